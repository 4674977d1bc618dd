"""Breadth-first crawl over a table of pages: one join for each depth; and a search of the web over a table of hits."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lumbre.operators import web
from lumbre.plans.tables import materialise


@dataclass
class Settings:
    """What a crawl is told. ``request_delay`` and ``timeout`` are for a fetcher of live pages; a table of pages needs neither."""

    seed_urls: list[str]
    allowed_domains: list[str] = field(default_factory=list)
    max_depth: int = 2
    max_pages: int = 100
    request_delay: float = 1.0
    timeout: float = 10.0
    user_agent: str = "lumbre"
    obey_robots: bool = True
    include_url_patterns: list[str] = field(default_factory=list)
    exclude_url_patterns: list[str] = field(default_factory=lambda: list(web.EXCLUDED))
    progress_every_pages: int = 10
    expand_persisted: bool = True

    def __post_init__(self) -> None:
        self.seed_urls = [u.strip() for u in self.seed_urls if u and u.strip()]
        if not self.seed_urls:
            raise ValueError("at least one seed address is needed")
        self.allowed_domains = sorted({web.clean_domain(d) for d in self.allowed_domains if d and d.strip()} - {""})


def _robots(url: Column, rules: Column, agent: str) -> Column:
    """Whether the rules of the address's host let the agent through; a host without a row has rules that couldn't be read, which forbid."""

    @F.pandas_udf(BooleanType())
    def allowed(urls: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([web.robots_allow(t, agent, u) for u, t in zip(urls, texts)], dtype=bool)

    return allowed(url, rules)


def _nth(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``nth``, their place in the order from 0, counted in ranges of it, so that no task holds all."""
    from pyspark.sql import Window

    cut = materialise(rows.orderBy(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = cut.groupBy("_range").agg(F.count("*").alias("_held")).select("_range", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return cut.join(held, "_range").withColumn("nth", F.col("_before") + within).drop("_range", "_before")


def crawl(
    pages: DataFrame,
    seeds: list[str],
    domains: list[str],
    max_depth: int = 2,
    max_pages: int = 100,
    persisted: DataFrame | None = None,
    expand_persisted: bool = True,
    include: list[str] = (),
    exclude: list[str] = tuple(web.EXCLUDED),
    robots: DataFrame | None = None,
    agent: str = "lumbre",
    progress=None,
) -> DataFrame:
    """(url, depth, parent_url, status, final_url): the addresses reached, in the order of depth and address, until ``max_pages`` of them were pages.

    pages: (url, html) and, where known, (status_code, final_url, content_type): the snapshot that stands for the web. robots: (host, rules), obeyed if given. status:
    ``document``, ``persisted`` (known before: its links are followed at any depth, if ``expand_persisted``, but no document is made), ``error`` (not in the
    snapshot), ``http_error`` (a code of 400 or more), ``policy`` (a seed, or where an address led, that isn't allowed), ``robots`` or ``non_html``. Each address is visited
    once, from the first parent in address order; links are taken relative to where the address led. ``progress`` is called with the counts so far after each depth.
    """
    spark = pages.sparkSession
    pages = pages.select("url", "html", *[F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in (("status_code", "int"), ("final_url", "string"), ("content_type", "string"))])
    pages = pages.withColumn("final_url", F.coalesce(web.normalised_url(F.col("url"), F.col("final_url")), "url"))
    fits = lambda c: web.allowed(F.col(c), list(domains), include, exclude)
    schema = "url string, depth int, parent_url string"
    frontier = spark.createDataFrame([(u, 0, None) for u in dict.fromkeys(web.normalise_url(u, u) for u in seeds) if u], schema)
    known = (persisted.select("url").distinct() if persisted is not None else spark.createDataFrame([], "url string")).withColumn("known", F.lit(True))
    every = materialise(web.links(pages.select("url", "html", "final_url"), list(domains), include, exclude, base="final_url"), "links")
    stored = pages.select("url", "final_url", "status_code", "content_type", F.lit(True).alias("stored"))
    html = F.coalesce(F.col("content_type"), F.lit("text/html")).contains("text/html")
    levels, left = [], max_pages
    while left > 0:
        level = frontier.join(known, "url", "left").join(stored, "url", "left")
        if robots is not None:
            rules = robots.select(F.lower("host").alias("_host"), "rules")
            level = level.join(rules, web.host(F.col("url")) == F.col("_host"), "left").withColumn("open", _robots(F.col("url"), F.col("rules"), agent))
        status = F.when(~fits("url"), "policy")
        status = status.when(~F.col("open"), "robots") if robots is not None else status
        status = status.when(F.col("stored").isNull(), "error").when(F.coalesce("status_code", F.lit(200)) >= 400, "http_error").when(~fits("final_url"), "policy").when(~html, "non_html")
        level = materialise(level.select("url", "depth", "parent_url", status.when(F.col("known"), "persisted").otherwise("document").alias("status"), F.coalesce("final_url", "url").alias("final_url")), "level")
        fetched = F.col("status").isin("document", "persisted")
        n, got = level.agg(F.count("*"), F.count_if(fetched)).first()
        if not n:
            break
        if got > left:  # in address order, up to the last page that may be fetched
            last = _nth(level.where(fetched), "url").where(F.col("nth") == left - 1).first()["url"]
            level, got = materialise(level.where(F.col("url") <= last), "level"), left
        levels.append(level)
        left -= got
        if progress:
            progress({"depth": len(levels) - 1, "pages": max_pages - left, "addresses": n})
        visited = reduce(DataFrame.unionByName, [x.select("url") for x in levels])
        grown = (F.col("status") == "document") & (F.col("depth") < max_depth)
        if expand_persisted:
            grown = grown | (F.col("status") == "persisted")
        found = level.where(grown).select("url", "depth", "final_url").join(every, "url").select(F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), F.col("final_url").alias("parent_url"))
        frontier = found.join(visited, "url", "left_anti").groupBy("url").agg(F.min("depth").alias("depth"), F.min("parent_url").alias("parent_url"))
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], f"{schema}, status string, final_url string")


COUNTERS = ["seed_urls", "urls_visited", "pages_fetched", "documents_saved", "links_discovered", "links_enqueued", "errors", "skipped_policy", "skipped_robots", "skipped_non_html", "skipped_duplicate", "skipped_persisted"]


def counters(visited: DataFrame, links_found: DataFrame) -> DataFrame:
    """One row with COUNTERS. visited: (url, depth, status) of a crawl; links_found: (url, link) of the pages. A duplicate is a link to an address that was reached from another page."""
    status = lambda *names: F.count_if(F.col("status").isin(*names))
    counts = visited.agg(
        F.count_if(F.col("depth") == 0).alias("seed_urls"),
        F.count_if(~F.col("status").isin("policy", "robots")).alias("urls_visited"),
        status("document", "persisted").alias("pages_fetched"),
        status("document").alias("documents_saved"),
        F.count_if(F.col("depth") > 0).alias("links_enqueued"),
        status("error", "http_error").alias("errors"),
        status("policy").alias("skipped_policy"),
        status("robots").alias("skipped_robots"),
        status("non_html").alias("skipped_non_html"),
        status("persisted").alias("skipped_persisted"),
    )
    pages = visited.where(F.col("status").isin("document", "persisted")).select("url")
    seen = links_found.join(pages, "url", "left_semi").select("link").agg(F.count("*").alias("links_discovered"), F.countDistinct("link").alias("_links"))
    both = counts.crossJoin(seen)  # one row each
    return both.withColumn("skipped_duplicate", F.col("links_discovered") - F.col("_links")).select(*COUNTERS)


def run(settings: Settings, pages: DataFrame, persisted: DataFrame | None = None, robots: DataFrame | None = None, progress=None) -> tuple[DataFrame, DataFrame, dict[str, object]]:
    """(documents, errors, report) of a crawl: pages with their fields, depth and parent; (url, depth, reason, detail, timestamp); run id, times, settings and counters."""
    began = datetime.now(UTC)
    seen = crawl(
        pages, settings.seed_urls, settings.allowed_domains, settings.max_depth, settings.max_pages, persisted, settings.expand_persisted,
        settings.include_url_patterns, settings.exclude_url_patterns, robots if settings.obey_robots else None, settings.user_agent, progress,
    )
    made = seen.where("status = 'document'").join(pages.select("url", "html"), "url").select(F.col("final_url").alias("url"), "depth", "parent_url", "html")
    documents = web.documents(made, "url").join(made.select("url", "depth", "parent_url"), "url")
    documents = documents.select(web.doc_id(F.col("url")).alias("doc_id"), "url", web.host(F.col("url")).alias("domain"), *[c for c in documents.columns if c != "url"], F.lit(began.isoformat()).alias("scraped_at"))
    code = F.concat(F.lit("status_code="), F.col("status_code").cast("string")) if "status_code" in pages.columns else F.lit(None).cast("string")
    failed = seen.where(F.col("status").isin("error", "http_error")).join(pages.drop("html", "final_url"), "url", "left")
    reason = F.when(F.col("status") == "http_error", "http_error").otherwise("request-exception")
    errors = failed.select("url", "depth", reason.alias("reason"), F.when(F.col("status") == "http_error", code).alias("detail"), F.lit(began.isoformat()).alias("timestamp"))
    stats = counters(seen, web.links(pages.select("url", "html"), settings.allowed_domains, settings.include_url_patterns, settings.exclude_url_patterns)).first().asDict()
    ended = datetime.now(UTC)
    report = {"run_id": began.strftime("%Y%m%d_%H%M%S"), "started_at": began.isoformat(), "finished_at": ended.isoformat(), "elapsed_seconds": round((ended - began).total_seconds(), 3), "config": asdict(settings), "stats": stats}
    return documents, errors, report


def web_search(hits: DataFrame, pages: DataFrame, visited: DataFrame, query: str, most: int = 5) -> DataFrame:
    """(doc_id, url, fields of the page): the pages behind the first ``most`` new hits of a query, in the order of ``place``.

    hits: (query, place, url), what a search engine gave; pages: (url, html, status_code), of which only those of code 200 count. Blank, repeated and visited addresses are passed over.
    """
    wanted = hits.where((F.trim("query") == query.strip()) & (F.trim(F.coalesce("url", F.lit(""))) != "")) if query and query.strip() else hits.limit(0)
    first = wanted.groupBy(F.trim("url").alias("url")).agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti")
    chosen = first.orderBy("place", "url").limit(max(int(most), 0))
    found = chosen.join(pages.where("status_code = 200").select("url", "html"), "url")
    return web.documents(found, "url").withColumn("doc_id", web.doc_id(F.col("url")))


def new_urls(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct trimmed addresses that weren't visited."""
    return urls.select(F.trim("url").alias("url")).where("url != ''").distinct().join(visited.select("url"), "url", "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; keys are shuffled with whole rows once, and copies within a partition are dropped before."""
    names = [c for c in rows.columns if c != key]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def fill_absent(documents: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with their documents' columns; of columns that both have, the document's counts, even where it is null, unless there is no document."""
    both = [c for c in hits.columns if c in documents.columns and c != key]
    docs = documents.select(key, F.lit(True).alias("_found"), *[F.col(c).alias(f"_d_{c}") for c in documents.columns if c != key])
    rows = hits.join(docs, key, "left")
    own = [F.when(F.col("_found"), F.col(f"_d_{c}")).otherwise(F.col(c)).alias(c) if c in both else F.col(c) for c in hits.columns]
    extra = [F.col(f"_d_{c}").alias(c) for c in documents.columns if c != key and c not in hits.columns]
    return rows.select(*own, *extra)


def latest_run(runs: DataFrame) -> DataFrame:
    """(path): of (run_id, path), the run with the greatest name."""
    return runs.agg(F.max_by("path", "run_id").alias("path"))


def overwrite(rows: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with their metadata: of columns that both have, the metadata's counts, even where it is null, unless there is none."""
    return fill_absent(metadata, rows, key)


def with_metadata(ids: DataFrame, metadata: DataFrame, key: str = "doc_id") -> DataFrame:
    """``metadata`` and, for each id that has none, a row with nothing but the id."""
    missing = ids.select(key).distinct().join(metadata.select(key), key, "left_anti")
    return metadata.unionByName(missing, allowMissingColumns=True)
