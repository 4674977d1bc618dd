"""The queries of the training-data problems, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbre import problems
from lumbre.llm import language, mixture, neardup, pack, quality, ranking, repeated, split, template
from lumbre.operators import timeline
from lumbre.plans.tables import materialise, table

SCORES = ["lsi_score", "lexical_overlap", "title_match"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, sf_dir, "crawled_documents"), F.col("doc_id"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, doc_id, url, content, cluster, day): crawled documents with the cluster of their article and the normalised day of their review."""
    docs = table(spark, sf_dir, "crawled_documents").select("seq", "doc_id", "url", "content")
    dates = timeline.normalise(problems._timestamps(spark, sf_dir).where("field_name = 'review_date'"))
    days = dates.groupBy(F.col("record_key").alias("seq")).agg(F.min(F.substring("utc_form", 1, 10)).alias("day"))
    return docs.join(repeated.article_clusters(docs), "seq", "left").join(days, "seq", "left")


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least two publication dates, with documents of near-duplicate articles counted once."""
    return repeated.repeated_lines(materialise(_clustered(spark, sf_dir), "clustered"), F.col("cluster"), F.col("day"), min_dates=2)


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialise(_clustered(spark, sf_dir), "clustered")
    return repeated.without_lines(docs, repeated.repeated_lines(docs, F.col("cluster"), F.col("day"), min_dates=2)).select("seq", "content")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_set, record_key, label, segments): the articles of crawled documents, and reviews, with their languages."""
    docs = table(spark, sf_dir, "crawled_documents")
    model = language.fit(table(spark, sf_dir, "documents"))
    pages = template.articles(docs).join(docs.select("seq", "language"), "seq")
    crawled = pages.select(F.lit("crawled_documents").alias("record_set"), F.col("seq").alias("record_key"), F.col("language").alias("label"), F.col("article").alias("text"))
    reviews = table(spark, sf_dir, "new_york_hotels_reviews")
    reviews = reviews.select(F.lit("new_york_hotels_reviews").alias("record_set"), F.col("review_id").alias("record_key"), F.lit(None).cast("string").alias("label"), F.col("review_text").alias("text"))
    return language.segments(crawled.unionByName(reviews), model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.languages(_labelled(spark, sf_dir)).withColumn("code", language.label_code(F.col("label")))
    alone = lambda code: F.col("langs") == F.array(code)
    right = F.when(F.col("record_set") == "crawled_documents", F.col("code").isNotNull() & alone(F.col("code"))).otherwise(alone(F.lit("en")))
    return rows.where(~right & (F.size("langs") > 0)).select("record_set", "record_key", F.explode("langs").alias("lang")).distinct()


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.languages(_labelled(spark, sf_dir))
    return rows.select("record_set", "record_key", "main", F.col("confidence").alias("main_confidence"), F.posexplode("segments").alias("segment_no", "s")).select("record_set", "record_key", "main", "main_confidence", "segment_no", "s.*")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "crawled_documents"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(table(spark, sf_dir, "crawled_documents"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text joined again from its pieces without their overlaps, and whether all pieces fit and begin with the overlap that is asked for."""
    piece = split.split_texts(table(spark, sf_dir, "crawled_documents"))
    lead = F.when(F.col("piece_no") == 1, 0).otherwise(split.OVERLAP)
    rows = piece.withColumn("own", F.expr("substring(piece, 1)") if not split.OVERLAP else F.substring(F.col("piece"), lead + 1, F.length("piece"))).withColumn("end", F.col("start") + F.col("n_chars"))
    before = F.lag("end").over(Window.partitionBy("seq").orderBy("piece_no"))
    right = (F.col("n_chars") <= split.LIMIT) & (F.coalesce(before, F.lit(0)) - F.col("start") == lead)
    rows = rows.withColumn("right", right).groupBy("seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "").alias("text"), F.bool_and("right").alias("pieces_right"))
    return rows.select("seq", F.length("text").alias("n_chars"), F.md5(F.encode("text", "utf-8")).alias("text_md5"), "pieces_right")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_set, key, text): the articles of crawled documents, and reviews."""
    pages = materialise(template.articles(table(spark, sf_dir, "crawled_documents")), "articles")
    pages = pages.select(F.lit("crawled_documents").alias("record_set"), F.col("seq").alias("key"), F.col("article").alias("text"))
    reviews = table(spark, sf_dir, "new_york_hotels_reviews")
    return pages.unionByName(reviews.select(F.lit("new_york_hotels_reviews").alias("record_set"), F.col("review_id").alias("key"), F.col("review_text").alias("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.record_pairs(_records(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_of_each(table(spark, sf_dir, "search_results"), ["system", "query_id"], "doc_id", SCORES)


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.ranked(table(spark, sf_dir, "search_results"), ["system", "query_id"], "doc_id", SCORES)
    return rows.select("system", "query_id", "doc_id", "position", *[F.round(F.col("vector")[i], 9).alias(name) for i, name in enumerate(("weakest", "middle", "strongest"))])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.boilerplate_lines(table(spark, sf_dir, "crawled_documents"))


def p6_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.articles(table(spark, sf_dir, "crawled_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill_containers(table(spark, sf_dir, "documents")).where("parts > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill_containers(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.report(materialise(pack.fill_containers(table(spark, sf_dir, "documents")), "containers"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p9_report_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four times the largest size at which all shares are met: the scarce sources are clamped at their caps, the others take what these leave."""
    return mixture.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"), total=lambda even: 4 * even)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagged(table(spark, sf_dir, "documents")).where("not_prose").select("doc_id").distinct()


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flagged(table(spark, sf_dir, "documents"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "p" and name[1].isdigit()}

_SITE = r"regexp_replace(regexp_extract(lower(coalesce(url, '')), '^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]*)', 1), '^(www|m)\.', '')"
_VALID = ", ".join(f"max(CASE WHEN NOT isnan({s}) THEN {s} END) AS {s}" for s in SCORES)
_PCT = ", ".join(
    f"CASE WHEN {s} IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY system, query_id ORDER BY {s} NULLS LAST) - 1 + count({s}) OVER (PARTITION BY system, query_id, {s}) / 2.0) / count({s}) OVER (PARTITION BY system, query_id) END::DOUBLE"
    for s in SCORES
)
_LEXIMIN = f"""WITH best AS (SELECT system, query_id, doc_id, {_VALID} FROM search_results GROUP BY ALL),
    vectors AS (SELECT system, query_id, doc_id, list_sort([{_PCT}]) AS vector FROM best),
    placed AS (SELECT *, row_number() OVER (PARTITION BY system, query_id ORDER BY vector DESC, doc_id)::BIGINT AS position FROM vectors)"""
ORACLE = {
    "p1_found": rf"""WITH docs AS (SELECT seq, doc_id, {_SITE} AS site, content FROM crawled_documents WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> ''),
        lines AS (SELECT seq, doc_id, site, no, lower(regexp_replace(line, '[^\p{{L}}]+', '', 'g')) AS k FROM
            (SELECT seq, doc_id, site, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM docs)),
        found AS (SELECT site, k FROM lines JOIN (SELECT site, count(DISTINCT doc_id) AS n FROM docs GROUP BY site) USING (site) WHERE k <> '' GROUP BY site, k, n
            HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.15 * n)
        SELECT DISTINCT seq, no::BIGINT AS line_no FROM lines JOIN found USING (site, k)""",
    "p3_rejoined": "SELECT seq, length(content)::INT AS n_chars, md5(content) AS text_md5, true AS pieces_right FROM crawled_documents WHERE content IS NOT NULL",
    "p5_ranking": f"""{_LEXIMIN} SELECT system, query_id, doc_id, position, round(vector[1], 9) AS weakest, round(vector[2], 9) AS middle, round(vector[3], 9) AS strongest FROM placed""",
    "p5_found": f"""{_LEXIMIN} SELECT system, query_id, doc_id FROM placed WHERE position = 1 AND vector[3] > 0""",
    "p3_found": "SELECT DISTINCT seq FROM crawled_documents WHERE length(content) > 4000",
}
