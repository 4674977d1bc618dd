"""Mixing sources to target weights (problem 9).

Capped water-filling: sources that can't give their share, even when each document is used the most times allowed, are clamped there, and the rest
of the size is dealt to the others in proportion to their weights, until all fit. Every document is then used the whole number of times, and a
seeded part of them once more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.llm.tokens import VOCABULARY, token_count
from lumbre.plans.tables import materialise

#: Hash ranges in which a source's documents are ordered, each by one task.
RANGES = 4096


def largest_even(weights: dict[str, float], most: dict[str, float]) -> float:
    """The largest size at which every source with a weight and anything to give keeps its weight: what the scarcest allows."""
    live = {s: w for s, w in weights.items() if w > 0 and most.get(s, 0) > 0}
    return sum(live.values()) * min((most[s] / w for s, w in live.items()), default=0.0)


def water_fill(weights: dict[str, float], most: dict[str, float], total: float | None) -> dict[str, float]:
    """Size to take of each source. most: what it can give at its highest number of uses. Without ``total``: the largest at which all sources that have anything keep their weights."""
    live = {s: w for s, w in weights.items() if w > 0 and most.get(s, 0) > 0}
    if not live:
        return dict.fromkeys(weights, 0.0)
    if total is None:
        total = largest_even(live, most)
    goal, left = dict.fromkeys(weights, 0.0), float(total)
    while live and left > 0:
        scale = left / sum(live.values())
        over = [s for s, w in live.items() if w * scale > most[s] * (1 + 1e-12)]
        for s in over or live:
            goal[s] = min(most[s], live[s] * scale)
        if not over:
            break
        left -= sum(goal[s] for s in over)
        live = {s: w for s, w in live.items() if s not in over}
    return goal


def sizes_of(docs: DataFrame, targets: DataFrame, key: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(key, source, tokens, u): the documents of the sources in ``targets``; ``u`` is their place, from 0 to 1, in the seeded order of copies."""
    wanted = docs.join(F.broadcast(targets.select(F.col("source").alias(source)).distinct()), source, "left_semi")  # a table of settings, collected below
    return wanted.select(F.col(key), F.col(source).alias("source"), token_count(F.col(text).cast("string"), vocabulary).cast("long").alias("tokens")).where(F.col("tokens") > 0)


def mixture(
    docs: DataFrame, targets: DataFrame, total: float | Callable[[float], float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = 7
) -> DataFrame:
    """(key, source, tokens, times): the documents of the mixture and how often each is used, at least once and at most the source's ``max_repeats`` times.

    ``targets`` (source, target_share, max_repeats) is a table of settings, read by the driver; shares needn't sum to 1, a null cap is 1. Documents of other
    or null sources, and null or empty texts, aren't used. A source without documents has its share dealt to the others. total: tokens of the mixture, or what to make
    of the largest size at which all sources reach their shares, which is the default; beyond it sources are clamped at their caps.
    """
    return _plan(docs, targets, total, key, text, source, vocabulary, seed)[0]


def _by_source(values: dict[str, object], kind: str) -> Column:
    """A value for each source of the settings, as literals; null for others."""
    return F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))])[F.col("source")] if values else F.lit(None).cast(kind)


def _plan(docs: DataFrame, targets: DataFrame, total, key: str, text: str, source: str, vocabulary: str, seed: int):
    spark = docs.sparkSession
    sizes = sizes_of(docs, targets, key, text, source, vocabulary).withColumn("h", F.xxhash64(F.lit(seed), F.col(key), "source"))
    rows = materialise(sizes.withColumn("range", F.shiftright("h", 52)).withColumn("once", F.lit(False)), "sizes")  # 4096 ranges of the order
    held = {r["source"]: (r["tokens"], r["docs"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}  # one row for each source of the settings
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] if r["max_repeats"] is not None else 1)) for r in targets.where(F.col("source").isNotNull()).collect()}
    have = {s: held.get(s, (0, 0))[0] for s in wanted}
    weights, most = {s: w for s, (w, _) in wanted.items()}, {s: have[s] * cap for s, (_, cap) in wanted.items()}
    goal = water_fill(weights, most, total(largest_even(weights, most)) if callable(total) else total)
    whole = {s: min(cap, int(goal[s] / have[s] + 1e-9)) if have[s] else 0 for s, (_, cap) in wanted.items()}
    part = {s: max(goal[s] - whole[s] * have[s], 0.0) if whole[s] < cap else 0.0 for s, (_, cap) in wanted.items()}
    lines = [(s, have[s], held.get(s, (0, 0))[1], w, cap, float(goal[s]), goal[s] > 0 and goal[s] >= most[s] * (1 - 1e-9)) for s, (w, cap) in wanted.items()]
    plan = spark.createDataFrame(lines, "source string, available long, docs long, target_share double, max_repeats int, goal double, clamped boolean")
    for _ in range(2):  # a second run passes over the texts too large for what the first left open
        rows = materialise(_run(rows, key, _by_source(_gaps(rows, part), "double")), "run")
    # The text that comes closest to filling what the run of whole texts leaves open.
    gap = _by_source(_gaps(rows, part), "double")
    off = F.abs(gap - F.col("tokens"))
    closest = rows.where(~F.col("once") & (off < gap)).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("h"), F.col(key).alias("extra"))).alias("x"))
    rows = rows.join(F.broadcast(closest.select("source", F.col("x.extra").alias("_extra"), F.col("x.h").alias("_h"))), "source", "left")  # a row for each source of the settings
    extra = F.coalesce(~F.col("once") & (F.col(key) == F.col("_extra")) & (F.col("h") == F.col("_h")), F.lit(False))
    rows = rows.withColumn("times", _by_source(whole, "int") + F.when(F.col("once") | extra, 1).otherwise(0))
    return rows.where(F.col("times") > 0).select(key, "source", "tokens", F.col("times").cast("int").alias("times")), plan


def _gaps(rows: DataFrame, part: dict[str, float]) -> dict[str, float]:
    """What each source still lacks of its part."""
    held = rows.where("once").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()  # a row for each source of the settings
    return part | {r["source"]: part[r["source"]] - r["tokens"] for r in held}


def _run(rows: DataFrame, key: str, gap: Column) -> DataFrame:
    """Marks, in the seeded order, the texts that fit one after another in what their source lacks."""
    rows = rows.withColumn("size", F.when(~F.col("once") & (F.col("tokens") <= gap), F.col("tokens")))
    sums = rows.groupBy("source", "range").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("held"))
    below = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows a source
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(below), F.lit(0))).drop("held")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source", "range").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(sums, ["source", "range"]).withColumn("upto", upto)
    return rows.withColumn("once", F.col("once") | F.coalesce(F.col("size").isNotNull() & (F.col("upto") <= gap), F.lit(False))).drop("size", "before", "upto")


def report(
    docs: DataFrame, targets: DataFrame, total: float | Callable[[float], float] | None = None, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, seed: int = 7
) -> DataFrame:
    """(source, target_share, reached_share, repeats, most_uses, max_repeats, clamped, docs, docs_used, available_tokens, tokens): what a mixture came to, a row for each source of the settings.

    ``repeats`` is the mean number of uses of the source's documents; shares are of the mixture's tokens.
    """
    mix, plan = _plan(docs, targets, total, key, text, source, vocabulary, seed)
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("docs_used"), F.max("times").alias("most_uses"))
    rows = plan.join(used, "source", "left").fillna(0, ["tokens", "docs_used", "most_uses"])
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy()))  # over the settings' rows
    repeats = F.coalesce(F.try_divide(F.col("tokens"), F.col("available")), F.lit(0.0))
    return rows.select("source", "target_share", F.coalesce(share, F.lit(0.0)).alias("reached_share"), repeats.alias("repeats"), "most_uses", "max_repeats", "clamped", "docs", "docs_used", F.col("available").alias("available_tokens"), "tokens")
