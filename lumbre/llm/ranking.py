"""One ranking from several scores on different scales (problem 5).

Leximin: each score becomes a percentile within its group, each item's percentiles are sorted ascending, and items are ordered by comparing these
vectors from their weakest entry on, so that no score's range counts and a weak score can't be hidden behind strong ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.plans.tables import materialise

#: Items of one group that are ranked in one task; larger groups are cut at quantiles.
BUCKET = 100_000


def _valid(score: Column) -> Column:
    value = score.cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), value)


def percentiles(items: DataFrame, group: list[str], scores: list[str], bucket: int = BUCKET) -> DataFrame:
    """(group, score_name, value, pct): the share of the group's scored items that a value beats, ties counted half, for each distinct value.

    A group of any size is cut at its own quantiles to buckets of about ``bucket`` items, which are ranked apart and shifted by the counts below them.
    """
    long = items.select(*group, F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), _valid(F.col(s)).alias("value")) for s in scores])).alias("x"))
    keys = [*group, "score_name"]
    values = long.select(*group, "x.*").where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    grid = F.array(*[F.lit(i / 256) for i in range(1, 256)])
    bounds = values.groupBy(*keys).agg(F.sum("n").alias("total"), F.percentile_approx("value", grid, 4096).alias("bounds"))
    bounds = bounds.withColumn("bounds", F.when(F.col("total") <= bucket, F.array().cast("array<double>")).otherwise(F.array_distinct("bounds")))
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = values.alias("v").join(bounds.alias("b"), on).select("v.*", "b.total", F.size(F.filter("b.bounds", lambda x: x < F.col("v.value"))).alias("bucket"))
    counts = rows.groupBy(*keys, "bucket").agg(F.sum("n").alias("held"))
    below = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows a group
    counts = counts.withColumn("before", F.coalesce(F.sum("held").over(below), F.lit(0))).drop("held")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "bucket"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    rows = rows.alias("r").join(counts.alias("c"), on).select("r.*", "c.before")
    within = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("n") / 2
    return rows.select(*keys, "value", (rank / F.col("total")).alias("pct"))


def _cut_percentiles(best: DataFrame, group: list[str], item: str, scores: list[str], bucket: int) -> DataFrame:
    """``best`` with <score>_pct, for groups of any size."""
    pct = percentiles(best, group, scores, bucket)
    long = best.select(*group, item, F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("value")) for s in scores])).alias("x")).select(*group, item, "x.*")
    keys = [*group, "score_name", "value"]
    on = F.col("l.value") == F.col("p.value")
    for k in keys[:-1]:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}"))
    got = long.alias("l").join(pct.alias("p"), on, "left").select("l.*", F.coalesce("p.pct", F.lit(0.0)).alias("pct"))
    return got.groupBy(*group, item).agg(*[F.max(F.when(F.col("score_name") == s, F.col("pct"))).alias(f"{s}_pct") for s in scores])


def _whole_percentiles(best: DataFrame, group: list[str], item: str, scores: list[str]) -> DataFrame:
    """The same for groups that fit a task each: a shuffle by group serves all windows."""
    whole = Window.partitionBy(*group)

    def pct(s: str) -> Column:
        below = F.rank().over(whole.orderBy(F.col(s).asc_nulls_last())) - 1
        same = F.count(s).over(Window.partitionBy(*group, s))
        return F.when(F.col(s).isNull(), 0.0).otherwise((below + same / 2) / F.count(s).over(whole))

    return best.select(*group, item, *[pct(s).alias(f"{s}_pct") for s in scores])


def _both(items: DataFrame, group: list[str], item: str, scores: list[str], bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """The percentiles and vectors of the groups that fit a task, and of the larger ones, if there are any."""
    best = materialise(items.groupBy(*group, item).agg(*[F.max(_valid(F.col(s))).alias(s) for s in scores]), "best")
    large = best.groupBy(*group).agg(F.count("*").alias("held")).where(F.col("held") > bucket)
    vector = F.array_sort(F.array(*[F.col(f"{s}_pct") for s in scores])).alias("vector")
    if large.limit(1).count() == 0:
        return _whole_percentiles(best, group, item, scores).select("*", vector), None
    large = materialise(large.select(*[F.col(k).alias(f"_{k}") for k in group]), "large")
    on = F.lit(True)
    for k in group:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    small = _whole_percentiles(best.join(large, on, "left_anti"), group, item, scores)
    return small.select("*", vector), _cut_percentiles(best.join(large, on, "left_semi"), group, item, scores, bucket).select("*", vector)


def leximin(items: DataFrame, group: list[str], item: str, scores: list[str], bucket: int = BUCKET) -> DataFrame:
    """(group, item, the scores' percentiles <score>_pct, vector): one row for each distinct item of a group.

    Of repeated rows of an item the best value of each score counts. A score that is null or NaN has percentile 0: what wasn't scored can't come first.
    ``vector`` is ascending; order by it descending, then by item, for the ranking.
    """
    small, large = _both(items, group, item, scores, bucket)
    return small if large is None else small.unionByName(large)


def ranked(items: DataFrame, group: list[str], item: str, scores: list[str], bucket: int = BUCKET) -> DataFrame:
    """``leximin`` with ``position`` from 1; ties by item. Groups larger than ``bucket`` are sorted in ranges of the whole order, so neither ties nor unscored items gather in one task."""
    small, large = _both(items, group, item, scores, bucket)
    order = [F.col("vector").desc(), F.col(item)]
    rows = small.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    if large is None:
        return rows
    cut = materialise(large.orderBy(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = cut.groupBy(*group, "_range").agg(F.count("*").alias("_held"))
    held = held.select("_range", *[F.col(k).alias(f"_{k}") for k in group], F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before")).withColumnRenamed("_range", "_r")
    on = F.col("_range") == F.col("_r")
    for k in group:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    nth = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return rows.unionByName(cut.join(held, on).withColumn("position", F.col("_before") + nth).select(*rows.columns))


def first_of_each(items: DataFrame, group: list[str], item: str, scores: list[str], bucket: int = BUCKET) -> DataFrame:
    """(group, item): the item that leads each group, of tied ones the first by item; groups without any scored item have none."""
    return ranked(items, group, item, scores, bucket).where((F.col("position") == 1) & (F.element_at("vector", -1) > 0)).select(*group, item)
