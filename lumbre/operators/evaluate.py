"""Ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hits(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, hit) of a run (query_id, doc_id, rank from 1)."""
    marked = qrels.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    return run.join(marked, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def ideal(relevant: Column, k: int) -> Column:
    n = F.least(relevant, F.lit(k)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))).otherwise(0.0)


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, depths: tuple[int, ...] = (3, 5)) -> DataFrame:
    """(query_id, p_at_<k>..., ap, ndcg_at_5): a row for each of ``queries`` (query_id), 0 where nothing was found or nothing is relevant.

    Precision divides by k, average precision by the number of relevant documents; gains are binary.
    """
    hits = _hits(run, qrels)
    seen = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("seen", seen)
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    gain = F.sum(F.when(F.col("rank") <= 5, F.col("hit") / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0))
    sums = hits.groupBy("query_id").agg(*[(at(k) / k).alias(f"p_at_{k}") for k in depths], F.sum(F.col("hit") * F.col("seen") / F.col("rank")).alias("s"), gain.alias("dcg"))
    relevant = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = queries.select("query_id").join(sums, "query_id", "left").join(relevant, "query_id", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select("query_id", *[f"p_at_{k}" for k in depths], share(F.col("s"), F.col("relevant")).alias("ap"), share(F.col("dcg"), ideal(F.col("relevant"), 5)).alias("ndcg_at_5"))


def summary(metrics: DataFrame) -> DataFrame:
    """(p_at_3, p_at_5, map_score, ndcg_at_5): means over queries, 0 for none."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return metrics.agg(mean("p_at_3").alias("p_at_3"), mean("p_at_5").alias("p_at_5"), mean("ap").alias("map_score"), mean("ndcg_at_5").alias("ndcg_at_5"))


def delta(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """Refined minus baseline, of two summaries."""
    return refined.alias("r").crossJoin(baseline.alias("b")).select(*[(F.col(f"r.{c}") - F.col(f"b.{c}")).alias(c) for c in baseline.columns])  # one row each


def insufficient(run: DataFrame, least: int = 3, top_score: float = 0.28, mean_score: float = 0.22) -> DataFrame:
    """(query_id, insufficient): too few results, a weak first one or a weak mean of the first three; a missing score is 0."""
    score = F.coalesce("score", F.lit(0.0))
    rows = run.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, score)).alias("first"), F.avg(F.when(F.col("rank") <= 3, score)).alias("mean"))
    return rows.select("query_id", ((F.col("n") < least) | (F.col("first") < top_score) | (F.col("mean") < mean_score)).alias("insufficient"))
