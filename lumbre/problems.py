"""Queries of the core's data problem: timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions.hosts import site_of
from lumbre.operators import timeline
from lumbre.plans.tables import table


def _timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written times of crawled documents and reviews, with the zone and locale of their site or crawl node."""
    sites = table(spark, sf_dir, "sites").select(F.col("domain").alias("source"), F.col("tz_name").alias("zone"), (F.col("locale") == "en-US").alias("month_first"))
    nodes = table(spark, sf_dir, "crawl_nodes").select(F.col("crawl_node").alias("source"), F.col("tz_name").alias("zone"), (F.col("locale") == "en-US").alias("month_first"))
    docs = table(spark, sf_dir, "crawled_documents").select(F.lit("review_date").alias("field_name"), F.col("seq").alias("record_key"), site_of(F.col("url")).alias("source"), F.col("review_date").alias("value"))
    both = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("reviewed_at", "crawled_at")])
    reviews = table(spark, sf_dir, "new_york_hotels_reviews").select(F.col("review_id").alias("record_key"), F.col("crawl_node").alias("source"), F.explode(both).alias("x"))
    reviews = reviews.select("x.field_name", "record_key", "source", "x.value")
    return docs.join(sites, "source", "left").unionByName(reviews.join(nodes, "source", "left"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.certain(timeline.normalise(_timestamps(spark, sf_dir))).distinct()


def p7_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.normalise(_timestamps(spark, sf_dir)).select("field_name", "record_key", "value", F.size("readings").alias("n_readings"), "utc_form")


def p7_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several readings, with both orders of slash dates read, and the reading chosen along their source's records."""
    rows = timeline.normalise(_timestamps(spark, sf_dir), strict=False).where(F.size("readings") > 1)
    return rows.select("field_name", "record_key", "value", F.size("readings").alias("n_readings"), "pick", "utc_form")


QUERIES = {"p7_found": p7_found, "p7_normalised": p7_normalised, "p7_chosen": p7_chosen}
