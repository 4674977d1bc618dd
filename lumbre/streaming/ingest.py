"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.operators.vectors import chunks


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Appends what is new in ``source`` (Parquet files) to the chunk table ``target``, each file once; returns the number of batches run.

    A batch is written to a folder of its own number, so a batch run again after a failure replaces its first try.
    """
    make = transform or (lambda docs: chunks(docs))
    ran = []

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        ran.append(number)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)


def visited_log(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Appends addresses of text files to ``target``, each once over all runs: the state outlives a run."""
    urls = spark.readStream.text(source).select(F.trim("value").alias("url")).where("url != ''").dropDuplicates(["url"])
    urls.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
