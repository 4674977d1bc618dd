"""Writers of documents, logs and indexes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_source(docs: DataFrame, path: str) -> None:
    """JSON files below one folder for each source, replacing what was there. Input: source, doc_id, tokens."""
    docs.write.mode("overwrite").partitionBy("source").json(path)


def per_document(docs: DataFrame, path: str) -> None:
    """A folder for each document; for a few documents only."""
    docs.write.mode("overwrite").partitionBy("doc_id").json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_new_urls(urls: DataFrame, path: str) -> None:
    """Adds the addresses that the log doesn't have yet, so that writing them again changes nothing."""
    from lumbre.operators.crawl import new_urls

    spark = urls.sparkSession
    if exists(spark, path):  # any other failure to read it is raised
        urls = new_urls(urls, spark.read.text(path).select(F.col("value").alias("url")))
    else:
        urls = urls.select(F.trim("url").alias("url")).where("url != ''").distinct()
    urls.select("url").write.mode("append").text(path)


def exists(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def raw_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes each page (name, html) to a file of its own in ``folder``, a path or address of a file system that all executors share; returns (name, n_bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for rows in batches:
            sizes = []
            for name, html in zip(rows["name"], rows["html"]):
                content = (html or "").encode("utf-8", errors="ignore")
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
                sizes.append(len(content))
            yield pd.DataFrame({"name": rows["name"], "n_bytes": sizes})

    return pages.select("name", "html").mapInPandas(run, "name string, n_bytes long")


def report(spark, value: dict[str, object], path: str) -> None:
    """A report (of a crawl or an evaluation) as one indented JSON file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, default=str), "utf-8"))
    out.close()


def save_tables(tables: dict[str, DataFrame], settings: dict[str, object], path: str) -> None:
    """An index as Parquet tables and a row of settings."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_tables(spark, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict[str, object]]:
    from pyspark.errors import AnalysisException

    try:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        return {n: spark.read.parquet(f"{path}/{n}") for n in names}, settings
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
