"""Readers of files as documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumbre.functions.text import column_name, slugify
from lumbre.operators.web import html_text

#: Suffixes of files that are read, and names of text columns in the order they are preferred.
EXTENSIONS = [".csv", ".txt", ".md", ".html", ".docx", ".json", ".jsonl"]
TEXT_COLUMNS = ["review_text", "review", "text", "content", "comment", "comments", "description", "body", "review_body", "full_review", "content_text"]
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def discover(spark: SparkSession, folder: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, slug, suffix) of the files below a folder, by path; none if it doesn't exist."""
    if "://" not in folder and not Path(folder).exists():
        return spark.createDataFrame([], "path string, slug string, suffix string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select("path", slugify(F.regexp_replace(name, r"\.[^.]*$", "")).alias("slug"), suffix.alias("suffix")).where(F.col("suffix").isin([e.lower() for e in extensions])).orderBy("path")


def json_strings(node: object, text_fields: list[str] | None = None) -> list[str]:
    """Non-blank string leaves in document order; of a record with text in any of ``text_fields``, those only."""
    out, waiting = [], [(node, tuple(text_fields or ()))]
    while waiting:
        x, wanted = waiting.pop()
        below: list = []
        if isinstance(x, str):
            out += [x.strip()] if x.strip() else []
        elif isinstance(x, list):
            below = x
        elif isinstance(x, dict):
            below = list(x.values())
            named = [x[f] for f in wanted if f in x]
            if json_strings(named):
                below, wanted = named, ()
        waiting += [(y, wanted) for y in reversed(below)]
    return out


@F.pandas_udf(StringType())
def json_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All string leaves of a JSON text, a line each; null for a malformed one."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else "\n".join(json_strings(json.loads(text)))
        except ValueError:
            return None

    for texts in batches:
        yield texts.map(one)


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs of a word-processing file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
    return "\n".join(p for p in paragraphs if p.strip())


def _read_whole(suffix: str, content: bytes) -> str | None:
    try:
        text = content.decode("utf-8", errors="replace")
        if suffix == ".html":
            return html_text(text)
        if suffix == ".docx":
            return docx_text(content)
        if suffix == ".json":
            return "\n".join(json_strings(json.loads(text)))
        return text
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None


def whole_files(spark: SparkSession, folder: str, extensions: list[str] = (".txt", ".md", ".html", ".docx", ".json")) -> DataFrame:
    """(doc_id, text): a document for each file; unreadable ones are left out."""
    files = discover(spark, folder, list(extensions))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["slug"] + "_doc", "text": [_read_whole(s, c) for s, c in zip(rows["suffix"], rows["content"])]})

    return content.join(files, "path").select("slug", "suffix", "content").mapInPandas(run, "doc_id string, text string").where("text is not null")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Records of a JSONL file in ``schema``. Tolerant: blank and malformed lines are skipped. Strict: they raise."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(record.alias("r")).where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")


def csv_rows(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV file with a header: short rows are padded with nulls, rows with too many fields are left out."""
    head = spark.read.option("header", True).option("multiLine", True).option("sep", delimiter).option("escape", '"').csv(path)
    names = head.columns
    schema = ", ".join(f"`{n}` string" for n in names) + ", _more string"
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("sep", delimiter).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.col("_more").isNull()).select(names).toDF(*[n.replace("﻿", "") for n in names])


def text_column(df: DataFrame, preferred: str | None = None, rows: int = 200) -> str | None:
    """The text column by name, else the one with the longest mean text over its first ``rows`` values (a guess by the head is the feature); the first of equals."""
    by_name = {column_name(c): c for c in reversed(df.columns)}
    for want in [*([column_name(preferred)] if preferred else []), *TEXT_COLUMNS]:
        if want in by_name:
            return by_name[want]
    best, longest = None, 0.0
    for c in df.columns:
        mean = df.select(F.col(c).cast("string").alias("v")).where("v is not null").limit(rows).agg(F.avg(F.length("v"))).first()[0]
        if mean is not None and mean > longest:
            best, longest = c, mean
    return best


def joined_column(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row (text): the non-null values of a column in order, a line each. It makes one document of a file, so it is one row's size by design."""
    return df.where(F.col(column).isNotNull()).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).cast("string").alias("v")))), lambda x: x["v"]), "\n").alias("text"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): distinct non-blank lines; none for a missing file."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], "url string")
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''").distinct()


def latest_run_path(root: str, explicit: str | None = None, name: str = "documents.jsonl") -> str:
    """The explicit path if it exists, else the file in the last run folder by name."""
    if explicit and Path(explicit).exists():
        return explicit
    runs = sorted(p for p in Path(root).glob("*") if (p / name).is_file()) if Path(root).is_dir() else []
    if not runs:
        raise FileNotFoundError(f"no {name} below {root}")
    return str(runs[-1] / name)
