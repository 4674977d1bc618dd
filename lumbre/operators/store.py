"""A vector store: chunks with vectors, metadata of their documents, and a manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lumbre.operators import vectors
from lumbre.operators.crawl import overwrite, with_metadata
from lumbre.sources.sinks import exists, load_tables, save_tables

#: An encoder: texts to a matrix with a row for each. It must work on the executors.
Encoder = Callable[[list[str]], np.ndarray]


@dataclass
class Manifest:
    """What a store was built with. ``index_type``: ``flat`` searches exactly, ``hnsw`` (an approximate index is wanted) through lists; its parameters have the least values stated below."""

    model_name: str = "all-MiniLM-L6-v2"
    id_field: str = "doc_id"
    text_fields: list[str] = field(default_factory=list)
    normalize_embeddings: bool = True
    chunk_size: int = 120
    chunk_overlap: int = 30
    metric: str = "ip"
    index_type: str = "flat"
    hnsw_m: int = 32
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 64
    format_version: int = 2

    def __post_init__(self) -> None:
        self.metric, self.index_type = self.metric.lower(), self.index_type.lower()
        if self.metric not in ("ip", "l2"):
            raise ValueError("metric must be 'ip' or 'l2'")
        if self.index_type not in ("flat", "hnsw"):
            raise ValueError("index_type must be 'flat' or 'hnsw'")
        self.hnsw_m, self.hnsw_ef_construction, self.hnsw_ef_search = max(int(self.hnsw_m), 2), max(int(self.hnsw_ef_construction), 8), max(int(self.hnsw_ef_search), 8)


@dataclass
class Store:
    chunks: DataFrame  # vec_id, doc_id, embedding
    metadata: DataFrame  # doc_id, stored fields
    manifest: Manifest
    encoder: Encoder | None = None


def assembled(docs: DataFrame, fields: list[str], least: int = 0, separator: str = " ", id_field: str = "doc_id") -> DataFrame:
    """(doc_id, text): the non-blank fields of each document, joined; those under ``least`` characters are left out. A blank id becomes ``doc_`` and the row's number in the order of the table."""
    fields = [f for f in fields if f]
    if not fields:
        raise ValueError("at least one text field is needed")
    text = F.trim(F.concat_ws(separator, *[F.when(F.trim(F.col(f).cast("string")) != "", F.col(f).cast("string")) for f in fields]))
    own = F.nullif(F.trim(F.col(id_field).cast("string")), F.lit(""))
    return docs.select(F.coalesce(own, F.concat(F.lit("doc_"), F.monotonically_increasing_id().cast("string"))).alias("doc_id"), text.alias("text")).where(F.length("text") >= least)


def encoded(texts: DataFrame, encoder: Encoder, text: str = "chunk") -> DataFrame:
    """``texts`` with ``embedding``, a vector for each text, encoded in Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(encoder([t or "" for t in batch]), dtype=np.float32)))

    return texts.withColumn("embedding", encode(F.col(text)))


def _chunks(docs: DataFrame, manifest: Manifest, encoder: Encoder, least: int) -> DataFrame:
    texts = vectors.chunks(assembled(docs, manifest.text_fields, least, id_field=manifest.id_field), "text", manifest.chunk_size, manifest.chunk_overlap)
    rows = encoded(texts.where(F.length("chunk") >= least), encoder)
    return rows.select(F.concat_ws("#", "doc_id", F.col("chunk_no").cast("string")).alias("vec_id"), "doc_id", "embedding")


def build(docs: DataFrame, manifest: Manifest, encoder: Encoder, stored: list[str] = (), least: int = 1) -> Store:
    """A store of the documents' chunks; a ValueError if there are none."""
    chunks = _chunks(docs, manifest, encoder, least)
    if not chunks.limit(1).count():
        raise ValueError("there are no texts to encode")
    metadata = docs.select(F.col(manifest.id_field).cast("string").alias("doc_id"), *[c for c in stored if c != "doc_id"]).dropDuplicates(["doc_id"])
    return Store(chunks, with_metadata(chunks, metadata), manifest, encoder)


def add(store: Store, docs: DataFrame, stored: list[str] = (), least: int = 1) -> Store:
    """The store with chunks of the documents it doesn't have yet."""
    new = docs.join(store.metadata.select(F.col("doc_id").alias("_known")), F.col(store.manifest.id_field).cast("string") == F.col("_known"), "left_anti")
    chunks = _chunks(new, store.manifest, store.encoder, least)
    metadata = new.select(F.col(store.manifest.id_field).cast("string").alias("doc_id"), *[c for c in stored if c != "doc_id"]).dropDuplicates(["doc_id"])
    return Store(store.chunks.unionByName(chunks), with_metadata(chunks, store.metadata.unionByName(metadata, allowMissingColumns=True)), store.manifest, store.encoder)


def save(store: Store, path: str) -> None:
    size = store.chunks.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    settings = asdict(store.manifest) | {"vector_count": size["n"], "embedding_dim": max(size["d"] or 0, 0), "created_at": datetime.now(UTC).isoformat()}
    save_tables({"chunks": store.chunks, "metadata": store.metadata}, settings, path)


def load(spark: SparkSession, path: str, encoder: Encoder | None = None) -> Store:
    """A saved store. An older layout, whose manifest itself holds the ids of the vectors (``doc_ids``) and their ``metadata``, and one without any ids, which become ``doc_0``, ``doc_1`` and so on in the order of ``vec_id``, are read too; documents without metadata get a row."""
    if not exists(spark, f"{path}/settings"):
        raise FileNotFoundError(path)
    tables, settings = load_tables(spark, path, ["chunks"])
    chunks, known = tables["chunks"], set(Manifest.__dataclass_fields__)
    if "doc_id" not in chunks.columns:
        ids = settings.get("doc_ids") or []
        nth = F.row_number().over(vectors.Window.partitionBy(F.lit(0)).orderBy("vec_id")) - 1  # the older layout is one file of vectors
        named = F.element_at(F.array(*map(F.lit, ids)), F.col("nth") + 1) if ids else F.concat(F.lit("doc_"), F.col("nth").cast("string"))
        chunks = chunks.withColumn("nth", nth).withColumn("doc_id", named).drop("nth")
    if exists(spark, f"{path}/metadata"):
        metadata = spark.read.parquet(f"{path}/metadata")
    else:
        rows = [{"doc_id": str(i)} | {k: str(v) for k, v in m.items() if v is not None and k != "doc_id"} for i, m in zip(settings.get("doc_ids") or [], settings.get("metadata") or [])]
        names = ["doc_id", *sorted({k for r in rows for k in r} - {"doc_id"})]
        metadata = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` string" for c in names)).dropDuplicates(["doc_id"])
    return Store(chunks, with_metadata(chunks, metadata), Manifest(**{k: v for k, v in settings.items() if k in known}), encoder)


def search(store: Store, queries: DataFrame, k: int, factor: int = 8) -> DataFrame:
    """(query_id, doc_id, score, chunk_hits, rank, stored fields): documents by their best chunk, with their metadata, which counts where names clash.

    queries: (query_id, query) to be encoded, or (query_id, embedding); blank queries find nothing.
    """
    k = max(int(k), 0)
    if "embedding" not in queries.columns:
        if store.encoder is None:
            raise RuntimeError("the store has no encoder")
        queries = encoded(queries.where(F.trim(F.coalesce("query", F.lit(""))) != ""), store.encoder, "query")
    unit = (lambda df: df.withColumn("embedding", vectors.normalise(F.col("embedding")))) if store.manifest.normalize_embeddings else (lambda df: df)
    pool = max(k * max(int(factor), 1), k)
    chunks, asked = unit(store.chunks), unit(queries.select("query_id", "embedding"))
    if store.manifest.index_type == "flat":
        found = vectors.nearest(chunks, asked, pool, store.manifest.metric, also=("doc_id",))
    else:
        found = vectors.search_lists(vectors.build_lists(chunks, metric=store.manifest.metric), asked, pool).join(chunks.select("vec_id", "doc_id"), "vec_id")
    return overwrite(vectors.documents_of(found, k, "doc_id"), store.metadata)
