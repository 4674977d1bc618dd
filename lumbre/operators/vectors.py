"""Chunks of text, exact vector search, and an approximate index of lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(docs: DataFrame, text: str = "text", size: int = 120, overlap: int = 30) -> DataFrame:
    """(doc_id, chunk_no, n_words, chunk): runs of ``size`` words that share ``overlap`` words with the run before; the last ends with the text.

    A negative overlap counts as 0; with a size of 0 or less a text is one chunk; empty texts give none.
    """
    overlap = max(overlap, 0)
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = docs.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    if size <= 0:
        return rows.select("doc_id", F.lit(0).alias("chunk_no"), F.size("words").alias("n_words"), F.array_join("words", " ").alias("chunk"))
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((F.size("words") - size) / step), F.lit(0)).cast("int")
    rows = rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    piece = F.slice("words", F.col("chunk_no") * step + 1, size)
    return rows.select("doc_id", "chunk_no", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("chunk"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def similarity(vector: Column, query: Column, metric: str) -> Column:
    """Larger is nearer: ``cosine``, ``ip`` (inner product) or ``l2`` (the squared distance, negative)."""
    if metric == "cosine":
        bottom = norm(vector) * norm(query)
        return F.when(bottom > 0, dot(vector, query) / bottom).otherwise(0.0)
    if metric == "ip":
        return dot(vector, query)
    if metric == "l2":
        return -F.aggregate(F.zip_with(vector, query, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown metric: {metric}")


#: Vectors of a chunk and queries of a block that one task compares.
CHUNK, BLOCK = 50_000, 2_048


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _scores(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """A row for each query: larger is nearer; rounded to six places."""
    if metric == "l2":
        out = -(np.square(queries).sum(1)[:, None] + np.square(vectors).sum(1) - 2 * queries @ vectors.T)
    else:
        out = queries @ vectors.T
        if metric == "cosine":
            bottom = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)
            out = np.divide(out, bottom, out=np.zeros_like(out), where=bottom > 0)
    return np.round(out, 6) + 0.0  # no negative zero


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, vector) of each query's ``k`` best, ties by key."""
    rows, columns = [], []
    for i, row in enumerate(scores):
        near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if k < len(row) else np.arange(len(row))
        near = near[np.lexsort((keys[near], -row[near]))][:k]
        rows.append(np.full(len(near), i))
        columns.append(near)
    return np.concatenate(rows), np.concatenate(columns)


def _checked(metric: str, k: int) -> int:
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    return max(int(k), 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", key: str = "vec_id", embedding: str = "embedding", query: str = "query_id", chunk: int = CHUNK, block: int = BLOCK, also: tuple = ()) -> DataFrame:
    """(query, key, also, score, rank): each query's ``k`` nearest vectors, exactly; rounded scores, ties by key.

    queries: (query, embedding), any number. Blocks of queries meet chunks of vectors, each pair of them in a task that multiplies two matrices and keeps k rows a
    query, so what is shuffled is vectors times blocks and queries times chunks. Null vectors are never found and null queries find nothing; repeated rows count again.
    """
    k = _checked(metric, k)
    key_type = dict(vectors.dtypes)[key]
    query_type = dict(queries.dtypes)[query]
    schema = f"{query} {query_type}, {key} {key_type}, {''.join(f'{c} {dict(vectors.dtypes)[c]}, ' for c in also)}score double"
    vectors = vectors.select(key, *also, F.col(embedding).alias("_v")).where(F.col("_v").isNotNull())
    queries = queries.select(F.col(query), F.col(embedding).alias("_q")).where(F.col("_q").isNotNull())
    chunks, blocks = max(1, -(-vectors.count() // chunk)), max(1, -(-queries.count() // block))
    left = vectors.withColumn("_c", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_b", F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int")).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked) or not k:
            return pd.DataFrame({c: [] for c in (query, key, *also, "score")})
        scores = _scores(_matrix(asked["_q"]), _matrix(rows["_v"]), metric)
        i, j = _best(scores, rows[key].to_numpy(), k)
        return pd.DataFrame({query: asked[query].to_numpy()[i], **{c: rows[c].to_numpy()[j] for c in (key, *also)}, "score": scores[i, j]})

    found = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInPandas(compare, schema)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))  # at most k rows of each chunk
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def documents_of(pool: DataFrame, k: int, doc: str, query: str = "query_id") -> DataFrame:
    """(query, doc, score, chunk_hits, rank): the ``k`` best documents of each query by their best chunk in the pool."""
    best = pool.groupBy(query, doc).agg(F.max("score").alias("score"), F.count("*").alias("chunk_hits"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(doc)))).where(F.col("rank") <= k)


def nearest_documents(
    chunked: DataFrame, queries: DataFrame, k: int, factor: int = 8, metric: str = "ip", doc: str = "label", key: str = "vec_id", embedding: str = "embedding", query: str = "query_id"
) -> DataFrame:
    """(query, doc, score, chunk_hits, rank): documents by their best chunk among the ``k * factor`` nearest chunks of each query; hits count pooled chunks only."""
    k = max(int(k), 0)
    return documents_of(nearest(chunked, queries, max(k * max(int(factor), 1), k), metric, key, embedding, query, also=(doc,)), k, doc, query)


#: Vectors that the lists' centres are fitted on, and passes of that; share of the ten nearest that the default number of probed lists holds for TRIED of them.
FITTED, PASSES, RECALL, TRIED = 50_000, 12, 0.96, 500


@dataclass
class Lists:
    """An approximate index: every vector in the list of its nearest centre (key, embedding, list); the centres, at most a few thousand; lists to probe."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int
    metric: str
    key: str


def _probe_by(metric: str) -> str:
    return "l2" if metric == "l2" else "ip"


def build_lists(vectors: DataFrame, n_lists: int | None = None, metric: str = "ip", key: str = "vec_id", embedding: str = "embedding", seed: int = 7) -> Lists:
    """Centres are fitted by k-means on about FITTED vectors chosen by a hash; all vectors are indexed. By default there are as many lists as the root of the number of vectors, at most 4,096."""
    _checked(metric, 1)
    rows = vectors.select(F.col(key), F.col(embedding).alias("embedding")).where(F.col("embedding").isNotNull())
    n = rows.count()
    n_lists = min(n_lists or max(1, int(n**0.5)), 4096)
    share = min(1.0, FITTED / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").toPandas()
    x = _matrix(sample["embedding"]) if len(sample) else np.zeros((0, 1))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n_lists]]
    for _ in range(PASSES if len(centres) else 0):
        own = np.argmax(_scores(x, centres, "l2"), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        held = np.bincount(own, minlength=len(centres))
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)

    probes = 1
    if len(x):
        some = x[:: max(1, len(x) // TRIED)]
        nearest_ten = np.argsort(-_scores(some, x, metric), axis=1, kind="stable")[:, :10]
        lists = np.argmax(_scores(x, centres, "l2"), axis=1)[nearest_ten]
        place = np.argsort(np.argsort(-_scores(some, centres, _probe_by(metric)), axis=1, kind="stable"), axis=1, kind="stable")
        probes = int(np.quantile(np.take_along_axis(place, lists, 1), RECALL, method="higher")) + 1

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(list=np.argmax(_scores(_matrix(batch["embedding"]), centres, "l2"), axis=1).astype(np.int32))

    schema = f"{key} {dict(vectors.dtypes)[key]}, embedding {dict(vectors.dtypes)[embedding]}, list int"
    return Lists(rows.mapInPandas(assign, schema), centres, probes, metric, key)


def search_lists(index: Lists, queries: DataFrame, k: int, probes: int | None = None, embedding: str = "embedding", query: str = "query_id") -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest of the vectors in the ``probes`` lists nearest to each query; by default as many as the fitted vectors needed."""
    k, key, metric, centres = max(int(k), 0), index.key, index.metric, index.centres
    probes = min(len(centres), probes or index.probes)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and probes:
                near = np.argsort(-_scores(_matrix(batch["_q"]), centres, _probe_by(metric)), axis=1, kind="stable")[:, :probes]
                yield batch.assign(list=[x.astype(np.int32) for x in near])

    asked = queries.select(F.col(query), F.col(embedding).alias("_q")).where(F.col("_q").isNotNull())
    schema = f"{query} {dict(queries.dtypes)[query]}, _q {dict(queries.dtypes)[embedding]}, list array<int>"
    asked = asked.mapInPandas(probe, schema).withColumn("list", F.explode("list"))

    def compare(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(some) or not k:
            return pd.DataFrame({query: [], key: [], "score": []})
        scores = _scores(_matrix(some["_q"]), _matrix(rows["embedding"]), metric)
        i, j = _best(scores, rows[key].to_numpy(), k)
        return pd.DataFrame({query: some[query].to_numpy()[i], key: rows[key].to_numpy()[j], "score": scores[i, j]})

    # A list of any length goes to tasks of about CHUNK vectors; its queries to each of these.
    sizes = index.vectors.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    left = index.vectors.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))  # a row for each centre
    cut = sizes.select("list", F.sequence(F.lit(0), F.col("parts") - 1).alias("each"))
    right = asked.join(F.broadcast(cut), "list").withColumn("part", F.explode("each"))
    schema = f"{query} {dict(queries.dtypes)[query]}, {key} {dict(index.vectors.dtypes)[key]}, score double"
    found = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(compare, schema)
    order = Window.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
