"""Latent semantic indexing over sparse TF-IDF weights.

A block Krylov method in a few passes over the weights, the same for any number of documents. The weights are cut once to cells of a block of documents
and a block of terms, kept as sparse matrices; a pass multiplies each cell by the vectors of its terms, and back by those of its documents, and adds up by
block. Documents and terms stay in tables; only matrices of the number of vectors squared come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.operators.vectors import dot, norm
from lumbre.plans.tables import materialise

#: Vectors beside the wanted ones in a block of the method, and blocks, that is, passes.
OVERSAMPLE, PASSES = 10, 7
#: Documents and terms of a block, about.
DOCS, TERMS = 4_096, 65_536


@dataclass
class Model:
    documents: DataFrame  # doc_id, vec
    terms: DataFrame  # term, vec
    singular_values: list[float]
    n_documents: int
    n_terms: int


def _check(k: object, n_docs: int, n_terms: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive integer")
    if not n_docs or not n_terms:
        raise ValueError("the weights are empty")
    if k > min(n_docs, n_terms):
        raise ValueError("k exceeds the number of documents or terms")
    return k


def check_weights(weights: DataFrame | None) -> None:
    """A ValueError unless these are weights (doc_id, term, weight), floating and finite, at least one."""
    if not isinstance(weights, DataFrame):
        raise ValueError("the weights must be a DataFrame")
    kinds = dict(weights.dtypes)
    if not {"doc_id", "term", "weight"} <= set(kinds):
        raise ValueError("the weights need the columns doc_id, term and weight")
    if kinds["weight"] not in ("double", "float"):
        raise ValueError("the weights must be floating numbers")
    w = F.col("weight")
    n, bad = weights.agg(F.count("*"), F.count_if(w.isNull() | F.isnan(w) | (F.abs(w) == math.inf))).first()
    if not n:
        raise ValueError("the weights are empty")
    if bad:
        raise ValueError("the weights hold null, NaN or infinite values")


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _matrix(m: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(m, np.float64).reshape(rows, -1)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell as sparse matrices by documents and by terms: keys, ends of the rows, and columns and weights in that order."""
    docs, i = np.unique(rows["d"].to_numpy(), return_inverse=True)
    terms, j = np.unique(rows["t"].to_numpy(), return_inverse=True)
    v, out = rows["weight"].to_numpy(float), {"db": rows["db"].iloc[:1], "tb": rows["tb"].iloc[:1], "docs": [_pack(docs)], "terms": [_pack(terms)]}
    for name, row, column in (("d", i, j), ("t", j, i)):
        order = np.lexsort((column, row))
        ends = np.searchsorted(row[order], np.arange(row.max() + 2))
        out |= {f"{name}_ends": [_pack(ends)], f"{name}_at": [_pack(column[order])], f"{name}_w": [_pack(v[order])]}
    return pd.DataFrame(out)


_CELL = "db int, tb int, docs binary, terms binary, d_ends binary, d_at binary, d_w binary, t_ends binary, t_at binary, t_w binary"


def _times(cells: DataFrame, by: str, to: str, vectors: DataFrame, width: int) -> DataFrame:
    """(block of ``to``, keys, m): the cells times the last ``width`` vectors of ``by`` (d or t), added up by block."""
    keys = {"d": "docs", "t": "terms"}

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                known = np.frombuffer(r.keys, np.int64)
                x = _matrix(r.m, len(known))[:, -width:][np.searchsorted(known, np.frombuffer(getattr(r, keys[by]), np.int64))]
                ends, at, w = np.frombuffer(r.ends, np.int64), np.frombuffer(r.at, np.int64), np.frombuffer(r.w, np.float64)
                out, step = np.empty((len(ends) - 1, width)), max(1, 200_000 // max(1, len(at) // max(1, len(ends) - 1)))
                for start in range(0, len(out), step):  # some rows at a time
                    own = ends[start : start + step + 1]
                    out[start : start + step] = np.add.reduceat(w[own[0] : own[-1], None] * x[at[own[0] : own[-1]]], own[:-1] - own[0], axis=0)
                yield pd.DataFrame({"block": [getattr(r, f"{to}b")], "keys": [getattr(r, keys[to])], "m": [_pack(out)]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.int64) for x in rows["keys"]]
        every = np.unique(np.concatenate(parts))
        total = np.zeros((len(every), width))
        for part, m in zip(parts, rows["m"]):
            total[np.searchsorted(every, part)] += _matrix(m, len(part))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "keys": [_pack(every)], "m": [_pack(total)]})

    some = cells.select("db", "tb", "docs", "terms", F.col(f"{to}_ends").alias("ends"), F.col(f"{to}_at").alias("at"), F.col(f"{to}_w").alias("w"))
    parts = some.join(vectors.select(F.col("block").alias(f"{by}b"), "keys", "m"), f"{by}b").mapInPandas(multiply, "block int, keys binary, m binary")
    return parts.groupBy("block").applyInPandas(add, "block int, keys binary, m binary")


def _gram(vectors: DataFrame) -> np.ndarray:
    """The product of the vectors' matrix with itself: one small matrix of each partition comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for rows in batches:
            for keys, m in zip(rows["keys"], rows["m"]):
                x = _matrix(m, len(keys) // 8)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [_pack(total)]})

    parts = [np.frombuffer(r["g"], np.float64) for r in vectors.select("keys", "m").mapInPandas(run, "g binary").collect()]
    total = np.sum(parts, axis=0)
    return total.reshape(math.isqrt(len(total)), -1)


def _apply(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(m=[_pack(_matrix(m, len(k) // 8) @ matrix) for k, m in zip(rows["keys"], rows["m"])])

    return vectors.mapInPandas(run, "block int, keys binary, m binary")


def _beside(one: DataFrame, two: DataFrame) -> DataFrame:
    """The vectors of both, side by side; both have the same keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            joined = [_pack(np.hstack([_matrix(m, len(k) // 8), _matrix(n, len(k) // 8)])) for k, m, n in zip(rows["keys"], rows["m"], rows["n"])]
            yield rows.assign(m=joined)[["block", "keys", "m"]]

    return one.join(two.select("block", F.col("m").alias("n")), "block").mapInPandas(run, "block int, keys binary, m binary")


def _inverse_root(gram: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """What makes columns with this product orthonormal; directions of nothing come out as zeros."""
    values, basis = np.linalg.eigh(gram)
    return basis * np.where(values > least * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def _rows(vectors: DataFrame, key: str) -> DataFrame:
    """(key, vec), a row for each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for keys, m in zip(rows["keys"], rows["m"]):
                known = np.frombuffer(keys, np.int64)
                yield pd.DataFrame({key: known, "vec": list(_matrix(m, len(known)))})

    return vectors.select("keys", "m").mapInPandas(run, f"{key} long, vec array<double>")


def train(weights: DataFrame, k: int, seed: int = 42, passes: int = PASSES) -> Model:
    """Truncated singular value decomposition, not centred, of (doc_id, term, weight). Document vectors are scaled by the singular values; zero components stay zero."""
    check_weights(weights)
    named = weights.where("weight != 0").select("doc_id", "term", F.xxhash64("doc_id").alias("d"), F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("weight"))
    named = materialise(named, "weights")
    ids, words = materialise(named.select("doc_id", "d").distinct(), "ids"), materialise(named.select("term", "t").distinct(), "vocabulary")
    n_docs, n_terms = ids.count(), words.count()
    _check(k, n_docs, n_terms)
    width = min(k + OVERSAMPLE, n_docs, n_terms)
    block = lambda c, n, size: F.pmod(F.col(c), F.lit(-(-n // size))).cast("int")
    placed = named.select("d", "t", "weight", block("d", n_docs, DOCS).alias("db"), block("t", n_terms, TERMS).alias("tb"))
    cells = materialise(placed.groupBy("db", "tb").applyInPandas(_cell, _CELL), "cells")

    def random(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(rows["t"].to_numpy())
        return pd.DataFrame({"block": rows["tb"].iloc[:1], "keys": [_pack(keys)], "m": [_pack(np.random.default_rng([seed, int(rows["tb"].iloc[0])]).standard_normal((len(keys), width)))]})

    start = words.select("t", block("t", n_terms, TERMS).alias("tb")).groupBy("tb").applyInPandas(random, "block int, keys binary, m binary")
    terms, found = materialise(start, "terms"), []
    for turn in range(max(1, passes)):
        found.append(materialise(_times(cells, "t", "d", terms, width), "pass"))
        if turn == passes - 1 or (turn + 1) * width >= min(n_docs, n_terms):
            break
        both, old = materialise(_beside(terms, _times(cells, "d", "t", found[-1], width)), "terms"), (turn + 1) * width
        gram = _gram(both)  # the new vectors are made orthogonal to those before; what rounding leaves is mended at the end
        across = np.linalg.pinv(gram[:old, :old], rcond=1e-13) @ gram[:old, old:]
        rest = gram[old:, old:] - gram[:old, old:].T @ across
        into = np.zeros_like(gram)
        into[:old, :old], root = np.eye(old), _inverse_root((rest + rest.T) / 2)
        into[:old, old:], into[old:, old:] = -across @ root, root
        terms = materialise(_apply(both, into), "terms")
    docs = materialise(reduce(_beside, found), "docs")
    # The best vectors within all that the passes found.
    root = _inverse_root(_gram(terms), 1e-10)
    values, basis = np.linalg.eigh(root.T @ _gram(docs) @ root)
    top = np.argsort(values)[::-1][:k]
    sigma, mix = np.sqrt(np.maximum(values[top], 0)), root @ basis[:, top]
    documents = materialise(ids.join(_rows(_apply(docs, mix), "d"), "d").select("doc_id", "vec"), "documents")
    inverse = np.where(sigma > 1e-9, 1.0, 0.0)
    found = materialise(words.join(_rows(_apply(terms, mix * inverse), "t"), "t").select("term", "vec"), "terms")
    return Model(documents, found, [float(s) for s in sigma], n_docs, n_terms)


def project(query: DataFrame, model: Model) -> list[float]:
    """The query (term, weight) in the model's space; zeros if it shares no term."""
    if model is None or not model.singular_values:
        raise RuntimeError("the model isn't trained")
    k = len(model.singular_values)
    rows = F.broadcast(query.select("term", "weight"))  # the words of one query
    row = model.terms.join(rows, "term").agg(*[F.sum(F.col("weight") * F.col("vec")[i]).alias(f"c{i}") for i in range(k)]).first()
    return [float(row[f"c{i}"] or 0.0) for i in range(k)]


def scores(query: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lsi_score): cosines, 0 where a vector is zero."""
    target = F.array(*[F.lit(x) for x in project(query, model)])
    bottom = norm(F.col("vec")) * norm(target)
    return model.documents.select("doc_id", F.when(bottom > 0, dot(F.col("vec"), target) / bottom).otherwise(0.0).alias("lsi_score"))


def explained_variance_ratio(weights: DataFrame, model: Model) -> list[float]:
    """Share of the weights' column variance in each component."""
    n, k = model.n_documents, len(model.singular_values)
    total = weights.groupBy("term").agg(F.sum(F.col("weight") * F.col("weight")).alias("s2"), F.sum("weight").alias("s"))
    whole = total.agg(F.sum(F.col("s2") / n - (F.col("s") / n) * (F.col("s") / n))).first()[0] or 0.0
    sums = model.documents.agg(*[F.sum(F.col("vec")[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("vec")[i] * F.col("vec")[i]).alias(f"q{i}") for i in range(k)]).first()
    return [(sums[f"q{i}"] / n - (sums[f"s{i}"] / n) ** 2) / whole if whole else 0.0 for i in range(k)]


def save(model: Model, path: str) -> None:
    """Two tables and a row of settings under ``path``; an untrained model can't be saved."""
    if model is None or not model.singular_values:
        raise RuntimeError("the model isn't trained")
    spark = model.documents.sparkSession
    model.documents.write.mode("overwrite").parquet(f"{path}/documents")
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    meta = spark.createDataFrame([(model.singular_values, model.n_documents, model.n_terms)], "singular_values array<double>, num_documents int, num_terms int")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark, path: str) -> Model:
    from pyspark.errors import AnalysisException

    try:
        meta = spark.read.schema("singular_values array<double>, num_documents int, num_terms int").json(f"{path}/meta").first()
        return Model(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/terms"), list(meta["singular_values"]), meta["num_documents"], meta["num_terms"])
    except AnalysisException as e:
        raise FileNotFoundError(path) from e


def train_documents(docs: DataFrame, k: int = 100, tokens: str = "tokens", alpha: float = 0.5, log_base: float | None = None) -> tuple[Model, DataFrame]:
    """The model of (doc_id, tokens) and the term frequencies (term, df, idf) that queries are weighted with; a ValueError for fewer documents or terms than ``k``."""
    from lumbre.operators import index

    docs = materialise(docs.select("doc_id", F.col(tokens).alias("tokens")), "tokens")
    idfs = materialise(index.idf_table(index.term_frequencies(docs), docs, log_base), "idf")
    return train(index.tfidf(docs, alpha=alpha, log_base=log_base), k), idfs
