"""Inverted index and TF-IDF, as long tables (doc_id, term, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_frequencies(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, doc_id, freq): the postings; null tokens are skipped."""
    return docs.select("doc_id", F.explode(tokens).alias("term")).where(F.col("term").isNotNull()).groupBy("term", "doc_id").agg(F.count("*").alias("freq"))


def postings(index: DataFrame, term: str) -> DataFrame:
    """(doc_id, freq) of one term in document order; none for an unknown term."""
    return index.where(F.col("term") == term).select("doc_id", "freq").orderBy("doc_id")


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def check_parameters(alpha: float, log_base: float | None) -> None:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    if log_base is not None and (log_base <= 0 or log_base == 1):
        raise ValueError("log_base must be positive and != 1")


def idf(n_docs: Column, df: Column, log_base: float | None = None) -> Column:
    """Unsmoothed, so 0 for a term of every document."""
    ratio = n_docs.cast("double") / df
    return F.log(ratio) if log_base is None else F.log(ratio) / F.log(F.lit(float(log_base)))


def idf_table(index: DataFrame, docs: DataFrame, log_base: float | None = None) -> DataFrame:
    """(term, df, idf); documents without tokens count too."""
    check_parameters(0.5, log_base)
    total = docs.agg(F.count("*").alias("n_docs"))
    return document_frequencies(index).crossJoin(F.broadcast(total)).select("term", "df", idf(F.col("n_docs"), F.col("df"), log_base).alias("idf"))  # one row is joined


def tf(freq: Column, most: Column, alpha: float = 0.5) -> Column:
    return F.when(most > 0, alpha + (1 - alpha) * freq / most).otherwise(0.0)


def tfidf(docs: DataFrame, tokens: str = "tokens", alpha: float = 0.5, log_base: float | None = None) -> DataFrame:
    """(doc_id, term, freq, weight), sparse; the vocabulary is the distinct terms."""
    check_parameters(alpha, log_base)
    index = term_frequencies(docs, tokens)
    return weigh(index, idf_table(index, docs, log_base), alpha)


def weigh(index: DataFrame, idfs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(doc_id, term, freq, weight) of postings (term, doc_id, freq); all postings of a document are needed."""
    most = F.max("freq").over(Window.partitionBy("doc_id"))
    rows = index.withColumn("most", most).join(idfs, "term")
    return rows.select("doc_id", "term", "freq", (tf(F.col("freq"), F.col("most"), alpha) * F.col("idf")).alias("weight"))


def query_vector(words: list[str], idfs: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(term, weight) of a query; words outside the vocabulary are dropped before the largest frequency is taken."""
    spark = idfs.sparkSession
    given = spark.createDataFrame([(w,) for w in words], "term string").groupBy("term").agg(F.count("*").alias("freq"))
    known = idfs.join(F.broadcast(given), "term")  # the words of one query
    most = F.max("freq").over(Window.partitionBy(F.lit(0)))
    return known.select("term", (tf(F.col("freq"), most, alpha) * F.col("idf")).alias("weight"))


def search(index: DataFrame, idfs: DataFrame, query: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(doc_id, score): cosines of the documents that share a term with the query (term, weight); only these are weighted."""
    shared = index.join(F.broadcast(query.select("term")), "term", "left_semi").select("doc_id").distinct()  # the words of one query
    return cosine_scores(weigh(index.join(shared, "doc_id", "left_semi"), idfs, alpha), query)


def cosine_scores(weights: DataFrame, query: DataFrame) -> DataFrame:
    """(doc_id, score): cosine of each document that shares a term with the query; 0 where a norm is 0."""
    q = query.select("term", F.col("weight").alias("qw"))
    qnorm = query.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("qnorm"))
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weights.join(F.broadcast(q), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    rows = dots.join(norms, "doc_id").crossJoin(F.broadcast(qnorm))  # one row is joined
    bottom = F.col("norm") * F.col("qnorm")
    return rows.select("doc_id", F.when(bottom > 0, F.col("dot") / bottom).otherwise(0.0).alias("score"))


def top(scores: DataFrame, k: int, score: str = "score", key: str = "doc_id", places: int = 6) -> DataFrame:
    """The ``k`` best by the rounded score, ties by key, with their rank from 1."""
    best = scores.withColumn(score, F.round(score, places)).orderBy(F.col(score).desc(), F.col(key)).limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), F.col(key))))


def weighted_fields(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(doc_id, term, freq): term frequencies with each field's tokens counted ``weights[field]`` times."""
    fields = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f).alias("tokens")) for f, w in weights.items()])
    rows = docs.select("doc_id", F.explode(fields).alias("x")).select("doc_id", "x.w", F.explode("x.tokens").alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.sum("w").alias("freq"))


def save(idfs: DataFrame, path: str, alpha: float = 0.5, log_base: float | None = None) -> None:
    """The frequencies that queries are weighted with, and the parameters they were made with."""
    from lumbre.sources.sinks import save_tables

    check_parameters(alpha, log_base)
    save_tables({"idf": idfs}, {"alpha": alpha, "log_base": log_base}, path)


def load(spark, path: str) -> tuple[DataFrame, float, float | None]:
    """(idf table, alpha, log_base); FileNotFoundError where there is none."""
    from lumbre.sources.sinks import load_tables

    tables, settings = load_tables(spark, path, ["idf"])
    return tables["idf"], settings["alpha"], settings["log_base"]
