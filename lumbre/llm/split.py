"""Splitting oversized texts at natural boundaries (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.timestamps import let

LIMIT, OVERLAP = 4000, 200


def boundary_pattern(size: int) -> str:
    """A pattern that takes the next piece of at most ``size`` characters: the rest if it fits, else up to the last paragraph end, line end,
    sentence end, clause end or space in the second half of the window, else ``size`` characters."""
    span, rest = f".{{{max(1, size // 2)},{size - 2}}}", f".{{1,{size}}}"
    if size < 8:
        return rf"(?s){rest}"
    return rf"(?s){rest}\z|{span}\n\n|{span}.?\n|{span}[.!?…]\s|{span}[,;:]\s|{span}.?\s|{rest}"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<text, start>>: pieces of at most ``limit`` code points in order; each but the first begins with the last ``overlap`` of the text before it.

    A text within the limit is one piece; an empty one gives one empty piece, null gives null. Without the overlaps the pieces join to the text again.
    """
    if limit < 1 or overlap < 0 or 3 * overlap > limit:
        raise ValueError("limit must be positive and overlap between 0 and a third of it")
    bodies = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))
    before = lambda b: F.concat(F.array(F.lit("")), F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: F.right(x, F.lit(overlap))))
    ends = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))
    join = lambda b: F.transform(
        F.arrays_zip(b.alias("b"), before(b).alias("lead"), F.slice(ends(b), 1, F.size(b)).alias("at")),
        lambda x: F.struct(F.concat(x["lead"], x["b"]).alias("text"), (x["at"] - F.length(x["lead"])).alias("start")),
    )
    cut = let(bodies, lambda b: F.when(F.size(b) > 0, join(b)))
    return F.when(F.length(text) <= limit, F.array(F.struct(text.alias("text"), F.lit(0).alias("start")))).otherwise(cut)


def split_texts(docs: DataFrame, key: str = "seq", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, pieces, start, n_chars, piece): one row for each piece, numbered from 1; ``start`` is its offset in code points.

    Null texts give no row; rows repeated under one key give their pieces again; other columns are ignored.
    """
    cut = docs.select(key, pieces(F.col(text).cast("string"), limit, overlap).alias("_cut")).where(F.col("_cut").isNotNull())
    rows = cut.select(key, F.size("_cut").alias("pieces"), F.posexplode("_cut").alias("no", "p"))
    return rows.select(key, (F.col("no") + 1).alias("piece_no"), "pieces", F.col("p.start").alias("start"), F.length("p.text").alias("n_chars"), F.col("p.text").alias("piece"))


def oversized(docs: DataFrame, key: str = "seq", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key): texts that had to be cut."""
    return split_texts(docs, key, text, limit, overlap).where((F.col("pieces") > 1) & (F.col("piece_no") == 1)).select(key).distinct()
