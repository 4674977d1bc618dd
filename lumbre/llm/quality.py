"""Per-document text statistics that tell natural prose from lists, tables and junk (problem 10).

The statistics are computed by built-in functions; KLL quantile sketches of each, per language, are merged over all documents, values are set
against them as percentiles and robust z-scores, and the distributions' tails are flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.words import FUNCTION_WORDS
from lumbre.plans.tables import materialise

STATS = ("mean_word_length", "letter_ratio", "symbol_ratio", "digit_ratio", "line_end_punctuation", "sentences_per_word", "common_word_share")
#: Robust z-score beyond which a value is in the tail.
TAIL = 6.0
#: Robust z-score below which too few sentence ends or letters mean that a text isn't prose.
JUNK_TAIL = 8.0
#: A language with fewer documents is set against all documents.
LEAST_DOCS = 100
#: Ranks of the quantiles against which percentiles are read.
GRID = [i / 100 for i in range(1, 100)]
#: The spread of a statistic counts as this part of its median at least, so that a constant one gives no infinite scores.
LEAST_SPREAD = 0.01

_COMMON = sorted({w for words in FUNCTION_WORDS.values() for w in words.split() if len(w) > 1})
_ACCENTS = ("áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def statistics(text: Column) -> Column:
    """A struct of counts and ratios; ratios of nothing are 0, all are null for a null text."""
    whole = F.greatest(F.length(text), F.lit(1)).cast("double")
    bare = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), *_ACCENTS)
    words = F.filter(F.split(bare, r"[^\p{L}]+"), lambda w: w != "")
    n_words, distinct = F.size(words), F.array_distinct(words)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")).cast("double")
    digits = F.length(F.regexp_replace(text, r"[^\p{N}]+", "")).cast("double")
    spaces = F.length(F.regexp_replace(text, r"[^\s\p{Z}]+", "")).cast("double")
    lines = F.regexp_count(text, F.lit(r"(?m)^.*[^\s\p{Z}].*$"))
    ended = F.regexp_count(text, F.lit(r"(?m)[.!?…。！？][\"'»”’)\]]*[ \t\r ]*$"))
    sentences = F.regexp_count(text, F.lit(r"\p{L}\p{M}*[\"'»”’)\]]*[.!?…。！？]+(?=[\s\"'»”’)\]]|\z)|\p{N}[\"'»”’)\]]*[.!?…]+(?=\s+[\p{Lu}¿¡«\"“]|\s*\z)"))
    visible = F.greatest(whole - spaces, F.lit(1.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return F.struct(
        F.length(text).alias("n_chars"),
        n_words.alias("n_words"),
        lines.alias("n_lines"),
        ratio(visible, F.greatest(F.size(F.filter(F.split(text, r"[\s\p{Z}]+"), lambda w: w != "")), F.lit(1))).alias("mean_word_length"),
        ratio(letters, visible).alias("letter_ratio"),
        ratio(visible - letters - digits, visible).alias("symbol_ratio"),
        ratio(digits, visible).alias("digit_ratio"),
        ratio(ended, lines).alias("line_end_punctuation"),
        ratio(sentences, n_words).alias("sentences_per_word"),
        ratio(F.size(F.array_intersect(distinct, F.array(*map(F.lit, _COMMON)))), F.size(distinct)).alias("common_word_share"),
    )


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    row = docs.select(F.col(key), F.col(lang).alias("lang"), statistics(F.when(F.col(text).isNotNull(), F.col(text).cast("string"))).alias("s"), F.col(text).isNull().alias("_null"))
    return row.select(key, "lang", *[F.when(~F.col("_null"), F.col(f"s.{c}")).alias(c) for c in ("n_chars", "n_words", "n_lines", *STATS)])


def language_sketches(stats: DataFrame) -> DataFrame:
    """(lang, docs, one sketch for each statistic): a row for each language and, with all_docs true, one for all documents."""
    return stats.where(F.col("n_chars").isNotNull()).rollup("lang").agg(
        F.grouping("lang").cast("boolean").alias("all_docs"), F.count("*").alias("docs"), *[F.kll_sketch_agg_double(s).alias(s) for s in STATS]
    )


def scored(stats: DataFrame, sketches: DataFrame) -> DataFrame:
    """``stats`` with <statistic>_pct and <statistic>_z; languages with too few documents, and null ones, are set against all documents."""
    quantile = lambda s, q: F.kll_sketch_get_quantile_double(F.col(s), F.array(*map(F.lit, q)) if isinstance(q, list) else F.lit(q))
    spread = lambda s: F.greatest((quantile(s, 0.75) - quantile(s, 0.25)) / 1.349, F.abs(quantile(s, 0.5)) * LEAST_SPREAD, F.lit(1e-9))
    ref = sketches.select("lang", "all_docs", "docs", *[F.struct(quantile(s, 0.5).alias("mid"), spread(s).alias("spread"), quantile(s, GRID).alias("grid")).alias(f"_{s}") for s in STATS])
    own = ref.where(~F.col("all_docs") & F.col("lang").isNotNull() & (F.col("docs") >= LEAST_DOCS)).drop("all_docs", "docs")
    every = ref.where("all_docs").select(F.lit(0).alias("_k"), *[F.col(f"_{s}").alias(f"_all_{s}") for s in STATS])  # one row
    rows = stats.join(own, "lang", "left").withColumn("_k", F.lit(0)).join(F.broadcast(every), "_k", "left").drop("_k")
    at = lambda s: F.coalesce(f"_{s}", f"_all_{s}")
    for s in STATS:
        rows = rows.withColumn(f"{s}_z", (F.col(s) - at(s)["mid"]) / at(s)["spread"])
        rows = rows.withColumn(f"{s}_pct", F.when(F.col(s).isNotNull(), F.size(F.filter(at(s)["grid"], lambda q: q <= F.col(s))) / len(GRID)))
    return rows.drop(*[f"{a}{s}" for s in STATS for a in ("_", "_all_")])


def flagged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, statistics, percentiles, z-scores, tails, not_prose): every row of ``docs``.

    tails names the statistics beyond ``TAIL`` and on which side. Not prose is a text with far fewer sentence ends than its language's documents, far fewer
    letters, or without any word; a null text has null statistics and isn't flagged.
    """
    stats = materialise(document_statistics(docs, key, text, lang), "statistics")
    rows = scored(stats, language_sketches(stats))
    tail = [F.when(F.col(f"{s}_z") < -TAIL, F.lit(f"{s}:low")).when(F.col(f"{s}_z") > TAIL, F.lit(f"{s}:high")) for s in STATS]
    rows = rows.withColumn("tails", F.array_compact(F.array(*tail)))
    low = (F.col("sentences_per_word_z") < -JUNK_TAIL) | (F.col("letter_ratio_z") < -JUNK_TAIL)
    return rows.withColumn("not_prose", F.coalesce(low | (F.col("n_words") == 0), F.lit(False)))
