"""Main content of pages by template deduction (problem 6).

Equivalence classes of tokens: on one host, words whose occurrence vectors are equal, that is, which stand in exactly the same lines of the
host's pages, form a class. The vector of a word is held as an order-free fingerprint (xor and sum of line hashes), so grouping needs one
aggregation and no list of pages. A class is valid if it is frequent enough and covers enough of the fixed words of its lines; words much
rarer than the class are its data slots. Classes nest in the page's template: those that stand between content, directly above it, and have no slots
(headings), and label-number lines (facts) belong to the main body's region, all others to the page around it. Lines that hold none of
these outer classes are the slots left over: the article.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.functions.hosts import site_of
from lumbre.plans.tables import materialise

#: Share of a host's pages, and number of lines, in which a class stands at least.
MIN_SHARE, MIN_LINES = 0.002, 3
#: Share of all words, and of the fixed words, of its lines that a class covers at least.
MIN_COVER, MIN_FIXED_COVER = 0.06, 0.2
#: Share of one line's fixed words that a class covers at least to claim that line.
MIN_LINE_COVER = 0.12
#: A word in less than this part of a class's lines is a slot of it.
SLOT_PART = 0.2
#: A class is a heading if this part of its lines stands directly above content, some stand below content too, and half of them have no slot.
ABOVE_CONTENT, BELOW_CONTENT, WITHOUT_SLOT = 0.7, 0.1, 0.5
#: Pages of a host that one task holds.
CHUNK = 4000

LINES = "array<struct<no:int,cids:array<bigint>,plain:array<boolean>,cover:array<double>,strong:array<bigint>,fact:boolean>>"
FACT = re.compile(r"^\s*[^\W\d_]{3,}(?:\s[^\W\d_]+){0,2}\s?:.*\d")


def _words(line: Column) -> Column:
    """Distinct words of letters, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(line), r"[^\p{L}]+"), lambda w: w != ""))


def chunk_words(pages: DataFrame) -> DataFrame:
    """(site, chunk, word, n, fp, fs, lw): of each word of a chunk of pages, the lines with it, the fingerprint of its occurrence vector there and the words of these lines. Input: site, chunk, page, text."""
    lines = pages.select("site", "chunk", "page", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("words", _words(F.col("line")))
    each = lines.select("site", "chunk", F.size("words").alias("lw"), F.xxhash64("page", "no").alias("h"), F.explode("words").alias("word"))
    return each.groupBy("site", "chunk", "word").agg(F.count("*").alias("n"), F.bit_xor("h").alias("fp"), F.sum(F.shiftright("h", 32)).alias("fs"), F.sum("lw").alias("lw"))


def word_vectors(chunked: DataFrame) -> DataFrame:
    """(site, word, n, fp, fs, lw): the same over all chunks of a host, of words in at least MIN_LINES lines."""
    sums = chunked.groupBy("site", "word").agg(F.sum("n").alias("n"), F.bit_xor("fp").alias("fp"), F.sum("fs").alias("fs"), F.sum("lw").alias("lw"))
    return sums.where(F.col("n") >= MIN_LINES)


def equivalence_classes(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site, word, n, cid, members): words with their class; cid and members are null where the class isn't frequent or large enough."""
    cls = vectors.groupBy("site", "fp", "fs", "n").agg(F.collect_list("word").alias("words"), F.first("lw").alias("clw"))  # at most the words of one line
    members = F.size("words")
    valid = (F.col("n") >= F.col("pages") * MIN_SHARE) & (members * F.col("n") >= MIN_COVER * F.col("clw"))
    cls = cls.join(sizes, "site").select("site", "n", F.when(valid, F.xxhash64("site", "fp", "fs")).alias("cid"), F.when(valid, members).alias("members"), "words")
    return cls.select("site", F.explode("words").alias("word"), "n", "cid", "members")


_WIDE = re.compile(r"[^\x00-\x7f]+")
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() or c == 10 else 32 for c in range(256))


def _line_words(text: str) -> list[list[bytes]]:
    """Words of letters, in lower case, of each line."""
    low = text.lower()
    if not low.isascii():
        low = _WIDE.sub(lambda m: "".join(c if c.isalpha() else " " for c in m[0]), low)
    return [line.split() for line in low.encode().translate(_KEEP).split(b"\n")]


def _label(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The classes in each line of the pages of one chunk of a host."""
    encoded = [w.encode() for w in right["word"]]
    right = right.assign(word=encoded)
    count = dict(zip(encoded, right["n"].tolist()))
    classed = right[right["cid"].notna()]
    member = {w: (int(c), n, int(m)) for w, c, n, m in zip(classed["word"], classed["cid"], classed["n"].tolist(), classed["members"].tolist())}
    out = []
    for page, text in zip(left["page"], left["text"]):
        rows = []
        for no, (line, found) in enumerate(zip(text.split("\n"), _line_words(text)), 1):
            if not line.strip():
                continue
            words = set(found)
            classes = {x[0]: x for x in map(member.get, words) if x}
            cids, plain, cover = sorted(classes), [], []
            if cids:
                counts = [count.get(w, 0) for w in words]
            for c in cids:
                _, n, m = classes[c]
                fixed = sum(k >= SLOT_PART * n for k in counts)
                plain.append(fixed == len(counts))
                cover.append(m / fixed)
            strong = [c for c, part in zip(cids, cover) if part >= MIN_LINE_COVER]
            rows.append({"no": no, "cids": cids, "plain": plain, "cover": cover, "strong": strong, "fact": bool(cids and FACT.match(line))})
        out.append((page, rows))
    site = left["site"].iloc[0] if len(left) else None
    return pd.DataFrame({"site": [site] * len(out), "page": [p for p, _ in out], "lines": [r for _, r in out]})


def class_lines(pages: DataFrame) -> DataFrame:
    """(site, page, lines): the non-blank lines of each page with the classes in them. A host's pages are dealt to chunks, so no task holds a whole host, and each chunk gets only the words that stand in it."""
    sizes = materialise(pages.groupBy("site").agg(F.count("*").alias("pages")), "sizes")
    chunks = F.ceil(F.col("pages") / CHUNK).cast("int")
    left = pages.join(sizes, "site").select("site", "page", "text", F.pmod(F.xxhash64("page"), chunks).cast("int").alias("chunk"))
    held = materialise(chunk_words(left), "words")
    words = equivalence_classes(word_vectors(held), sizes)
    right = held.select("site", "chunk", "word").join(words, ["site", "word"]).select("site", "word", "n", F.col("cid").cast("string").alias("cid"), "members", "chunk")  # pandas would turn null longs to floats
    return left.groupBy("site", "chunk").cogroup(right.groupBy("site", "chunk")).applyInPandas(_label, f"site string, page long, lines {LINES}")


def _outer(lines: Column, ignored: Column) -> Column:
    """For each line, whether it holds a class of the page around the article."""
    return F.transform(lines, lambda x: F.exists(x["strong"], lambda c: ~F.array_contains(ignored, c)))


def _with(lines: DataFrame, ignored: DataFrame) -> DataFrame:
    return lines.join(ignored, "site", "left").withColumn("ignored", F.coalesce("ignored", F.array().cast("array<bigint>")))


def _per_site(classes: DataFrame) -> DataFrame:
    """(site, ignored): a host's classes with fewer than ``1 / MIN_SHARE`` times the words of a page, so the lists are bounded."""
    return materialise(classes.groupBy("site").agg(F.collect_set("cid").alias("ignored")), "classes")


def _invalid(lines: DataFrame) -> DataFrame:
    """(site, ignored): classes that cover too little of the fixed words of their lines."""
    each = lines.select("site", F.explode("lines").alias("x")).select("site", F.explode(F.arrays_zip("x.cids", "x.cover")).alias("c"))
    return _per_site(each.groupBy("site", F.col("c.cids").alias("cid")).agg(F.avg("c.cover").alias("cover")).where(F.col("cover") < MIN_FIXED_COVER))


def _nested(lines: DataFrame, ignored: DataFrame) -> DataFrame:
    """(site, ignored): those ignored so far and the classes nested in the main body."""
    rows = _with(lines, ignored).withColumn("outer", _outer(F.col("lines"), F.col("ignored")))
    content = lambda i: F.coalesce(~F.get("outer", i), F.lit(False))
    rows = rows.select("site", F.explode(F.transform("lines", lambda x, i: F.struct(x.alias("x"), content(i + 1).alias("above"), content(i - 1).alias("below")))).alias("r"))
    each = rows.select("site", "r.above", "r.below", "r.x.fact", F.explode(F.arrays_zip("r.x.cids", "r.x.plain")).alias("c"))
    share = lambda c: F.avg(c.cast("int"))
    plain = F.col("c.plain")
    stats = each.groupBy("site", F.col("c.cids").alias("cid")).agg(share(F.col("above")).alias("above"), share(F.col("below")).alias("below"), share(plain).alias("plain"), share(F.col("fact") & plain).alias("fact"))
    found = stats.where(((F.col("above") >= ABOVE_CONTENT) & (F.col("below") >= BELOW_CONTENT) & (F.col("plain") >= WITHOUT_SLOT)) | (F.col("fact") >= ABOVE_CONTENT)).select("site", "cid")
    return _per_site(found.union(ignored.select("site", F.explode("ignored"))))


def template_lines(pages: DataFrame) -> DataFrame:
    """(site, page, outer): numbers, from 1, of each page's lines that belong to the page around its article.

    Input: site, page (long, unique), text. Null text, and blank lines, give nothing; a host with fewer than three lines alike keeps all its lines.
    """
    lines = materialise(class_lines(pages.where(F.col("text").isNotNull())), "lines")
    ignored = _invalid(lines)
    for _ in range(2):
        ignored = _nested(lines, ignored)
    outer = F.transform(F.filter("lines", lambda x: F.exists(x["strong"], lambda c: ~F.array_contains(F.col("ignored"), c))), lambda x: x["no"])
    return _with(lines, ignored).select("site", "page", outer.alias("outer"))


def pages_of(docs: DataFrame, key: str = "seq", url: str = "url", text: str = "content") -> DataFrame:
    return docs.select(site_of(F.col(url)).alias("site"), F.col(key).cast("long").alias("page"), F.col(text).cast("string").alias("text"))


def boilerplate_lines(docs: DataFrame, key: str = "seq", url: str = "url", text: str = "content") -> DataFrame:
    """(key, line_no): non-blank lines of ``text`` that aren't the article. Other columns of ``docs`` are ignored, rows repeated under one key give the line once."""
    return template_lines(pages_of(docs, key, url, text)).select(F.col("page").alias(key), F.explode(F.col("outer").cast("array<bigint>")).alias("line_no")).distinct()


def articles(docs: DataFrame, key: str = "seq", url: str = "url", text: str = "content") -> DataFrame:
    """(key, article): the text without the lines around the article; '' where nothing is left, no row where the text is null."""
    pages = pages_of(docs, key, url, text).where(F.col("text").isNotNull())
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("outer"), i + 1))
    rows = pages.join(template_lines(pages).select("page", "outer"), "page", "left")
    return rows.select(F.col("page").alias(key), F.array_join(F.when(F.col("outer").isNull(), F.split("text", "\n")).otherwise(kept), "\n").alias("article"))
