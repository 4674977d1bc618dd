"""Repeated lines (1), pieces (3) and page boilerplate (6)."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumbre.llm import repeated, split, template

SCHEMA = "seq long, doc_id string, url string, content string, review_date string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, d, u, c, "2020-01-%02d" % (i % 28 + 1)) for i, (d, u, c) in enumerate(rows)], SCHEMA)


def _corpus():
    rows = []
    for i in range(40):
        site = "https://www.a.example/" if i % 2 else "http://m.a.example/"
        body = [f"Artikel über Nummer {'x' * (i + 1)}", "", "  ALLE Rechte, vorbehalten 2020! ", "12345"]
        if i % 5 == 0:
            body += ["Nur manchmal hier"]
        if i == 7:
            body = []
        rows.append((f"d{i // 2 if i < 6 else i}", site + str(i), "\n".join(body) if i != 9 else None))
    rows += [("e1", "https://b.example/", "alle rechte vorbehalten"), ("e2", None, "ñ\nñ"), ("e3", "", "   ")]
    return rows


def _brute(rows, least, share):
    site = lambda u: re.sub(r"^(www|m)\.", "", (re.findall(r"//([^/]*)", u or "") or [""])[0])
    key = lambda line: "".join(c for c in line if c.isalpha()).lower()
    docs, where = defaultdict(set), defaultdict(set)
    for d, u, c in rows:
        if c and c.strip():
            docs[site(u)].add(d)
            for line in c.split("\n"):
                where[site(u), key(line)].add(d)
    return {(i, n) for i, (d, u, c) in enumerate(rows) if c and c.strip() for n, line in enumerate(c.split("\n"), 1) if key(line) and len(where[site(u), key(line)]) >= max(least, share * len(docs[site(u)]))}


def test_repeated_lines_against_brute_force(spark):
    rows = _corpus()
    docs = _docs(spark, rows)
    got = {tuple(r) for r in repeated.repeated_lines(docs, F.col("doc_id")).collect()}
    assert got == _brute(rows, 5, 0.15)
    again = docs.union(docs).withColumn("site", F.lit(1)).withColumn("line_no", F.lit(2)).withColumn("cluster", F.lit(3)).withColumn("share", F.lit(4))
    assert {tuple(r) for r in repeated.repeated_lines(again, F.col("doc_id")).collect()} == got
    assert repeated.repeated_lines(docs.limit(0), F.col("doc_id")).count() == 0


def test_copies_count_once(spark):
    """An article published under ten addresses is one cluster, so its lines aren't boilerplate; on one date, neither."""
    rows = [(f"d{i}", f"https://a.example/{i}", "Dieselbe Nachricht\nmit zwei Zeilen") for i in range(10)] + [(f"o{i}", f"https://a.example/o{i}", f"Anderes {'y' * i}\nFusszeile") for i in range(10)]
    docs = _docs(spark, rows)
    got = {r.seq for r in repeated.repeated_lines(docs, repeated.same_text(docs)).collect()}
    assert got == set(range(10, 20))
    assert repeated.repeated_lines(docs, F.col("doc_id"), F.lit("2020"), min_dates=2).count() == 0
    assert {r.seq for r in repeated.repeated_lines(docs, repeated.same_text(docs), F.col("review_date"), min_dates=5).collect()} == set(range(10, 20))


def test_republished_articles_count_once(spark):
    """Under other addresses, bylines and related links an article is still one cluster."""
    story = "\n".join(" ".join(f"wort{chr(97 + n)}{chr(97 + i)}" for i in range(12)) for n in range(4))
    rows = [(f"d{i}", f"https://a.example/{i}", f"Von Autor {'v' * (i + 1)}\n{story}\nMehr zu {'m' * (i + 1)}") for i in range(10)]
    rows += [(f"o{i}", f"https://a.example/o{i}", f"Anderes {'y' * (i + 1)}\nFusszeile") for i in range(10)]
    docs = _docs(spark, rows)
    docs = docs.join(repeated.article_clusters(docs), "seq")
    assert docs.where("seq < 10").select("cluster").distinct().count() == 1
    assert {r.seq for r in repeated.repeated_lines(docs, F.col("cluster")).collect()} == set(range(10, 20))


def test_no_date_is_not_a_date(spark):
    rows = [(f"o{i}", f"https://a.example/o{i}", f"Anderes {'y' * (i + 1)}\nFusszeile") for i in range(10)]
    date = F.when(F.col("seq") % 2 == 0, F.lit("2020-01-01"))
    assert repeated.repeated_lines(_docs(spark, rows), F.col("doc_id"), date, min_dates=2).count() == 0
    assert repeated.repeated_lines(_docs(spark, rows), F.col("doc_id"), date, min_dates=1).count() == 10


@pytest.mark.parametrize("other", ["2001-07-24", "2008-03-09", "2018-05-17"])
def test_dates_are_counted_exactly(spark, other):
    """Two dates that a sketch of distinct values takes for one are two."""
    rows = [(i, f"d{i}", "https://a.example/", "the same line", "2024-05-01" if i % 2 else other) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert repeated.repeated_lines(docs, F.col("doc_id"), F.col("review_date"), min_dates=2).count() == 6
    assert repeated.repeated_lines(docs, F.col("doc_id"), F.col("review_date"), min_dates=3).count() == 0
    counts = repeated.line_counts(docs, F.col("doc_id"), F.col("review_date")).collect()
    assert [(r.clusters, r.dates) for r in counts] == [(6, 2)]


def test_lines_removed(spark):
    rows = _corpus()
    docs = _docs(spark, rows)
    drop = _brute(rows, 5, 0.15)
    got = {r.seq: r.content for r in repeated.without_lines(docs, repeated.repeated_lines(docs, F.col("doc_id"))).collect()}
    for i, (_, _, c) in enumerate(rows):
        assert got[i] == (c if c is None else "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in drop))


TEXTS = [None, "", "a", "x" * 4000, "x" * 4001, "palabra " * 3000, "Uno. Dos tres.\n\n" * 700, "😀é" * 5000, "\n" * 9000, "linea\n" * 2000 + "y" * 9000, " " * 4100]


@pytest.mark.parametrize("limit, overlap", [(4000, 200), (300, 60), (12, 3), (2, 0)])
def test_pieces_round_trip(spark, limit, overlap):
    texts = [t and t[: 400 * limit] for t in TEXTS]  # so many pieces at most
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "seq long, content string, piece int")
    got = defaultdict(list)
    for r in split.split_texts(docs, limit=limit, overlap=overlap).orderBy("seq", "piece_no").collect():
        got[r.seq].append(r)
    assert 0 not in got
    for i, text in enumerate(texts[1:], 1):
        parts = got[i]
        assert all(len(p.piece) == p.n_chars <= limit and text[p.start : p.start + p.n_chars] == p.piece for p in parts)
        assert parts[0].piece + "".join(p.piece[overlap:] for p in parts[1:]) == text
        assert len(parts) == parts[0].pieces and (len(parts) > 1) == (len(text) > limit)
        assert all(a.piece[len(a.piece) - overlap :] == b.piece[:overlap] for a, b in zip(parts, parts[1:]))


def test_pieces_end_where_the_text_pauses(spark):
    text = ("Una frase corta. " * 20 + "\n\n") * 12
    got = split.split_texts(spark.createDataFrame([(1, text)], "seq long, content string"), limit=1000, overlap=100).orderBy("piece_no").collect()
    assert all(p.piece.endswith("\n\n") for p in got)


def test_oversized(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "seq long, content string")
    assert {r.seq for r in split.oversized(docs.union(docs)).collect()} == {i for i, t in enumerate(TEXTS) if t and len(t) > 4000}
    assert split.oversized(docs.limit(0)).count() == 0
    for bad in ((0, 0), (10, -1), (10, 4)):
        with pytest.raises(ValueError):
            split.pieces(F.col("x"), *bad)


def _pages(n=120):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(7)) for _ in range(400)]
    name = lambda: "".join(rng.choice("bcdfgaeio") for _ in range(9)).title()
    rows, truth = [], set()
    for i in range(n):
        body = [" ".join(rng.choices(vocabulary, k=30)).capitalize() + "." for _ in range(3)]
        body.insert(rng.choice([0, 1]), ["Consejos prácticos", "Vida nocturna"][i % 2])
        lines = ["Todos los derechos reservados 2020", f"Suscríbete ya al boletín: {i} lectores"] * (i % 3 > 0) + body + [f"También te puede interesar: {name()}, {name()}"] * (i % 2) + ["Imprimir esta página"]
        for no, line in enumerate(lines, 1):
            if line not in body:
                truth.add((i, no))
        rows.append((i, "https://a.example/p", "\n".join(lines)))
    return rows, truth


def test_template_of_a_host(spark):
    rows, truth = _pages()
    docs = spark.createDataFrame(rows, "seq long, url string, content string").withColumn("site", F.lit("clash")).withColumn("lines", F.lit(1)).withColumn("page", F.lit(9))
    got = {tuple(r) for r in template.boilerplate_lines(docs).collect()}
    assert got == truth
    articles = {r.seq: r.article for r in template.articles(docs).collect()}
    assert all(articles[i] == "\n".join(x for n, x in enumerate(c.split("\n"), 1) if (i, n) not in truth) for i, _, c in rows)


def test_template_chunks_change_nothing(spark, monkeypatch):
    rows, truth = _pages()
    monkeypatch.setattr(template, "CHUNK", 7)
    assert {tuple(r) for r in template.boilerplate_lines(spark.createDataFrame(rows, "seq long, url string, content string")).collect()} == truth


def test_template_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "https://a.example/", ""), (3, "https://a.example/", " \n\n"), (4, "https://b.example/", "Solo una línea" + " larga" * 20_000)], "seq long, url string, content string")
    assert template.boilerplate_lines(docs).count() == 0
    assert {r.seq: r.article for r in template.articles(docs).collect()}.keys() == {2, 3, 4}
    assert template.boilerplate_lines(docs.limit(0)).count() == 0
