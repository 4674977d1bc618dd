import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.operators import evaluate, index, lsi, search, vectors


@pytest.fixture
def corpus(spark):
    rows = [(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["a", None, "b"]), (4, [])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_tfidf_by_hand(corpus):
    got = {(r.doc_id, r.term): r.weight for r in index.tfidf(corpus).collect()}
    assert got[1, "b"] == pytest.approx(math.log(4 / 2))
    assert got[1, "a"] == pytest.approx(0.75 * math.log(4 / 3))
    assert got[2, "c"] == pytest.approx(math.log(4))
    assert (4, "a") not in got and len(got) == 6


def test_term_of_every_document_and_unknown_words(spark):
    docs = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "doc_id long, tokens array<string>")
    idfs = index.idf_table(index.term_frequencies(docs), docs)
    assert {r.term: r.idf for r in idfs.collect()}["a"] == 0
    assert index.query_vector(["zz"], idfs).count() == 0
    assert index.cosine_scores(index.tfidf(docs), index.query_vector(["a"], idfs)).agg(F.max("score")).first()[0] == 0


def test_bad_parameters(corpus):
    for bad in ({"alpha": 2}, {"log_base": 1.0}, {"log_base": 0.0}):
        with pytest.raises(ValueError):
            index.tfidf(corpus, **bad)


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, tokens array<string>")
    assert index.tfidf(docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 119, 120, 121, 210, 211, 500])
def test_chunks_cover_all_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = vectors.chunks(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).orderBy("chunk_no").collect()
    want, start = [], 0
    while n:
        want.append(words[start : start + 120])
        if start + 120 >= n:
            break
        start += 90
    assert [r.chunk.split(" ") for r in got] == want


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 7), (2, [0.0, 0.0], 7), (3, [1.0, 0.0], 8), (4, [0.0, -2.0], 9), (5, None, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ask = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "query_id int, embedding array<float>")
    found = lambda got: [(r.vec_id, r.score) for r in got.orderBy("query_id", "rank").collect()]
    assert found(vectors.nearest(df, ask([2.0, 0.0]), 3, "cosine")) == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert found(vectors.nearest(df, ask([1.0, 0.0], [0.0, -1.0], None), 2, "l2")) == [(1, 0.0), (3, 0.0), (2, -1.0), (4, -1.0)]
    assert found(vectors.nearest(df, ask([1.0, 0.0], [0.0, -1.0]), 2, "l2", chunk=1, block=1)) == [(1, 0.0), (3, 0.0), (2, -1.0), (4, -1.0)]
    assert [(r.label, r.chunk_hits) for r in vectors.nearest_documents(df, ask([1.0, 0.0]), 2, 2).orderBy("rank").collect()] == [(7, 2), (8, 1)]
    assert vectors.nearest_documents(df, ask([1.0, 0.0]), 0).count() == 0 and vectors.nearest(df.where("vec_id < 0"), ask([1.0, 0.0]), 2).count() == 0
    with pytest.raises(ValueError):
        vectors.nearest(df, ask([1.0, 0.0]), 2, "dice")


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_lists_find_most_of_the_nearest(spark, metric):
    """All rows of the smallest embeddings table are indexed; recall of ten for every tenth vector against the exact search."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(df, asked, 10, metric).collect()}
    got = {(r.query_id, r.vec_id) for r in vectors.search_lists(vectors.build_lists(df, metric=metric), asked, 10).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    whole = vectors.search_lists(vectors.build_lists(df, 4, metric), asked, 10, probes=4)
    assert {(r.query_id, r.vec_id) for r in whole.collect()} == exact


#: Hits of each query's five results, its number of relevant documents, P@3, P@5, AP and NDCG@5; then the means of P@3, P@5, AP and NDCG@5.
GOLDEN = [
    (
        [("00000", 4, 0, 0, 0, 0), ("01000", 5, 0.333333, 0.2, 0.1, 0.213986), ("10000", 5, 0.333333, 0.2, 0.2, 0.33916), ("10000", 1, 0.333333, 0.2, 1, 1), ("00010", 3, 0, 0.2, 0.083333, 0.202107), ("00000", 3, 0, 0, 0, 0), ("00000", 3, 0, 0, 0, 0), ("10000", 6, 0.333333, 0.2, 0.166667, 0.33916)],
        (0.166667, 0.125, 0.19375, 0.261802),
    ),
    (
        [("00001", 4, 0, 0.2, 0.05, 0.15102), ("10000", 5, 0.333333, 0.2, 0.2, 0.33916), ("10000", 5, 0.333333, 0.2, 0.2, 0.33916), ("10000", 1, 0.333333, 0.2, 1, 1), ("10000", 3, 0.333333, 0.2, 0.333333, 0.469279), ("00000", 3, 0, 0, 0, 0), ("00000", 3, 0, 0, 0, 0), ("10000", 6, 0.333333, 0.2, 0.166667, 0.33916)],
        (0.208333, 0.15, 0.24375, 0.329722),
    ),
]


@pytest.mark.parametrize("queries, means", GOLDEN)
def test_metrics_of_known_rankings(spark, queries, means):
    run = [(f"q{n}", f"d{i}" if hit == "1" else f"x{i}", i) for n, (hits, *_) in enumerate(queries) for i, hit in enumerate(hits, 1)]
    found = [(q, d) for q, d, _ in run if d[0] == "d"]
    missed = [(f"q{n}", f"m{i}") for n, (hits, relevant, *_) in enumerate(queries) for i in range(relevant - hits.count("1"))]
    qrels = spark.createDataFrame(found + missed, "query_id string, doc_id string")
    asked = spark.createDataFrame([(f"q{n}",) for n in range(len(queries))], "query_id string")
    metrics = evaluate.per_query(spark.createDataFrame(run, "query_id string, doc_id string, rank int"), qrels, asked)
    got = {r.query_id: list(r)[1:] for r in metrics.collect()}
    assert all(got[f"q{n}"] == pytest.approx(want, abs=1e-6) for n, (_, _, *want) in enumerate(queries))
    assert list(evaluate.summary(metrics).first()) == pytest.approx(means, abs=1e-6)


def test_metrics_of_nothing(spark):
    run = spark.createDataFrame([("q1", "x", 1)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q1", "y"), ("q3", "z")], "query_id string, doc_id string")
    asked = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "query_id string")
    assert all(list(r)[1:] == [0, 0, 0, 0] for r in evaluate.per_query(run, qrels, asked).collect())
    assert list(evaluate.summary(evaluate.per_query(run.limit(0), qrels, asked.limit(0))).first()) == [0, 0, 0, 0]


def _weights(spark, a):
    return spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "doc_id long, term string, weight double")


@pytest.mark.parametrize("docs, terms", [(4096, 65536), (4, 3)])
def test_lsi_against_svd(spark, monkeypatch, docs, terms):
    monkeypatch.setattr(lsi, "DOCS", docs)
    monkeypatch.setattr(lsi, "TERMS", terms)
    rng = np.random.default_rng(0)
    a = rng.random((9, 4)) @ rng.random((4, 7)) + 0.001 * rng.random((9, 7))
    a[3] = a[4] = a[5]
    model = lsi.train(_weights(spark, a), 3)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular_values, s[:3], rtol=1e-9)
    got = {r.doc_id: np.array(r.vec) for r in model.documents.collect()}
    want = u[:, :3] * s[:3]
    assert np.allclose([[got[i] @ got[j] for j in range(9)] for i in range(9)], want @ want.T, atol=1e-3)
    query = spark.createDataFrame([("t1", 1.0), ("zz", 5.0)], "term string, weight double")
    assert np.allclose(np.abs(lsi.project(query, model)), np.abs(v[:3, 1]), atol=1e-3)


def test_lsi_of_a_flat_spectrum(spark):
    """More documents than a pass spans, and singular values close to each other: as exact as a full decomposition."""
    rng = np.random.default_rng(1)
    a = rng.random((150, 130)) * (rng.random((150, 130)) < 0.3)
    weights = spark.createDataFrame([(int(i), f"t{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "doc_id long, term string, weight double")
    model = lsi.train(weights, 5)
    assert np.allclose(model.singular_values, np.linalg.svd(a, compute_uv=False)[:5], rtol=1e-6)
    shares = lsi.explained_variance_ratio(weights, model)
    assert all(0 <= x <= 1 for x in shares)


def test_lsi_weights_are_checked(spark):
    for rows, schema in (([(1, "a", math.nan)], "weight double"), ([(1, "a", math.inf)], "weight double"), ([(1, "a", None)], "weight double"), ([(1, "a", 1)], "weight int"), ([], "weight double")):
        with pytest.raises(ValueError):
            lsi.train(spark.createDataFrame(rows, f"doc_id long, term string, {schema}"), 1)
    with pytest.raises(ValueError):
        lsi.train(None, 1)
    with pytest.raises(RuntimeError):
        lsi.project(None, None)


def test_lsi_limits(spark, tmp_path):
    w = _weights(spark, np.eye(3))
    for k in (0, -1, 4, 2.0, True):
        with pytest.raises(ValueError):
            lsi.train(w, k)
    model = lsi.train(w, 2)
    lsi.save(model, str(tmp_path / "m"))
    assert lsi.load(spark, str(tmp_path / "m")).singular_values == pytest.approx(model.singular_values)
    with pytest.raises(FileNotFoundError):
        lsi.load(spark, str(tmp_path / "none"))
    with pytest.raises(RuntimeError):
        lsi.save(None, "x")


def test_prompt_and_answers_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, citation_id int, title string, url string, score double, summary string, content string")
    words = lambda c: F.split(c, " ")
    assert search.NO_CONTEXT in search.prompt(none, " q ").first()[0]
    assert search.local_answer(none, "q", "e").first()[0].startswith("No encontre documentos")
    assert search.extractive_answer(none, "q", ["q"], words).first()[0].startswith("No encontre documentos")


def test_passages_fall_back_to_excerpts(spark):
    docs = spark.createDataFrame([(1, 1, "T", "u", 0.5, None, "corto"), (2, 2, "T2", "u", 0.4, "resumen", None)], "doc_id long, citation_id int, title string, url string, score double, summary string, content string")
    got = search.select_passages(docs, ["zz"], lambda c: F.split(c, " ")).orderBy("place").collect()
    assert [r.passage for r in got] == ["corto", "resumen"]
