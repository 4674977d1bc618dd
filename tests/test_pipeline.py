"""The command line, the vector store, answers, settings and the details of a crawl."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lumbre import cli
from lumbre.functions import settings
from lumbre.functions.encode import hashed as encode
from lumbre.operators import crawl, index, store, vectors
from lumbre.plans import answers
from lumbre.sources import sinks

WORDS = ["playa", "hotel", "museo", "puerto", "montana", "cafe", "historia", "barco"]


def _page(title, body, links=()):
    return f"<html lang=es><head><title>{title}</title></head><body><article><p>{body}</p></article>{''.join(f'<a href={x}>x</a>' for x in links)}</body></html>"


SITE = [
    ("https://a.example/", _page("Inicio", "Guia de la ciudad con puerto y museo para viajeros curiosos.", ["/playa", "/museo", "/privado", "/mal", "/pdf", "/va"])),
    ("https://a.example/playa", _page("La playa larga", "La playa tiene arena blanca y un hotel junto al puerto viejo.", ["/barco", "/museo"])),
    ("https://a.example/museo", _page("Museo de historia", "El museo cuenta la historia del puerto y de sus barcos.")),
    ("https://a.example/barco", _page("Paseo en barco", "El barco sale del puerto cada manana hacia la playa.")),
    ("https://a.example/va", _page("Cafe", "Un cafe tranquilo en la montana con vistas al puerto.", ["y"])),
    ("https://a.example/x/y", _page("Montana", "La montana tiene un cafe y senderos con mucha historia.")),
    ("https://a.example/mal", ""),
    ("https://a.example/pdf", "x"),
    ("https://a.example/privado", _page("Privado", "Nada.")),
]


def _pages(spark):
    codes = {"https://a.example/mal": (404, None, None), "https://a.example/pdf": (200, None, "application/pdf"), "https://a.example/va": (200, "https://a.example/x/va#top", "text/html; charset=utf-8")}
    rows = [(u, h, *codes.get(u, (200, None, "text/html"))) for u, h in SITE]
    return spark.createDataFrame(rows, "url string, html string, status_code int, final_url string, content_type string")


def test_crawl_statuses(spark):
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /privado")], "host string, rules string")
    told = []
    seen = crawl.crawl(_pages(spark), ["https://a.example/", "https://o.example/"], ["a.example"], max_depth=2, robots=robots, progress=told.append)
    got = {(r.url[-7:], r.status) for r in seen.collect()}
    assert got == {("xample/", "document"), ("xample/", "policy"), ("e/playa", "document"), ("e/museo", "document"), ("privado", "robots"), ("ple/mal", "http_error"), ("ple/pdf", "non_html"), ("mple/va", "document"), ("e/barco", "document"), ("ple/x/y", "document")}
    assert {r.parent_url for r in seen.where("url like '%/x/y'").collect()} == {"https://a.example/x/va"} and told[-1]["pages"] == 6
    assert crawl.crawl(_pages(spark), ["https://a.example/"], [], max_pages=3).where("status = 'document'").count() == 3
    no_rules = crawl.crawl(_pages(spark), ["https://a.example/"], [], robots=robots.limit(0))
    assert [r.status for r in no_rules.collect()] == ["robots"]


def test_crawl_report(spark):
    told = crawl.Settings([" https://a.example/ "], ["HTTPS://A.example/x"], obey_robots=False)
    assert told.allowed_domains == ["a.example"]
    documents, errors, report = crawl.run(told, _pages(spark))
    assert list(report["stats"]) == crawl.COUNTERS and report["stats"]["documents_saved"] == documents.count() == 7
    assert report["stats"]["errors"] == 1 and report["stats"]["skipped_non_html"] == 1 and report["stats"]["skipped_duplicate"] == 1
    row = errors.first()
    assert row.reason == "http_error" and row.detail == "status_code=404"
    assert {r.parent_url for r in documents.where("title = 'Montana'").collect()} == {"https://a.example/x/va"}
    with pytest.raises(ValueError):
        crawl.Settings([" "])


def test_web_search(spark):
    hits = spark.createDataFrame([("q", 1, "https://a.example/playa"), ("q", 2, " https://a.example/playa "), ("q", 3, ""), ("q", 4, "https://a.example/mal"), ("q", 5, "https://a.example/museo"), ("z", 1, "https://a.example/")], "query string, place int, url string")
    known = spark.createDataFrame([("https://a.example/museo",)], "url string")
    assert [r.title for r in crawl.web_search(hits, _pages(spark), known, " q ", 5).collect()] == ["La playa larga"]
    assert {r.title for r in crawl.web_search(hits, _pages(spark), known.limit(0), "q", 5).collect()} == {"La playa larga", "Museo de historia"}
    assert crawl.web_search(hits, _pages(spark), known, " ", 5).count() == 0 and crawl.web_search(hits, _pages(spark), known, "q", 0).count() == 0


def test_metadata_joins(spark):
    rows = spark.createDataFrame([("a", "mine", 1.0), ("b", "mine", 2.0)], "doc_id string, title string, score double")
    meta = spark.createDataFrame([("a", None, "u")], "doc_id string, title string, url string")
    assert {tuple(r) for r in crawl.overwrite(rows, meta).select("doc_id", "title", "url").collect()} == {("a", None, "u"), ("b", "mine", None)}
    assert {tuple(r) for r in crawl.with_metadata(rows, meta).collect()} == {("a", None, "u"), ("b", None, None)}


def _docs(spark):
    return spark.createDataFrame([(f"d{i}", f"Titulo {w}", f"La {w} es " + f"{w} " * 40, None if i else " ") for i, w in enumerate(WORDS)] + [(None, None, "x", None)], "doc_id string, title string, content_text string, url string")


@pytest.mark.parametrize("kind", ["flat", "hnsw"])
def test_store(spark, tmp_path, kind):
    made = store.build(_docs(spark), store.Manifest(text_fields=["title", "content_text"], index_type=kind, chunk_size=20, chunk_overlap=5), encode, ["title"], 10)
    store.save(made, str(tmp_path / "v"))
    held = store.load(spark, str(tmp_path / "v"), encode)
    assert held.manifest == made.manifest and held.chunks.count() == made.chunks.count() > len(WORDS)
    asked = spark.createDataFrame([(1, "museo"), (2, " "), (3, "barco barco")], "query_id int, query string")
    got = {(r.query_id, r["rank"]): r for r in store.search(held, asked, 2).collect()}
    assert got[1, 1].doc_id == "d2" and got[1, 1].title == "Titulo museo" and got[3, 1].doc_id == "d7" and got[1, 1].chunk_hits >= 1 and (2, 1) not in got
    more = store.add(held, spark.createDataFrame([("d2", "again", "museo " * 30, None), ("n", "Nuevo", "museo museo " * 30, None)], _docs(spark).schema), ["title"], 10)
    assert more.metadata.where("doc_id = 'n'").first().title == "Nuevo" and more.chunks.where("doc_id = 'd2'").count() == held.chunks.where("doc_id = 'd2'").count()
    with pytest.raises(RuntimeError):
        store.search(store.load(spark, str(tmp_path / "v")), asked, 2)
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.build(_docs(spark).limit(0), made.manifest, encode)


def test_older_layouts_of_a_store(spark, tmp_path):
    chunks = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id int, embedding array<float>")
    sinks.save_tables({"chunks": chunks}, {"doc_ids": ["x", "y", "y"], "metadata": [{"title": "X"}], "metric": "ip"}, str(tmp_path / "old"))
    held = store.load(spark, str(tmp_path / "old"))
    assert [r.doc_id for r in held.chunks.orderBy("vec_id").collect()] == ["x", "y", "y"] and {tuple(r) for r in held.metadata.collect()} == {("x", "X"), ("y", None)}
    sinks.save_tables({"chunks": chunks}, {}, str(tmp_path / "bare"))
    assert {r.doc_id for r in store.load(spark, str(tmp_path / "bare")).metadata.collect()} == {"doc_0", "doc_1", "doc_2"}


def test_manifest_and_assembly(spark):
    low = store.Manifest(metric="L2", index_type="HNSW", hnsw_m=1, hnsw_ef_construction=1, hnsw_ef_search=1)
    assert (low.metric, low.index_type, low.hnsw_m, low.hnsw_ef_construction, low.hnsw_ef_search) == ("l2", "hnsw", 2, 8, 8)
    for bad in ({"metric": "cosine"}, {"index_type": "ivf"}):
        with pytest.raises(ValueError):
            store.Manifest(**bad)
    rows = store.assembled(_docs(spark), ["title", "content_text"], 2)
    assert rows.count() == len(WORDS) and rows.where("doc_id = 'd0'").first().text.startswith("Titulo playa La playa")
    assert store.assembled(_docs(spark), ["title", "content_text"]).where("text = 'x'").first().doc_id.startswith("doc_")
    with pytest.raises(ValueError):
        store.assembled(_docs(spark), [])


def test_settings():
    env = {"A": " x ", "B": " ", "C": "Off", "D": "7", "E": "-1", "F": "z", "RAG_LLM_TIMEOUT_SECONDS": "3"}
    assert settings.text("A", "d", env) == "x" and settings.text("B", "d", env) == "d" and settings.text("Z", "d", env) == "d"
    assert settings.flag("C", True, env) is False and settings.flag("F", True, env) is True and settings.flag("Z", False, env) is False
    assert [settings.positive(k, 5, env) for k in "DEFZ"] == [7, 5, 5, 5] and settings.Generator.from_env(env) == settings.Generator(timeout=3)


def test_retrieval_falls_back_for_good(spark):
    calls = []

    def broken(query, k):
        calls.append(query)
        raise RuntimeError("no model")

    words = lambda query, k: spark.createDataFrame([("d1", 0.5, 1)], "doc_id string, score double, rank int")
    find = answers.Retriever(broken, words)
    assert find("a", 1).count() == 1 and find("b", 1).count() == 1 and calls == ["a"] and not find.available
    assert answers.Retriever(words, broken)("a", 1).count() == 1


def test_models_on_disk(tmp_path):
    (tmp_path / ".cache/torch/sentence_transformers/m").mkdir(parents=True)
    (tmp_path / ".cache/huggingface/hub/models--a--b").mkdir(parents=True)
    assert [answers.has_local_model(n, tmp_path) for n in ("m", "a/b", "c", "", str(tmp_path))] == [True, True, False, False, True]


DOCUMENTS = [("d1", "Playa", None, "u1", "resumen", "texto uno"), ("d2", None, "Ente", " u2 ", None, "texto dos"), ("d3", " ", None, None, None, None)]


def _retrieved(spark):
    docs = spark.createDataFrame(DOCUMENTS, "doc_id string, title string, entity_name string, url string, summary string, content_text string")
    hits = spark.createDataFrame([("d2", 0.9, 1), ("d1", 0.8, 2), ("d3", 0.7, 3), ("", 0.1, 4)], "doc_id string, score double, rank int")
    return hits, docs


def test_retrieved_documents(spark):
    hits, docs = _retrieved(spark)
    got = [(r.citation_id, r.title, r.url, r.summary, r.content) for r in answers.retrieved(hits, docs).orderBy("citation_id").collect()]
    assert got == [(1, "Ente", "u2", "", "texto dos"), (2, "Playa", "u1", "resumen", "texto uno"), (3, "d3", "", "", ""), (4, "Documento 4", "", "", "")]
    named = docs.withColumn("content", F.lit("propio"))
    assert answers.retrieved(hits, named, ("content", "content_text")).where("doc_id = 'd1'").first().content == "propio"


def test_answers(spark):
    hits, docs = _retrieved(spark)
    ask = lambda generator, **options: answers.answer(hits, docs, "playa", settings.Generator(**options), generator).answer
    assert ask(lambda prompt, s: f"{s.model}: {'[1] Titulo: Ente' in prompt}") == "qwen3: True"
    assert "fallo: No se pudo generar" in ask(lambda prompt, s: f"{answers.FAILED}. x") and ask(len, enabled=False) == answers.DISABLED and ask(len, model="") == answers.NO_MODEL
    assert answers.answer(hits, docs, "q", settings.Generator(command="no-such-command")).answer.startswith("No se encontro el comando")
    assert answers.run_generator("hola", settings.Generator(command="false")).endswith("retorno 1: sin detalle") and answers.run_generator("x", settings.Generator(command="true")) == answers.EMPTY
    assert answers.run_generator("x", settings.Generator(command="echo")) == "run qwen3"
    words = lambda c: F.split(F.lower(c), r"\W+")
    long = docs.withColumn("content_text", F.concat(F.lit("Nada que ver con la pregunta de hoy, de verdad.\n"), F.lit("La playa larga tiene arena blanca y agua clara todo el ano."))).withColumn("summary", F.lit(None).cast("string"))
    made = answers.passage_prompt(answers.retrieved(hits.limit(1), long), "playa", ["playa"], words).first()[0]
    assert "Contexto: La playa larga" in made


def test_index_round_trip(spark, tmp_path):
    idfs = spark.createDataFrame([("a", 1, 0.5)], "term string, df long, idf double")
    index.save(idfs, str(tmp_path / "i"), 0.4, 2.0)
    got, alpha, base = index.load(spark, str(tmp_path / "i"))
    assert [tuple(r) for r in got.collect()] == [("a", 1, 0.5)] and (alpha, base) == (0.4, 2.0)
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    data = str(tmp_path / "data")
    run = lambda *a: cli.main([*a, *([] if a[0] == "preprocess" else ["--data", data])], spark)
    assert cli.main([], spark) == 1 and run("lsi_query", "playa") == 1 and run("rag_query", "playa") == 1
    _pages(spark).write.parquet(f"{data}/pages")
    assert run("crawl", "--seed", "https://a.example/", "--no-robots") == 0 and "Documentos guardados: 7" in capsys.readouterr().out
    assert run("vectordb") == 1 and run("vectordb", "--encoder", "lumbre.functions.encode:hashed") == 0
    capsys.readouterr()
    assert run("query", "museo", "--encoder", "lumbre.functions.encode:hashed", "--top-k", "2") == 0 and "1. score=" in capsys.readouterr().out
    assert run("rag_query", "museo", "de", "historia", "--show-prompt") == 0
    said = capsys.readouterr().out
    assert "Respuesta RAG para: museo de historia" in said and "[1] score=" in said and "Museo de historia" in said and "Prompt:" in said
    assert run("lsi_train", "--components", "3") == 0 and "Documentos: 7" in capsys.readouterr().out
    assert run("lsi_query", "museo") == 0 and "Museo de historia" in capsys.readouterr().out
    assert run("lsi_rag", "museo") == 0 and "Respuesta RAG+LSI" in capsys.readouterr().out
    (tmp_path / "qrels.json").write_text(json.dumps({"queries": [{"query_id": "q1", "query": "museo", "relevant_doc_ids": [spark.read.json(spark.sparkContext.parallelize(["{}"])).select(F.sha1(F.lit("https://a.example/museo"))).first()[0]]}, {"query_id": "q2", "query": " ", "relevant_doc_ids": []}]}))
    assert run("evaluate_rec01", "--qrels", str(tmp_path / "qrels.json")) == 0 and run("evaluate_rec01", "--qrels", "none.json") == 1
    report = json.loads((tmp_path / "data/evaluation.json").read_text())
    assert report["query_count"] == 1 and set(report["delta"]) == set(report["baseline"]["summary"]) and math.isfinite(report["refined"]["summary"]["map_score"])
    spark.createDataFrame([("barcos", 1, "https://b.example/1")], "query string, place int, url string").write.parquet(f"{data}/hits")
    assert run("web_search", "barcos") == 0 and "Sin documentos nuevos" in capsys.readouterr().out
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.txt").write_text("Running dogs are running")
    (tmp_path / "raw/b.csv").write_text("id,review\n1,Happy dogs\n2,\n3,Sad cats\n")
    assert run("preprocess", "--raw-dir", str(tmp_path / "raw"), "--out-dir", str(tmp_path / "out")) == 0
    got = {r.doc_id: r.tokens for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"a_doc": ["run", "dog", "run"], "b_doc": ["happi", "dog", "sad", "cat"]}


def test_golden_tokens():
    """Stems of a Spanish text, as published with the corpus' processed sources."""
    from lumbre.functions.stem import stem

    assert [stem(w, "spanish") for w in ("playas", "ciudades", "turismo", "viajeros", "hoteles", "vacaciones", "destinos", "lugares")] == ["play", "ciudad", "turism", "viajer", "hotel", "vacacion", "destin", "lugar"]
    assert vectors.CHUNK > 0
