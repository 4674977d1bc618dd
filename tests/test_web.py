import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lumbre.operators import crawl, web
from lumbre.sources import readers, sinks
from lumbre.streaming import ingest

PAGE = """<html lang="es"><head><title> Viejo </title><meta property="og:title" content="Playa"><meta property="og:description" content="og">
<meta name="description" content="Resumen"><script type="application/ld+json">{"@graph":[{"@type":["Hotel","Place"],"name":"Sol","author":{"name":"Ana"},
"aggregateRating":{"ratingValue":4.5},"address":{"addressRegion":"R"},"keywords":"b, a,b"}]}</script><script type="application/ld+json">{bad</script></head>
<body><article><p>Uno<p>Dos<ul><li><p>Tres</p></ul></article>""" + "".join(f'<img src="{i % 11}.jpg">' for i in range(30)) + "</body></html>"


def test_page_fields():
    got = web.page_fields(PAGE)
    assert (got["title"], got["summary"], got["language"]) == ("Playa", "Resumen", "es")
    assert got["content_text"] == "Uno\nDos\nTres\nTres"
    assert len(got["images"]) == 10 and got["word_count"] == 4
    assert (got["entity_name"], got["review_author"], got["rating"], got["location"], got["content_type"], got["tags"]) == ("Sol", "Ana", "4.5", "R", "Hotel,Place", ["a", "b"])


def test_page_without_anything():
    got = web.page_fields("<p>a<p>b <b>c</b><br><script>x</script>")
    assert (got["title"], got["content_text"], got["content_type"]) == (None, "a\nb c", "web_page")
    assert web.page_fields("")["content_text"] == "" and web.page_fields("<![x")["title"] is None
    assert web.linked_fields([{"author": {"url": "x"}}])["review_author"] == "{'url': 'x'}"


def test_urls(spark):
    assert web.normalise_url("https://a.example/x/y", "../z;p=1?q=2#f") == "https://a.example/z?q=2"
    assert [web.normalise_url("https://a.example/", h) for h in (None, " ", "mailto:a@b", "tel:1", "javascript:void(0)")] == [None] * 5
    rows = spark.createDataFrame([("https://WWW.a.example/x",), ("https://nota.example/",), ("ftp://a.example/",), ("https://a.example/f.PDF",), ("bad url",), (None,)], "url string")
    assert [r[0] for r in rows.select(web.allowed(F.col("url"), ["a.example"])).collect()] == [True, False, False, False, False, False]
    assert web.clean_domain("HTTPS://A.example/x") == "a.example"
    assert not web.robots_allow(None, "x", "https://a.example/") and not web.robots_allow("User-agent: *\nDisallow: /p", "x", "https://a.example/p") and web.robots_allow("", "x", "https://a.example/")


GRAPH = [("https://a.example/", '<a href="/b">b</a><a href=c>c</a><a href="/b#x">b</a><a href="mailto:x@a">m</a>'), ("https://a.example/b", '<a href="/">h</a><a href="/d">d</a><a href="https://o.example/">o</a>'), ("https://a.example/c", "<a href='/d'>d</a><a href='/f.pdf'>f</a>"), ("https://a.example/d", '<a href="/e">e</a>'), ("https://a.example/e", "")]


def _crawl(spark, **options):
    pages = spark.createDataFrame(GRAPH, "url string, html string")
    return [(r.url[17:], r.depth, r.status) for r in crawl.crawl(pages, ["https://a.example/"], ["a.example"], **options).orderBy("depth", "url").collect()]


def test_crawl(spark):
    assert _crawl(spark) == [("/", 0, "document"), ("/b", 1, "document"), ("/c", 1, "document"), ("/d", 2, "document")]
    assert _crawl(spark, max_pages=2) == [("/", 0, "document"), ("/b", 1, "document")]
    known = spark.createDataFrame([("https://a.example/d",)], "url string")
    assert _crawl(spark, persisted=known)[-2:] == [("/d", 2, "persisted"), ("/e", 3, "document")]
    assert _crawl(spark, persisted=known, expand_persisted=False)[-1] == ("/d", 2, "persisted")
    assert crawl.crawl(spark.createDataFrame([], "url string, html string"), [], []).count() == 0


def test_last_wins_and_absent_columns(spark):
    docs = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "z")], "doc_id string, seq long, title string")
    last = crawl.last_wins(docs, "doc_id", "seq")
    assert [tuple(r) for r in last.collect()] == [("a", 2, None)]
    hits = spark.createDataFrame([("a", "h", 1.0), ("b", "i", 2.0)], "doc_id string, title string, score double")
    assert sorted((r.doc_id, r.title, r.seq) for r in crawl.fill_absent(last, hits).collect()) == [("a", None, 2), ("b", "i", None)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Señor \xff".encode("latin-1"))
    (tmp_path / "b.HTML").write_text("<style>x</style><p>Hola<p>Mundo")
    (tmp_path / "c.json").write_text(json.dumps({"a": ["x", {"b": " y ", "n": 3}], "c": " "}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "d.doc").write_text("no")
    with zipfile.ZipFile(tmp_path / "Mi Doc.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Uno</w:t><w:t>!</w:t></w:p><w:p/><w:p><w:t>Dos</w:t></w:p></w:document>')
    got = {r.doc_id: r.text for r in readers.whole_files(spark, str(tmp_path)).collect()}
    assert got == {"a_doc": "Se�or �", "b_doc": "Hola Mundo", "c_doc": "x\ny", "mi_doc_doc": "Uno!\nDos"}
    assert readers.discover(spark, str(tmp_path / "none")).count() == 0
    assert readers.json_strings({"t": "a", "u": ["b"]}, ["u"]) == ["b"]


def test_lines_and_csv(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a":"1"}\n\n{bad\n{"a":"2"}\n')
    assert readers.json_lines(spark, str(path), "a string").count() == 2
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), "a string", strict=True).collect()
    (tmp_path / "r.csv").write_text('id,note\n1,"a, b"\n2\n3,x,y,z\n4,"long ""text"" here"\n')
    rows = readers.csv_rows(spark, str(tmp_path / "r.csv"))
    assert sorted((r.id, r.note) for r in rows.collect()) == [("1", "a, b"), ("2", None), ("4", 'long "text" here')]
    assert readers.text_column(rows) == "note" and readers.text_column(rows.withColumnRenamed("id", "Review Text")) == "Review Text"
    assert readers.text_column(rows.withColumnRenamed("note", " Review_Text ")) == " Review_Text "
    assert readers.joined_column(rows, "note", "id").first()[0] == 'a, b\nlong "text" here'
    with pytest.raises(FileNotFoundError):
        readers.latest_run_path(str(tmp_path))
    for run in ("2024", "2025"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "documents.jsonl").write_text("")
    assert readers.latest_run_path(str(tmp_path / "runs")).endswith("2025/documents.jsonl")


def test_sinks_and_streams(spark, tmp_path):
    urls = spark.createDataFrame([("u1",), ("u1",), (" u2 ",), ("",)], "url string")
    for _ in range(2):
        sinks.append_new_urls(urls, str(tmp_path / "log"))
    assert sorted(r.url for r in readers.url_list(spark, str(tmp_path / "log")).collect()) == ["u1", "u2"]
    assert readers.url_list(spark, str(tmp_path / "nolog")).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    places = [str(tmp_path / x) for x in ("in", "out", "check")]
    for i in range(2):
        docs.where(F.col("doc_id") == i + 1).write.mode("append").parquet(places[0])
        assert ingest.ingest(spark, places[0], "doc_id long, text string", places[1], places[2]) == 1
    assert ingest.ingest(spark, places[0], "doc_id long, text string", places[1], places[2]) == 0
    assert spark.read.parquet(places[1]).count() == 2
    sinks.save_tables({"docs": docs}, {"alpha": 0.5}, str(tmp_path / "index"))
    tables, settings = sinks.load_tables(spark, str(tmp_path / "index"), ["docs"])
    assert tables["docs"].count() == 2 and settings == {"alpha": 0.5}
    with pytest.raises(FileNotFoundError):
        sinks.load_tables(spark, str(tmp_path / "x"), ["docs"])
    assert sinks.raw_pages(spark.createDataFrame([("n.html", "é")], "name string, html string"), str(tmp_path / "raw")).first().n_bytes == 2
