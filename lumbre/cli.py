"""The command line: crawl, index, search, answer and evaluate over files in a folder.

    python -m lumbre COMMAND --data FOLDER ...

``FOLDER`` holds what the commands read and write: ``pages`` (a Parquet table of url, html and, where known, status_code, final_url, content_type, which stands for the web),
``hits`` (query, place, url: what a search engine gave), ``robots`` (host, rules), ``crawl/RUN`` (a run's documents, errors and report), ``visited``,
``vectors`` (the vector store) and ``lsi`` (model, frequencies and tokens).
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.functions import text as T
from lumbre.functions.stem import stem, stems
from lumbre.operators import crawl, evaluate, index, lsi, search, store
from lumbre.plans import answers
from lumbre.plans.tables import materialise
from lumbre.sources import readers, sinks

#: Fields that are encoded and stored.
TEXT_FIELDS = ["title", "content_text"]
STORED = ["url", "title", "summary", "content_type", "rating", "review_date", "location"]
MAIN = "spanish"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], schema) if schema else None
    return spark.read.parquet(path)


def _latest(spark: SparkSession, data: str) -> str:
    """The folder of the last run that has documents."""
    runs = _read(spark, f"{data}/runs", "run_id string, path string")
    path = crawl.latest_run(runs).first()["path"]
    if not path:
        raise FileNotFoundError(f"no documents below {data}/crawl")
    return path


def _documents(spark: SparkSession, data: str) -> DataFrame:
    return spark.read.parquet(f"{_latest(spark, data)}/documents")


def _words(text: str) -> list[str]:
    """Stems of a question, in order, as ``_tokens`` makes them of documents."""
    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(T.without_stopwords(T.tokens(T.clean(F.lit(text), entities=True)), F.lit(MAIN)).alias("w")).first()
    return [s for s in (stem(w, MAIN) for w in row["w"]) if s]


def _tokens(docs: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """(doc_id, tokens): stems of the joined fields of each document."""
    texts = store.assembled(docs, fields, separator=separator)
    words = texts.select("doc_id", F.posexplode(T.without_stopwords(T.tokens(T.clean(F.col("text"), entities=True)), F.lit(MAIN))).alias("pos", "term")).withColumn("language", F.lit(MAIN))
    words = materialise(words, "terms")
    got = words.join(stems(words), ["language", "term"]).where("stem != ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stem"))).alias("x"))
    return texts.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.coalesce(F.transform("x", lambda s: s["stem"]), F.array().cast("array<string>")).alias("tokens"))


def encoder_of(name: str | None) -> store.Encoder | None:
    """The function ``module:function``; none for no name."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def run_crawl(spark: SparkSession, args: argparse.Namespace) -> int:
    settings = crawl.Settings(args.seed, args.domain, args.max_depth, args.max_pages, obey_robots=not args.no_robots)
    pages = spark.read.parquet(f"{args.data}/pages")
    known = readers.url_list(spark, f"{args.data}/visited") if sinks.exists(spark, f"{args.data}/visited") else None
    told = lambda so_far: print(f"[crawl] depth={so_far['depth']} pages={so_far['pages']}")
    documents, errors, report = crawl.run(settings, pages, known, _read(spark, f"{args.data}/robots", "host string, rules string"), told)
    path = f"{args.data}/crawl/{report['run_id']}"
    documents.write.parquet(f"{path}/documents")
    errors.write.parquet(f"{path}/errors")
    sinks.append_new_urls(spark.read.parquet(f"{path}/documents").select("url"), f"{args.data}/visited")
    spark.createDataFrame([(report["run_id"], path)], "run_id string, path string").write.mode("append").parquet(f"{args.data}/runs")
    sinks.report(spark, report, f"{path}/report.json")
    print(f"Crawling finalizado\n- Run ID: {report['run_id']}")
    for label, name in (("Documentos guardados", "documents_saved"), ("Paginas HTML procesadas", "pages_fetched"), ("URLs visitadas", "urls_visited"), ("Errores", "errors")):
        print(f"- {label}: {report['stats'][name]}")
    print(f"- Reporte: {path}/report.json")
    return 0


def run_vectordb(spark: SparkSession, args: argparse.Namespace) -> int:
    encoder = encoder_of(args.encoder)
    if encoder is None:
        print("Falta un codificador de textos: --encoder modulo:funcion")
        return 1
    made = store.build(_documents(spark, args.data), store.Manifest(model_name=args.encoder, text_fields=TEXT_FIELDS, index_type="hnsw"), encoder, STORED, 20)
    store.save(made, f"{args.data}/vectors")
    print(f"Vector DB creada\n- Source: {_latest(spark, args.data)}\n- Fragmentos indexados: {spark.read.parquet(f'{args.data}/vectors/chunks').count()}\n- Output dir: {args.data}/vectors")
    return 0


def run_pipeline(spark: SparkSession, args: argparse.Namespace) -> int:
    return run_crawl(spark, args) or run_vectordb(spark, args)


def _by_vectors(spark: SparkSession, args: argparse.Namespace) -> Callable[[str, int], DataFrame] | None:
    encoder = encoder_of(args.encoder)
    if encoder is None:
        return None
    held = store.load(spark, f"{args.data}/vectors", encoder)
    return lambda query, k: store.search(held, spark.createDataFrame([(0, query)], "query_id int, query string"), k)


def run_query(spark: SparkSession, args: argparse.Namespace) -> int:
    find = _by_vectors(spark, args)
    if find is None:
        print("Falta un codificador de textos: --encoder modulo:funcion")
        return 1
    print(f"Resultados para: {args.text}")
    rows = find(args.text, args.top_k).orderBy("rank").collect() if args.text.strip() else []
    for r in rows:
        print(f"{r['rank']}. score={r['score']:.4f}  {r['title'] or ''}" + (f"\n   {r['url']}" if r["url"] else ""))
    if not rows:
        print("- Sin resultados")
    return 0


def fallback(spark: SparkSession, documents: DataFrame) -> Callable[[str, int], DataFrame]:
    """A search by words over documents' weighted fields: title three times, summary twice, content once."""

    def find(query: str, k: int) -> DataFrame:
        given = _words(query)
        if not given:
            return spark.createDataFrame([], "doc_id string, score double, rank int")
        named = {f: _tokens(documents, [f]).withColumnRenamed("tokens", f) for f in ("title", "summary", "content_text")}
        rows = named["title"].join(named["summary"], "doc_id", "full").join(named["content_text"], "doc_id", "full")
        every = F.concat(*[F.array_repeat(F.coalesce(f, F.array().cast("array<string>")), n) for f, n in (("title", 3), ("summary", 2), ("content_text", 1))])
        flat = materialise(rows.select("doc_id", "title", F.flatten(every).alias("tokens")), "fields")
        from lumbre.plans.retrieval import fallback_search

        return fallback_search(flat, given, k, F.col("title"))

    return find


def _show(done: answers.Answer, label: str, args: argparse.Namespace) -> None:
    print(f"{label} para: {args.text}\n{done.answer}\n\nFuentes:")
    for d in done.documents:
        print(f"[{d['citation_id']}] score={d['score']:.4f}  {d['title']}" + (f"\n   {d['url']}" if d["url"] else ""))
    if args.show_prompt:
        print(f"\nPrompt:\n{done.prompt}")


def run_rag_query(spark: SparkSession, args: argparse.Namespace) -> int:
    documents = _documents(spark, args.data)
    hits = answers.Retriever(_by_vectors(spark, args), fallback(spark, documents))(args.text, args.top_k)
    _show(answers.answer(hits.select("doc_id", "score", "rank"), documents, args.text), "Respuesta RAG", args)
    return 0


def run_lsi_train(spark: SparkSession, args: argparse.Namespace) -> int:
    documents = _documents(spark, args.data)
    tokens = materialise(_tokens(documents, ["title", "summary", "content_text"]), "tokens")
    if not tokens.limit(1).count():
        print("No se encontraron documentos para entrenar LSI.")
        return 1
    model, idfs = lsi.train_documents(tokens, args.components)
    lsi.save(model, f"{args.data}/lsi/model")
    index.save(idfs, f"{args.data}/lsi/tfidf")
    tokens.write.mode("overwrite").parquet(f"{args.data}/lsi/tokens")
    print(f"LSI entrenado y guardado\n- Documentos: {model.n_documents}\n- Vocabulario: {model.n_terms}\n- Componentes LSI: {args.components}\n- Modelo: {args.data}/lsi")
    return 0


def lsi_hits(spark: SparkSession, data: str, query: str, k: int, refined: bool = True) -> DataFrame:
    """(doc_id, title, url, snippet, lsi_score, score, rank) of the trained model; baseline hits are ranked by the model alone."""
    model, (idfs, alpha, _) = lsi.load(spark, f"{data}/lsi/model"), index.load(spark, f"{data}/lsi/tfidf")
    given = _words(query)
    scored = lsi.scores(index.query_vector(given, idfs, alpha), model)
    pool = index.top(scored.withColumnRenamed("lsi_score", "score"), max(k, search.POOL) if refined else k).withColumnRenamed("score", "lsi_score")
    docs = _documents(spark, data)
    rows = docs.join(F.broadcast(pool), "doc_id").join(spark.read.parquet(f"{data}/lsi/tokens"), "doc_id")  # at most the pool
    asked = F.array(*map(F.lit, given)) if given else F.array().cast("array<string>")
    plain = lambda c: T.without_stopwords(T.tokens(T.clean(c)), F.lit(MAIN))
    titled = _tokens(docs.join(F.broadcast(pool.select("doc_id")), "doc_id"), ["title"]).withColumnRenamed("tokens", "title_tokens")
    rows = rows.join(titled, "doc_id", "left")
    score = search.rerank_score(F.col("lsi_score"), search.overlap(asked, F.col("tokens")), search.overlap(asked, F.coalesce("title_tokens", F.array().cast("array<string>"))), T.word_count(F.col("content_text")))
    words = F.array(*map(F.lit, query.lower().split())) if query.split() else F.array().cast("array<string>")
    rows = rows.select("doc_id", "title", "url", search.best_snippet(F.col("summary"), F.col("content_text"), words, plain).alias("snippet"), "lsi_score", F.round(score if refined else F.col("lsi_score"), 6).alias("score"))
    return search.above_threshold(rows, k) if refined else index.top(rows, k)


def _untrained(spark: SparkSession, args: argparse.Namespace) -> bool:
    missing = [p for p in (f"{args.data}/lsi/model", f"{args.data}/lsi/tfidf") if not sinks.exists(spark, p)]
    if missing:
        print("Faltan archivos de indice LSI/TF-IDF:", *[f"- {p}" for p in missing], "Primero debes construir el TF-IDF y entrenar el LSI: lsi_train", sep="\n")
    return bool(missing)


def run_lsi_query(spark: SparkSession, args: argparse.Namespace) -> int:
    if _untrained(spark, args):
        return 1
    rows = lsi_hits(spark, args.data, args.text, args.top_k).orderBy("rank").collect()
    print(f"Resultados LSI para: {args.text}")
    for r in rows:
        print(f"{r['rank']}. score={r['score']:.4f}  lsi={r['lsi_score']:.4f}  {r['title'] or '(sin titulo)'}\n   doc_id={r['doc_id']}" + (f"\n   {r['url']}" if r["url"] else "") + (f"\n   snippet: {r['snippet']}" if r["snippet"] else ""))
    if not rows:
        print("- Sin resultados por encima del umbral de relevancia")
    return 0


def run_lsi_rag(spark: SparkSession, args: argparse.Namespace) -> int:
    if _untrained(spark, args):
        return 1
    hits = lsi_hits(spark, args.data, args.text, args.top_k)
    if not hits.limit(1).count():
        print(f"No se encontraron resultados LSI para: {args.text}")
        return 0
    _show(answers.answer(hits.select("doc_id", "score", "rank"), _documents(spark, args.data), args.text, contents=("content", "content_text")), "Respuesta RAG+LSI", args)
    return 0


def run_web_search(spark: SparkSession, args: argparse.Namespace) -> int:
    hits = _read(spark, f"{args.data}/hits", "query string, place int, url string")
    pages = _read(spark, f"{args.data}/pages", "url string, html string, status_code int")
    pages = pages if "status_code" in pages.columns else pages.withColumn("status_code", F.lit(200))
    log = f"{args.data}/visited"
    known = readers.url_list(spark, log) if sinks.exists(spark, log) else spark.createDataFrame([], "url string")
    found = materialise(crawl.web_search(hits, pages, known, args.text, args.top_k), "found")
    n = found.count()
    print(f"Resultados Web para: {args.text}")
    if not n:
        print("- Sin documentos nuevos (posiblemente ya visitados o no accesibles)")
        return 0
    sinks.append_lines(found, args.output or f"{args.data}/web_search")
    sinks.append_new_urls(found.select("url"), log)
    print(f"- Documentos extraidos: {n}\n- Guardados en: {args.output or f'{args.data}/web_search'}")
    return 0


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    if not sinks.exists(spark, args.qrels):
        print(f"No se encontro archivo de evaluacion: {args.qrels}")
        return 1
    if _untrained(spark, args):
        return 1
    judged = json.loads("\n".join(r[0] for r in spark.read.text(args.qrels).collect()))["queries"]  # a file of some questions
    judged = [q for q in judged if q["query"].strip()]
    asked = spark.createDataFrame([(q["query_id"],) for q in judged], "query_id string")
    qrels = spark.createDataFrame([(q["query_id"], d) for q in judged for d in q["relevant_doc_ids"]], "query_id string, doc_id string")
    report, means = {"query_count": len(judged), "top_k": args.top_k}, []
    for section, system, refined in (("baseline", "tfidf+lsi", False), ("refined", "tfidf+lsi+rerank", True)):
        runs = [(q["query_id"], r["doc_id"], r["rank"]) for q in judged for r in lsi_hits(spark, args.data, q["query"], args.top_k, refined).collect()]
        per = evaluate.per_query(spark.createDataFrame(runs, "query_id string, doc_id string, rank int"), qrels, asked)
        means.append(evaluate.summary(per).first().asDict())
        report[section] = {"system": system, "summary": means[-1], "queries": [r.asDict() | {"retrieved_doc_ids": [d for q, d, _ in sorted(runs, key=lambda x: x[2]) if q == r["query_id"]]} for r in per.collect()]}
    report["delta"] = {k: means[1][k] - means[0][k] for k in means[0]}
    sinks.report(spark, report, args.report_out or f"{args.data}/evaluation.json")
    print(f"Evaluacion REC-01\n- Consultas: {report['query_count']}\n- top_k: {report['top_k']}")
    for section in ("baseline", "refined"):
        print(report[section]["system"], *[f"  {k}: {v:.4f}" for k, v in report[section]["summary"].items()], sep="\n")
    print("Delta refinado - baseline", *[f"  {k}: {v:+.4f}" for k, v in report["delta"].items()], sep="\n")
    return 0


def run_preprocess(spark: SparkSession, args: argparse.Namespace) -> int:
    """Tokens of all files below a folder, a folder of JSON for each source."""
    texts = readers.whole_files(spark, args.raw_dir).select(F.col("doc_id"), F.col("text"), F.lit(args.language).alias("lang"))
    for row in readers.discover(spark, args.raw_dir, [".csv"]).collect():  # a row for each file
        table = readers.csv_rows(spark, row["path"])
        column = readers.text_column(table, args.text_column)
        if column:
            one = readers.joined_column(table.withColumn("_n", F.monotonically_increasing_id()), column, "_n")
            texts = texts.unionByName(one.select(F.lit(f"{row['slug']}_doc").alias("doc_id"), "text", F.lit(args.language).alias("lang")))
    from lumbre.plans.retrieval import stemmed

    rows = texts.withColumn("tokens", T.without_stopwords(T.tokens(T.clean(F.col("text"), entities=True)), T.language_name(F.col("lang"))))
    made = stemmed(rows).select(F.regexp_replace("doc_id", "_doc$", "").alias("source"), "doc_id", "tokens")
    sinks.per_source(made, args.out_dir)
    print(f"- Documentos: {spark.read.json(args.out_dir).count()}\n- Output dir: {args.out_dir}")
    return 0


def parser() -> argparse.ArgumentParser:
    whole = argparse.ArgumentParser(prog="lumbre", description="Crawl, index, search, answer and evaluate.")
    commands = whole.add_subparsers(dest="command")

    def command(name: str, run, help: str, *, asks: int | None = None, prompt: bool = False, crawls: bool = False) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=help)
        own.set_defaults(run=run)
        own.add_argument("--data", default="data")
        own.add_argument("--encoder", help="module:function that encodes a list of texts")
        if asks:
            own.add_argument("query", nargs="+")
            own.add_argument("--top-k", type=int, default=asks)
        if prompt:
            own.add_argument("--show-prompt", action="store_true")
        if crawls:
            own.add_argument("--seed", action="append", default=[])
            own.add_argument("--domain", action="append", default=[])
            own.add_argument("--max-depth", type=int, default=2)
            own.add_argument("--max-pages", type=int, default=2000)
            own.add_argument("--no-robots", action="store_true")
        return own

    command("crawl", run_crawl, "crawl the pages", crawls=True)
    command("vectordb", run_vectordb, "build the vector store")
    command("pipeline", run_pipeline, "crawl, then build the vector store", crawls=True)
    command("query", run_query, "search the vector store", asks=5)
    command("rag_query", run_rag_query, "answer from the vector store", asks=4, prompt=True)
    command("lsi_rag", run_lsi_rag, "answer from the LSI model", asks=4, prompt=True)
    command("lsi_train", run_lsi_train, "train TF-IDF and LSI").add_argument("--components", type=int, default=100)
    command("lsi_query", run_lsi_query, "search the LSI model", asks=5)
    command("web_search", run_web_search, "extract the pages of a web search", asks=5).add_argument("--output")
    own = command("evaluate_rec01", run_evaluate, "compare plain and refined LSI search")
    own.add_argument("--qrels", required=True)
    own.add_argument("--top-k", type=int, default=5)
    own.add_argument("--report-out")
    own = command("preprocess", run_preprocess, "tokens of files")
    own.add_argument("--raw-dir", required=True)
    own.add_argument("--out-dir", required=True)
    own.add_argument("--language", default="english")
    own.add_argument("--text-column")
    return whole


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    whole = parser()
    args = whole.parse_args(arguments)
    if not args.command:
        whole.print_help()
        return 1
    args.text = " ".join(getattr(args, "query", []))
    try:
        return args.run(spark or SparkSession.builder.appName("lumbre").getOrCreate(), args)
    except (FileNotFoundError, ValueError) as problem:
        print(problem)
        return 1
