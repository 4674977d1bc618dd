"""Reranking, snippets, passages, prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbre.functions.text import cited, four_places, short_error, squeeze_bullets, truncate

#: Weights of the reranked score, its threshold, the pool, and stems too general to focus a query.
WEIGHTS = {"lsi": 0.70, "overlap": 0.20, "title": 0.08, "length": 0.02}
THRESHOLD, POOL = 0.2, 20
GENERIC = ["cub", "turism", "viaj", "destin", "vacacion", "hotel", "ciud", "lug"]
#: Segments that say nothing, whole and in part.
EMPTY_SEGMENTS = ["visitar cuba", "organizacion de agencias cubanas"]
EMPTY_PHRASES = [
    "visitar cuba es una organizacion de agencias cubanas",
    "si eres una agencia o tour operador",
    "datos personales y de contacto",
    "estoy de acuerdo con la politica de privacidad",
    "mapa interactivo",
]
#: The prompt and the sentences of answers.
PROMPT_HEAD = """Eres un asistente RAG especializado en turismo.
Responde unicamente con la evidencia del contexto recuperado.
Reglas:
1. No inventes hechos, precios, fechas o ubicaciones que no aparezcan en el contexto.
2. Si la evidencia es insuficiente o parcial, dilo explicitamente.
3. Integra detalles concretos del contexto y ancla cada idea con citas [1], [2], etc.
4. Prioriza claridad, sintesis y fidelidad al contexto recuperado.
5. Responde en espanol.

Consulta del usuario:
"""
PROMPT_MIDDLE = "\n\nContexto recuperado:\n"
PROMPT_TAIL = """

Formato esperado:
- Un parrafo breve que responda la consulta.
- Uno o dos detalles complementarios si aportan valor.
- No extrapoles mas alla de la evidencia."""
NO_CONTEXT = "No se recuperaron documentos relevantes."
NO_DOCUMENTS = "No encontre documentos suficientemente relevantes para responder con evidencia a la consulta: "
PREFIXES = ["Segun la informacion recuperada, ", "Ademas, ", "Tambien, "]


def focus(words: Column) -> Column:
    """Distinct query words without the general ones, or all if none is left."""
    rest = F.array_except(words, F.array(*map(F.lit, GENERIC)))
    return F.when(F.size(rest) > 0, rest).otherwise(F.array_distinct(words))


def overlap(query: Column, words: Column) -> Column:
    """Share of the query's distinct words that are among ``words``; 0 for an empty query."""
    return F.size(F.array_intersect(query, words)) / F.greatest(F.size(F.array_distinct(query)), F.lit(1))


def rerank_score(lsi: Column, content: Column, title: Column, words: Column) -> Column:
    return WEIGHTS["lsi"] * lsi + WEIGHTS["overlap"] * content + WEIGHTS["title"] * title + WEIGHTS["length"] * F.least(words / 120.0, F.lit(1.0))


def above_threshold(scored: DataFrame, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """The ``k`` best of those that reach the threshold, ranked from 1."""
    best = scored.where(F.col("score") >= threshold).orderBy(F.col("score").desc(), "doc_id").limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "doc_id")))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n+"), lambda p: F.trim(p)), lambda p: p != "")


def best_snippet(summary: Column, content: Column, query: Column, tokenise) -> Column:
    """The summary, else the paragraph with the largest overlap and length bonus (the first of equals), cut to 280 characters."""
    parts = paragraphs(content)
    scored = F.transform(parts, lambda p, i: F.struct(F.round(overlap(query, tokenise(p)) + F.least(F.length(p) / 240.0, F.lit(1.0)) * 0.05, 9).alias("score"), (-i).alias("order"), p.alias("p")))
    best = F.array_max(scored)
    found = F.when((F.trim(F.coalesce(content, F.lit(""))) == "") , F.lit("")).when(F.coalesce(best["score"], F.lit(0.0)) > 0, truncate(best["p"])).otherwise(truncate(content))
    return F.when(F.trim(F.coalesce(summary, F.lit(""))) != "", truncate(summary)).otherwise(found)


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, segment): the summary, then paragraphs; those over 360 characters as their sentences of 50 characters and more."""
    long = F.filter(F.transform(F.split(F.element_at(F.array(F.col("p")), 1), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 50)
    rows = docs.select("doc_id", F.coalesce("summary", F.lit("")).alias("summary"), F.posexplode_outer(paragraphs(F.col("content"))).alias("at", "p"))
    rows = rows.withColumn("parts", F.when(F.col("p").isNull(), F.array().cast("array<string>")).when(F.length("p") <= 360, F.array("p")).otherwise(long))
    lead = F.when((F.col("summary") != "") & (F.coalesce("at", F.lit(0)) == 0), F.array(F.struct(F.lit(-1).alias("i"), F.col("summary").alias("s")))).otherwise(F.array().cast("array<struct<i:int,s:string>>"))
    rows = rows.select("doc_id", F.coalesce("at", F.lit(0)).alias("at"), F.explode(F.concat(lead, F.transform("parts", lambda s, i: F.struct(i.alias("i"), s.alias("s"))))).alias("x"))
    return rows.select("doc_id", F.when(F.col("x.i") < 0, -1).otherwise(F.col("at") * 10_000 + F.col("x.i")).alias("seg_no"), F.col("x.s").alias("segment"))


def useful(segment: Column, title: Column) -> Column:
    """Whether a segment says something: long enough, neither title nor boilerplate, an address or a list of labels."""
    text = squeeze_bullets(segment)
    low = F.lower(text)
    marks = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    bad = low.isin(EMPTY_SEGMENTS) | (low == F.lower(squeeze_bullets(F.coalesce(title, F.lit("")))))
    for phrase in EMPTY_PHRASES:
        bad = bad | low.contains(phrase)
    bad = bad | low.startswith("ubicacion") | (low.startswith("calle ") & low.contains("cuba") & (marks(",") >= 2)) | (marks(":") >= 4)
    return (F.length(text) >= 40) & ~bad


def passage_score(doc_score: Column, shared: Column, n_query: Column, n_segment: Column, title_shared: Column, length: Column) -> Column:
    one = F.lit(1)
    return (
        doc_score
        + 1.2 * shared / F.greatest(n_query, one)
        + 0.35 * shared / F.greatest(n_segment, one)
        + 0.12 * F.least(shared, F.lit(4))
        + 0.15 * title_shared
        + 0.2 * F.least(length, F.lit(220)) / 220.0
        - F.when(length < 70, 0.2).otherwise(0.0)
    )


def best_passages(docs: DataFrame, query: list[str], tokenise, limit: int = 1) -> DataFrame:
    """(doc_id, citation_id, title, passage, score): each document's best segments for a query's words.

    Input: doc_id, citation_id, title, score, summary, content, and what ``tokenise`` reads (as the language). Segments alike but for case count once; those that share no word with the query are left out
    unless the title does.
    """
    active = focus(F.array(*map(F.lit, query))) if query else F.array().cast("array<string>")
    known = ("summary", "content", "score")
    parts = segments(docs).join(docs.select(*[c for c in docs.columns if c not in known], F.col("score").alias("doc_score")), "doc_id")
    parts = parts.where(useful(F.col("segment"), F.col("title"))).withColumn("passage", squeeze_bullets(F.col("segment")))
    first = Window.partitionBy("doc_id", F.lower("passage")).orderBy("seg_no")
    parts = parts.withColumn("again", F.row_number().over(first)).where("again = 1")
    words = F.array_distinct(tokenise(F.col("passage")))
    parts = parts.withColumn("words", words).withColumn("shared", F.size(F.array_intersect(active, F.col("words"))))
    parts = parts.withColumn("title_shared", F.size(F.array_intersect(active, tokenise(F.coalesce("title", F.lit(""))))))
    if query:
        parts = parts.where((F.col("title_shared") > 0) | (F.col("shared") > 0))
    score = passage_score(F.col("doc_score"), F.col("shared"), F.size(active), F.size("words"), F.col("title_shared"), F.length("passage"))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "seg_no")
    parts = parts.withColumn("score", F.round(score, 6)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return parts.select("doc_id", "citation_id", "title", "passage", "score")


def excerpt(summary: Column, content: Column, title: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return truncate(F.coalesce(blank(summary), blank(content), blank(title), F.lit("")))


def _joined(rows: DataFrame, text: Column, separator: str) -> DataFrame:
    """One row: the texts of a few retrieved documents in citation order."""
    return rows.select("citation_id", text.alias("t")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("citation_id", "t"))), lambda x: x["t"]), separator).alias("text"))


def prompt(docs: DataFrame, query: str) -> DataFrame:
    """(prompt): instructions, the query and a block for each retrieved document (citation_id, title, url, score, summary, content)."""
    url = F.coalesce(F.nullif(F.trim(F.coalesce("url", F.lit(""))), F.lit("")), F.lit("N/D"))
    block = F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] Titulo: "), F.col("title"), F.lit("\nURL: "), url, F.lit("\nScore: "), four_places(F.col("score")), F.lit("\nContexto: "), excerpt(F.col("summary"), F.col("content"), F.col("title")))
    context = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(NO_CONTEXT))
    return _joined(docs, block, "\n\n").select(F.concat(F.lit(PROMPT_HEAD + query.strip() + PROMPT_MIDDLE), context, F.lit(PROMPT_TAIL)).alias("prompt"))


def _prefix(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, PREFIXES)), number - 1), F.lit(""))


def _sources(docs: DataFrame) -> DataFrame:
    return _joined(docs, F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] "), F.col("title")), ", ")


def local_answer(docs: DataFrame, query: str, error: str) -> DataFrame:
    """(answer): an excerpt of up to three documents, what failed, and the sources."""
    some = docs.where(F.col("citation_id") <= 3)
    part = F.concat(_prefix(F.col("citation_id")), F.rtrim(excerpt(F.col("summary"), F.col("content"), F.col("title")), F.lit(".!?")), F.lit(" ["), F.col("citation_id").cast("string"), F.lit("]."))
    both = _joined(some, part, " ").crossJoin(_sources(some).withColumnRenamed("text", "sources"))  # one row each
    told = F.concat("text", F.lit(" Se devolvio respuesta local porque Ollama fallo: "), short_error(F.lit(error)), F.lit(" Fuentes usadas: "), "sources", F.lit("."))
    return both.select(F.when(F.col("sources") == "", F.lit(f"{NO_DOCUMENTS}{query}.")).otherwise(told).alias("answer"))


def select_passages(docs: DataFrame, query: list[str], tokenise, most: int = 3) -> DataFrame:
    """(citation_id, title, passage, score, place): each document's best passage, the best ``most`` of them; without any, excerpts in document order."""
    found = best_passages(docs, query, tokenise)
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "citation_id"))).where(F.col("place") <= most)
    plain = docs.where(F.col("citation_id") <= most).select("citation_id", "title", excerpt(F.col("summary"), F.col("content"), F.col("title")).alias("passage"), "score", F.col("citation_id").alias("place"))
    none = found.agg((F.count("*") == 0).alias("none"))
    return ranked.drop("doc_id").unionByName(plain.where(F.col("passage") != "").crossJoin(F.broadcast(none)).where("none").drop("none"))  # one row is joined


def extractive_answer(docs: DataFrame, query_text: str, query: list[str], tokenise) -> DataFrame:
    """(answer): up to three passages with citations, and the sources if there are several documents."""
    chosen = select_passages(docs, query, tokenise)
    said = chosen.select(F.col("place").alias("citation_id"), F.concat(_prefix(F.col("place")), cited(F.col("passage"), F.col("citation_id"))).alias("t"))
    text = _joined(said, F.col("t"), " ")
    meta = docs.agg(F.count("*").alias("n")).crossJoin(_sources(docs.where(F.col("citation_id") <= 3)).withColumnRenamed("text", "sources"))  # one row each
    full = F.concat("text", F.when(F.col("n") > 1, F.concat(F.lit(" Las fuentes principales consultadas fueron "), "sources", F.lit("."))).otherwise(""))
    little = F.concat(F.lit("Recupere documentos relacionados con la consulta, entre ellos "), "sources", F.lit(", pero el contenido disponible no alcanza para construir una respuesta mas detallada."))
    return text.crossJoin(meta).select(F.when(F.col("n") == 0, F.lit(f"{NO_DOCUMENTS}{query_text}.")).when(F.col("text") == "", little).otherwise(full).alias("answer"))
