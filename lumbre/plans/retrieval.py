"""Queries of indexing, search and evaluation over the test tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbre.functions import text as T
from lumbre.functions.stem import stem, stems
from lumbre.operators import crawl, evaluate, index, lsi, search, vectors, web
from lumbre.plans.tables import materialise, table

QUERY = ["playa", "hotel", "piscinas", "naturales", "rocas"]
QUERY_TEXT = "playa con hotel y piscinas naturales entre las rocas"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, title, cleaned, tokens): documents with their first line as title; tokens without stop words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "url")
    rows = rows.withColumn("title", F.trim(F.element_at(F.split("text", "\n"), 1))).withColumn("cleaned", T.clean(F.col("text"), entities=True))
    return rows.withColumn("tokens", T.without_stopwords(T.tokens(F.col("cleaned")), T.language_name(F.col("lang"))))


def words(text: Column) -> Column:
    """Tokens of a text of a row, without the stop words of the row's language."""
    return T.without_stopwords(T.tokens(T.clean(text)), T.language_name(F.col("lang")))


def _list(ws: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


_CLEAN = r"trim(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[’‘'']', '', 'g'))), '[^a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_STOP = "CASE WHEN lang = 'en' THEN {0} WHEN lang = 'es' THEN {1} ELSE CAST([] AS VARCHAR[]) END".format(_list(T.STOPWORDS["english"]), _list(T.STOPWORDS["spanish"]))
_TOK = "list_filter(list_filter(string_split(cleaned, ' '), lambda w: length(w) >= 2), lambda w: NOT list_contains(stop, w))"
DOCS = f"""docs AS (SELECT *, {_TOK} AS tokens FROM (SELECT doc_id, text, lang, source, url, trim(string_split(text, chr(10))[1]) AS title,
    {_CLEAN.format("text")} AS cleaned, {_STOP} AS stop FROM documents))"""
TF = "tf AS (SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY ALL)"
IDF = "idf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM docs)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term)"
W = "w AS (SELECT doc_id, term, freq, (0.5 + 0.5 * freq / max(freq) OVER (PARTITION BY doc_id)) * idf AS weight FROM tf JOIN idf USING (term))"


def _words_sql(text: str) -> str:
    return f"list_filter(list_filter(string_split({_CLEAN.format(text)}, ' '), lambda w: length(w) >= 2), lambda w: NOT list_contains(stop, w))"


def _flat(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def _trunc(text: str) -> str:
    return f"CASE WHEN length({_flat(text)}) <= 280 THEN {_flat(text)} ELSE rtrim(substr({_flat(text)}, 1, 277)) || '...' END"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOCS} SELECT doc_id, cleaned FROM docs")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", "cleaned")


@query(f"WITH {DOCS} SELECT doc_id, length(list_filter(string_split(cleaned, ' '), lambda w: length(w) >= 2))::INT AS n_tokens FROM docs")
def tokenize(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.tokens(F.col("cleaned"))).alias("n_tokens"))


@query(f"WITH {DOCS} SELECT doc_id, length(tokens)::INT AS n_kept, array_to_string(tokens, ' ') AS kept FROM docs")
def stopword_filter(spark, d):
    return docs(spark, d).select("doc_id", F.size("tokens").alias("n_kept"), F.array_join("tokens", " ").alias("kept"))


@query(f"SELECT doc_id, CASE WHEN {_flat('text')} = '' THEN 0 ELSE length(string_split({_flat('text')}, ' ')) END::INT AS word_count FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query("""SELECT seq, CASE WHEN l IN ('', 'en', 'eng', 'english', 'ingles', 'ing') THEN 'english' WHEN l IN ('es', 'spa', 'spanish', 'espanol', 'español') THEN 'spanish' ELSE l END AS language_name
    FROM (SELECT seq, lower(trim(coalesce(language, ''))) AS l FROM crawled_documents)""")
def language_alias(spark, d):
    return table(spark, d, "crawled_documents").select("seq", T.language_name(F.col("language")).alias("language_name"))


@query()
def stem_terms(spark, d):
    return stems(docs(spark, d).select(T.language_name(F.col("lang")).alias("language"), F.explode("tokens").alias("term")))


def stemmed(rows: DataFrame, fields: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """``rows`` (doc_id, lang and others) with the words of ``fields`` stemmed, in their order; stems are made of distinct terms and joined back. Languages other than Spanish are stemmed as English."""
    words_of = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ws")) for f in fields])
    terms = rows.select("doc_id", T.language_name(F.col("lang")).alias("language"), F.explode(words_of).alias("x")).select("doc_id", "language", "x.field", F.posexplode("x.ws").alias("pos", "term"))
    terms = materialise(terms, "terms")
    got = terms.join(stems(terms), ["language", "term"]).where("stem != ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("field", "pos", "stem"))).alias("_x"))
    of = lambda f: F.transform(F.filter(F.coalesce("_x", F.array().cast("array<struct<field:string,pos:int,stem:string>>")), lambda s: s["field"] == f), lambda s: s["stem"])
    return rows.drop(*fields).join(got, "doc_id", "left").select("*", *[of(f).alias(f) for f in fields]).drop("_x")


@query()
def process_text(spark, d):
    """(doc_id, tokens): the whole preparation of a text, down to stems."""
    return stemmed(docs(spark, d).select("doc_id", "lang", "tokens")).select("doc_id", "tokens")


@query(f"WITH {DOCS}, {TF} SELECT term, doc_id, freq FROM tf")
def inverted_index(spark, d):
    return index.term_frequencies(docs(spark, d))


@query(f"WITH {DOCS}, {TF} SELECT doc_id, freq FROM tf WHERE term = 'playa'")
def postings_lookup(spark, d):
    return index.postings(index.term_frequencies(docs(spark, d)), "playa")


@query(f"WITH {DOCS}, {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark, d):
    return index.document_frequencies(index.term_frequencies(docs(spark, d)))


@query(f"WITH {DOCS}, {TF}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, d):
    rows = docs(spark, d)
    return index.idf_table(index.term_frequencies(rows), rows).withColumn("idf", F.round("idf", 6))


@query(f"WITH {DOCS}, {TF}, {IDF} SELECT term, df, round(idf / ln(2), 6) AS idf FROM idf")
def idf_log_base(spark, d):
    rows = docs(spark, d)
    return index.idf_table(index.term_frequencies(rows), rows, 2.0).withColumn("idf", F.round("idf", 6))


@query(f"WITH {DOCS}, {TF}, {IDF}, {W} SELECT doc_id, term, freq, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, d):
    return index.tfidf(docs(spark, d)).withColumn("weight", F.round("weight", 6))


_QV = f"""q AS (SELECT term, (0.5 + 0.5 * f / max(f) OVER ()) * idf AS weight FROM (SELECT term, count(*) AS f FROM (SELECT unnest({_list(QUERY + ["playa", "noword"])}) AS term) GROUP BY term) JOIN idf USING (term))"""


@query(f"WITH {DOCS}, {TF}, {IDF}, {_QV} SELECT term, round(weight, 6) AS weight FROM q")
def tfidf_query_vector(spark, d):
    rows = docs(spark, d)
    idfs = index.idf_table(index.term_frequencies(rows), rows)
    return index.query_vector(QUERY + ["playa", "noword"], idfs).withColumn("weight", F.round("weight", 6))


def _cosines(rows: DataFrame, given: list[str]) -> DataFrame:
    postings = materialise(index.term_frequencies(rows), "postings")
    idfs = materialise(index.idf_table(postings, rows), "idf")
    return index.search(postings, idfs, index.query_vector(given, idfs))


_Q = _QV.replace(", 'playa', 'noword'", "")
_COS = """cos AS (SELECT doc_id, CASE WHEN n * qn > 0 THEN dot / (n * qn) ELSE 0 END AS score FROM (SELECT doc_id, sum(w.weight * q.weight) AS dot FROM w JOIN q USING (term) GROUP BY doc_id)
    JOIN (SELECT doc_id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY doc_id) USING (doc_id), (SELECT sqrt(sum(weight * weight)) AS qn FROM q))"""


@query(f"""WITH {DOCS}, {TF}, {IDF}, {W}, {_Q}, {_COS}
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM cos ORDER BY 2 DESC, 1 LIMIT 10)""")
def tfidf_cosine_topk(spark, d):
    return index.top(_cosines(docs(spark, d), QUERY), 10)


@query(f"""WITH {DOCS} SELECT doc_id, term, sum(w)::BIGINT AS freq FROM (SELECT doc_id, 3 AS w, unnest({_words_sql("title")}) AS term FROM docs UNION ALL SELECT doc_id, 1, unnest({_words_sql("text")}) FROM docs) GROUP BY ALL""")
def weighted_field_tokens(spark, d):
    rows = docs(spark, d).select("doc_id", words(F.col("title")).alias("title"), words(F.col("text")).alias("content"))
    return index.weighted_fields(rows, {"title": 3, "content": 1})


def fallback_search(rows: DataFrame, given: list[str], k: int, title: Column | None = None) -> DataFrame:
    """(doc_id, score, rank): a pool by cosine, then a point for focus words in the title and a fraction for those in the text. rows: doc_id, tokens, and title and lang, or ``title`` as words."""
    pool = _cosines(rows, given).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc_id").limit(max(6 * k, 12)).where("score > 0")
    focused = search.focus(F.array(*map(F.lit, given)))
    both = rows.join(F.broadcast(pool), "doc_id")  # at most the pool
    shared = lambda c: F.size(F.array_intersect(focused, c))
    score = F.col("score") + 1.1 * shared(words(F.col("title")) if title is None else title) + 0.18 * shared(F.col("tokens"))
    return index.top(both.select("doc_id", score.alias("score")), k)


def stemmed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` with the stems of text and title, as the index and the searches of a whole pipeline take them."""
    rows = docs(spark, sf_dir)
    return materialise(stemmed(rows.withColumn("title_tokens", words(F.col("title"))), ("tokens", "title_tokens")), "stemmed")


STEMS = [stem(w, "spanish") for w in QUERY]


@query()
def stemmed_tfidf_weights(spark, d):
    return index.tfidf(stemmed_docs(spark, d)).withColumn("weight", F.round("weight", 6))


@query()
def stemmed_fallback_search(spark, d):
    return fallback_search(stemmed_docs(spark, d), STEMS, 4, F.col("title_tokens"))


@query()
def stemmed_passage_score(spark, d):
    """Passages of the documents found by stems, scored by the words themselves."""
    rows = stemmed_docs(spark, d)
    best = fallback_search(rows, STEMS, 4, F.col("title_tokens"))
    both = rows.join(F.broadcast(best), "doc_id")  # at most k
    found = both.select("doc_id", "lang", F.col("rank").alias("citation_id"), "title", "url", "score", F.lit("").alias("summary"), F.col("text").alias("content"))
    return search.best_passages(materialise(found, "retrieved"), QUERY, words, 3)


_SHARED = "length(list_distinct(list_intersect({0}, {1})))"


@query(f"""WITH {DOCS}, {TF}, {IDF}, {W}, {_Q}, {_COS}, pool AS (SELECT doc_id, round(score, 6) AS score FROM cos ORDER BY 2 DESC, 1 LIMIT 24),
    s AS (SELECT doc_id, round(score + 1.1 * {_SHARED.format(_list([w for w in QUERY if w not in search.GENERIC]), _words_sql("title"))} + 0.18 * {_SHARED.format(_list([w for w in QUERY if w not in search.GENERIC]), "tokens")}, 6) AS score FROM pool JOIN docs USING (doc_id) WHERE score > 0)
    SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM s ORDER BY score DESC, doc_id LIMIT 4""")
def tfidf_fallback_search(spark, d):
    return fallback_search(docs(spark, d), QUERY, 4)


@query(f"""WITH {DOCS} SELECT doc_id, array_to_string(list_sort(CASE WHEN length(rest) > 0 THEN rest ELSE all_words END), ' ') AS focus FROM
    (SELECT doc_id, list_distinct(t) AS all_words, list_distinct(list_filter(t, lambda w: NOT list_contains({_list(search.GENERIC)}, w))) AS rest FROM (SELECT doc_id, {_words_sql("title")} AS t FROM docs))""")
def focus_tokens(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.array_sort(search.focus(words(F.col("title")))), " ").alias("focus"))


_CHUNK = r"""c AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(ceil((length(ws) - 120) / 90.0), 0)::BIGINT)) AS no FROM
    (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents) WHERE length(ws) > 0)"""


@query(f"WITH {_CHUNK} SELECT doc_id, no::INT AS chunk_no, length(ws[no * 90 + 1 : no * 90 + 120])::INT AS n_words, array_to_string(ws[no * 90 + 1 : no * 90 + 120], ' ') AS chunk FROM c")
def chunk_documents(spark, d):
    return vectors.chunks(table(spark, d, "documents"))


@query(f"WITH {_CHUNK} SELECT doc_id, count(*) AS chunks, sum(length(ws[no * 90 + 1 : no * 90 + 120]))::BIGINT AS words FROM c GROUP BY doc_id")
def chunk_stats(spark, d):
    return vectors.chunks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("n_words").alias("words"))


def _asked(spark, d) -> DataFrame:
    """The query set of vector searches: every row whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT vec_id AS query_id, e AS te FROM v WHERE vec_id % 100 = 0)"
_METRICS = {
    "cosine": "list_cosine_similarity(e, te)",
    "ip": "list_inner_product(e, te)",
    "l2": "-list_sum(list_transform(list_zip(e, te), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
}


def _top_sql(metric: str) -> str:
    return f"""WITH {_VEC}, s AS (SELECT query_id, vec_id, round({_METRICS[metric]}, 6) + 0.0 AS score FROM v, t)
        SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""


@query(_top_sql("cosine"))
def vector_cosine_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), _asked(spark, d), 10, "cosine")


@query(_top_sql("ip"))
def vector_ip_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), _asked(spark, d), 10, "ip")


@query(_top_sql("l2"))
def vector_l2_topk(spark, d):
    return vectors.nearest(table(spark, d, "embeddings"), _asked(spark, d), 10, "l2")


@query()
def vector_lists_topk(spark, d):
    """The approximate index, over all rows, for the same queries."""
    return vectors.search_lists(vectors.build_lists(table(spark, d, "embeddings")), _asked(spark, d), 10)


@query("SELECT vec_id, pos::INT AS pos, round(x / n, 6) AS x FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def vector_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.normalise(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {_VEC}, s AS (SELECT query_id, label, vec_id, round({_METRICS["ip"]}, 6) AS score FROM v, t),
    p AS (SELECT query_id, label, max(score) AS score, count(*) AS chunk_hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 40 GROUP BY query_id, label)
    SELECT * FROM (SELECT query_id, label, score, chunk_hits, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label)::INT AS rank FROM p) WHERE rank <= 5""")
def vector_doc_maxpool(spark, d):
    return vectors.nearest_documents(table(spark, d, "embeddings"), _asked(spark, d), 5)


_OVER = f"{_SHARED.format(_list(QUERY), '{0}')} / {float(len(QUERY))}"


@query(f"WITH {DOCS} SELECT doc_id, round({_OVER.format('tokens')}, 6) AS lexical_overlap FROM docs")
def lexical_overlap(spark, d):
    return docs(spark, d).select("doc_id", F.round(search.overlap(F.array(*map(F.lit, QUERY)), F.col("tokens")), 6).alias("lexical_overlap"))


def _reranked(spark, d) -> DataFrame:
    rows = docs(spark, d)
    pool = index.top(_cosines(rows, QUERY), search.POOL)
    given = F.array(*map(F.lit, QUERY))
    both = rows.join(F.broadcast(pool.select("doc_id", F.col("score").alias("lsi"))), "doc_id")  # at most the pool
    score = search.rerank_score(F.col("lsi"), search.overlap(given, F.col("tokens")), search.overlap(given, words(F.col("title"))), T.word_count(F.col("text")))
    return both.select("doc_id", F.round(score, 6).alias("score"))


_RERANK = f"""{DOCS}, {TF}, {IDF}, {W}, {_Q}, {_COS}, pool AS (SELECT doc_id, round(score, 6) AS lsi FROM cos ORDER BY 2 DESC, 1 LIMIT 20),
    scored AS (SELECT doc_id, round(0.7 * lsi + 0.2 * {_OVER.format("tokens")} + 0.08 * {_OVER.format(_words_sql("title"))} + 0.02 * least(length(string_split({_flat("text")}, ' ')) / 120.0, 1), 6) AS score FROM pool JOIN docs USING (doc_id))"""


@query(f"WITH {_RERANK} SELECT doc_id, score FROM scored")
def rerank_score(spark, d):
    return _reranked(spark, d)


@query(f"WITH {_RERANK} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT * FROM scored WHERE score >= 0.2 ORDER BY score DESC, doc_id LIMIT 10)")
def threshold_filter(spark, d):
    return search.above_threshold(_reranked(spark, d), 10)


_PARAS = r"list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: trim(p)), lambda p: p <> '')"


@query(f"""WITH {DOCS}, p AS (SELECT doc_id, text, stop, unnest({_PARAS}) AS p, generate_subscripts({_PARAS}, 1) AS i FROM docs),
    s AS (SELECT doc_id, text, p, i, round({_OVER.format(_words_sql("p"))} + least(length(p) / 240.0, 1) * 0.05, 9) AS score FROM p)
    SELECT doc_id, {_trunc("p")} AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM s) WHERE n = 1""")
def best_snippet(spark, d):
    return docs(spark, d).select("doc_id", search.best_snippet(F.lit(None).cast("string"), F.col("text"), F.array(*map(F.lit, QUERY)), words).alias("snippet"))


@query(f"SELECT doc_id, {_trunc('text')} AS cut FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text")).alias("cut"))


def _retrieved(spark, d, k: int = 4) -> DataFrame:
    """The documents that the fallback search finds, in the shape that passages and prompts take."""
    rows = docs(spark, d)
    best = fallback_search(rows, QUERY, k)
    both = rows.join(F.broadcast(best), "doc_id")  # at most k
    return both.select("doc_id", "lang", F.col("rank").alias("citation_id"), "title", "url", "score", F.lit("").alias("summary"), F.col("text").alias("content"))


_SEG = rf"""seg AS (SELECT doc_id, (i - 1) * 10000 + unnest(generate_series(0, length(parts) - 1)) AS seg_no, unnest(parts) AS segment FROM
    (SELECT doc_id, i, CASE WHEN length(p) <= 360 THEN [p] ELSE list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 50) END AS parts
     FROM (SELECT doc_id, unnest({_PARAS}) AS p, generate_subscripts({_PARAS}, 1) AS i FROM docs)) WHERE length(parts) > 0)"""


@query(f"WITH {DOCS}, {_SEG} SELECT doc_id, seg_no::INT AS seg_no, segment FROM seg")
def passage_segments(spark, d):
    return search.segments(docs(spark, d).select("doc_id", F.lit("").alias("summary"), F.col("text").alias("content")))


_BULLET = "trim(" + _flat("{0}") + ", '-• ')"
_SEGTEXT = _BULLET.format("segment")
_USEFUL = f"""(length({_SEGTEXT}) >= 40 AND lower({_SEGTEXT}) NOT IN ('visitar cuba', 'organizacion de agencias cubanas') AND lower({_SEGTEXT}) <> lower({_BULLET.format("title")})
    AND NOT ({" OR ".join(f"contains(lower({_SEGTEXT}), '{p}')" for p in search.EMPTY_PHRASES)}) AND NOT starts_with(lower({_SEGTEXT}), 'ubicacion')
    AND NOT (starts_with(lower({_SEGTEXT}), 'calle ') AND contains(lower({_SEGTEXT}), 'cuba') AND length({_SEGTEXT}) - length(replace({_SEGTEXT}, ',', '')) >= 2)
    AND length({_SEGTEXT}) - length(replace({_SEGTEXT}, ':', '')) < 4)"""


@query(f"WITH {DOCS}, {_SEG} SELECT doc_id, seg_no::INT AS seg_no FROM seg JOIN docs USING (doc_id) WHERE {_USEFUL}")
def useful_segments(spark, d):
    rows = docs(spark, d)
    parts = search.segments(rows.select("doc_id", F.lit("").alias("summary"), F.col("text").alias("content")))
    return parts.join(rows.select("doc_id", "title"), "doc_id").where(search.useful(F.col("segment"), F.col("title"))).select("doc_id", "seg_no")


def _found(spark, d) -> DataFrame:
    return materialise(_retrieved(spark, d), "retrieved")


_FOUND = f"""{DOCS}, {TF}, {IDF}, {W}, {_Q}, {_COS}, pool AS (SELECT doc_id, round(score, 6) AS score FROM cos ORDER BY 2 DESC, 1 LIMIT 24),
    fs AS (SELECT doc_id, round(score + 1.1 * {_SHARED.format(_list([w for w in QUERY if w not in search.GENERIC]), _words_sql("title"))} + 0.18 * {_SHARED.format(_list([w for w in QUERY if w not in search.GENERIC]), "tokens")}, 6) AS score FROM pool JOIN docs USING (doc_id) WHERE score > 0),
    hits AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS citation_id, score FROM fs ORDER BY score DESC, doc_id LIMIT 4),
    ret AS (SELECT doc_id, citation_id, score, title, url, text, stop FROM hits JOIN docs USING (doc_id))"""
_ACTIVE = _list([w for w in QUERY if w not in search.GENERIC])
_N = float(len([w for w in QUERY if w not in search.GENERIC]))
_PASS = f"""{_FOUND}, {_SEG}, ps AS (SELECT doc_id, citation_id, title, stop, score AS ds, seg_no, {_SEGTEXT} AS passage FROM seg JOIN ret USING (doc_id) WHERE {_USEFUL}),
    pd AS (SELECT *, list_distinct({_words_sql("passage")}) AS ws, {_SHARED.format(_ACTIVE, _words_sql("title"))} AS ts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(passage) ORDER BY seg_no) AS again FROM ps) WHERE again = 1),
    pe AS (SELECT *, {_SHARED.format(_ACTIVE, "ws")} AS sh FROM pd),
    pf AS (SELECT doc_id, citation_id, title, passage, seg_no, round(ds + 1.2 * sh / {_N} + 0.35 * sh / greatest(length(ws), 1) + 0.12 * least(sh, 4) + 0.15 * ts + 0.2 * least(length(passage), 220) / 220.0 - CASE WHEN length(passage) < 70 THEN 0.2 ELSE 0 END, 6) AS score FROM pe WHERE ts > 0 OR sh > 0)"""


@query(f"WITH {_PASS} SELECT doc_id, citation_id, title, passage, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seg_no) AS n FROM pf) WHERE n <= 3")
def passage_score(spark, d):
    return search.best_passages(_found(spark, d), QUERY, words, 3)


_SELECTED = "sel AS (SELECT citation_id, title, passage, score, row_number() OVER (ORDER BY score DESC, citation_id)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seg_no) AS n FROM pf) WHERE n = 1)"


@query(f"WITH {_PASS}, {_SELECTED} SELECT citation_id, title, passage, score, place FROM sel WHERE place <= 3")
def select_passages(spark, d):
    return search.select_passages(_found(spark, d), QUERY, words)


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""WITH {_FOUND} SELECT {_sql_text(search.PROMPT_HEAD + QUERY_TEXT + search.PROMPT_MIDDLE)} || string_agg('[' || citation_id || '] Titulo: ' || title || chr(10) || 'URL: ' || coalesce(nullif(trim(url), ''), 'N/D') || chr(10)
    || 'Score: ' || printf('%.4f', score) || chr(10) || 'Contexto: ' || ({_trunc("text")}), chr(10) || chr(10) ORDER BY citation_id) || {_sql_text(search.PROMPT_TAIL)} AS prompt FROM ret""")
def rag_prompt(spark, d):
    return search.prompt(_found(spark, d), QUERY_TEXT)


_PREFIX = f"coalesce({_list(search.PREFIXES)}[{{0}}], '')"


@query(f"""WITH {_FOUND} SELECT string_agg({_PREFIX.format("citation_id")} || rtrim({_trunc("text")}, '.!?') || ' [' || citation_id || '].', ' ' ORDER BY citation_id) || ' Se devolvio respuesta local porque Ollama fallo: sin modelo Fuentes usadas: '
    || string_agg('[' || citation_id || '] ' || title, ', ' ORDER BY citation_id) || '.' AS answer FROM ret WHERE citation_id <= 3""")
def local_answer(spark, d):
    return search.local_answer(_found(spark, d), QUERY_TEXT, "sin  modelo")


@query(f"""WITH {_PASS}, {_SELECTED} SELECT (SELECT string_agg({_PREFIX.format("place")} || rtrim(passage, '.!?') || ' [' || citation_id || '].', ' ' ORDER BY place) FROM sel WHERE place <= 3)
    || ' Las fuentes principales consultadas fueron ' || (SELECT string_agg('[' || citation_id || '] ' || title, ', ' ORDER BY citation_id) FROM ret WHERE citation_id <= 3) || '.' AS answer""")
def extractive_answer(spark, d):
    return search.extractive_answer(_found(spark, d), QUERY_TEXT, QUERY, words)


def _run(spark, d) -> DataFrame:
    """(query_id, doc_id, rank, score): each system's documents of each query by their LSI score; the query's name begins with the system's."""
    named = F.concat_ws("|", "system", "query_id").alias("query_id")
    hits = table(spark, d, "search_results").groupBy(named, "doc_id").agg(F.max(F.when(~F.isnan("lsi_score"), F.col("lsi_score"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order))


def _relevant(spark, d) -> DataFrame:
    """Documents whose title matches the query, in place of judgements; the same for every system."""
    rows = table(spark, d, "search_results")
    hits = rows.where((F.col("system") == "tfidf+lsi") & ~F.isnan("title_match") & (F.col("title_match") >= 0.6)).select("query_id", "doc_id").distinct()
    systems = F.broadcast(rows.select("system").distinct())  # a few systems
    return hits.crossJoin(systems).select(F.concat_ws("|", "system", "query_id").alias("query_id"), "doc_id")


def _metrics(spark, d) -> DataFrame:
    """(system, query_id, metrics)"""
    rows = table(spark, d, "search_results")
    asked = rows.select("query_id").distinct().crossJoin(F.broadcast(rows.select("system").distinct())).select(F.concat_ws("|", "system", "query_id").alias("query_id"))  # a few systems
    per = evaluate.per_query(_run(spark, d), _relevant(spark, d), asked)
    return per.withColumn("system", F.substring_index("query_id", "|", 1)).withColumn("query_id", F.expr("substring(query_id, length(system) + 2)"))


def _of(per: DataFrame, system: str) -> DataFrame:
    return evaluate.summary(per.where(F.col("system") == system))


_RUNS = """runs AS (SELECT system, query_id, doc_id, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC NULLS LAST, doc_id) AS rank, score FROM
        (SELECT system, query_id, doc_id, max(CASE WHEN NOT isnan(lsi_score) THEN lsi_score END) AS score FROM search_results GROUP BY ALL)),
    hit AS (SELECT r.system, r.query_id, rank, CASE WHEN q.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM runs r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.doc_id = q.doc_id),
    sums AS (SELECT system, query_id, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) / 3.0 AS p3, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5.0 AS p5, sum(hit * seen / rank) AS s, sum(CASE WHEN rank <= 5 THEN hit / log2(rank + 1) ELSE 0 END) AS dcg
        FROM (SELECT *, sum(hit) OVER (PARTITION BY system, query_id ORDER BY rank) AS seen FROM hit) GROUP BY system, query_id),
    m AS (SELECT system, query_id, coalesce(p3, 0) AS p_at_3, coalesce(p5, 0) AS p_at_5, CASE WHEN n > 0 THEN coalesce(s, 0) / n ELSE 0 END AS ap,
        CASE WHEN n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, 5)), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_at_5
        FROM (SELECT * FROM (SELECT DISTINCT query_id FROM search_results), (SELECT DISTINCT system FROM search_results)) LEFT JOIN sums USING (system, query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id) USING (query_id))"""
_QRELS = "qrels AS (SELECT DISTINCT query_id, doc_id FROM search_results WHERE system = 'tfidf+lsi' AND NOT isnan(title_match) AND title_match >= 0.6)"
_ROUNDED = "round(p_at_3, 6) AS p_at_3, round(p_at_5, 6) AS p_at_5, round(ap, 6) AS ap, round(ndcg_at_5, 6) AS ndcg_at_5"
_MEANS = "avg(p_at_3) AS p_at_3, avg(p_at_5) AS p_at_5, avg(ap) AS map_score, avg(ndcg_at_5) AS ndcg_at_5"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_QRELS}, {_RUNS} SELECT system, query_id, {_ROUNDED} FROM m")
def eval_per_query(spark, d):
    return _rounded(_metrics(spark, d))


@query(f"WITH {_QRELS}, {_RUNS} SELECT system, round(avg(p_at_3), 6) AS p_at_3, round(avg(p_at_5), 6) AS p_at_5, round(avg(ap), 6) AS map_score, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM m GROUP BY system")
def eval_summary(spark, d):
    per = materialise(_metrics(spark, d), "metrics")
    systems = [r["system"] for r in table(spark, d, "search_results").select("system").distinct().collect()]  # a few systems
    return _rounded(reduce(DataFrame.unionByName, [_of(per, x).withColumn("system", F.lit(x)) for x in systems]))


@query(f"WITH {_QRELS}, {_RUNS}, a AS (SELECT {_MEANS} FROM m WHERE system = 'tfidf+lsi'), b AS (SELECT {_MEANS} FROM m WHERE system = 'tfidf+lsi+threshold+rerank') SELECT round(b.p_at_3 - a.p_at_3, 6) AS p_at_3, round(b.p_at_5 - a.p_at_5, 6) AS p_at_5, round(b.map_score - a.map_score, 6) AS map_score, round(b.ndcg_at_5 - a.ndcg_at_5, 6) AS ndcg_at_5 FROM a, b")
def eval_delta(spark, d):
    per = materialise(_metrics(spark, d), "metrics")
    return _rounded(evaluate.delta(_of(per, "tfidf+lsi"), _of(per, "tfidf+lsi+threshold+rerank")))


@query(f"""WITH {_QRELS}, {_RUNS} SELECT system, query_id, count(*) < 3 OR max(CASE WHEN rank = 1 THEN coalesce(score, 0) END) < 0.28 OR avg(CASE WHEN rank <= 3 THEN coalesce(score, 0) END) < 0.22 AS insufficient FROM runs GROUP BY system, query_id""")
def insufficiency(spark, d):
    told = evaluate.insufficient(_run(spark, d))
    return told.withColumn("system", F.substring_index("query_id", "|", 1)).withColumn("query_id", F.expr("substring(query_id, length(system) + 2)"))


_HOST = r"lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DOMAINS = ["rutas-palmar.example", "cayo-norte.example"]


@query("SELECT seq, regexp_replace(url, '#.*$', '') AS normalized FROM crawled_documents")
def url_normalize(spark, d):
    return table(spark, d, "crawled_documents").select("seq", web.normalised_url(F.col("url"), F.col("url")).alias("normalized"))


@query(f"SELECT seq, url FROM crawled_documents WHERE {' OR '.join(f'{_HOST.format(chr(117) + chr(114) + chr(108))} = ' + chr(39) + x + chr(39) + f' OR ends_with({_HOST.format(chr(117) + chr(114) + chr(108))}, ' + chr(39) + '.' + x + chr(39) + ')' for x in _DOMAINS)}")
def domain_filter(spark, d):
    return table(spark, d, "crawled_documents").where(web.in_domains(F.col("url"), _DOMAINS)).select("seq", "url")


@query(r"SELECT seq, regexp_matches(url, '(?i)^https?://') AND regexp_matches(url, '(?i)guia|blog|destinos') AND NOT regexp_matches(url, '(?i)\.pdf$|\.jpg$|\?p=') AS allowed FROM crawled_documents")
def url_allowed(spark, d):
    return table(spark, d, "crawled_documents").select("seq", web.allowed(F.col("url"), [], ["guia", "blog", "destinos"], [r"\.pdf$", r"\.jpg$", r"\?p="]).alias("allowed"))


@query("SELECT seq, sha1(url) AS made_id, sha1(url) = doc_id AS same FROM crawled_documents")
def doc_id_sha1(spark, d):
    return table(spark, d, "crawled_documents").select("seq", web.doc_id(F.col("url")).alias("made_id"), (web.doc_id(F.col("url")) == F.col("doc_id")).alias("same"))


def _decoded(text: str) -> str:
    for entity, sign in (("&#x27;", "''"), ("&#39;", "''"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{sign}')"
    return f"nullif(trim({text}), '')"


_OG = """regexp_extract(html, '<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)"""


@query(f"""SELECT raw_html_path, coalesce({_decoded(_OG)}, {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
    nullif(trim(regexp_extract(html, '<html[^>]*? lang="([^"]*)"', 1)), '') AS language FROM raw_pages""")
def html_title_lang(spark, d):
    return web.documents(table(spark, d, "raw_pages"), "raw_html_path").select("raw_html_path", "title", "language")


@query()
def extract_document(spark, d):
    return web.documents(table(spark, d, "raw_pages"), "raw_html_path")


_LD = r"""ld AS (SELECT raw_html_path, CASE WHEN json_valid(j) THEN j END AS j FROM (SELECT raw_html_path, regexp_extract(html, '(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>', 1) AS j FROM raw_pages))"""


def _linked(key: str) -> str:
    return f"nullif(trim(json_extract_string(j, '$.\"{key}\"')), '')"


@query(f"""WITH {_LD} SELECT raw_html_path, coalesce({_linked("name")}, {_decoded(_OG)}, {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS entity_name, {_linked("datePublished")} AS review_date,
    {_linked("ratingValue")} AS rating, {_linked("location")} AS location, coalesce({_linked("@type")}, 'web_page') AS content_type, '' AS tags FROM raw_pages JOIN ld USING (raw_html_path)""")
def jsonld_fields(spark, d):
    rows = web.documents(table(spark, d, "raw_pages"), "raw_html_path")
    return rows.select("raw_html_path", "entity_name", "review_date", "rating", "location", "content_type", F.array_join("tags", ",").alias("tags"))


@query(r"""SELECT DISTINCT 'https://pages.example/' || raw_html_path AS url, 'https://pages.example' || href AS link FROM (SELECT raw_html_path, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM raw_pages)""")
def extract_links(spark, d):
    pages = table(spark, d, "raw_pages").select(F.concat(F.lit("https://pages.example/"), F.col("raw_html_path")).alias("url"), "html")
    return web.links(pages, [])


@query("SELECT DISTINCT trim(url) AS url FROM crawled_documents WHERE trim(url) <> '' AND trim(url) NOT IN (SELECT url FROM crawl_errors WHERE url IS NOT NULL)")
def visited_antijoin(spark, d):
    return crawl.new_urls(table(spark, d, "crawled_documents").where("url is not null"), table(spark, d, "crawl_errors").where("url is not null"))


@query("SELECT doc_id, seq, title, word_count FROM (SELECT doc_id, seq, title, word_count, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n FROM crawled_documents WHERE doc_id IS NOT NULL) WHERE n = 1")
def dedup_last_wins(spark, d):
    return crawl.last_wins(table(spark, d, "crawled_documents").select("doc_id", "seq", "title", "word_count"), "doc_id", "seq").select("doc_id", "seq", "title", "word_count")


@query("""WITH docs AS (SELECT doc_id, title, summary FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n FROM crawled_documents) WHERE n = 1),
    hits AS (SELECT doc_id, min(query_text) AS title, max(list_pos) AS list_pos FROM search_results GROUP BY doc_id)
    SELECT h.doc_id, CASE WHEN d.doc_id IS NULL THEN h.title ELSE d.title END AS title, list_pos, summary FROM hits h LEFT JOIN docs d ON h.doc_id = d.doc_id""")
def merge_precedence(spark, d):
    documents = crawl.last_wins(table(spark, d, "crawled_documents").select("doc_id", "seq", "title", "summary"), "doc_id", "seq").drop("seq")
    hits = table(spark, d, "search_results").groupBy("doc_id").agg(F.min("query_text").alias("title"), F.max("list_pos").alias("list_pos"))
    return crawl.fill_absent(documents, hits)


@query("SELECT arg_max(system, run_id) AS path FROM (SELECT run_id, refined.system AS system FROM rec01_eval_report)")
def latest_run(spark, d):
    return crawl.latest_run(table(spark, d, "rec01_eval_report").select("run_id", F.col("refined.system").alias("path")))


@query("SELECT 'review_text' AS text_column")
def guess_text_column(spark, d):
    from lumbre.sources.readers import text_column

    return spark.createDataFrame([(text_column(table(spark, d, "new_york_hotels_reviews")),)], "text_column string")


@query("SELECT string_agg(name, chr(10) ORDER BY key) AS text FROM (SELECT n_nationkey AS key, n_name AS name FROM nation)")
def concat_column(spark, d):
    from lumbre.sources.readers import joined_column

    return joined_column(table(spark, d, "nation"), "n_name", "n_nationkey")


def _leaves(side: str) -> str:
    return f"{side}.system || chr(10) || array_to_string(list_transform({side}.queries, lambda q: q.query_id || chr(10) || q.query_text || chr(10) || array_to_string(q.retrieved_doc_ids, chr(10))), chr(10))"


@query(f"SELECT run_id, {_leaves('baseline')} || chr(10) || {_leaves('refined')} AS text FROM rec01_eval_report")
def json_string_leaves(spark, d):
    from lumbre.sources.readers import json_text

    return table(spark, d, "rec01_eval_report").select("run_id", json_text(F.to_json(F.struct("baseline", "refined"))).alias("text"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'dataset') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slugify(F.col("p_name")).alias("slug"))


@query("SELECT event_id, printf('%.4f', round(value * 100) / 800 + 0.00001) AS shown FROM events")
def score_format(spark, d):
    return table(spark, d, "events").select("event_id", T.four_places(F.round(F.col("value") * 100) / 800 + F.lit(0.00001)).alias("shown"))


@query("""WITH seen AS (SELECT url, arg_min(depth, seq) AS depth, 'document' AS status FROM crawled_documents WHERE url IS NOT NULL GROUP BY url
        UNION ALL SELECT url, max(depth), min(CASE WHEN reason = 'policy' THEN 'policy' WHEN reason = 'http_error' THEN 'http_error' ELSE 'error' END) FROM crawl_errors WHERE url IS NOT NULL GROUP BY url),
    links AS (SELECT DISTINCT parent_url AS url, url AS link FROM crawled_documents WHERE parent_url IS NOT NULL AND url IS NOT NULL),
    d AS (SELECT count(*) AS n, count(DISTINCT link) AS m FROM links WHERE url IN (SELECT url FROM seen WHERE status = 'document'))
    SELECT count(*) FILTER (depth = 0) AS seed_urls, count(*) FILTER (status <> 'policy') AS urls_visited, count(*) FILTER (status = 'document') AS pages_fetched, count(*) FILTER (status = 'document') AS documents_saved,
        (SELECT n FROM d) AS links_discovered, count(*) FILTER (depth > 0) AS links_enqueued, count(*) FILTER (status IN ('error', 'http_error')) AS errors, count(*) FILTER (status = 'policy') AS skipped_policy,
        0::BIGINT AS skipped_robots, 0::BIGINT AS skipped_non_html, (SELECT n - m FROM d) AS skipped_duplicate, 0::BIGINT AS skipped_persisted FROM seen""")
def crawl_counters(spark, d):
    """The counters over what was crawled and what failed."""
    made = table(spark, d, "crawled_documents").where("url is not null")
    seen = made.groupBy("url").agg(F.min_by("depth", "seq").alias("depth"), F.lit("document").alias("status"))
    reason = F.when(F.col("reason") == "policy", "policy").when(F.col("reason") == "http_error", "http_error").otherwise("error")
    failed = table(spark, d, "crawl_errors").where("url is not null").groupBy("url").agg(F.max("depth").alias("depth"), F.min(reason).alias("status"))
    links = made.where("parent_url is not null").select(F.col("parent_url").alias("url"), F.col("url").alias("link")).distinct()
    return crawl.counters(seen.unionByName(failed), links)


def _model(spark, d, k: int = 10) -> tuple[lsi.Model, DataFrame, DataFrame, DataFrame]:
    """The model over the stems of all documents, the documents, their weights, and the frequencies for queries."""
    rows = stemmed_docs(spark, d)
    weights = materialise(index.tfidf(rows), "weights")
    return lsi.train(weights, k), rows, weights, index.idf_table(index.term_frequencies(rows), rows)


@query()
def lsi_singular_values(spark, d):
    model, _, weights, _ = _model(spark, d)
    shares = lsi.explained_variance_ratio(weights, model)
    rows = [(i, s, v) for i, (s, v) in enumerate(zip(model.singular_values, shares))]
    return spark.createDataFrame(rows, "component int, singular_value double, explained_variance_ratio double")


@query()
def lsi_doc_vectors(spark, d):
    return _model(spark, d)[0].documents


def _lsi_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    model, rows, _, idfs = _model(spark, d)
    return lsi.scores(index.query_vector(STEMS, idfs), model).withColumnRenamed("lsi_score", "score"), rows


@query()
def lsi_search(spark, d):
    scored, _ = _lsi_scores(spark, d)
    return index.top(scored, 10)


@query()
def lsi_refined_search(spark, d):
    scored, rows = _lsi_scores(spark, d)
    pool = index.top(scored, search.POOL).select("doc_id", F.col("score").alias("lsi"))
    given = F.array(*map(F.lit, STEMS))
    both = rows.join(F.broadcast(pool), "doc_id")  # at most the pool
    content, title = search.overlap(given, F.array_union("tokens", "title_tokens")), search.overlap(given, F.col("title_tokens"))
    score = search.rerank_score(F.col("lsi"), content, title, T.word_count(F.col("text")))
    snippet = search.best_snippet(F.lit(None).cast("string"), F.col("text"), F.array(*map(F.lit, QUERY)), words)
    found = both.select("doc_id", F.round(score, 6).alias("score"), "lsi", F.round(content, 6).alias("lexical_overlap"), F.round(title, 6).alias("title_match"), "title", snippet.alias("snippet"))
    return search.above_threshold(found, 10)


@query(f"WITH {_CHUNK} SELECT doc_id, no::INT AS chunk_no, length(ws[no * 90 + 1 : no * 90 + 120])::INT AS n_words FROM c")
def incremental_ingest(spark, d):
    """The chunk table after two runs of the stream over a growing folder."""
    import uuid

    from lumbre.plans.tables import shared_dir
    from lumbre.streaming.ingest import ingest

    root = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("doc_id", "text")
    for half in (0, 1):
        rows.where(F.pmod("doc_id", F.lit(2)) == half).write.mode("append").parquet(f"{root}/in")
        ingest(spark, f"{root}/in", "doc_id long, text string", f"{root}/out", f"{root}/log")
    return spark.read.parquet(f"{root}/out").select("doc_id", "chunk_no", "n_words")


_GRAPH = [("https://a.example/", '<a href="/b">b</a> <a href="c">c</a> <a href="/b#x">b</a> <a href="mailto:x@a.example">m</a>'), ("https://a.example/b", '<a href="/">home</a> <a href="/d">d</a> <a href="https://other.example/">o</a>'), ("https://a.example/c", '<a href="/d">d</a> <a href="/file.pdf">f</a> <a href="/gone">g</a>'), ("https://a.example/d", '<a href="/e">e</a>'), ("https://a.example/e", '<a href="/f">f</a>')]


@query("SELECT * FROM (VALUES ('https://a.example/', 0, 'document'), ('https://a.example/b', 1, 'document'), ('https://a.example/c', 1, 'document'), ('https://a.example/d', 2, 'document'), ('https://a.example/gone', 2, 'error')) t(url, depth, status)")
def crawl_frontier(spark, d):
    pages = spark.createDataFrame(_GRAPH, "url string, html string")
    return crawl.crawl(pages, ["https://a.example/"], ["a.example"]).select("url", "depth", "status")
