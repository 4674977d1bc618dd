"""Languages of documents and of the segments of mixed texts (problem 2).

Script ranges narrow the candidates of each word; words in Latin script get a score for each of six languages from a model fitted on labelled rows;
a Viterbi pass over the words, with a penalty for switching that is lower at the start of a sentence, labels the spans. All texts of an Arrow batch
take each step together.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumbre.llm.words import FUNCTION_WORDS

LANGUAGES = ["de", "en", "es", "fr", "it", "pt"]
#: Labelled rows on which the word scores are fitted, about; the only bound on input, all rows are labelled.
SAMPLE = 10_000
#: Log-odds that a switch costs at the start of a sentence and within one.
SWITCH_SENTENCE, SWITCH_WORD = 4.0, 12.0
#: A word's score is cut to this many nats between its best and worst language; a capital within a sentence (a name) counts this part.
MOST, NAME = 6.0, 0.2
#: Words of a full sentence at least.
FULL = 3

#: Scripts outside Latin, as code point ranges, and the language they stand for.
SCRIPTS = [("ru", "Ѐ-ԯ"), ("el", "Ͱ-Ͽἀ-῿"), ("ar", "؀-ۿݐ-ݿ"), ("he", "֐-׿"), ("hi", "ऀ-ॿ"), ("th", "฀-๿"), ("ja", "぀-ヿ"), ("ko", "가-힯"), ("zh", "㐀-鿿")]
#: Names of the languages and their three-letter codes.
LABELS = {
    "de": "de deu ger german deutsch aleman allemand tedesco alemao",
    "en": "en eng english ingles anglais inglese englisch",
    "es": "es spa esp spanish espanol castellano castilian espagnol spagnolo espanhol spanisch",
    "fr": "fr fra fre french francais frances francese franzosisch",
    "it": "it ita italian italiano italien italienisch",
    "pt": "pt por portuguese portugues portugais portoghese portugiesisch",
    "ca": "ca cat catalan",
    "nl": "nl nld dut dutch",
    "ru": "ru rus russian",
    "zh": "zh zho chi chinese",
    "ja": "ja jpn japanese",
}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^\n.!?…]*(?:[.!?…]+(?![\s\"'»”’)]|$)[^\n.!?…]*)*(?:[.!?…]+[\"'»”’)]*|\n|$)", re.M)
_OTHER = [(code, re.compile(f"[{chars}]")) for code, chars in SCRIPTS]
_NON_LATIN = re.compile("[" + "".join(chars for _, chars in SCRIPTS) + "]")


def bare(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def label_code(label: Column) -> Column:
    """The language a label names in any usual notation (code, code with a region, name); null where it names none."""
    plain = F.lower(F.trim(F.translate(label, "áàâãäåçéèêëíìîïñóòôõöúùûüÁÀÂÃÇÉÊÍÑÓÔÕÖÚÜ", "aaaaaaceeeeiiiinooooouuuuAAAACEEINOOOOUU")))
    first = F.regexp_extract(plain, r"^[\[(\"']*([a-z]+)", 1)
    known = F.lit(None).cast("string")
    for code, names in LABELS.items():
        known = F.when(first.isin(names.split()), F.lit(code)).otherwise(known)
    return known


class Model:
    """Scores of words: known ones by their counts, others by their letter groups."""

    def __init__(self, counts: dict[str, list[float]]):
        for code, words in FUNCTION_WORDS.items():
            for w in words.split():
                counts.setdefault(w, [0.0] * len(LANGUAGES))[LANGUAGES.index(code)] += 1
        table = np.array(list(counts.values()), dtype=float).reshape(-1, len(LANGUAGES))
        share = table / np.maximum(table.sum(0), 1)
        floor = 0.05 / np.maximum(table.sum(0), 1)
        self.words = dict(zip(counts, self._centred(np.log(share * 0.98 + share.mean(1, keepdims=True) * 0.02 + floor.mean()))))
        grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for w, row in zip(counts, np.log1p(table)):
            for g in self._grams(w):
                grams[g] += row
        total = np.maximum(sum(grams.values(), np.zeros(len(LANGUAGES))), 1)
        self.grams = {g: self._centred(np.log((v + 0.5) / total)) for g, v in grams.items()}
        self.cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _centred(x: np.ndarray) -> np.ndarray:
        return np.maximum(x - x.max(-1, keepdims=True), -MOST).astype(np.float32)

    @staticmethod
    def _grams(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    def score(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is None:
            known = self.words.get(bare(word))
        if known is not None:
            return known
        got = [self.grams[g] for g in self._grams(word) if g in self.grams]
        return self._centred(np.sum(got, 0) * 0.35) if got else np.zeros(len(LANGUAGES), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        for w in set(words):
            if w not in cache:
                cache[w] = self.score(w)
        return np.array([cache[w] for w in words], dtype=np.float32).reshape(-1, len(LANGUAGES))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Word counts of about ``sample`` labelled rows, chosen by a hash of their key; the counts, bounded by the sample, come to the driver."""
    rows = labelled.select(F.col(key), F.col(text).alias("text"), label_code(F.col(lang)).alias("lang")).where(F.col("lang").isin(LANGUAGES) & F.col("text").isNotNull())
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, n))) < sample)
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''")
    counts = words.groupBy("word").agg(*[F.count_if(F.col("lang") == code).alias(code) for code in LANGUAGES])
    table: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(LANGUAGES))
    for r in counts.where(sum((F.col(c) for c in LANGUAGES[1:]), F.col(LANGUAGES[0])) >= 3).toLocalIterator():
        row = [float(r[c]) for c in LANGUAGES]
        for w in {r["word"], bare(r["word"])}:
            table[w] = [a + b for a, b in zip(table[w], row)]
    return Model(dict(table))


def viterbi(scores: np.ndarray, penalty: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best state of each word. Texts lie one after another in ``scores`` (words × states); penalty: what a switch before each word costs."""
    n, k = scores.shape
    path = np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    live = int((sizes > 0).sum())
    if not live:
        return path
    from_ = np.empty(n, dtype=np.int64)  # the state switched from, if that was better
    stay = np.empty((n, k), dtype=bool)
    value = scores[starts[:live]].astype(np.float64)
    last = {}
    for t in range(1, int(sizes[0]) + 1):
        now = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t words
        if now < live:
            last[t] = (starts[now:live] + sizes[now:live] - 1, value[now:live].argmax(1))
            live, value = now, value[:now]
        if not live:
            break
        at = starts[:live] + t
        best = value.argmax(1)
        switched = value[np.arange(live), best] - penalty[at]
        keep = value >= switched[:, None]
        from_[at], stay[at] = best, keep
        value = np.where(keep, value, switched[:, None]) + scores[at]
    for rows, states in last.values():
        path[rows] = states
    for t in range(int(sizes[0]) - 1, 0, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = starts[:live] + t
        state = path[at]
        path[at - 1] = np.where(stay[at, state], state, from_[at])
    return path


def label_batch(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float, bool]]]:
    """For each text its segments: (start, end, language, confidence, whether it holds a full sentence); text offsets are code points."""
    words, weight, penalty, spans, sentences, lengths = [], [], [], [], [], []
    extra = any(t and not t.isascii() and _NON_LATIN.search(t) for t in texts)
    for text in texts:
        before = len(words)
        if text:
            lower, caps = text.lower(), text.isupper()
            if len(lower) != len(text):  # a few capitals lengthen
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for m in _SENTENCE.finditer(text):
                if m.end() == m.start():
                    continue
                first = True
                found = [(w.start(), w.end()) for w in _WORD.finditer(lower, m.start(), m.end())]
                if not found:
                    continue
                ended = text[m.start() : m.end()].rstrip("\"'»”’) \n")[-1:] in tuple(".!?…")
                sentences.append((len(words), len(words) + len(found), ended and len(found) >= FULL))
                for a, b in found:
                    words.append(lower[a:b])
                    weight.append(1.0 if first or caps or not text[a].isupper() else NAME)
                    penalty.append(SWITCH_SENTENCE if first else SWITCH_WORD)
                    spans.append((a, b))
                    first = False
        lengths.append(len(words) - before)
    states = LANGUAGES + ([code for code, _ in SCRIPTS] if extra else [])
    if not words:
        return [[] for _ in texts]
    scores = model.scores(words) * np.array(weight, dtype=np.float32)[:, None]
    if extra:
        wide = np.full((len(words), len(states)), -3 * MOST, dtype=np.float32)
        wide[:, : len(LANGUAGES)] = scores
        for i, w in enumerate(words):
            if not w.isascii() and _NON_LATIN.search(w):
                wide[i, : len(LANGUAGES)] = -3 * MOST
                for s, (_, chars) in enumerate(_OTHER):
                    if chars.search(w):
                        wide[i, len(LANGUAGES) + s] = 0
        scores = wide
    size = np.array(lengths)
    path = viterbi(scores, np.array(penalty), size)
    total = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores, 0, dtype=np.float64)])
    first_word = np.cumsum(size) - size
    full = np.zeros(len(words), dtype=bool)
    for a, b, is_full in sentences:
        if is_full:
            major = int(np.bincount(path[a:b], minlength=len(states)).argmax())
            if (path[a:b] == major).mean() > 0.8:
                full[a + int(np.argmax(path[a:b] == major))] = True
    out = []
    for start, n in zip(first_word, size):
        if not n:
            out.append([])
            continue
        own = path[start : start + n]
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), int(n)]
        any_full = bool(full[start : start + n].any())
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            lo, hi, state = start + a, start + b, int(own[a])
            odds = total[hi] - total[lo]
            odds = odds - odds.max()
            posterior = math.exp(odds[state]) / float(np.exp(odds).sum())
            whole = bool(full[lo:hi].any()) or not any_full  # a text without any full sentence is taken as one
            rows.append((spans[lo][0], spans[hi - 1][1], states[state], posterior, whole))
        out.append(rows)
    return out


SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double,full:boolean>>"


def segments(texts: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``texts`` but ``text``, and ``segments``: runs of one language with their offsets, confidence (0 to 1) and whether they hold a full sentence.

    Null and empty texts, and texts without letters, have no segments. A text in which no sentence is full counts as one sentence. Texts of any length are taken whole.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on
    keys = [f for f in texts.schema.fields if f.name != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("start", "end", "lang", "confidence", "full")
        for rows in batches:
            got = label_batch(rows[text].tolist(), shared.value)
            out = rows.drop(columns=[text])
            out["segments"] = [[dict(zip(names, s)) for s in one] for one in got]
            yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), f"segments {SEGMENTS}"])
    return texts.mapInPandas(run, schema)


def languages(labelled: DataFrame) -> DataFrame:
    """``labelled`` (with segments) and ``langs``: the languages of at least one full sentence, and ``main``, that of most text, with ``confidence`` as its share."""
    spoken = F.array_sort(F.array_distinct(F.transform(F.filter("segments", lambda s: s["full"]), lambda s: s["lang"])))
    length = lambda code: F.aggregate(F.filter("segments", lambda s: s["lang"] == code), F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]) * s["confidence"])
    rows = labelled.withColumn("langs", spoken)
    sums = F.transform("langs", lambda c: F.struct(length(c).alias("n"), c.alias("lang")))
    whole = F.aggregate("segments", F.lit(0.0), lambda a, s: a + (s["end"] - s["start"]))
    best = F.array_max(sums)
    return rows.withColumn("main", best["lang"]).withColumn("confidence", F.try_divide(best["n"], whole))
