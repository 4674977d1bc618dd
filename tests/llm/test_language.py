"""Languages of documents and segments (2)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.llm import language

SAMPLES = {
    "en": "The old harbour is quiet in the morning and the boats leave before noon. We would come back with the children.",
    "es": "El puerto viejo es tranquilo por la mañana y los barcos salen antes del mediodía. Volveríamos con los niños.",
    "fr": "Le vieux port est calme le matin et les bateaux partent avant midi. Nous reviendrons avec les enfants.",
    "de": "Der alte Hafen ist am Morgen ruhig und die Boote fahren vor dem Mittag ab. Wir kommen mit den Kindern wieder.",
    "it": "Il vecchio porto è tranquillo la mattina e le barche partono prima di mezzogiorno. Torneremo con i bambini.",
    "pt": "O porto velho é tranquilo pela manhã e os barcos saem antes do meio-dia. Voltaremos com as crianças.",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, code) for i, (code, t) in enumerate(SAMPLES.items())]
    return language.fit(spark.createDataFrame(rows * 5, "doc_id long, text string, lang string"))


def _langs(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    return [r for r in language.languages(language.segments(df, model)).orderBy("key").collect()]


@pytest.mark.parametrize("code", SAMPLES)
def test_one_language(spark, model, code):
    row = _langs(spark, model, [SAMPLES[code]])[0]
    assert row.langs == [code] == [row.main] and row.confidence > 0.9
    assert _langs(spark, model, [SAMPLES[code].upper()])[0].langs == [code]


def test_mixed_text_and_offsets(spark, model):
    text = SAMPLES["en"] + " " + SAMPLES["fr"] + "\n" + SAMPLES["de"]
    row = _langs(spark, model, [text])[0]
    assert row.langs == ["de", "en", "fr"] and [s.lang for s in row.segments] == ["en", "fr", "de"]
    assert [text[s.start : s.end].split()[0] for s in row.segments] == ["The", "Le", "Der"]


def test_odd_texts(spark, model):
    rows = _langs(spark, model, [None, "", "12 !?", "Привет, как дела сегодня?", "今日はいい天気ですね。", SAMPLES["es"] + " Привет, как дела сегодня?", (SAMPLES["it"] + " ") * 3000, "İİİ ßß the and"])
    assert [r.langs for r in rows[:3]] == [[], [], []] and rows[0].main is None
    assert rows[3].langs == ["ru"] and rows[4].langs[0] in ("ja", "zh") and rows[5].langs == ["es", "ru"] and rows[6].langs == ["it"] and rows[7].langs == ["en"]
    assert _langs(spark, model, ["x"])[0].segments is not None and language.segments(spark.createDataFrame([], "key long, text string"), model).count() == 0


@pytest.mark.parametrize("label, code", [("es", "es"), ("es-CU", "es"), ("ES_es", "es"), (" Spanish ", "es"), ("Español", "es"), ("eng", "en"), ("pt-BR", "pt"), ("und", None), ("x-default", None), ("", None), (None, None), ("Deutsch", "de")])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(language.label_code(F.col("x"))).first()[0] == code


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 0, 1, 5, 3])
    scores, penalty = rng.normal(size=(lengths.sum(), 3)) * 2, rng.uniform(0.5, 2, lengths.sum())
    got, start = language.viterbi(scores.copy(), penalty, lengths), 0
    for n in lengths:
        own, pen = scores[start : start + n], penalty[start : start + n]
        value = lambda p: sum(own[i, s] for i, s in enumerate(p)) - sum(pen[i] for i in range(1, len(p)) if p[i] != p[i - 1])
        paths = [[]]
        for _ in range(n):
            paths = [[*p, s] for p in paths for s in range(3)]
        assert value(got[start : start + n]) == pytest.approx(max(map(value, paths)))
        start += n
