import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lumbre.functions import text as T
from lumbre.functions.stem import porter, snowball_spanish, stems

SPANISH = """visitarcuba:visitarcub playa:play perla:perl blanca:blanc cayo:cay santa:sant maria:mari request:request exception:exception connection:connection
aborted:abort remotedisconnected:remotedisconnect remote:remot end:end closed:clos without:without response:respons cuba:cub turismo:turism viaje:viaj
destino:destin vacaciones:vacacion hotel:hotel ciudad:ciud lugar:lug"""
ENGLISH = "services:servic beautiful:beauti poor:poor resort:resort views:view relational:relat caresses:caress ponies:poni hopping:hop happy:happi dying:die falling:fall agreed:agre"


@pytest.mark.parametrize("pair", SPANISH.split())
def test_spanish_stems(pair):
    word, want = pair.split(":")
    assert snowball_spanish(word) == want


@pytest.mark.parametrize("pair", ENGLISH.split())
def test_english_stems(pair):
    word, want = pair.split(":")
    assert porter(word) == want


def test_stems_of_distinct_terms(spark):
    terms = spark.createDataFrame([("spanish", "playas"), ("spanish", "playas"), ("english", "views"), ("english", None)], "language string, term string")
    assert sorted(map(tuple, stems(terms).collect())) == [("english", "views", "view"), ("spanish", "playas", "play")]


TEXTS = ["<b>Habitación</b> con  niños &amp; más", "don’t 'stop' 24h", None, "", "ÀÉÎ-õü\tx", "a" * 50_000 + " ñ", "1 < 2 > 0"]


def _brute(text, accents=False, entities=False):
    text = text or ""
    if entities:
        text = html.unescape(text)
    text = re.sub("[’‘']", "", re.sub("<[^>]+>", " ", text))
    if not accents:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z\s]+", " ", text.lower()).split())


@pytest.mark.parametrize("accents", [False, True])
@pytest.mark.parametrize("entities", [False, True])
def test_clean(spark, accents, entities):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(T.clean(F.col("t"), accents, entities)).collect()]
    assert got == [_brute(t, accents, entities) for t in TEXTS]


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        T.slugify(F.lit(" Hoteles de Cuba! ")), T.slugify(F.lit("--")), T.truncate(F.lit("x" * 281)), T.truncate(F.lit(None).cast("string")), T.short_error(F.lit(" ")), T.cited(F.lit("• Es así!"), F.lit(2)),
        T.word_count(F.lit("  a b\nc ")), T.word_count(F.lit(" ")), T.language_name(F.lit(" ESP ")), T.language_name(F.lit("Español")), T.language_name(F.lit(None).cast("string")), T.four_places(F.lit(0.12346)),
    ).first()
    assert list(got) == ["hoteles_de_cuba", "dataset", "x" * 277 + "...", "", "sin detalle", "Es así [2].", 3, 0, "esp", "spanish", "english", "0.1235"]


def test_stopwords_keep_repeats(spark):
    df = spark.createDataFrame([(["la", "playa", "playa", "the"],)], "w array<string>")
    got = df.select(T.without_stopwords(F.col("w"), F.lit("spanish")), T.without_stopwords(F.col("w"), F.lit("english")), T.without_stopwords(F.col("w"), F.lit("klingon"))).first()
    assert list(got) == [["playa", "playa", "the"], ["la", "playa", "playa"], ["la", "playa", "playa", "the"]]
