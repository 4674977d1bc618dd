"""Text functions as column expressions: cleaning, tokens, stop words, cuts and labels."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Stop words in lower case and without accents.
STOPWORDS = {
    "english": """a about above after again against all am an and any are as at be because been before being below between both but by can could did
        do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its
        itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such
        than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where
        which while who whom why will with you your yours yourself yourselves""".split(),
    "spanish": """a al algo algunas algunos ante antes como con contra cual cuales cualquier cuando de del desde donde dos el ella ellas ellos en entre
        era erais eran eras eres es esa esas ese eses eso esos esta estaba estabais estaban estabas estad estada estadas estado estados estais
        estamos estan estando estar estaremos estara estaran estaras estare estareis estaria estariais estarian estarias estas este estemos esto
        estos estoy fue fuera fuerais fueran fueras fueron fui fuimos fuiste fuisteis ha habeis habia habiais habian habias habida habidas habido
        habidos habiendo habla hablan haber hace hacen hacia haciendo han has hasta hay la las le les lo los mas me mi mis mucho muy no nos nosotros
        nuestra nuestras nuestro nuestros o os otra otras otro otros para pero poco por porque que quien quienes se sea sean ser si sin sobre sois
        somos son soy su sus tambien te teneis tenemos tener tengo ti tiene tienen toda todas todo todos tu tus un una uno unos unas usted ustedes
        vosotros vuestra vuestras vuestro vuestros y ya""".split(),
}
#: What a language may be called.
ALIASES = {"english": "en eng english ingles ing".split(), "spanish": "es spa spanish espanol español".split()}

_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŠšŽž"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyySsZz"


@F.pandas_udf(StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", "")


def clean(text: Column, accents: bool = False, entities: bool = False) -> Column:
    """Words of the letters a to z in lower case, one space apart; '' for null.

    Tags become spaces and apostrophes vanish. With ``accents`` kept, accented letters become spaces as all else does. ``entities`` decodes HTML entities
    first: texts that may hold one, and only these, pass through a Python worker. It can't be used within a lambda.
    """
    out = F.coalesce(text.cast("string"), F.lit(""))
    if entities:
        held = out.rlike(r"&#?\w")
        out = F.when(held, _unescape(F.when(held, out))).otherwise(out)
    out = F.when(F.contains(out, F.lit("<")), F.regexp_replace(out, "<[^>]+>", " ")).otherwise(out)
    # One pass replaces accented letters and drops apostrophes.
    out = F.translate(out, "’‘'", "") if accents else F.regexp_replace(F.translate(out, _ACCENTED + "’‘'", _PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(out), "[^a-z]+", " "))


def tokens(cleaned: Column, least: int = 2) -> Column:
    """Words of a cleaned text with at least ``least`` letters."""
    return F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= least)


def language_name(label: Column) -> Column:
    """``english`` or ``spanish`` for their aliases, english for a blank label, else the label in lower case."""
    plain = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(plain == "", "english").when(plain.isin(ALIASES["english"]), "english").when(plain.isin(ALIASES["spanish"]), "spanish").otherwise(plain)


def without_stopwords(words: Column, language: Column) -> Column:
    """The words that aren't stop words of the language; repeats stay, other languages have no stop words."""
    keep = lambda name: F.filter(words, lambda w: ~w.isin(STOPWORDS[name]))
    return F.when(language == "english", keep("english")).when(language == "spanish", keep("spanish")).otherwise(words)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze_bullets(text: Column) -> Column:
    """``squeeze``, then without dashes, bullets and spaces at both ends."""
    return F.btrim(squeeze(text), F.lit("-• "))


def truncate(text: Column, limit: int = 280) -> Column:
    """A squeezed text, cut to ``limit`` characters with an ellipsis if longer."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def short_error(text: Column, limit: int = 220) -> Column:
    flat = squeeze(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit)), F.when(F.length(flat) > limit, "...").otherwise(""))
    return F.when(flat == "", "sin detalle").otherwise(cut)


def cited(text: Column, number: Column) -> Column:
    """A statement without its end mark and with its citation."""
    return F.concat(F.rtrim(squeeze_bullets(text), F.lit(".!?")), F.lit(" ["), number.cast("string"), F.lit("]."))


def slugify(name: Column) -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("dataset"))


def safe_text(value: Column) -> Column:
    """Trimmed text, null where blank."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def word_count(text: Column) -> Column:
    flat = squeeze(F.coalesce(text, F.lit("")))
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def four_places(score: Column) -> Column:
    return F.format_string("%.4f", score)


def column_name(name: str) -> str:
    return "_".join(name.replace("﻿", "").strip().lower().split())
