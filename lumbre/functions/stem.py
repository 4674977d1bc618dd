"""Stemmers for English (Porter's, with its later extensions) and Spanish (Snowball), written from the published algorithms.

They run over distinct terms, which are far fewer than tokens, and the stems are joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    if w[i] in _VOWELS:
        return False
    return w[i] != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) >= 3 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1):
        return w[-1] not in "wxy"
    return len(w) == 2 and not _consonant(w, 0) and _consonant(w, 1)


#: Words whose stem is given, and the suffixes of steps 2 to 4 with what replaces them.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in text.split()), key=lambda x: -len(x[0]))


_STEP2, _STEP3, _STEP4 = _table(STEP2), _table(STEP3), sorted(STEP4.split(), key=lambda x: -len(x))


def porter(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-3] + ("ie" if len(w) == 4 else "i")
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    for end, new in _STEP2:
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("logi") and _measure(w[:-3]) > 0:
            w = w[:-1]
    for end, new in _STEP3:
        if w.endswith(end):
            if _measure(w[: -len(end)]) > 0:
                w = w[: -len(end)] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root[-1:] in ("s", "t")):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _cvc(root)):
            w = root
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


_ES_VOWELS = frozenset("aeiouáéíóúü")
#: The suffixes of the Spanish steps.
ES_PRONOUNS = "selas selos sela selo las les los nos me se la le lo".split()
ES_BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir yendo".split()
ES_STEP1 = {
    "": "amientos imientos amiento imiento anzas ismos ables ibles istas acion anza icos icas ismo able ible ista osos osas oso osa ico ica".split(),
    "ic": "adoras adores aciones ancias adora ador ación ante antes ancia".split(),
    "log": "logía logías".split(),
    "u": "ución uciones".split(),
    "ente": "encia encias".split(),
}
ES_YVERB = "yeron yendo yamos yais yan yen yas yes ya ye yo yó".split()
ES_VERB_FREE = """aríamos eríamos iríamos iéramos iésemos aríais aremos eríais eremos iríais iremos ierais ieseis asteis isteis ábamos áramos ásemos arían arías
    aréis erían erías eréis irían irías iréis ieran iesen ieron iendo ieras ieses abais arais aseis íamos arán arás aría erán erás ería irán irás iría iera
    iese aste iste aban aran asen aron ando abas adas idas aras ases íais ados idos amos imos ará aré erá eré irá iré aba ada ida ara ase ían ado ido ías áis
    ía ad ed id an ió ar er ir as ís""".split()
ES_VERB_GU = "en es éis emos".split()
ES_RESIDUAL, ES_RESIDUAL_GU = "os a o á í ó".split(), "e é".split()


def _regions(w: str) -> tuple[int, int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _ES_VOWELS and w[i - 1] in _ES_VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    r2 = after(r1) if r1 < len(w) else len(w)
    rv = len(w)
    if len(w) >= 2:
        if w[1] not in _ES_VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _ES_VOWELS), len(w))
        elif w[0] in _ES_VOWELS:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _ES_VOWELS), len(w))
        else:
            rv = 3
    return min(rv, len(w)), r1, r2


def _longest(w: str, ends: list[str], start: int = 0) -> str | None:
    """The longest ending of ``w`` that lies behind ``start``."""
    fit = [e for e in ends if w.endswith(e) and len(w) - len(e) >= start]
    return max(fit, key=len) if fit else None


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áéíóú", "aeiou"))


def snowball_spanish(word: str) -> str:
    w = word.lower()
    rv, r1, r2 = _regions(w)
    end = _longest(w, ES_PRONOUNS, rv)
    if end:
        root = w[: -len(end)]
        before = _longest(root, ES_BEFORE_PRONOUN, rv)
        if before and (before != "yendo" or root[: -len(before)].endswith("u")):
            w = root[: -len(before)] + _plain(before)
    start = w
    w = _step1(w, r1, r2)
    if w == start:
        w = _verb(w, rv)
    end = _longest(w, ES_RESIDUAL, rv)
    if end:
        w = w[: -len(end)]
    else:
        end = _longest(w, ES_RESIDUAL_GU, rv)
        if end:
            w = w[: -len(end)]
            if w.endswith("gu") and len(w) - 1 >= rv:
                w = w[:-1]
    return _plain(w)


def _step1(w: str, r1: int, r2: int) -> str:
    every = [e for ends in ES_STEP1.values() for e in ends] + ["amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    end = _longest(w, every)
    if end is None:
        return w
    root = w[: -len(end)]
    inside = lambda part: root.endswith(part) and len(root) - len(part) >= r2
    if end == "amente":
        if len(root) < r1:
            return w
        for part in ("ativ", "iv", "os", "ic", "ad"):
            if inside(part):
                return root[: -len(part)]
        return root
    if len(root) < r2:
        return w
    if end in ES_STEP1["log"]:
        return root + "log"
    if end in ES_STEP1["u"]:
        return root + "u"
    if end in ES_STEP1["ente"]:
        return root + "ente"
    if end in ES_STEP1["ic"]:
        return root[:-2] if inside("ic") else root
    if end == "mente":
        return next((root[: -len(p)] for p in ("ante", "able", "ible") if inside(p)), root)
    if end in ("idad", "idades"):
        return next((root[: -len(p)] for p in ("abil", "ic", "iv") if inside(p)), root)
    if end in ("iva", "ivo", "ivas", "ivos"):
        return root[:-2] if inside("at") else root
    return root


def _verb(w: str, rv: int) -> str:
    end = _longest(w, ES_YVERB, rv)
    if end and w[: -len(end)].endswith("u"):
        return w[: -len(end)]
    end = _longest(w, ES_VERB_FREE + ES_VERB_GU, rv)
    if end is None:
        return w
    root = w[: -len(end)]
    if end in ES_VERB_GU and root.endswith("gu"):
        return root[:-1]
    return root


def stem(word: str, language: str) -> str:
    return snowball_spanish(word) if language == "spanish" else porter(word)


def stems(terms: DataFrame) -> DataFrame:
    """(language, term, stem) for distinct (language, term)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(stem=[stem(t, lang) for t, lang in zip(rows["term"], rows["language"])])

    return terms.select("language", "term").where(F.col("term").isNotNull()).distinct().mapInPandas(run, "language string, term string, stem string")
