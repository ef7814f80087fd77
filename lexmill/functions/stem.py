"""Stemmers. porter() is a plain function of a word; stems() maps a table's distinct words and joins them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .arrow import arrow_function

_STEP2 = tuple(
    tuple(p.split(">"))
    for p in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log".split()
)
_STEP3 = tuple(tuple(p.split(">")) for p in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split())
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _forms(word: str) -> str:
    """c or v for each letter; a y after a consonant is a vowel."""
    out: list[str] = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _forms(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: tuple[tuple[str, ...], ...]) -> str:
    for end, to in rules:
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + to if _measure(stem) > 0 else word
    return word


def porter(token: str) -> str:
    """Porter's algorithm; words of two letters stay. A step ends with the first suffix that is there."""
    w = token.translate(_LOWER)
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w[: -len(end)]
                if "v" in _forms(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w):
                        w = w if w[-1] in "lsz" else w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _forms(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if _measure(w[: -len(end)]) > 1 else w
            break
    else:
        if w.endswith("ion") and w[:-3].endswith(("s", "t")) and _measure(w[:-3]) > 1:
            w = w[:-3]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_LOWER = {c: c + 32 for c in range(65, 91)}
porter_stem = arrow_function(porter, "string")


def snowball_stem(word: Column | str, language: str = "english") -> Column:
    """Porter's for English ASCII words, the suffix rules otherwise."""
    w = F.lower(F.trim(T._col(word)))
    if language.lower() != "english":
        return T.lancaster_stem(w)
    return F.when(w.rlike(r"^[\x00-\x7F]+$"), porter_stem(w)).otherwise(T.lancaster_stem(w))


def stems(words: DataFrame, column: str, stem=porter_stem) -> DataFrame:
    """words with a column stem. Each distinct word is stemmed once; the few distinct ones are joined back."""
    known = words.select(column).distinct().withColumn("stem", stem(F.col(column)))
    return words.join(known, column, "left")
