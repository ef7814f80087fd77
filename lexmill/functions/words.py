"""Tokenizers that need Python: tweets, multi-word expressions, Unicode normalisation; and the word tokenizer in Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .arrow import arrow_function
from .stem import porter

_PHONE = r"\(\d{3}\)\s*\d+\s*-\d+|\d{2}-\d{8}|\d{3}-\d{3}-\d{4}|\d+\s*-\s*\d+"
_EMOTICON = r"[:;=8]-?[)(DPpOo/\\]"
_EMOJI = r"\p{Extended_Pictographic}[\p{Emoji_Modifier}️]?(?:‍\p{Extended_Pictographic}[\p{Emoji_Modifier}️]?)*"
_TWEET = rf"https?://\S+|#[A-Za-z0-9_]+|@[A-Za-z0-9_]+|{_EMOTICON}|[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|{_EMOJI}|\S"


def words(text: str) -> list[str]:
    """What text.word_tokens gives."""
    out = []
    for t in re.findall(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|\S", text):
        if m := re.fullmatch(r"(?i)(.+)n't", t):
            out += [m.group(1), "n't"]
        elif m := re.fullmatch(r"(?i)(.+)'(s|m|d|re|ve|ll)", t):
            out += [m.group(1), f"'{m.group(2).lower()}"]
        else:
            out.append(t)
    return out


_TWEETS = {True: regex.compile(rf"{_PHONE}|{_TWEET}"), False: regex.compile(_TWEET)}
_FACE = re.compile(_EMOTICON)
_THRICE = re.compile(r"([A-Za-z])\1{2,}")


def tweet_words(text: str, preserve_case: bool = True, strip_handles: bool = False, reduce_len: bool = False, phones: bool = True) -> list[str]:
    out = []
    for t in _TWEETS[phones].findall(text):
        if strip_handles and t.startswith("@"):
            continue
        if reduce_len and t.isascii() and t.isalpha():
            t = _THRICE.sub(r"\1\1\1", t)
        out.append(t if preserve_case or (t[0] in ":;=8" and _FACE.fullmatch(t)) else t.lower())
    return out


def tweet_tokens(text: Column | str, **options) -> Column:
    return arrow_function(lambda t: tweet_words(t, **options), "array<string>")(text)


#: White space of the tweets' pattern. A token has some within only between a digit, bracket or dash and a digit or dash,
#: in a telephone number: all other white space parts pieces that are told apart by themselves. Beside it stands a letter
#: or an ASCII character that is no such one; where there is neither, the piece goes on, which costs time alone.
_BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CUT = rf"{_BLANK}(?:(?<=[!-(*-,./:-~\p{{L}}]{_BLANK}){_BLANK}*+|{_BLANK}*+(?=[!-,./:-~\p{{L}}]))"


def tweet_counts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """(token, n): tweet_tokens of all texts, counted. Pieces are counted first, so that each different one goes to Python
    once and not wherever it stands."""
    pieces = docs.select(F.explode(F.split(text, _CUT)).alias("piece")).filter("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))
    return pieces.select(F.explode(tweet_tokens("piece", **options)).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def merge_phrases(tokens: Sequence[str], phrases: Sequence[Sequence[str]], joiner: str = "_") -> list[str]:
    """Phrases as one token, the longest first, from left to right; phrases of one word are ignored."""
    known = {tuple(w.strip() for w in p if w.strip()) for p in phrases}
    sizes = sorted({len(p) for p in known if len(p) > 1}, reverse=True)
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in sizes if tuple(tokens[i : i + n]) in known), 1)
        out.append(joiner.join(tokens[i : i + n]))
        i += n
    return out


def mwe_tokens(tokens: Column | str, phrases: Sequence[Sequence[str]], joiner: str = "_") -> Column:
    return arrow_function(lambda t: merge_phrases(t, phrases, joiner), "array<string>")(tokens)


nfkc = arrow_function(lambda t: unicodedata.normalize("NFKC", t), "string")


def normalized_unicode(text: Column | str, remove_stopwords: bool = True) -> Column:
    toks = F.transform(F.regexp_extract_all(nfkc(text), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), F.lower)
    return T.without_stopwords(toks) if remove_stopwords else toks


porter_ascii = arrow_function(lambda t: [porter(x) if x.isascii() else x for x in t], "array<string>")


def normalized(text: Column | str, remove_stopwords: bool = True, prefer_ascii: bool = True, stem: bool = False) -> Column:
    """ASCII texts by the ASCII tokenizer, others by the Unicode one; stem gives Porter's stems of ASCII tokens."""
    out = normalized_unicode(text, remove_stopwords)
    if prefer_ascii:
        c = F.col(text) if isinstance(text, str) else text
        out = F.when(c.rlike(r"^[\x00-\x7F]*$"), T.normalized_ascii(c, remove_stopwords)).otherwise(out)
    return porter_ascii(out) if stem else out
