"""Tokenizers, n-gram templates and other text functions as Column expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What counts as white space in the tokenizers: Unicode spaces, line separators and the byte order mark.
SPACES = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = rf"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?|[^{SPACES}]"
TREEBANK = rf"\.{{3}}|--+|[A-Za-z]+(?:[-'][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*|``|''|[^{SPACES}]"
WORD_PUNCT = rf"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACES}]+"
TOKTOK = rf"\.\.\.|--+|[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+(?:[.,][0-9]+)*|[^{SPACES}]"
STOPWORDS = tuple(
    sorted(
        "a again all an and any are as at be both but by can down each few for from further he her here him how i if in into is it just me more most my myself no not now of on once or other our ours ourselves out over she should some such than that the their them themselves then there these they this to too under up very was we when where why will with you your yours".split()
    )
)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f's lambdas look at it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(_col(text), _UPPER, _UPPER.lower())


def ascii_tokens(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and apostrophes in lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def raw_ascii_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit("[A-Za-z0-9']+"), F.lit(0))


def _matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def _split_clitics(tokens: Column) -> Column:
    def parts(t: Column) -> Column:
        stem = F.regexp_extract(t, r"(?is)^(.+)'(?:s|m|d|re|ve|ll)$", 1)
        tail = F.regexp_extract(t, r"(?is)('(?:s|m|d|re|ve|ll))$", 1)
        return (
            F.when(t.rlike(r"(?is)^.+n't$"), F.array(F.regexp_extract(t, r"(?is)^(.+)n't$", 1), F.lit("n't")))
            .when(stem != "", F.array(stem, F.lower(tail)))
            .otherwise(F.array(t))
        )

    return F.flatten(F.transform(tokens, parts))


def word_tokens(text: Column | str) -> Column:
    """Words, their clitics apart, and single other characters."""
    return _split_clitics(_matches(text, WORD))


def treebank_tokens(text: Column | str) -> Column:
    return _split_clitics(_matches(text, TREEBANK))


def wordpunct_tokens(text: Column | str) -> Column:
    return _matches(text, WORD_PUNCT)


def toktok_tokens(text: Column | str) -> Column:
    return _matches(text, TOKTOK)


def without_stopwords(tokens: Column | str) -> Column:
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(*STOPWORDS))


def normalized_ascii(text: Column | str, remove_stopwords: bool = True) -> Column:
    toks = ascii_tokens(text)
    return without_stopwords(toks) if remove_stopwords else toks


def ngrams(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens in order."""
    if n < 1:
        raise ValueError("n must be a positive integer")
    empty = F.array().cast("array<array<string>>")

    def all_of(toks: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(toks) - (n - 1))
        return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.slice(toks, i, n))).otherwise(empty)

    return _bound(_col(tokens), all_of)


def bigrams(tokens: Column | str, distance: int = 1) -> Column:
    """Pairs of tokens so far apart, as structs l and r; built without a lambda."""
    toks = _col(tokens)
    size = F.greatest(F.size(toks) - distance, F.lit(0))
    pairs = F.arrays_zip(F.slice(toks, F.lit(1), size).alias("l"), F.slice(toks, F.lit(distance + 1), size).alias("r"))
    return pairs.cast("array<struct<l:string,r:string>>")


def zipped(tokens: Column | str, places: Iterable[int], width: int, last: str | None = None) -> Column:
    """Structs w1, ..., w<width> of the tokens at these distances from each start at which all are there, built without
    a lambda. Fields beyond the places are null, but for the last one where that is given."""
    toks, at = _col(tokens), list(places)
    size = F.greatest(F.size(toks) - at[-1], F.lit(0))
    cols = [F.slice(toks, F.lit(g + 1), size) for g in at]
    cols += [F.array().cast("array<string>")] * (width - len(at))
    if last is not None:
        cols[-1] = F.array_repeat(F.lit(last), size)
    kind = "array<struct<" + ",".join(f"w{i + 1}:string" for i in range(width)) + ">>"
    return F.arrays_zip(*(c.alias(f"w{i + 1}") for i, c in enumerate(cols))).cast(kind)


def window_pairs(tokens: Column | str, window: int) -> Column:
    """Ordered pairs of tokens fewer than window places apart."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    parts = [bigrams(tokens, d) for d in range(1, window)]
    return parts[0] if window == 2 else F.concat(*parts)


def everygrams(tokens: Column | str, least: int = 1, most: int = 3) -> Column:
    """Runs of least to most tokens, by start, then length."""
    if not 1 <= least <= most:
        raise ValueError("lengths must satisfy 1 <= least <= most")
    empty = F.array().cast("array<array<string>>")

    def all_of(toks: Column) -> Column:
        def at(i: Column) -> Column:
            sizes = F.sequence(F.lit(least), F.least(F.lit(most), F.size(toks) - i + 1))
            return F.transform(sizes, lambda s: F.slice(toks, i, s))

        starts = F.sequence(F.lit(1), F.size(toks) - (least - 1))
        return F.when(F.size(toks) >= least, F.flatten(F.transform(starts, at))).otherwise(empty)

    return _bound(_col(tokens), all_of)


def skipgrams(tokens: Column | str, n: int, k: int) -> Column:
    """For each start, the token with every n-1 of the next n+k-1 places; those past the end are left out."""
    if n < 1 or k < 0:
        raise ValueError("n must be positive and k not negative")
    if n == 1:
        return F.transform(_col(tokens), lambda t: F.array(t))
    shapes = list(combinations(range(1, n + k), n - 1))
    empty = F.array().cast("array<array<string>>")

    def all_of(toks: Column) -> Column:
        def at(i: Column) -> Column:
            picks = [F.when(i + s[-1] <= F.size(toks), F.array(*(F.element_at(toks, i + o) for o in (0, *s)))) for s in shapes]
            return F.filter(F.array(*picks), lambda p: p.isNotNull())

        starts = F.sequence(F.lit(1), F.size(toks))
        return F.when(F.size(toks) > 0, F.flatten(F.transform(starts, at))).otherwise(empty)

    return _bound(_col(tokens), all_of)


def fnv1a(token: Column | str) -> Column:
    """64-bit FNV-1a of a token's bytes as 16 hex digits, in two 32-bit halves so that nothing overflows."""
    t = F.encode(_col(token), "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.conv(F.hex(F.substring(t, i, F.lit(1))), 16, 10).cast("long"))

    def step(a: Column, c: Column) -> Column:
        low = a["l"].bitwiseXOR(c)
        carry = F.shiftright(low * 435, 32)
        return F.struct(
            (a["h"] * 435 + carry + low * 256).bitwiseAND(4294967295).alias("h"),
            (low * 435).bitwiseAND(4294967295).alias("l"),
        )

    start = F.struct(F.lit(3421674724).alias("h"), F.lit(2216829733).alias("l"))
    text = lambda a: F.concat(F.lpad(F.hex(a["h"]), 8, "0"), F.lpad(F.hex(a["l"]), 8, "0"))
    return F.when(F.length(t) > 0, F.aggregate(codes, start, step, text)).otherwise("CBF29CE484222325")


def gram_hash(tokens: Column | str) -> Column:
    """FNV-1a of an n-gram's length and then of its tokens' hashes, as 16 hex digits."""
    from .arrow import arrow_function

    def run(gram: list[str]) -> str:
        prime, mask = 1099511628211, (1 << 64) - 1

        def fold(h: int, x: int) -> int:
            return ((h ^ x) * prime) & mask

        h = fold(14695981039346656037, len(gram))
        for t in gram:
            own = 14695981039346656037
            for b in t.encode():
                own = fold(own, b)
            h = fold(h, own)
        return f"{h:016X}"

    return arrow_function(run, "string")(tokens)


#: Closed word classes of the rule tagger, in the order they are tried.
_CLASSES = (
    ("PRP", "he her him i it me she them they us we you"),
    ("DT", "a an that the these this those"),
    ("CC", "and but nor or yet"),
    ("VB", "am are be been being did do does had has have is was were"),
)
#: Endings of the rule tagger, tried after these.
_ENDS = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"))
TAG_IDS = {t: i for i, t in enumerate("NN NNP CD VBG VBD RB DT CC PRP VB".split())}


def rule_tag(token: Column | str) -> Column:
    """Part of speech of a token by its form."""
    t = _col(token)
    low = F.lower(t)
    tag = F.when(t.rlike("^[0-9]+$"), "CD")
    for name, words in _CLASSES:
        tag = tag.when(low.isin(*words.split()), name)
    for end, name in _ENDS:
        tag = tag.when(low.endswith(end), name)
    return tag.when(t.rlike("^[A-Z]") & (F.length(t) > 1), "NNP").otherwise("NN")


def tag_id(tag: Column | str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in TAG_IDS.items() for x in kv)), _col(tag))


def rule_tags(text: Column | str) -> Column:
    """token, tag, tag_id, start (in characters, from 0) and length of each ASCII token."""
    kind = "array<struct<token:string,tag:string,tag_id:int,start:int,length:int>>"
    parts = F.struct(F.split(_col(text), "[A-Za-z0-9']+").alias("gaps"), raw_ascii_tokens(text).alias("toks"))

    def all_of(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.element_at(p["gaps"], i))
            t = F.element_at(p["toks"], i)
            row = F.struct(t.alias("token"), rule_tag(t).alias("tag"), tag_id(rule_tag(t)).alias("tag_id"), start.alias("start"), F.length(t).alias("length"))
            return F.struct((start + F.length(t)).alias("at"), F.array_append(acc["rows"], row).alias("rows"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("rows"))
        places = F.when(F.size(p["toks"]) > 0, F.sequence(F.lit(1), F.size(p["toks"]))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, zero, step, lambda a: a["rows"])

    return _bound(parts, all_of)


def paragraphs(text: Column | str) -> Column:
    """What blank lines part, trimmed, without empty ones."""
    pieces = F.split(_col(text), r"\r?\n\r?\n")
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, rf"^[{SPACES}]+|[{SPACES}]+$", ""))
    return F.filter(trimmed, lambda p: p != "")


#: Suffix, replacement and least length of the one-rule stemmer, in order.
LANCASTER = tuple(
    (a, "" if b == "-" else b, int(n))
    for a, b, n in (r.split(":") for r in "sses:ss:4 ies:y:4 ied:y:4 ing:-:5 edly:e:6 ed:-:4 ly:-:4 ness:-:6 ment:-:6 tion:t:6 ions:ion:6 ers:er:5 er:-:5 s:-:4".split())
)


def lancaster_stem(word: Column | str) -> Column:
    """The first suffix rule that fits, then a doubled last consonant made single."""
    w = F.lower(F.trim(_col(word)))
    cut = lambda x: F.regexp_replace(x, r"([bdfgmnprst])\1$", "$1")
    out = None
    for suffix, to, least in LANCASTER:
        hit = w.endswith(suffix) & (F.length(w) >= least)
        got = cut(F.concat(F.substring(w, F.lit(1), F.length(w) - len(suffix)), F.lit(to)))
        out = F.when(hit, got) if out is None else out.when(hit, got)
    out = out.otherwise(w)
    return F.when(out == "", w).otherwise(out)


def regexp_stem(word: Column | str, pattern: str, least: int = 0) -> Column:
    """Without the first match of the pattern (case is ignored) if longer than least."""
    w = _col(word)
    return F.when(F.length(w) > least, F.regexp_replace(w, rf"(?is)^(.*?)(?:{pattern})(.*)$", "$1$2")).otherwise(w)


#: By part of speech: what is cut, the least length of the word, what takes its place.
MORPHY = {
    "n": (("ies", 4, "y"), ("ves", 4, "f"), ("es", 3, ""), ("s", 2, "")),
    "v": (("ies", 4, "y"), ("ing", 5, ""), ("ed", 4, ""), ("s", 2, "")),
    "a": (("est", 4, ""), ("er", 3, "")),
    "r": (),
}


def morphy_rule(word: Column | str, pos: str | None = None) -> Column:
    """Base form by the first ending that fits: nouns also where no part of speech is given."""
    w = F.translate(F.substring(_col(word), 1, 128), _UPPER + " ", _UPPER.lower() + "_")
    rules = MORPHY[pos or "n"]
    out = F.when(F.lit(False), w)
    for end, least, to in rules:
        out = out.when(w.endswith(end) & (F.length(w) >= least), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(to)))
    return out.otherwise(w)
