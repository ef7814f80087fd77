"""Collocation finders for two, three and four words, and association measures as column expressions.

A finder is a set of frequency tables, one a pattern of positions: (0, 1, 2) counts triples of words, (0, 2) the first
with the third whatever stands between. Scoring looks up the marginals of each n-gram by equi-joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import batches
from ..functions import text as T
from ..sources.shared import stored
from . import counts

EPSILON = 1e-20
#: Patterns that each finder counts.
PATTERNS = {
    2: [(0, 1)],
    3: [(0, 1, 2), (0, 1), (0, 2)],
    4: [(0, 1, 2, 3), (0, 1), (0, 2), (0, 3), (0, 1, 2), (0, 2, 3), (0, 1, 3)],
}


@dataclass(frozen=True)
class Finder:
    """words (w1, n) and for each pattern a table (w1, ..., n); window is that of the pairs.

    known has the n-grams of each size up to that of the finder, with the counts m_... of those of their words that
    include the first; no n-gram of the finder's size is rarer than least.
    """

    size: int
    window: int
    words: DataFrame
    tables: dict[tuple[int, ...], DataFrame]
    known: dict[int, DataFrame]
    least: int = 1

    def total(self) -> DataFrame:
        return self.words.agg(F.sum("n").alias("total"))

    def with_freq(self, least: int) -> Finder:
        """Without n-grams seen fewer than least times; words and total stay."""
        return replace(self._only(F.col("n") >= least), least=max(self.least, least))

    def without_ngrams(self, pred: Callable[..., Column]) -> Finder:
        return self._only(~pred(*(F.col(f"w{i + 1}") for i in range(self.size))))

    def without_words(self, pred: Callable[[Column], Column]) -> Finder:
        """Without n-grams that have any word for which pred holds."""
        bad = pred(F.col("w1"))
        for i in range(1, self.size):
            bad = bad | pred(F.col(f"w{i + 1}"))
        return self._only(~bad)

    def _only(self, keep: Column) -> Finder:
        full = tuple(range(self.size))
        return replace(self, tables=self.tables | {full: self.tables[full].filter(keep)}, known=self.known | {self.size: self.known[self.size].filter(keep)})

    def bigram_finder(self) -> Finder:
        return Finder(2, self.window, self.words, {(0, 1): self.tables[0, 1]}, {1: self.known[1], 2: self.known[2]})


def _weights(size: int, window: int, pattern: tuple[int, ...]) -> Counter:
    """How often each tuple of distances counts for a pattern, over all places that an n-gram may take in a window."""
    out: Counter = Counter()
    for places in combinations(range(1, window), size - 1):
        whole = (0, *places)
        out[tuple(whole[p] for p in pattern)] += 1
    return out


def finder(docs: DataFrame, size: int = 2, window: int | None = None, tokens: Column | str | None = None) -> Finder:
    """Of documents' ASCII tokens, or of a column of token arrays; documents don't run into one another.

    As in the windowed counts for three and four words, every word is counted once a placement, also at a document's end
    where later words are missing.
    """
    window = window or size
    if size not in PATTERNS or window < size:
        raise ValueError("size must be 2, 3 or 4 and window no smaller")
    toks = docs.select((T.ascii_tokens("text") if tokens is None else T._col(tokens)).alias("t"))
    # one scan, one shuffle: a row for each word and what follows it in the window, kept where the word's rows are
    wide = [f"w{i + 1}" for i in range(window)]
    rest = F.greatest(F.size("t"), F.lit(0))
    runs = F.arrays_zip(F.col("t").alias("w1"), *(F.slice("t", F.lit(i + 1), rest).alias(w) for i, w in enumerate(wide) if i))
    kind = "array<struct<" + ",".join(f"{w}:string" for w in wide) + ">>"
    seen = toks.select(F.explode(runs.cast(kind)).alias("g")).select("g.*").repartition("w1").groupBy(*wide).agg(F.count("*").alias("n"))
    return _plain(seen, size) if window == size else _weighted(seen, size, window)


def _name(place: tuple[int, ...]) -> str:
    return "m_" + "".join(map(str, place))


def _from_first(size: int) -> list[tuple[int, ...]]:
    """Sets of positions with the first one, without that of all, so ordered that most need no sort of their own."""
    parts = [(0, *p) for r in range(size - 1) for p in combinations(range(1, size), r)]
    return [p for p in ((0, 3, 1), (0, 3), (0, 2, 3), (0, 2), (0, 1, 2), (0, 1), (0,)) if tuple(sorted(p)) in parts]


def _with_sums(rows: DataFrame, size: int, counts_: Callable[[tuple[int, ...]], Column]) -> DataFrame:
    """rows, parted by their first word, with the sum of counts_(place) over the rows that have the same words there, for
    each place of _from_first; at_1, at_2, ... are true in one row for each word, pair of words and so on."""
    whole = [f"w{i + 1}" for i in range(size)]
    for order in _from_first(size):
        place = tuple(sorted(order))
        keys = [f"w{i + 1}" for i in order]
        straight = place == tuple(range(len(place)))
        w = W.partitionBy(*keys)
        if straight:
            w = w.orderBy(*whole[len(place):])
            rows = rows.withColumn(f"at_{len(place)}", F.row_number().over(w) == 1)
            w = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn(_name(place), F.sum(counts_(place)).over(w))
    return rows


def _plain(seen: DataFrame, size: int) -> Finder:
    """Of runs as long as the n-grams: shorter ones are the beginnings of the rows."""
    words = [f"w{i + 1}" for i in range(size)]
    rows = stored(_with_sums(seen, size, lambda p: F.when(F.col(f"w{p[-1] + 1}").isNotNull(), F.col("n"))), "ngrams", codec="zstd")
    whole = rows.filter(F.col(words[-1]).isNotNull())
    known = {size: whole.select(*words, "n", *(_name(tuple(sorted(p))) for p in _from_first(size)))}
    for k in range(1, size):
        own = rows.filter(F.col(f"at_{k}") & F.col(words[k - 1]).isNotNull())
        known[k] = own.select(*words[:k], F.col(_name(tuple(range(k)))).alias("n"), *(_name(tuple(sorted(p))) for p in _from_first(k)))

    def counted(pattern: tuple[int, ...]) -> DataFrame:
        if pattern == tuple(range(len(pattern))):
            return known[len(pattern)].select(*words[: len(pattern)], "n")
        names = [F.col(f"w{p + 1}").alias(words[i]) for i, p in enumerate(pattern)]
        return rows.filter(F.col(f"w{pattern[-1] + 1}").isNotNull()).groupBy(*names).agg(F.sum("n").alias("n"))

    return Finder(size, size, known[1].select("w1", "n"), {p: counted(p) for p in PATTERNS[size]}, known)


def _weighted(seen: DataFrame, size: int, window: int) -> Finder:
    """Of runs as long as the window: each gives n-grams at several distances. A pattern's words keep their places."""
    words = [f"w{i + 1}" for i in range(size)]
    patterns = [(0,), *PATTERNS[size]]
    times = comb(window - 1, size - 1) if size > 2 else 1
    groups = []
    for kind, pattern in enumerate(patterns):
        for gaps, weight in (_weights(size, window, pattern) if kind else {(0,): times}).items():
            at = dict(zip(pattern, gaps, strict=True))
            own = F.struct(F.lit(kind).alias("kind"), (F.col("n") * weight).alias("k"), *(F.col(f"w{at[i] + 1}").alias(words[i]) if i in at else F.lit(None).cast("string").alias(words[i]) for i in range(1, size)))
            groups.append(F.when(F.col(f"w{gaps[-1] + 1}").isNotNull(), own))
    rows = seen.select("w1", F.explode(F.array_compact(F.array(*groups))).alias("x")).select("w1", *(F.col(f"x.{w}").alias(w) for w in words[1:]), "x.kind", "x.k")
    rows = rows.groupBy("kind", *words).agg(F.sum("k").alias("n"))
    rows = stored(_with_sums(rows, size, lambda p: F.when(F.col("kind") == patterns.index(p), F.col("n"))), "ngrams", "kind", "zstd")
    of = lambda p: rows.filter(F.col("kind") == patterns.index(p))
    known = {k: of(tuple(range(k))).select(*words[:k], "n", *(_name(tuple(sorted(p))) for p in _from_first(k))) for k in range(1, size + 1)}
    tables = {p: of(p).select(*(F.col(f"w{i + 1}").alias(words[j]) for j, i in enumerate(p)), "n") for p in PATTERNS[size]}
    return Finder(size, window, known[1].select("w1", "n"), tables, known)


def marginals(f: Finder) -> DataFrame:
    """w1, ..., n, total, and for each set of positions its count m_...

    An n-gram has the counts of those of its words that include the first. Those of all others are what its words after
    the first have, an n-gram of one word less: one join for each size.
    """
    out = f.known[1]
    for size in range(2, f.size + 1):
        words = [f"w{i + 1}" for i in range(size)]
        own = f.known[size]
        if f.window == f.size:  # an n-gram is no rarer than a longer one that it is part of
            own = own.filter(F.col("n") >= f.least)
        later = lambda c: "m_" + "".join(str(int(i) + 1) for i in c[2:])
        right = out.select(*(F.col(w).alias(words[i + 1]) for i, w in enumerate(words[:-1])), F.col("n").alias(_name(tuple(range(1, size)))), *(F.col(c).alias(later(c)) for c in out.columns if c.startswith("m_")))
        out = own.join(right, words[1:])
    places = [_name(p) for r in range(1, f.size) for p in combinations(range(f.size), r)]
    return out.select(*(f"w{i + 1}" for i in range(f.size)), "n", *places).crossJoin(F.broadcast(f.total()))


class Cells:
    """Contingency cells of an n-gram from marginals, by inclusion and exclusion."""

    def __init__(self, size: int):
        self.size = size
        self.n = F.col("n").cast("double")
        self.total = F.col("total").cast("double")

    def margin(self, place: tuple[int, ...]) -> Column:
        if len(place) == self.size:
            return self.n
        return F.col("m_" + "".join(map(str, place))).cast("double") if place else self.total

    def singles(self) -> list[Column]:
        return [self.margin((i,)) for i in range(self.size)]

    def product(self) -> Column:
        out = self.singles()[0]
        for m in self.singles()[1:]:
            out = out * m
        return out

    def cell(self, inside: tuple[int, ...]) -> Column:
        """Count of n-grams that agree at exactly these positions."""
        rest = [i for i in range(self.size) if i not in inside]
        out = self.margin(inside)
        for r in range(1, len(rest) + 1):
            for more in combinations(rest, r):
                m = self.margin(tuple(sorted((*inside, *more))))
                out = out - m if r % 2 else out + m
        return out

    def all(self) -> list[tuple[tuple[int, ...], Column]]:
        return [(s, self.cell(s)) for r in range(self.size, -1, -1) for s in combinations(range(self.size), r)]

    def expected(self, inside: tuple[int, ...]) -> Column:
        out = F.lit(1.0)
        for i in range(self.size):
            m = self.margin((i,))
            out = out * (m if i in inside else self.total - m)
        return out / F.pow(self.total, F.lit(float(self.size - 1)))


def raw_freq(c: Cells) -> Column:
    return c.n / c.total


def student_t(c: Cells) -> Column:
    return (c.n - c.product() / F.pow(c.total, F.lit(float(c.size - 1)))) / F.sqrt(c.n + EPSILON)


def mi_like(c: Cells, power: int = 3) -> Column:
    return F.pow(c.n, F.lit(float(power))) / c.product()


def pmi(c: Cells) -> Column:
    return F.log2(c.n * F.pow(c.total, F.lit(float(c.size - 1)))) - F.log2(c.product())


def likelihood_ratio(c: Cells) -> Column:
    out = F.lit(0.0)
    for inside, seen in c.all():
        out = out + seen * F.log(seen / (c.expected(inside) + EPSILON) + EPSILON)
    return out * 2


def poisson_stirling(c: Cells) -> Column:
    return c.n * (F.log2(c.n / (c.product() / F.pow(c.total, F.lit(float(c.size - 1))))) - 1)


def jaccard(c: Cells) -> Column:
    return c.n / sum((x for s, x in c.all() if s and len(s) < c.size), c.n)


def phi_sq(c: Cells) -> Column:
    ii, io, oi, oo = c.cell((0, 1)), c.cell((0,)), c.cell((1,)), c.cell(())
    return F.pow(ii * oo - io * oi, F.lit(2.0)) / ((ii + io) * (ii + oi) * (io + oo) * (oi + oo))


def chi_sq(c: Cells) -> Column:
    return c.total * phi_sq(c)


def dice(c: Cells) -> Column:
    return 2 * c.n / (c.margin((0,)) + c.margin((1,)))


def fisher(c: Cells) -> Column:
    raise NotImplementedError("the exact test is not available")


MEASURES: dict[str, Callable[[Cells], Column]] = {f.__name__: f for f in (raw_freq, student_t, mi_like, pmi, likelihood_ratio, poisson_stirling, jaccard, phi_sq, chi_sq, dice)}
_ONLY_PAIRS = {"phi_sq", "chi_sq", "dice", "fisher"}


def score(f: Finder, measure: str | Callable[[Cells], Column], round_to: int | None = None) -> DataFrame:
    """w1, ..., score of every n-gram; scores that aren't finite are left out.

    A pair's count is divided by window - 1, as it has so many chances to be seen.
    """
    name = measure if isinstance(measure, str) else measure.__name__
    if f.size > 2 and name in _ONLY_PAIRS:
        raise ValueError(f"{name} is for pairs")
    make = MEASURES[measure] if isinstance(measure, str) else measure
    m = marginals(f)
    if f.size == 2 and f.window > 2:
        m = m.withColumn("n", F.col("n") / (f.window - 1))
    return _finite(m, f.size, make, round_to)


def _finite(m: DataFrame, size: int, make: Callable[[Cells], Column], round_to: int | None) -> DataFrame:
    # one test of the plain score: rounding takes longer than the measure, and what a filter looks at is made for each look;
    # NaN is above all numbers
    s = make(Cells(size))
    found = m.filter("n > 0").filter(F.abs(s) < float("inf"))
    return found.select(*(f"w{i + 1}" for i in range(size)), (F.round(s, round_to) if round_to is not None else s).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    """By score, then words."""
    return scored.orderBy(F.desc("score"), *(c for c in scored.columns if c != "score"))


def nbest(f: Finder, measure: str | Callable[[Cells], Column], k: int, round_to: int | None = 9) -> DataFrame:
    return ranked(score(f, measure, round_to)).limit(k)


def above(f: Finder, measure: str | Callable[[Cells], Column], least: float, round_to: int | None = 9) -> DataFrame:
    """In rank order, strictly above a score."""
    return ranked(score(f, measure, round_to).filter(F.col("score") > least))


#: Words that no reported collocation of a text holds.
COLLOCATION_STOP = tuple("a an and are as at be but by for from has have he i in is it its of on or she that the their to was with".split())


def _next_words(docs: DataFrame, least: int, stop: tuple[str, ...]) -> DataFrame:
    """(w1, w2, n): every word with the next one of its document, which is null where either is shorter than least or a
    stop word, or none is left. A batch's pairs are counted where its texts are."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            toks, first = batches.tokens(part.column(0), lower=True)
            toks = toks.dictionary_encode()
            own = toks.dictionary
            good = pc.and_(pc.greater_equal(pc.binary_length(own), least), pc.invert(pc.is_in(own, pa.array(stop, pa.string())))).to_numpy(zero_copy_only=False)
            w = toks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            after = np.append(w[1:], -1)[: len(w)]
            after[first[1:][np.diff(first) > 0] - 1] = -1
            after[~(good[w] & good[after])] = -1
            keys, n = np.unique(w * (len(own) + 1) + after + 1, return_counts=True)
            left, right = keys // (len(own) + 1), keys % (len(own) + 1) - 1
            for i in range(0, len(keys), batches.ROWS):
                at = slice(i, i + batches.ROWS)
                cols = [own.take(pa.array(left[at])), own.take(pa.array(right[at], mask=right[at] < 0)), pa.array(n[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "n"])

    return docs.select("text").mapInArrow(run, "w1 string, w2 string, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def text_collocations(docs: DataFrame, k: int = 20, window: int = 2, stop: tuple[str, ...] = COLLOCATION_STOP) -> DataFrame:
    """The best pairs by likelihood ratio, of pairs seen twice or more and free of short and stop words."""
    if window > 2:
        f = finder(docs, 2, window).with_freq(2).without_words(lambda w: (F.length(w) < 3) | F.lower(w).isin(*stop))
        return nbest(f, "likelihood_ratio", k)
    # neighbours: other pairs are counted as words alone, as a word's count is all that they are needed for
    rows = stored(_next_words(docs, 3, stop), "neighbours", codec="zstd")
    words = rows.groupBy("w1").agg(F.sum("n").alias("m"))
    m = rows.filter("w2 is not null and n >= 2")
    m = m.join(words.select("w1", F.col("m").alias("m_0")), "w1").join(words.select(F.col("w1").alias("w2"), F.col("m").alias("m_1")), "w2")
    m = m.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("w1", "w2", "n", "m_0", "m_1", "total")
    return ranked(_finite(m, 2, likelihood_ratio, 9)).limit(k)


__all__ = ["COLLOCATION_STOP", "MEASURES", "Cells", "Finder", "above", "counts", "finder", "marginals", "nbest", "ranked", "score", "text_collocations"]
