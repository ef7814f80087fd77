"""Passages of MIN_WORDS words or more that repeat across documents, by compressed FM-indexes.

Every window of MIN_WORDS words holds an anchor: the least hash of its runs of ANCHOR words. Equal windows hold equal
anchors, so that a repeated passage brings its surroundings, the segment of all windows that hold the anchor, to one
shard. A shard's segments form an FM-index: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet tree
(the level-wise matrix form, in bit vectors that leave out words of only zeros or only ones). Its segments are then streamed
through backward search, which keeps the interval of the suffixes that begin with the match and drops what no second
document holds: the steps it takes from a place to the left are that place's matching statistic, the longest match that ends
there. A statistic below MIN_WORDS bounds those of the next places, each at most one more than the last, so that places
which can't reach it are passed over; at the others the statistic is computed up to MIN_WORDS, and windows that reach it are
reported. All segments of a shard step together in numpy. Words that a single document of an anchor's segments has can't be in a
shared window: they and runs that they leave too short don't enter the index.

All anchors and all segments take part; the result is exact up to collisions of 64-bit hashes (the index itself holds words
as numbers of 64-bit hashes). Segments that are equal as a whole in two documents are repeated all over and enter the index
once. An anchor with more than HOT segments would make too large a shard. Its windows are compared by their hashes instead,
by an aggregate that no group is too large for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._frame import stored, tidy
from ._words import Words, mix, pieces, signed, spans_hash

MIN_WORDS, ANCHOR, SHARD_WORDS, HOT = 50, 16, 1_500_000, 20_000


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over x[i : i + n] for each i; the end of x is padded with its last values' own windows."""
    have, size = x, 1
    while size < n:
        step = min(size, n - size)
        nxt = have.copy()
        nxt[:-step] = best(have[:-step], have[step:])
        have, size = nxt, size + step
    return have


def anchors(words: Words, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word places of the anchors, their hashes, and start and end (words of the batch) of their segments."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, np.zeros(0, np.uint64), none, none
    width = least - k + 1
    h = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    at, x = words.windows(k)
    h[at] = np.minimum(x, np.uint64(0xFFFFFFFFFFFFFFFE)) | np.uint64(1)
    low = _sliding(h, width, np.minimum)
    valid = np.zeros(n, bool)
    i = np.arange(n - least + 1)
    valid[: n - least + 1] = words.row[i] == words.row[i + least - 1]
    low[~valid] = 0
    # an anchor is the least of some window: the largest of the minima of the windows that hold it
    high = _sliding(low[::-1], width, np.maximum)[::-1]
    place = np.flatnonzero((high == h) & (high > 0))
    row = words.row[place]
    start = np.maximum(words.first[row], place - (width - 1))
    end = np.minimum(words.first[row + 1], place + least)
    return place, h[place], start, end


def _pass_one(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                words = Words(texts)
                place, h, start, end = anchors(words, least, k)
                seg = words.spans(start, end) if len(place) else h
                row = words.row[place] if len(place) else place
                # equal neighbours, as in a text that says one thing again and again, are one row
                new = np.ones(len(place), bool)
                if len(place) > 1:
                    new[1:] = (seg[1:] != seg[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (h[1:] != h[:-1])
                own = np.flatnonzero(new)
                reps = np.diff(np.append(own, len(place)))
                ids = part.column(part.schema.get_field_index("doc_id"))
                first = start[own] - words.first[row[own]] if len(own) else own
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[own])), pa.array(signed(seg[own])), ids.take(pa.array(row[own])), pa.array(first, pa.int32()), pa.array((end - start)[own], pa.int32()), pa.array(reps, pa.int32())],
                    names=["anchor", "seg", "doc_id", "start", "len", "reps"],
                )

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words (64-bit hashes) of the wanted segments of each document."""
    for batch in batches:
        at = 0
        for part, texts in pieces(batch, "text"):
            words = Words(texts)
            ids = words.hash
            counts = words.counts()
            wanted = batch.column(batch.schema.get_field_index("wanted")).slice(at, len(texts))
            at += len(texts)
            owner = np.repeat(np.arange(len(texts)), np.diff(wanted.offsets.to_numpy()))
            w = wanted.flatten()
            start, size = w.field("start").to_numpy(), w.field("len").to_numpy()
            fits = start.astype(np.int64) + size <= counts[owner] if len(owner) else np.zeros(0, bool)
            a = words.first[owner] + start
            # rows that share a doc_id may be other texts
            ok = np.flatnonzero(fits)
            ok = ok[signed(words.spans(a[ok], a[ok] + size[ok])) == w.field("seg").to_numpy()[ok]] if len(ok) else ok
            n = size[ok].astype(np.int64)
            flat = ids[np.repeat(a[ok] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(ok) else ids[:0]
            offsets = np.zeros(len(ok) + 1, np.int32)
            np.cumsum(n * 8, out=offsets[1:])
            blob = pa.Array.from_buffers(pa.binary(), len(ok), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])
            take = pa.array(ok)
            names = ["anchor", "start", "reps", "many"]
            yield pa.RecordBatch.from_arrays([*(w.field(c).take(take) for c in names), part.column(part.schema.get_field_index("doc_id")).take(pa.array(owner[ok])), blob], names=[*names, "doc_id", "words"])


class Bits:
    """A bit vector in words of 64. Of words of only zeros or only ones nothing is stored but the count of ones before them."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        pad = -(-n // 64) * 64 + 64
        packed = np.packbits(np.concatenate([bits, np.zeros(pad - n, np.uint8)]), bitorder="little").view(np.uint64)
        mixed = (packed != 0) & (packed != ~np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
        #: Where a word is stored: 0 are zeros, 1 are ones.
        self.at = np.where(mixed, np.cumsum(mixed) + 1, (packed != 0).astype(np.int64)).astype(np.int32)
        self.words = np.concatenate([np.array([0, ~np.uint64(0)], np.uint64), packed[mixed]])

    def size(self) -> int:
        return self.before.nbytes + self.at.nbytes + self.words.nbytes

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[self.at[block]] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FmIndex:
    """FM-index of segments. text: word numbers of all segments, each followed by a 0; label: the document of each place."""

    def __init__(self, text: np.ndarray, label: np.ndarray, sigma: int):
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.levels = n, max(1, int(sigma - 1).bit_length())
        self.starts = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.starts[1:])
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        seq = bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            ones = ((seq >> level) & 1).astype(bool)
            self.bits.append(Bits(ones.astype(np.uint8)))
            self.zeros.append(n - int(ones.sum()))
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.origin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))
        d = label[sa]
        change = np.flatnonzero(d[1:] != d[:-1]) + 1
        self.run_end = np.append(change, n)[np.searchsorted(change, np.arange(n), "right")].astype(np.int32)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i of each symbol's sequence comes to lie below all levels of the wavelet tree."""
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.rank(i)
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: intervals of symbol + pattern from those of the pattern."""
        base = self.starts[symbol] - self.origin[symbol]
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[: len(lo)], base + both[len(lo) :]

    def shared(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether an interval holds suffixes of two documents."""
        return (lo < hi) & (self.run_end[np.minimum(lo, self.n - 1)] < hi)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling over the places that are still tied, after as many words at once as fit a key. Zeros are separators,
    each smaller than the next; the last word is one."""
    n = len(text)
    rank = text.astype(np.int64)
    rank[text == 0] = np.arange((text == 0).sum())
    rank[text > 0] += (text == 0).sum()
    width = int(rank.max()).bit_length()
    h = min(n, 63 // max(1, width))
    key = rank.copy()
    for j in range(1, h):
        key <<= width
        key[: n - j] |= rank[j:]
    order = np.argsort(key)
    rank = key
    r = rank[order]
    first = np.ones(n, bool)
    first[1:] = r[1:] != r[:-1]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = np.ones(n, bool)
    tied[:-1] = ~first[1:]
    tied[-1] = False
    tied |= ~first
    slots = np.flatnonzero(tied)
    while len(slots):
        who = order[slots]
        key = rank[who] * np.int64(n + 1) + rank[np.minimum(who + h, n - 1)]
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))
        rank[who] = slots[at]
        alone = fresh & np.append(fresh[1:], True)
        slots = slots[~alone]
        h *= 2
    return order


def indexed(segments: list[np.ndarray], labels: np.ndarray) -> tuple[FmIndex, np.ndarray, np.ndarray]:
    """The index of segments, its text and the place of each segment in it."""
    return _indexed(np.concatenate(segments), np.array([len(s) for s in segments]), labels)


def _indexed(flat: np.ndarray, size: np.ndarray, labels: np.ndarray) -> tuple[FmIndex, np.ndarray, np.ndarray]:
    """The same of segments that lie one behind the other in flat."""
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=base[1:])
    text = np.zeros(base[-1], np.int64)
    names, inverse = np.unique(flat, return_inverse=True)
    inside = np.ones(len(text), bool)
    inside[base[1:] - 1] = False
    text[inside] = inverse.reshape(-1) + 1
    return FmIndex(text, np.repeat(labels, size + 1), len(names) + 1), text, base


def statistics(index: FmIndex, text: np.ndarray, start: np.ndarray, place: np.ndarray, most: int | None = None) -> np.ndarray:
    """Matching statistics: for each place of the text the words of the longest match that ends there, begins at start or
    later, and occurs under another label too; no more than most are counted."""
    out = np.zeros(len(place), np.int64)
    who = np.arange(len(place))
    pos = place.copy()
    lo, hi = np.zeros(len(place), np.int64), np.full(len(place), index.n)
    while len(who):
        c = text[pos]
        lo, hi = index.extend(c, lo, hi)
        ok = index.shared(lo, hi)
        out[who[ok]] += 1
        ok &= pos > start[who]
        if most is not None:
            ok &= out[who] < most
        who, pos, lo, hi = who[ok], pos[ok] - 1, lo[ok], hi[ok]
    return out


def shareable(flat: np.ndarray, size: np.ndarray, groups: np.ndarray, labels: np.ndarray, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the part of each segment that can hold a window of least words which a queried segment shares with
    another label of the group (0 where there is none): the run of words that a queried segment and two labels of the group
    have. Words are looked up by a hash in a table, so that two may be taken for one, which keeps more words and loses none.
    Segments are shorter than two windows: no more than one run is long enough."""
    owner = np.repeat(np.arange(len(size)), size)
    bits = max(10, int(len(flat) * 4).bit_length())
    at = np.arange(len(flat))
    # the second time without words that stood in runs too short
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        mine = owner[at]
        slot = (((flat[at] ^ mix(groups + np.uint64(1))[mine]) * np.uint64(factor)) >> np.uint64(64 - bits)).astype(np.int64)
        who = np.zeros(1 << bits, np.int32)
        who[slot] = labels[mine]
        kept = np.zeros(1 << bits, np.uint8)
        kept[slot[who[slot] != labels[mine]]] = 1
        asked = slot[query[mine]]
        kept[asked] |= 2 * kept[asked]
        at = at[kept[slot] == 3]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(at)))
        at = at[np.repeat(run >= least, run)]
    start, length = np.zeros(len(size), np.int64), np.bincount(owner[at], minlength=len(size))
    has = length > 0
    start[has] = at[(np.cumsum(length) - length)[has]] - (np.cumsum(size) - size)[has]
    return start, length


def repeated(flat: np.ndarray, size: np.ndarray, groups: np.ndarray, labels: np.ndarray, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each queried segment the first and the last start of a window of least words that occurs under another label
    (-1 where there is none). All windows of a segment have a word in common, so that what lies between is covered. Segments lie
    one behind the other in flat; a window that two segments share must be found if they are of one group."""
    low, high = np.full(len(size), -1), np.full(len(size), -1)
    cut, length = shareable(flat, size, groups, labels, query, least)
    kept = np.flatnonzero(length)
    if not query[kept].any():
        return low, high
    begin, n = (np.cumsum(size) - size + cut)[kept], length[kept]
    index, text, base = _indexed(flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n, labels[kept])
    alike = spans_hash(text.astype(np.uint64), np.arange(len(text) - least + 1), np.arange(least, len(text) + 1))

    def ending(place: np.ndarray) -> np.ndarray:
        """Statistics, up to least, of places with so many words before them; equal windows are looked up once."""
        _, one, which = np.unique(alike[place - least + 1], return_index=True, return_inverse=True)
        return statistics(index, text, place[one] - least + 1, place[one], least)[which.reshape(-1)]

    first, last = np.full(len(n), -1), np.full(len(n), -1)
    q = np.flatnonzero(query[kept])
    end = np.full(len(q), least - 1)
    # the first place whose statistic reaches least; one of m words keeps the next least - m - 1 places below it
    while len(q):
        m = ending(base[q] + end)
        hit = m >= least
        first[q[hit]] = end[hit]
        end = end + least - m
        go = ~hit & (end < n[q])
        q, end = q[go], end[go]
    # the last one: the far end, then the middle of what is left after the last place known to reach least; places below it
    # are passed over until one reaches least, or all up to the upper end are known not to
    q = np.flatnonzero(first >= 0)
    last[q] = first[q]
    q = q[n[q] > first[q] + 1]
    top = n[q] - 1
    end, below = top, top
    while len(q):
        m = ending(base[q] + end)
        hit = m >= least
        last[q[hit]] = end[hit]
        end = end + least - m
        none = ~hit & (end > top)
        top = np.where(none, below - 1, top)
        fresh = hit | none
        end = np.where(fresh, (last[q] + top + 1) // 2, end)
        below = np.where(fresh, end, below)
        go = last[q] < top
        q, top, end, below = q[go], top[go], end[go], below[go]
    found = first >= 0
    low[kept[found]] = cut[kept[found]] + first[found] - least + 1
    high[kept[found]] = cut[kept[found]] + last[found] - least + 1
    return low, high


def _search(least: int, shard_words: int):
    def shard(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables).combine_chunks()
        blobs = t["words"].to_pylist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        many = t["many"].to_numpy()
        _, label = np.unique(t["doc_id"].to_numpy(), return_inverse=True)
        label = np.where(many, -1 - np.arange(len(label)), label)
        low, high = repeated(np.frombuffer(b"".join(blobs), np.uint64), size, t["anchor"].to_numpy().view(np.uint64), label, ~many, least)
        found = np.flatnonzero(low >= 0)
        start = t["start"].to_numpy()[found].astype(np.int64)
        reps = t["reps"].to_numpy()[found]
        return pa.RecordBatch.from_arrays(
            [t["doc_id"].combine_chunks().take(pa.array(found)) if not isinstance(t["doc_id"], pa.Array) else t["doc_id"].take(pa.array(found)), pa.array(start + low[found]), pa.array(start + high[found] + least + reps - 1)],
            names=["doc_id", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column(0).to_numpy()
            size = np.diff(np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :][: batch.num_rows + 1]) // 8
            total = np.cumsum(size)
            at = 0
            edges = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != anchor[0] and n >= shard_words:
                yield shard(held)
                held, n = [], 0
            for e in edges.tolist():
                if n + total[e - 1] - (total[at - 1] if at else 0) >= shard_words:
                    held.append(batch.slice(at, e - at))
                    yield shard(held)
                    held, n, at = [], 0, e
            held.append(batch.slice(at))
            n += int(total[-1] - (total[at - 1] if at else 0))
        if held:
            yield shard(held)

    return run


def _windows(least: int):
    """The windows of least words of segments: hash, doc_id, start, end (of the last of a segment's repetitions) and many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, reps = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            many, ids, blobs = batch.column(3), batch.column(4), batch.column(5)
            for a in range(0, batch.num_rows, 2000):
                segs = [np.frombuffer(b, np.uint64) for b in blobs.slice(a, 2000).to_pylist()]
                flat = np.concatenate(segs)
                size = np.array([len(x) for x in segs])
                first = np.cumsum(size) - size
                n = np.maximum(size - least + 1, 0)
                owner = np.repeat(np.arange(len(segs)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h = spans_hash(flat, first[owner] + at, first[owner] + at + least)
                rows, begin = pa.array(owner + a), start[owner + a] + at
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), ids.take(rows), pa.array(begin), pa.array(begin + least + reps[owner + a] - 1), many.take(rows)], names=["window", "doc_id", "first", "last", "many"])

    return run


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """Per document the passages that occur in another document too: doc_id, first_word, last_word, n_words.

    A row is a maximal run of words covered by windows of min_words words that another doc_id's text holds as well. Null
    ids, null texts and texts of fewer words have none. Rows that repeat a doc_id are one document and don't repeat one
    another. Ties between anchors all count. An empty table gives an empty result; texts are read whole; extra columns
    are ignored, whatever their names.
    """
    if not 0 < anchor <= min_words:
        raise ValueError("anchor must be from 1 to min_words")
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    found = stored(docs.mapInArrow(_pass_one(min_words, anchor), "anchor long, seg long, doc_id long, start int, len int, reps int"), "anchors")
    # aggregates only, which are begun where the rows lie: an anchor or a segment may be in a large share of all documents
    per = found.groupBy("anchor", "seg").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.struct("doc_id", "start")).alias("lead"))
    per = stored(per, "segments")
    whole = per.groupBy("anchor").agg(F.min("a").alias("least"), F.max("b").alias("most"), F.count("*").alias("n"), F.max(F.expr("a = b")).alias("asked")).filter("least <> most")
    # an anchor whose segments are all in two documents as a whole has nothing to look up
    per = per.join(whole.select("anchor", (F.col("asked") & (F.col("n") > hot)).alias("hot"), "asked"), "anchor").select("anchor", "seg", (F.col("a") != F.col("b")).alias("many"), "lead", "hot", "asked")
    found = stored(found.join(per, ["anchor", "seg"]), "shared")
    whole = found.filter("many").select("doc_id", F.col("start").cast("long").alias("first"), (F.col("start").cast("long") + F.col("len") + F.col("reps") - 1).alias("last"))
    wanted = found.filter("not many or (asked and lead.doc_id = doc_id and lead.start = start)")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(F.when(F.col("hot"), None).otherwise(F.col("anchor")).alias("anchor"), "seg", "start", "len", "reps", "many")).alias("wanted"))
    segments = docs.join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(_segments, "anchor long, start int, reps int, many boolean, doc_id long, words binary")
    if per.filter("hot").isEmpty():
        cool, few = segments, None
    else:
        segments = stored(segments, "words")
        cool = segments.filter("anchor is not null")
        windows = stored(segments.filter("anchor is null").mapInArrow(_windows(min_words), "window long, doc_id long, first long, last long, many boolean"), "windows")
        twice = windows.groupBy("window").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max("many").alias("many")).filter("a <> b or many").select("window")
        few = windows.join(twice, "window", "left_semi").select("doc_id", "first", "last")
    part = cool.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search(min_words, shard_words), "doc_id long, first long, last long")
    spans = whole.union(part) if few is None else whole.union(part).union(few)
    w = W.partitionBy("doc_id").orderBy("first", "last")
    spans = spans.withColumn("__end", F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("__run", F.sum(F.when(F.col("first") <= F.col("__end"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "__run").agg(F.min("first").alias("first_word"), (F.max("last") - 1).alias("last_word"))
    return spans.select("doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word") + 1).alias("n_words"))
