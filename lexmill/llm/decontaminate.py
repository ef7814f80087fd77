"""Benchmark decontamination by word windows.

The windows of N words of all benchmark items form a set of 64-bit hashes that every executor gets; each document's
windows are looked up in it, hits are verified word by word, and the covered words become spans. A document of which
more than MAX_SHARE of the words is covered goes as a whole, from others the spans are cut.

The set is arrays only: sorted hashes, each with its place in the items' words, which lie as one text to verify hits by. It
takes about 5 bytes a character of benchmark. It is built from at most SLICE_CHARS characters; a larger benchmark is taken in
slices of that size, one pass over the documents each, so that the broadcast never grows with the benchmark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frame import stored, tidy
from ._words import Words, cuts

N, MIN_WORDS, MAX_SHARE, SLICE_CHARS = 8, 5, 0.5, 32_000_000
#: Characters of items that are turned into words at once.
_BUILD_CHARS = 2_000_000
_SPANS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint,item_id:bigint>>"
_HITS = f"struct<words:bigint,spans:{_SPANS},rest:string>"
_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "end", "item_id")])


class Grams:
    """Windows of benchmark items: by length the sorted hashes, and the first word and least item of each.

    The items' words lie in one text, in lower case and apart by spaces; word i is at begins[i]. Windows of equal words are
    one; windows that share their hash but not their words all stay.
    """

    def __init__(self, items: list[tuple[int, str]], n: int, min_words: int):
        texts, begins, hashes, rows = [], [], [], []
        words, chars = 0, 0
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        at = 0
        while at < len(items):
            to, size = at, 0
            while to < len(items) and (to == at or size + len(items[to][1]) <= _BUILD_CHARS):
                size += len(items[to][1])
                to += 1
            w = Words([t for _, t in items[at:to]])
            own, places = w.joined()
            texts.append(own)
            begins.append(places + chars)
            hashes.append(w.hash)
            rows.append(w.row + at)
            counts = w.counts()
            for k in {n} | {int(c) for c in np.unique(counts) if min_words <= c < n}:
                first, h = w.windows(k)
                if k < n:
                    whole = counts[w.row[first]] == k
                    first, h = first[whole], h[whole]
                if len(first):
                    found.setdefault(k, []).append((first + words, h))
            words, chars, at = words + len(w), chars + len(own), to
        self.text = b"".join(texts)
        self.begins = np.concatenate([*begins, [chars]]).astype(np.int64 if chars >> 31 else np.int32) if begins else np.zeros(1, np.int32)
        word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        ids = np.array([i for i, _ in items], np.int64)
        item = ids[np.concatenate(rows)] if rows else ids
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, parts in sorted(found.items()):
            first, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((item[first], h))
            first, h = first[order], h[order]
            lead = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            of = np.repeat(lead, np.diff(np.append(lead, len(h))))
            same = np.ones(len(h), bool)
            for j in range(k):
                same &= word[first + j] == word[first[of] + j]
            keep = ~same
            keep[lead] = True
            first, h = first[keep], h[keep]
            seen = np.zeros(1 << 16, bool)
            seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.sets[k] = (h, seen, first.astype(np.int32 if words >> 31 == 0 else np.int64), item[first])

    def size(self) -> int:
        """Bytes of all arrays."""
        return len(self.text) + self.begins.nbytes + sum(x.nbytes for s in self.sets.values() for x in s)

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Number of words of each text, and its covered spans."""
        words = Words(texts)
        out: list[list[dict]] = [[] for _ in texts]
        hits: list[tuple[int, int, int]] = []
        for size, (known, seen, first, items) in self.sets.items():
            at, h = words.windows(size)
            maybe = seen[(h & np.uint64(0xFFFF)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            place = np.searchsorted(known, h)
            same = known[np.minimum(place, len(known) - 1)] == h
            for a, i in zip(at[same].tolist(), place[same].tolist(), strict=True):
                gram = " ".join([words.word(j) for j in range(a, a + size)]).encode("utf-8", "surrogatepass") + b" "
                x, found = known[i], None
                while i < len(known) and known[i] == x:
                    w = int(first[i])
                    if self.text[self.begins[w] : self.begins[w + size]] == gram:
                        found = int(items[i]) if found is None else min(found, int(items[i]))
                    i += 1
                if found is not None:
                    hits.append((a, a + size, found))
        for a, b, item in sorted(hits):
            r, base = int(words.row[a]), int(words.first[words.row[a]])
            last = out[r][-1] if out[r] else None
            if last and a - base <= last["last_word"] + 1:
                last["item_id"] = min(last["item_id"], item)
                if b - base - 1 > last["last_word"]:
                    last |= {"last_word": b - base - 1, "end": int(words.end[b - 1])}
            else:
                out[r].append({"first_word": a - base, "last_word": b - base - 1, "start": int(words.start[a]), "end": int(words.end[b - 1]), "item_id": item})
        return words.counts(), out


def _scanner(grams, text: Column) -> Column:
    @F.arrow_udf(_HITS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g: Grams = grams.value
        for batch in batches:
            counts, spans, rest = [], [], []
            for a, b in cuts(batch):
                texts = batch.slice(a, b - a).to_pylist()
                c, found = g.scan(texts)
                counts.append(c)
                spans += found
                rest += [_without(t, f) if f else None for t, f in zip(texts, found, strict=True)]
            words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            yield pa.StructArray.from_arrays([words, pa.array(spans, pa.list_(_SPAN)), pa.array(rest, pa.string())], names=["words", "spans", "rest"])

    # evaluated once, though both a filter and a projection look at it
    return run.asNondeterministic()(text)


def _merge(spans: pa.Array) -> pa.Array:
    """Overlapping and touching spans of several slices as one."""
    out = []
    for row in spans.to_pylist():
        got: list[dict] = []
        for s in sorted(row or [], key=lambda s: (s["first_word"], s["last_word"])):
            if got and s["first_word"] <= got[-1]["last_word"] + 1:
                got[-1]["item_id"] = min(got[-1]["item_id"], s["item_id"])
                if s["last_word"] > got[-1]["last_word"]:
                    got[-1] |= {"last_word": s["last_word"], "end": s["end"]}
            else:
                got.append(s)
        out.append(got)
    return pa.array(out, pa.list_(_SPAN))


def _without(text: str, spans: list[dict]) -> str:
    at, kept = 0, []
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*kept, text[at:]])


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_without(t, s) if s else None for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def scanned(docs: DataFrame, benchmark: DataFrame, n: int, min_words: int, slice_chars: int) -> DataFrame:
    """docs with column __hit."""
    bench, _ = tidy(benchmark, {"item_id": "long", "text": "string"})
    bench = bench.select("item_id", "text").filter("item_id is not null and text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(chars / slice_chars))
    sc = docs.sparkSession.sparkContext
    for i in range(slices):
        part = bench if slices == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        grams = sc.broadcast(Grams([tuple(r) for r in part.collect()], n, min_words))
        hit = _scanner(grams, F.col("text"))
        if slices == 1:
            return docs.withColumn("__hit", hit)
        docs = docs.withColumn("__new", hit)
        spans = F.concat("__hit.spans", "__new.spans") if i else F.col("__new.spans")
        docs = stored(docs.withColumn("__hit", F.struct(F.col("__new.words"), spans.alias("spans"))).drop("__new"), "scanned")
    spans = F.arrow_udf(_merge, _SPANS)(F.col("__hit.spans"))
    docs = stored(docs.withColumn("__hit", F.struct(F.col("__hit.words"), spans.alias("spans"))), "scanned")
    return docs.withColumn("__hit", F.col("__hit").withField("rest", F.arrow_udf(_cut, "string")("text", "__hit.spans")))


def _covered() -> Column:
    return F.aggregate("__hit.spans", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """One row per contaminated span: doc_id, first_word, last_word, n_words, item_id (least matching item), doc_words,
    action ("drop document" or "cut span").

    Items of fewer than n words match as a whole; of fewer than min_words, with a null id or text, never. Null and empty
    texts have no spans. Null ids and repeated rows are scanned like others. Empty tables give an empty result; texts
    are read whole; extra columns are ignored.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})
    out = scanned(docs.select("doc_id", "text"), benchmark, n, min_words, slice_chars).filter(F.size("__hit.spans") > 0)
    out = out.withColumn("action", F.when(_covered() > F.lit(max_share) * F.col("__hit.words"), "drop document").otherwise("cut span"))
    out = out.select("doc_id", F.col("__hit.words").alias("doc_words"), "action", F.explode("__hit.spans").alias("s"))
    return out.select("doc_id", "s.first_word", "s.last_word", F.expr("s.last_word - s.first_word + 1").alias("n_words"), "s.item_id", "doc_words", "action")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """The documents without contaminated ones, and without contaminated spans in the rest; there n_chars is counted anew.

    All other rows and columns stay as they were: null, empty and blank texts, rows without an id, repeated rows, extra
    columns of whatever name. Items match as in contaminated(). Empty documents give an empty result, an empty benchmark
    takes nothing away; texts are read whole.
    """
    inner, back = tidy(docs, {"doc_id": "long", "text": "string", "n_chars": "long"})
    out = scanned(inner, benchmark, n, min_words, slice_chars)
    out = out.filter(F.coalesce(_covered() <= F.lit(max_share) * F.col("__hit.words"), F.lit(True)))
    cut = F.col("__hit.rest")
    return back(out.withColumns({"text": F.coalesce(cut, "text"), "n_chars": F.when(cut.isNotNull(), F.length(cut).cast("long")).otherwise(F.col("n_chars"))}))
