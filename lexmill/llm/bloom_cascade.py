"""URL filters by a cascade of Bloom filters.

Over the complete set of a corpus's keys, level 1 encodes the listed keys, level 2 the other keys that level 1 takes for
listed, level 3 the listed keys that level 2 takes for others, and so on until a level has no false positive. Walking
the levels answers membership exactly for every key of the corpus, without a join (Larisch et al., CRLite).

Keys stand as two hashes of 64 bits with seeds of their own. Where a listed key and another one share both, all keys are
hashed anew with other seeds, so that the levels can tell any two keys apart. A level from the third on that has LAST keys
or fewer holds their hashes themselves, has no false positive, and is the last one.

Keys are dealt by hash over shards of SHARD_KEYS, each with a cascade of its own. All shards' levels are built together, by
aggregating 64-bit words of the bit arrays. To look keys up, the cascades go to all executors where they take no more than
MAX_BYTES together; where they take more, rows go to their shard's cascade, SALTS ways so that a frequent key is no one
task's. Either way the answer is the cascade's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frame import stored, tidy
from ._words import mix

MAX_BYTES, SHARD_KEYS, LAST, SALTS = 64_000_000, 4_000_000, 128, 32
#: Registered names, without the part before and the top-level domain, whose pages a list of unwanted sites holds.
UNWANTED = ("cheap-pills", "spam-farm", "casino-win", "free-bets", "ads-track", "adult-x")
_BITS = "shard int, word long, bits long"


def url_key(url: Column) -> Column:
    """Host without port and a leading www., and path without a trailing slash; no scheme, query or fragment."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    bare = F.regexp_replace(bare, r"^([^/:]*):[0-9]+", "$1")
    return F.regexp_replace(bare, r"/+$", "")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url_key(url), r"^[^/]*", 0)


class Level:
    """A Bloom filter of m bits and k hashes, or for few keys the keys' hashes; salt tells levels apart."""

    def __init__(self, keys: int, share: float, salt: int, listed: bool = False):
        m = max(64, math.ceil(-keys * math.log(share) / math.log(2) ** 2))
        self.m, self.salt, self.listed = -(-m // 64) * 64, salt, listed
        self.k = max(1, round(self.m / max(keys, 1) * math.log(2)))
        self.size = 16 * keys if listed else self.m // 8
        self.bits: np.ndarray | None = None

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Bits of each key, keys by hashes."""
        s = np.uint64((self.salt * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        b = mix(h2 + s)
        a, b = mix(h1 ^ b), b | np.uint64(1)
        return (a[:, None] + np.arange(self.k, dtype=np.uint64) * b[:, None]) % np.uint64(self.m)

    def words(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the bit array, and the bits that the keys set in them; of a list the hashes."""
        if self.listed:
            return h1.view(np.int64), h2.view(np.int64)
        p = np.unique(self.places(h1, h2).reshape(-1))
        word, first = np.unique(p >> np.uint64(6), return_index=True)
        bit = np.uint64(1) << (p & np.uint64(63))
        return word.astype(np.int64), (np.bitwise_or.reduceat(bit, first) if len(p) else bit).view(np.int64)

    def put(self, word: np.ndarray, bits: np.ndarray) -> None:
        """Take words as words() gives them; of one word several rows may come."""
        if self.listed:
            own = np.stack([word, bits], 1).view(np.uint64)
            self.bits = own if self.bits is None else np.concatenate([self.bits, own])
            return
        if self.bits is None:
            self.bits = np.zeros(self.m // 64, np.uint64)
        np.bitwise_or.at(self.bits, word, bits.view(np.uint64))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(h1), bool)
        if self.listed:
            out = np.zeros(len(h1), bool)
            for a, b in self.bits:
                out |= (h1 == a) & (h2 == b)
            return out
        p = self.places(h1, h2)
        return ((self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


def lookup(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of keys of the corpus."""
    listed = np.zeros(len(h1), bool)
    rest = np.arange(len(h1))
    for i, level in enumerate(levels):
        has = level.has(h1[rest], h2[rest])
        listed[rest[~has]] = i % 2 == 1
        rest = rest[has]
    listed[rest] = len(levels) % 2 == 1
    return listed


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """value, start and end of each run of equal values."""
    edge = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a < b:
            yield int(x[a]), a, b


def _fill(keys: DataFrame, levels: dict[int, Level]) -> DataFrame:
    """Words of all shards' bit arrays for one level. keys: shard, h1, h2."""
    lists = {s for s, x in levels.items() if x.listed}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, h1, h2 = _longs(batch, "shard"), _longs(batch, "h1").view(np.uint64), _longs(batch, "h2").view(np.uint64)
            order = np.argsort(shard, kind="stable")
            for s, a, b in _runs(shard[order]):
                own = order[a:b]
                w, bits = levels[s].words(h1[own], h2[own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), s, np.int32)), pa.array(w), pa.array(bits)], names=["shard", "word", "bits"])

    found = keys.mapInArrow(words, _BITS)
    if not lists:
        return found.groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    rows = F.col("shard").isin(*lists)
    return found.filter(~rows).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits")).unionByName(found.filter(rows))


def _streamed(levels: list[dict[int, Level]], last: int, answer):
    """A function over batches (shard, __kind, h1, h2, ...) sorted by group and kind: rows of kind below last are words of
    that level, the others keys, which answer(cascade, h1, h2, batch) turns into a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        at, own = None, []
        for batch in batches:
            group = _longs(batch, "__group")
            for g, a, b in _runs(group):
                part = batch.slice(a, b - a)
                if g != at:
                    s = int(_longs(part, "shard")[0])
                    at, own = g, [copy.copy(x[s]) for x in levels if s in x]
                kind = _longs(part, "__kind")
                for k, c, d in _runs(kind):
                    piece = part.slice(c, d - c)
                    if k < last:
                        own[k].put(_longs(piece, "h1"), _longs(piece, "h2"))
                    else:
                        yield answer(own, _longs(piece, "h1").view(np.uint64), _longs(piece, "h2").view(np.uint64), piece)

    return run


class Cascade:
    """Levels by shard, and the table (shard, level, word, bits) of what is in them."""

    def __init__(self, shards: int, seed: int):
        self.shards, self.seed = shards, seed
        self.levels: list[dict[int, Level]] = []
        self.tables: list[DataFrame] = []

    def size(self) -> int:
        return sum(x.size for level in self.levels for x in level.values())

    def bits(self) -> DataFrame:
        out = self.tables[0].withColumn("level", F.lit(0))
        for i, t in enumerate(self.tables[1:], 1):
            out = out.unionByName(t.withColumn("level", F.lit(i)))
        return out

    def loaded(self) -> dict[int, list[Level]]:
        """All levels with their bits, on the driver: for cascades of a checked size."""
        for level, table in zip(self.levels, self.tables, strict=True):
            got = table.toArrow().combine_chunks()
            shard, word, bits = (got[c].to_numpy() for c in ("shard", "word", "bits"))
            order = np.argsort(shard, kind="stable")
            for s, a, b in _runs(shard[order]):
                level[s].put(word[order[a:b]], bits[order[a:b]])
        return {s: [x[s] for x in self.levels if s in x] for s in (self.levels[0] if self.levels else ())}


def hashed(key: Column, seed: int = 0) -> list[Column]:
    """Two hashes of a key, neither of which follows from the other."""
    return [F.xxhash64(F.lit(2 * seed), key).alias("h1"), F.xxhash64(F.lit(2 * seed + 1), key).alias("h2")]


def distinct_hashes(keys: DataFrame, seeds: int = 16, hashes=hashed) -> tuple[DataFrame, int]:
    """shard-less universe (h1, h2, listed) of distinct keys (key, listed), and the seed under which no listed key shares
    its hashes with another one. Keys that are on the same side may share theirs."""
    for seed in range(seeds):
        universe = stored(keys.select(*hashes(F.col("key"), seed), "listed"), "universe")
        clash = universe.groupBy("h1", "h2").agg((F.min("listed") != F.max("listed")).alias("both")).filter("both")
        if clash.isEmpty():
            return universe, seed
    raise ValueError("listed and other keys share their hashes under all seeds")


def build(universe: DataFrame, seed: int = 0, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascades of a table of keys (h1, h2, listed) in which no listed key has the hashes of another."""
    n = universe.count()
    out = Cascade(max(1, -(-n // shard_keys)), seed)
    universe = universe.withColumn("shard", F.pmod("h1", F.lit(out.shards)).cast("int"))
    counts: dict[int, dict[bool, int]] = {}
    for r in universe.groupBy("shard", "listed").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["shard"], {})[r["listed"]] = r["n"]
    encode, check = (universe.filter(c).select("shard", "h1", "h2") for c in ("listed", "not listed"))
    todo = {s: c[True] for s, c in counts.items() if c.get(True)}
    while todo:
        i = len(out.levels)
        share = {s: min(0.5, todo[s] / (max(counts[s].get(False, 0), 1) * math.sqrt(2))) if i == 0 else 0.5 for s in todo}
        levels = {s: Level(c, share[s], i, i >= 2 and c <= LAST) for s, c in todo.items()}
        table = stored(_fill(encode.filter(F.col("shard").isin(*levels)), levels), "cascade")
        out.levels.append(levels)
        out.tables.append(table)

        def passing(own, h1, h2, piece):
            # only this level's words came with the keys
            keep = pa.array(own[0].has(h1, h2))
            return pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)).filter(keep) for c in ("shard", "h1", "h2")], names=["shard", "h1", "h2"])

        words = table.select("shard", F.lit(0).alias("__kind"), F.col("word").alias("h1"), F.col("bits").alias("h2"))
        keys = check.filter(F.col("shard").isin(*levels)).select("shard", F.lit(1).alias("__kind"), "h1", "h2")
        if out.shards == 1:
            # one shard's keys are spread over all tasks, each with the level, which is no larger than a shard's may be
            one = levels[0]
            got = table.toArrow()
            one.put(got["word"].to_numpy(), got["bits"].to_numpy())
            sent = universe.sparkSession.sparkContext.broadcast(one)
            one.bits = None

            def alone(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(sent.value.has(_longs(b, "h1").view(np.uint64), _longs(b, "h2").view(np.uint64))))

            passed = check.mapInArrow(alone, "shard int, h1 long, h2 long")
        else:
            mixed = words.unionByName(keys).withColumn("__group", F.col("shard"))
            passed = mixed.repartition("shard").sortWithinPartitions("shard", "__kind").mapInArrow(_streamed([levels], 1, passing), "shard int, h1 long, h2 long")
        false = stored(passed, "cascade")
        encode, check = false, encode
        todo = {r["shard"]: r["n"] for r in false.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return out


def url_filter(pages: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """page_id, url and listed (whether the page's key is a key of the list) for every row of pages.

    listed has a column key, in the form that url_key() gives. Null urls are not listed; null keys are ignored. Null ids
    and repeated rows are answered like others. Empty pages give an empty result, an empty list lists nothing. Extra
    columns are ignored, whatever their names; urls are read whole. The answer is exact.
    """
    pages, _ = tidy(pages, {"page_id": "long", "url": "string"})
    listed, _ = tidy(listed, {"key": "string"})
    keyed = pages.select("page_id", "url", url_key(F.col("url")).alias("key"))
    # one side says that a key is the corpus's, the other that it is the list's
    both = keyed.select("key", F.lit(True).alias("here"), F.lit(False).alias("on")).unionByName(listed.select("key", F.lit(False).alias("here"), F.lit(True).alias("on")))
    both = both.filter("key is not null").groupBy("key").agg(F.max("here").alias("here"), F.max("on").alias("listed")).filter("here").select("key", "listed")
    universe, seed = distinct_hashes(both)
    cascade = build(universe, seed, shard_keys)
    if not cascade.levels:
        return keyed.select("page_id", "url", F.lit(False).alias("listed"))
    keyed = keyed.select("page_id", "url", F.col("key").isNotNull().alias("__has"), *hashed(F.col("key"), seed))
    shards = cascade.shards
    if cascade.size() <= max_bytes:
        sent = pages.sparkSession.sparkContext.broadcast(cascade.loaded())

        @F.arrow_udf("boolean")
        def member(h1: pa.Array, h2: pa.Array) -> pa.Array:
            a, b = (x.to_numpy(zero_copy_only=False) for x in (h1, h2))
            out = np.zeros(len(a), bool)
            shard = a % shards
            for s, levels in sent.value.items():
                own = np.flatnonzero(shard == s) if shards > 1 else np.arange(len(a))
                out[own] = lookup(levels, a[own].view(np.uint64), b[own].view(np.uint64))
            return pa.array(out)

        return keyed.select("page_id", "url", (F.col("__has") & member("h1", "h2")).alias("listed"))
    last = len(cascade.levels)

    def answer(own, h1, h2, piece):
        has = pa.array(lookup(own, h1, h2) & _longs(piece, "__has").astype(bool))
        return pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("page_id")), piece.column(piece.schema.get_field_index("url")), has], names=["page_id", "url", "listed"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    words = cascade.bits().select("shard", F.col("level").alias("__kind"), F.col("word").alias("h1"), F.col("bits").alias("h2"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(False).alias("__has"), salts)
    rows = keyed.select(F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.lit(last).alias("__kind"), "h1", "h2", "page_id", "url", "__has", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("__salt"))
    mixed = words.unionByName(rows).withColumn("__group", F.col("shard") * SALTS + F.col("__salt"))
    sorted_ = mixed.repartition("__group").sortWithinPartitions("__group", "__kind")
    return sorted_.mapInArrow(_streamed(cascade.levels, last, answer), "page_id long, url string, listed boolean")


def keys_of_sites(pages: DataFrame, names: tuple[str, ...] = UNWANTED) -> DataFrame:
    """The distinct keys of all pages on sites of the given registered names: a list to filter by.

    Null urls have no key. Null ids and repeated rows count like others; empty pages give an empty list; urls of any length
    are read whole; extra columns are ignored.
    """
    pages, _ = tidy(pages, {"page_id": "long", "url": "string"})
    site = F.regexp_extract(url_host(F.col("url")), r"([^.]+)\.example\.[a-z]+$", 1)
    return pages.filter(site.isin(*names)).select(url_key(F.col("url")).alias("key")).distinct()
