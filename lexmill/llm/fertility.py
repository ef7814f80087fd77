"""Quality rules from tokeniser fertility.

Public vocabularies measure a text: characters per token under two of them, the share of byte-fallback tokens and the
entropy of its tokens. For each language (or, where none is given, script) and size class the documents themselves say
what is usual: the band around the median of each measure is TOLERANCE robust deviations wide. A text outside a band is
rejected. A size class of too few documents is judged by the next size classes of its language as well, as many as it takes,
and where the language has too few in all by those of all languages; where the whole table has too few, by the fixed bands
of FALLBACK. So every text with a token is judged.

Words are encoded one by one, each distinct word once per worker while the word cache has room; emptying it changes no
result. A stretch without spaces, as in scripts that use none, is taken in runs of at most RUN characters, each a word. Bands
come from exact histograms over all documents.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._frame import stored, tidy
from ._words import cuts

TOKENIZERS = "/opt/tokenizers"
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
TOLERANCE, MIN_GROUP, MIN_TOKENS = 6.0, 50, 1
#: Histogram steps per unit, least robust deviation, and which side of the band rejects (-1 below, 1 above).
MEASURES = {"chars_per_token": (128, 0.04, (-1, 1)), "chars_per_byte_token": (128, 0.06, (-1, 1)), "byte_share": (1024, 0.01, (1,)), "entropy": (128, 0.08, (-1,))}
#: Bands of a table of too few documents to say what is usual: no text that is written in any language is outside them.
FALLBACK = {"chars_per_token": (0.4, 12.0), "chars_per_byte_token": (0.3, 12.0), "byte_share": (-math.inf, 0.6), "entropy": (-math.inf, math.inf)}
METRICS = "n_tokens long, chars_per_token double, chars_per_byte_token double, byte_share double, entropy double"
RUN, CACHE_BYTES = 64, 24_000_000
#: What a cached word takes beside its characters and token numbers.
_ENTRY = 260
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_encoding(path: str):
    """A tiktoken encoding from a file of ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(Path(path).name, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _models(folder: str):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
    ranks = rank_encoding(f"{folder}/{BYTES}")
    spaced = np.array([ranks.decode_single_token_bytes(i)[:1] == b" " for i in range(ranks.n_vocab)])
    return pieces, is_byte, ranks, spaced, {}, [0]


def measure(texts: list[str | None], folder: str) -> tuple[np.ndarray, ...]:
    """n_tokens, chars_per_token, chars_per_byte_token, byte_share, entropy of each text; zeros where there is no word."""
    pieces, is_byte, ranks, spaced, cache, used = _models(folder)
    split = [(t or "").split() for t in texts]
    every = list(chain.from_iterable(split))
    index = {w: i for i, w in enumerate(dict.fromkeys(every))}
    if index and max(map(len, index)) > RUN:
        split = [[w[a : a + RUN] for w in words for a in range(0, len(w), RUN)] for words in split]
        every = list(chain.from_iterable(split))
        index = {w: i for i, w in enumerate(dict.fromkeys(every))}
    n_words = np.array(list(map(len, split)), np.int64)
    if not index:
        z = np.zeros(len(texts))
        return n_words, z, z, z, z
    new = [w for w in index if w not in cache]
    # a token that begins with a space is a word's first one
    other = np.bincount(np.cumsum(spaced[ranks.encode_ordinary(" " + " ".join(new))]) - 1).tolist() if new else []
    for w, ids, n in zip(new, pieces.encode(new, num_threads=1), other, strict=True):
        cache[w] = (array("i", ids).tobytes(), n)
        used[0] += _ENTRY + 4 * len(w) + 4 * len(ids)
    known = [cache[w] for w in index]
    if used[0] > CACHE_BYTES:
        cache.clear()
        used[0] = 0
    lens = np.array([len(k[0]) // 4 for k in known])
    flat = np.frombuffer(b"".join([k[0] for k in known]), np.int32)
    first = np.cumsum(lens) - lens
    other, chars = np.array([k[1] for k in known]), np.array(list(map(len, index)))
    code = np.fromiter(map(index.__getitem__, every), np.int64, len(every))
    row = np.repeat(np.arange(len(texts)), n_words)
    total = lambda x: np.bincount(row, x[code], len(texts))
    n, n_chars, n_other = total(lens), total(chars), total(other)
    size = lens[code]
    at = np.repeat(first[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    token, owner = flat[at], np.repeat(row, size)
    fallback = np.bincount(owner, is_byte[token], len(texts))
    key, times = np.unique(owner * len(is_byte) + token, return_counts=True)
    whole = np.maximum(n, 1)
    p = times / whole[key // len(is_byte)]
    entropy = np.bincount(key // len(is_byte), -p * np.log2(p), len(texts)) + 0.0
    return n.astype(np.int64), n_chars / whole, n_chars / np.maximum(n_other, 1), fallback / whole, entropy


def _metrics(text: Column, folder: str) -> Column:
    @F.arrow_udf(f"struct<{METRICS.replace(' long', ':bigint').replace(' double', ':double')}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in METRICS.split(", ")]
        for batch in batches:
            out = [measure(batch.slice(a, b - a).to_pylist(), folder) for a, b in cuts(batch)]
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] + [np.zeros(0)] * 4
            yield pa.StructArray.from_arrays([pa.array(c) for c in cols], names=names)

    return run(text)


def _script(text: Column) -> Column:
    """The script that most letters of a text belong to, for texts without a language."""
    share = [(s, F.length(F.regexp_replace(text, rf"[^\p{{Is{s}}}]", ""))) for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Hangul", "Thai")]
    most = F.greatest(*(n for _, n in share))
    out = F.lit("script:other")
    for s, n in reversed(share):
        out = F.when((n == most) & (n > 0), F.lit(f"script:{s}")).otherwise(out)
    return out


def measured(docs: DataFrame, folder: str) -> DataFrame:
    key = F.when(F.trim("lang") != "", F.lower(F.trim("lang"))).otherwise(_script(F.coalesce("text", F.lit(""))))
    out = docs.withColumns({"__m": _metrics(F.col("text"), folder), "__band": key})
    return out.withColumn("__size", F.floor(F.log2(F.greatest(F.col("__m.n_tokens"), F.lit(1)).cast("double"))).cast("int"))


def pools(sizes: DataFrame, min_group: int) -> DataFrame:
    """For each (__band, __size), a row for each (from, size) whose documents judge it: the size classes up to the least
    distance that holds min_group documents, of the language or, where that never does, of all (from is null).
    A table of fewer documents than that has no rows and is judged by FALLBACK. sizes: __band, __size, n."""
    every = sizes.groupBy(F.lit(None).cast("string").alias("from"), F.col("__size").alias("size")).agg(F.sum("n").alias("n"))
    here = sizes.select("__band", "__size")
    own = here.join(sizes.select("__band", F.col("__band").alias("from"), F.col("__size").alias("size"), "n"), "__band")
    each = own.unionByName(here.crossJoin(F.broadcast(every))).withColumn("far", F.abs(F.col("size") - F.col("__size")))
    w = W.partitionBy("__band", "__size", F.isnull("from"))
    each = each.withColumn("total", F.sum("n").over(w.orderBy("far").rangeBetween(W.unboundedPreceding, W.currentRow)))
    each = each.withColumn("reach", F.min(F.when(F.col("total") >= min_group, F.col("far"))).over(w))
    each = each.withColumn("own", F.max(F.col("from").isNotNull() & F.col("reach").isNotNull()).over(W.partitionBy("__band", "__size")))
    return each.filter((F.col("far") <= F.col("reach")) & (F.col("own") == F.col("from").isNotNull())).select("__band", "__size", "from", "size")


def bands(measures: DataFrame, tolerance: float, min_group: int, min_tokens: int) -> DataFrame:
    """(__band, __size) with the lowest and highest histogram step that each measure may take, by the documents of pools()."""
    steps = [F.struct(F.lit(m).alias("m"), F.round(F.col(f"__m.{m}") * s).cast("long").alias("x")) for m, (s, _, _) in MEASURES.items()]
    hist = measures.filter(F.col("__m.n_tokens") >= min_tokens).select("__band", "__size", F.explode(F.array(*steps)).alias("h"))
    hist = stored(hist.groupBy("__band", "__size", "h.m", "h.x").agg(F.count("*").alias("n")), "histogram")
    by = stored(pools(hist.filter(F.col("m") == next(iter(MEASURES))).groupBy("__band", "__size").agg(F.sum("n").alias("n")), min_group), "pools")
    every = hist.groupBy(F.lit(None).cast("string").alias("from"), F.col("__size").alias("size"), "m", "x").agg(F.sum("n").alias("n"))
    parts = hist.select(F.col("__band").alias("from"), F.col("__size").alias("size"), "m", "x", "n")
    own = by.filter("from is not null").join(parts, ["from", "size"])
    rest = by.filter("from is null").drop("from").join(every.drop("from"), "size")
    # a text is at most one bit richer than its halves
    extra = F.when(F.col("m") == "entropy", F.greatest(F.col("size") - F.col("__size"), F.lit(0)) * MEASURES["entropy"][0]).otherwise(0)
    pooled = own.drop("from").unionByName(rest).withColumn("x", F.col("x") - extra)
    hist = stored(pooled.groupBy("__band", "__size", "m", "x").agg(F.sum("n").alias("n")), "pooled")
    group = ["__band", "__size", "m"]

    def middle(h: DataFrame, x: str, name: str) -> DataFrame:
        w = W.partitionBy(*group)
        h = h.withColumns({"__c": F.sum("n").over(w.orderBy(x)), "__t": F.sum("n").over(w)})
        return h.filter(F.col("__c") * 2 >= F.col("__t")).groupBy(*group).agg(F.min(x).alias(name))

    med = middle(hist, "x", "mid")
    away = hist.join(med, group).withColumn("d", F.abs(F.col("x") - F.col("mid"))).groupBy(*group, "mid", "d").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*group)
    away = away.withColumns({"__c": F.sum("n").over(w.orderBy("d")), "__t": F.sum("n").over(w)}).filter(F.col("__c") * 2 >= F.col("__t"))
    wide = away.groupBy(*group).agg(F.min("d").alias("mad"), F.first("mid").alias("mid"))
    cols = []
    for m, (s, least, sides) in MEASURES.items():
        here = F.col("m") == m
        reach = tolerance * F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(least * s))
        for side, label in ((-1, "lo"), (1, "hi")):
            edge = F.col("mid") + side * reach if side in sides else F.lit(side * math.inf)
            cols.append(F.max(F.when(here, edge)).alias(f"__{label}_{m}"))
    return wide.groupBy("__band", "__size").agg(*cols)


def judged(docs: DataFrame, folder: str, tolerance: float, min_group: int, min_tokens: int, unneeded: tuple[str, ...] = ()) -> DataFrame:
    rows = stored(measured(docs, folder).drop(*unneeded), "measured")
    out = rows.join(F.broadcast(bands(rows, tolerance, min_group, min_tokens)), ["__band", "__size"], "left")
    why = []
    for m, (s, _, _) in MEASURES.items():
        x = F.round(F.col(f"__m.{m}") * s)
        low, high = (F.coalesce(F.col(f"__{side}_{m}"), F.lit(edge * s)) for side, edge in zip(("lo", "hi"), FALLBACK[m], strict=True))
        why.append(F.when(x < low, F.lit(f"{m} low")).when(x > high, F.lit(f"{m} high")))
    why = F.when(F.col("__m.n_tokens") >= min_tokens, F.array_compact(F.array(*why))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("__why", F.when(F.col("__m.n_tokens") == 0, F.array(F.lit("empty"))).otherwise(why))


def fertility(docs: DataFrame, folder: str = TOKENIZERS, tolerance: float = TOLERANCE, min_group: int = MIN_GROUP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per document: doc_id, band, the measures, why (what is out of its band) and keep.

    Null and empty texts, and those of white space only, are rejected as "empty". A language and size class of fewer than
    min_group documents is judged together with its next ones; a table of fewer documents than that by FALLBACK. Texts of fewer than min_tokens tokens would be kept; by
    default there are none.
    A null or blank lang is replaced by the script. Null ids and repeated rows are measured like any other. An empty
    table gives an empty result; extra columns are ignored; texts of any length are measured whole.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    out = judged(docs.select("doc_id", "text", "lang"), folder, tolerance, min_group, min_tokens, ("text", "lang"))
    rounded = [F.round(f"__m.{m}", 6).alias(m) for m in MEASURES]
    return out.select("doc_id", F.col("__band").alias("band"), F.col("__m.n_tokens").alias("n_tokens"), *rounded, F.col("__why").alias("why"), (F.size("__why") == 0).alias("keep"))


def drop_unusual(docs: DataFrame, folder: str = TOKENIZERS, tolerance: float = TOLERANCE, min_group: int = MIN_GROUP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents that fertility() keeps, each row with all its columns as they were, under their names.

    Null, empty and blank texts go; null ids and repeated rows are judged like others; a null or blank lang is replaced by
    the script. An empty table stays empty; texts are measured whole.
    """
    inner, back = tidy(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    return back(judged(inner, folder, tolerance, min_group, min_tokens).filter(F.size("__why") == 0))
