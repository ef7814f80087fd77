"""Token counts through a digest cache.

A count is stored under the digest of the normalised text and the digest of the tokenizer (its file and how it splits).
Documents' digests, 16 bytes each, are joined with the stored ones; the distinct ones that miss are looked for among the
texts, encoded once each, and their counts appended. A Bloom filter of the missing digests, of at most FILTER_BYTES, keeps
texts that hit where they lie: only texts that miss are moved, to the worker that holds their digest. Texts that come
again, in this table or the next, cost a lookup.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._frame import fresh_path, stored, tidy
from .bloom_cascade import Level
from .fertility import _SPLIT, BYTES, TOKENIZERS, rank_encoding

SCHEMA, FILTER_BYTES = "digest binary, n_tokens long", 16_000_000


def tokenizer_digest(path: str) -> str:
    """Of the rank file's bytes and the splitting pattern: another version of either is another tokenizer."""
    return hashlib.sha256(Path(path).read_bytes() + _SPLIT.encode()).hexdigest()[:16]


def normalised(text: Column) -> Column:
    """Line ends as line feeds, no white space at the end; null as empty."""
    lines = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.rtrim(lines, F.lit(" \t\n\x0b\x0c\r"))


def digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame | None:
    """What the cache has for a tokenizer, one row a digest; None if nothing."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(SCHEMA).option("basePath", f"{cache}/tokenizer={version}").parquet(f"{cache}/tokenizer={version}").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = rank_encoding(path)
        seen: set[bytes] = set()
        for batch in batches:
            keys, counts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    counts.append(len(encoding.encode_ordinary(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _halves(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def _maybe(keyed: DataFrame, misses: DataFrame, n: int) -> DataFrame:
    """The rows of keyed whose digest may be one of the n of misses; no row of another is kept but by chance."""
    level = Level(n, max(0.01, 0.5 ** (FILTER_BYTES * 8 * 0.69 / n)), 0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in level.words(*_halves(batch.column(0)))], names=["word", "bits"])

    got = misses.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = copy.copy(level)
    full.put(got["word"].to_numpy(), got["bits"].to_numpy())
    sent = keyed.sparkSession.sparkContext.broadcast(full)

    @F.arrow_udf("boolean")
    def has(digests: pa.Array) -> pa.Array:
        return pa.array(sent.value.has(*_halves(digests)))

    return keyed.filter(has("digest"))


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str = f"{TOKENIZERS}/{BYTES}") -> DataFrame:
    """doc_id, tokenizer, digest (hex) and n_tokens of every row.

    cache: the folder of stored counts, shared by all executors; None for a new one in the shared folder. Null and blank
    texts have 0 tokens. Null ids and repeated rows are counted like others. Two runs that append the same digest do no
    harm: one row of it is read. An empty table gives an empty result; texts are encoded whole; extra columns are ignored.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})
    cache = cache or fresh_path(docs.sparkSession, "token-cache")
    version = tokenizer_digest(tokenizer)
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    known = stored_counts(docs, cache, version)
    rows = text.select("doc_id", digest(F.col("text")).alias("digest"))
    rows = rows.withColumn("n_tokens", F.lit(None).cast("long")) if known is None else rows.join(known, "digest", "left").select("doc_id", "digest", "n_tokens")
    rows = stored(rows, "digests")
    misses = stored(rows.filter("n_tokens is null").select("digest").distinct(), "misses")
    n = misses.count()
    if n:
        keyed = text.select(digest(F.col("text")).alias("digest"), "text")
        if known is None:
            keyed = keyed.repartition("digest")
        else:
            keyed = _maybe(keyed, misses, n).join(misses.hint("shuffle_hash"), "digest", "left_semi")
        fresh = f"{cache}/tokenizer={version}/run={uuid.uuid4().hex}"
        keyed.mapInArrow(_encode(tokenizer), SCHEMA).write.parquet(fresh)
        new = docs.sparkSession.read.schema(SCHEMA).parquet(fresh)
        rest = rows.filter("n_tokens is null").drop("n_tokens").join(new, "digest").select("doc_id", "digest", "n_tokens")
        rows = rest if known is None else rows.filter("n_tokens is not null").unionByName(rest)
    return rows.select("doc_id", F.lit(version).alias("tokenizer"), F.lower(F.hex("digest")).alias("digest"), "n_tokens")
