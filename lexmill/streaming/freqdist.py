"""Incremental counts of tokens, adjacent pairs and tagged tokens over streams of text chunks.

A row is (stream_id, seq, chunk). Words may straddle chunks: each stream's state is the unfinished word and the word
before it. A null chunk ends the unfinished word. Counts of each micro-batch are written under its number, so that a batch
that is run again replaces itself; reading adds the batches up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T

_OPEN = re.compile(r"[A-Za-z0-9']*\Z")
EVENTS = "stream_id string, word string, before string"


def _finished(text: str, carry: str) -> tuple[list[str], str]:
    """Words that end within carry + text, and the unfinished rest."""
    whole = carry + text
    rest = _OPEN.search(whole).group()
    return re.findall(r"[A-Za-z0-9']+", whole[: len(whole) - len(rest)]), rest


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    carry, before = state.get if state.exists else ("", None)
    words, befores = [], []
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    for chunk in rows["chunk"]:
        if chunk is None or pd.isna(chunk):
            found, carry = ([carry] if carry else []), ""
        else:
            found, carry = _finished(chunk, carry)
        for w in found:
            words.append(w)
            befores.append(before)
            before = w.lower()
    state.update((carry, before))
    if words:
        yield pd.DataFrame({"stream_id": key[0], "word": words, "before": befores})


def words_of(chunks: DataFrame) -> DataFrame:
    """(stream_id, word, before) of a streaming table of chunks; word as written, before in lower case."""
    keyed = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk")
    return keyed.groupBy("stream_id").applyInPandasWithState(_step, EVENTS, "carry string, before string", "append", "NoTimeout")


class FreqDistStream:
    """Counts kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def start(self, chunks: DataFrame, available_now: bool = False) -> StreamingQuery:
        def keep(batch: DataFrame, number: int) -> None:
            tag = T.rule_tag("word")
            one = F.array(
                F.struct(F.lit("token").alias("kind"), F.lit(None).cast("string").alias("a"), T.ascii_lower("word").alias("b")),
                F.struct(F.lit("bigram").alias("kind"), F.col("before").alias("a"), T.ascii_lower("word").alias("b")),
                F.struct(F.lit("tag").alias("kind"), tag.alias("a"), T.ascii_lower("word").alias("b")),
            )
            rows = batch.select(F.explode(one).alias("e")).select("e.*").filter("kind <> 'bigram' or a is not null")
            rows.groupBy("kind", "a", "b").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")

        writer = words_of(chunks).writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _counts(self, kind: str) -> DataFrame:
        rows = self.spark.read.schema("kind string, a string, b string, n long").parquet(f"{self.folder}/counts")
        return rows.filter(F.col("kind") == kind).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def tokens(self) -> DataFrame:
        return self._counts("token").select(F.col("b").alias("token"), "n")

    def bigrams(self) -> DataFrame:
        return self._counts("bigram").select(F.col("a").alias("l"), F.col("b").alias("r"), "n")

    def conditional(self) -> DataFrame:
        return self._counts("tag").select(F.col("a").alias("tag"), F.col("b").alias("token"), "n")

    def unique_counts(self) -> DataFrame:
        parts = [("tokens", self.tokens()), ("bigrams", self.bigrams()), ("conditional", self.conditional())]
        out = None
        for name, df in parts:
            n = df.agg(F.count("*").alias(name))
            out = n if out is None else out.crossJoin(n)
        return out

    def to_json(self) -> str:
        """Hashes in decimal, each list by key. Meant for small vocabularies: the text is one string."""
        number = lambda c: F.conv(T.fnv1a(c), 16, 10)
        key = lambda c: T.fnv1a(c)
        t = self.tokens().select(F.struct(key("token").alias("k"), number("token").alias("hash"), F.col("n").alias("count")).alias("x"))
        b = self.bigrams().select(F.struct(key("l").alias("k"), key("r").alias("k2"), number("l").alias("left"), number("r").alias("right"), F.col("n").alias("count")).alias("x"))
        c = self.conditional().select(F.struct(T.tag_id("tag").alias("tag_id"), key("token").alias("k"), number("token").alias("hash"), F.col("n").alias("count")).alias("x"))
        lists = [df.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.dropFields("k", "k2")).alias(name)) if name == "bigrams" else df.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.dropFields("k")).alias(name)) for name, df in (("tokens", t), ("bigrams", b), ("conditional_tags", c))]
        return lists[0].crossJoin(lists[1]).crossJoin(lists[2]).select(F.to_json(F.struct("tokens", "bigrams", "conditional_tags")).alias("j")).first()["j"]
