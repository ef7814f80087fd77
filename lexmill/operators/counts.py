"""Counts over tokenised documents: metrics, frequency tables, ids, windowed bigram statistics.

Pairs never cross a document. Pairs are built within the row, so that the first shuffle is that of the partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..sources.shared import stored


def tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", make=T.ascii_tokens) -> DataFrame:
    """(key, pos, token): one row a token, pos from 0."""
    return docs.select(key, F.posexplode(make(F.col(text))).alias("pos", "token"))


def metrics(docs: DataFrame, n: int = 2, text: str = "text") -> DataFrame:
    """One row: tokens, distinct tokens, n-grams, distinct n-grams of all documents."""
    if n < 1:
        raise ValueError("n must be a positive integer")
    rows = docs.select(T.ascii_tokens(text).alias("t")).select(F.explode(F.concat(T.zipped("t", [0], n + 1), T.zipped("t", range(n), n + 1, "gram"))).alias("g")).select("g.*")
    kinds = [f"w{i + 1}" for i in range(n + 1)]
    seen = rows.groupBy(*kinds).agg(F.count("*").alias("c"))
    word = F.col(kinds[-1]).isNull()
    total = lambda of: F.coalesce(F.sum(F.when(of, F.col("c"))), F.lit(0))
    return seen.agg(
        total(word).alias("token_count"), F.count(F.when(word, 1)).alias("unique_token_count"), total(~word).alias("ngram_count"), F.count(F.when(~word, 1)).alias("unique_ngram_count")
    )


def token_freq(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(T.ascii_tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def hashed_freq(freq: DataFrame) -> DataFrame:
    return freq.select(T.fnv1a("token").alias("hash"), "n")


def grams(docs: DataFrame, shapes: Sequence[Sequence[int]], text: str = "text") -> DataFrame:
    """(gram): the tokens at each shape's distances from each start at which all are there, blanks between. Tokens have no
    blanks, so a gram's text tells its tokens; no lambda runs for it and what is grouped is a string."""
    width = max(len(s) for s in shapes)
    parts = [T.zipped("t", s, width) for s in shapes]
    rows = docs.select(T.ascii_tokens(text).alias("t")).select(F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("g"))
    return rows.select(F.concat_ws(" ", *(f"g.w{i + 1}" for i in range(width))).alias("gram"))


def gram_freq(docs: DataFrame, shapes: Sequence[Sequence[int]], text: str = "text") -> DataFrame:
    """(gram, n) of the grams of some shapes."""
    return grams(docs, shapes, text).groupBy("gram").agg(F.count("*").alias("n"))


def ngram_freq(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(gram, n): gram is the n tokens with blanks between."""
    if n < 1:
        raise ValueError("n must be a positive integer")
    return gram_freq(docs, [range(n)], text)


def hashed_ngram_freq(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(hash, n) of n-grams."""
    return ngram_freq(docs, n, text).select(T.gram_hash(F.split("gram", " ")).alias("hash"), "n")


def token_ids(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, token, n): ids by first occurrence in document order."""
    seen = tokens(docs, text, key).groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    return rank_by(seen, "first").select(F.col("rank").alias("id"), "token", "n")


def rank_by(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with rank from 0 in a total order, without moving all rows to one task: a range sort numbers its partitions'
    rows, and the partitions' sizes say where each begins."""
    ordered = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()})
    ordered = stored(ordered, "ranked")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("c"), F.min("__row").alias("__least"))
    offsets = sizes.select("__part", "__least", (F.sum("c").over(W.orderBy("__part")) - F.col("c")).alias("__before"))
    ranked = ordered.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__before") + F.col("__row") - F.col("__least"))
    return ranked.drop("__part", "__row", "__least", "__before")


def pair_counts(docs: DataFrame, window: int = 2, text: str = "text") -> DataFrame:
    toks = docs.select(T.ascii_tokens(text).alias("t"))
    return toks.select(F.explode(T.window_pairs("t", window)).alias("p")).groupBy("p.l", "p.r").agg(F.count("*").alias("n"))


def window_stats(docs: DataFrame, window: int = 2, text: str = "text") -> DataFrame:
    """(l, r, n, pmi) with pmi = log2(n * N / (n_l * n_r * (window - 1)))."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    from .collocations import finder, marginals

    m = marginals(finder(docs, 2, window, T.ascii_tokens(text)))
    score = F.log2(F.col("n").cast("double") * F.col("total") / (F.col("m_0").cast("double") * F.col("m_1") * (window - 1)))
    return m.select(F.col("w1").alias("l"), F.col("w2").alias("r"), "n", score.alias("pmi"))


def top_pmi(docs: DataFrame, k: int, window: int = 2, least: int = 1, text: str = "text") -> DataFrame:
    """The k pairs of greatest pmi, of pairs seen least times; equal scores by the hashes of left and right word."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    scored = window_stats(docs, window, text).filter(F.col("n") >= least).withColumn("pmi", F.round("pmi", 9))
    return scored.orderBy(F.desc("pmi"), T.fnv1a("l"), T.fnv1a("r")).limit(k)
