"""Mixing sources to target weights by Pareto order sampling.

A source's target share of the output is a number of rows n. Document i of weight w_i is expected n * w_i / W times: the
whole part are certain copies, the rest r_i / W is its inclusion probability for one more. Ranking documents by the
random odds u / (1 - u) divided by the inclusion odds r / (W - r) and taking the k smallest, k being the sum of the
probabilities, gives a sample of fixed size with those probabilities (Rosen, Pareto pi-ps sampling).

The k-th smallest rank of each source is found without sorting: counts by rank bucket, then an exact ranking within
the one bucket that holds it. The texts are read once and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._frame import stored, tidy

SEED, BUCKETS = 20240229, 4096


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of a digest of id and seed."""
    digest = F.md5(F.concat(doc_id.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _ranked(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """docs with __whole copies, __r (numerator of the probability), __q (rank) and __b (its bucket)."""
    out = docs.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("__src")))
    out = out.withColumn("__nw", F.col("__n").cast("decimal(38,0)") * F.col("__w"))
    out = out.withColumns({"__whole": F.expr("cast(__nw div __tw as long)"), "__r": F.expr("cast(__nw % __tw as long)")})
    u = uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed)
    odds = F.when(F.col("__r") > 0, u / (1 - u) * ((F.col("__tw") - F.col("__r")).cast("double") / F.col("__r").cast("double")))
    out = out.withColumn("__q", odds)
    return out.withColumn("__b", F.floor(F.col("__q") / (1 + F.col("__q")) * BUCKETS).cast("int"))


def _prepared(docs: DataFrame, total: int | None, weights: dict[str, float] | None, seed: int) -> DataFrame:
    """One row a source: its rows n, weight W, and the last rank that is taken, with how many of the rows at it."""
    own = F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(1)).cast("long")
    by = stored(docs.select("source", own.alias("w")).groupBy("source").agg(F.sum("w").cast("long").alias("__tw"), F.count("*").alias("__rows")), "sources")
    goal = total if total is not None else by.agg(F.sum("__rows")).first()[0] or 0
    share = F.lit(1.0)
    if weights is not None:
        if any(v < 0 for v in weights.values()):
            raise ValueError("weights can't be negative")
        share = F.lit(0.0)
        for s, v in weights.items():
            share = F.when(F.col("source") == s, F.lit(float(v))).otherwise(share)
    by = by.withColumn("__share", share)
    every = by.agg(F.sum("__share").alias("__all"))
    by = by.crossJoin(F.broadcast(every)).select(
        F.col("source").alias("__src"), "__tw", F.when(F.col("__all") > 0, F.floor(F.col("__share") / F.col("__all") * goal + 0.5)).otherwise(0).cast("long").alias("__n")
    )
    by = stored(by, "sources")
    narrow = _ranked(docs.select("doc_id", "source", "n_chars").withColumn("__w", own), by, seed).filter("__r > 0")
    counts = stored(narrow.groupBy("__src", "__b").agg(F.count("*").alias("c"), F.sum(F.col("__r").cast("decimal(38,0)")).alias("r")), "ranks")
    mass = counts.groupBy(F.col("__src").alias("__s1")).agg(F.sum("r").alias("r"))
    need = by.join(mass, F.col("__src").eqNullSafe(F.col("__s1"))).select(F.col("__src").alias("__s2"), F.expr("cast(r div __tw as long)").alias("k"))
    need = counts.select("__src", "__b", "c").join(need, F.col("__src").eqNullSafe(F.col("__s2")))
    before = F.sum("c").over(W.partitionBy("__src").orderBy("__b"))
    edge = need.withColumn("__to", before).filter("__to >= k and __to - c < k and k > 0").select("__src", "__b", (F.col("k") - (F.col("__to") - F.col("c"))).alias("__left"))
    edge = stored(edge, "edge")
    e = edge.select(F.col("__src").alias("__s3"), F.col("__b").alias("__b3"), "__left")
    close = narrow.join(F.broadcast(e), F.col("__src").eqNullSafe(F.col("__s3")) & (F.col("__b") == F.col("__b3")))
    close = close.groupBy("__src", "__left", "__q", "doc_id").agg(F.count("*").alias("c"))
    close = close.withColumn("__to", F.sum("c").over(W.partitionBy("__src").orderBy("__q", F.col("doc_id").asc_nulls_first())))
    last = close.filter("__to >= __left and __to - c < __left").select(
        F.col("__src").alias("__s4"), F.col("__q").alias("__lastq"), F.coalesce("doc_id", F.lit(-1)).alias("__lastid"), (F.col("__left") - F.col("__to") + F.col("c")).alias("__take"), F.col("c").alias("__at")
    )
    return stored(by.join(last, F.col("__src").eqNullSafe(F.col("__s4")), "left").drop("__s4"), "thresholds")


def pareto_mix(docs: DataFrame, total: int | None = None, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The sample: all columns of docs and copy (1, 2, ...), total rows in proportion to the sources' weights.

    weights None: every source alike; a source not named has weight 0; a null source is a source when weights is None.
    total None: as many rows as docs has. Each source gets its rounded share. A document's weight is n_chars, and 1
    where that is null or less than 1. A null doc_id draws as -1. Equal ranks are ordered by doc_id; of rows that share
    rank and id, as of repeated rows, those with the smaller digest of source and text are taken. An empty table gives
    an empty sample. Texts are never looked at, save in such ties. A column copy in docs keeps its place; the new one
    comes last.
    """
    inner, back = tidy(docs, {"doc_id": "long", "text": "string", "source": "string", "n_chars": "long"})
    inner = inner.withColumn("__w", F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(1)).cast("long"))
    limits = _prepared(inner, total, weights, seed)
    rows = _ranked(inner, limits, seed)
    at = F.struct("__q", F.coalesce("doc_id", F.lit(-1)).alias("i"))
    edge = F.struct(F.col("__lastq").alias("__q"), F.col("__lastid").alias("i"))
    has = F.col("__lastq").isNotNull() & (F.col("__r") > 0)
    tied = limits.filter("__take < __at")
    split = not tied.isEmpty()
    one_more = F.coalesce(has & ((at < edge) if split else (at <= edge)), F.lit(False)).cast("int")
    rows = rows.withColumn("__copies", F.col("__whole") + one_more)
    if split:
        same = F.coalesce(has & (at == edge), F.lit(False))
        w = W.partitionBy("__src").orderBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        of_tied = rows.filter(same).withColumn("__no", F.row_number().over(w)).withColumn("__copies", F.col("__copies") + F.when(F.col("__no") <= F.col("__take"), 1).otherwise(0)).drop("__no")
        rows = rows.filter(~same).unionByName(of_tied)
    names = [c for c in inner.columns if c != "__w"]
    out = rows.filter("__copies > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy"))
    renamed = back(out)
    return out.toDF(*renamed.columns, "copy")
