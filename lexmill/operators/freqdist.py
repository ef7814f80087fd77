"""Frequency distributions as tables (sample, n, first): what is counted, how often, where first seen.

Conditional distributions have a column condition as well; every operation then goes by condition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def build(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts (or sums of weight) by keys; first is the least of the order columns, for ties."""
    n = F.sum(weight) if weight else F.count("*")
    first = [F.min(F.struct(*order)).alias("first")] if order else []
    return df.groupBy(*keys).agg(n.alias("n"), *first)


def most_common(fd: DataFrame, k: int | None = None, tie: Sequence[str] = ("first",)) -> DataFrame:
    out = fd.orderBy(F.desc("n"), *tie)
    return out if k is None else out.limit(max(0, k))


def totals(fd: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """N (sum) and B (distinct samples), by condition if given."""
    return fd.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("B"))


def frequencies(fd: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """fd with freq = n / N, 0 where N is 0."""
    if by:
        total = F.sum("n").over(W.partitionBy(*by))
        return fd.withColumn("freq", F.when(total == 0, 0.0).otherwise(F.col("n") / total))
    total = fd.agg(F.sum("n").alias("__N"))
    return fd.crossJoin(F.broadcast(total)).withColumn("freq", F.when(F.col("__N") == 0, 0.0).otherwise(F.col("n") / F.col("__N"))).drop("__N")


def of_frequencies(fd: DataFrame, bins: int | None = None) -> DataFrame:
    """(r, nr): how many samples occur r times. r = 0 is there if bins are given."""
    out = fd.groupBy(F.col("n").cast("long").alias("r")).agg(F.count("*").alias("nr"))
    if bins is None:
        return out
    unseen = fd.agg(F.greatest(F.lit(0).cast("long"), F.lit(bins).cast("long") - F.count("*")).alias("nr"))
    return out.unionByName(unseen.select(F.lit(0).cast("long").alias("r"), "nr"))


def hapaxes(fd: DataFrame) -> DataFrame:
    return fd.filter("n = 1")


def maximum(fd: DataFrame, sample: str = "sample") -> DataFrame:
    """The most frequent sample, the first seen of equals."""
    return most_common(fd).limit(1).select(sample)


def _both(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    left = a.select(*keys, F.col("n").alias("__a"))
    right = b.select(*keys, F.col("n").alias("__b"))
    return left.join(right, list(keys), how)


def add(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    return a.select(*keys, "n").unionByName(b.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """a less b, positive counts only."""
    return _both(a, b, keys, "left").select(*keys, (F.col("__a") - F.coalesce("__b", F.lit(0))).alias("n")).filter("n > 0")


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """The greater count of each sample."""
    return a.select(*keys, "n").unionByName(b.select(*keys, "n")).groupBy(*keys).agg(F.max("n").alias("n"))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """The smaller count of samples in both."""
    return _both(a, b, keys, "inner").select(*keys, F.least("__a", "__b").alias("n")).filter("n > 0")


def put(fd: DataFrame, updates: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """fd with the counts of updates in place of its own; a count of 0 deletes. updates has each sample once."""
    both = fd.select(*keys, F.col("n").alias("__a")).join(updates.select(*keys, F.col("n").alias("__b")), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("__b", "__a").alias("n")).filter("n > 0")


def delete(fd: DataFrame, samples: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Without some samples; what is left counts as before."""
    return fd.join(samples.select(*keys), list(keys), "left_anti")


def is_subset(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """One row: whether no sample of a is more frequent than in b. Conditions must be in b as well."""
    out = _both(a, b, keys, "left").agg(F.coalesce(F.bool_and(F.col("__a") <= F.coalesce("__b", F.lit(0))), F.lit(True)).alias("is_subset"))
    if len(keys) == 1:
        return out
    missing = a.select(keys[0]).distinct().join(b.select(keys[0]).distinct(), keys[0], "left_anti").agg((F.count("*") == 0).alias("__all"))
    return out.crossJoin(missing).select((F.col("is_subset") & F.col("__all")).alias("is_subset"))


def equals(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    one, two = is_subset(a, b, keys), is_subset(b, a, keys).withColumnRenamed("is_subset", "__back")
    return one.crossJoin(two).select((F.col("is_subset") & F.col("__back")).alias("equal"))


def rendered(fd: DataFrame, k: int = 10, sample: str = "sample") -> DataFrame:
    """One row: FreqDist({"b": 3, ...}), dots where more than k samples are left out."""
    top = most_common(fd, k + 1).select(F.concat(F.lit('"'), F.col(sample), F.lit('": '), F.col("n").cast("string")).alias("s"), "n", "first")
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "s"))).alias("r"))
    shown = F.array_join(F.transform(F.slice("r", 1, k), lambda x: x["s"]), ", ")
    return rows.select(F.concat(F.lit("FreqDist({"), shown, F.when(F.size("r") > k, F.lit(", ...")).otherwise(""), F.lit("})")).alias("text"))
