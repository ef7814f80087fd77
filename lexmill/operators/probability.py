"""Probability distributions over frequency tables: columns prob and logprob next to (sample, n), by condition if given."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NEG_INF = float("-inf")


def logprob(p: Column) -> Column:
    return F.when(p > 0, F.log2(p)).otherwise(F.lit(NEG_INF))


def _stats(fd: DataFrame, by: Sequence[str]) -> DataFrame:
    """fd with __N and __B; a window where there are conditions, else a broadcast row."""
    if by:
        w = W.partitionBy(*by)
        return fd.withColumns({"__N": F.sum("n").over(w).cast("double"), "__B": F.count("*").over(w).cast("double")})
    return fd.crossJoin(F.broadcast(fd.agg(F.sum("n").cast("double").alias("__N"), F.count("*").cast("double").alias("__B"))))


def _done(df: DataFrame, p: Column) -> DataFrame:
    return df.withColumn("prob", p).withColumn("logprob", logprob(F.col("prob"))).drop("__N", "__B")


def mle(fd: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _done(_stats(fd, by), F.col("n") / F.col("__N"))


def uniform(samples: DataFrame) -> DataFrame:
    """Of distinct samples; refuses none."""
    rows = samples.distinct()
    k = rows.agg(F.count("*").alias("__B"))
    return rows.crossJoin(F.broadcast(k)).withColumn("prob", 1 / F.col("__B")).drop("__B")


def lidstone(fd: DataFrame, gamma: float, bins: int | None = None, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """(n + gamma) / (N + gamma * bins); bins default to the samples seen. Fewer bins than samples are an error, or if not
    strict are taken as they are, and the probabilities then sum to more than 1."""
    if bins is not None and bins <= 0:
        raise ValueError("bins must be positive")
    df = _stats(fd, by)
    b = F.col("__B") if bins is None else F.lit(float(bins))
    if bins is not None and strict:
        df = df.withColumn("__B", F.when(F.col("__B") <= b, b).otherwise(F.raise_error(F.lit("bins must not be fewer than the samples")).cast("double")))
        b = F.col("__B")
    under = F.col("__N") + b * gamma
    return _done(df, F.when(under == 0, F.col("n").cast("double")).otherwise((F.col("n") + gamma) / under))


def laplace(fd: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return lidstone(fd, 1.0, bins, by)


def ele(fd: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    return lidstone(fd, 0.5, bins, by)


def lidstone_discount(fd: DataFrame, gamma: float, bins: int) -> DataFrame:
    return fd.agg((F.lit(gamma * bins) / (F.sum("n") + gamma * bins)).alias("discount"))


def witten_bell(fd: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Seen samples: n / (N + T), T being their number."""
    return _done(_stats(fd, by), F.col("n") / (F.col("__N") + F.col("__B")))


def witten_bell_unseen(fd: DataFrame, bins: int) -> DataFrame:
    """One row: the probability of each unseen sample."""
    s = fd.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("T")).withColumn("Z", F.lit(bins) - F.col("T"))
    return s.select(F.when(F.col("Z") <= 0, 0.0).when(F.col("N") == 0, 1 / F.col("Z")).otherwise(F.col("T") / (F.col("Z") * (F.col("N") + F.col("T")))).alias("prob"))


def from_dictionary(table: DataFrame, log: bool = False, normalize: bool = False) -> DataFrame:
    """(sample, p) as probabilities; p are base-2 logarithms if log. Normalised, a sum of 0 becomes uniform."""
    p = F.pow(F.lit(2.0), F.col("p")) if log else F.col("p").cast("double")
    df = table.withColumn("prob", p)
    if normalize:
        total = df.agg(F.sum("prob").alias("__s"), F.count("*").alias("__c"))
        df = df.crossJoin(F.broadcast(total)).withColumn("prob", F.when(F.col("__s") == 0, 1 / F.col("__c")).otherwise(F.col("prob") / F.col("__s"))).drop("__s", "__c")
    return df.withColumn("logprob", logprob(F.col("prob")))


def mutable(dist: DataFrame, updates: DataFrame) -> DataFrame:
    """(sample, prob) with the probabilities that updates has in place of the old ones."""
    old = dist.select("sample", "prob").join(updates.select("sample"), "sample", "left_anti")
    return old.unionByName(updates.select("sample", "prob"))


def good_turing(fd: DataFrame, bins: int | None = None) -> tuple[DataFrame, float]:
    """Simple Good-Turing: (sample, n, prob, logprob) of the seen samples, and the probability of each unseen one."""
    out, zero, seen = _good_turing(fd)
    bins = seen + 1 if bins is None else bins
    if bins <= seen:
        raise ValueError("bins must be more than the samples")
    return out, zero / (bins - seen)


def good_turing_seen(fd: DataFrame) -> DataFrame:
    """The seen samples of good_turing alone, which depend on no number of bins."""
    return _good_turing(fd)[0]


def _good_turing(fd: DataFrame) -> tuple[DataFrame, float, int]:
    """Table of the seen samples, probability of all unseen ones together, number of samples seen.

    The fit needs only how many samples occur r times, a table of few rows, so it is done on the driver.
    """
    rows = sorted((int(r["n"]), int(r["c"])) for r in fd.groupBy("n").agg(F.count("*").alias("c")).collect())
    if not rows:
        raise ValueError("nothing was counted")
    seen = sum(c for _, c in rows)
    total = sum(r * c for r, c in rows)
    rs, nr = [r for r, _ in rows], dict(rows)
    z = []
    for i, r in enumerate(rs):
        before = rs[i - 1] if i else 0
        after = rs[i + 1] if i + 1 < len(rs) else 2 * r - before
        z.append(2 * nr[r] / (after - before))
    x, y = [math.log(r) for r in rs], [math.log(v) for v in z]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    var = sum((a - mx) ** 2 for a in x)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / var if var else 0.0
    smooth = lambda r: math.exp(my - slope * mx + slope * math.log(r))
    switch = None
    for i, r in enumerate(rs):
        if i + 1 == len(rs) or rs[i + 1] != r + 1:
            switch = r
            break
        s = (r + 1) * smooth(r + 1) / smooth(r)
        t = (r + 1) * nr[r + 1] / nr[r]
        if abs(t - s) <= 1.96 * math.sqrt((r + 1) ** 2 * (nr[r + 1] / nr[r] ** 2) * (1 + nr[r + 1] / nr[r])):
            switch = r
            break
    zero = nr.get(1, 0) / total
    at = lambda r: nr[r] if r < switch and r in nr else smooth(r)
    star = {r: (r + 1) * at(r + 1) / at(r) / total for r in rs}
    mass = sum(nr[r] * star[r] for r in rs)
    scale = (1 - zero) / mass if mass else 1.0
    table = fd.sparkSession.createDataFrame([(r, star[r] * scale) for r in rs], "n long, prob double")
    out = fd.join(F.broadcast(table), fd["n"].cast("long") == table["n"]).drop(table["n"]).withColumn("logprob", logprob(F.col("prob")))
    return out, zero, seen


def entropy(dist: DataFrame, by: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """-sum p log2 p over positive p."""
    return dist.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col(prob) > 0, -F.col(prob) * F.log2(prob))), F.lit(0.0)).alias("entropy"))


def log_likelihood(actual: DataFrame, test: DataFrame, key: str = "sample") -> DataFrame:
    """sum p_actual log2 max(p_test, least double), over positive p_actual."""
    both = actual.select(key, F.col("prob").alias("__a")).join(test.select(key, F.col("prob").alias("__t")), key, "left")
    return both.agg(F.sum(F.when(F.col("__a") > 0, F.col("__a") * F.log2(F.greatest(F.coalesce("__t", F.lit(0.0)), F.lit(5e-324))))).alias("log_likelihood"))


def log_sum(values: Column) -> Column:
    """log2 of the sum of 2^x over an array."""
    # the array and its greatest are bound once, not computed anew for each of its values
    bound = F.array(F.struct(values.alias("v"), F.array_max(values).alias("m")))

    def one(x: Column) -> Column:
        total = F.aggregate(x["v"], F.lit(0.0), lambda a, y: a + F.pow(F.lit(2.0), y - x["m"]))
        return F.when(F.size(x["v"]) == 0, F.lit(NEG_INF)).when(x["m"] == NEG_INF, F.lit(NEG_INF)).otherwise(x["m"] + F.log2(total))

    return F.element_at(F.transform(bound, one), 1)


#: Distributions by name: each takes a frequency table, its options and the columns of the condition.
FACTORIES = {"mle": mle, "lidstone": lidstone, "laplace": laplace, "ele": ele, "witten_bell": witten_bell}


def conditional(fd: DataFrame, factory: str | Callable[..., DataFrame], by: Sequence[str] = ("condition",), **options) -> DataFrame:
    """A distribution for each condition, by a named factory or one of the caller's own: factory(fd, by=by, **options)."""
    make = FACTORIES[factory] if isinstance(factory, str) else factory
    return make(fd, by=by, **options)
