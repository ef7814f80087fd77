"""Edit distance, BLEU, confusion matrices and accuracy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_function

WEIGHTS = (0.25, 0.25, 0.25, 0.25)


def edit_distance(a: str, b: str, substitution: float = 1, transpositions: bool = False) -> float:
    """Over code points; adjacent letters that change places cost 1 if transpositions."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (0 if x == y else substitution))
            if transpositions and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [*rows[-1:], row]
    return rows[-1][-1]


def distance(a: Column | str, b: Column | str, substitution: float = 1, transpositions: bool = False) -> Column:
    """The built-in where all edits cost 1."""
    if substitution == 1 and not transpositions:
        return F.levenshtein(a, b)
    return arrow_function(lambda x, y: float(edit_distance(x, y, substitution, transpositions)), "double")(a, b)


def _grams(tokens: Sequence[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def bleu_counts(refs: Sequence[Sequence[str]], hyp: Sequence[str], orders: int = 4) -> tuple[list[int], list[int], int, int]:
    """Clipped and total n-gram counts by order, length of the hypothesis and of the closest reference (ties: shorter)."""
    clipped, totals = [], []
    for n in range(1, orders + 1):
        own = _grams(hyp, n)
        most: Counter = Counter()
        for r in refs:
            most |= _grams(r, n)
        clipped.append(sum(min(c, most[g]) for g, c in own.items()))
        totals.append(sum(own.values()))
    closest = min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1] if refs else 0
    return clipped, totals, len(hyp), closest


def bleu_score(clipped: Sequence[int], totals: Sequence[int], hyp: int, ref: int, weights: Sequence[float] = WEIGHTS) -> float:
    if not hyp:
        return 0.0
    brevity = 1.0 if hyp > ref else math.exp(1 - ref / hyp)
    return brevity * math.exp(sum(w * math.log((c + 1) / (t + 1)) for w, c, t in zip(weights, clipped, totals, strict=False)))


def sentence_bleu(refs: Sequence[Sequence[str]], hyp: Sequence[str], weights: Sequence[float] = WEIGHTS) -> float:
    return bleu_score(*bleu_counts(refs, hyp, len(weights)), weights) if refs else 0.0


def corpus_bleu(pairs: DataFrame, refs: str = "refs", hyp: str = "hyp", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """One row: bleu over a table of references and hypotheses (arrays of tokens); pairs without references are left out."""

    def counted(r, h):
        c, t, n, m = bleu_counts(r, h, len(weights))
        return {"c": c, "t": t, "h": n, "r": m}

    one = pairs.filter(F.size(refs) > 0).select(arrow_function(counted, "struct<c:array<bigint>,t:array<bigint>,h:bigint,r:bigint>")(refs, hyp).alias("x"))
    n = range(len(weights))
    sums = one.agg(*(F.sum(F.col("x.c")[i]).alias(f"c{i}") for i in n), *(F.sum(F.col("x.t")[i]).alias(f"t{i}") for i in n), F.sum("x.h").alias("h"), F.sum("x.r").alias("r"))
    logs = sum((w * F.log((F.col(f"c{i}") + 1) / (F.col(f"t{i}") + 1)) for i, w in enumerate(weights)), F.lit(0.0))
    brevity = F.when(F.col("h") > F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return sums.select(F.when(F.coalesce("h", F.lit(0)) == 0, 0.0).otherwise(brevity * F.exp(logs)).alias("bleu"))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold, pred, n) for every pair of labels that either column has, 0 where it never occurs."""
    seen = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    labels = seen.select(F.col("gold").alias("l")).union(seen.select("pred")).distinct()
    grid = labels.select(F.col("l").alias("gold")).crossJoin(labels.select(F.col("l").alias("pred")))
    return grid.join(seen, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def accuracy(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    hit = F.sum((F.col(gold) == F.col(pred)).cast("long"))
    return df.agg(F.count("*").alias("total"), F.coalesce(hit, F.lit(0)).alias("correct"), F.coalesce(F.avg((F.col(gold) == F.col(pred)).cast("double")), F.lit(0.0)).alias("accuracy"))
