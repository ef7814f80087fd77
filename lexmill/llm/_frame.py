"""Columns, shared folders and sizes that the operators of this subpackage have in common."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import BATCH_BYTES, bound_batches, fresh_path, scratch, shared_dir, stored

def tidy(df: DataFrame, needed: dict[str, str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Give the needed columns their exact names and all others names that can't clash.

    Extra columns may repeat a name, or differ from one by case only. The second result restores names and order.
    """
    bound_batches(df.sparkSession)
    names = list(df.columns)
    place = {n: next((i for i, c in enumerate(names) if c == n), None) for n in needed}
    lost = [n for n, i in place.items() if i is None]
    if lost:
        raise ValueError(f"columns missing: {', '.join(lost)}")
    at = {i: n for n, i in place.items()}
    inner = [at.get(i, f"__x{i}") for i in range(len(names))]
    out = df.toDF(*inner)
    kinds = dict(out.dtypes)
    casts = {n: F.col(n).cast(t) for n, t in needed.items() if kinds[n] != t}
    if casts:
        out = out.withColumns(casts)
    return out, lambda x: x.select(*inner).toDF(*names)


def arrow_schema(fields: Iterable[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


__all__ = ["BATCH_BYTES", "arrow_schema", "bound_batches", "fresh_path", "scratch", "shared_dir", "stored", "tidy"]
