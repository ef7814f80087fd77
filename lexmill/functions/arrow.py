"""Plain Python functions as Arrow UDFs, one call a value, distinct values of a batch once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def arrow_function(f: Callable[..., Any], returns: str) -> Callable[..., Column]:
    """f over columns; null in, null out. Equal inputs of a batch are computed once."""

    def apply(*cols: Column | str) -> Column:
        kind = to_arrow_type(_parse_datatype_string(returns))

        def run(*arrays: pa.Array) -> pa.Array:
            done: dict = {}
            out = []
            for row in zip(*(a.to_pylist() for a in arrays), strict=True):
                if any(x is None for x in row):
                    out.append(None)
                    continue
                k = row if len(row) > 1 else row[0]
                try:
                    if k not in done:
                        done[k] = f(*row)
                    out.append(done[k])
                except TypeError:
                    out.append(f(*row))
            return pa.array(out, kind)

        # arrow_udf reads the type hints of fixed signatures
        if len(cols) == 1:

            def one(a: pa.Array) -> pa.Array:
                return run(a)

            udf = F.arrow_udf(one, returns)
        else:

            def two(a: pa.Array, b: pa.Array) -> pa.Array:
                return run(a, b)

            udf = F.arrow_udf(two, returns)
        return udf(*cols)

    return apply
