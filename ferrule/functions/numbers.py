"""Numbers rounded and written as Python does it.

Python rounds the exact binary value, and ties to even; SQL functions go by a double's
shortest decimal form, and ties away from zero: 0.00015 is below its decimal form, 0.0625
a tie.  No SQL cast keeps the exact value, so these run in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f: Callable[[float], object], kind: str, arrow: pa.DataType, c: Column) -> Column:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in values.to_pylist()], arrow)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(c.cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """``round(x, digits)``."""
    return _each(lambda x: round(x, digits), "double", pa.float64(), c)


def fixed(c: Column, digits: int) -> Column:
    """``f"{x:.<digits>f}"``."""
    return _each(lambda x: f"{x:.{digits}f}", "string", pa.string(), c)


def general(c: Column) -> Column:
    """``f"{x:g}"``: at most six significant digits, no trailing zeros."""
    return _each(lambda x: f"{x:g}", "string", pa.string(), c)
