"""Array expressions that compute an intermediate once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def indexes(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


def squares(values: Column) -> Column:
    return total(F.transform(values, lambda x: x * x))
