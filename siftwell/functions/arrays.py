"""Array expressions that the built-in functions lack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), 0)


def running(steps: Column) -> Column:
    """Running sums of an int array, in blocks, so that long arrays aren't copied at each step."""

    def sums(values: Column, first: Column) -> Column:
        return F.aggregate(
            values,
            F.named_struct(F.lit("at"), first, F.lit("list"), F.array().cast("array<int>")),
            lambda acc, x: F.named_struct(F.lit("at"), acc["at"] + x, F.lit("list"), F.concat(acc["list"], F.array(acc["at"] + x))),
            lambda acc: acc["list"],
        )

    count = F.ceil(F.size(steps) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda b: F.slice(steps, (b - 1) * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    before = F.zip_with(sums(totals, F.lit(0)), totals, lambda end, n: end - n)
    return F.flatten(F.zip_with(blocks, before, sums))
