"""One notion of a missing value: NULL. NaN never enters a cube, and divisions follow IEEE rules without raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 missing and x / 0 infinite, as float arithmetic has it."""
    return F.when(b != 0, a / b).when(a != 0, F.signum(a) * F.lit(float("inf")))


def sum_rule(value: Column, skipna: bool | None, min_count: int | None, cells: Column | int | None) -> Column:
    """The sum of a group of cells, of which `cells` exist in the dense cube.

    skipna None and no min_count: missing cells count as zero, so a group without data is 0. skipna True: at least
    `min_count` cells (1 if not given) must hold data. skipna False: all cells must.
    """
    total = F.sum(value)
    if skipna is False:
        return F.when(F.count(value) == cells, total)
    if skipna is None and min_count is None:
        return F.coalesce(total, F.lit(0.0))
    least = 1 if min_count is None else min_count
    if least <= 0:
        return F.coalesce(total, F.lit(0.0))
    return total if least == 1 else F.when(F.count(value) >= least, total)
