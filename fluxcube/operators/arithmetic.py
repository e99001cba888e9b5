"""Arithmetic of two cubes: cells with equal labels meet; a cube that lacks a dimension meets all labels of the other's."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.missing import safe_div
from fluxcube.functions.units import registry
from fluxcube.meta import CubeError, CubeMeta, VariableMeta

OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": safe_div}


def _unit(op: str, a: VariableMeta, b: VariableMeta) -> tuple[str, float]:
    """Unit of the result and the factor that the second operand needs. Sums and ratios take convertible units; a product
    needs one operand without dimension."""
    context = a.gwp_context or b.gwp_context
    if op in "+-":
        return a.unit, registry.factor(b.unit, a.unit, context)
    if op == "/":
        return (a.unit, registry.parse(b.unit).factor) if not registry.parse(b.unit).dims else ("", registry.factor(b.unit, a.unit, context))
    for one, other in ((a, b), (b, a)):
        if not registry.parse(other.unit).dims:
            return one.unit, 1.0
    raise CubeError(f"A product of {a.unit!r} and {b.unit!r} is no emission unit.")


def combine(a: Cube, b: Cube, op: Literal["+", "-", "*", "/"], name: str = "result", join: Literal["inner", "left", "exact"] = "inner") -> Cube:
    """`a op b` for cubes of one variable each. `exact`: raise unless both have the same labels along shared dimensions."""
    if len(a.meta.variables) != 1 or len(b.meta.variables) != 1:
        raise CubeError("Arithmetic takes cubes of one variable; choose one with variable().")
    (ma,), (mb,) = a.meta.variables.values(), b.meta.variables.values()
    unit, factor = _unit(op, ma, mb)
    shared = [d for d in a.meta.axes if d in b.meta.axes and d in b.df.columns and d in a.df.columns]
    if join == "exact":
        for d in shared:
            require_same_axis(a, b, d)
    cond = F.lit(True)
    for d in shared:
        cond &= F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}"))
    dims = [*a.meta.dims, *[d for d in b.meta.dims if d not in a.meta.dims]]
    joined = a.df.alias("a").join(b.df.alias("b"), cond, "left" if join == "left" else "inner")
    column = lambda d: F.col(f"a.{d}" if d in a.df.columns else f"b.{d}").alias(d)
    value = OPERATORS[op](F.col("a.value"), F.col("b.value") * F.lit(factor))
    df = joined.select(*[column(d) for d in dims], column("time"), F.lit(name).alias("variable"), value.alias("value"))
    return Cube(df, CubeMeta(tuple(dims), {name: VariableMeta(name, unit, ma.gwp_context)}, {**b.meta.long_names, **a.meta.long_names}, dict(a.meta.attrs)))


def require_same_axis(a: Cube, b: Cube, dim: str) -> None:
    """Raise unless both cubes have the same labels along `dim`."""
    dim = a.meta.resolve(dim)
    x, y = a.axis(dim), b.axis(dim)
    odd = x.exceptAll(y).union(y.exceptAll(x)).limit(5).collect()
    if odd:
        raise CubeError(f"The axes of {dim!r} differ, for example at {[r[0] for r in odd]}.")


def to_frame(cube: Cube, columns: str | None = None, values: list | None = None):
    """A wide frame: labels of `columns` (a dimension or `entity`; the last dimension if none is given) become columns.

    Without `values` one action collects the labels: as many as there are columns to make.
    """
    dim = "variable" if columns in ("entity", "variable") else cube.meta.resolve(columns or cube.meta.axes[-1])
    keys = [k for k in cube.keys if k != dim]
    pivoted = cube.df.groupBy(*keys).pivot(dim, values) if values else cube.df.groupBy(*keys).pivot(dim)
    return pivoted.agg(F.first("value", ignorenulls=True))
