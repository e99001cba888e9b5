"""Selection by label: scalars, lists, inclusive slices, partial dates and negation."""

from __future__ import annotations

import calendar
import datetime
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcube.cube import Cube, to_date
from fluxcube.meta import CubeError, CubeMeta, split_long_name


@dataclass(frozen=True)
class Not:
    """Everything in a dimension but a value or a list of values."""

    value: Any


def _period(text: str) -> tuple[datetime.date, datetime.date]:
    """First and last day of `2002`, `2002-05` or `2002-05-31`."""
    first = to_date(text)
    n = text.count("-")
    if n == 0:
        return first, datetime.date(first.year, 12, 31)
    if n == 1:
        return first, datetime.date(first.year, first.month, calendar.monthrange(first.year, first.month)[1])
    return first, first


def condition(column: str, selector: Any) -> Column:
    """The filter of one selector; ranges include both ends."""
    c = F.col(column)
    is_time = column == "time"
    if isinstance(selector, Not):
        return ~condition(column, selector.value)
    if isinstance(selector, slice):
        cond = F.lit(True)
        if selector.start is not None:
            cond &= c >= F.lit(_period(str(selector.start))[0] if is_time else selector.start)
        if selector.stop is not None:
            cond &= c <= F.lit(_period(str(selector.stop))[1] if is_time else selector.stop)
        return cond
    if isinstance(selector, (list, tuple, set, frozenset)):
        if is_time:
            return reduce(lambda a, b: a | b, [condition(column, v) for v in selector], F.lit(False))
        return c.isin(*selector)
    if is_time and isinstance(selector, (str, int)):
        first, last = _period(str(selector))
        return (c >= F.lit(first)) & (c <= F.lit(last))
    return c == F.lit(selector)


def _labels(selector: Any) -> list:
    if isinstance(selector, Not):
        return _labels(selector.value)
    if isinstance(selector, slice):
        return []
    return list(selector) if isinstance(selector, (list, tuple, set, frozenset)) else [selector]


def loc(cube: Cube, selection: Mapping[str, Any], check: bool = True, strict: bool = False) -> Cube:
    """Cells with these labels. A scalar drops its dimension, a list, slice or `Not` keeps it.

    With `check`, labels that the cube does not hold raise KeyError where the domain is known (see `Cube.with_domains`);
    `strict` learns domains that aren't, which runs one action, so that such labels always raise.
    """
    if strict:
        named = [d for d in (cube.meta.resolve(k) for k, v in selection.items() if _labels(v)) if d != "time"]
        cube = cube.with_domains(*named) if named else cube
    meta, df, dropped = cube.meta, cube.df, []
    for name, selector in selection.items():
        dim = meta.resolve(name)
        if check and dim in meta.domains and dim != "time":
            missing = [v for v in _labels(selector) if v not in meta.domains[dim]]
            if missing:
                raise KeyError(f"{missing} not in {dim}")
        df = df.where(condition(dim, selector))
        if not isinstance(selector, (list, tuple, set, frozenset, slice, Not)) and dim != "time":
            dropped.append(dim)
        elif dim in meta.domains and dim != "time":
            keep = set(_labels(selector))
            if isinstance(selector, Not):
                meta = meta.with_(domains={**meta.domains, dim: tuple(v for v in meta.domains[dim] if v not in keep)})
            elif not isinstance(selector, slice):
                meta = meta.with_(domains={**meta.domains, dim: tuple(v for v in meta.domains[dim] if v in keep)})
        if dim == "time" or isinstance(selector, slice):
            meta = meta.with_(domains={k: v for k, v in meta.domains.items() if k != dim})
    return cube.with_df(df.drop(*dropped), meta.without(dropped))


def select_no_scalar_dimension(cube: Cube, selection: Mapping[str, Any] | None) -> Cube:
    """`loc` for selections that must keep every dimension."""
    if not selection:
        return cube
    selection = {k: [v] if isinstance(v, (str, int)) and cube.meta.resolve(k) == "time" else v for k, v in selection.items()}
    scalars = [k for k, v in selection.items() if not isinstance(v, (list, tuple, set, frozenset, slice, Not))]
    if scalars:
        raise CubeError(f"The dimension of the selection doesn't match the dimension of the cube: {scalars} select single values; use lists.")
    return loc(cube, selection)


def assign(cube: Cube, selection: Mapping[str, Any], value: float | None, new_cells: bool = True) -> Cube:
    """Set all selected cells to a value. With `new_cells`, cells without a row are created where the domain has them."""
    dims = cube.meta.resolve_all(list(selection))
    cond = reduce(lambda a, b: a & b, [condition(d, s) for d, s in zip(dims, selection.values())], F.lit(True))
    dense = cube.densify(*dims) if new_cells else cube
    return dense.with_df(dense.df.withColumn("value", F.when(cond, F.lit(value).cast("double")).otherwise(F.col("value"))))


def get(cube: Cube, name: str) -> DataFrame:
    """A variable's cells, or the values of a dimension or additional coordinate, by any of its names."""
    if name in cube.meta.variables:
        return cube.variable(name).df
    if name in cube.meta.coords:
        dim, labels = cube.meta.coords[name]
        return cube.df.sparkSession.createDataFrame(list(labels.items()), f"`{dim}` string, `{name}` string")
    return cube.axis(name)


def expand_dims(cube: Cube, dim: str, value: str, terminology: str | None = None) -> Cube:
    """Add a dimension with one value."""
    if dim in cube.meta.axes:
        raise CubeError(f"There already is a dimension {dim!r}.")
    meta = cube.meta
    meta = meta.with_(
        dims=(*meta.dims, dim),
        variables={k: replace(v, dims=None if v.dims is None else (*v.dims, dim)) for k, v in meta.variables.items()},
        long_names={**meta.long_names, dim: f"{dim} ({terminology})" if terminology else dim},
        domains={**meta.domains, dim: (value,)},
    )
    df = cube.df.withColumn(dim, F.lit(value))
    return cube.with_df(df.select(*meta.dims, "time", "variable", *[c for c in df.columns if c not in (*meta.dims, "time", "variable")]), meta)


def filter_rows(df: DataFrame, keep: Mapping[str, Mapping[str, Any]] | None = None, remove: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """Rows that fit any `keep` rule and no `remove` rule. A rule is a conjunction of equalities or lists; NULL fits nothing."""

    def rule(spec: Mapping[str, Any]) -> Column:
        parts = [F.coalesce(F.col(f"`{c}`").isin(*v) if isinstance(v, (list, tuple, set)) else F.col(f"`{c}`") == F.lit(v), F.lit(False)) for c, v in spec.items()]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    if keep:
        df = df.where(reduce(lambda a, b: a | b, [rule(s) for s in keep.values()]))
    if remove:
        df = df.where(~reduce(lambda a, b: a | b, [rule(s) for s in remove.values()]))
    return df


__all__ = ["Not", "assign", "condition", "expand_dims", "filter_rows", "get", "loc", "select_no_scalar_dimension"]
