"""Sums, counts and coverage that know about missing cells, and aggregates added along a dimension."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.missing import sum_rule
from fluxcube.functions.units import registry
from fluxcube.meta import CubeError
from fluxcube.operators.align import merge
from fluxcube.operators.select import condition

ENTITY = ("entity", "variable")


def _reduced(cube: Cube, dim: str | Iterable[str] | None, reduce_to_dim: str | Iterable[str] | None) -> list[str]:
    """Columns that a reduction removes; `variable` for the entity."""
    if dim is not None and reduce_to_dim is not None:
        raise CubeError("Only one of 'dim' and 'reduce_to_dim' may be given, not both.")
    named = lambda x: ["variable" if n in ENTITY else cube.meta.resolve(n) for n in ([x] if isinstance(x, str) else x)]
    if dim is not None:
        return named(dim)
    axes = [*cube.meta.axes]
    if reduce_to_dim is not None:
        kept = named(reduce_to_dim)
        return [a for a in [*axes, "variable"] if a not in kept] if len(cube.meta.variables) > 1 and "variable" not in kept and any(n in ENTITY for n in ([reduce_to_dim] if isinstance(reduce_to_dim, str) else reduce_to_dim)) else [a for a in axes if a not in kept]
    return axes


def _cells(cube: Cube, reduced: Sequence[str]) -> Column:
    """The number of cells that a sum over `reduced` takes in, by variable."""
    sizes = {d: len(cube.meta.domains[d]) for d in reduced if d != "variable"}
    count = lambda v: prod(sizes[d] for d in sizes if d == "time" or d in cube.meta.dims_of(v)) * (len(cube.meta.variables) if "variable" in reduced else 1)
    counts = {v: count(v) for v in cube.meta.variables}
    if len(set(counts.values())) <= 1:
        return F.lit(next(iter(counts.values()), prod(sizes.values())))
    out = F.lit(0)
    for v, n in counts.items():
        out = F.when(F.first("variable") == v, n).otherwise(out)
    return out


def _common_unit(cube: Cube) -> tuple[Cube, str | None]:
    """All variables in the unit of the first one."""
    metas = list(cube.meta.variables.items())
    if len({cube.meta.dims_of(v) for v, _ in metas}) > 1:
        raise NotImplementedError("Variables with different dimensions can't be reduced along the entity.")
    unit = metas[0][1].unit
    factors = {v: registry.factor(m.unit, unit, m.gwp_context or metas[0][1].gwp_context) for v, m in metas if m.unit != unit}
    if not factors:
        return cube, unit
    value = F.col("value")
    for v, x in factors.items():
        value = F.when(F.col("variable") == v, F.col("value") * x).otherwise(value)
    return cube.with_df(cube.df.withColumn("value", value)), unit


def sum_cells(
    cube: Cube,
    dim: str | Iterable[str] | None = None,
    *,
    reduce_to_dim: str | Iterable[str] | None = None,
    skipna: bool | None = None,
    skipna_evaluation_dims: str | Iterable[str] | None = None,
    min_count: int | None = None,
    total_name: str = "total",
) -> Cube:
    """Sum over `dim` (or over all but `reduce_to_dim`; over everything if neither is given).

    See `functions.missing.sum_rule` for missing cells. `skipna_evaluation_dims`: cells count as zero where all cells
    along these dimensions are missing, and any other missing cell makes its sum missing. Summing over the entity needs
    equal dimensions and convertible units. Groups without any row stay absent, which reads as missing.
    """
    cube.require_no_processing_info()
    reduced = _reduced(cube, dim, reduce_to_dim)
    if skipna_evaluation_dims is not None:
        if skipna is not None:
            raise CubeError("Only one of 'skipna' and 'skipna_evaluation_dims' may be supplied, not both.")
        cube, skipna = fill_all_na(cube, skipna_evaluation_dims), False
    if skipna is False:
        cube = cube.with_domains(*[d for d in reduced if d != "variable"])
    if "variable" in reduced:
        cube, unit = _common_unit(cube)
    keys = [k for k in cube.keys if k not in reduced]
    cells = _cells(cube, reduced) if skipna is False else None
    df = cube.df.groupBy(*keys).agg(sum_rule(F.col("value"), skipna, min_count, cells).alias("value"))
    meta = cube.meta.without(reduced)
    if "variable" in reduced:
        df = df.withColumn("variable", F.lit(total_name))
        first = next(iter(cube.meta.variables.values()))
        meta = meta.with_(variables={total_name: replace(first, entity=total_name, unit=unit)})
    return cube.with_df(df, meta)


def count(cube: Cube, dim: str | Iterable[str] | None = None, *, reduce_to_dim: str | Iterable[str] | None = None) -> DataFrame:
    """Number of cells with data; groups that have no row are absent."""
    reduced = _reduced(cube, dim, reduce_to_dim)
    return cube.df.groupBy(*[k for k in cube.keys if k not in reduced]).agg(F.count("value").alias("value"))


def any_cell(cube: Cube, dim: str | Iterable[str] | None = None, *, reduce_to_dim: str | Iterable[str] | None = None) -> DataFrame:
    """Whether any cell is other than zero. A cell that has a row but no value counts as true, as NaN does."""
    reduced = _reduced(cube, dim, reduce_to_dim)
    return cube.df.groupBy(*[k for k in cube.keys if k not in reduced]).agg(F.bool_or(F.coalesce(F.col("value") != 0, F.lit(True))).alias("value"))


def fill_all_na(cube: Cube, dim: str | Iterable[str], value: float = 0.0) -> Cube:
    """Fill missing cells where all cells along `dim` are missing. Dimensions that a variable lacks don't count for it."""
    cube.require_no_processing_info()
    dims = cube.meta.resolve_all(dim)
    if not dims:
        return cube
    dense = cube.densify(*cube.meta.axes)
    series = Window.partitionBy(*[k for k in cube.keys if k not in dims])
    empty = F.count("value").over(series) == 0
    return dense.with_df(dense.df.withColumn("value", F.when(empty, F.lit(float(value))).otherwise(F.col("value"))))


def coverage(cube: Cube, *dims: str, pivot: bool = False) -> DataFrame:
    """Number of cells with data for each combination of `dims` (`entity` among them if wanted), zeros included.

    Variables that lack one of the dimensions are left out. With `pivot` the last dimension becomes columns.
    """
    cube.require_no_processing_info()
    if not dims:
        raise CubeError("Specify at least one dimension.")
    names = ["variable" if d in ENTITY else cube.meta.resolve(d) for d in dims]
    own = [v for v in cube.meta.variables if all(n in ("variable", "time") or n in cube.meta.dims_of(v) for n in names)]
    rows = cube.df.where(F.col("variable").isin(*own)) if len(own) < len(cube.meta.variables) else cube.df
    counts = rows.groupBy(*names).agg(F.count("value").alias("n"))
    full = None
    for n in names:
        axis = cube.df.sparkSession.createDataFrame([(v,) for v in own], "variable string") if n == "variable" else cube.axis(n)
        full = axis if full is None else full.crossJoin(axis)  # domains of a few dimensions, not rows
    out = full.join(counts, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("coverage"))
    return out.groupBy(*names[:-1]).pivot(names[-1]).agg(F.first("coverage")) if pivot else out


@dataclass(frozen=True)
class Rule:
    """One aggregate: `target` is the sum of `sources`, perhaps only for `sel`."""

    target: str
    sources: Sequence[str]
    sel: Mapping[str, Any] = field(default_factory=dict)
    tolerance: float | None = None
    skipna: bool = True
    min_count: int = 1


def levels(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Rules in the fewest passes in which each sees the results of the earlier ones it needs."""
    out: list[list[Rule]] = []
    level_of: list[int] = []
    for i, r in enumerate(rules):
        need = [level_of[j] + 1 for j in range(i) if rules[j].target in r.sources or rules[j].target == r.target]
        level = max(need, default=0)
        level_of.append(level)
        while len(out) <= level:
            out.append([])
        out[level].append(r)
    return out


def add_aggregates_coordinates(cube: Cube, agg_info: Mapping[str, Sequence[Rule]], tolerance: float = 0.01, check: bool = True) -> Cube:
    """Add sums along dimensions as new labels (or check them against labels that exist, within the tolerance).

    Rules of one level are computed in one pass over the cube, for all variables at once. Labels that the dimension doesn't
    have yet meet no cells, so their rows are appended; only the others are merged and checked.
    """
    cube.require_no_processing_info()
    for name, rules in agg_info.items():
        dim = cube.meta.resolve(name)
        cube = cube.with_domains(dim)
        for level in levels(rules):
            for tol in sorted({r.tolerance if r.tolerance is not None else tolerance for r in level}):
                part = [r for r in level if (r.tolerance if r.tolerance is not None else tolerance) == tol]
                fresh = [r for r in part if r.target not in cube.meta.domains[dim]]
                old = [r for r in part if r.target in cube.meta.domains[dim]]
                added = _apply_level(cube, dim, fresh) if fresh else None
                if old:
                    cube = merge(cube, _apply_level(cube, dim, old), tolerance=tol, check=check)
                if added is not None:
                    cube = cube.with_df(cube.df.select(*cube.keys, "value").union(added.df), cube.meta.with_(domains=added.meta.domains))
    return cube


def _apply_level(cube: Cube, dim: str, rules: Sequence[Rule]) -> Cube:
    targets = []
    for r in rules:
        cond = F.col(dim).isin(*r.sources)
        for key, sel in r.sel.items():
            if key == "entity":
                own = [v for v, m in cube.meta.variables.items() if m.entity in ([sel] if isinstance(sel, str) else sel)]
                cond &= F.col("variable").isin(*own)
            elif key == "variable":
                cond &= F.col("variable").isin(*([sel] if isinstance(sel, str) else sel))
            else:
                cond &= condition(cube.meta.resolve(key), sel)
        targets.append(F.when(cond, F.struct(F.lit(r.target).alias("t"), F.lit(r.min_count if r.skipna else len(r.sources)).alias("least"))))
    hits = cube.df.withColumn("_t", F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull()))).withColumn(dim, F.col("_t.t"))
    df = hits.groupBy(*cube.keys).agg(F.when(F.count("value") >= F.max("_t.least"), F.sum("value")).alias("value")).where("value is not null")
    domains = cube.meta.domains
    if dim in domains:
        domains = {**domains, dim: tuple(sorted({*domains[dim], *[r.target for r in rules]}))}
    return cube.with_df(df.select(*cube.keys, "value"), cube.meta.with_(domains=domains))
