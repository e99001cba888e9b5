"""Downscaling: a total is known for more times than its parts; the parts' shares are interpolated and multiplied back."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.meta import CubeError
from fluxcube.operators.aggregate import fill_all_na
from fluxcube.operators.align import set_values
from fluxcube.operators.gwp import _basket_meta, factors_to, scaled_by_variable
from fluxcube.operators.select import condition, select_no_scalar_dimension

log = logging.getLogger(__name__)


class DownscalingError(ValueError):
    """Total and parts don't fit together."""


def interpolated(value: Column, series: Sequence[str]) -> Column:
    """`value` along `time` within each series: linear between known points by days, constant outside of them.

    Both windows share one partitioning, so a plan with this has one shuffle for it.
    """
    w = Window.partitionBy(*series).orderBy("time")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    day = F.unix_date("time").cast("double")
    point = F.when(value.isNotNull(), F.struct(day.alias("x"), value.alias("q")))
    p0, p1 = F.last(point, ignorenulls=True).over(before), F.first(point, ignorenulls=True).over(after)
    between = p0["q"] + (p1["q"] - p0["q"]) * (day - p0["x"]) / (p1["x"] - p0["x"])
    return F.coalesce(value, F.when(p0.isNull(), p1["q"]).when(p1.isNull(), p0["q"]).otherwise(between))


def _check(state: DataFrame, tolerance: float, consistency: bool, hint: str) -> bool:
    """One action: raises where total and parts disagree; returns whether the parts hold anything but zeros."""
    parts, total = F.col("parts_sum"), F.col("total")
    deviation = F.when(parts != 0, F.abs(total / parts - 1)).when((parts == 0) & (total != 0), F.lit(float("inf")))
    row = state.agg(F.max(deviation).alias("worst"), F.coalesce(F.sum(((total != 0) & (parts == 0)).cast("int")), F.lit(0)).alias("lost"), F.coalesce(F.max((parts != 0).cast("int")), F.lit(0)).alias("nonzero")).first()
    if consistency and row["worst"] is not None and row["worst"] > tolerance:
        example = state.where(deviation > tolerance).limit(5).collect()
        raise DownscalingError(f"{hint}: total and parts deviate by up to {row['worst']:.3g}, the tolerance is {tolerance}. For example {[r.asDict() for r in example]}")
    if row["lost"]:
        raise DownscalingError(f"{hint}: found zero basket content sum where the total is not zero, {row['lost']} times.")
    return bool(row["nonzero"])


def _downscaled(cells: DataFrame, keys: Sequence[str], part: str, total_label: str, parts: Sequence[str], skipna: bool, tolerance: float, consistency: bool) -> DataFrame:
    """Rows (keys, value) for the parts at every time of the total. `cells` hold total and parts, `part` names the column.

    One aggregation brings total, sum and known parts of a time together, one window runs along the series; no join.
    """
    rest = [k for k in keys if k != part]
    is_part = F.col(part) != total_label
    total = F.max(F.when(~is_part, F.col("value")))
    parts_sum = F.sum(F.when(is_part, F.col("value")))
    if not skipna:
        parts_sum = F.when(F.count_if(F.col("value").isNotNull() & is_part) == len(parts), parts_sum)
    known = F.map_from_entries(F.collect_list(F.when(is_part & F.col("value").isNotNull(), F.struct(F.col(part), F.col("value")))))  # the parts that the caller wrote, at most
    state = cells.groupBy(*rest).agg(total.alias("total"), parts_sum.alias("parts_sum"), known.alias("known"))
    nonzero = _check(state.drop("known"), tolerance, consistency, f"downscaling of {total_label!r}")
    grid = state.withColumn(part, F.explode(F.array(*[F.lit(p) for p in parts]))).withColumn("value", F.try_element_at("known", F.col(part)))
    both_zero = (F.col("total") == 0) & (F.col("parts_sum") == 0)
    if nonzero:
        share = F.when(F.col("parts_sum") != 0, F.col("value") / F.col("parts_sum"))
    else:  # nothing but zeros: equal shares
        share = F.when(both_zero, F.lit(1.0 / len(parts))).when(F.col("parts_sum") != 0, F.col("value") / F.col("parts_sum"))
    filled = grid.withColumn("share", interpolated(share, [k for k in keys if k != "time"]))
    if nonzero:
        filled = filled.withColumn("share", F.when(F.coalesce(both_zero, F.lit(False)), F.lit(0.0)).otherwise(F.col("share")))
    return filled.select(*keys, F.coalesce("value", F.col("total") * F.col("share")).alias("value"))


def _replaced(cube: Cube, column: str, parts: Sequence[str], sel: Mapping[str, Any] | None, new: DataFrame) -> Cube:
    """The cube with the selected cells of the parts exchanged for `new`, which holds all of them."""
    chosen = F.col(column).isin(*parts)
    for name, selector in (sel or {}).items():
        chosen &= condition(cube.meta.resolve(name), selector)
    others = cube.df.where(~F.coalesce(chosen, F.lit(False))).select(*cube.keys, "value")
    return cube.with_df(others.unionByName(new.select(*cube.keys, "value")))


def downscale_timeseries(
    cube: Cube,
    dim: str,
    basket: str,
    basket_contents: Sequence[str],
    *,
    check_consistency: bool = True,
    sel: Mapping[str, Any] | None = None,
    skipna_evaluation_dims: str | Iterable[str] | None = None,
    skipna: bool = True,
    tolerance: float = 0.01,
) -> Cube:
    """Fill the `basket_contents` of `dim` from the `basket`, for all variables at once. Cells that hold data never change."""
    cube.require_no_processing_info()
    dim = cube.meta.resolve(dim)
    if skipna_evaluation_dims is not None:
        if skipna:
            raise CubeError("skipna_evaluation_dims needs skipna=False.")
    part = select_no_scalar_dimension(cube, sel)
    cells = part.with_df(part.df.where(F.col(dim).isin(basket, *basket_contents)))
    if skipna_evaluation_dims is not None:
        contents = cells.with_df(cells.df.where(F.col(dim) != basket), cells.meta.with_(domains={k: v for k, v in cells.meta.domains.items() if k != dim}))
        filled = fill_all_na(contents, skipna_evaluation_dims)
        cells = cells.with_df(filled.df.where("value is not null").unionByName(cells.df.where(F.col(dim) == basket).select(*cells.keys, "value")))
    df = _downscaled(cells.df, cube.keys, dim, basket, list(basket_contents), skipna, tolerance, check_consistency)
    return _replaced(cube, dim, basket_contents, sel, df)


def downscale_gas_timeseries(
    cube: Cube,
    basket: str,
    basket_contents: Sequence[str],
    *,
    check_consistency: bool = True,
    sel: Mapping[str, Any] | None = None,
    skipna_evaluation_dims: str | Iterable[str] | None = None,
    skipna: bool = True,
    tolerance: float = 0.01,
) -> Cube:
    """Fill gases from a gas basket: shares are taken in the basket's unit and context, results are in the gases' own."""
    cube.require_no_processing_info()
    if skipna_evaluation_dims is not None and skipna:
        raise CubeError("skipna_evaluation_dims needs skipna=False.")
    meta = _basket_meta(cube, basket, None)
    factors = {basket: 1.0, **factors_to(cube, basket_contents, meta)}
    part = select_no_scalar_dimension(cube, sel).variable(basket, *basket_contents)
    if skipna_evaluation_dims is not None:
        filled = fill_all_na(part.variable(*basket_contents), skipna_evaluation_dims)
        part = part.with_df(filled.df.where("value is not null").unionByName(part.df.where(F.col("variable") == basket).select(*part.keys, "value")))
    in_basket = part.df.withColumn("value", scaled_by_variable(factors))
    df = _downscaled(in_basket, cube.keys, "variable", basket, list(basket_contents), skipna, tolerance, check_consistency)
    back = df.withColumn("value", scaled_by_variable({k: v for k, v in factors.items() if k != basket}, inverse=True))
    return _replaced(cube, "variable", basket_contents, sel, back)


def downscale_timeseries_by_shares(cube: Cube, dim: str, basket: str, basket_contents: Sequence[str], basket_contents_shares: Cube | DataFrame) -> Cube:
    """New parts of a total from given weights, normalised over the parts. Variables without weights are dropped.

    Parts that already hold data raise; totals and weights without a common cell raise.
    """
    dim = cube.meta.resolve(dim)
    weights = basket_contents_shares.df if isinstance(basket_contents_shares, Cube) else basket_contents_shares
    weights = weights.where(F.col(dim).isin(*basket_contents))
    rest = [k for k in cube.keys if k != dim and k in weights.columns]
    share = F.col("value") / F.sum("value").over(Window.partitionBy(*rest))
    shares = weights.withColumn("share", share).select(*rest, dim, "share")
    totals = cube.df.where(F.col(dim) == basket).drop(dim)
    cond = F.lit(True)
    for k in rest:
        cond &= F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    out = totals.alias("t").join(shares.alias("s"), cond).select(*[F.col(f"s.{k}" if k == dim else f"t.{k}").alias(k) for k in cube.keys], (F.col("t.value") * F.col("s.share")).alias("value"))
    if "variable" in rest:
        present = {r[0] for r in weights.select("variable").distinct().collect()}
        if gone := sorted(set(cube.meta.variables) - present):
            log.warning("variables without shares are dropped: %s", gone)
        cube = cube.variable(*[v for v in cube.meta.variables if v in present])
    if not out.limit(1).count():
        raise DownscalingError("Totals and shares have no cell in common.")
    return set_values(cube, dim, list(basket_contents), out)
