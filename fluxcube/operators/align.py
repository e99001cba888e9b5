"""Combining two cubes cell by cell: filling, merging within a tolerance, setting values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.cube import Cube, to_date
from fluxcube.functions.missing import safe_div
from fluxcube.functions.units import registry
from fluxcube.meta import CubeError, CubeMeta


class MergeError(ValueError):
    """Two cubes disagree by more than the tolerance."""


def _full(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of both with the values `va` and `vb`: a union and one hash aggregation, which takes NULL keys as equal,
    needs no sort and leaves no hot key to a join."""
    nothing = F.lit(None).cast("double")
    sides = a.select(*keys, F.col("value").alias("va"), nothing.alias("vb")).union(b.select(*keys, nothing.alias("va"), F.col("value").alias("vb")))
    return sides.groupBy(*keys).agg(F.max("va").alias("va"), F.max("vb").alias("vb"))


def _joint_meta(a: CubeMeta, b: CubeMeta) -> CubeMeta:
    domains = {d: tuple(sorted({*a.domains[d], *b.domains[d]})) for d in a.domains if d in b.domains}
    return a.with_(variables={**b.variables, **a.variables}, domains=domains, coords={**b.coords, **a.coords})


def in_units_of(cube: Cube, other: Cube) -> Cube:
    """`cube` with the variables that `other` has too in `other`'s units."""
    value = F.col("value")
    variables = dict(cube.meta.variables)
    for name, m in other.meta.variables.items():
        mine = variables.get(name)
        if mine is not None and mine.unit is not None and m.unit is not None and mine.unit != m.unit:
            factor = registry.factor(mine.unit, m.unit, m.gwp_context)
            value = F.when(F.col("variable") == name, F.col("value") * factor).otherwise(value)
            variables[name] = m
    return cube.with_df(cube.df.withColumn("value", value), cube.meta.with_(variables=variables))


def combine_first(cube: Cube, other: Cube) -> Cube:
    """Missing cells from `other`; the cells of both."""
    other = in_units_of(other, cube)
    df = _full(cube.df, other.df, cube.keys).select(*cube.keys, F.coalesce("va", "vb").alias("value"))
    return cube.with_df(df, _joint_meta(cube.meta, other.meta))


def fillna(cube: Cube, other: Cube) -> Cube:
    """Missing cells from `other`, within the labels that the cube has."""
    cube = cube.with_domains()
    other = in_units_of(other, cube)
    inside = other.df.where(F.col("variable").isin(*cube.meta.variables))
    for d in cube.meta.axes:
        inside = inside.where(F.col(d).isin(*cube.meta.domains[d]) | F.col(d).isNull())
    df = _full(cube.df, inside, cube.keys).select(*cube.keys, F.coalesce("va", "vb").alias("value"))
    return cube.with_df(df)


def ensure_compatible(a: Cube, b: Cube) -> None:
    """Both must have the same dimensions and additional coordinates, by name."""
    for what, x, y in (("dimensions", {*a.meta.dims}, {*b.meta.dims}), ("coordinates", {*a.meta.coords}, {*b.meta.coords})):
        if x != y:
            raise CubeError(f"{what} of the cubes to merge don't agree: {sorted(x ^ y)} are in one of them only.")


def deviations(cube: Cube, other: Cube, tolerance: float, absolute: bool = False) -> DataFrame:
    """Cells of both with a relative deviation above the tolerance. It is relative to the signed first value, so that
    negative first values never deviate, unless `absolute` is set; from zero, anything but zero is infinitely far."""
    base = F.abs("va") if absolute else F.col("va")
    both = _full(cube.df, in_units_of(other, cube).df, cube.keys).where("va is not null and vb is not null")
    return both.withColumn("deviation", safe_div(F.abs(F.col("va") - F.col("vb")), base)).where(F.col("deviation") > tolerance)


def merge(cube: Cube, other: Cube, tolerance: float = 0.01, error_on_discrepancy: bool = True, combine_attrs: str = "drop_conflicts", check: bool = True, absolute: bool = False) -> Cube:
    """The cells of both; where both have data they must agree within the tolerance, and the first one's stay.

    A disagreement raises `MergeError` with the first few cells, or is reported as a warning. `check=False` skips the
    action that looks for one and keeps the plan lazy.
    """
    cube.require_no_processing_info()
    ensure_compatible(cube, other)
    if check:
        found = deviations(cube, other, tolerance, absolute).limit(20).collect()
        if found:
            message = merge_message(cube, found, tolerance)
            if error_on_discrepancy:
                raise MergeError(message)
            import warnings

            warnings.warn(message, stacklevel=2)
    out = combine_first(cube, other)
    return out.with_df(out.df, out.meta.with_(attrs=combine_attributes(cube.meta.attrs, other.meta.attrs, combine_attrs)))


def merge_message(cube: Cube, found: Sequence[Any], tolerance: float) -> str:
    """What deviates: labels that all cells share come first, then a line for each cell; yearly dates as years."""
    keys = [k for k in cube.keys if k in found[0]]
    yearly = all(r["time"] is None or (r["time"].month, r["time"].day) == (1, 1) for r in found) if "time" in keys else False
    show = lambda k, v: str(v.year) if k == "time" and yearly and v is not None else str(v)
    common = {k: show(k, found[0][k]) for k in keys if len({show(k, r[k]) for r in found}) == 1}
    lines = [", ".join(show(k, r[k]) for k in keys if k not in common) + f": {r['va']} and {r['vb']}" for r in found]
    where = ", ".join(f"{k}={v}" for k, v in common.items())
    return f"The cubes differ by more than {tolerance:.2%} at {where}:\n" + "\n".join(lines)


def combine_attributes(a: dict, b: dict, policy: str) -> dict:
    if policy == "override":
        return dict(a)
    if policy == "drop":
        return {}
    clash = {k for k in a if k in b and a[k] != b[k]}
    if policy in ("no_conflicts", "identical") and (clash or policy == "identical" and dict(a) != dict(b)):
        raise MergeError(f"conflicting attributes: {sorted(clash)}")
    return {k: v for k, v in {**b, **a}.items() if k not in clash}


def set_values(
    cube: Cube,
    dim: str,
    key: Any,
    value: float | DataFrame | Cube,
    *,
    existing: Literal["fillna_empty", "fillna", "overwrite", "error"] = "fillna_empty",
    new: Literal["extend", "error"] = "extend",
) -> Cube:
    """Set `value` at labels `key` of `dim`.

    `value`: a number, a cube, or a DataFrame whose columns are `value` and some of the cube's keys; dimensions that it
    lacks are filled from the labels of the cube, a missing `dim` with `key`. Existing labels: `fillna_empty` raises if
    one holds data, `fillna` keeps data, `overwrite` replaces everything at the labels (by missing cells, too), `error`
    raises. New labels are added (`extend`) or raise (`error`). Variables without `dim` stay as they are.
    """
    dim = cube.meta.resolve(dim)
    labels = list(key) if isinstance(key, (list, tuple, set)) else [key]
    labels = [to_date(x) for x in labels] if dim == "time" else labels
    cube = cube.with_domains()
    known = [x for x in labels if x in cube.meta.domains[dim]]
    unknown = [x for x in labels if x not in cube.meta.domains[dim]]
    if existing == "error" and known:
        raise CubeError(f"Values {known!r} for {dim!r} already exist.")
    if new == "error" and unknown:
        raise KeyError(f"Values {unknown!r} not in {dim!r}.")
    own = [v for v in cube.meta.variables if dim == "time" or dim in cube.meta.dims_of(v)]
    here = cube.df.where(F.col(dim).isin(*labels) & F.col("variable").isin(*own))
    if existing == "fillna_empty" and known and here.where("value is not null").limit(1).count():
        raise CubeError(f"Values {known!r} for {dim!r} already hold data; use existing='overwrite' or 'fillna'.")
    given = _value_rows(cube, dim, labels, value, own)
    if existing == "overwrite":
        df = cube.df.where(~F.coalesce(F.col(dim).isin(*labels) & F.col("variable").isin(*own), F.lit(False))).select(*cube.keys, "value").unionByName(given)
    else:
        df = _full(cube.df, given, cube.keys).select(*cube.keys, F.coalesce("va", "vb").alias("value"))
    domains = {**cube.meta.domains, dim: tuple(sorted({*cube.meta.domains[dim], *labels}))}
    return cube.with_df(df, cube.meta.with_(domains=domains))


def _value_rows(cube: Cube, dim: str, labels: Iterable[Any], value: float | DataFrame | Cube, variables: Sequence[str]) -> DataFrame:
    spark = cube.df.sparkSession
    kind = cube.df.schema[dim].dataType.simpleString()
    at = spark.createDataFrame([(x,) for x in labels], f"`{dim}` {kind}")
    if isinstance(value, Cube):
        value = in_units_of(value, cube).df
    if not isinstance(value, DataFrame):
        rest = [k for k in cube.keys if k != dim]
        frame = cube.df.where(F.col("variable").isin(*variables)).select(*rest).distinct()
        return frame.crossJoin(F.broadcast(at)).select(*cube.keys, F.lit(float(value)).alias("value"))  # labels that the caller wrote
    if dim in value.columns:
        value = value.join(F.broadcast(at), dim, "left_semi")
    else:
        value = value.crossJoin(F.broadcast(at))
    missing = [k for k in cube.keys if k not in value.columns]
    if missing:
        have = [k for k in cube.keys if k in value.columns and k != dim]
        frame = cube.df.where(F.col("variable").isin(*variables)).select(*missing, *have).distinct()
        value = (frame.join(value, have) if have else frame.crossJoin(F.broadcast(value))).distinct()
    return value.where(F.col("variable").isin(*variables)).select(*cube.keys, F.col("value").cast("double").alias("value"))
