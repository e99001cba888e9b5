"""Composition of one series per variable and fixed dimensions from prioritised sources.

Substitution alone is one aggregation. Other strategies run per series, as grouped numpy; a group is one series' cells
from all its sources.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.meta import CubeError, CubeMeta, DimensionNotExistingError
from fluxcube.operators.select import condition, loc, select_no_scalar_dimension
from fluxcube.operators.validate import ensure_valid
from fluxcube.plans.definitions import PriorityDefinition, StrategyDefinition, StrategyUnableToProcess, matches
from fluxcube.plans.strategies import EPOCH
from fluxcube.session import ship_package

STEPS = "array<struct<time:array<string>,function:string,description:string,source:string>>"


def _condition(cube: Cube, selector: Mapping[str, Any]) -> Column:
    parts = []
    for k, v in selector.items():
        if k == "entity":
            own = [n for n, m in cube.meta.variables.items() if matches({"entity": v}, {"entity": m.entity})]
            parts.append(F.col("variable").isin(*own))
        else:
            parts.append(condition("variable" if k == "variable" else cube.meta.resolve(k), v))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def rank(cube: Cube, priorities: PriorityDefinition) -> Column:
    """Place of a row's source in the priorities; NULL if it has none or is excluded."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(priorities.priorities))):
        out = F.when(_condition(cube, priorities.priorities[k]), F.lit(k)).otherwise(out)
    for sel in (*priorities.exclude_input, *priorities.exclude_result):
        out = F.when(~F.coalesce(_condition(cube, sel), F.lit(False)), out)
    return out


def _result_meta(cube: Cube, dims: Sequence[str]) -> CubeMeta:
    return cube.meta.without(dims)


def compose_substitution(cube: Cube, priorities: PriorityDefinition) -> Cube:
    """Of each cell the value of the first source that has one: one aggregation, no Python on the executors.

    Values alone: no processing table, and a series that no priority fits has no cells.
    """
    priorities.check()
    dims = cube.meta.resolve_all(priorities.priority_dimensions)
    keys = [k for k in cube.keys if k not in dims]
    ranked = cube.df.where("value is not null").withColumn("_r", rank(cube, priorities)).where("_r is not null")
    return cube.with_df(ranked.groupBy(*keys).agg(F.min_by("value", "_r").alias("value")), _result_meta(cube, dims))


def label_of(labels: Mapping[str, Any], dims: Sequence[str]) -> str:
    """How a source is called in descriptions: its value, or all of them if there are several priority dimensions."""
    return f"'{labels[dims[0]]}'" if len(dims) == 1 else repr({d: labels[d] for d in dims})


def compose_series(days: np.ndarray, sources: Mapping[tuple, np.ndarray], labels: Mapping[str, Any], dims: Sequence[str], priorities: PriorityDefinition, strategies: StrategyDefinition) -> tuple[np.ndarray, list[dict]]:
    """One series from its sources, in order of priority, until nothing is missing."""
    result, steps, seen = np.full(len(days), np.nan), [], False
    for priority in priorities.priorities:
        if not matches(priorities.fixed_part(priority), labels):
            continue
        own = {**labels, **{d: priority[d] for d in dims}}
        series = sources.get(tuple(priority[d] for d in dims))
        if series is None:
            continue
        seen = True
        name = label_of(own, dims)
        note = lambda text: steps.append({"time": ["all"], "function": "initial", "description": text, "source": name})  # noqa: B023, E731
        if any(matches(x, own) for x in priorities.exclude_input):
            note(f"{name} is excluded from processing, skipped")
            continue
        if np.isnan(series).all():
            note(f"{name} is fully NaN, skipped")
            continue
        for strategy in strategies.find(own):
            try:
                result, new = strategy.fill(days, result, series, name)
            except StrategyUnableToProcess as e:
                steps.append({"time": ["all"], "function": strategy.type, "description": f"strategy {strategy.type} unable to process {name}: {e.reason}, skipping to next strategy", "source": name})
                continue
            steps += new
            break
        else:
            raise CubeError(f"No strategy could process {name} for {dict(labels)!r}.")
        if not np.isnan(result).any():
            break
    if not seen:
        raise CubeError(f"No priority fits {dict(labels)!r}.")
    return result, steps


def compose(cube: Cube, priorities: PriorityDefinition, strategies: StrategyDefinition) -> Cube:
    """Compose every variable and every combination of fixed dimensions; priority dimensions vanish.

    The result carries a processing table: `variable`, the fixed dimensions and the steps of each series, NULL for
    excluded results.
    """
    priorities.check()
    dims = list(cube.meta.resolve_all(priorities.priority_dimensions))
    if list(priorities.priority_dimensions) != dims:
        raise CubeError(f"Name the priority dimensions by their columns: {dims}")
    ship_package(cube.df.sparkSession)
    cube = cube.with_domains("time")
    days = np.array([(t - EPOCH).days for t in cube.meta.domains["time"]], float)
    fixed = [d for d in cube.meta.dims if d not in dims]
    keys = ["variable", *fixed]
    entities = {k: m.entity for k, m in cube.meta.variables.items()}

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        labels = dict(zip(keys, key)) | {"entity": entities.get(key[0], key[0])}
        if any(matches(x, labels) for x in priorities.exclude_result):
            return pd.DataFrame([[*key, None, None, None]], columns=[*keys, "time", "value", "steps"])
        at = {d: i for i, d in enumerate(days.tolist())}
        sources: dict[tuple, np.ndarray] = {}
        for s, part in rows.groupby(dims, sort=False, dropna=False):
            series = np.full(len(days), np.nan)
            place = [at[float((t - EPOCH).days)] for t in part["time"]]
            series[place] = part["value"].astype(float).to_numpy()
            sources[s if isinstance(s, tuple) else (s,)] = series
        result, steps = compose_series(days, sources, labels, dims, priorities, strategies)
        data = [[*key, EPOCH + datetime.timedelta(int(d)), float(v), None] for d, v in zip(days, result) if not np.isnan(v)]
        return pd.DataFrame([*data, [*key, None, None, steps]], columns=[*keys, "time", "value", "steps"])

    kinds = ", ".join(f"`{k}` string" for k in keys)
    out = cube.df.select(*keys, *dims, "time", "value").groupBy(*keys).applyInPandas(one, f"{kinds}, time date, value double, steps {STEPS}")
    meta = _result_meta(cube, dims)
    cells = out.where("time is not null").select(*meta.dims, "time", "variable", "value")
    done = Cube(cells, meta.with_(domains={"time": cube.meta.domains["time"]}), out.where("time is null").select(*keys, "steps"))
    return done


def _by_columns(meta: CubeMeta, selector: Mapping[str, Any]) -> dict[str, Any]:
    """A selector that names dimensions by their columns; names that the cube doesn't know stay."""
    names = {}
    for k in selector:
        try:
            names[k] = k if k in ("entity", "variable") else meta.resolve(k)
        except DimensionNotExistingError:
            names[k] = k
    return {names[k]: v for k, v in selector.items()}


def create_composite_source(
    cube: Cube,
    priorities: PriorityDefinition,
    strategies: StrategyDefinition,
    *,
    result_prio_coords: Mapping[str, Mapping[str, str]],
    limit_coords: Mapping[str, Any] | None = None,
    time_range: tuple[str, str] | None = None,
    metadata: Mapping[str, object] | None = None,
) -> Cube:
    """Filter, compose, give the priority dimensions their new single values, set attributes and validate.

    `result_prio_coords`: dimension -> {"value": ..., "terminology": ... (optional)}. Every plan goes through `compose`, so
    steps are kept and a series that no priority fits is an error; `compose_substitution` is the faster one without both.
    """
    limits = dict(limit_coords or {})
    names = limits.pop("variable", None)
    if names is not None:
        cube = cube.variable(*([names] if isinstance(names, str) else names))
    cube = select_no_scalar_dimension(cube, {k: [v] if isinstance(v, str) else v for k, v in limits.items()})
    if time_range is not None:
        cube = loc(cube, {"time": slice(*time_range)})
    named = lambda selectors: [_by_columns(cube.meta, x) for x in selectors]
    by_columns = PriorityDefinition(cube.meta.resolve_all(priorities.priority_dimensions), named(priorities.priorities), named(priorities.exclude_input), named(priorities.exclude_result))
    done = compose(cube, by_columns, StrategyDefinition([(_by_columns(cube.meta, x), s) for x, s in strategies.strategies]))
    df, meta = done.df, done.meta
    for dim, spec in result_prio_coords.items():
        df = df.withColumn(dim, F.lit(spec["value"]))
        meta = meta.with_(dims=(*meta.dims, dim), long_names={**meta.long_names, dim: f"{dim} ({spec['terminology']})" if "terminology" in spec else dim}, domains={**meta.domains, dim: (spec["value"],)})
    missing = set(priorities.priority_dimensions) - set(result_prio_coords)
    if missing:
        raise CubeError(f"No values for priority dimensions {sorted(missing)}.")
    out = Cube(df.select(*meta.dims, "time", "variable", "value"), meta.with_attrs(**dict(metadata or {})), done.processing)
    ensure_valid(out)
    return out


def processing_info(cube: Cube) -> DataFrame:
    """The steps of each series, one row for each step."""
    if cube.processing is None:
        raise CubeError("The cube has no processing information.")
    return cube.processing.select("*", F.posexplode_outer("steps").alias("step_number", "step")).drop("steps").select("*", "step.*").drop("step")
