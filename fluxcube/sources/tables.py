"""Wide and long tables of emission series, from CSV files or DataFrames, as interchange frames and cubes.

An interchange frame has one row for each series and time (long) with the columns `dimensions..., entity, unit, time,
value`; `to_wide` turns times into columns. Everything is lazy but what must look at distinct spellings.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxcube.cube import Cube
from fluxcube.functions.codes import BLANKS, CodeError, entity_name, ipcc_code, map_distinct, parse_code_column, unit_name
from fluxcube.functions.units import UnitError, registry, split_variable
from fluxcube.meta import CubeError, CubeMeta, VariableMeta, split_long_name
from fluxcube.operators.select import filter_rows

MANDATORY = ("area", "source", "entity", "unit")
#: strptime directives and what Spark calls them
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD"}


def spark_format(time_format: str) -> str:
    for a, b in _FORMATS.items():
        time_format = time_format.replace(a, b)
    return time_format


def matches_time_format(value: str, time_format: str) -> bool:
    try:
        datetime.datetime.strptime(value, time_format)
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class Interchange:
    """A long interchange frame and what is known about it."""

    df: DataFrame
    #: column -> long name, e.g. area -> area (ISO3); secondary categories included
    dimensions: Mapping[str, str]
    attrs: Mapping[str, Any] = field(default_factory=dict)
    time_format: str = "%Y"
    #: additional coordinate -> the dimension it labels
    additional_coordinates: Mapping[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [*self.dimensions, *self.additional_coordinates, "entity", "unit"]


#: Rules by name for `coords_value_mapping`; the entity is mapped first, as units depend on it.
NAMED_RULES: dict[str, dict[str, Callable[..., str]]] = {"COMPACT": {"category": ipcc_code, "entity": entity_name, "unit": unit_name}}


def _check(coords_cols: Mapping[str, str], defaults: Mapping[str, str], add_coords: Mapping[str, Sequence[str]], terminologies: Mapping[str, str]) -> None:
    twice = sorted(set(coords_cols) & set(defaults))
    if twice:
        raise CubeError(f"{twice} given in coords_cols and coords_defaults.")
    for name, (column, dim) in add_coords.items():
        if name in coords_cols or name in defaults:
            raise CubeError(f"{name!r} given in coords_cols and add_coords_cols.")
        if dim not in coords_cols:
            raise CubeError(f"{column!r} refers to unknown coordinate {dim!r} in add_coords_cols.")
    missing = [d for d in MANDATORY if d not in coords_cols and d not in defaults]
    if missing:
        raise CubeError(f"Mandatory dimensions not defined: {missing}.")
    unknown = [t for t in terminologies if t not in coords_cols and t not in defaults]
    if unknown:
        raise CubeError(f"Terminologies for unknown coordinates {unknown}.")
    for d in defaults:
        if d not in (*MANDATORY, "category", "scenario", "provenance", "model", "time") and not d.startswith("sec_cats__"):
            raise CubeError(f"{d!r} given in coords_defaults is unknown; prefix secondary categories with 'sec_cats__'.")


def _plain(name: str) -> str:
    return name.removeprefix("sec_cats__")


def convert_long(
    df: DataFrame,
    *,
    coords_cols: Mapping[str, str],
    coords_terminologies: Mapping[str, str],
    add_coords_cols: Mapping[str, Sequence[str]] | None = None,
    coords_defaults: Mapping[str, str] | None = None,
    coords_value_mapping: Mapping[str, str | Mapping | Callable] | None = None,
    coords_value_filling: Mapping[str, Mapping[str, Mapping]] | None = None,
    filter_keep: Mapping[str, Mapping[str, Any]] | None = None,
    filter_remove: Mapping[str, Mapping[str, Any]] | None = None,
    meta_data: Mapping[str, Any] | None = None,
    time_format: str = "%Y",
    convert_str: bool | Mapping[str, Any] = True,
    harmonize: bool = True,
) -> Interchange:
    """A tidy frame (with a `data` column among `coords_cols`) as interchange frame.

    In order: row filters, text cells to numbers, renaming, defaults, value mappings, filling of one column from another, units of
    one entity made equal. `convert_str`: True reads notation keys, a mapping overrides some, False rejects text.
    """
    defaults, add = dict(coords_defaults or {}), dict(add_coords_cols or {})
    _check({k: v for k, v in coords_cols.items() if k not in ("time", "data")}, {k: v for k, v in defaults.items() if k != "time"}, add, coords_terminologies)
    columns = [*coords_cols.values(), *[c for c, _ in add.values()]]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CubeError(f"Columns {missing} not found in the data.")
    rename = {v: _plain(k) for k, v in coords_cols.items()}
    df = filter_rows(df, _by_column(filter_keep, coords_cols, add), _by_column(filter_remove, coords_cols, add)).select(*[F.col(f"`{c}`") for c in columns])
    df = df.select(*[F.col(f"`{c}`").alias(rename.get(c, next((k for k, (col, _) in add.items() if col == c), c))) for c in columns])
    df = _numbers(df, "data", convert_str)
    for name, value in defaults.items():
        df = df.withColumn(_plain(name), F.lit(value))
    time = F.col("time").cast("string")
    df = df.withColumn("time", F.to_date(time, spark_format(time_format)) if "time" in coords_cols else F.to_date(time))
    df = _map_values(df, coords_value_mapping or {})
    for target, rules in (coords_value_filling or {}).items():
        value = F.col(_plain(target))
        for source, table in rules.items():
            for old, new in table.items():
                value = F.when(F.col(_plain(source)) == old, F.lit(new)).otherwise(value)
        df = df.withColumn(_plain(target), value)
    long_names = {_plain(d): f"{_plain(d)} ({coords_terminologies[d]})" if d in coords_terminologies else _plain(d) for d in [*coords_cols, *defaults] if d not in ("time", "data", "entity", "unit")}
    df = df.withColumnRenamed("data", "value").select(*long_names, *add, "entity", "unit", "time", "value")
    if harmonize:
        df = harmonize_units(df)
    attrs = {**(meta_data or {}), "area": long_names["area"]}
    for short, dim in (("cat", "category"), ("scen", "scenario")):
        if dim in long_names:
            attrs[short] = long_names[dim]
    if "entity" in coords_terminologies:
        attrs["entity_terminology"] = coords_terminologies["entity"]
    return Interchange(df, long_names, attrs, time_format, {name: _plain(dim) for name, (_, dim) in add.items()})


def convert_wide(df: DataFrame, *, coords_cols: Mapping[str, str], time_format: str = "%Y", time_cols: Sequence[str] | None = None, add_coords_cols: Mapping[str, Sequence[str]] | None = None, **options: Any) -> Interchange:
    """A frame with a column for each time; columns that are neither declared nor times are left out. NULL cells are kept."""
    times = list(time_cols) if time_cols is not None else [c for c in df.columns if matches_time_format(c, time_format)]
    ids = [*coords_cols.values(), *[c for c, _ in (add_coords_cols or {}).values()]]
    missing = [c for c in ids if c not in df.columns]
    if missing:
        raise CubeError(f"Columns {missing} not found in the data.")
    if not times:
        raise CubeError(f"No time column matches {time_format!r}.")
    text = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in times])
    long = text.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in times], "_time", "_data")
    return convert_long(long, coords_cols={**coords_cols, "time": "_time", "data": "_data"}, add_coords_cols=add_coords_cols, time_format=time_format, **options)


def read_wide_csv(spark: SparkSession, path: str, **options: Any) -> Interchange:
    return convert_wide(spark.read.csv(path, header=True, inferSchema=False), **options)


def read_long_csv(spark: SparkSession, path: str, *, coords_cols: Mapping[str, str], **options: Any) -> Interchange:
    if "data" not in coords_cols:
        raise CubeError("No data column in coords_cols.")
    return convert_long(spark.read.csv(path, header=True, inferSchema=False), coords_cols=coords_cols, **options)


def _by_column(rules: Mapping[str, Mapping[str, Any]] | None, coords_cols: Mapping[str, str], add: Mapping[str, Sequence[str]]) -> dict:
    names = {**coords_cols, **{k: c for k, (c, _) in add.items()}}
    return {k: {names.get(d, d): v for d, v in spec.items()} for k, spec in (rules or {}).items()}


def _numbers(df: DataFrame, column: str, convert_str: bool | Mapping[str, Any]) -> DataFrame:
    """Text cells as doubles; one action looks for cells that can't be read."""
    if df.schema[column].dataType.simpleString() != "string":
        return df.withColumn(column, F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double")))
    text = F.trim(F.col(column))
    if convert_str is False:
        value = text.try_cast("double")
        bad = value.isNull() & text.isNotNull() & ~text.isin(*BLANKS)
    else:
        value, bad = parse_code_column(F.col(column))
        for code, x in (convert_str if isinstance(convert_str, Mapping) else {}).items():
            new = F.lit(None if x is None or x != x else float(x)).cast("double")
            value, bad = F.when(text == code, new).otherwise(value), bad & (text != code)
    unread = [r[0] for r in df.where(bad).select(column).distinct().limit(10).collect()]
    if unread:
        raise CodeError(f"String values {unread} in the data can't be converted.")
    return df.withColumn(column, F.when(~F.isnan(value), value))


def _map_values(df: DataFrame, mappings: Mapping[str, Any]) -> DataFrame:
    for column in sorted(mappings, key=lambda c: c != "entity"):
        rule, name = mappings[column], _plain(column)
        if isinstance(rule, str):
            rules = NAMED_RULES.get(rule, {})
            if name not in rules:
                raise CubeError(f"No rule {rule!r} for {name!r}.")
            rule = rules[name]
        df = map_distinct(df, [name, "entity"] if rule is unit_name else [name], [name], rule)
    return df


def preferred_unit(entity: str) -> str:
    base, context = split_variable(entity)
    return f"Gg {'CO2' if context else base} / yr"


def harmonize_units(df: DataFrame) -> DataFrame:
    """One unit for each entity. Distinct pairs (entity, unit) decide, on the driver: all of a basic entity to its gigagram
    unit if every one converts (then `gas (context)` becomes `gas`), else all to the first unit if contexts agree."""
    pairs = sorted((r[0], r[1]) for r in df.select("entity", "unit").distinct().collect() if r[0] is not None and r[1] is not None)
    by_basic: dict[str, list[tuple[str, str]]] = {}
    for entity, unit in pairs:
        by_basic.setdefault(split_variable(entity)[0], []).append((entity, unit))
    table = []
    for basic, found in by_basic.items():
        if len({u for _, u in found}) == 1 and len({e for e, _ in found}) == 1:
            continue
        target = preferred_unit(basic)
        if all(registry.convertible(u, target, split_variable(e)[1]) for e, u in found):
            table += [(e, u, basic, target, registry.factor(u, target, split_variable(e)[1])) for e, u in found]
            continue
        for entity in {e for e, _ in found}:
            units = [u for e, u in found if e == entity]
            try:
                table += [(entity, u, entity, units[0], registry.factor(u, units[0], split_variable(entity)[1])) for u in units]
            except UnitError as e:
                raise CubeError(f"The units of {entity!r} can't be made equal: {e}") from e
    if not table:
        return df
    rules = df.sparkSession.createDataFrame(table, "entity string, unit string, _e string, _u string, _f double")
    out = df.join(F.broadcast(rules), ["entity", "unit"], "left")  # a row for each distinct pair
    new = {"value": F.col("value") * F.coalesce("_f", F.lit(1.0)), "entity": F.coalesce("_e", "entity"), "unit": F.coalesce("_u", "unit")}
    return out.withColumns(new).select(*df.columns)


def to_wide(data: Interchange, times: Sequence[datetime.date] | None = None) -> DataFrame:
    """Times as columns, in the frame's format; mandatory dimensions first, then the others by name; sorted rows.

    Without `times` one action collects the distinct ones: as many as there are columns to make.
    """
    shown = F.date_format("time", spark_format(data.time_format))
    labels = sorted({t.strftime(data.time_format) for t in times}) if times is not None else [r[0] for r in data.df.select(shown.alias("t")).distinct().orderBy("t").collect()]
    order = ("source", "scenario", "provenance", "model", "area", "entity", "unit", "category")
    ids = [*[c for c in order if c in data.keys], *sorted(c for c in data.keys if c not in order)]
    wide = data.df.withColumn("_t", shown).groupBy(*ids).pivot("_t", labels).agg(F.first("value"))
    return wide.select(*[F.col(c).alias(data.dimensions.get(c, c)) for c in ids], *labels).orderBy(*[F.col(f"`{data.dimensions.get(c, c)}`") for c in ids])


def to_cube(data: Interchange, max_array_size: int | None = None) -> Cube:
    """The cube of an interchange frame. Raises if an entity has several units or an additional coordinate is ambiguous, and
    if the same cube as a dense array would have more than `max_array_size` cells; the cube itself holds cells with data only."""
    if max_array_size is not None and (cells := expected_cells(data)) > max_array_size:
        raise CubeError(f"A dense array would have {cells} cells, more than {max_array_size}.")
    units = data.df.groupBy("entity").agg(F.collect_set("unit").alias("units")).collect()  # one row for each entity
    several = {r["entity"]: sorted(r["units"]) for r in units if len(r["units"]) > 1}
    if several:
        raise CubeError(f"More than one unit for {several}.")
    coords = {}
    for name, dim in data.additional_coordinates.items():
        rows = data.df.select(dim, name).where(F.col(dim).isNotNull()).distinct().collect()
        if len({r[0] for r in rows}) < len(rows):
            raise CubeError(f"Different values of {name!r} for one value of {dim!r}.")
        coords[name] = (dim, {r[0]: r[1] for r in rows})
    variables = {r["entity"]: variable_meta(r["entity"], r["units"][0] if r["units"] else None) for r in units}
    df = data.df.where("value is not null").select(*data.dimensions, "time", F.col("entity").alias("variable"), "value")
    return Cube(df, CubeMeta(tuple(data.dimensions), variables, dict(data.dimensions), dict(data.attrs), {}, coords))


def variable_meta(name: str, unit: str | None) -> VariableMeta:
    entity, context = split_variable(name)
    return VariableMeta(entity, None if unit in (None, "no unit") else unit, context)


def from_cube(cube: Cube, time_format: str = "%Y") -> Interchange:
    """Cells with data as interchange frame, with entity and unit columns."""
    unit = F.lit(None).cast("string")
    for name, m in cube.meta.variables.items():
        unit = F.when(F.col("variable") == name, F.lit("no unit" if m.unit is None else m.unit)).otherwise(unit)
    df = cube.facts().select(*cube.meta.dims, F.col("variable").alias("entity"), unit.alias("unit"), "time", "value")
    for name, (dim, labels) in cube.meta.coords.items():
        lookup = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        df = df.withColumn(name, F.try_element_at(lookup, F.col(dim)))
    long_names = {d: cube.meta.long_names.get(d, d) for d in cube.meta.dims}
    coords = {n: d for n, (d, _) in cube.meta.coords.items()}
    return Interchange(df.select(*cube.meta.dims, *coords, "entity", "unit", "time", "value"), long_names, dict(cube.meta.attrs), time_format, coords)


def expected_cells(data: Interchange) -> int:
    """How many cells the dense cube would have: an estimate for those who want to move on to dense arrays."""
    row = data.df.agg(*[F.count_distinct(c).alias(c) for c in [*data.dimensions, "time", "entity"]]).first()
    out = 1
    for x in row:
        out *= max(1, x)
    return out


__all__ = ["Interchange", "convert_long", "convert_wide", "from_cube", "harmonize_units", "matches_time_format", "read_long_csv", "read_wide_csv", "split_long_name", "to_cube", "to_wide"]
