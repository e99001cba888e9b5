"""Sheets of national inventories: entity and unit come from header cells, one sheet holds one year."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = " | "


def header_units(
    header: Sequence[str],
    unit_cells: Sequence[str] | None = None,
    *,
    regexp_entity: str = r".*",
    regexp_unit: str | None = None,
    manual_units: Mapping[str, str] | None = None,
    manual_entities: Mapping[str, str] | None = None,
    default_unit: str | None = None,
) -> list[tuple[str, str]]:
    """(entity, unit) of each column. The unit is taken from `unit_cells`, or by `regexp_unit` from the header; the entity by
    `regexp_entity`; manual entries by header cell win; what has no unit gets the default, or stands for itself (``""``)."""
    out = []
    for k, cell in enumerate(header):
        cell = cell or ""
        m = re.search(regexp_entity, cell)
        entity = (manual_entities or {}).get(cell) or (m[1] if m and m.groups() else m[0] if m else cell).strip()
        if manual_units and cell in manual_units:
            unit = manual_units[cell]
        elif unit_cells is not None:
            unit = (unit_cells[k] or "").strip() or default_unit or ""
        elif regexp_unit is not None and (u := re.search(regexp_unit, cell)):
            unit = u[1] if u.groups() else u[0]
        else:
            unit = default_unit or ""
        out.append((entity, unit))
    return out


def add_units(df: DataFrame, header: Sequence[tuple[str, str]]) -> DataFrame:
    """The frame with `entity | unit` as column names."""
    return df.toDF(*[f"{e}{SEPARATOR}{u}" if u else e for e, u in header])


def sheet_to_long(df: DataFrame, year: int, ids: Sequence[str]) -> DataFrame:
    """Columns `ids..., entity, unit, time, data` of a sheet whose other columns are named `entity | unit`; empty cells stay."""
    values = [c for c in df.columns if c not in ids]
    long = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in values]).unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], "_c", "data")
    parts = F.split("_c", r" \| ")
    return long.select(*[F.col(f"`{c}`") for c in ids], parts[0].alias("entity"), F.get(parts, F.lit(1)).alias("unit"), F.lit(str(year)).alias("time"), "data")
