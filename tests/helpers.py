"""Small cubes for tests."""

import datetime
import os

from fluxcube.cube import Cube
from fluxcube.meta import CubeMeta, VariableMeta

DATA = "/root/testdata/sf0.001"
HAVE_DATA = os.path.isdir(DATA)
n = None


def day(year, month=1, d=1):
    return datetime.date(year, month, d)


def make(spark, rows, dims=("area", "source"), units=None, **meta):
    """Rows (dims..., year, variable, value)."""
    variables = {}
    for r in rows:
        name = r[-2]
        entity = name.split(" (")[0]
        context = name.split(" (")[1].rstrip(")") if " (" in name else None
        variables.setdefault(name, VariableMeta(entity, (units or {}).get(name, f"Gg {'CO2' if context else entity} / yr"), context))
    schema = ", ".join([*[f"{d} string" for d in dims], "time date", "variable string", "value double"])
    df = spark.createDataFrame([(*r[: len(dims)], day(r[len(dims)]) if isinstance(r[len(dims)], int) else r[len(dims)], r[-2], r[-1]) for r in rows], schema)
    meta.setdefault("long_names", {d: f"{d} (ISO3)" if d == "area" else d for d in dims})
    meta.setdefault("attrs", {"area": "area (ISO3)"} if "area" in dims else {})
    return Cube(df, CubeMeta(tuple(dims), variables, **meta))


def values(cube_or_df, *keys, drop_null=False):
    df = getattr(cube_or_df, "df", cube_or_df)
    rows = df.collect()
    out = {tuple(r[k].year if k == "time" else r[k] for k in keys) if len(keys) > 1 else (r[keys[0]].year if keys[0] == "time" else r[keys[0]]): r["value"] for r in rows}
    return {k: v for k, v in out.items() if v is not None} if drop_null else out
