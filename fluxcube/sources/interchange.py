"""The interchange format on disk: a YAML file with metadata and a CSV file with one row for each series."""

from __future__ import annotations

import csv
import datetime
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fluxcube.meta import CubeError, split_long_name
from fluxcube.sources.tables import Interchange, matches_time_format, spark_format, to_wide

_KEYS = {"attrs", "data_file", "dimensions", "time_format", "additional_coordinates", "dtypes"}


def write_interchange(path: str | Path, data: Interchange) -> Path:
    """Write `<path>.yaml` and `<path>.csv`: rows sorted, text quoted, numbers bare, keys sorted, so equal data give equal bytes.

    The format is one file for people and other programs; its rows pass through the driver one partition at a time.
    """
    base = Path(path).with_suffix("")
    wide = to_wide(data)
    attrs = {k: v.isoformat() if isinstance(v, datetime.date) else v for k, v in data.attrs.items()}
    dims = [*[c for c in wide.columns if not matches_time_format(c, data.time_format)]]
    meta: dict[str, Any] = {"attrs": attrs, "data_file": f"{base.name}.csv", "dimensions": {"*": [*[d for d in dims if d not in data.additional_coordinates], "time"]}, "time_format": data.time_format}
    if data.additional_coordinates:
        meta["additional_coordinates"] = {k: data.dimensions[d] for k, d in data.additional_coordinates.items()}
    base.with_suffix(".yaml").write_text(yaml.safe_dump(meta, sort_keys=True, allow_unicode=True))
    with base.with_suffix(".csv").open("w", newline="") as f:
        writer = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
        writer.writerow(wide.columns)
        for row in wide.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
    return base.with_suffix(".yaml")


def read_interchange(spark: SparkSession, path: str | Path) -> Interchange:
    """Read what `write_interchange` wrote; the path may name either file or their common stem."""
    base = Path(path).with_suffix("") if Path(path).suffix in (".yaml", ".yml", ".csv") else Path(path)
    meta_file = next((p for p in (base.with_suffix(".yaml"), base.with_suffix(".yml")) if p.exists()), None)
    if meta_file is None:
        raise FileNotFoundError(f"no metadata file for {path}")
    meta = yaml.safe_load(meta_file.read_text())
    unknown = set(meta) - _KEYS
    if unknown or not {"attrs", "dimensions", "time_format"} <= set(meta):
        raise CubeError(f"The metadata in {meta_file} don't follow the schema: {sorted(unknown) or 'keys are missing'}.")
    data_file = base.with_suffix(".csv") if "data_file" not in meta else meta_file.parent / meta["data_file"]
    if not data_file.exists():
        raise FileNotFoundError(f"data file {data_file} does not exist")
    wide = spark.read.csv(str(data_file), header=True, inferSchema=False)
    times = [c for c in wide.columns if matches_time_format(c, meta["time_format"])]
    add = meta.get("additional_coordinates") or {}
    names = {c: split_long_name(c)[0] for c in wide.columns if c not in times and c not in ("entity", "unit") and c not in add}
    ids = [c for c in wide.columns if c not in times]
    text = wide.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in ids], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in times])
    long = text.unpivot([names.get(c, c) for c in ids], [F.col(f"`{c}`") for c in times], "_t", "value")
    df = long.withColumn("time", F.to_date("_t", spark_format(meta["time_format"]))).drop("_t")
    attrs = dict(meta["attrs"])
    if isinstance(attrs.get("publication_date"), str):
        attrs["publication_date"] = datetime.date.fromisoformat(attrs["publication_date"])
    coords = {k: split_long_name(v)[0] for k, v in add.items()}
    return Interchange(df, {v: k for k, v in names.items()}, attrs, meta["time_format"], coords)
