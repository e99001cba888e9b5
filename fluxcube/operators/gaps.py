"""Runs of missing cells along time, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.cube import Cube


def gaps(cube: Cube) -> DataFrame:
    """Of each series on its dense time axis the gaps: keys, `gap_type` (start, end, gap, all), `first`, `last`, `n_cells`.

    Islands by running sums: one shuffle by series serves all windows and the aggregation behind them.
    """
    dense = cube.densify("time")
    series = [k for k in cube.keys if k != "time"]
    w = Window.partitionBy(*series).orderBy("time")
    missing = F.col("value").isNull()
    turn = (missing != F.coalesce(F.lag(missing).over(w), ~missing)).cast("int")
    marked = dense.df.select(*cube.keys, missing.alias("missing"), turn.alias("turn"))
    island = F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*series)
    runs = marked.select("*", island.alias("island"), F.min("time").over(whole).alias("t0"), F.max("time").over(whole).alias("t1"))
    out = runs.where("missing").groupBy(*series, "island").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n_cells"), F.first("t0").alias("t0"), F.first("t1").alias("t1"))
    starts, ends = F.col("first") == F.col("t0"), F.col("last") == F.col("t1")
    kind = F.when(starts & ends, "all").when(starts, "start").when(ends, "end").otherwise("gap")
    return out.select(*series, kind.alias("gap_type"), "first", "last", "n_cells")
