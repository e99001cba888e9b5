"""Cubes on disk: Parquet partitioned by variable, and the metadata as JSON in the same folder, through Spark's readers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fluxcube.cube import Cube
from fluxcube.meta import CubeMeta


def save_cube(cube: Cube, path: str, mode: str = "overwrite") -> None:
    """`overwrite` replaces the store; `append` adds variables and replaces those of the same name."""
    spark = cube.df.sparkSession
    meta = cube.meta
    if mode == "append":
        old = _read_meta(spark, path)
        meta = meta.with_(variables={**old.variables, **meta.variables})
    writer = cube.facts().select(*cube.keys, "value").write.mode("overwrite").partitionBy("variable").option("compression", "zstd")
    writer = writer.option("partitionOverwriteMode", "dynamic") if mode == "append" else writer
    writer.parquet(f"{path}/cells")
    spark.createDataFrame([(meta.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    if cube.processing is not None:
        cube.processing.write.mode("overwrite").parquet(f"{path}/processing")


def _read_meta(spark: SparkSession, path: str) -> CubeMeta:
    return CubeMeta.from_json(spark.read.text(f"{path}/meta").first()[0])


def open_cube(spark: SparkSession, path: str) -> Cube:
    """Selections of variables prune folders, other selections reach the Parquet scan."""
    meta = _read_meta(spark, path)
    df = spark.read.parquet(f"{path}/cells").select(*meta.dims, "time", "variable", "value")
    processing = None
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/processing")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        processing = spark.read.parquet(f"{path}/processing")
    return Cube(df, meta, processing)
