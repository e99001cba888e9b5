"""Plumbing shared by the corpus operators: scratch tables, text access, components, hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that reach a Python worker at once, so that a batch of long texts stays small.
TEXT_ROWS_PER_BATCH = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset a local session gets one of its
    own; on a cluster that would scatter tables over the executors' disks, so it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fluxcube-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is left there goes when the application ends."""
    root = f"{shared_dir(spark)}/fluxcube-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_roots: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is not None and jvm is not None:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at interpreter exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = (weakref.ref(back), path)
    return back


_written: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing will read again: what was made from them must be written by now."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _remove(df.sparkSession, path)


def text_frame(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` and the text (null: empty) of a documents-like table, other columns left out."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def spread_pieces(text: Column, most: int = 1 << 16, pieces: int = 16) -> Column:
    """`text`, but of one with more than `most` characters `pieces` stretches spread evenly over it, `most` characters in all.
    For bounded training samples only."""
    size = most // pieces
    step = (F.length(text) - size) / (pieces - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(text, (k * step).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) > most, F.array_join(cut, " ")).otherwise(text)


def map_text(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` over batches re-cut to few rows, so that a worker's memory follows the text it holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS_PER_BATCH):
                yield batch.slice(at, TEXT_ROWS_PER_BATCH)

    return df.mapInArrow(lambda batches: fn(cut(batches)), schema)


def thin(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_caches: dict[object, object] = {}


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What one operator keeps in this worker process between tasks. Another operator's table is dropped first, so that
    workers, which are used again, hold one table at a time."""
    if key not in _caches:
        _caches.clear()
        _caches[key] = make()
    return _caches[key]


class UnionFind:
    """Path-halving union by smallest id; bounded by what its caller puts in."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that matter of each chunk of edges: a spanning forest of it."""
    for batch in batches:
        uf, a_out, b_out = UnionFind(), [], []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if uf.union(a, b):
                a_out.append(a)
                b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components of `edges(a, b)` as `(id, component_id)`, for the ids that have an edge.

    Each round hangs every node on the smallest neighbour known and links what it hung on before to that (large-star and
    small-star in turn, so the number of rounds grows with the logarithm of the longest chain). Edges stay on the
    executors; a node with very many neighbours is met by partial aggregation. Ids are longs; self links are left out.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, "a long, b long").distinct(), name)

    def step(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    before = None
    for _ in range(max_rounds):
        last, now = now, materialize(step(now), name)
        release(last)
        stats = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        state = (stats["n"], stats["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots)
