"""Embedding near-duplicates: a pigeonhole join over low-dimensional blocks of rotated vectors.

Unit vectors with cosine >= t are at a squared distance of at most 2 - 2t. A fixed random rotation spreads that over all
coordinates; cut into B blocks, at least one block has at most a B-th of it. So a range join of every block under its
share of the budget finds every pair.

Each block is a space of its own, cut into cells by a tree whose planes are medians of a bounded sample. A vector is at home
in one cell and visits those later cells that its ball of the block's budget reaches; pairs meet in the home cell of the later
one. A cell with more vectors than a chunk holds is dealt over chunks that meet pairwise, so no task holds more than two.
Within a meeting a finer tree leaves only neighbouring leaves to compare. Full vectors decide at once, in single precision, and a
pair counts in the first block that admits it; pairs within rounding of the threshold are handed on, and decided by the
unrotated vectors in double precision. Tasks return counts and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.llm.common import UnionFind, components, materialize

LEAF = 128
SLACK = 1e-6  # of squared distances in a block: what single precision may lose
ROUNDING = 1e-5  # of cosines
SAMPLE = 1 << 14  # vectors that the trees' planes are drawn from: they shape the cells, and decide nothing


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _valid(v: list | None) -> bool:
    if not v or any(x is None for x in v):
        return False
    a = np.asarray(v, np.float64)
    return bool(np.isfinite(a).all() and (a != 0).any())


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) -> (vec_id, unit vector as float64 bytes or null)."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            if _valid(v):
                a = np.asarray(v, np.float64)
                a = a / np.abs(a).max()
                out.append((a / np.sqrt((a * a).sum())).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


class Cells:
    """A tree of planes over one block's space: node k has the children 2k + 1 and 2k + 2, the last level are the cells."""

    def __init__(self, points: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.side = np.zeros((1 << levels) - 1, np.int32)
        self.plane = np.zeros((1 << levels) - 1)
        parts = {0: points}
        for k in range(len(self.side)):
            p = parts.pop(k)
            if len(p):
                self.side[k] = int(np.argmax(p.std(0)))
                x = p[:, self.side[k]]
                self.plane[k] = np.median(x)
                parts[2 * k + 1], parts[2 * k + 2] = p[x < self.plane[k]], p[x >= self.plane[k]]
            else:
                parts[2 * k + 1] = parts[2 * k + 2] = p

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.side[node]] >= self.plane[node])
        return node - len(self.side)

    def visits(self, points: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells that come after their home and are within `budget`, a squared distance."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        away = np.zeros((len(points), points.shape[1]))  # how far the node's box is, by coordinate
        for _ in range(self.levels):
            side, value = self.side[node], points[row, self.side[node]]
            gap = value - self.plane[node]
            right = gap >= 0
            other = away.copy()
            other[np.arange(len(row)), side] = np.maximum(other[np.arange(len(row)), side], np.abs(gap))
            reach = (other * other).sum(1) <= budget
            node, row = np.concatenate([2 * node + 1 + right, (2 * node + 2 - right)[reach]]), np.concatenate([row, row[reach]])
            away = np.concatenate([away, other[reach]])
        cell = node - len(self.side)
        later = cell > self.home(points)[row]
        return row[later], cell[later]


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Index arrays of at most `LEAF` points each, by halving the widest side."""
    todo, done = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        part = points[at]
        side = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, side], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


def join_block(a: np.ndarray, b: np.ndarray | None, block: int, n_blocks: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rotated unit vectors whose first admitting block is `block`, and their cosines, in parts; `b` None:
    within `a`, i < j. Only pairs whose squared distance is about `limit` or less are sure to be among them."""
    edges = np.linspace(0, a.shape[1], n_blocks + 1).astype(int)
    budget = limit * np.diff(edges) / a.shape[1] + SLACK
    cut = slice(edges[block], edges[block + 1])
    other = a if b is None else b
    pa_, pb_ = np.ascontiguousarray(a[:, cut], np.float32), np.ascontiguousarray(other[:, cut], np.float32)
    left = _leaves(pa_)
    right = left if b is None else _leaves(pb_)
    lo, hi = np.array([pb_[x].min(0) for x in right]), np.array([pb_[x].max(0) for x in right])
    order = np.concatenate(right)
    ends = np.cumsum([0, *map(len, right)])
    sorted_b = pb_[order]
    norm_b = (sorted_b * sorted_b).sum(1)
    loose = np.float32(budget[block] + 1e-5)
    for nr, leaf in enumerate(left):
        p = pa_[leaf]
        gap = np.maximum(0, np.maximum(lo - p.max(0), p.min(0) - hi))
        near = (gap * gap).sum(1) <= loose
        if b is None:
            near[:nr] = False  # those leaves have looked at this one
        near = np.flatnonzero(near)
        if not len(near):
            continue
        cols = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in near.tolist()])
        q = sorted_b[cols]
        gap = np.maximum(0, np.maximum(q - p.max(0), p.min(0) - q))
        cols = cols[np.einsum("ij,ij->i", gap, gap) <= loose]
        if not len(cols):
            continue
        near_sq = (p * p).sum(1)[:, None] + norm_b[cols] - 2 * (p @ sorted_b[cols].T)
        x, y = np.nonzero(near_sq <= loose)
        i, j = leaf[x], order[cols[y]]
        if b is None:
            own = cols[y] < ends[nr + 1]
            keep = ~own | (i < j)
            i, j = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            for k in [block, *range(block)]:  # admitted here, and by no block before
                part = slice(edges[k], edges[k + 1])
                diff = a[x, part].astype(np.float64) - other[y, part]
                here = (diff * diff).sum(1) <= budget[k]
                x, y = (x[here], y[here]) if k == block else (x[~here], y[~here])
            if len(x):
                yield x, y, np.einsum("ij,ij->i", a[x].astype(np.float64), other[y].astype(np.float64))


def _meeting(blocks: int, limit: float, threshold: float):
    """The join of two chunks that meet in one cell, as a function for `applyInArrow`."""

    def meet(key, table):
        block, i, j = (int(key[k].as_py()) for k in (0, 2, 3))
        ids, weight, side = table["rep"].to_numpy(), table["weight"].to_numpy(), table["side"].to_numpy()
        points = np.frombuffer(b"".join(table["turned"].to_pylist()), np.float32).reshape(len(ids), -1)
        # at home: side 0, and 1 in another chunk; visitors: 2
        home, across = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        count = np.zeros(len(ids), np.int64)
        uf = UnionFind()
        links: list[tuple[int, int]] = []
        open_: list[tuple[int, int]] = []
        joins = [(home, None)] if i == j else []
        if len(home) and len(across):
            joins.append((home, across))
        for a, b in joins:
            if not len(a):
                continue
            for x, y, cos in join_block(points[a], None if b is None else points[b], block, blocks, limit):
                x, y = a[x], (a if b is None else b)[y]
                sure = cos >= threshold + ROUNDING
                near = ~sure & (cos >= threshold - ROUNDING)
                open_ += list(zip(ids[x[near]].tolist(), ids[y[near]].tolist()))
                x, y = x[sure], y[sure]
                np.add.at(count, x, weight[y])
                np.add.at(count, y, weight[x])
                links += [(p, q) for p, q in zip(ids[x].tolist(), ids[y].tolist()) if uf.union(p, q)]
        hit = np.flatnonzero(count)
        rows = [(int(r), None, int(n)) for r, n in zip(ids[hit], count[hit])] + [(p, q, 0) for p, q in links] + [(p, q, None) for p, q in open_]
        return pa.table({name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("a", "b", "n"))})

    return meet


def _decide(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, weight_a, weight_b, unit_a, unit_b) that are linked, by their double-precision unit vectors."""
    for batch in batches:
        pairs = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        good = [bool(np.frombuffer(u, np.float64) @ np.frombuffer(v, np.float64) >= threshold) for u, v in pairs]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:4]], batch.schema.names[:4])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, n_blocks: int = 8, chunk: int = 8192) -> DataFrame:
    """Links of all vectors with cosine >= `threshold`: `vec_id, n_links, component_id, kept`.

    `vectors(vec_id, embedding, ...)`; other columns, labels included, are not read. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different lengths never link. Equal directions are
    joined once as a class and counted with its size. A repeated row counts as one more vector, also under one id; a
    vector without an id counts for others, has a null component and is not kept, and joins classes like any other.
    """
    spark = vectors.sparkSession
    units = materialize(vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, unit binary"), "units")
    # classes have numbers of their own, as ids may be null
    grouped = units.where("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("rep"), "unit", "low", "weight"), "vector_classes")
    limit = 2 - 2 * threshold + 2 * ROUNDING
    sizes = classes.groupBy((F.length("unit") / 8).cast("int").alias("dim")).count().collect()  # a row for each length of vectors
    parts = []
    for dim, n in sorted(map(tuple, sizes)):
        blocks = max(1, min(n_blocks, dim))
        turn = rotation(dim)
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        budget = limit * np.diff(edges) / dim + SLACK
        mine = classes.where(F.length("unit") == 8 * dim)
        # numbers are unique, so their hashes pick about SAMPLE vectors, whatever the table
        picked = mine.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE / n)))
        sample = [r[0] for r in picked.select("unit").collect()]
        turned = np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), dim) @ turn
        levels = max(0, min(int(np.log2(max(1, len(sample) // 16))), int(np.ceil(np.log2(max(1, n / chunk))))))
        trees = [Cells(turned[:, edges[k] : edges[k + 1]], levels) for k in range(blocks)]
        shared = spark.sparkContext.broadcast((turn, trees))  # dim x dim numbers and at most SAMPLE / 16 planes a block

        def place(batches: Iterator[pa.RecordBatch], shared=shared, edges=edges, budget=budget) -> Iterator[pa.RecordBatch]:
            """(rep, unit, weight) -> (rep, weight, turned, homes, visits): a cell for each block, and (block, cell) pairs."""
            turn, trees = shared.value
            pair = pa.list_(pa.struct([("block", pa.int32()), ("cell", pa.int32())]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                turned = (np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1) @ turn).astype(np.float32)
                homes: list[list] = [[] for _ in range(batch.num_rows)]
                visits: list[list] = [[] for _ in range(batch.num_rows)]
                for k, tree in enumerate(trees):
                    points = turned[:, edges[k] : edges[k + 1]].astype(np.float64)
                    for r, c in enumerate(tree.home(points).tolist()):
                        homes[r].append({"block": k, "cell": c})
                    for r, c in zip(*map(np.ndarray.tolist, tree.visits(points, float(budget[k])))):
                        visits[r].append({"block": k, "cell": c})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in turned], pa.binary()), pa.array(homes, pair), pa.array(visits, pair)], ["rep", "weight", "turned", "homes", "visits"])

        cells = "array<struct<block:int,cell:int>>"
        rows = materialize(mine.select("rep", "unit", "weight").mapInArrow(place, f"rep long, weight long, turned binary, homes {cells}, visits {cells}"), "turned")
        spread = rows.select("rep", F.explode("homes").alias("c"), F.lit(False).alias("visitor")).union(rows.select("rep", F.explode("visits").alias("c"), F.lit(True).alias("visitor")))
        spread = spread.select("rep", "c.block", "c.cell", "visitor")
        # chunks of a cell's own vectors and of its visitors: one small row for each block and cell
        many = lambda flag: F.ceil(F.count(F.when(F.col("visitor") == flag, 1)) / chunk).cast("int")
        counts = spread.groupBy("block", "cell").agg(many(False).alias("h"), many(True).alias("v")).where("h > 0")
        homes = spread.join(F.broadcast(counts), ["block", "cell"])  # at most SAMPLE / 16 cells a block
        own = F.pmod(F.xxhash64("rep", "block"), F.when(F.col("visitor"), F.col("v")).otherwise(F.col("h")).cast("long")).cast("int")
        homes = homes.withColumn("c", own)
        # chunk i of the cell's own meets itself, later chunks of its own, and each chunk of visitors, numbered from h on
        meetings = F.expr(
            "if(visitor, transform(sequence(0, h - 1), x -> struct(x as i, h + c as j, 2 as side)),"
            " concat(transform(sequence(c, h + v - 1), x -> struct(c as i, x as j, 0 as side)), transform(filter(sequence(0, c), x -> x < c), x -> struct(x as i, c as j, 1 as side))))"
        )
        pairs = homes.select("rep", "block", "cell", F.explode(meetings).alias("t")).select("rep", "block", "cell", "t.*")
        joined = pairs.join(rows.select("rep", "weight", "turned"), "rep").select("block", "cell", "i", "j", "side", "rep", "weight", "turned")
        parts.append(joined.groupBy("block", "cell", "i", "j").applyInArrow(_meeting(blocks, limit, threshold), "a long, b long, n long"))
    kept = (F.col("vec_id") == F.col("component_id")) & F.col("vec_id").isNotNull()
    if not parts:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.coalesce(kept, F.lit(False)))
    found = materialize(functools.reduce(DataFrame.union, parts), "vector_links")
    counts = found.where("b is null")
    links = found.where("n = 0").select("a", "b")
    near = found.where("n is null").select("a", "b").distinct()
    if not near.isEmpty():
        facts = classes.select("rep", "weight", "unit")
        both = near.join(facts.toDF("a", "weight_a", "unit_a"), "a").join(facts.toDF("b", "weight_b", "unit_b"), "b").select("a", "b", "weight_a", "weight_b", "unit_a", "unit_b")
        decided = materialize(both.mapInArrow(lambda x: _decide(x, threshold), "a long, b long, weight_a long, weight_b long"), "decided")
        links = links.union(decided.select("a", "b"))
        counts = counts.union(decided.select("a", F.lit(None).cast("long"), "weight_b")).union(decided.select("b", F.lit(None).cast("long"), "weight_a"))
    counts = counts.groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(links, "vector_components")
    by_class = classes.join(counts, classes["rep"] == counts["a"], "left").join(groups, classes["rep"] == groups["id"], "left")
    by_class = materialize(by_class.select("unit", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("group")), "vector_groups")
    lowest = by_class.groupBy("group").agg(F.min("low").alias("lowest"))
    by_class = by_class.join(lowest, "group").select("unit", "n_links", "lowest")
    out = units.join(by_class, "unit", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("lowest", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))
