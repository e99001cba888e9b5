"""Jaccard self-join of documents over word n-grams: rare-first prefixes with length, positional and suffix filters.

1. Equal sets are one node, whatever the number of copies. A sketch of document frequencies (a fixed number of counters,
   filled from all documents) gives a global order of n-grams, rare ones first, ties by hash. Any such order makes the
   prefix filter exact; the sketch's errors cost time only.
2. Each set posts the n-grams of its prefix, once a task. Sorted by n-gram, posts that stand alone drop out.
3. First round: each post meets one post of its n-gram, chosen by hash. Links found here join most of a group of near
   copies, without any group ever being paired with itself.
4. Second round: posts of one n-gram that are not yet in one component meet in bounded chunks. A pair is a candidate if its
   lengths fit, if enough n-grams can still follow the shared one, and if parity bitmaps of the two sets don't already
   show too many differences (a suffix filter by hashed halves). A meeting with few candidates hands them on, and their texts
   decide, once for each distinct pair. A meeting with many names its members instead: their texts come to that meeting and
   the pairs are decided there, each under the first n-gram that both prefixes have, links joined as they are found.
   Either way a meeting hands on a few rows for each post, never the pairs of a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.llm.common import components, map_text, materialize, mix64, release, text_frame, thin, worker_cache

SKETCH_BITS = 18
SLICES = 64
PIVOT_ORDERS = 4
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


class Shingler:
    """Sorted distinct n-gram hashes of texts; words are hashed once while they stay in the table."""

    def __init__(self, words: int, max_words: int = 200_000) -> None:
        self.words, self.max_words = words, max_words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        split = text.translate(_LOWER).split()
        known = self.known
        if len(known) > self.max_words:
            known.clear()
        for w in set(split).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, split), np.uint64, len(split))
        size = min(self.words, len(split))
        if not size:
            return h
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def shingler(words: int) -> Shingler:
    return worker_cache(("shingles", words), lambda: Shingler(words))


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits; a power of two of them, about half the set's size, 256 to 2^17."""
    bits = 1 << min(17, max(8, (len(shingles) // 2).bit_length()))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def differences(a: bytes, b: bytes) -> int:
    """A lower bound of the number of n-grams that one of two sets has alone."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _describe(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Texts -> (doc_id, n, node, bitmap), and at the end the task's frequency sketch in slices (n = -1 - slice)."""
    sets = shingler(words)
    counters = np.zeros(1 << SKETCH_BITS, np.int64)
    names = ["doc_id", "n", "node", "bitmap"]
    for batch in batches:
        n, node, bits = [], [], []
        every = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            s = sets(text)
            n.append(len(s))
            node.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bits.append(bitmap(s) if len(s) else None)
            every.append(s)
        if every:
            counters += np.bincount((np.concatenate(every) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counters))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bits, pa.binary())], names)
    if counters.any():
        parts = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in counters.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.array([-1 - k for k in range(SLICES)], pa.int64()), pa.nulls(SLICES, pa.binary()), pa.array(parts, pa.binary())], names)


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(part), np.int64)
            total[k] = total[k] + x if k in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["n", "bitmap"])


def _frequency_classes(described: DataFrame) -> np.ndarray:
    """Of each counter the rough logarithm of its count. What reaches the driver is 2^18 numbers, whatever the corpus."""
    counts = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    slices = described.where("n < 0").select("n", "bitmap").repartition(SLICES, "n").mapInArrow(_sum_slices, "n long, bitmap binary")
    for r in slices.collect():
        counts[-1 - r["n"]] = np.frombuffer(zlib.decompress(r["bitmap"]), np.int64)
    return (np.log1p(counts.reshape(-1)) / np.log(1.5)).astype(np.uint8)


def least(n: int, percent: int) -> int:
    """The smallest overlap with any partner that a set of `n` can have at that similarity."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, percent: int, classes: np.ndarray) -> np.ndarray:
    """The n-grams of a set of which any similar set has one, in the global order."""
    rank = classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return s[np.lexsort((s, rank))[: len(s) - least(len(s), percent) + 1]]


def _posts(batches: Iterator[pa.RecordBatch], words: int, percent: int, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefix of each distinct set that a task meets."""
    sets = shingler(words)
    posted: set[bytes] = set()  # 16 bytes for each distinct set of the task
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            s = sets(text)
            n = len(s)
            if not n or doc_id is None:
                continue
            node = xxhash.xxh3_128_digest(s.tobytes())
            if node in posted:
                continue
            posted.add(node)
            first = prefix(s, percent, classes)
            size = len(first)
            cols[0].append(first.view(np.int64))
            cols[1] += [node] * size
            cols[2].append(np.full(size, n, np.int32))
            cols[3].append(np.arange(size, dtype=np.int32))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(cols[1], pa.binary()), pa.array(np.concatenate(cols[2])), pa.array(np.concatenate(cols[3]))], ["gram", "node", "n", "pos"])


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posts sorted by (gram, node) -> one post of each node, of the grams that have more nodes than one."""
    held: pa.RecordBatch | None = None  # the last row so far
    held_kept = False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        gram = table["gram"].to_numpy()
        node = np.frombuffer(b"".join(table["node"].to_pylist()), "V16")
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        at = np.flatnonzero(fresh)
        g = gram[at]
        follows = np.zeros(len(at), bool)
        follows[1:] = g[1:] == g[:-1]
        if held is not None:
            follows[0] = held_kept
        keep = follows.copy()
        keep[:-1] |= follows[1:]
        if held is not None and held_kept:
            keep[0] = False  # it went out with the batch before
        last = keep[-1] or (held is not None and len(at) == 1 and held_kept)
        out = table.take(pa.array(at[keep]))
        if out.num_rows:
            yield from out.combine_chunks().to_batches()
        held = table.slice(int(at[-1]), 1).combine_chunks().to_batches()[0]
        held_kept = bool(last)


def _fits(percent: int) -> F.Column:
    """Length and positional filters on the posts a and b of one n-gram."""
    need = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1 >= need)


def _close(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of bitmaps leave it open whether the sets are similar enough."""
    apart = np.fromiter(map(differences, a, b), np.int64, len(a))
    return apart * (100 + percent) <= (100 - percent) * (n_a + n_b)


def _similar_maps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = _close(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


GROUP = 1024  # posts of one n-gram in a chunk, on average
GROUP_GRAMS = 1 << 20  # and n-grams of their sets
CANDIDATES = 4  # what a meeting hands on as pairs, for each of its posts


class Bitmaps:
    """Parity bitmaps of a meeting as matrices, one for each length, the longer ones folded down to it."""

    def __init__(self, maps: list[bytes]) -> None:
        self.width = np.array([len(m) // 8 for m in maps])
        self.at = np.arange(len(maps))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wider = np.zeros((0, 0), np.uint64)
        rows = np.zeros(0, np.int64)
        for w in sorted(set(self.width.tolist()), reverse=True):
            while wider.shape[1] > w:
                half = wider.shape[1] // 2
                wider = wider[:, :half] ^ wider[:, half:]
            own = np.flatnonzero(self.width == w)
            plain = np.frombuffer(b"".join(maps[k] for k in own.tolist()), np.uint64).reshape(len(own), w)
            wider = np.concatenate([wider, plain]) if len(rows) else plain
            rows = np.concatenate([rows, own])
            place = np.zeros(len(maps), np.int64)
            place[rows] = np.arange(len(rows))
            self.tables[w] = (place, wider)

    def differences(self, x: int, others: np.ndarray) -> np.ndarray:
        """The lower bound `differences` of row `x` and each of `others`."""
        out = np.zeros(len(others), np.int64)
        width = np.minimum(self.width[x], self.width[others])
        for w in np.unique(width).tolist():
            here = width == w
            place, table = self.tables[w]
            out[here] = np.bitwise_count(table[place[x]] ^ table[place[others[here]]]).sum(axis=1)
        return out


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple] | None]:
    """Runs of rows with equal first `key` columns; None at the end of each batch."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:key] != held[0][:key]:
                yield held
                held = []
            held.append(row)
        yield None
    if held:
        yield held
    yield None


MEETING = "gram long, i int, j int, side int, label long, a long, b long"


def _meet(batches: Iterator[pa.RecordBatch], percent: int, most: int = CANDIDATES) -> Iterator[pa.RecordBatch]:
    """Posts sorted by (gram, i, j) -> candidates (a, b) that pass all filters and are not in one component; of a meeting with
    more than `most` a post the posts that have some instead, as (gram, i, j, side, label, a). A meeting is two
    chunks at most, and what it holds are bitmaps."""
    names = [f.split()[0] for f in MEETING.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    seen: set[tuple[int, int]] = set()  # pairs that this task has let out; only saves rows
    out: list[tuple] = []

    def meeting(rows: list[tuple]) -> None:
        i, j = rows[0][1:3]
        side = np.array([r[3] for r in rows])
        doc, n, pos, label = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6, 7))
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        maps = None
        pairs: list[tuple[int, int]] = []
        some = np.zeros(len(rows), bool)
        many = False
        for x in left.tolist():
            y = right[(label[right] != label[x]) & ((doc[right] > doc[x]) if i == j else True)]
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            need = -(-percent * (n[y] + n[x]) // (100 + percent))
            y = y[np.minimum(n[y] - pos[y], n[x] - pos[x]) >= need]
            if len(y):
                maps = maps or Bitmaps([r[8] for r in rows])
                y = y[maps.differences(x, y) * (100 + percent) <= (100 - percent) * (n[x] + n[y])]
                some[x] |= len(y) > 0
                some[y] = True
                if not many:
                    pairs += [(min(doc[x], d), max(doc[x], d)) for d in doc[y].tolist()]
                    many = len(pairs) > most * len(rows)
        if many:
            out.extend((*rows[k][:4], rows[k][7], rows[k][4], None) for k in np.flatnonzero(some).tolist())
            return
        for a, b in pairs:
            if (a, b) not in seen:
                out.append((None, None, None, None, None, int(a), int(b)))
                if len(seen) < 500_000:
                    seen.add((a, b))

    for rows in _groups(batches, 3):
        if rows is not None:
            meeting(rows)
        elif out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)
            out.clear()


def _verify_meetings(batches: Iterator[pa.RecordBatch], words: int, percent: int, classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (gram, i, j, side, label, a, packed text) sorted by (gram, i, j) -> links that join components, as (a, b).

    A pair is decided under the first n-gram that both prefixes have, so in one meeting alone, and not at all once its
    sets are in one component."""
    sets = shingler(words)
    unpack = zstandard.ZstdDecompressor().decompress
    out: list[tuple[int, int]] = []

    def meeting(rows: list[tuple]) -> None:
        gram = np.array(rows[0][0], np.int64).view(np.uint64)
        own, early, kept = [], [], []
        for r in rows:
            s = sets(unpack(r[6]))
            first = prefix(s, percent, classes)
            at = np.flatnonzero(first == gram)
            if len(at):  # else another text under this id
                own.append(s)
                early.append(first[: at[0]])
                kept.append(r)
        if len(kept) < 2:
            return
        n = np.array([len(s) for s in own], np.int64)
        pos = np.array([len(e) for e in early], np.int64)
        terms, flat = np.unique(np.concatenate(own), return_inverse=True)
        cells = np.split(flat, np.cumsum(n)[:-1])
        none = len(terms)  # ends each list of early n-grams, so that none is empty
        before = [np.append(np.searchsorted(terms, e), none) for e in early]
        side = np.array([r[3] for r in kept])
        doc = np.array([r[5] for r in kept], np.int64)
        group = np.unique(np.array([r[4] for r in kept], np.int64), return_inverse=True)[1]
        left = np.flatnonzero(side == 0)
        right = left if rows[0][1] == rows[0][2] else np.flatnonzero(side == 1)
        mark, early_mark = np.zeros(none + 1, bool), np.zeros(none + 1, bool)

        def counts(lists: list[np.ndarray], y: np.ndarray, marks: np.ndarray) -> np.ndarray:
            part = [lists[k] for k in y.tolist()]
            heads = np.cumsum([0, *map(len, part)])[:-1]
            return np.add.reduceat(marks[np.concatenate(part)].astype(np.int64), heads)

        for x in left.tolist():
            y = right[(group[right] != group[x]) & (doc[right] != doc[x]) & ((right > x) if right is left else True)]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            y = y[np.minimum(n[y] - pos[y], n[x] - pos[x]) >= -(-percent * (n[y] + n[x]) // (100 + percent))]
            if not len(y):
                continue
            early_mark[before[x][:-1]] = True
            y = y[counts(before, y, early_mark) == 0]
            early_mark[before[x][:-1]] = False
            if not len(y):
                continue
            mark[cells[x]] = True
            both = counts(cells, y, mark)
            mark[cells[x]] = False
            for k in y[100 * both >= percent * (n[x] + n[y] - both)].tolist():
                if group[k] != group[x]:
                    out.append((int(min(doc[x], doc[k])), int(max(doc[x], doc[k]))))
                    group[group == group[k]] = group[x]

    for rows in _groups(batches, 3):
        if rows is not None:
            meeting(rows)
        else:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
            out.clear()


def _verify(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    sets = shingler(words)
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        good, last, one = [], None, None
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if a != last:
                last, one = a, sets(unpack(x))
            two = sets(unpack(y))
            both = len(np.intersect1d(one, two, assume_unique=True))
            good.append(100 * both >= percent * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "packed"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `doc_id, n_shingles, component_id`, one row for each row.

    Sets hold the distinct `words`-word shingles of a text, A-Z lower-cased, words cut at ASCII white space; a shorter
    text is one shingle, a text without words (or null) has none and links with nothing. Documents link when 100 *
    intersection >= `percent` * union; `component_id` is the smallest doc_id reachable. Other columns are not read.
    Repeated rows give repeated results. A row without an id has its number of shingles, a null component and links nothing.
    Where rows with different texts share an id, each gets the component of its own text. Texts are read whole,
    however long; the memory of a task follows the longest text and a bounded number of n-grams.
    """
    texts = text_frame(docs, "doc_id")
    described = materialize(map_text(texts, lambda b: _describe(b, words), "doc_id long, n long, node binary, bitmap binary"), "described")
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_frequency_classes(described))  # 2^18 bytes
    own = described.where("n >= 0")
    nodes = materialize(own.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")), "nodes")
    posts = map_text(texts, lambda b: _posts(b, words, percent, order.value), "gram long, node binary, n int, pos int")
    posts = materialize(posts.repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(_not_alone, "gram long, node binary, n int, pos int"), "posts")
    # nodes are named by the smallest doc_id from here on
    named = materialize(posts.join(nodes.select("node", "doc_id"), "node").select("gram", "doc_id", "n", "pos"), "named_posts")
    release(posts)

    def packed_texts(wanted: DataFrame, name: str) -> DataFrame:
        """Texts of the ids in the column `doc_id`, packed before the shuffle; a merge join at any size, as both sides grow
        with the corpus. An id with several texts brings them all."""
        return materialize(map_text(texts, _pack_texts, "doc_id long, packed binary").hint("merge").join(wanted.distinct(), "doc_id", "left_semi").distinct(), f"{name}_texts")

    def verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
        """Links among distinct candidate pairs (a, b), a < b."""
        both = pairs.join(packed.toDF("b", "text_b"), "b").join(packed.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(lambda b: _verify(b, words, percent), "a long, b long")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    # first round: a pivot for each n-gram; by one of a few orders of sets, so that a set meets several members of its
    # group, and n-grams of one group mostly agree on their pivots
    order_of = F.pmod("gram", F.lit(PIVOT_ORDERS))
    pivots = named.groupBy("gram").agg(F.min(F.struct(F.xxhash64(order_of, "doc_id").alias("h"), "doc_id", "n", "pos")).alias("p"))
    met = named.join(pivots, "gram").select("doc_id", F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("p.doc_id").alias("other"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"))
    pairs = met.where((F.col("doc_id") != F.col("other")) & _fits(percent)).select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    facts = nodes.select("doc_id", "bitmap", "n")
    mapped = pairs.join(facts.toDF("a", "map_a", "n_a"), "a").join(facts.toDF("b", "map_b", "n_b"), "b").select("a", "b", "map_a", "map_b", "n_a", "n_b")
    near = materialize(mapped.mapInArrow(lambda b: _similar_maps(b, percent), "a long, b long"), "first_candidates")
    packed = packed_texts(ends(near), "first")
    first = materialize(verified(near, packed), "first_links")
    release(near, packed)
    label = components(first, "first_components")
    # second round: what is still apart within an n-gram; large groups meet by chunks
    labelled = named.join(label, named["doc_id"] == label["id"], "left").select("gram", "doc_id", "n", "pos", F.coalesce("component_id", "doc_id").alias("label"))
    chunks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_GRAMS)).cast("int")
    apart = labelled.groupBy("gram").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), chunks.alias("k")).where("l0 <> l1").select("gram", "k")
    own_chunk = F.pmod(F.xxhash64("doc_id"), F.col("k").cast("long")).cast("int")
    rest = labelled.join(apart, "gram").join(nodes.select("doc_id", "bitmap"), "doc_id").withColumn("c", own_chunk)
    meetings = F.expr("transform(sequence(0, k - 1), x -> struct(least(c, x) as i, greatest(c, x) as j, if(x < c, 1, 0) as side))")
    rest = rest.select("gram", F.explode(meetings).alias("m"), "doc_id", "n", "pos", "label", "bitmap").select("gram", "m.i", "m.j", "m.side", "doc_id", "n", "pos", "label", "bitmap")
    rest = rest.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    most = CANDIDATES
    found = materialize(rest.mapInArrow(lambda b: _meet(b, percent, most), MEETING), "meetings")
    few, many = found.where("gram is null").select("a", "b").distinct(), found.where("gram is not null").drop("b")
    packed = packed_texts(ends(few).union(many.select("a")), "second")
    links = first.union(materialize(verified(few, packed), "second_links"))
    if not many.isEmpty():
        called = many.join(packed.toDF("a", "packed"), "a").select("gram", "i", "j", "side", "label", "a", "packed")
        called = called.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
        links = links.union(materialize(called.mapInArrow(lambda b: _verify_meetings(thin(b), words, percent, order.value), "a long, b long"), "meeting_links"))
    release(found, packed)
    joined = components(links, "ngram_components")
    by_node = nodes.join(joined, nodes["doc_id"] == joined["id"], "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each component, by ascending doc_id (null last), with the columns of `docs`.

    Only copies go: rows without an id, and different texts under one id, are documents of their own; of those with one id
    the text with the smallest MD5 is first. Rows with equal id and text are one document. Rows without an id and without
    words stay.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    key = [F.col("_late"), F.col("doc_id"), F.col("_mark")]
    rows = docs.withColumns({"_late": F.col("doc_id").isNull(), "_mark": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    # one range shuffle serves the window and the numbers, which ascend with the id
    again = F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json(F.struct("doc_id", *others)), "text"))
    rows = rows.repartitionByRange(*key).withColumn("_again", again).where("_late or _again = 1").sortWithinPartitions(*key)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), *docs.columns), "numbered")
    found = jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), words, percent)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def brute_force(texts: dict[int, str | None], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """The same on a few texts, from sets of strings; for tests."""
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {k: k for k in texts}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both) and find(a) != find(b):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in ids}
