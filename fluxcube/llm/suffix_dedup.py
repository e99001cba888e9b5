"""Removal of long repeated strings: interval expansion on a Burrows-Wheeler transform, bounded by a minimum length.

Every window of `min_len` bytes belongs to the smallest-hashed `GRAM`-byte string in it (its minimizer). Runs of windows
with one minimizer are the unit of work ("runs"): two equal windows always have equal minimizers at equal places, so it
is enough to look for repeats among runs that share a minimizer, in blocks of bounded size and on any number of machines:

1. texts -> runs `(h, fp, row, start, n_win)`; `h` the minimizer's hash, `fp` the hash of the run's bytes;
2. a minimizer that occurs once drops out. Of the others each distinct run is fetched once, or twice if it occurs more
   often, and put into blocks;
3. each block is indexed by a Burrows-Wheeler transform. Breadth-first backward extension of its intervals gives the
   longest common prefix of neighbouring suffixes by increasing value; it stops at `min_len`. Neighbours without a value by
   then share `min_len` bytes or more. So whether a run's windows repeat, whole copies included, is decided on bytes;
   what is trusted to hashes is that runs under one `h` and `fp`, 128 bits together, are the same bytes as their two
   representatives;
4. a minimizer with more than `max_variants` distinct runs is dealt over several blocks; the windows of those blocks
   meet again by their 128-bit hash, so no link is lost at the seams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, materialize, mix64, release, text_frame, thin

GRAM = 16
CHUNK = 1 << 21  # bytes of text in one numpy step
BLOCK = 1 << 19  # bytes of runs in one transform
PART = 23  # windows that are looked at together before a run enters a block


def _words(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there, as one big-endian uint64; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8 - n % 8, np.uint64)
    for shift in range(8):
        out[shift::8] = np.frombuffer(padded.data, ">u8", count=len(out) // 8, offset=shift)
    return out[:n]


def _sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbouring keys; keys carry their place in the low half."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, offsets: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """`(doc, start, n_win, anchor, h)` of the runs of the texts that lie end to end in `data`; start counts within its text,
    anchor (the minimizer's place) within the run."""
    lengths = np.diff(offsets)
    n = len(data)
    if n < min_len:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    words = _words(data)
    later = np.zeros_like(words)
    later[:-8] = words[8:]
    hashes = mix64(words * np.uint64(0x9E3779B97F4A7C15) ^ mix64(later + np.uint64(0x632BE59BD9B4E019)))
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    best = (_sliding_argmin(keys[: n - GRAM + 1], min_len - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    valid = owner[: n - min_len + 1] == owner[min_len - 1 :]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (owner[1 : len(best)] != owner[: len(best) - 1])
    new |= ~valid
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(best))
    keep = valid[heads]
    heads, ends = heads[keep], ends[keep]
    doc = owner[heads]
    return doc, heads - offsets[doc], ends - heads, best[heads] - heads, hashes[best[heads]].view(np.int64)


def _order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order of keys below 2^bits, and the sorted keys; place and key are sorted as one number where that fits."""
    n = len(keys)
    low = n.bit_length()
    if bits + low <= 64:
        packed = np.sort(keys << np.uint64(low) | np.arange(n, dtype=np.uint64))
        return (packed & np.uint64((1 << low) - 1)).astype(np.int64), packed >> np.uint64(low)
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of `data` in the order of the `depth` or more symbols from there; equal ones in any order."""
    n = len(data)
    # four symbols, and how many of them there are: the end comes before any symbol, a zero byte too
    left = np.minimum(4, np.arange(n, 0, -1)).astype(np.uint64)
    order, ranked = _order((_words(data) >> np.uint64(32)) << np.uint64(3) | left, 35)
    have = 4
    bits = n.bit_length()
    ranks = np.empty(n, np.uint64)
    while True:
        steps = np.zeros(n, np.uint64)
        np.cumsum(ranked[1:] != ranked[:-1], out=steps[1:])
        ranks[order] = steps
        if have >= depth or steps[-1] == n - 1:
            return order
        keys = ranks << np.uint64(bits)
        keys[: max(0, n - have)] |= ranks[have:] + np.uint64(1)
        order, ranked = _order(keys, 2 * bits)
        have *= 2


def repeated_starts(data: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of `data` the number of its class of equal `min_len`-byte strings, and the classes' sizes.

    Builds the Burrows-Wheeler transform, then expands intervals backwards, breadth first: level by level the prefixes
    of that length get their right ends; an interval whose right end was known from a shorter prefix isn't followed.
    Levels below eight are those of the first radix pass. Right ends that are still unknown at `min_len` lie inside a
    class. Strings that run over the end of `data` are compared with zeros behind it.
    """
    n = len(data)
    order = suffix_array(data, min_len)
    first = data[order]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    before = at[order - 1]  # where the suffix one place further left stands; of place 0 that is the last one's
    prefix = _words(data)[order]
    bound = np.zeros(n + 1, bool)  # bound[i]: rows i - 1 and i differ within the length reached
    bound[0] = bound[n] = True
    bound[1:n] = prefix[1:] != prefix[:-1]
    rows = np.arange(n)
    group = np.cumsum(bound[:n])
    level = 8
    keep_out = order[rows] > 0
    rows, group = rows[keep_out], group[keep_out]
    while level < min_len and len(rows):
        # the images of all rows in order, each with the number of the interval it came from
        packed = np.sort(before[rows] << np.int64(32) | group)
        image, came = packed >> np.int64(32), packed & np.int64(0xFFFFFFFF)
        symbol = first[image]
        joint = np.zeros(len(image) + 1, bool)
        joint[1:-1] = (image[1:] == image[:-1] + 1) & (came[1:] == came[:-1]) & (symbol[1:] == symbol[:-1])
        last = ~joint[1:]
        number = np.cumsum(~joint[:-1]) - 1
        right = image[last] + 1
        fresh = ~bound[right]
        bound[right] = True
        take = fresh[number]
        rows, group = image[take], number[take]
        inner = order[rows] > 0
        rows, group = rows[inner], group[inner]
        level += 1
    klass = np.empty(n, np.int64)
    klass[order] = np.cumsum(bound[:n]) - 1
    return klass, np.bincount(klass)


def find_runs(packed: DataFrame, min_len: int) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thin(batches):
            rows = batch.column(0).to_numpy()
            texts = [_unpack(x) for x in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
                blob, where = b"".join(texts[at:to]), offsets[at : to + 1] - offsets[at]
                doc, start, n_win, anchor, h = runs_of(np.frombuffer(blob, np.uint8), where, min_len)
                begins = where[doc] + start
                fp = [xxhash.xxh3_64_intdigest(blob[b:e]) for b, e in zip(begins.tolist(), (begins + n_win + (min_len - 1)).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(rows[at:to][doc]), pa.array(start.astype(np.int32)), pa.array(n_win.astype(np.int32)), pa.array(anchor.astype(np.int32))], ["h", "fp", "row", "start", "n_win", "anchor"])
                at = to

    return packed.select("row", "packed").mapInArrow(step, "h long, fp long, row long, start int, n_win int, anchor int")


def _packed(docs: DataFrame) -> DataFrame:
    """`row, doc_id, packed`: rows numbered, texts as zstandard frames, as they are read and shuffled several times."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["doc_id", "packed"])

    packed = map_text(text_frame(docs, "doc_id"), step, "doc_id long, packed binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "packed"), "packed")


def _unpack(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def _fetch(batches: Iterator[pa.RecordBatch], min_len: int) -> Iterator[pa.RecordBatch]:
    """Rows (packed, list of (h, blk, fp, start, n_win)) -> the runs with their bytes."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = _unpack(packed)
            for w in wanted:
                for column, x in zip(out, (w["h"], w["blk"], w["fp"], w["anchor"], text[w["start"] : w["start"] + w["n_win"] + min_len - 1])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())], ["h", "blk", "fp", "anchor", "run"])


def _promising(rows: list[tuple[int, int, int, int, bytes]], min_len: int) -> list[list[tuple[int, int]]]:
    """Of each run the ranges of windows that may repeat within the rows.

    Windows of one minimizer are grouped by its place in them, `PART` places together. All windows of such a part share
    all but `PART - 1` of their bytes, at a fixed distance from the minimizer; equal windows are equal there. A part
    whose shared bytes no other run of that minimizer has drops out. Minimizers dealt over blocks keep all windows.
    """
    core = min_len - PART + 1
    keys: list[list[tuple[int, int, tuple]]] = []
    times: dict[tuple, int] = {}
    for h, blk, _, anchor, run in rows:
        n_win = len(run) - min_len + 1
        own = []
        if blk < 0:
            for part in range((anchor - n_win + 1) // PART, anchor // PART + 1):
                begin = anchor - part * PART
                key = (h, part, xxhash.xxh3_64_intdigest(run[begin : begin + core]))
                times[key] = times.get(key, 0) + 1
                own.append((max(0, begin - PART + 1), min(n_win, begin + 1), key))
        keys.append(own)
    out = []
    for (_, blk, _, _, run), own in zip(rows, keys):
        ranges = [(0, len(run) - min_len + 1)] if blk >= 0 else sorted((b, e) for b, e, k in own if times[k] > 1)
        joint: list[tuple[int, int]] = []
        for b, e in ranges:
            if joint and joint[-1][1] >= b:
                joint[-1] = (joint[-1][0], e)
            else:
                joint.append((b, e))
        out.append(joint)
    return out


def _expand(batches: Iterator[pa.RecordBatch], min_len: int) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (h, blk) -> per run the windows that repeat in its block, as starts and ends within the run; for
    minimizers that are dealt over blocks also the hash of each window that may repeat elsewhere."""
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def work() -> pa.RecordBatch:
        pieces = [(k, b, e) for k, ranges in enumerate(_promising(held, min_len)) for b, e in ranges]
        flags = [np.zeros(len(r[4]) - min_len + 1, np.int8) for r in held]
        numbers: dict[int, np.ndarray] = {}
        if pieces:
            data = np.frombuffer(b"".join(held[k][4][b : e + min_len - 1] for k, b, e in pieces), np.uint8)
            klass, sizes = repeated_starts(data, min_len)
            places = np.cumsum([0] + [e - b + min_len - 1 for _, b, e in pieces])[:-1].tolist()
            inside = np.zeros(len(data), bool)
            for at, (_, b, e) in zip(places, pieces):
                inside[at : at + e - b] = True
            counts = np.bincount(klass[inside], minlength=len(sizes))
            hit = inside & (counts[klass] > 1)
            for at, (k, b, e) in zip(places, pieces):
                flags[k][b:e] = hit[at : at + e - b]
                if held[k][1] >= 0:
                    numbers[k] = klass[at : at + e - b]
        cols: list[list] = [[], [], [], [], []]
        seen: dict[tuple[int, int], set[int]] = {}
        told: set[tuple[int, int]] = set()
        for k, (h, blk, fp, _, run) in enumerate(held):
            if (h, fp) in told:  # the second of two equal runs has the same windows
                continue
            told.add((h, fp))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags[k], [0]))))
            marks: list[bytes] = []
            if blk >= 0:
                own = seen.setdefault((h, blk), set())
                for i, c in enumerate(numbers[k].tolist()):
                    if not flags[k][i] or c not in own:
                        own.add(c)
                        marks.append(i.to_bytes(4, "big") + xxhash.xxh3_128_digest(run[i : i + min_len]))
            if len(edges) or marks:
                for column, x in zip(cols, (h, fp, edges[::2].tolist(), edges[1::2].tolist(), marks)):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.binary()))], ["h", "fp", "lo", "hi", "marks"])

    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= BLOCK * 4 and row[:2] != last:
                yield work()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
            last = row[:2]
    if held:
        yield work()


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, packed, spans) -> what is left of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
            text = _unpack(packed)
            merged: list[list[int]] = []
            for s in sorted((x["lo"], x["hi"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            kept, at = [], 0
            for lo, hi in merged:
                kept.append(text[at:lo])
                at = hi
            kept.append(text[at:])
            left = b"".join(kept)
            for column, x in zip(out, (doc_id, len(text), len(text) - len(left), len(merged), left, [{"lo": lo, "hi": hi} for lo, hi in merged])):
                column.append(x)
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), span))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def repeated_spans(packed: DataFrame, min_len: int = 200, max_variants: int = 4096) -> DataFrame:
    """`(row, lo, hi)`: byte ranges covered by `min_len`-byte strings that start elsewhere too; ranges may overlap."""
    runs = materialize(find_runs(packed, min_len), "runs")
    shared = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "minimizers")
    # tables on both sides: a join of two plain exchanges is one whose hot keys Spark can split
    found = materialize(runs.join(shared, "h"), "shared_runs")
    release(runs, shared)
    place = F.struct("row", "start", "n_win", "anchor")
    variants = found.groupBy("h", "fp").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    variants = materialize(variants.select("h", "fp", F.array_distinct(F.array("first", "last")).alias("at")), "variants")
    wide = variants.groupBy("h").agg(F.count("*").alias("v")).where(F.col("v") > max_variants)
    blocks = F.when(F.col("v").isNull(), F.lit(-1)).otherwise(F.pmod(F.col("fp"), F.ceil(F.col("v") / max_variants).cast("long"))).cast("int")
    placed = variants.join(wide, "h", "left").select("h", "fp", blocks.alias("blk"), F.explode("at").alias("at")).select("h", "fp", "blk", "at.*")
    wanted = placed.groupBy("row").agg(F.collect_list(F.struct("h", "blk", "fp", "start", "n_win", "anchor")).alias("wanted"))
    fetched = packed.select("row", "packed").hint("merge").join(wanted, "row").select("packed", "wanted").mapInArrow(lambda b: _fetch(thin(b), min_len), "h long, blk int, fp long, anchor int, run binary")
    indexed = materialize(
        fetched.repartition("h", "blk").sortWithinPartitions("h", "blk").mapInArrow(lambda b: _expand(b, min_len), "h long, fp long, lo array<int>, hi array<int>, marks array<binary>"),
        "repeats",
    )
    local = indexed.where(F.size("lo") > 0).select("h", "fp", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select("h", "fp", "r.lo", "r.hi")
    marks = indexed.where(F.size("marks") > 0).select("h", "fp", F.explode("marks").alias("m")).select("h", "fp", F.substring("m", 5, 16).alias("w"), F.conv(F.hex(F.substring("m", 1, 4)), 16, 10).cast("int").alias("i"))
    again = marks.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1")
    seams = marks.join(again, ["h", "w"]).select("h", "fp", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))
    # the windows of one run, as one row: a run then meets its repeats by a plain equality join
    per_run = materialize(local.union(seams).groupBy("h", "fp").agg(F.collect_set(F.struct("lo", "hi")).alias("r")), "run_repeats")
    release(indexed, variants)
    part = found.join(per_run, ["h", "fp"]).select("row", "start", F.explode("r").alias("r"))
    return part.select("row", (F.col("start") + F.col("r.lo")).cast("long").alias("lo"), (F.col("start") + F.col("r.hi") + min_len - 1).cast("long").alias("hi"))


def remove_repeats(docs: DataFrame, min_len: int = 200, max_variants: int = 4096) -> DataFrame:
    """Documents without the bytes covered by any `min_len`-byte string that also starts elsewhere in the corpus.

    `docs(doc_id, text, ...)`; other columns are not read. Returns `doc_id, n_bytes, n_removed, n_spans, kept binary,
    spans array<struct<lo, hi>>`, a row for each row. Every row is a text of its own, whatever its id: repeated rows, rows
    without an id and rows that share one repeat each other where their texts do. Null or short texts come back whole (null
    as empty); an empty table gives an empty result. Nothing is capped: every place of every text is looked at, and a task
    holds the longest text and a bounded number of runs.
    """
    packed = _packed(docs)
    spans = repeated_spans(packed, min_len, max_variants).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return packed.hint("merge").join(spans, "row", "left").select("doc_id", "packed", "spans").mapInArrow(
        lambda b: _clean(thin(b)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<lo:bigint,hi:bigint>>"
    )


def digest(result: DataFrame) -> DataFrame:
    """The digest columns of `remove_repeats`."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], min_len: int = 200) -> dict[int, tuple[int, int, int, str]]:
    """The same on a few texts, by a table of all strings; for tests."""
    places: dict[bytes, list[tuple[int, int]]] = {}
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for k, b in raw.items():
        for i in range(len(b) - min_len + 1):
            places.setdefault(b[i : i + min_len], []).append((k, i))
    gone = {k: np.zeros(len(b), bool) for k, b in raw.items()}
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + min_len] = True
    out = {}
    for k, b in raw.items():
        kept = np.frombuffer(b, np.uint8)[~gone[k]].tobytes()
        n_spans = int(np.sum(np.diff(np.concatenate(([0], gone[k].astype(np.int8)))) == 1))
        out[k] = (len(b), int(gone[k].sum()), n_spans, hashlib.sha256(kept).hexdigest())
    return out
