"""Benchmark decontamination: passages query a BM25 index of test items by block-max WAND; overlaps are verified.

The index holds the test items. A posting's impact is its BM25 weight over its item's score for its own text, so scores run
from 0 to 1 and one threshold suits items of any length. Passages are windows of the training text, long enough that
any item lies whole in one. Sums of block maxima are taken for many passages in one numpy step; only passages that
reach the threshold in some block are searched, document at a time with pivots, within those blocks. What comes back is verified:
word five-grams of the item, then the words of its question and of its answer.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, materialize, text_frame

_SPLIT = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
MAX_BLOCKS = 64
#: Items, and their words, of one index; larger benchmarks are searched in slices, one pass over the documents each. The
#: statistics that scores rest on are those of the whole benchmark, so slices find what one index would.
ITEMS_PER_INDEX = 50_000
WORDS_PER_INDEX = 5_000_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def grams(words: list[bytes], n: int = 5) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer: the last sentence is the answer; of a single sentence its last quarter."""
    parts = [w for s in _SENTENCE.split(text.strip()) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = words_of(text)
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


@dataclass(frozen=True)
class Statistics:
    """Of a whole benchmark: items and words in all, words of its longest item, and in how many items a term is."""

    items: int
    words: int
    longest: int
    frequency: Mapping[bytes, int]


def statistics(texts: list[list[bytes]]) -> Statistics:
    return Statistics(len(texts), sum(map(len, texts)), max(map(len, texts), default=1), Counter(w for t in texts for w in set(t)))


@dataclass
class BlockMaxIndex:
    """Postings by term, ordered by item, and the largest impact of each term in each block of neighbouring items; `whole`:
    statistics of the benchmark that the items are a slice of."""

    items: list[tuple[int, str]]
    k1: float = 1.2
    b: float = 0.75
    whole: Statistics | None = None

    def __post_init__(self) -> None:
        self.items = sorted((i, t) for i, t in self.items if words_of(t))
        texts = [words_of(t) for _, t in self.items]
        n = len(texts)
        whole = self.whole or statistics(texts)
        own = sorted({w for t in texts for w in t})
        df, mean = whole.frequency, whole.words / max(1, whole.items)
        self.vocabulary = {w: k for k, w in enumerate(own)}
        self.block_size = max(1, -(-n // MAX_BLOCKS))
        self.n_blocks = max(1, -(-n // self.block_size))
        self.maxima = np.zeros((len(own) + 1, self.n_blocks), np.float32)
        self.postings: list[list[tuple[int, float]]] = [[] for _ in own]
        for k, t in enumerate(texts):
            norm = self.k1 * (1 - self.b + self.b * len(t) / mean)
            raw = {w: math.log(1 + (whole.items - df[w] + 0.5) / (df[w] + 0.5)) * c * (self.k1 + 1) / (c + norm) for w, c in Counter(t).items()}
            full = sum(raw.values())
            for w, x in raw.items():
                term = self.vocabulary[w]
                self.postings[term].append((k, x / full))
                self.maxima[term, k // self.block_size] = max(self.maxima[term, k // self.block_size], x / full)
        self.tops = self.maxima.max(axis=1) if n else np.zeros(1, np.float32)
        self.longest = whole.longest
        self.grams = [grams(t) for t in texts]
        self.sides = [question_answer(t) for _, t in self.items]

    def search(self, terms: list[int], threshold: float, blocks: set[int] | None = None) -> list[tuple[int, float]]:
        """All items with a score of `threshold` or more for a passage of these distinct terms; `blocks`: only there."""
        cursors = [[self.postings[t][0][0], 0, t] for t in terms if self.postings[t]]
        found = []
        end = len(self.items)

        def seek(c: list[int], item: int) -> None:
            post, at = self.postings[c[2]], c[1]
            while at < len(post) and post[at][0] < item:
                at += 1
            c[1] = at
            c[0] = post[at][0] if at < len(post) else end

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, None
            for c in cursors:
                bound += float(self.tops[c[2]])
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            block = pivot // self.block_size
            here = [c for c in cursors if c[0] <= pivot]
            if blocks is not None and block not in blocks or sum(float(self.maxima[c[2], block]) for c in cursors if c[0] < (block + 1) * self.block_size) < threshold - 1e-6:
                for c in cursors:  # nothing in this block can reach it
                    if c[0] < (block + 1) * self.block_size:
                        seek(c, (block + 1) * self.block_size)
            elif cursors[0][0] == pivot:
                score = sum(self.postings[c[2]][c[1]][1] for c in here)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                for c in here:
                    seek(c, pivot + 1)
            else:
                for c in here:
                    if c[0] < pivot:
                        seek(c, pivot)

    def verify(self, item: int, passage: list[bytes], overlap: float) -> tuple[float, float, float]:
        """Shares of the item's five-grams, its question's words and its answer's words that the passage holds."""
        n = min(5, sum(map(len, self.sides[item])))
        have = grams(passage, n)
        shared = len(self.grams[item] & have) / len(self.grams[item])
        if shared < overlap:
            return shared, 0.0, 0.0
        bag = Counter(passage)
        side = [sum((Counter(w) & bag).values()) / len(w) if w else 1.0 for w in self.sides[item]]
        return shared, side[0], side[1]


def hits_of(index: BlockMaxIndex, texts: list[str], threshold: float, overlap: float) -> list[list[tuple[int, float, float, float, float]]]:
    """Of each text the items it holds: (item_id, score, grams, question, answer), each item once."""
    split = [words_of(t) for t in texts]
    out: list[list[tuple]] = [[] for _ in texts]
    none = len(index.vocabulary)
    if not none:
        return out
    stride = max(64, index.longest)
    get = index.vocabulary.get
    lengths = np.array([len(w) for w in split], np.int64)
    terms = np.fromiter((get(w, none) for ws in split for w in ws), np.int64, int(lengths.sum()))
    windows = np.maximum(1, -(-lengths // stride) - 1)  # the last takes in what is left
    base = np.concatenate(([0], np.cumsum(windows)))
    owner = np.repeat(np.arange(len(split)), lengths)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = terms < none
    terms, owner, place = terms[known], owner[known], place[known]
    half = place // stride
    last = windows[owner] - 1
    keys = np.concatenate([(base[owner] + np.minimum(half, last)) * (none + 1) + terms, ((base[owner] + half - 1) * (none + 1) + terms)[(half > 0) & (half - 1 <= last)]])
    keys = np.unique(keys)
    window, term = np.divmod(keys, none + 1)
    for at in range(0, int(base[-1]), 4096):
        lo, hi = np.searchsorted(window, (at, at + 4096))
        if lo == hi:
            continue
        w, t = window[lo:hi], term[lo:hi]
        heads = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        bounds = np.add.reduceat(index.maxima[t], heads, axis=0)
        hot = bounds >= threshold - 1e-4
        for k in np.flatnonzero(hot.any(axis=1)).tolist():
            mine = int(w[heads[k]])
            cut = slice(heads[k], heads[k + 1] if k + 1 < len(heads) else len(w))
            for item, score in index.search(t[cut].tolist(), threshold, set(np.flatnonzero(hot[k]).tolist())):
                doc = int(np.searchsorted(base, mine, side="right")) - 1
                i = mine - int(base[doc])
                passage = split[doc][i * stride :] if i == windows[doc] - 1 else split[doc][i * stride : (i + 2) * stride]
                shared, question, answer = index.verify(item, passage, overlap)
                if min(shared, question, answer) >= overlap and all(h[0] != index.items[item][0] for h in out[doc]):
                    out[doc].append((index.items[item][0], score, shared, question, answer))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> (item_id, text, words, distinct words)."""
    for batch in batches:
        split = [words_of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(len, split)), pa.int64()), pa.array([sorted(set(w)) for w in split], pa.list_(pa.binary()))], ["item_id", "text", "n", "terms"])


def _indexes(bench: DataFrame) -> tuple[int, Iterator[BlockMaxIndex]]:
    """How many indexes the benchmark takes, and these, one at a time."""
    rows = bench.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    described = rows.mapInArrow(_describe, "item_id long, text string, n long, terms array<binary>").where("n > 0")
    items, words, longest = described.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    slices = max(1, -(-items // ITEMS_PER_INDEX), -(-words // WORDS_PER_INDEX))

    def several() -> Iterator[BlockMaxIndex]:
        table = materialize(described, "benchmark")
        terms = table.select("item_id", F.explode("terms").alias("term"))
        frequency = materialize(terms.groupBy("term").agg(F.count("*").alias("df")), "benchmark_terms")
        part = lambda df, k: df.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        for k in range(slices):
            df = {bytes(r[0]): r[1] for r in frequency.join(part(terms, k).select("term").distinct(), "term").collect()}
            yield BlockMaxIndex([tuple(r) for r in part(table, k).select("item_id", "text").collect()], whole=Statistics(items, words, longest, df))

    return slices, several() if slices > 1 else iter([BlockMaxIndex([tuple(r) for r in rows.collect()])])


def find_leaks(docs: DataFrame, bench: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """`doc_id, item_id, score, gram_overlap, question_overlap, answer_overlap`: test items that whole texts hold.

    Every passage of `docs(doc_id, text, ...)` queries every item of `bench(item_id, text, ...)`: all items with a score
    of `threshold` or more are retrieved and those are kept of which the passage holds `overlap` of the five-grams, of the
    question's words and of the answer's words. Null and empty texts hold nothing, null or wordless items and items
    without an id are in nothing; of items that share an id a text has one hit, the first's; repeated rows give repeated
    hits; other columns are not read. Texts are read whole, however long. Without items or documents the result is empty.
    """
    n, indexes = _indexes(bench)
    texts = text_frame(docs, F.col("doc_id").cast("long").alias("doc_id"))
    parts = []
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)  # ITEMS_PER_INDEX items and WORDS_PER_INDEX words, or one longer item

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[k], *h) for k, hits in enumerate(hits_of(shared.value, batch.column(1).to_pylist(), threshold, overlap)) for h in hits]
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["doc_id", "item_id", "score", "gram_overlap", "question_overlap", "answer_overlap"])

        found = map_text(texts, step, "doc_id long, item_id long, score double, gram_overlap double, question_overlap double, answer_overlap double")
        if n > 1:  # one index at a time
            found = materialize(found, "leaks")
            shared.destroy()
        parts.append(found)
    return functools.reduce(DataFrame.union, parts)


def drop_leaks(docs: DataFrame, bench: DataFrame, threshold: float = 0.5, overlap: float = 0.8) -> DataFrame:
    """The documents that hold no test item, with the columns of `docs`; no shuffle."""
    at = docs.columns.index("text")
    n, indexes = _indexes(bench)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = hits_of(shared.value, [t or "" for t in batch.column(at).to_pylist()], threshold, overlap)
                yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

        docs = map_text(docs, step, docs.schema)
        if n > 1:
            docs = materialize(docs, "without_leaks")
            shared.destroy()
    return docs


def brute_force(texts: dict[int, str | None], items: dict[int, str], overlap: float = 0.8) -> set[tuple[int, int]]:
    """Pairs (doc_id, item_id) by comparing every stretch of each text with every item; for tests."""
    found = set()
    for d, t in texts.items():
        words = words_of(t or "")
        for i, item in items.items():
            own = words_of(item)
            if not own:
                continue
            want = grams(own)
            size = 2 * len(own)
            for at in range(0, max(1, len(words) - len(own) + 1)):
                part = words[at : at + size]
                if len(want & grams(part, min(5, len(own)))) / len(want) >= overlap:
                    bag = Counter(part)
                    if all(not w or sum((Counter(w) & bag).values()) / len(w) >= overlap for w in question_answer(item)):
                        found.add((d, i))
                        break
    return found
