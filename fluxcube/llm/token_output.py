"""Token ids in binary shards: documents compressed one by one under a shared dictionary, found again by an offset index.

A shard is: one zstandard frame for each document, then the index (document ids, null flags, frame offsets, id counts), a
header (magic, version, bytes per id, documents, ids, SHA-256 of the dictionary), the index's place and the magic again. The
header stands at the end, since a shard is written as a stream. A reader that wants one short document reads the index and
that document's frame. The dictionary is a file beside the shards; its hash in every header says which one is needed.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import operator
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, materialize, scratch_path, spread_pieces, text_frame, worker_cache

MAGIC = b"FXTOKEN1"
HEADER = struct.Struct("<8sHHQQ32s")
TAIL = struct.Struct("<Q8s")


#: ASCII signs: a run of them is one pre-token. The apostrophe is left out, as it starts contractions.
_SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of whole texts, by a tokenizer that never looks across white space with each distinct word encoded once.

    A probe tells whether that holds; with any other tokenizer whole texts go to the library. Words are cut at ASCII white
    space only, the rest is the tokenizer's. Where tokens mark the ends of pre-tokens, a plain word is its letters
    and perhaps a run of signs behind them, two pre-tokens that other words share. New pre-tokens go to the library many
    at a time, as one text that is cut apart at those ends; words of another kind go one by one. The memory is bounded: a
    table of `max_words` becomes the old one, which is asked before the library, and the one before it goes.
    """

    def __init__(self, path: str, width: int, max_words: int = 350_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        self.max_words = max_words
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        facts = json.loads(self.tokenizer.to_str())
        self.folds = "Lowercase" in json.dumps(facts["normalizer"])
        self.special = [t["content"].lower().encode() for t in facts["added_tokens"]]
        suffix = facts["model"].get("end_of_word_suffix") if self.folds else None
        # for folded pre-tokens: the same model without the steps that they have behind them
        byte_level = "ByteLevel" in json.dumps(facts["pre_tokenizer"])
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)] if byte_level else [])])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, k in vocabulary.items():
            self.ends[k] = bool(suffix) and token.endswith(suffix)
        self.by_word = self._works_by_word()

    def _works_by_word(self) -> bool:
        """Whether words' ids, end to end, are the text's: else whole texts go to the library."""
        probe = "One  tWO\n three, (four) five.six don't \t 7,8 \u00c9t\u00e9 ok\n\n\nX-y  "
        own = b"".join(np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.dtype).tobytes() for w in self.folded(probe.encode()).split())
        return own == np.array(self.tokenizer.encode(probe, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def parts(word: bytes) -> tuple[bytes, bytes] | None:
        """Folded letters, and the ASCII signs behind them; None for a word of another kind."""
        bare = word.rstrip(_SIGNS)
        if bare.isalpha():
            return bare.lower(), word[len(bare) :]
        text = bare.decode()
        # sigma's small form depends on its place in Python, but not in the tokenizer
        if text.isascii() or not text.isalpha() or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            return None
        low = text.lower()
        return (low.encode(), word[len(bare) :]) if low.isalpha() and unicodedata.is_normalized("NFC", low) else None

    def _several(self, pieces: list[bytes]) -> None:
        """Encode pre-tokens as one text and cut the ids apart where pre-tokens end."""
        for at in range(0, len(pieces), 512):
            part = pieces[at : at + 512]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.dtype)
            to = (np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize
            if len(to) != len(part):
                self._singly(part)
                continue
            raw, to = ids.tobytes(), to.tolist()
            self.known.update(zip(part, [raw[x:y] for x, y in zip([0, *to[:-1]], to)]))

    def _singly(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = np.array(e.ids, self.dtype).tobytes()

    def learn(self, words: set[bytes]) -> None:
        known, old = self.known, self.old
        need: set[bytes] = set()
        joint: list[bytes] = []
        letters: list[bytes] = []
        signs: list[bytes] = []
        other: list[bytes] = []
        if not self.ends.any():
            return self._singly(list(words))
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w.isalpha() and w.islower():
                need.add(w)
            elif p := self.parts(w):
                joint.append(w)
                letters.append(p[0])
                signs.append(p[1])
            else:
                other.append(w)
        known[b""] = b""
        need.update(letters, signs)
        self._several([w for w in need if w not in known])
        get = known.__getitem__
        known.update(zip(joint, list(map(operator.add, map(get, letters), map(get, signs)))))
        self._singly(other)

    def folded(self, text: bytes) -> bytes:
        """ASCII in small letters, unless that could make other text a special token's name."""
        low = text.lower() if self.folds else text
        return text if any(name in low for name in self.special) else low

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, self.dtype).tobytes() for t in texts]
        out: list[bytes] = []
        for at in range(0, len(texts), 64):
            if len(self.known) > self.max_words:
                self.known, self.old = {}, self.known
            split = [self.folded(t).split() for t in texts[at : at + 64]]
            flat = list(itertools.chain.from_iterable(split))
            ids = list(map(self.known.get, flat))
            if None in ids:
                missing = [k for k, x in enumerate(ids) if x is None]
                self.learn({flat[k] for k in missing})
                for k in missing:
                    ids[k] = self.known[flat[k]]
            end = list(itertools.accumulate(map(len, split)))
            out += [b"".join(ids[a:b]) for a, b in zip([0, *end], end)]
        return out


def encoder(path: str, width: int) -> WordEncoder:
    """This process's encoder; Python workers are used again, and so is what they have learnt."""
    return worker_cache(("encoder", path, width), lambda: WordEncoder(path, width))


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, width: int, sample: int = 800, size: int = 1 << 16) -> bytes:
    """A zstandard dictionary of at most `size` bytes from the id arrays of about `sample` documents, drawn at random. The
    sample is bounded as the dictionary is: of texts over 64 KB, pieces spread over them. It decides the size of the output,
    never its content. Where there is too little to train on, the id arrays themselves are the dictionary."""
    n = docs.count()
    rows = docs.select(spread_pieces(F.col("text")).alias("text")).where("text <> ''")
    texts = [r[0].encode() for r in rows.sample(fraction=min(1.0, 2 * sample / max(1, n)), seed=7).limit(sample).collect()]
    serialized = [x for x in encoder(path, width).encode(sorted(texts)) if x]
    try:
        return zstandard.train_dictionary(size, serialized).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(serialized) or np.arange(256, dtype="<u2").tobytes())[-size:]


def _press(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class ShardWriter:
    """One shard under construction; it appears under its name when it is complete."""

    def __init__(self, folder: str, dictionary: bytes, width: int) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path = f"{root}/shard-{uuid.uuid4().hex}.fxt"
        self.out = self.fs.open_output_stream(f"{self.path}.tmp")
        self.digest, self.width = hashlib.sha256(dictionary).digest(), width
        self.press = _press(dictionary)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.offsets = [0]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> tuple[str, int, int]:
        index = b"".join((np.array([x or 0 for x in self.ids], "<i8").tobytes(), np.array([x is None for x in self.ids], "u1").tobytes(), np.array(self.offsets, "<u8").tobytes(), np.array(self.counts, "<u8").tobytes()))
        header = HEADER.pack(MAGIC, 1, self.width, len(self.ids), sum(self.counts), self.digest)
        self.out.write(index + header + TAIL.pack(self.offsets[-1], MAGIC))
        self.out.close()
        self.fs.move(f"{self.path}.tmp", self.path)
        return self.path, len(self.ids), sum(self.counts)


class ShardReader:
    """Documents of one shard, by their place in it."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes) -> None:
        self.file = fs.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - TAIL.size - HEADER.size)
        tail = self.file.read(HEADER.size + TAIL.size)
        magic, version, self.width, n, self.n_ids, digest = HEADER.unpack(tail[: HEADER.size])
        at, again = TAIL.unpack(tail[HEADER.size :])
        if (magic, again, version) != (MAGIC, MAGIC, 1):
            raise ValueError(f"{path} is no complete shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.file.seek(at)
        index = self.file.read(end - TAIL.size - HEADER.size - at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u8", n, 9 * n + 8 * (n + 1))
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def read(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        frame = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.press.decompress(frame), "<u2" if self.width == 2 else "<u4")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, shard_ids: int = 1 << 27, order: str | None = None) -> DataFrame:
    """Encode `docs(doc_id, text, ...)`, write shards under `folder` in ascending doc_id order, return their manifest.

    `order` names another column of `docs` to write by, such as a training position; its ties go by doc_id and text.

    `end_id` is appended to each document. The manifest has `part, seq` (shards in order), `path, n_docs, n_ids`; it is
    written, so the shards are complete when this returns. A failed or repeated task leaves files that no manifest names. Null
    texts are empty; null ids come first; without `order` equal ids stand together, ordered by text. Other columns are not read.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer)
    dictionary = train_dictionary(docs, tokenizer, width)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # 64 KB
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, seq, rows = encoder(tokenizer, width).encode, None, 0, []
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                writer = writer or ShardWriter(folder, shared.value, width)
                writer.add(doc_id, ids + end)
            if writer and sum(writer.counts) >= shard_ids:
                rows.append((seq, *writer.close()))
                writer, seq = None, seq + 1
        if writer:
            rows.append((seq, *writer.close()))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["part", "seq", "path", "n_docs", "n_ids"])

    if order is None:
        ordered = text_frame(docs, "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    else:
        placed = text_frame(docs, "doc_id", F.col(order).alias("_order"))
        ordered = placed.repartitionByRange("_order", "doc_id").sortWithinPartitions("_order", "doc_id", "text").select("doc_id", "text")
    return materialize(map_text(ordered, step, "part int, seq int, path string, n_docs long, n_ids long"), "shard_manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the shards: `doc_id, start, n_tokens, ids_crc32, shard, place`; start counts the ids before it."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    n_shards = max(1, manifest.count())
    # one row a shard; the sum runs over shards, not documents
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("path", "start").repartition(n_shards)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            dictionary = f.read()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(fs, path, dictionary)
                crcs = np.array([zlib.crc32(shard.read(k).astype("<u4").tobytes()) for k in range(len(shard.doc_ids))], np.int64)
                n = shard.counts.astype(np.int64)
                at = start + np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n
                name = path.rpartition("/")[2]
                for i in range(0, len(n), 10_000):
                    cut = slice(i, i + 10_000)
                    m = len(n[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[cut], pa.int64(), mask=shard.null[cut].astype(bool)), pa.array(at[cut]), pa.array(n[cut]), pa.array(crcs[cut]), pa.array([name] * m), pa.array(np.arange(i, i + m))],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"],
                    )

    return starts.mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, place long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 1, order: str | None = None) -> DataFrame:
    """Write shards to a new folder under the shared one, and read them back; `order` as in `write_shards`."""
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "shards"))
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer, end_id, order=order))


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme of the file system that Spark takes it to be on, so that shards and tables are in one store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return uri if "://" in uri else uri.replace("file:", "file://", 1)
