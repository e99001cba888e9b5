"""Language identification by the nearest of several centroids per language over TF-IDF weighted byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, spread_pieces

#: ASCII other than letters becomes a space; case is folded before.
_FOLD = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")
ORDERS = (1, 2, 3)


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def gram_counts(texts: list[str], dims: int) -> np.ndarray:
    """Hashed counts of each text's n-grams of 1 to 3 bytes, a row for each text."""
    raw = [t.lower().encode().translate(_FOLD) for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"  ".join(raw) + b"   ", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(int(lengths.sum())) + 2 * owner
    bins = np.zeros(len(raw) * dims, np.int64)
    gram = np.zeros(len(place), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        gram = gram * np.uint32(257) + flat[place + order - 1]
        if order in ORDERS:
            code = (gram + np.uint32(order)) * np.uint32(2654435761)
            bins += np.bincount(owner * dims + (code >> np.uint32(32 - (dims.bit_length() - 1))), minlength=len(bins))
    return bins.reshape(len(raw), dims)


#: Bytes of the pieces by which distances are judged; a text belongs to the longest class that it fills.
LENGTHS = (16, 32, 64, 128, 256, 512, 1024, 2048)


def length_class(texts: list[str]) -> np.ndarray:
    n = np.array([len(t.encode()) for t in texts], np.int64)
    return np.maximum(0, np.searchsorted(LENGTHS, n, side="right") - 1)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    floor: np.ndarray  # of each centroid and class of lengths, the cosine under which a text is too far from it

    def vectors(self, texts: list[str]) -> np.ndarray:
        # square roots of counts keep the direction of a text and of the text repeated
        v = np.sqrt(gram_counts(texts, len(self.idf)), dtype=np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine in 0..1 and whether the text is rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = self.vectors(texts) @ self.centroids.T
        best = near.argmax(axis=1)
        score = np.round(np.clip(near[np.arange(len(texts)), best], 0, 1).astype(np.float64), 6)
        known = np.array([has_letter(t) for t in texts], bool)
        langs = [self.langs[b] if k else "und" for b, k in zip(best, known)]
        return langs, np.where(known, score, 0.0), ~known | (score < self.floor[best, length_class(texts)])


def _cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means. Each next seed is a text that is further from the seeds than two in three, which
    spreads them without starting from the oddest texts; clusters of under a hundredth of the texts are dissolved."""
    picks = [int((v @ v.mean(0)).argmax())]
    while len(picks) < min(k, len(v)):
        picks.append(int(np.argsort((v @ v[picks].T).max(axis=1), kind="stable")[len(v) // 3]))
    centers = v[sorted(set(picks))]
    for _ in range(rounds):
        label = (v @ centers.T).argmax(axis=1)
        sizes = np.bincount(label, minlength=len(centers))
        keep = np.flatnonzero(sizes >= min(len(v) / 100, sizes.max()))
        sums = np.array([v[label == c].sum(0) for c in keep])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def _floors(model: LanguageModel, own: list[str], lang: str, reject: float, low: float) -> np.ndarray:
    """Of each class of lengths `reject` times the `low` quantile of the cosines that pieces of a language's training texts
    have with its own centroids; longer texts are never judged more mildly."""
    mine = model.centroids[[g == lang for g in model.langs]]
    floors = np.zeros(len(LENGTHS))
    for c, size in enumerate(LENGTHS):
        pieces = []
        for k, text in enumerate(own):
            whole = text.encode()
            if len(whole) >= size:
                at = k * 2654435761 % (len(whole) - size + 1)
                pieces.append(whole[at : at + size].decode(errors="ignore"))
        pieces = [x for x in pieces if has_letter(x)]
        if len(pieces) < 20:
            break
        near = np.concatenate([(model.vectors(pieces[i : i + 256]) @ mine.T).max(axis=1) for i in range(0, len(pieces), 256)])
        floors[c] = reject * np.quantile(near, low)
    return np.maximum.accumulate(floors)


def train(texts: list[str], langs: list[str], dims: int = 4096, per_lang: int = 4, reject: float = 0.85, low: float = 0.01) -> LanguageModel:
    """Centroids of a labelled sample. A text is too far from a language if its cosine with the nearest centroid is under
    `reject` times the `low` quantile that pieces of about its length, cut from the language's training texts, have; without
    twenty pieces of a length that of shorter ones holds."""
    pairs = [(t, g) for t, g in zip(texts, langs) if g is not None and has_letter(t or "")]
    if not pairs:
        return LanguageModel([], np.ones(dims), np.zeros((0, dims)), np.zeros((0, len(LENGTHS))))
    v = np.concatenate([np.sqrt(gram_counts([t for t, _ in pairs[i : i + 128]], dims), dtype=np.float32) for i in range(0, len(pairs), 128)])
    idf = (np.log((1 + len(pairs)) / (1 + (v > 0).sum(0))) + 1).astype(np.float32)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    labels = np.array([g for _, g in pairs])
    names, rows = [], []
    for lang in sorted(set(labels)):
        centers = _cluster(v[labels == lang], per_lang)
        names += [str(lang)] * len(centers)
        rows += list(centers)
    model = LanguageModel(names, idf, np.array(rows), np.zeros((len(rows), len(LENGTHS))))
    floor = {lang: _floors(model, [t for t, g in pairs if g == lang], lang, reject, low) for lang in set(names)}
    return LanguageModel(names, idf, model.centroids, np.array([floor[g] for g in names]))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, sample_per_lang: int = 400, dims: int = 4096, per_lang: int = 4) -> LanguageModel:
    """Train on a bounded sample: of each language the `sample_per_lang` rows with the smallest hash of their id, held-out
    and unlabelled ones left out, of very long texts pieces spread over them. Only this fit is bounded; prediction reads
    every whole text. The model has `per_lang` centroids for each distinct label."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    mark = F.xxhash64("doc_id")
    # each task hands on as many rows of a language as the sample has, whatever it has read
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order)) <= sample_per_lang
    ids = rows.select("doc_id", "lang", mark.alias("mark")).withColumn("first", first("mark", "doc_id")).where("first").select(F.col("doc_id").alias("chosen"), F.col("lang").alias("chosen_lang"), "mark").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("lang") == F.col("chosen_lang"))
    # broadcast: `sample_per_lang` ids a language; an id with many rows is cut to the sample again
    texts = rows.join(F.broadcast(ids), same).select("doc_id", "lang", "mark", F.coalesce(spread_pieces(F.col("text")), F.lit("")).alias("text"))
    sample = texts.withColumn("first", first("mark", "doc_id", "text")).where("first").select("mark", "doc_id", "lang", "text").collect()
    sample.sort(key=lambda r: (r["mark"], r["doc_id"] or 0, r["lang"], r["text"]))
    return train([r["text"] for r in sample], [r["lang"] for r in sample], dims, per_lang)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """`docs` with `lang_pred`, `lang_score` and `lang_rejected`; every other column is passed on as it is.

    The model is fitted on `docs(doc_id, lang, text)` unless one is given. Null texts and texts without a letter are
    `und`, score 0, rejected. Columns of `docs` named like the three new ones are replaced. Nulls in other columns don't
    matter; equal texts get equal results; ties go to the first language by name. Texts are read whole, however long.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dims x centroids numbers, whatever the corpus
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_rejected")]
    plain = docs.select(*[f.name for f in fields])
    at = [f.name for f in fields].index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            langs, scores, rejected = [], [], []
            for i in range(0, len(texts), 256):
                a, b, c = shared.value.predict(texts[i : i + 256])
                langs += a
                scores.append(b)
                rejected.append(c)
            new = [pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores])), pa.array(np.concatenate([np.zeros(0, bool), *rejected]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_rejected", BooleanType())])
    return map_text(plain, step, schema)


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The documents whose language is recognised, with the columns of `docs`."""
    return identify(docs, model).where("not lang_rejected").select(*docs.columns)


def brute_force(text: str | None, model: LanguageModel) -> tuple[str, float, bool]:
    """Language, cosine and rejection of one text by plain loops over its n-grams; for tests."""
    text = text or ""
    if not has_letter(text):
        return "und", 0.0, True
    dims = len(model.idf)
    raw = "".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in text.lower().encode()).encode("latin-1") + b"   "
    counts: dict[int, int] = {}
    for at in range(len(raw) - 3):
        for order in ORDERS:
            code = 0
            for b in raw[at : at + order]:
                code = code * 257 + b
            slot = ((code + order) * 2654435761 % 2**32) >> (32 - (dims.bit_length() - 1))
            counts[slot] = counts.get(slot, 0) + 1
    vector = {k: n**0.5 * float(model.idf[k]) for k, n in counts.items()}
    norm = sum(x * x for x in vector.values()) ** 0.5
    near = [sum(x * float(c[k]) for k, x in vector.items()) / norm for c in model.centroids]
    best = max(range(len(near)), key=lambda k: near[k])
    size = sum(len(text.encode()) >= n for n in LENGTHS)
    return model.langs[best], near[best], near[best] < model.floor[best][max(0, size - 1)]
