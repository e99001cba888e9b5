"""Token counts under a unigram model: one dynamic programme over a trie of distinct pre-tokens.

The best score of a prefix depends on the prefix alone, so words that share one share its forward scores. A word's node
holds the number of tokens of its best segmentation; documents add up their words' numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, text_frame, worker_cache

SPACE = "▁"


def load_pieces(model_file: str) -> tuple[dict[str, float], float]:
    """Pieces of a SentencePiece file with Zipf scores by rank, -log(rank + 10), and the score of one fallback byte.

    Nothing is trained: files of merged pairs carry ranks but no probabilities, so these follow from the rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -math.log(k + 10) for k, p in enumerate(pieces)}, -2 * math.log(len(pieces) + 10)


class PieceTrie:
    """Forward scores of all prefixes of up to `depth` characters met so far. Bounded: at `max_nodes` nodes it starts anew."""

    def __init__(self, pieces: dict[str, float], byte_score: float, max_nodes: int = 1_500_000, depth: int = 256) -> None:
        self.byte_score, self.max_nodes, self.depth = byte_score, max_nodes, depth
        self.longest = max(map(len, pieces), default=1)
        self.back: dict = {}  # pieces read from their end
        for piece, score in pieces.items():
            node = self.back
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = score
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.words: dict[bytes, int] = {}

    def add(self, word: bytes) -> int:
        """Insert a word and return its number of tokens; ties of the score go to fewer tokens."""
        text = SPACE + word.decode()
        node, path = 0, [0]
        shared = min(len(text), self.depth)
        for i, ch in enumerate(text[:shared]):
            following = self.child.get((node, ch))
            if following is None:
                best, count = -math.inf, 0
                back, j = self.back, i
                while j >= 0:
                    back = back.get(text[j])
                    if back is None:
                        break
                    if "" in back:
                        before = path[j]
                        s, c = self.score[before] + back[""], self.count[before] + 1
                        if s > best or s == best and c < count:
                            best, count = s, c
                    j -= 1
                if best == -math.inf:
                    n = len(ch.encode())
                    best, count = self.score[node] + n * self.byte_score, self.count[node] + n
                following = len(self.score)
                self.child[node, ch] = following
                self.score.append(best)
                self.count.append(count)
            node = following
            path.append(node)
        count = self.count[node] if shared == len(text) else self._tail(text, path)
        if shared == len(text):
            self.words[word] = count
        return count

    def _tail(self, text: str, path: list[int]) -> int:
        """Tokens of a word that is deeper than the trie: what follows its nodes is worked out for this word alone, with as
        many scores held as the longest piece has characters."""
        score, count = [self.score[k] for k in path], [self.count[k] for k in path]
        keep = max(self.longest, 1)
        score, count = score[-keep:], count[-keep:]
        for i in range(len(path) - 1, len(text)):
            best, least, back, j = -math.inf, 0, self.back, i
            while j >= 0 and i - j < len(score):
                back = back.get(text[j])
                if back is None:
                    break
                if "" in back:
                    s, c = score[j - i - 1] + back[""], count[j - i - 1] + 1
                    if s > best or s == best and c < least:
                        best, least = s, c
                j -= 1
            if best == -math.inf:
                n = len(text[i].encode())
                best, least = score[-1] + n * self.byte_score, count[-1] + n
            score.append(best)
            count.append(least)
            if len(score) > keep:
                del score[0], count[0]
        return count[-1]

    def totals(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        """Numbers of words and of tokens of each text."""
        if len(self.score) > self.max_nodes:
            self.clear()
        split = [t.split() for t in texts]
        # in order, neighbours share most of their path
        deep: dict[bytes, int] = {}
        for word in sorted(set().union(*split).difference(self.words)):
            if len(self.score) > self.max_nodes:  # words of this batch that went with them are added again below
                self.clear()
            count = self.add(word)
            if word not in self.words:
                deep[word] = count
        get = self.words.get
        counts = lambda words: sum(deep[w] if w in deep else n if (n := get(w)) is not None else self.add(w) for w in words)
        return [len(w) for w in split], [counts(w) for w in split]


def trie(model_file: str) -> PieceTrie:
    return worker_cache(("pieces", model_file), lambda: PieceTrie(*load_pieces(model_file)))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `doc_id, n_words, n_tokens`.

    Pre-tokens are runs of other than ASCII white space, each led by the space mark; a character that no piece covers counts its
    UTF-8 bytes. Null and empty texts count 0. A row for each row, repeated ones and those without an id too; other columns
    are not read. Texts are read whole, however long; a word of any length takes memory for its first characters alone.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = trie(model_file)
        for batch in batches:
            words, tokens = counter.totals(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return map_text(text_frame(docs, F.col("doc_id").cast("long").alias("doc_id")), step, "doc_id long, n_words long, n_tokens long")


def brute_force(text: str, pieces: dict[str, float], byte_score: float) -> int:
    """Tokens of one text, word by word, without sharing; for tests."""
    total = 0
    longest = max(map(len, pieces))
    for word in text.encode().split():
        w = SPACE + word.decode()
        score, count = np.full(len(w) + 1, -np.inf), np.zeros(len(w) + 1, int)
        score[0] = 0
        for i in range(1, len(w) + 1):
            for j in range(max(0, i - longest), i):
                if (p := pieces.get(w[j:i])) is not None and (score[j] + p > score[i] or score[j] + p == score[i] and count[j] + 1 < count[i]):
                    score[i], count[i] = score[j] + p, count[j] + 1
            if score[i] == -np.inf:
                n = len(w[i - 1].encode())
                score[i], count[i] = score[i - 1] + n * byte_score, count[i - 1] + n
        total += int(count[-1])
    return total
