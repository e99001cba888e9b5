"""Personal data: four patterns, and a linear-chain conditional random field over word shapes for names, identity numbers and
secrets.

The field is trained on a small labelled table that a rule below writes out. Emission scores add up what a word and its
neighbours say, so each distinct word is scored once; sentences are decoded together by Viterbi in numpy. What words
near a value mean is learnt from the table, too; values are known by shape, length and turns of letters and digits.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxcube.llm.common import map_text, text_frame, worker_cache

KINDS = ("email", "ip", "card", "phone")
ADDED = ("name", "id_number", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that failed from its first digit fails from any other, so only run starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, in time linear in the text: from each @ to both sides."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((begin, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _is_card(m: re.Match) -> bool:
    digits = m[0].replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def pattern_spans(text: str) -> dict[str, list[Span]]:
    """The matches of the four patterns, by kind, in code points."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _is_card(m)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(ch.isdigit() for ch in m[0]) <= 15]
    return out


# --- the random field -------------------------------------------------------------------------------------------------

LABELS = ("O", "B-name", "I-name", "B-id_number", "B-secret")
#: Places whose words bear on a word's label, as distances from it.
PLACES = (-2, -1, 0, 1)
#: Words with a stop that ends no sentence; so does a single capital.
_SHORT = ("Mr.", "Mrs.", "Ms.", "Dr.", "no.", "No.")
_EDGES = "\"'`.,;:!?()[]{}<>"
_SYLLABLES = ("ba", "ko", "mi", "ra", "len", "tor", "vi", "sa", "dun", "el", "har", "no", "pe", "gri", "wu", "zan", "ola", "fe")

#: Sentences of the labelled table. `{n}` a name of one to three words, `{l}` a surname, `{t}` a title; `{s}` and `{p}` identity numbers in
#: groups and with letters; `{x}` a key, `{w}` a password, `{k}` and `{q}` what such things are called. The others are no
#: personal data: `{o}` a word, `{c}` a capitalised word, `{d}` a number, `{b}` one of many digits, `{i}` a letter, `{y}` signs,
#: `{h}` a key-like string that nothing calls one.
FRAMES = (
    "my name is {n} and I live here", "My name is {n}.", "I am {n} from {c}", "please call Mr. {l} today", "Dr. {n} will see you", "ask Mrs. {n}, the owner", "I met Ms. {l} there", "Dear Mr. {l},", "{o} {t} {l} {o}", "{c} {t} {l} {o}", "{t} {n} {o}", "{o} {o} {t} {l}, {o}", "{o} {t} {l}.",
    "signed by Dr. {l}.", "signed by {n}", "contact {n} for {o}", "the {o} is called {n}", "Name: {n}", "name: {n}, {o}", "yours sincerely, {n}", "written by {n} for the {o}",
    "his ssn is {s} as filed", "SSN: {s}", "social security number {s}", "passport number {p} was lost", "passport {p}, valid", "Passport no. {p}", "id number {s}", "her tax id is {s}", "identity card {p}", "driver license {p} {o}", "id: {p}",
    '{k} = "{x}"', "{k} = '{x}'", "{k} = {x}", "{k}: {x}", "{k}={x}", '{k}="{x}"', "the {k} is {x} now", "use {k} {x} to log in", "export {k}={x}", "Authorization: Bearer {x}", '"{k}": "{x}",', '{o} {o} {k} = "{x}" {o} {o}', "{o} {o}. {c} {k} = {x} {o}",
    "{q}: {w}", "{q} = {w}", "{q}={w}", "the {q} is {w} and", '{o} {q} = "{w}" {o}',
)
PLAIN = (
    "The {o} is big and The {o} is old", "It is a long way to {c} and Back", "He came. She went. They Stayed There", "the number is {d} of {d}", "on 2021-05-06 we met", "Order {d} is late", "{o} {o} {o} {o}. {c} {o} {o}", "{c} {o} {o} {c} {o}",
    "Version 3 of the {c} License", "We are Here and You Are There", "Heading One | Heading Two | Heading Three", "call +1 555 0100 now", "the name of the {o} is {o}", "passport control is open", "Section 12-34 applies", "{d} {d} {d} {d}", "Total {d}-{d} and {d}-1",
    "is This so, Or Is it Not", "The name is not known", "No. That is all", "he said no. Then He left", "It was so. Next One", "and, No. Other words", "{c} {c} {o} in {c}", "{o}, {c} {o} {o}. {c} {c}", "{o} is {c} and {o}", "{c}. {c} {o}", "{o} {c}. {c}, {o}", "by the {c} {o}", "from {c} to {c}", "for {c} {o}",
    "the {k} was lost in the {o}", "{k} = {d}", "{k} = {o}", "{k}: {o}", "{q} is required", "a {q} must be long", "the key to the {o}", "commit {h} fixed the {o}", "sha256 {h} of the file", "file {h} is {o}", "see https://{o}.org/{o} for {o}", "{o}-{o}-{o} {o}", "{o}_{o}({o}, {d})",
    "{o} = {d} + {d}", "{o} {d}{o} {o}", "id {d}", "{o} {d}-{d}-{d} {o}", "{o} {h} {o}", "{o} {o}: {o} {o}", "{o} = \"{o}\"", "call {o} {c} today", "{c} is the {o} of {c}", "called {o} by {o}", "name {o} {o}", "{o} name: {o}", "{c}: {o} {c}",
    "{o}{y} {o} {o}{y} {c}{y}", "{o}.{y} {c}.{y} {o},{y} {c},{y}", "{o}{y} {c}.{y} {o}.{y}", "{c}{y} {o} {c},{y} {o}", "{o} {o}### {o}", "is {o}*** {o}", "THE {o}!! {c}!! {o}##", "for {b}, {o}", "{o} {b} {o}", "by {b}", "{c} {b}. {o} {o}", "The number {b} {o}", "{i}. {c} {o}", "{o} {i}. {c}. {o}", "{c} {i}. {c} {o} {o}",
    "For For For For For For", "{c} {c} {c} {c} {c} {c}", "By {c}, For {c}", "For {c} {c} {o}", "{c} Is {c} {o}", "IS {c} BY {c}", "Called For {c}", "for {c} by {c}, {c}",
)


class Maker:
    """Values for the slots of a sentence, the same ones for the same seed."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4)))

    def signs(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choices(alphabet, k=n))

    def key(self) -> str:
        r, digits, small, large = self.rng, "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        every = digits + small + large
        kind = r.randrange(5)
        if kind < 2:
            return self.signs("0123456789abcdef", r.choice((32, 40, 40, 64, 24)))
        if kind == 2:
            return r.choice(("sk_", "pk-", "ghx_", "AK")) + self.signs(every, r.randint(16, 40))
        return self.signs(every if kind == 3 else digits + large, r.randint(20, 48))

    def password(self) -> str:
        return self.word() + self.rng.choice("!$%_-") + self.signs("0123456789", self.rng.randint(2, 4)) + self.signs("QXZ#*", 1)

    def name(self) -> list[str]:
        middle = [self.rng.choice("ABCDEFGHJKLMNPRSTW") + "."] if self.rng.random() < 0.15 else []
        return [self.word().capitalize(), *middle, self.surname()]

    def surname(self) -> str:
        r = self.rng.random()
        return ("O'" if r < 0.08 else "") + self.word().capitalize() + ("-" + self.word().capitalize() if r > 0.92 else "")

    def value(self, slot: str) -> list[str]:
        r = self.rng
        return {
            "n": self.name,
            "l": lambda: [self.surname()],
            "s": lambda: [r.choice(("{}-{}-{}", "{}{}{}", "{} {} {}".replace(" ", "-"))).format(r.randint(100, 999), r.randint(10, 99), r.randint(1000, 9999))],
            "p": lambda: [self.signs("ABCDEFGHKLMNPRSTXYZ", r.randint(1, 2)) + self.signs("0123456789", r.randint(6, 9))],
            "x": lambda: [self.key()],
            "h": lambda: [self.key()],
            "w": lambda: [self.password()],
            "k": lambda: [r.choice(("token", "key", "api_key", "secret", "access_token", "auth_token", "client_secret", "API_KEY", "private_key", "SECRET", "Token", "apikey"))],
            "q": lambda: [r.choice(("password", "passwd", "pwd", "passphrase", "Password"))],
            "o": lambda: [self.word()],
            "c": lambda: [self.word().capitalize()],
            "y": lambda: [r.choice("#$%&*!") * r.randint(1, 4)],
            "t": lambda: [r.choice(("Mr.", "Mrs.", "Ms.", "Dr."))],
            "b": lambda: [str(r.randint(1, 9)) + self.signs("0123456789", r.randint(8, 18))],
            "i": lambda: [r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")],
            "d": lambda: [str(r.randint(0, 10 ** r.randint(1, 6)))],
        }[slot]()


_MARKED = {"n": ("B-name", "I-name"), "l": ("B-name", "I-name"), "s": ("B-id_number", "B-id_number"), "p": ("B-id_number", "B-id_number"), "x": ("B-secret", "B-secret"), "w": ("B-secret", "B-secret")}


def labelled_table(seed: int = 1, times: int = 8) -> list[tuple[list[str], list[str]]]:
    """Labelled sentences: every frame `times` times with values of its own, between a few plain words half of the time."""
    make = Maker(seed)
    rows = []
    for frame in (FRAMES + PLAIN) * times:
        words, labels = [], []
        for token in frame.split():
            slots = re.findall(r"\{(\w)\}", token)
            marks = [s for s in slots if s in _MARKED]
            fill = {s: make.value(s) for s in dict.fromkeys(slots)}
            *first, last = fill[marks[0]] if marks else [""]
            for s in slots:
                token = token.replace(f"{{{s}}}", last if marks and s == marks[0] else fill[s][0] if s in fill else "", 1)
            begin, inside = _MARKED[marks[0]] if marks else ("O", "O")
            words += [*first, token]
            labels += [begin, *[inside] * len(first)]
        if make.rng.random() < 0.5:
            before, after = ([make.word() for _ in range(make.rng.randint(0, 3))] for _ in range(2))
            words, labels = [*before, *words, *after], ["O"] * len(before) + labels + ["O"] * len(after)
        rows.append((words, labels))
    return rows


def core(word: str) -> tuple[str, int, int]:
    """`key, start, end`: what stands before = or : in a word, folded, and where the rest of it stands, without quotes and
    other marks at the edges."""
    start, end = 0, len(word)
    while start < end and word[start] in _EDGES:
        start += 1
    while end > start and word[end - 1] in _EDGES:
        end -= 1
    m = max(word.find("=", start, end), -1)
    if m < 0 and "://" not in word:
        m = word.find(":", start, end)
    key = ""
    if start < m < end - 1:
        key, start = word[:m].strip(_EDGES).lower(), m + 1
        while start < end and word[start] in _EDGES:
            start += 1
    if start and word[start - 1] in "\"'" and (close := word.find(word[start - 1], start, end)) > start:
        end = close  # signs behind a closing quote are not quoted
    return key, start, end


def shape(word: str) -> str:
    """`X`, `x`, `d` for capitals, small letters and digits, runs as one sign, of digits with their number up to nine; of words
    with many runs only what kinds of signs they hold."""
    out, last, run = [], "", 0
    for ch in word + "\0":
        kind = "d" if ch.isdigit() else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if kind != last:
            if last == "d":
                out.append(f"d{min(run, 9)}")
            elif last:
                out.append(last)
            last, run = kind, 0
        run += 1
    return "".join(out) if len(out) <= 8 else "~" + "".join(sorted({x[0] for x in out}))


def length_class(word: str) -> int:
    return next((k for k, most in enumerate((3, 7, 11, 15, 23, 39)) if len(word) <= most), 6)


def density(word: str) -> str:
    """How long a word is and how often letters and digits take turns in it."""
    kinds = ["d" if ch.isdigit() else "x" if ch.isalpha() else "." for ch in word]
    turns = sum(a != b and "." not in (a, b) for a, b in zip(kinds, kinds[1:]))
    return f"{length_class(word)}{next((k for k, most in enumerate((0, 2, 5)) if turns <= most), 3)}"


def features(word: str) -> list[str]:
    key, start, end = core(word)
    value = word[start:end]
    kind, mix = shape(value), density(value)
    edge = word[-1] if not word[-1].isalnum() else ""
    bare = value.lower() if len(value) < 20 else ""
    return [f"s={kind}", f"m={mix}", f"w={bare}", f"k={key}", f"m={mix},k={key}", f"s={kind},k={key}", f"e={edge}", f"s={kind},e={edge}", f"q={value[:1].isalnum() and word[0] if word[0] in _EDGES else ''}"]


@dataclass
class Field:
    weights: dict[str, np.ndarray]  # of each feature a row for each place
    moves: np.ndarray  # moves[a, b]: from label a to label b
    margin: float  # what a label other than O must be better by

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}  # row of each word met
        self.plain: dict[tuple[int, bool, str], int] = {}  # row of all plain words of a length, a case and an end
        self.own_words = {f[2:] for f in self.weights if f.startswith("w=")}
        self.rows = np.zeros((0, len(PLACES), len(LABELS)), np.float32)
        self.ends = np.zeros(0, bool)

    def forget(self) -> None:
        self.__post_init__()

    def plain_kind(self, word: str) -> tuple[int, bool, str] | None:
        """What all features of a word follow from that is letters and perhaps one mark, and none that the table has."""
        letters, mark = (word, "") if word[-1].isalnum() else (word[:-1], word[-1])
        if mark not in ",.;:!?" or not letters.isalpha():
            return None
        large = letters[0].isupper()
        if not (letters[1:].islower() if large else letters.islower()) or letters.lower() in self.own_words or len(word) <= 4 and mark == ".":
            return None
        return length_class(letters), large, mark

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of words, and whether a sentence ends with them."""
        rows = np.zeros((len(words), len(PLACES), len(LABELS)), np.float32)
        for k, w in enumerate(words):
            for f in features(w):
                if f in self.weights:
                    rows[k] += self.weights[f]
        return rows, np.array([w[-1] in ".!?" and w not in _SHORT and not (len(w) == 2 and w[0].isupper()) for w in words], bool)

    def index(self, words: list[str]) -> np.ndarray:
        """Numbers of the words' rows; new words are scored, plain ones of a kind once."""
        known, plain = self.known, self.plain
        fresh: list[str] = []
        at = len(self.rows)
        for w in set(words).difference(known):
            kind = self.plain_kind(w)
            if kind in plain:
                known[w] = plain[kind]
                continue
            known[w] = at + len(fresh)
            if kind is not None:
                plain[kind] = known[w]
            fresh.append(w)
        if fresh:
            rows, ends = self.score(fresh)
            self.rows, self.ends = np.concatenate([self.rows, rows]), np.concatenate([self.ends, ends])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores by label of each word; `first` marks the first words of sentences."""
        e = self.rows[ids, PLACES.index(0)].astype(np.float64)
        sentence = np.cumsum(first)
        for p, far in enumerate(PLACES):
            if far and abs(far) < len(ids):
                here, there = (slice(-far, None), slice(None, far)) if far < 0 else (slice(None, -far), slice(far, None))
                same = sentence[here] == sentence[there]
                e[here][same] += self.rows[ids[there][same], p]
        e[:, 0] += self.margin
        return e

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best label of each word, all sentences at once, those that can't hold anything but O left out."""
        labels = np.zeros(len(e), np.int8)
        heads = np.flatnonzero(first)
        lengths = np.diff(np.append(heads, len(e)))
        slack = 2 * (self.moves.max() - self.moves.min())
        # if no word gains enough by another label to pay for the moves, all O is best
        may = np.maximum.reduceat(e[:, 1:].max(axis=1) - e[:, 0], heads) + slack >= 0
        heads, lengths = heads[may], lengths[may]
        if not len(heads):
            return labels
        order = np.argsort(-lengths, kind="stable")
        heads, lengths = heads[order], lengths[order]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sentences longer than t
        best = e[heads]
        back = []
        for t in range(1, int(lengths[0])):
            n = active[t]
            paths = best[:n, :, None] + self.moves
            choice = paths.argmax(axis=1)
            back.append(choice.astype(np.int8))
            best[:n] = np.take_along_axis(paths, choice[:, None, :], 1)[:, 0] + e[heads[:n] + t]
        now = best.argmax(axis=1)
        labels[heads + lengths - 1] = now
        for t in range(int(lengths[0]) - 1, 0, -1):
            n = active[t]
            now[:n] = back[t - 1][np.arange(n), now[:n]]
            labels[heads[:n] + t - 1] = now[:n]
        return labels

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """The added spans of each text: (kind, start, end)."""
        if len(self.known) > 400_000:
            self.forget()
        split = [t.split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        total = int(lengths.sum())
        if not total:
            return out
        ids = self.index([w for ws in split for w in ws])
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(total + 1, bool)
        first[1:] = self.ends[ids]
        first[starts] = True
        first = first[:total]
        labels = self.decode(self.emissions(ids, first), first)
        hit = np.flatnonzero(labels)
        if not len(hit):
            return out
        for doc in np.unique(np.searchsorted(starts, hit, side="right") - 1).tolist():
            at = [m.span() for m in re.finditer(r"\S+", texts[doc])]
            own = labels[starts[doc] : starts[doc] + lengths[doc]]
            k = 0
            while k < len(own):
                if own[k]:
                    kind = LABELS[own[k]][2:]
                    end = k + 1
                    while end < len(own) and LABELS[own[end]] == f"I-{kind}":
                        end += 1
                    text = texts[doc]
                    begin = at[k][0] + core(text[slice(*at[k])])[1]
                    stop = at[end - 1][0] + core(text[slice(*at[end - 1])])[2]
                    if stop > begin:
                        out[doc].append((kind, begin, stop))
                    k = end
                else:
                    k += 1
        return out


@functools.cache
def train(rounds: int = 160, rate: float = 0.08, decay: float = 0.005, margin: float = 0.8, seed: int = 1) -> Field:
    """Gradient ascent (Adam) on the penalised likelihood of the labelled table; the same result every time.

    Sentences are padded to one length and go through the forward and backward sums together."""
    table = labelled_table(seed)
    n_labels, n_places = len(LABELS), len(PLACES)
    times = Counter(f for words, _ in table for w in words for f in features(w))
    # a word that is met in few sentences says nothing about others
    number = {f: k for k, f in enumerate(sorted(f for f, n in times.items() if n >= 6))}
    longest = max(len(words) for words, _ in table)
    real = np.array([[t < len(words) for t in range(longest)] for words, _ in table])
    gold = np.array([[LABELS.index(labels[t]) if t < len(labels) else 0 for t in range(longest)] for _, labels in table])
    cells, at = [], []  # features, and the words that they bear on
    for s, (words, _) in enumerate(table):
        for t, w in enumerate(words):
            mine = [number[f] for f in features(w) if f in number]
            for p, far in enumerate(PLACES):
                if 0 <= t - far < len(words):
                    cells += [k * n_places + p for k in mine]
                    at += [s * longest + t - far] * len(mine)
    cells, at = np.array(cells), np.array(at)
    by_word, by_cell = np.argsort(at, kind="stable"), np.argsort(cells, kind="stable")
    word_heads = np.flatnonzero(np.diff(at[by_word], prepend=-1))
    cell_heads = np.flatnonzero(np.diff(cells[by_cell], prepend=-1))
    words_at, cells_at = at[by_word][word_heads], cells[by_cell][cell_heads]
    allowed = np.array([[b != 2 or a in (1, 2) for b in range(n_labels)] for a in range(n_labels)])
    params = [np.zeros((len(number) * n_places, n_labels)), np.zeros((n_labels, n_labels))]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(n_labels)
    hit = one[gold] * real[..., None]
    both = real[:, 1:] & real[:, :-1]
    seen_moves = np.einsum("sta,stb->ab", hit[:, :-1], hit[:, 1:])

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    for step in range(1, rounds + 1):
        w, moves = params
        e = np.zeros((real.size, n_labels))
        e[words_at] = np.add.reduceat(w[cells[by_word]], word_heads, axis=0)
        e = e.reshape(*real.shape, n_labels)
        m = np.where(allowed, moves, -20.0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            forth = total(alpha[:, t - 1, :, None] + m, 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], forth, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], total(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = total(alpha[:, -1], 1)
        gap = (hit - np.exp(alpha + beta - z[:, None, None]) * real[..., None]).reshape(-1, n_labels)
        pairs = np.exp(alpha[:, :-1, :, None] + m + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        grads = [np.zeros_like(w), seen_moves - pairs.sum((0, 1))]
        grads[0][cells_at] = np.add.reduceat(gap[at[by_cell]], cell_heads, axis=0)
        for k, g in enumerate(grads):
            g = (g - decay * len(table) * 0.1 * params[k]) / len(table)
            means[k] = 0.9 * means[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            params[k] = params[k] + rate * means[k] / (1 - 0.9**step) / (np.sqrt(squares[k] / (1 - 0.99**step)) + 1e-8)
    w, moves = params
    rows = w.reshape(len(number), n_places, n_labels).astype(np.float32)
    return Field({f: rows[k] for f, k in number.items()}, np.where(allowed, moves, -20.0), margin)


def find_spans(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `doc_id, spans array<struct<kind, start, end>>`, in code points, end exclusive.

    Spans come by kind (email, ip, card, phone, then the field's name, id_number and secret), then by start. What the
    field finds where a pattern has matched is left out. Null and empty
    texts have none; a row for each row, repeated ones and those without an id too; other columns are not read. Texts
    and words are read whole, however long; patterns and field take time linear in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train())  # the table's features: a few hundred rows

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = worker_cache("field", lambda: shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, added in zip(texts, found_by.spans(texts)):
                base = pattern_spans(text)
                spans = [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in base[k]]
                added = [s for s in added if not any(s[1] < p["end"] and p["start"] < s[2] for p in spans)]
                rows.append(spans + [{"kind": k, "start": a, "end": b} for k, a, b in sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_text(text_frame(docs, F.col("doc_id").cast("long").alias("doc_id")), step, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = written(F.filter("spans", lambda s: s["kind"].isin(*KINDS)))
    counts = [count(k).alias(f"n_{k}") for k in KINDS], [count(k).alias(f"n_{k}") for k in ADDED]
    return found.select("doc_id", *counts[0], F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *counts[1], F.size("spans").cast("long").alias("n_spans"))


def brute_force(text: str) -> dict[str, list[Span]]:
    """The four patterns as regular expressions, nothing else; for tests."""
    def spans(pattern: str, ok) -> list[Span]:
        return [m.span() for m in re.finditer(pattern, text) if ok(m)]

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
