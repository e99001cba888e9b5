import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fluxcube.llm import embed_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as h", "1 as gram", "2 as node", "3 as n", "array(1) as spans") if extra else df


# --- repeated strings -------------------------------------------------------------------------------------------------

LINE = "the quick brown fox jumps over the lazy dog while forty two geese look on and say nothing at all, "
PASSAGE = "".join(f"{LINE[:60]}{k:03d} " for k in range(6))


def check_repeats(spark, texts, min_len=200, **options):
    got = {r[0]: tuple(r)[1:5] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs(spark, texts, True), min_len, **options)).collect()}
    assert got == suffix_dedup.brute_force(texts, min_len)
    return got


def test_repeats(spark):
    texts = {1: "A" * 50 + PASSAGE + "B" * 80, 2: PASSAGE, 3: "x " * 120 + PASSAGE[30:260], 4: None, 5: "", 6: "short", 7: LINE * 5, 8: "a" * 500, 9: "é" * 300, 10: PASSAGE[:199], 11: "q" + PASSAGE[:200] + "q", 12: "".join(map(chr, range(1, 400)))}
    got = check_repeats(spark, texts)
    assert got[2][1] == len(PASSAGE) and got[4] == got[5] and got[10][1] == 0 and got[11][1:3] == (200, 1) and got[12][1] == 0
    assert check_repeats(spark, texts, max_variants=2) == got  # minimizers dealt over several blocks


def test_repeats_in_many_surroundings(spark):
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    texts = {k: noise(int(rng.integers(0, 150))) + PASSAGE[int(rng.integers(0, 40)) :] + noise(int(rng.integers(0, 150))) for k in range(40)}
    assert check_repeats(spark, texts) == check_repeats(spark, texts, max_variants=5)


def test_repeated_rows_and_no_rows(spark):
    df = docs(spark, {1: PASSAGE, 2: "z"})
    got = suffix_dedup.remove_repeats(df.union(df.where("doc_id = 1"))).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, len(PASSAGE)), (1, len(PASSAGE)), (2, 0)]
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def test_repeats_without_ids_and_under_shared_ones(spark):
    big = (1 << 60) + 1  # no double holds it
    rows = [(None, PASSAGE + "a" * 60), (None, "b" * 30 + PASSAGE), (None, None), (big, "c" + PASSAGE[:250]), (4, "x y " * 10), (4, "z" * 199), (4, PASSAGE), (5, PASSAGE)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {k: v for k, v in enumerate(suffix_dedup.brute_force(dict(enumerate(t for _, t in rows))).values())}
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got), key=str) == sorted(((d, *want[k][:3]) for k, (d, _) in enumerate(rows)), key=str)


def test_repeats_in_very_long_and_tied_texts(spark):
    rng = np.random.default_rng(8)
    noise = "".join(chr(97 + x) for x in rng.integers(0, 26, 300_000))
    texts = {1: noise + PASSAGE + noise[:1000], 2: "ab" * 2000, 3: "ab" * 150, 4: noise[5000:5300], 5: "\x00" * 700}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    assert got == {k: v[:3] for k, v in suffix_dedup.brute_force(texts).items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), max_size=5), st.integers(8, 14), st.sampled_from([0, 97]))
def test_transform_finds_every_repeat(parts, min_len, least):
    data = bytes(x + least for x in b"".join(parts)) + bytes([35, 0][least == 0:][:1]) * 3
    klass, _ = suffix_dedup.repeated_starts(np.frombuffer(data, np.uint8), min_len)
    seen: dict[bytes, int] = {}
    for i in range(len(data) - min_len + 1):
        s = data[i : i + min_len]
        assert klass[seen.setdefault(s, i)] == klass[i]
    assert len({klass[i] for i in seen.values()}) == len(seen)


def test_runs_hold_every_window():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 199, 200, 201, 1500)] + [b"ab" * 300]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    doc, start, n_win, anchor, _ = suffix_dedup.runs_of(np.frombuffer(b"".join(texts), np.uint8), offsets, 200)
    for k, t in enumerate(texts):
        mine = sorted((s, s + n) for d, s, n in zip(doc.tolist(), start.tolist(), n_win.tolist()) if d == k)
        windows = max(0, len(t) - 199)
        assert [x for a, b in mine for x in range(a, b)] == list(range(windows))
    assert (anchor >= n_win - 1).all() and (anchor <= 184 + n_win).all()


# --- vectors ----------------------------------------------------------------------------------------------------------


def vector_truth(vectors, t):
    ids = sorted(vectors)
    ok = {k: v for k, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= t
    links = {a: [b for b in ok if b != a and cos(ok[a], ok[b])] if a in ok else [] for a in ids}
    label = {a: a for a in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            low = min([label[a], *[label[b] for b in links[a]]])
            if low < label[a]:
                label[a], changed = low, True
    return {a: (len(links[a]), label[a], label[a] == a) for a in ids}


@pytest.mark.parametrize("chunk", [8192, 7])
def test_vectors(spark, chunk):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 16))
    near = [c + 0.06 * rng.standard_normal(16) * s for c in centre for s in (0, 0, 1, 1, 2, 3, 4)]
    vectors = {k: [float(x) for x in v] for k, v in enumerate([*near, *rng.standard_normal((60, 16))])}
    vectors |= {200: None, 201: [], 202: [0.0] * 16, 203: [float("nan")] + [1.0] * 15, 204: [None] + [1.0] * 15, 205: [3 * x for x in vectors[0]], 206: [1.0, 2.0], 207: [2.0, 4.0], 208: [float("inf")] * 16, 209: [1e300] * 16, 210: [1e-300] * 16}
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in vectors.items()], "vec_id long, embedding array<double>, label int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, chunk=chunk).collect()}
    ones = {209, 210}
    want = vector_truth({k: ([1.0] * 16 if k in ones else v) for k, v in vectors.items()}, 0.95)
    assert got == want
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0
    assert embed_dedup.near_duplicates(df.where("vec_id in (200, 201)")).count() == 2


def test_vectors_at_the_threshold_and_without_ids(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0])]
    for k, d in enumerate((-1e-6, -1e-9, 1e-9, 1e-6), 1):
        c = 0.95 + d
        rows += [(k, [c, float(np.sqrt(1 - c * c)) * (-1) ** k, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.001 * k])]
    rows += [(7, [0.0, 0.0, 1.0, 0.0]), (7, [0.0, 0.0, 2.0, 0.0]), (None, None)]
    got = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    # 1 and 3, 2 and 4 lie on the same side of 0, which only 3 and 4 are near enough to
    want = [(0, 2, 0, True), (1, 1, 0, False), (2, 1, 0, False), (3, 2, 0, False), (4, 2, 0, False), (7, 5, 7, True), (7, 5, 7, True), (None, 0, None, False), *[(None, 5, None, False)] * 4]
    assert got == sorted(want, key=str)


def test_blocks_admit_each_pair_once():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((200, 12))
    a[100:] = a[:100] + 0.08 * rng.standard_normal((100, 12))
    a = (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)
    found = [(i, j) for b in range(5) for x, y, cos in embed_dedup.join_block(a, None, b, 5, 0.1) for i, j, c in zip(x.tolist(), y.tolist(), cos.tolist()) if c >= 0.95]
    i, j = np.nonzero(np.triu(a.astype(np.float64) @ a.T.astype(np.float64) >= 0.95, 1))
    assert len(found) == len(set(found)) and set(found) == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("levels", [0, 1, 4, 6])
def test_cells_bring_near_points_together_once(levels):
    rng = np.random.default_rng(levels)
    x = rng.standard_normal((1500, 8)) / 8
    cells = embed_dedup.Cells(x[:400], levels)
    home = cells.home(x)
    row, cell = cells.visits(x, 0.0125)
    visits = set(zip(row.tolist(), cell.tolist()))
    assert len(visits) == len(row)
    i, j = np.nonzero(np.triu(((x[:, None] - x[None]) ** 2).sum(-1) <= 0.0125, 1))
    for a, b in zip(i.tolist(), j.tolist()):
        a, b = (a, b) if home[a] <= home[b] else (b, a)
        assert home[a] == home[b] or (a, home[b]) in visits


def test_cells_keep_comparisons_below_the_square():
    """Vectors of a block that meet in cells, for five times as many vectors: far less than 25 times."""
    met = []
    for n in (20_000, 100_000):
        x = np.random.default_rng(1).standard_normal((n, 8)) / 8
        cells = embed_dedup.Cells(x[: embed_dedup.SAMPLE], int(np.ceil(np.log2(n / 1000))))
        home = np.bincount(cells.home(x), minlength=1 << cells.levels)
        guests = np.bincount(cells.visits(x, 0.0125)[1], minlength=1 << cells.levels)
        met.append((home * (home / 2 + guests)).sum())
    assert met[1] < 17 * met[0]


# --- n-gram sets ------------------------------------------------------------------------------------------------------


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        words = base.copy()
        for at in rng.integers(0, len(words), edits):
            words[at] = f"w{rng.integers(0, 10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("words, percent, group, most", [(3, 90, 4096, 4), (5, 80, 4096, 4), (3, 90, 5, 4), (2, 50, 4096, 0), (5, 80, 5, 0), (5, 80, 4, 100)])
def test_ngram_sets(spark, monkeypatch, words, percent, group, most):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "CANDIDATES", most)
    rng = np.random.default_rng(words + percent)
    base = [f"b{x}" for x in rng.integers(0, 300, 150)]
    texts = [*near_copies(rng, 12, base, 2), *near_copies(rng, 12, base, 4), *near_copies(rng, 6, base, 9), *near_copies(rng, 4, [f"c{x}" for x in range(40)], 1), "a b", "A  B", "a", None, "", " \n\t", "b a", "Éa b", "éa b", "a\u00a0b c d", "x " * 300, "x x x x"]
    texts += [" ".join(f"u{rng.integers(0, 10**6)}" for _ in range(50)) + " " + " ".join(base[:60]) for _ in range(10)]
    texts = dict(enumerate([*texts, texts[0], texts[0].upper()]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts, True), words, percent).collect()}
    assert got == ngram_join.brute_force(texts, words, percent)


def test_ngram_sets_of_odd_tables(spark):
    df = docs(spark, {1: "a b c d e f", 2: "a b c d e f", 3: None})
    twice = df.union(df)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(twice).collect()) == sorted([(1, 2, 1), (2, 2, 1), (3, 0, 3)] * 2)
    assert sorted(r["doc_id"] for r in ngram_join.keep_first(twice).collect()) == [1, 3] and ngram_join.keep_first(df).columns == df.columns
    assert ngram_join.jaccard_components(df.where("false")).count() == 0


def test_large_group_of_near_copies_hands_on_few_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"b{x}" for x in rng.integers(0, 3000, 150)]
    texts = [t for edits in range(1, 11) for t in near_copies(rng, 200, base, edits)]
    rows, plain = {}, ngram_join.materialize

    def counted(df, name):
        rows[name] = (done := plain(df, name)).count()
        return done

    monkeypatch.setattr(ngram_join, "materialize", counted)
    got = [r["component_id"] for r in sorted(ngram_join.jaccard_components(docs(spark, dict(enumerate(texts)))).collect())]
    assert sum(n for name, n in rows.items() if name not in ("posts", "named_posts")) < rows["posts"] + 10 * len(texts)
    assert rows["meetings"] <= ngram_join.CANDIDATES * rows["posts"]
    sets = [ngram_join.Shingler(5)(t.encode()) for t in texts]
    terms = np.unique(np.concatenate(sets))
    member = np.zeros((len(sets), len(terms)), np.float32)
    for k, s in enumerate(sets):
        member[k, np.searchsorted(terms, s)] = 1
    n, both = member.sum(1), member @ member.T
    linked = 100 * both >= 80 * (n[:, None] + n[None] - both)
    label = np.arange(len(sets))
    while (new := np.array([label[x].min() for x in linked])).tolist() != label.tolist():
        label = new
    assert got == label.tolist() and 1 < len(set(got)) < len(got)


def test_ngram_sets_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None), (4, "x y z u v w"), (4, "a b c d e f"), (5, "x y z u v w")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (None, 0, None), (2, 2, 2), (3, 2, 2), (4, 2, 2), (4, 2, 4), (5, 2, 4)], key=str)


def test_bitmap_tables_agree_with_single_bitmaps():
    rng = np.random.default_rng(4)
    maps = [ngram_join.bitmap(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 3000, 40, 600, 1500, 700, 2)]
    table = ngram_join.Bitmaps(maps)
    others = np.arange(len(maps))
    assert all(table.differences(x, others).tolist() == [ngram_join.differences(maps[x], m) for m in maps] for x in range(len(maps)))


def test_first_copies_with_null_and_shared_ids(spark):
    rows = [(None, "u v w x y z", "en"), (None, "a b c d e f", "en"), (None, "k l m n o p", "en"), (None, "k l m n o p", "de"), (None, None, None), (None, None, "en")]
    rows += [(5, "a b c d e f", "en"), (7, "a b c d e f", None), (7, "q r s t u v w", "en"), (7, "one two three", "en"), (7, "one two three", "de"), (8, None, None), (8, "", None), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = ngram_join.keep_first(df)
    assert got.columns == df.columns
    key = lambda r: str(r)
    want = [(None, "u v w x y z"), (None, "k l m n o p"), (None, ""), (None, ""), (5, "a b c d e f"), (7, "q r s t u v w"), (7, "one two three"), (8, ""), (9, "")]
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key) == sorted(want, key=key)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 400))
def test_bitmaps_never_see_too_much(a, b, keep):
    other = set(list(a)[:keep]) | b
    x, y = (np.array(sorted(s), np.uint64) for s in (a, other))
    assert ngram_join.differences(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(a ^ other)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    from fluxcube.llm.common import UnionFind, components

    uf = UnionFind()
    for a, b in edges:
        uf.union(a, b)
    want = {x: uf.find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3)), max_size=14), st.integers(1, 5))
def test_lone_posts_drop_out_at_any_batch_size(posts, size):
    import pyarrow as pa

    posts = sorted(posts)
    node = lambda x: bytes([x]) * 16
    batches = [
        pa.RecordBatch.from_arrays([pa.array([g for g, _ in part], pa.int64()), pa.array([node(x) for _, x in part], pa.binary()), pa.array([1] * len(part), pa.int32()), pa.array([0] * len(part), pa.int32())], ["gram", "node", "n", "pos"])
        for i in range(0, len(posts), size)
        for part in [posts[i : i + size]]
    ]
    got = [(r["gram"], r["node"][0]) for b in ngram_join._not_alone(iter(batches)) for r in b.to_pylist()]
    distinct = sorted(set(posts))
    assert sorted(got) == [p for p in distinct if sum(q[0] == p[0] for q in distinct) > 1]
