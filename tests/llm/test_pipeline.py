import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_text_operators import DOCS, ITEMS, leaky, prose
from tokenizers import Tokenizer

import corpus_pipeline
from fluxcube.llm import decontaminate, langid, ngram_join

WORD = r"[^\x20\x09-\x0D]+"


def documents():
    rows = [(k, prose(lang, 20 + k % 60, k), lang, f"s{k % 4}") for k, lang in enumerate(["de", "en", "es"] * 20)]
    rows += [(100 + k, rows[k][1], rows[k][2], "s1") for k in range(6)]  # exact copies
    rows += [(200 + k, rows[k + 41][1] + " end", rows[k + 41][2], "s2") for k in range(9)]  # near copies, if long enough
    rows += [(300, leaky(1), "en", "s0"), (301, leaky(2), "en", None), (400, None, "en", "s0"), (401, "", "de", "s1"), (402, "1 2 3 4", None, "s3"), (403, prose("es", 900, 77), None, None)]
    return [(k, t, lang, s, len(t or "")) for k, t, lang, s in rows]


def mixed(docs):
    """The mix of (doc_id, text, source) in plain Python: (position, doc_id, epoch, text) in training order."""
    size = {k: len(re.findall(WORD, t)) for k, t, _ in docs}
    by_source = defaultdict(list)
    for k, t, s in docs:
        by_source[s].append((k, t))
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    total = {s: sum(size[k] for k, _ in by_source[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = []
    for i, s in enumerate(names):
        rate0, rate1 = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))[i % 3]
        goal = int(np.floor(target[s] + 0.5))
        full, rest = divmod(goal, total[s])
        begin = 0
        for k, t in sorted(by_source[s], key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()):
            take = max(0, min(size[k], rest - begin))
            copies = [t] * full + ([t] if take == size[k] else [" ".join(re.findall(WORD, t)[:take])] if take else [])
            for epoch, copy in enumerate(copies):
                need = (epoch * total[s] + begin) / goal * (rate0 + rate1) / 2
                slope = rate1 - rate0
                out.append((need / rate0 if slope == 0 else (np.sqrt(rate0 * rate0 + 2 * slope * need) - rate0) / slope, k, epoch, copy))
            begin += size[k]
    return sorted(out, key=lambda c: c[:3])


def test_pipeline_agrees_with_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]

    model = langid.fit(spark.createDataFrame(rows, DOCS))
    rejected = model.predict([r[1] or "" for r in rows])[2]
    docs = {r[0]: r for r, gone in zip(rows, rejected) if not gone}
    assert set(docs) == {r[0] for r in rows} - {400, 401, 402}
    groups = ngram_join.brute_force({k: r[1] for k, r in docs.items()}, 5, 80)
    docs = {k: r for k, r in docs.items() if groups[k][1] == k}
    assert not set(docs) & set(range(100, 106))
    leaks = decontaminate.brute_force({k: r[1] for k, r in docs.items()}, {k: t for k, t in ITEMS.items() if t})
    docs = {k: r for k, r in docs.items() if k not in {d for d, _ in leaks}}
    assert {300, 301} <= {d for d, _ in leaks}
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for _, k, _, t in mixed([(k, r[1], r[3]) for k, r in docs.items()]):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and [r[0] for r in got] != sorted(r[0] for r in got)


def test_stages_keep_columns_and_bear_odd_tables(spark, tmp_path):
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(documents(), DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df.union(df.where("doc_id = 403")), str(tmp_path))
        assert out.columns == df.columns and out.count() > 0, name
    empty = df.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_token_output_follows_the_files_or_the_ids(spark, tmp_path):
    rows = [(k if k % 9 else None, prose("en", 30 + k, k), "en", f"s{k % 3}", 0) for k in range(60)][::-1]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    by_id = corpus_pipeline.write_tokens(spark, df, "").orderBy("start").collect()
    assert [r["doc_id"] for r in by_id] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    df.repartition(3, "doc_id").sortWithinPartitions("text").write.parquet(str(tmp_path / "docs"))
    files = sorted((tmp_path / "docs").glob("part-*.parquet"))
    assert len(files) == 3
    order = [r["doc_id"] for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert [r["doc_id"] for r in corpus_pipeline.write_tokens(spark, spark.read.parquet(str(tmp_path / "docs")), "").orderBy("start").collect()] == order


@pytest.mark.parametrize("name", ["op4_chat_format", "op10_source_mix"])
def test_query_agrees_with_sql(spark, name):
    import duckdb
    from helpers import DATA

    from fluxcube.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.queries()[name](spark, DATA).collect())
    columns = queries.queries()[name](spark, DATA).columns
    assert got == sorted(con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall())
