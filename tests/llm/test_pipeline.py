"""The whole chain against a brute-force version, on an empty table and with clashing column names."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from ledgerlens.llm import quality
from ledgerlens.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def exact(docs):
    best = {}
    for i, t in docs:
        best[lower(t)] = max(best.get(lower(t), i), i)
    return [(i, t) for i, t in docs if best[lower(t)] == i]


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(i, t) for i, t in docs if root(i) == i]


def clean(docs, bench):
    grams = {}
    for t in bench:
        w = words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(k, set()).add(tuple(w[i:i + k]))
    out = []
    for d, t in docs:
        w = words(t)
        hit = {j for k, g in grams.items() for i in range(len(w) - k + 1) if tuple(w[i:i + k]) in g for j in range(i, i + k)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((d, t))
    return out


def test_run_equals_brute_force(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    good = {r.doc_id for r in scores if r.score >= 0.7}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = clean(near(exact([r for r in rows if r[0] in good])), bench)
    assert 50 < len(left) < len(good)
    kept = {i for i, _ in left}
    path = os.path.join(tmpdir_path, "documents.parquet")
    docs.toPandas().query("doc_id in @kept").to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    size = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in left}
    want = {i: taken // size[i] if size[i] else 0 for i, taken in con.execute(f"SELECT doc_id, taken FROM ({ORACLE['op5_source_mix']})").fetchall()}
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert {i: n for i, n in got.items() if size[i]} == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("n", [0, 60])
def test_chain_with_clashing_columns_and_without_rows(spark, tmpdir_path, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(n)
    clashing = ["row", "key", "score", "keep_id", "class_id", "stays", "label", "size", "finish", "n_words", "text_sha256", "copies", "gone"]
    docs = docs.selectExpr("*", *[f"'{c}' as `{c}`" for c in clashing])
    docs.write.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    held = spark.read.parquet(os.path.join(tmpdir_path, "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, tmpdir_path)
        assert held.columns == docs.columns, name
    out = corpus_pipeline.run(spark, tmpdir_path)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and (len(rows) > 0) == (n > 0)
    assert all(r[c] == c for r in rows for c in clashing)
