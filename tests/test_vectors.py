import hashlib
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import knn
from ledgerlens.operators import vectors as V


def py_embed(text, dim=64):
    toks = [t for t in re.split(r"[^\w]+|_", text.lower()) if t]
    v = np.zeros(dim)
    for t in toks:
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1
    n = math.sqrt((v * v).sum())
    return (v / n if n else v).astype(np.float32)


def test_hashed_embedding_matches_plain_python(spark):
    texts = ["Invoice Number: INV-1 | Seller: ABC", "ÉCOLE école 42 x-y", "", None, "a a a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(V.hashed_embedding("t")).collect()]
    for t, g in zip(texts, got):
        assert np.allclose(np.array(g, dtype=np.float32), py_embed(t or ""), atol=0)


def brute_knn(ids, x, qids, q, k):
    out = {}
    for qi, qv in zip(qids, q):
        d = ((x.astype(np.float64) - qv) ** 2).sum(axis=1)
        order = sorted(range(len(ids)), key=lambda i: (round(d[i], 9), ids[i]))[:k]
        out[qi] = [(ids[i], round(d[i], 6)) for i in order]
    return out


def test_knn_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, dim = 700, 16
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[10] = x[11]                    # exact duplicates tie: order by id
    ids = list(range(1000, 1000 + n))
    q = rng.normal(size=(9, dim))
    q[3] = x[10]
    qids = list(range(9))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id long, embedding array<float>")
    vec = vec.repartition(5)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in zip(qids, q)], "qid long, embedding array<double>")
    monkeypatch.setattr(V, "MAX_QUERY_BATCH", 4)          # blocks
    got = V.knn_candidates(vec, qdf, 7).collect()
    want = brute_knn(ids, x, qids, q, 7)
    res = {}
    for r in sorted(got, key=lambda r: (r.qid, r.rank)):
        res.setdefault(r.qid, []).append((r.id, round(r.distance, 6)))
    assert res == want


def _index(spark):
    rows = [(i, [float(i), 0.0]) for i in range(10)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def _records(spark):
    rows = [(i, f"INV-{i}", "S", "B", float(100 * i), "USD" if i % 2 else "EUR") for i in range(10)]
    return spark.createDataFrame(rows, "id long, invoice_number string, seller_name string, buyer_name string, "
                                       "total_amount double, currency string")


def test_search_post_filter_shortfall_and_prefilter(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0], "USD")], "qid long, embedding array<double>, currency string")
    hits = V.semantic_search(_index(spark), _records(spark), q, top_k=1).collect()
    # candidates = 5 nearest (ids 0..4); id 0 fails validity (amount 0), 1 is the first USD hit
    assert [(h.id, h.rank, h.position) for h in hits] == [(1, 2, 1)]
    q2 = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, embedding array<double>")
    usd = _records(spark).filter(F.col("currency") == "USD")
    pre = V.semantic_search(_index(spark), usd, q2, top_k=3, prefilter=True).collect()
    assert sorted(h.id for h in pre) == [1, 3, 5]
    post = V.semantic_search(_index(spark), usd, q2, top_k=3).collect()
    assert sorted(h.id for h in post) == [1, 3, 5]
    assert all(abs(h.score - 1 / (1 + h.distance)) < 1e-12 for h in post)


def test_top_k_range_and_empty_index(spark):
    with pytest.raises(ValueError):
        V.check_top_k(0)
    assert V.check_top_k(50) == 50
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, embedding array<double>")
    assert V.semantic_search(empty, _records(spark), q).count() == 0


def test_add_documents_replaces_by_id_and_stats(spark):
    a = spark.createDataFrame([(1, "old", [1.0], 0), (2, "keep", [2.0], 0)],
                              "id long, matched_text string, embedding array<float>, seq int")
    b = spark.createDataFrame([(1, "new", [3.0], 1)], a.schema)
    out = {r.id: r.matched_text for r in V.add_documents(a, b).collect()}
    assert out == {1: "new", 2: "keep"}
    s = V.vector_stats(a).first()
    assert (s.n_vectors, s.dimension, s.model_name) == (2, 1, V.DEFAULT_MODEL)


def test_centroids_and_distance(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [3.0, 2.0]), (1, [5.0, 5.0])],
                               "label int, embedding array<float>")
    c = {r.label: r.embedding for r in V.centroids(df, "label").collect()}
    assert c == {0: [2.0, 1.0], 1: [5.0, 5.0]}
    d = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    assert d.select(V.l2_distance("a", "b")).first()[0] == 25.0


def found(df):
    res = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        res.setdefault(r.qid, []).append((r.id, round(r.distance, 6)))
    return res


def vector_frame(spark, x, parts=3):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(parts)


def query_frame(spark, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<double>")


@pytest.mark.parametrize("max_broadcast", [None, 0])
@pytest.mark.parametrize("group_bytes", [knn.VECTOR_GROUP_BYTES, 200])
def test_knn_by_broadcast_and_in_blocks(spark, monkeypatch, max_broadcast, group_bytes):
    monkeypatch.setattr(knn, "QUERY_BLOCK_ROWS", 7)
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "TILE_QUERIES", 4)
    monkeypatch.setattr(knn, "PAIRS", 10)
    monkeypatch.setattr(knn.block_search, "__defaults__", (group_bytes,))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    x[20:60] = x[20]                       # forty vectors tie
    q = rng.normal(size=(40, 4))
    q[5] = x[20]
    got = found(V.knn_candidates(vector_frame(spark, x), query_frame(spark, q), 5, max_broadcast=max_broadcast))
    assert got == brute_knn(list(range(90)), x, list(range(40)), q, 5)


def test_knn_ties_leave_exactly_k(spark):
    x = np.ones((3000, 3), np.float32)
    for most in (None, 0):
        got = found(V.knn_candidates(vector_frame(spark, x, 4), query_frame(spark, np.ones((2, 3))), 5, max_broadcast=most))
        assert got == {0: [(i, 0.0) for i in range(5)], 1: [(i, 0.0) for i in range(5)]}
    best = knn.Nearest(np.ones((2, 3)), 5)
    best.update(np.arange(3000)[::-1].copy(), x)
    assert len(best.rows()[0]) == 10       # what leaves a task


def test_knn_of_fifty_thousand_requests(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    base = rng.normal(size=(50, 8))
    pos = spark.range(50_000, numPartitions=4).select(F.col("id").alias("qid"), (F.col("id") % 50).alias("b"))
    q = pos.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "b long, embedding array<double>"), "b")
    cand = V.knn_candidates(vector_frame(spark, x), q.select("qid", "embedding"), 3)
    want = brute_knn(list(range(500)), x, list(range(50)), base, 3)
    rows = cand.select("qid", "id", "rank").toPandas()
    assert len(rows) == 150_000
    rows = rows.sort_values(["qid", "rank"])
    ids = rows["id"].to_numpy().reshape(50_000, 3)
    assert all((ids[i] == [a for a, _ in want[i % 50]]).all() for i in range(50_000))
    plan = cand._jdf.queryExecution().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_block_search_filters_and_payload_equal_broadcast(spark, monkeypatch):
    q = spark.createDataFrame([(1, [0.0, 0.0], "USD", None, None, "s"), (2, [0.0, 0.0], None, 500.0, "usd", None), (3, [9.0, 0.0], None, None, "EUR", "x")],
                              "qid long, embedding array<double>, currency string, min_amount double, exclude_currency string, seller_name string")
    cols = ["qid", "id", "rank", "position", "distance", "invoice_number", "currency"]
    idx = _index(spark).join(_records(spark), "id")
    runs = [lambda: V.semantic_search(_index(spark), _records(spark), q, top_k=3, prefilter=True),
            lambda: V.semantic_search(idx, None, q, top_k=2), lambda: V.semantic_search(_index(spark), _records(spark), q, top_k=2)]
    want = [sorted(map(tuple, f().select(cols).collect())) for f in runs]
    monkeypatch.setattr(V, "MAX_QUERY_BATCH", 1)
    assert [sorted(map(tuple, f().select(cols).collect())) for f in runs] == want and all(want)


def test_mixed_dimensions_and_bad_vectors_raise(spark):
    idx = _index(spark)
    mixed = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0])], "qid long, embedding array<double>")
    with pytest.raises(ValueError, match="mixed dimension"):
        V.knn_candidates(idx, mixed, 2)
    for most in (None, 0):
        with pytest.raises(Exception, match="not of size 1"):
            V.knn_candidates(idx, mixed.filter("qid = 2"), 2, max_broadcast=most).collect()


def test_user_model_embedder_and_read_vectors(spark, tmpdir_path):
    class _ToyModel:   # defined here so it is pickled by value to the workers
        def encode(self, texts):
            import numpy
            return numpy.array([[len(t), t.count("a")] for t in texts], dtype=numpy.float32)

    df = spark.createDataFrame([("aa",), ("bcd",), (None,)], "t string")
    got = [r.e for r in V.embed(df, "t", "e", embedder=V.model_embedder(_ToyModel, 2)).collect()]
    assert got == [[2.0, 2.0], [3.0, 0.0], [0.0, 0.0]]
    assert V.read_vectors(spark, tmpdir_path + "/missing").count() == 0
    with open(tmpdir_path + "/broken.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        V.read_vectors(spark, tmpdir_path + "/broken.parquet").count()


def test_user_model_loads_once_per_worker_and_encodes_a_row_once(spark, tmpdir_path):
    def load():
        import os
        import uuid

        import numpy

        class Model:
            def encode(self, texts):
                with open(f"{tmpdir_path}/rows-{uuid.uuid4().hex}", "w") as f:
                    f.write(str(len(texts)))
                return numpy.ones((len(texts), 2), dtype=numpy.float32)

        with open(f"{tmpdir_path}/load-{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
            f.write("x")
        return Model()

    emb = V.model_embedder(load, 2, name="counted")
    df = spark.range(0, 1000, numPartitions=8).select(F.col("id").cast("string").alias("t"))
    for _ in range(3):                                   # several jobs, tasks and batches
        out = V.embed(df, "t", "e", embedder=emb)
        assert out.filter(F.size("e") == 2).count() == 1000
    names = os.listdir(tmpdir_path)
    pids = [n.split("-")[1] for n in names if n.startswith("load-")]
    assert pids and len(pids) == len(set(pids))          # one load per worker process
    assert sum(int(open(os.path.join(tmpdir_path, n)).read()) for n in names if n.startswith("rows-")) == 3000


def test_token_buckets_column_matches_embedder(spark):
    df = spark.createDataFrame([("Invoice INV-7 from ABC",)], "t string")
    r = df.select(V.token_buckets("t").alias("b"), V.hashed_embedding("t").alias("e")).first()
    counts = np.bincount(np.array(r.b), minlength=64).astype(float)
    assert np.allclose(np.array(r.e), counts / np.sqrt((counts ** 2).sum()), atol=1e-7)


def test_search_with_payload_index_matches_record_join(spark):
    idx = _index(spark).join(_records(spark), "id")
    q = spark.createDataFrame([(1, [0.0, 0.0], "USD"), (2, [6.0, 0.0], None)],
                              "qid long, embedding array<double>, currency string")
    a = V.semantic_search(_index(spark), _records(spark), q, top_k=2)
    b = V.semantic_search(idx, None, q, top_k=2)
    cols = ["qid", "id", "rank", "position", "distance", "invoice_number", "currency"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    cand = V.knn_candidates(idx, q.select("qid", "embedding"), 3, payload=["currency"])
    assert {r.id: r.currency for r in cand.collect()} == {i: ("USD" if i % 2 else "EUR") for i in
                                                           {r.id for r in cand.collect()}}


def test_prefilter_per_query_filters(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0], "USD", None, None), (2, [0.0, 0.0], None, 500.0, "usd")],
                              "qid long, embedding array<double>, currency string, min_amount double, "
                              "exclude_currency string")
    hits = V.semantic_search(_index(spark), _records(spark), q, top_k=3, prefilter=True).collect()
    got = {}
    for h in sorted(hits, key=lambda h: (h.qid, h.position)):
        got.setdefault(h.qid, []).append(h.id)
    assert got[1] == [1, 3, 5]                 # USD only, nearest first, always top_k when possible
    assert got[2] == [5, 6, 7]                 # amount >= 500; exclusion is case-sensitive ('usd')
    idx = _index(spark).join(_records(spark), "id")
    again = V.semantic_search(idx, None, q, top_k=3, prefilter=True).collect()
    assert sorted((h.qid, h.id) for h in again) == sorted((h.qid, h.id) for h in hits)


def test_search_over_bound_uses_a_written_batch(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 3)], "USD" if i % 2 else None) for i in range(9)]
    q = spark.createDataFrame(rows, "qid long, embedding array<double>, currency string")
    want = sorted(map(tuple, V.semantic_search(_index(spark), _records(spark), q, top_k=2)
                      .select("qid", "id", "rank", "position").collect()))
    monkeypatch.setattr(V, "MAX_QUERY_BATCH", 4)       # 9 queries: written, then joined in blocks
    got = sorted(map(tuple, V.semantic_search(_index(spark), _records(spark), q, top_k=2)
                     .select("qid", "id", "rank", "position").collect()))
    assert got == want and len({g[0] for g in got}) == 9


def test_hits_carry_the_matched_text_of_the_index(spark):
    idx = _index(spark).withColumn("matched_text", F.concat(F.lit("text "), F.col("id").cast("string")))
    q = spark.createDataFrame([(1, [3.0, 0.0])], "qid long, embedding array<double>")
    for most in (None, 0):
        hits = V.semantic_search(idx, _records(spark), q, top_k=2, max_broadcast=most).collect()
        assert [(h.id, h.matched_text) for h in sorted(hits, key=lambda h: h.position)] == [(3, "text 3"), (2, "text 2")]


def test_block_search_works_the_view_out_once_and_masks_currencies(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def currency(i):
        seen.add(1)
        return [None, "EUR", "USD"][i % 3]

    rows = spark.range(30).select("id", F.array(F.col("id").cast("float")).alias("embedding"), F.lit(1.0).alias("_amt"),
                                  currency.asNondeterministic()("id").alias("currency"))
    asks = spark.createDataFrame([(1, [4.2], "EUR", None), (2, [4.2], None, "EUR"), (3, [4.2], "GBP", None), (4, [4.2], None, None),
                                  (5, [4.2], None, "GBP")], "qid long, embedding array<double>, currency string, exclude_currency string")
    got = V.knn_candidates(rows, asks, 3, payload=["currency"], filter_cols=["currency", "exclude_currency"], max_broadcast=0)
    found = {}
    for r in got.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((r.id, r.currency))
    assert found == {1: [(4, "EUR"), (7, "EUR"), (1, "EUR")], 2: [(5, "USD"), (3, None), (6, None)],
                     4: [(4, "EUR"), (5, "USD"), (3, None)], 5: [(4, "EUR"), (5, "USD"), (3, None)]}
    assert seen.value == 30
