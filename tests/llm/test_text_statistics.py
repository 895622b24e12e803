"""Periodic runs, collocations and token counts against brute force on small hard tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerlens.llm import collocations, periodic_runs, queries, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, row string, n_runs long, n_tokens string, f int"


def docs_frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, x, "r", 1, "k", 2) for i, t, x in rows], DOCS)


# ---------------------------------------------------------------- periodic runs

def brute_runs(w, least=24, periods=3):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, periods * q) and not any(
                    all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def repetitive(r):
    w = []
    for _ in range(r.randrange(6)):
        kind = r.randrange(4)
        if kind == 0:
            w += [r.randrange(3) for _ in range(r.randrange(40))]
        elif kind == 1:
            u = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 15))]
            w += [u[i % len(u)] for i in range(r.randrange(1, 70))]
        elif kind == 2:
            w += [r.randrange(1000) for _ in range(r.randrange(30))]
        else:
            w += ([r.randrange(2) for _ in range(r.randrange(1, 5))] * r.randrange(1, 5) + [9]) * r.randrange(1, 9)
    return w


def test_runs_equal_brute_force_alone_and_end_to_end():
    r = random.Random(7)
    texts = [repetitive(r) for _ in range(300)]
    want = [brute_runs(w) for w in texts]
    assert sum(map(len, want)) > 100
    assert periodic_runs.runs(np.array([x for w in texts for x in w], np.int64), [len(w) for w in texts]) == want
    for w, x in zip(texts[:60], want, strict=False):
        assert periodic_runs.runs(np.array(w, np.int64), [len(w)]) == [x]


def test_runs_of_long_texts():
    assert periodic_runs.runs(np.tile(np.arange(20000), 3), [60000]) == [[(0, 60000, 20000)]]
    assert periodic_runs.runs(np.zeros(300_000, np.int64), [300_000]) == [[(0, 300_000, 1)]]
    prose = np.random.default_rng(1).integers(0, 300, 200_000)
    assert periodic_runs.runs(prose, [200_000]) == [[]]


def brute_row(doc_id, text, plant):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_runs_rows(spark):
    r = random.Random(3)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", "a"), (4, "ein  wort\x0bdas " * 30, "a"), (5, "É " * 24, "a"), (5, "É " * 24, "a"),
            (6, "x " * 23, "a")] + [(i, " ".join(map(str, repetitive(r) + repetitive(r))), "a") for i in range(10, 90)]
    got = periodic_runs.periodic_runs(docs_frame(spark, rows), periodic_runs.planted).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(i, t, True) for i, t, _ in rows), key=str)
    plain = periodic_runs.periodic_runs(docs_frame(spark, [*rows, (None, "y " * 30, None)])).collect()
    assert sorted(map(tuple, plain), key=str) == sorted([brute_row(i, t, False) for i, t, _ in [*rows, (None, "y " * 30, None)]], key=str)
    assert periodic_runs.periodic_runs(docs_frame(spark, [])).count() == 0


def test_collapse_keeps_other_columns_and_texts_without_runs(spark):
    docs = docs_frame(spark, [(1, "a  b " + "x y " * 20 + "c", "l"), (2, "no  run", None), (3, None, None)])
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [
        (1, "a b x y c", "l", "r", 1, "k", 2), (2, "no  run", None, "r", 1, "k", 2), (3, None, None, "r", 1, "k", 2)]


def duck(key, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(queries.ORACLE[key])


@pytest.mark.parametrize("key", ["op4_url_filter", "op9_warc", "op11_periodic_runs", "op12_collocations"])
def test_sql_agrees(spark, key):
    cur = duck(key, documents=f"{SF}/documents.parquet", pages=f"{SF}/pages.parquet")
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = queries.QUERIES[key](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- collocations

def brute_collocations(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        inside = any(x[0] == lang and len(x) - 1 > len(w) and c >= a and any(list(x[1 + i:1 + i + len(w)]) == w for i in range(len(x) - len(w)))
                     for x, c in f.items() if c >= a and len(x) - 1 > len(w))
        if not inside:
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, left, r) in enumerate(sorted(x)[:top]))


def phrase_rows(seed, n):
    r = random.Random(seed)
    words = "New york City é ü x\x01 \x0e a b".split(" ")
    rows = [(1, None, None), (2, "", "en"), (3, " \t.\n!?", "de"), (4, "a", ""), (None, "new york new york", None)]
    for i in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(r.randrange(40)))
        rows.append((i, t, r.choice(["en", "en", "und", None])))
    return rows + rows[-5:]


@pytest.mark.parametrize("sizes", [{}, {"shard_words": 60, "range_words": 40, "every": 5}, {"shard_words": 1, "range_words": 1, "every": 3}])
def test_collocations(spark, sizes):
    rows = phrase_rows(11, 60)
    got = collocations.collocations(docs_frame(spark, rows).repartition(3), min_count=4, **sizes).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 4)
    top = collocations.collocations(docs_frame(spark, rows), min_count=4, top=3, **sizes).collect()
    assert sorted(map(tuple, top)) == brute_collocations(rows, 4, 3)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_frame(spark, [])).count() == 0
    assert collocations.collocations(docs_frame(spark, [(1, None, None), (2, "a b", "en")])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10 ** 15
    found = spark.createDataFrame([("en", "", 0, 10 ** 16), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)],
                                  "lang string, phrase string, size int, f long")
    r = collocations.scored(found).first()
    assert (r.score, r.l, r.r) == (1000 * (big - 7) * 10 ** 16 // (big * (big + 1)), big, big + 1)


def test_transducer_round_trip_union_and_cut():
    r = random.Random(2)
    texts = [" ".join(r.choice(["aa", "b", "ccc", ".", "dd"]) for _ in range(r.randrange(60))).encode() for _ in range(20)]

    def built(part):
        s = collocations.Shard(5)
        for t in part:
            for ws, ahead in collocations.portions(t, 4, 20):
                s.add(b"en", ws, ahead)
        return s.paths()

    def weights(t):
        totals = t.totals()
        return {t.path(d, i): int(x) for d, w in enumerate(totals) for i, x in enumerate(w)}

    whole = collocations.Transducer.of_sorted(*built(texts))
    halves = [collocations.Transducer.of_bytes(collocations.Transducer.of_sorted(*built(p)).to_bytes()) for p in (texts[:9], texts[9:])]
    assert weights(collocations.Transducer.union(halves)) == weights(whole)
    words, rows, counts = built(texts)
    bounds = [(b"en", b"aa", b"b"), (b"en", b"bb"), (b"en", b"ccc"), (b"fr",)]
    ends = collocations.cut(words, rows, bounds)
    paths = [tuple(words[x] for x in p if x >= 0) for p in rows.tolist()]
    assert ends == [sum(p < b for p in paths) for b in bounds]


# ---------------------------------------------------------------- token counts

def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.TOKENIZER)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


HARD_TEXTS = [None, "", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>  ", "aaaaaaaaaaaaa", "   \n\n  x", "\x00\x1c\x1f \x85 \xa0",
              "日本語テスト" * 50, "a" * 5000, "=-" * 3000, "don't we'll I'D", "😀😀 é é", "ab " * 200000, "՘Ⱟ꟎ x", "x" * 300000 + " y  z" * 9]


def test_token_counts_equal_the_library():
    r = random.Random(3)
    bits = ["a", "b", "e", " ", "  ", "\n", "the", "ing", "1", "23", "!", "é", "ß", "я", "中", "՘", "\U0001f600", "<|endoftext|>", "<|endof", "\t", "'s", "'"]
    texts = [*HARD_TEXTS, *("".join(r.choice([*bits, chr(r.randrange(1, 0xD800)), chr(r.randrange(0xE000, 0x110000))])
                                    for _ in range(r.randrange(1, 60))) for _ in range(500))]
    merges, count = token_counts.Merges(), library()
    want = [count(t) for t in texts]
    assert token_counts.Counter(merges).counts(texts) == want


def test_segments_and_memo_do_not_change_counts(monkeypatch):
    texts = pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() + HARD_TEXTS
    merges, count = token_counts.Merges(), library()
    monkeypatch.setattr(token_counts, "SEGMENT", 50)
    monkeypatch.setattr(token_counts, "GROUP_CHARS", 300)
    monkeypatch.setattr(token_counts, "MEMO_TOKENS", 20)
    assert token_counts.Counter(merges).counts(texts) == [count(t) for t in texts]


def test_token_counts_rows(spark):
    rows = [(i, t, "en") for i, t in enumerate(HARD_TEXTS)] + [(None, "a b", None), (1, "x", "en"), (1, "x", "en")]
    got = token_counts.token_counts(docs_frame(spark, rows)).collect()
    count = library()
    want = [(i, len((t or "").encode()), count(t), count(t) > 1024) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs_frame(spark, [])).count() == 0
    few = token_counts.counted(docs_frame(spark, rows), ["doc_id", "n_tokens"]).filter("row.doc_id = 2").first()
    assert (few.row.n_tokens, few.n_tokens, few.n_bytes) == ("k", 1, 1)


def test_arrow_batches_are_bounded_by_bytes(spark):
    from ledgerlens.llm import common

    held = spark.conf.get(common._ARROW)
    try:
        for given, left in (("1m", "1m"), ("16mb", str(common.ARROW_BYTES)), ("2097152", "2097152"), ("1g", str(common.ARROW_BYTES))):
            spark.conf.set(common._ARROW, given)
            common.small_batches(spark)
            assert spark.conf.get(common._ARROW) == left
        spark.conf.unset(common._ARROW)
        common.small_batches(spark)
        assert spark.conf.get(common._ARROW) == str(common.ARROW_BYTES)
    finally:
        spark.conf.set(common._ARROW, held)
