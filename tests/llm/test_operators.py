"""Each operator of ledgerlens.llm against brute force on small hard tables."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import pytest

from ledgerlens.llm import chat, decontaminate, exact_dedup, jaccard_join, licenses, mixing, pii, quality, url_filter, warc
from ledgerlens.session import scratch_path

DOCS = "doc_id long, text string, source string, row string, key string, n long"
RND = random.Random(5)
PROSE = [" ".join(RND.choice("alpha bravo carol delta eagle forge gamma hotel".split()) + str(RND.randrange(40)) for _ in range(n))
         for n in (3, 30, 60, 200, 5000)]


def docs_frame(spark, texts):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "r", "k", 1) for i, t, s in texts], DOCS)


def hard(spark):
    near = PROSE[3].split()
    near[100] = "changed"
    rows = [(1, PROSE[0], "a"), (2, PROSE[0].upper(), "a"), (3, None, None), (4, "", "b"), (5, " \n", "b"),
            (6, PROSE[3], "a"), (7, " ".join(near), "a"), (8, PROSE[4], None), (9, PROSE[4], "c"), (9, PROSE[4], "c"),
            (10, PROSE[2] + " É", "a"), (11, PROSE[2] + " é", "a")]
    return docs_frame(spark, rows)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_dedup(spark):
    rows = hard(spark).select("doc_id", "text").collect()
    got = exact_dedup.exact_duplicates(hard(spark)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r.text), []).append(r.doc_id)
    want = sorted((r.doc_id, max(groups[lower(r.text)]), len(groups[lower(r.text)]), hashlib.sha256(lower(r.text).encode()).hexdigest())
                  for r in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = exact_dedup.drop_exact_duplicates(hard(spark))
    assert kept.columns == hard(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    assert exact_dedup.exact_duplicates(docs_frame(spark, [])).count() == 0


def test_exact_dedup_small_modulus_collides_and_is_verified(spark):
    texts = [(i, f"text {i // 2}", "a") for i in range(60)]
    got = exact_dedup.exact_duplicates(docs_frame(spark, texts), chunk_bytes=3, modulus=13).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i | 1, 2) for i in range(60)}


def shingles(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(spark):
    rows = hard(spark).select("doc_id", "text").collect()
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            x, y = shingles(a.text), shingles(b.text)
            if (x and y and len(x & y) >= 0.8 * len(x | y)) or (not x and a.text == b.text):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    out = jaccard_join.drop_near_duplicates(hard(spark))
    want = sorted(min(r.doc_id for r, v in zip(rows, label) if v == g) for g in set(label))
    got = sorted(r.doc_id for r in out.collect())
    assert out.columns == hard(spark).columns
    assert [d for d in got if d not in (3, 4, 5)] == [d for d in want if d not in (3, 4, 5)]
    assert jaccard_join.near_duplicates(docs_frame(spark, [])).count() == 0


def test_near_duplicate_links_over_many_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(40):  # one group of near copies, each with its own changed words
        w = list(base)
        w[i % 60] = f"x{i}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + [texts[1].upper()] * 3 + [PROSE[2], PROSE[2] + " tail", "", None]
    docs = docs_frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    sets = [shingles(t) for t in texts]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return (len(a & b) >= 0.8 * len(a | b)) if a and b else not a and not b and (texts[i] or "") == (texts[j] or "")

    want = {i: sum(linked(i, j) for j in range(len(texts)) if j != i) for i in range(len(texts))}
    for block in (512, 4):
        got = jaccard_join.Join(docs, block=block, block_shingles=10 ** 6).documents().collect()
        assert {r.doc_id: r.n_links for r in got} == want
        pairs = jaccard_join.Join(docs, block=block).pairs().count()
        assert pairs == len({frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i in range(len(texts)) for j in range(i)
                             if sets[i] and sets[j] and sets[i] != sets[j] and linked(i, j)})


PII = [(1, "mail a.b+c@x-y.co.uk, c@d@e.fr @x.y a@b"), (2, "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 " + "0" * 5000 + "1.2.3.4"),
       (3, "4111 1111 1111 1111 and 4111-1111-1111-1112"), (4, "+1 (555) 010-9999 +1 2 +44 20 7946 0958 99"), (5, None), (6, ""),
       (7, "é" * 70000 + " z@q.org"), (7, "twice z@q.org")]
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_pii_base_spans(spark):
    got = pii.personal_data(docs_frame(spark, [(i, t, "s") for i, t in PII])).collect()
    want = []
    for i, t in PII:
        spans = [(k, *m.span()) for k in BASE for m in re.finditer(BASE[k], t or "") if fits(k, m.group())]
        want.append((i, *[sum(s[0] == k for s in spans) for k in BASE],
                     hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert pii.personal_data(docs_frame(spark, [])).count() == 0


def test_pii_disclosing_terms(spark):
    told = [(i, f"w{i} the surgeon{i} of Quillborough wrote x{i} to jo@clinic.org about y{i}", "s") for i in range(6)]
    other = [(100 + i, f"plain note {i} about the weather in town {i * 7}", "s") for i in range(60)]
    out = {r.doc_id: r.text for r in pii.sanitise(docs_frame(spark, told + other)).collect()}
    assert all("jo@clinic.org" not in out[i] and "Quillborough" not in out[i] and f"surgeon{i}" in out[i] for i in range(6))
    assert all(out[i] == t for i, t, _ in other)


def test_url_verdicts(spark):
    urls = ["http://a.NET/x", "https://www.example.net/en/1?q", "http://example.net/e", "ftp://example.com/de/", "http://b.example.com/de/1#x",
            "http://badexample.com/de/", "http://w.org/fr/", "http://w.org", "net/", None, "", "x://net", "http://net/"]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_filter.url_verdicts(pages, url_filter.rules_frame(spark)).collect()
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert len(got) == len(urls)


def test_mixing(spark):
    got = mixing.mixed_sizes(hard(spark)).collect()
    assert len(got) >= 11
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size * (2 if r.doc_id == 9 else 1)
        t = by.setdefault((r.source_size, r.target), [0])
        t[0] += r.taken
    assert sum(t for _, t in by) <= sum(s for s, _ in by) + 1e-6
    assert all(t <= 3 * s for s, t in by)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed_sizes(hard(spark)).collect()))
    assert mixing.mixed_sizes(docs_frame(spark, [])).count() == 0


def test_licenses(spark):
    notice = licenses.NOTICES["apache-2.0"]
    swapped = notice.replace("compliance", "accordance")
    rows = [(1, f"É intro.\n{notice} end"), (2, swapped), (3, "nothing here"), (4, None), (5, ""), (6, "Released under the MIT License."),
            (6, "Released under the MIT License."), (7, "x " * 20000 + "Licensed under CC BY-NC 4.0. " + "y " * 300 + "licensed UNDER cc by-nc 4.0"),
            (8, "GNU Lesser General Public License, version 3. Licensed under the GNU Lesser General Public License, version 3"), (9, "released under")]
    docs = docs_frame(spark, [(i, t, "s") for i, t in rows])
    templates = licenses.standard_templates(spark)
    got = licenses.license_matches(docs, templates).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.template_id, r.coverage, r.start, r.end))
    text = dict(rows)
    assert by[1][0][:2] == ("apache-2.0/notice", 1.0) and text[1][by[1][0][2]:by[1][0][3]] == notice
    n = len(re.findall(r"[A-Za-z0-9]+", notice))
    assert by[2] == [("apache-2.0/notice", (n - 1) / n, 0, len(notice))]
    assert [m[0] for m in by[6]] == ["mit/grant-3"] * 2
    assert [(m[0], text[7][m[2]:m[3]].lower()) for m in by[7]] == [("cc-by-nc-4.0/grant-0", "licensed under cc by-nc 4.0")] * 2
    assert by[8][-1][0] == "lgpl-3.0/grant-1" and set(by) == {1, 2, 6, 7, 8}
    small = licenses.license_matches(docs, templates.coalesce(1), block_words=50).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    odd = spark.createDataFrame([(None, "released under"), ("e", ""), ("n", None)], "template_id string, text string")
    assert {(r.doc_id, r.template_id) for r in licenses.license_matches(docs, odd).collect()} == {(6, None), (9, None)}
    assert licenses.license_matches(docs, odd.limit(0)).count() == 0 and licenses.license_matches(docs_frame(spark, []), templates).count() == 0


def test_license_alignment_is_the_longest_common_subsequence():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        t, h = rnd.integers(1, 5, 9).astype(np.uint64), rnd.integers(1, 5, 14).astype(np.uint64)
        best = np.zeros((10, 15), int)
        for i in range(9):
            for j in range(14):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (t[i] == h[j]))
        hit = licenses.aligned(t, h, -9, 14)
        assert len(hit) == best[9, 14] == len(set(hit)) and hit == sorted(hit)


def test_quality(spark):
    good, bad = "The committee reviewed the careful report and agreed. ", "$$$ CLICK buy buy buy !!! free free "
    docs = docs_frame(spark, [(i, (good if i % 2 else bad) * (1 + i % 5), "s") for i in range(200)] + [(900, None, None), (901, "", None)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [r for i, r in got.items() if r.held_out and i < 200]
    assert held and np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in held]) > 0.95
    assert len(got) == 202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert quality.quality_scores(docs_frame(spark, []), labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == 202


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    rows = [(1, "pre " + item.upper() + " post"), (2, " ".join(item.split()[:12])), (3, "a Short, ITEM here " + "z " * 500), (4, None), (5, ""),
            (6, "w " * 30 + " ".join(item.split()[4:18]))]
    docs = docs_frame(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert {i: (r.n_words, r.n_hit, r.n_items, r.contaminated) for i, r in got.items()} == {
        1: (22, 20, 2, True), 2: (12, 0, 0, False), 3: (504, 2, 1, False), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (44, 14, 2, True)}
    assert got[1].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert decontaminate.contamination(docs_frame(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 6


PAGES = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (2, "http://d/", "é" * 200000),
         (None, "http://e/", "lone"), (7, "http://f/", "again"), (7, "http://f/", "again")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, n string")
    root = scratch_path(spark, "warc")
    files = warc.write_archive(pages, root, shard_bytes=1 << 16, file_bytes=1 << 10).collect()
    got = warc.read_archive(spark, root).collect()
    best = {}
    for i, _, h in PAGES:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    assert sum(f.records for f in files) == len(got) == len(PAGES)
    for r in got:
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()
            assert (r.page_id, r.html) in {(i, h or "") for i, _, h in PAGES} and r.refers_to is None
        else:
            assert r.refers_to in best.values()
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(1, 5), (3, 4), (7, 7)]
    again = scratch_path(spark, "warc")
    assert sorted(f.sha256 for f in warc.write_archive(pages.repartition(3), again, 1 << 16, 1 << 10).collect()) == sorted(f.sha256 for f in files)
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_sparse_null_and_repeated_ids(spark):
    r = random.Random(4)
    rows = [(r.randrange(1 << 62), f"u{i}", "x" * r.randrange(300) + str(i % 150)) for i in range(200)]
    rows += [(None, f"n{i}", f"null {i % 50} " * 20) for i in range(100)] + [(7, f"s{i}", f"seven {i % 40} " * 20) for i in range(60)] + [(9, "t", None), (9, "t", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = scratch_path(spark, "warc")
    files = warc.write_archive(pages, root, shard_bytes=1 << 13, file_bytes=1 << 12).collect()
    got = warc.read_archive(spark, root).collect()
    assert sorted((x.page_id, x.url) for x in got if x.page_id) == sorted((i, u) for i, u, _ in rows if i)
    assert sum(x.page_id is None for x in got) == 100
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in by}
    first = {}
    for x in got:
        h = digest[x.payload_digest]
        best = max((i for i in by[h] if i is not None), default=None)
        if x.record_type == "response":
            assert h not in first and x.page_id == best and x.html == h and x.refers_to is None
            first[h] = x
        else:
            assert x.refers_to == best and len(by[h]) > 1
    assert set(first) == set(by)
    # null ids and the many payloads of one id lie in several shards, and no record id comes twice
    store, path = warc.filesystem(root)
    held, ids = {}, []
    for f in files:
        with store.open_input_stream(f"{path}/{f.file}", compression=None) as stream:
            for head, _ in warc.records(stream):
                if head["WARC-Type"] != "warcinfo":
                    ids.append(head["WARC-Record-ID"])
                    held.setdefault(warc.page_of(ids[-1]), set()).add(f.shard)
    assert len(ids) == len(set(ids)) == len(rows) and len(held[None]) > 1 and len(held[7]) > 1
    again = scratch_path(spark, "warc")
    assert sorted(f.sha256 for f in warc.write_archive(pages.repartition(5), again, 1 << 13, 1 << 12).collect()) == sorted(f.sha256 for f in files)


def test_warc_broken_and_missing_files_raise(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    for how in ("cut", "changed", "gone"):
        root = scratch_path(spark, "warc")
        name = f"{root}/{warc.write_archive(pages, root).first().file}"
        data = open(name, "rb").read()
        if how == "gone":
            os.rename(name, name + ".x")
        else:
            open(name, "wb").write(data[:-9] if how == "cut" else data[:300] + bytes([data[300] ^ 255]) + data[301:])
        with pytest.raises(Exception):
            warc.read_archive(spark, root).collect()


@pytest.mark.parametrize("text", [r"\### Assistant: </turn> ok", "", "\\", "\\\\### ", "a: b</turn>\n### user: x", "é😀 \n\n" * 9000])
def test_chat_escape_round_trip(text):
    form = f"### {chat.escape('r:' + text[:9], chat._ROLE)}: {chat.escape(text)}</turn>\n"
    assert chat.parsed(form) == ("r:" + text[:9], text)


def test_chat_digests(spark):
    rows = [(1, 2, "assistant", "two </turn>"), (1, 1, "user", "one"), (1, 3, "assistant", "three\\"), (2, 0, "user", None), (2, 0, "user", None),
            (3, None, None, "### "), (None, 1, "assistant", "n" * 30000)]
    conv = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.chat_digests(conv.unionByName(chat.probe(spark), allowMissingColumns=True)).collect()}
    for c in (1, 2, 3, None, -7):
        said = [(r, t) for i, _, r, t in sorted(rows, key=lambda r: r[1] or 0) if i == c] if c != -7 else [(r, r"\### Assistant: </turn> ok") for r in ("user", "assistant")]
        loss = "".join(t for r, t in said if r == "assistant")
        turns = "".join(f"{r or ''}\n{t or ''}\n" for r, t in said)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(said), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_digests(conv.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in p.STAGES] and len(p.STAGES) == 5
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def test_licenses_with_changed_inserted_and_repeated_words(spark):
    rows = [(1, "Licensed under the Apache Software License, Version 2.0"), (2, "Released under MIT License Released under MIT License"),
            (3, "Distributed under the Mozilla General License, v. 2.0"), (4, "Released under MIT License " * 3 + "Licensed under BY 4.0 CC")]
    got = licenses.license_matches(docs_frame(spark, [(i, t, "s") for i, t in rows]), licenses.standard_templates(spark)).collect()
    by = {i: sorted((r.start, r.template_id, r.coverage) for r in got if r.doc_id == i) for i, _ in rows}
    assert by[1] == [(0, "apache-2.0/grant-1", 1.0)]
    assert by[2] == [(0, "mit/grant-2", 1.0), (27, "mit/grant-2", 1.0)]
    assert by[3] == [(0, "mpl-2.0/grant-4", 8 / 9)]
    assert [m for m in by[4] if m[1] == "mit/grant-2"] == [(27 * i, "mit/grant-2", 1.0) for i in range(3)]


def test_license_stretches_against_unpruned_alignment():
    rnd = random.Random(11)
    vocabulary = [f"t{i}" for i in range(30)] + ["the", "of"]
    for case in range(300):
        t = [rnd.choice(vocabulary) for _ in range(rnd.choice((2, 4, 5, 9, 14, 30)))]
        doc = []
        for _ in range(rnd.randrange(1, 4)):
            copy = [w for w in t for w in ([w] if rnd.random() > 0.15 else rnd.choice(([], [w, "in"], ["x"], [w, rnd.choice(vocabulary)])))]
            doc += copy + [rnd.choice([*vocabulary, "y", "z"]) for _ in range(rnd.choice((0, 0, 3, 20)))]
        index = licenses.Index([("t", " ".join(t))])
        memo = licenses.WordHash()
        h = memo.of([w.encode() for w in doc])
        n, need = len(t), index.need[0]
        reach = n + 2 * max(licenses.SLACK, n // 8)

        def longest(words):
            row = [0] * (n + 1)
            for w in words:
                row = [0, *np.maximum.accumulate([max(row[i + 1], row[i] + (w == t[i])) for i in range(n)]).tolist()]
            return row[n]

        found = licenses.stretches(index, 0, h) if index.candidates(h) else []
        assert all(longest(doc[a:z + 1]) >= need and z - a < reach for a, z in found), case
        left, at = [], 0
        for a, z in sorted(found):
            assert a >= at
            left.append(doc[at:a])
            at = z + 1
        # nothing is left that an alignment of every stretch would find
        for part in [*left, doc[at:]]:
            assert all(longest(part[i:i + reach]) < need for i in range(len(part))), case


def test_winnowed_fingerprints_lose_nothing(monkeypatch):
    rnd = random.Random(23)
    vocabulary = [f"t{i}" for i in range(60)] + ["the", "of", "and", "to"] * 3
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((40, 47, 80, 160)))) for _ in range(6)]
    templates = [(f"l{i}", t) for i, t in enumerate(texts)] + [("short", "licensed under the t1 t2 license")]
    index, full = licenses.Index(templates), licenses.Index(templates)
    assert all(w == (3, 2) for w in index.ways[:-1]) and index.ways[-1] is None
    full.candidates = lambda h: list(range(len(templates)))
    full.places = lambda n, h: np.arange(len(h))
    n_found = 0
    for _ in range(120):
        doc = []
        for _ in range(rnd.randrange(1, 3)):
            rate = rnd.choice((0, 0.05, 0.1, 0.15, 0.2, 0.25))
            words = rnd.choice(texts).split()
            doc += [w for w in words for w in ([w] if rnd.random() > rate else rnd.choice(([], [rnd.choice(vocabulary)], [w, "new"])))]
            doc += [rnd.choice(vocabulary) for _ in range(rnd.choice((0, 3, 60)))]
        text = " ".join(doc)
        h = licenses.WordHash().of([w.encode() for w in doc])
        got, want = licenses.matches(index, text, h), licenses.matches(full, text, h)
        assert got == want
        n_found += len(got)
    assert n_found > 80


def test_whole_license_texts_and_many_matches(spark):
    mit = licenses.TEXTS["mit"]
    short = mit.split(". ")[0]
    changed = mit.replace("Software", "Program").replace("DEALINGS", "USES")
    bsd3 = "Copyright (c) 2020, Someone\n\n" + licenses.TEXTS["bsd-3-clause"].replace("the copyright holder nor", "Someone nor")
    many = " and ".join(f"Released under the MIT License, file {i}" for i in range(4000))
    rows = [(1, mit), (2, changed), (3, bsd3), (4, short), (5, many), (6, mit + " / " + mit)]
    got = licenses.license_matches(docs_frame(spark, [(i, t, "s") for i, t in rows]), licenses.standard_templates(spark)).collect()
    by = {i: sorted((r.start, r.template_id, round(r.coverage, 2)) for r in got if r.doc_id == i) for i, _ in rows}
    assert by[1] == [(0, "mit/text", 1.0)] and [m[1] for m in by[2]] == ["mit/text"] and 0.8 <= by[2][0][2] < 1
    assert [m[1] for m in by[3]] == ["bsd-3-clause/text"] and by[3][0][2] > 0.98
    assert [m[1] for m in by[4]] == ["mit/notice"]
    assert len(by[5]) == 4000 and {m[1] for m in by[5]} == {"mit/grant-3"}
    assert [m[1:] for m in by[6]] == [("mit/text", 1.0)] * 2


def test_chat_orders_tied_turns_by_text(spark):
    import duckdb
    from ledgerlens.llm.queries import ORACLE

    rows = [(c, t, r, f"{w} {c}") for c in range(4) for t in (None, 1) for r in ("assistant", "user") for w in ("b", "é", "a", "", "Z", "z" * 9000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r) for r in chat.chat_digests(conv.unionByName(chat.probe(spark))).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == {r[0]: r for r in db.execute(ORACLE["op10_chat"]).fetchall()}


def test_quality_learns_from_passages_far_behind(spark):
    plain, bad = "The committee reviewed the careful report and agreed. " * 600, "$$$ CLICK buy buy buy !!! free free " * 600
    docs = docs_frame(spark, [(i, plain + (bad if i % 2 == 0 else plain), "s") for i in range(80)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_quality_gradients_by_steps_are_those_of_the_loss():
    rnd = np.random.default_rng(2)
    bags, sizes = quality.Bags(), (3, 1, 40, 7)
    for n in sizes:
        for i in range(n):
            bags.add(rnd.normal(0, 0.3, quality.FEATURES).astype("<f2").tobytes(), i == 0)
    y, docs, model = np.array([1.0, 0, 1, 0]), np.array([2, 0, 3, 1]), quality.Model.start()
    whole, steps = (model.gradients(bags, docs, y[docs], size) for size in (1000, 5))
    assert all(np.allclose(whole[k], steps[k], atol=1e-6) for k in whole)

    def loss():
        total = 0.0
        for i, d in enumerate(docs):
            x = np.concatenate([x for x, _ in bags.steps(np.array([d]))])
            h, _, _, g = model.passage(x)
            a = np.exp(g - g.max())
            s = float(1 / (1 + np.exp(-(a / a.sum() @ h @ model.weights["c"] + model.weights["b"][0]))))
            total -= np.log(s if y[d] else 1 - s) / len(docs)
        return total

    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    for k, v in model.weights.items():
        at = np.unravel_index(np.argmax(np.abs(whole[k])), v.shape)
        v[at] += 1e-4
        up = loss()
        v[at] -= 2e-4
        assert abs((up - loss()) / 2e-4 - whole[k][at]) < 1e-4 + 0.02 * abs(whole[k][at]), k
        v[at] += 1e-4


def test_pii_terms_of_signatures_rare_entities_and_far_words(spark):
    body = [" ".join(f"{w}{(i * 7 + j) % 20}" for j, w in enumerate("note about weather town river market garden bridge school road".split())) for i in range(90)]
    told = [(i, f"{body[i]} so far Anna Quillborough Head of Surgery anna@clinic.org", "s") for i in range(20)]
    far = [(30 + i, f"Tamsin began {body[30 + i]} and {body[31 + i]} then wrote to far@clinic.org", "s") for i in range(2)]
    copied = [(40, f"Zebedee {body[40]} of copied@clinic.org", "s")] * 5
    other = [(1000 + i, f"then began head of and far to wrote plain{i} {body[50 + i % 40]} {body[i]}", "s") for i in range(90)]
    wide = [(2000 + i, f"other text number{i} {body[i % 90]}", "s") for i in range(2000)]
    out = {r.doc_id: r.text for r in pii.sanitise(docs_frame(spark, told + far + copied + other + wide)).collect()}
    assert all("Quillborough" not in out[i] and "Anna" not in out[i] and "note" in out[i] for i in range(20))
    # twice in two texts is evidence; once (exact copies are one text) is not
    assert all("Tamsin" not in out[30 + i] for i in range(2)) and "Zebedee" in out[40]
    assert all(out[i] == t for i, t, _ in other + wide)


def brute_terms(rows, generalise=0.8, confidence=0.4, z=1.6448536269514722):
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    n, holds, has = len(by_text), {}, {}
    for t in by_text:
        spans = pii.base_spans(t)
        for k, a, b in spans:
            holds.setdefault((k, lower(t[a:b])), set()).add(t)
        for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t):
            if not any(a < m.end() and m.start() < b for _, a, b in spans):
                has.setdefault(lower(m.group()), set()).add(t)
    out = {}
    for texts in holds.values():
        for w, own in has.items():
            both, n_t = texts & own, len(own)
            if not both or len(texts) == n:
                continue
            share, zz = len(both) / n_t, z * z
            low = (share + zz / (2 * n_t) - z * ((share * (1 - share) + zz / (4 * n_t)) / n_t) ** 0.5) / (1 + zz / n_t)
            told = 1 + np.log2(share) / np.log2(n / len(texts))
            if low >= confidence and told >= generalise:
                for t in both:
                    for i in by_text[t]:
                        if i is not None:
                            out[i, w] = max(out.get((i, w), -1), round(float(told), 9))
    return out


def test_pii_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "SALT_CLASSES", 2)
    r = random.Random(9)
    rows = []
    for i in range(400):
        who = r.randrange(12)
        t = " ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(12)))
        if r.random() < 0.4:
            t += f" Name{who} mail u{who}@x.org" + (f" Town{who} u{(who + 1) % 12}@x.org, u{(who + 2) % 12}@x.org +1 234 567 {who:04}" if r.random() < 0.5 else "")
        rows.append((i % 390 if i % 50 else None, t))
    rows += rows[:40] + [(900, None), (901, ""), (902, "only@once.org Alone")]
    docs = docs_frame(spark, [(i, t, "s") for i, t in rows])
    got = {(d.doc_id, w): round(x, 9) for d in pii.document_terms(docs).collect() for w, x in d.terms.items()}
    want = brute_terms(rows)
    assert len(want) > 100 and got == want and not any(w == "alone" for _, w in got)


def test_url_list_with_false_positives_and_a_hot_url(spark):
    urls = ["http://listed.example/a/"] * 300 + [f"https://www.listed.example/p{i}?utm_source=x&k=1#f" for i in range(100)] + ["http://example.net/en/1", "http://w.net/z"]
    listed = spark.createDataFrame([("http://listed.example/a",), ("http://www.example.net/en/1",), (None,)]
                                   + [(f"http://listed.example/p{i}?k=1",) for i in range(0, 100, 2)], "url string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = ["block"] * 300 + ["block", "allow"] * 50 + ["allow", "block"]
    for bits, most in ((12, 32 << 20), (1, 32 << 20), (12, 0)):     # as dealt; many false positives; over the broadcast bound
        got = url_filter.filter_urls(pages, url_filter.rules_frame(spark), listed, bits_per_key=bits, max_filter_bytes=most).collect()
        assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == want
