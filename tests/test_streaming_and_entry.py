import os

from pyspark.sql import functions as F

from ledgerlens.sources.store import read_bucketed
from ledgerlens.streaming.ingest import start_incremental_upsert


def test_incremental_upsert_runs_once_per_file(spark, tmpdir_path):
    landing = os.path.join(tmpdir_path, "landing")
    table = os.path.join(tmpdir_path, "table")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    rows = [(i, f"INV-{i % 3}", "f.pdf", float(i), i) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, invoice_number string, file_name string, amount double, seq long")
    df.coalesce(1).write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    start_incremental_upsert(spark, landing, table, ckpt, schema).awaitTermination()
    got = {r.id: r.amount for r in read_bucketed(spark, table).collect()}
    assert got == {0: 3.0, 1: 4.0, 2: 5.0}

    def files():
        return sorted(os.path.join(d, f) for d, _, fs in os.walk(table) for f in fs if f.endswith(".parquet"))

    before = files()
    # a second run finds no new file and writes nothing
    start_incremental_upsert(spark, landing, table, ckpt, schema).awaitTermination()
    assert files() == before
    # a new file is picked up and upserted
    more = spark.createDataFrame([(9, "INV-0", "f.pdf", 99.0, 9)], df.schema)
    more.write.mode("append").parquet(landing)
    start_incremental_upsert(spark, landing, table, ckpt, schema).awaitTermination()
    got = {r.id: r.amount for r in read_bucketed(spark, table).collect()}
    assert got == {0: 99.0, 1: 4.0, 2: 5.0}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and "qid" in df.columns
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    from ledgerlens.plans.catalog import QUERIES
    assert set(QUERIES) <= set(o)
    assert "semantic_search_text" in o and "semantic_search_prefilter_per_query" in o


INVOICE = """INVOICE
Invoice No: {num}
Date: January 15, 2024
From: ABC Exports Ltd.
To: XYZ Imports Inc.
Total Amount: ${amt} USD
"""


def test_file_ingest_stream(spark, tmpdir_path):
    from ledgerlens.streaming.ingest import start_file_ingest

    landing = os.path.join(tmpdir_path, "in")
    os.makedirs(landing)

    def put(name, num, amt):
        with open(os.path.join(landing, name), "w") as f:
            f.write(INVOICE.format(num=num, amt=amt))

    put("a.txt", "INV-1", "1,000.00")
    put("b.txt", "INV-2", "2,000.00")
    with open(os.path.join(landing, "bad.txt"), "wb") as f:
        f.write(b"\xff\xfe tiny")                       # decode fails, then too short
    table, vecs, ckpt = (os.path.join(tmpdir_path, x) for x in ("t", "v", "c"))

    def decode(b):
        return b.decode("utf-8")

    run = lambda: start_file_ingest(spark, landing, table, vecs, ckpt, [decode], pattern="*.txt",
                                    n_buckets=4).awaitTermination()
    run()
    got = {r.file_name: (r.id, r.invoice_number, r.total_amount) for r in read_bucketed(spark, table).collect()}
    first_ids = {k: v[0] for k, v in got.items()}
    assert sorted(first_ids.values()) == [1, 2]          # dense ids; order inside a batch is free
    assert {k: v[1:] for k, v in got.items()} == {"a.txt": ("INV-1", 1000.0), "b.txt": ("INV-2", 2000.0)}
    assert read_bucketed(spark, vecs).count() == 2
    # a later file: picked up by the next run only, ids continue after the stored maximum
    import time
    time.sleep(1.1)
    put("a2.txt", "INV-9", "5.00")
    os.replace(os.path.join(landing, "a2.txt"), os.path.join(landing, "c.txt"))
    run()
    got = {r.file_name: (r.id, r.invoice_number) for r in read_bucketed(spark, table).collect()}
    assert got == {"a.txt": (first_ids["a.txt"], "INV-1"), "b.txt": (first_ids["b.txt"], "INV-2"),
                   "c.txt": (3, "INV-9")}
    assert read_bucketed(spark, vecs).count() == 3


def _file_rows(spark, rows):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"file:/in/{n}", t, len(c), c.encode()) for n, c in rows],
                                 "path string, modificationTime timestamp, length long, content binary")


def _ingest_state(spark, table, vecs):
    from ledgerlens.sources.changes import ChangeTable

    rec = sorted((r.id, r.invoice_number, r.seller_name, r.total_amount) for r in ChangeTable.open(spark, table).read().collect())
    vec = sorted(r.id for r in ChangeTable.open(spark, vecs).read().collect())
    led = sorted((r.path, r.success) for r in ChangeTable.open(spark, table + "_files").read().collect())
    return rec, vec, led


def test_replays_and_crashes_between_tables_add_nothing_twice(spark, tmpdir_path, monkeypatch):
    from ledgerlens.sources.changes import ChangeTable
    from ledgerlens.streaming.ingest import ingest_files_batch

    table, vecs, calls = (os.path.join(tmpdir_path, x) for x in ("t", "v", "calls"))
    os.makedirs(calls)

    def decode(b):
        import uuid
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write("x")
        return b.decode("utf-8")

    no_number = INVOICE.replace("Invoice No: {num}\n", "")
    batch = _file_rows(spark, [("a.txt", no_number.format(amt="1.00")), ("b.txt", no_number.format(amt="2.00")), ("c.txt", INVOICE.format(num="N-1", amt="3.00")),
                               ("bad.txt", "tiny")])
    run = lambda epoch, b=batch, **kw: ingest_files_batch(b, epoch, [decode], table, vecs, 4, **kw)
    # the job dies before the vectors, then before the ledger, is replayed, and replayed once more after all was written
    real = ChangeTable.put

    def dying(at):
        seen = []

        def put(self, rows, name=None):
            seen.append(1)
            if len(seen) == at:
                raise RuntimeError("executor and driver lost")
            return real(self, rows, name)
        return put

    for at in (2, 3):
        monkeypatch.setattr(ChangeTable, "put", dying(at))
        try:
            run(0)
            raise AssertionError("did not die")
        except RuntimeError:
            pass
    monkeypatch.setattr(ChangeTable, "put", real)
    run(0)
    first = _ingest_state(spark, table, vecs)
    assert [(n, a) for _, n, _, a in first[0]] in ([(None, 1.0), (None, 2.0), ("N-1", 3.0)], *[
        [(None, 1.0), ("N-1", 3.0), (None, 2.0)], [(None, 2.0), (None, 1.0), ("N-1", 3.0)], [(None, 2.0), ("N-1", 3.0), (None, 1.0)],
        [("N-1", 3.0), (None, 1.0), (None, 2.0)], [("N-1", 3.0), (None, 2.0), (None, 1.0)]])
    assert first[1] == [r[0] for r in first[0]] and [s for _, s in first[2]] == [True, True, False, True]
    n_calls = len(os.listdir(calls))
    run(0)                                            # the epoch again
    run(7)                                            # the files under another epoch, as after a lost checkpoint
    assert _ingest_state(spark, table, vecs) == first and len(os.listdir(calls)) == n_calls
    # a changed file is a new file; its record keeps the id, and one codec call is made per new file
    changed = _file_rows(spark, [("c.txt", INVOICE.format(num="N-1", amt="9.00")), ("d.txt", INVOICE.format(num="N-2", amt="4.00"))])
    run(8, changed.withColumn("modificationTime", F.expr("modificationTime + interval 1 day")))
    got = _ingest_state(spark, table, vecs)
    assert len(os.listdir(calls)) == n_calls + 2 and len(got[0]) == 4 and len(got[1]) == 4
    ids = {r[1]: (r[0], r[3]) for r in first[0]}, {r[1]: (r[0], r[3]) for r in got[0]}
    assert ids[1]["N-1"] == (ids[0]["N-1"][0], 9.0)


def _landed(folder, *numbers):
    for i in numbers:
        at = os.path.join(folder, f"d{i}")
        os.makedirs(at, exist_ok=True)
        with open(os.path.join(at, f"{i}.txt"), "w") as f:
            f.write(INVOICE.format(num=f"N-{i}", amt=f"{i}.00"))
        os.utime(os.path.join(at, f"{i}.txt"), (1_700_000_000 - i, 1_700_000_000 - i))         # the last number first


def _stream_files(spark, top, **options):
    from ledgerlens.streaming.ingest import start_file_ingest

    table = os.path.join(top, "t")
    start_file_ingest(spark, os.path.join(top, "in"), table, os.path.join(top, "v"), os.path.join(top, "c"), [lambda b: b.decode()],
                      pattern="*.txt", n_buckets=4, recursive=True, **options).awaitTermination()
    return _ingest_state(spark, table, os.path.join(top, "v"))


def test_a_stream_of_files_keeps_none_on_the_driver(spark, tmpdir_path):
    from ledgerlens.streaming.ingest import list_new_files

    landing, listed = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "c", "listed")
    _landed(landing, *range(1, 13))
    rec, vec, led = _stream_files(spark, tmpdir_path, files_per_batch=5)
    assert [n for _, n, _, _ in sorted(rec, key=lambda r: r[1])] == sorted(f"N-{i}" for i in range(1, 13)) and vec == [r[0] for r in rec] and len(led) == 12
    # three batches of at most five, the oldest files first
    batches = [n for n in os.listdir(os.path.join(tmpdir_path, "t_files", "batches")) if not n.startswith(".")]
    assert sorted(batches) == ["files-0", "files-1", "files-2"]
    assert [{n for i, n, _, _ in rec if lo < i <= lo + 5} for lo in (0, 5, 10)] == [{f"N-{i}" for i in r} for r in (range(8, 13), range(3, 8), (1, 2))]
    # Spark's log of the stream, which the driver holds whole, names listings and no document
    log = "".join(open(os.path.join(p, f), errors="replace").read() for p, _, names in os.walk(os.path.join(tmpdir_path, "c", "sources")) for f in names
                  if not f.startswith("."))
    assert ".parquet" in log and ".txt" not in log
    # nothing new; then a file that only a call that died has listed, one listed and gone, and one that no one has
    assert _stream_files(spark, tmpdir_path, files_per_batch=5) == (rec, vec, led)
    _landed(landing, 13, 14)
    list_new_files(spark, landing, "*.txt", True, listed, 5)
    os.remove(os.path.join(landing, "d14", "14.txt"))
    _landed(landing, 15)
    got = _stream_files(spark, tmpdir_path, files_per_batch=5)
    assert {r[1] for r in got[0]} - {r[1] for r in rec} == {"N-13", "N-15"} and set(rec) < set(got[0]) and len(got[1]) == len(got[2]) == 14


def test_a_checkpoint_of_sparks_own_file_stream_goes_on(spark, tmpdir_path, monkeypatch):
    from ledgerlens.streaming import ingest

    _landed(os.path.join(tmpdir_path, "in"), 1, 2)
    with monkeypatch.context() as m:
        m.setattr(ingest, "task_folder", lambda *_: None)
        first = _stream_files(spark, tmpdir_path)
    _landed(os.path.join(tmpdir_path, "in"), 3)
    got = _stream_files(spark, tmpdir_path)
    assert len(first[0]) == 2 and {r[1] for r in got[0]} == {"N-1", "N-2", "N-3"} and set(first[0]) < set(got[0]) and len(got[2]) == 3
    assert not os.path.exists(os.path.join(tmpdir_path, "c", "listed"))


def test_stream_with_a_model_in_place_of_the_rules(spark, tmpdir_path):
    from ledgerlens.operators.extraction import model_extractor
    from ledgerlens.sources.changes import ChangeTable
    from ledgerlens.streaming.ingest import ingest_files_batch

    def ask(prompts):
        import json
        return ["nothing" if "skip me" in p else json.dumps({"invoice_number": "M-1", "seller_name": "S", "total_amount": "$5", "po": {"n": 7}}) for p in prompts]

    table, vecs = (os.path.join(tmpdir_path, x) for x in ("t", "v"))
    batch = _file_rows(spark, [("a.txt", "a long enough document"), ("b.txt", "skip me, a long enough document")])
    ingest_files_batch(batch, 0, [lambda b: b.decode()], table, vecs, 4, extractor=model_extractor(ask))
    r = ChangeTable.open(spark, table).read().collect()
    assert [(x.invoice_number, x.total_amount, x.extras) for x in r] == [("M-1", 5.0, {"po": '{"n":7}'})]
    led = {x.path: (x.success, x.errors) for x in ChangeTable.open(spark, table + "_files").read().collect()}
    assert led["file:/in/b.txt"] == (False, ["no valid JSON in reply: nothing"])


def test_file_texts_runs_later_codecs_only_when_needed(spark):
    from ledgerlens.streaming.ingest import file_texts

    files = spark.createDataFrame([("/x/long.pdf", b"L" * 60), ("/x/short.pdf", b"s")],
                                  "path string, content binary")

    def first(b):
        return b.decode()

    def second(b):
        return "second:" + b.decode()

    def third(b):
        raise RuntimeError("ocr down")

    got = {r.file_name: (r.text_1, r.text_2, r.text_3) for r in file_texts(files, [first, second, third]).collect()}
    assert got["long.pdf"] == ("L" * 60, None, None)
    assert got["short.pdf"] == ("s", "second:s", None)
