import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dml
from ledgerlens.schema import INVOICE_SCHEMA
from ledgerlens.sources import store
from ledgerlens.sources.files import file_name_from_path, scan_directory, write_text_files


def records(spark, n=3, start=1):
    rows = [(i, f"INV-{i}", "2024-01-15", "S", "B", float(i), "USD", f"doc_{i}.pdf", f"2024-01-15T00000{i}",
             "raw", "pymupdf", 1, str(i), {"note": "x"}) for i in range(start, start + n)]
    return spark.createDataFrame(rows, INVOICE_SCHEMA)


def test_json_roundtrip_and_array_file(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "j")
    store.write_json(records(spark), p)
    store.write_json(records(spark, 2, 10), p)          # append
    back = store.read_json(spark, p)
    assert back.count() == 5
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in INVOICE_SCHEMA]
    arr = os.path.join(tmpdir_path, "arr.json")
    with open(arr, "w") as f:
        json.dump([{"id": 1, "invoice_number": "A"}, {"id": 2}], f)
    one = os.path.join(tmpdir_path, "one.json")
    with open(one, "w") as f:
        json.dump({"id": 7, "invoice_number": "B"}, f)
    assert store.read_json(spark, arr, multiline=True).count() == 2
    assert store.read_json(spark, one, multiline=True).first().invoice_number == "B"


def test_json_files_of_any_form_in_one_folder(spark, tmpdir_path):
    schema = "id long, a string"
    texts = {"lines.json": '\n  \n{"id": 1, "a": "x"}\n{"id": 2}\n', "array.json": '[{"id": 3},\n {"id": 4, "a": "]"}]', "flat.json": '[{"id": 5}, {"id": 6}]',
             "one.json": '{\n "id": 7,\n "a": "{}"\n}', "line.json": '{"id": 8}', "blank.json": " \n", "empty.json": "", "none.json": "[]"}
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    for name, t in texts.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(t)
    with open(os.path.join(tmpdir_path, "sub", "deep.json"), "w") as f:
        f.write('{"id": 9}')
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    got = store.read_json_files(spark, tmpdir_path, st)
    assert sorted((r.id, r.a) for r in got.collect()) == [(1, "x"), (2, None), (3, None), (4, "]"), (5, None), (6, None), (7, "{}"), (8, None)]
    assert store.read_json_files(spark, tmpdir_path, st, recursive=True).count() == 9
    assert store.read_json_files(spark, tmpdir_path + "/nothing", st).count() == 0


def test_two_writers_of_versions_take_two_numbers(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "w")
    files = store._Files(spark, root)
    assert files.create(f"{root}/claims/v00000001", "")          # another writer is at work on version 1
    assert store.write_table_version(records(spark), root) == 2
    assert not files.create(f"{root}/claims/v00000002", "")


def test_missing_store_is_empty_and_format_checked(spark, tmpdir_path):
    assert store.read_json(spark, os.path.join(tmpdir_path, "nope")).count() == 0
    assert store.read_csv(spark, os.path.join(tmpdir_path, "nope"), INVOICE_SCHEMA).count() == 0
    with pytest.raises(ValueError):
        store.check_format("xml")


def test_csv_roundtrip_flattens(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c")
    df = records(spark).select("id", "invoice_number", F.struct(F.lit("a").alias("b")).alias("n"), "extras")
    store.write_csv(df, p)
    back = store.read_csv(spark, p, store.csv_safe(df).schema)
    assert back.columns == ["id", "invoice_number", "n_b", "extras"]
    assert back.orderBy("id").first().extras == '{"note":"x"}'


def test_versioned_table_and_save(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "t")
    batch = records(spark).withColumn("seq", F.col("id"))
    out = store.save(batch, root, formats=["json", "csv", "db"], upsert_fn=dml.upsert_into)
    assert out["db"]["version"] == 1 and out["json"]["rows"] == 3
    out2 = store.save(batch, root, formats=["db"], upsert_fn=dml.upsert_into)   # same keys again
    assert out2["db"]["version"] == 2
    assert store.read_table_version(spark, f"{root}/invoices_table").count() == 3
    assert store.read_table_version(spark, f"{root}/invoices_table", version=1).count() == 3
    with pytest.raises(ValueError):
        store.save(batch, root, formats=["xml"])


def test_newest_first(spark):
    df = records(spark, 3)
    assert [r.id for r in store.load_newest_first(df).collect()] == [3, 2, 1]


def test_scan_directory_glob(spark, tmpdir_path):
    for name in ["a.pdf", "b.PDF", "c.txt"]:
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(b"%PDF-1.4 x")
    os.makedirs(os.path.join(tmpdir_path, "sub"))
    with open(os.path.join(tmpdir_path, "sub", "d.pdf"), "wb") as f:
        f.write(b"x")
    got = sorted(r.file_name for r in scan_directory(spark, tmpdir_path).collect())
    assert got == ["a.pdf"]            # non-recursive, case-sensitive
    got = sorted(r.file_name for r in scan_directory(spark, tmpdir_path, recursive=True).collect())
    assert got == ["a.pdf", "d.pdf"]


def test_text_files_are_dealt_to_tasks_and_listed_by_few(spark, tmpdir_path):
    df = spark.range(40).selectExpr("id % 30 AS k", "concat('t', id) AS value").coalesce(1)
    path = write_text_files(df, "k", os.path.join(tmpdir_path, "out"))
    rows = scan_directory(spark, path, "*.txt", recursive=True).collect()
    got = {int(r.path.split("/k=")[1].split("/")[0]): sorted(bytes(r.content).decode().split()) for r in rows}
    assert len(rows) == 30 and got == {k: sorted(f"t{i}" for i in range(40) if i % 30 == k) for k in range(30)}
    assert len({r.file_name.split("-")[1] for r in rows}) > 1          # written by several tasks, though one held all rows
    most = 8 * spark.sparkContext.defaultParallelism
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= most


def test_tasks_list_and_read_what_sparks_source_reads(spark, tmpdir_path, monkeypatch):
    from ledgerlens.sources import files

    names = ["a.pdf", "b.PDF", "c.txt", "_h.pdf", "_k=1.pdf", ".x.pdf", "e{1}.pdf", "sp ace%20#\u00e9.pdf", "empty.pdf", "q.pdf._COPYING_"]
    for sub in ["", "sub", "sub/deep er", "_hid", "_hid=2", ".dot", "k=1"]:
        os.makedirs(os.path.join(tmpdir_path, sub), exist_ok=True)
        for name in names:
            with open(os.path.join(tmpdir_path, sub, name), "wb") as f:
                f.write(b"" if name == "empty.pdf" else (sub + name).encode() * 3)
    os.symlink("/nowhere", os.path.join(tmpdir_path, "dead.pdf"))
    os.symlink(os.path.join(tmpdir_path, "sub"), os.path.join(tmpdir_path, "link"))
    monkeypatch.setattr(files, "CONTENT_BYTES", 40)                  # several batches of contents to one of paths
    cols = ["path", "modificationTime", "length", "content"]
    for pattern in ["*.pdf", "{a,b}.*", "[a-c].???", "e\\{1\\}.pdf", "*"]:
        want = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(tmpdir_path)
        got = scan_directory(spark, tmpdir_path, pattern, recursive=True)
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) != []
    flat = os.path.join(tmpdir_path, "sub", "deep er")
    assert sorted(r.path for r in scan_directory(spark, flat).collect()) == sorted(
        r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(flat).collect())
    # the driver's plan holds no document, neither of the folder tree nor of the flat folder
    assert not [p for df in (got, scan_directory(spark, flat)) for p in df.inputFiles() if "ledgerlens-scratch" not in p]


def test_text_files_are_those_of_sparks_writer(spark, tmpdir_path):
    df = spark.createDataFrame([("a b", "1"), ("a b", "2"), ("p/q:%=\u00e9", "x\ny"), (None, "n"), ("z", None)], "k string, v string")
    ours, theirs = (os.path.join(tmpdir_path, x) for x in ("ours", "theirs"))
    write_text_files(df, "k", f"file://{ours}")
    df.repartition(4, "k").write.partitionBy("k").text(theirs)

    def tree(top):
        return {os.path.relpath(p, top): [sorted(open(os.path.join(p, f), "rb").read().split(b"\n")) for f in names if f.endswith(".txt")]
                for p, _, names in os.walk(top) if p != top}

    assert tree(ours) == tree(theirs) and len(tree(ours)) == 4
    # no checksum beside a file: Hadoop's local file system, which writes these, starts processes for every file and folder
    assert not [f for _, _, names in os.walk(ours) for f in names if f.endswith(".crc")]


def test_file_name_from_path(spark):
    df = spark.createDataFrame([("https://x.org/a/b/page.html?q=1",), ("/tmp/f.pdf",)], "p string")
    assert [r[0] for r in df.select(file_name_from_path("p")).collect()] == ["page.html", "f.pdf"]


def test_stamp_ingestion_one_value_per_batch(spark):
    df = spark.range(50).withColumn("extracted_at", F.when(F.col("id") == 0, F.lit("2020-01-01T00")))
    out = store.stamp_ingestion(df)
    vals = {r.extracted_at for r in out.collect()}
    assert "2020-01-01T00" in vals and len(vals) == 2
    assert store.stamp_ingestion(spark.range(3)).select("extracted_at").distinct().count() == 1


def test_single_file_export(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "x")
    store.write_csv(spark.range(100).repartition(4), p, append=False, single_file=True)
    assert len([f for f in os.listdir(p) if f.endswith(".csv")]) == 1


def test_uncommitted_version_is_ignored(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "v")
    assert store.write_table_version(records(spark), root) == 1
    os.makedirs(os.path.join(root, "v00000002", "_temporary"))      # a job died here
    assert store.latest_version(spark, root) == 1
    assert store.write_table_version(records(spark, 5), root) == 2
    assert store.read_table_version(spark, root).count() == 5


def test_save_bucketed_layout(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "sb")
    batch = records(spark, 6).withColumn("seq", F.col("id"))
    out = store.save(batch, root, formats=["db"], upsert_fn=dml.upsert_into,
                     bucketed_key=dml.UPSERT_KEY, n_buckets=4)
    assert out["db"]["rows"] == 6 and out["db"]["change"] == 1
    again = records(spark, 1, start=2).withColumn("seq", F.lit(99)).withColumn("total_amount", F.lit(-1.0))
    store.save(again, root, formats=["db"], upsert_fn=dml.upsert_into, bucketed_key=dml.UPSERT_KEY, n_buckets=4)
    got = {r.id: r.total_amount for r in store.read_bucketed(spark, out["db"]["path"]).collect()}
    assert len(got) == 6 and got[2] == -1.0


def test_csv_keeps_line_breaks_blanks_and_quotes(spark, tmpdir_path):
    rows = [(1, 'line1\nline2, "quoted"'), (2, " 12.5 "), (3, "a\\b"), (4, None)]
    df = spark.createDataFrame(rows, "id long, raw_text string")
    path = store.write_csv(df, tmpdir_path + "/csv")
    assert sorted(map(tuple, store.read_csv(spark, path, df.schema).collect())) == rows


def test_scratch_tables_can_be_cleared(spark):
    from ledgerlens.session import clear_scratch, scratch_path, written

    kept = written(spark, spark.range(5), "five")
    assert kept.count() == 5
    folder = os.path.dirname(scratch_path(spark, "x").rsplit("/", 1)[0])
    assert os.listdir(folder) and clear_scratch(spark) and not os.path.exists(folder)


def test_one_csv_file_is_written_by_all_tasks_and_read_in_splits(spark, tmpdir_path):
    df = spark.range(3000).repartitionByRange(4, "id").selectExpr("id", "concat('a, \"b\" ', id) AS t", "if(id % 3 = 0, null, 'x') AS u")
    path = tmpdir_path + "/csv"
    for append in (True, True, False):
        store.write_csv(df, path, append=append, single_file=True)
        files = [f for f in os.listdir(path) if f.endswith(".csv")]
        if append:
            continue
        assert len(files) == 1 and os.path.exists(path + "/_SUCCESS") and not any(f.startswith("_one") for f in os.listdir(path))
        with open(f"{path}/{files[0]}") as f:
            lines = f.read().splitlines()
        assert lines[0] == "id,t,u" and [int(x.split(",")[0]) for x in lines[1:]] == list(range(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = store.read_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 1
        assert sorted(back.collect(), key=lambda r: r.id) == df.collect()
        store.write_csv(spark.createDataFrame([(-1, "line\nbreak", "q\"\n\"")], df.schema), path, single_file=True)
        assert sorted(store.read_csv(spark, path, df.schema).collect(), key=lambda r: r.id)[0] == (-1, "line\nbreak", "q\"\n\"")
        assert store.read_csv(spark, path, df.schema).count() == 3001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_csv_file_has_a_header(spark, tmpdir_path):
    path = store.write_csv(spark.range(0), tmpdir_path + "/csv", single_file=True)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1 and store.read_csv(spark, path, spark.range(0).schema).count() == 0
