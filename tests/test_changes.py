"""Change tables: batches that only add, replays, crashes, deletes and compaction."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.dml import UPSERT_KEY
from ledgerlens.sources.changes import CLEAR_PHRASE, ChangeTable, delete_everything, delete_records

ROW = "id long, invoice_number string, file_name string, amount double, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def make(spark, root, buckets=4):
    return ChangeTable.create(spark, root, frame(spark, []).schema, UPSERT_KEY, buckets=buckets)


def state(table):
    return {r.id: (r.invoice_number, r.amount) for r in table.read().collect()}


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_batch_adds_its_own_rows_and_touches_no_file(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "t")
    table = make(spark, root)
    assert state(table) == {}
    assert table.put(frame(spark, [(i, f"INV-{i}", "f", float(i), i) for i in range(40)])) == 1
    before = files(root)
    assert table.put(frame(spark, [(90, "INV-3", "f", -3.0, 100), (91, None, "f", 1.0, 101), (92, None, "f", 2.0, 102)])) == 2
    after = files(root)
    assert all(after[k] == t for k, t in before.items())
    added = spark.read.parquet(*[os.path.dirname(k) for k in after if k not in before])
    assert added.count() == 3
    got = state(table)
    assert len(got) == 42 and got[3] == ("INV-3", -3.0) and got[91] == (None, 1.0) and got[92] == (None, 2.0)


def test_bucket_count_is_stored_and_checked(spark, tmpdir_path):
    table = make(spark, tmpdir_path + "/t", 8)
    table.put(frame(spark, [(i, f"INV-{i % 40}", "f", float(i), i) for i in range(80)]))
    with pytest.raises(ValueError, match="buckets"):
        make(spark, tmpdir_path + "/t", 64)
    again = ChangeTable.open(spark, tmpdir_path + "/t")
    assert again.buckets == 8
    again.put(frame(spark, [(100 + i, f"INV-{i}", "f", -1.0, 1000) for i in range(40)]))
    assert len(state(again)) == 40 and {v for _, v in state(again).values()} == {-1.0}
    with pytest.raises(ValueError, match="unknown"):
        again.put(frame(spark, []).withColumn("other", F.lit(1)))


def test_a_replayed_batch_is_skipped_and_a_dead_one_done_over(spark, tmpdir_path):
    root = tmpdir_path + "/t"
    table = make(spark, root)
    rows = frame(spark, [(1, None, "f", 1.0, 1), (2, "A", "f", 2.0, 2)])
    assert table.put(rows, "s-0") == 1 and table.put(rows, "s-0") is None and table.applied("s-0")
    # the next job dies while it writes: no marker of success
    assert table.put(frame(spark, [(3, None, "f", 3.0, 3)]), "s-1") == 2
    os.remove(f"{root}/changes/c00000002-put-s-1/_SUCCESS")
    assert set(state(table)) == {1, 2} and not table.applied("s-1")
    assert table.put(frame(spark, [(5, "B", "f", 5.0, 5)]), "s-2") == 3
    assert table.compact() == 1                      # no further than the open number
    assert set(state(table)) == {1, 2, 5}
    assert table.put(frame(spark, [(3, None, "f", 3.0, 3)]), "s-1") == 2
    assert set(state(table)) == {1, 2, 3, 5}
    assert table.compact() == 3 and set(state(table)) == {1, 2, 3, 5}
    table.vacuum()
    assert set(state(table)) == {1, 2, 3, 5} and not os.listdir(f"{root}/changes")
    assert table.put(rows, "s-0") is None            # still known after its folder went
    assert table.next_id() == 6


def test_a_number_that_never_comes_is_released(spark, tmpdir_path):
    table = make(spark, tmpdir_path + "/t")
    table._claim("gone")
    table.put(frame(spark, [(1, "A", "f", 1.0, 1)]))
    assert table.compact() == 0
    table.release(1)
    assert table.compact() == 2 and state(table) == {1: ("A", 1.0)}


def test_two_writers_never_share_a_number(spark, tmpdir_path):
    a, b = make(spark, tmpdir_path + "/t"), ChangeTable.open(spark, tmpdir_path + "/t")
    assert a._claim("x") == (1, False) and b._claim("y") == (2, False) and b._claim("x") == (1, False)


def test_a_dying_compaction_loses_nothing(spark, tmpdir_path):
    root = tmpdir_path + "/t"
    table = make(spark, root)
    table.put(frame(spark, [(1, "A", "f", 1.0, 1)]))
    table.put(frame(spark, [(2, "B", "f", 2.0, 2)]))
    table.compact()
    os.remove(f"{root}/base/v00000002/_SUCCESS")
    assert set(state(table)) == {1, 2}
    assert table.compact() == 2 and set(state(table)) == {1, 2}


def test_deletes_reach_records_and_vectors_and_end_at_compaction(spark, tmpdir_path):
    table = make(spark, tmpdir_path + "/t")
    vecs = ChangeTable.create(spark, tmpdir_path + "/v", spark.createDataFrame([], "id long, embedding array<float>").schema, ["id"], buckets=2)
    table.put(frame(spark, [(1, "A", "f", 1.0, 1), (2, None, "f", 2.0, 2), (3, None, "f", 3.0, 3), (4, "A", "f", 4.0, 4), (5, "C", "f", 5.0, 5)]))
    vecs.put(spark.createDataFrame([(i, [float(i)]) for i in (1, 2, 3, 5)], "id long, embedding array<float>"))
    ids = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    assert delete_records(table, vecs, ids, "d") == 2
    assert delete_records(table, vecs, ids, "d") == 2          # the same delete again
    assert set(state(table)) == {3, 5} and {r.id for r in vecs.read().collect()} == {3, 5}
    # a later write of a deleted key is a new record, with its own id
    table.put(frame(spark, [(7, "A", "f", 7.0, 0), (8, "C", "f", 8.0, 9)]))
    assert state(table) == {3: (None, 3.0), 5: ("C", 8.0), 7: ("A", 7.0)}
    table.compact()
    table.vacuum()
    assert state(table) == {3: (None, 3.0), 5: ("C", 8.0), 7: ("A", 7.0)}
    with pytest.raises(ValueError):
        delete_everything(table, vecs)
    assert delete_everything(table, vecs, confirm=CLEAR_PHRASE) == 3
    assert state(table) == {} and vecs.read().count() == 0
    table.put(frame(spark, [(9, "C", "f", 1.0, 0)]))
    assert state(table) == {9: ("C", 1.0)} and table.compact() == 5 and state(table) == {9: ("C", 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_plain_model(spark, tmpdir_path, seed):
    r = random.Random(seed)
    table = make(spark, tmpdir_path + "/t", 3)
    model, next_id, seq = {}, 1, 0            # key or own id -> [id, amount, seq]
    for step in range(14):
        do = r.choice(["put", "put", "put", "delete", "compact", "clear" if step % 5 == 4 else "vacuum"])
        if do == "put":
            rows = []
            for _ in range(r.randrange(1, 6)):
                number = r.choice([None, "A", "B", "C", "D"])
                seq += 1
                rows.append((next_id, number, "f", float(seq), r.choice([seq, seq * 1000])))
                next_id += 1
            table.put(frame(spark, rows))
            for i, number, _, amount, s in rows:
                old = model.get(number or i)
                model[number or i] = [old[0] if old else i, *((amount, s) if not old or s > old[2] else old[1:])]
        elif do == "delete":
            gone = [v[0] for v in model.values() if r.random() < 0.4]
            assert table.delete(spark.createDataFrame([(i,) for i in [*gone, -1]], "id long")) == len(gone)
            model = {k: v for k, v in model.items() if v[0] not in gone}
        elif do == "clear":
            assert table.clear(confirm=CLEAR_PHRASE) == len(model)
            model = {}
        else:
            getattr(table, do)()
        assert {i: a for i, (_, a) in state(table).items()} == {v[0]: v[1] for v in model.values()}


def test_plans_read_few_columns_and_add_no_sort_aggregate(spark, tmpdir_path):
    table = make(spark, tmpdir_path + "/t")
    table.put(frame(spark, [(1, "A", "f", 1.0, 1), (2, "B", "f", 2.0, 2)]))
    table.delete(spark.createDataFrame([(2,)], "id long"))
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    scans = [x for x in table.read()._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]]
    assert sorted("amount" in x.split("\n")[0] for x in scans if "_print" in x.split("\n")[0]) == [False, True]    # winners first, narrowly
    narrow = table._identities()._jdf.queryExecution().executedPlan().toString()
    assert "amount" not in narrow
