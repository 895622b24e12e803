"""Keyed tables whose changes are only ever added.

A batch of rows, of deletes or a clearing is a folder of its own under ``changes``, numbered in the order of the batches; no file
is rewritten, and none is changed while it is read. Reading puts the newest compacted base and the later changes together: rows
that a later delete of their key names are left out by an anti join, and the last write of each key is
found by the two-phase aggregate of ``dml.latest``. ``compact`` writes that state as the next base and so takes the deletes out.

    table.json             key, id column, bucket count and schema, written once and checked by every writer
    claims/c00000007       number 7 is taken, by the batch named in the file
    batches/<batch>        the number of a batch
    changes/c00000007-put-<batch>/    rows with their bucket; counts once its ``_SUCCESS`` is there
    base/v00000005/        the state after change 5, partitioned by bucket; likewise

Numbers are claimed by creating a file that must not exist, so two writers never share one. A batch has a name (a stream's
name and epoch, say): given again, it is skipped if it was committed, and overwrites its own uncommitted folder if it was not. A job that dies
leaves no readable trace, and compaction goes no further than the first number still open (``release`` closes
one that will never come).
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.dml import fingerprint, next_id, upsert

BUCKET_COL = "_bucket"
NUMBER_COL = "_n"
SOLO_COL = "_solo"
PRINT_COL = "_print"
SEQ_COL = "seq"
DEFAULT_BUCKETS = 256
CLEAR_PHRASE = "DELETE ALL"
_CHANGE = re.compile(r"^c(\d{8})-(put|del|clear)-(.+)$")
_BASE = re.compile(r"^v(\d{8})$")
_CLAIM = re.compile(r"^c(\d{8})$")


def bucket_of(key: list[str], id_col: str = "id", n_buckets: int = DEFAULT_BUCKETS) -> Column:
    """Stable bucket of a record: hash of its key, or of its id when a key
    part is null (such a record only ever matches itself)."""
    return F.pmod(F.when(_any_null(key), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64(*key)), F.lit(n_buckets)).cast("int")


def _any_null(key: list[str]) -> Column:
    out = F.lit(False)
    for k in key:
        out = out | F.col(k).isNull()
    return out


class _Files:
    """The few file operations a table needs, on whatever file system holds it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return bool(self.fs.exists(self.path(path)))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(path))] if self.exists(path) else []

    def create(self, path: str, text: str) -> bool:
        """Write a small file; False where there is one already."""
        try:
            out = self.fs.create(self.path(path), False)
        except Exception:  # noqa: BLE001 - the file system's own kind of "exists"
            if self.exists(path):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def path_exists(spark: SparkSession, path: str) -> bool:
    return _Files(spark, path).exists(path)


class ChangeTable:
    """One table; make it with ``create`` or ``open``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)
        if not self.files.exists(f"{self.root}/table.json"):
            raise FileNotFoundError(root)
        about = json.loads(self.files.text(f"{self.root}/table.json"))
        self.key, self.id_col, self.buckets = about["key"], about["id"], about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> ChangeTable:
        return cls(spark, root)

    @classmethod
    def exists(cls, spark: SparkSession, root: str) -> bool:
        return _Files(spark, root).exists(f"{root.rstrip('/')}/table.json")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, key: list[str], id_col: str = "id",
               buckets: int | None = None) -> ChangeTable:
        """The table at ``root``, made where there is none. Another key, id column or bucket count than the stored ones raises."""
        if not cls.exists(spark, root):
            fields = [f for f in schema.fields if f.name not in (BUCKET_COL, NUMBER_COL, SOLO_COL, PRINT_COL)]
            if SEQ_COL not in schema.fieldNames():
                fields.append(T.StructField(SEQ_COL, T.LongType()))
            about = {"key": list(key), "id": id_col, "buckets": buckets or DEFAULT_BUCKETS,
                     "schema": T.StructType([T.StructField(f.name, f.dataType) for f in fields]).jsonValue()}
            _Files(spark, root).create(f"{root.rstrip('/')}/table.json", json.dumps(about))
        out = cls(spark, root)
        given = (list(key), id_col, buckets or out.buckets)
        if given != (out.key, out.id_col, out.buckets):
            raise ValueError(f"table {root} has key, id and buckets {(out.key, out.id_col, out.buckets)}, not {given}")
        return out

    # ------------------------------------------------------------ numbers

    def _base(self) -> int:
        """Number of the newest committed base; 0 without one."""
        found = sorted((int(m.group(1)) for n in self.files.names(f"{self.root}/base") if (m := _BASE.match(n))), reverse=True)
        return next((v for v in found if self.files.exists(f"{self.root}/base/v{v:08d}/_SUCCESS")), 0)

    def _changes(self, after: int) -> list[tuple[int, str, str]]:
        """Number, kind and folder of the committed changes after a number, in order."""
        found = sorted((int(m.group(1)), m.group(2), f"{self.root}/changes/{n}")
                       for n in self.files.names(f"{self.root}/changes") if (m := _CHANGE.match(n)))
        return [c for c in found if c[0] > after and self.files.exists(f"{c[2]}/_SUCCESS")]

    def _claimed(self) -> list[int]:
        return sorted(int(m.group(1)) for n in self.files.names(f"{self.root}/claims") if (m := _CLAIM.match(n)))

    def _claim(self, batch: str) -> tuple[int, bool]:
        """Number of the batch, and whether it was committed before."""
        marker = f"{self.root}/batches/{batch}"
        if self.files.exists(marker):
            n = int(self.files.text(marker) or 0)
            done = n <= self._base() or any(c[0] == n for c in self._changes(n - 1))
            return n, done
        n = max([self._base(), *self._claimed()], default=0) + 1
        while not self.files.create(f"{self.root}/claims/c{n:08d}", batch):
            n += 1
        self.files.create(marker, str(n))
        return n, False

    def applied(self, batch: str) -> bool:
        marker = f"{self.root}/batches/{_name(batch)}"
        return self.files.exists(marker) and self._claim(_name(batch))[1]

    def _commit(self, rows: DataFrame, n: int, kind: str, batch: str) -> str:
        path = f"{self.root}/changes/c{n:08d}-{kind}-{batch}"
        rows.write.mode("overwrite").parquet(path)      # a folder of this name can only be this batch's uncommitted one
        return path

    # ------------------------------------------------------------ writing

    def put(self, rows: DataFrame, batch: str | None = None) -> int | None:
        """Add a batch; only its own rows are written, evaluated once. Returns its number, None if it was there already.

        Missing columns become null; a missing ``seq`` is the batch's number.
        """
        batch = _name(batch)
        extra = [c for c in rows.columns if c not in self.schema.fieldNames()]
        if extra:
            raise ValueError(f"columns unknown to table {self.root}: {extra}")
        n, done = self._claim(batch)
        if done:
            return None
        cols = []
        for f in self.schema.fields:
            absent = F.lit(n if f.name == SEQ_COL else None)
            cols.append((F.col(f"`{f.name}`") if f.name in rows.columns else absent).cast(f.dataType).alias(f.name))
        out = self._marked(rows.select(*cols), n)
        # in bucket order, so that a read of few buckets skips row groups
        self._commit(out.hint("rebalance").sortWithinPartitions(BUCKET_COL), n, "put", batch)
        return n

    def delete(self, ids: DataFrame, batch: str | None = None) -> int:
        """Delete the records with the listed ids; returns how many there were.

        The delete names their keys, which are read without any other column. A later write of such a key is a new record.
        """
        batch = _name(batch)
        n, done = self._claim(batch)
        if not done:
            listed = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
            gone = self._identities().join(listed, self.id_col, "left_semi").withColumn(NUMBER_COL, F.lit(n).cast("long"))
            self._commit(gone.select(*self._deletes().fieldNames()), n, "del", batch)
        return self.spark.read.schema(self._deletes()).parquet(f"{self.root}/changes/c{n:08d}-del-{batch}").count()

    def clear(self, confirm: str | None = None, batch: str | None = None) -> int:
        """Delete every record; the confirmation text must match. Returns how many there were."""
        if confirm != CLEAR_PHRASE:
            raise ValueError(f"clearing a table needs confirm={CLEAR_PHRASE!r}")
        batch = _name(batch)
        n, done = self._claim(batch)
        if done:
            return 0
        rows = self._identities().count()
        self._commit(self.spark.createDataFrame([], self.schema), n, "clear", batch)
        return rows

    def release(self, n: int) -> None:
        """Close a number whose batch will never be committed."""
        batch = self.files.text(f"{self.root}/claims/c{n:08d}")
        if not any(c[0] == n for c in self._changes(n - 1)):
            self._commit(self.spark.createDataFrame([], self._stored()), n, "put", batch)

    def compact(self) -> int:
        """Write the state up to the last number without an open one before it as the next base; returns its number."""
        base = self._base()
        done = {c[0] for c in self._changes(base)}
        n = base
        for claim in self._claimed():
            if claim > base:
                if claim not in done:
                    break
                n = claim
        if n > base:
            out = self._marked(self.read(upto=n), n)
            out.hint("rebalance", BUCKET_COL).write.mode("overwrite").partitionBy(BUCKET_COL).parquet(f"{self.root}/base/v{n:08d}")
        return n

    def vacuum(self) -> None:
        """Remove bases, changes and claims that the newest base replaces. No reader may be at work on them."""
        base = self._base()
        for folder, pattern in (("base", _BASE), ("changes", _CHANGE), ("claims", _CLAIM)):
            for name in self.files.names(f"{self.root}/{folder}"):
                m = pattern.match(name)
                if m and int(m.group(1)) <= base and not (folder == "base" and int(m.group(1)) == base):
                    self.files.remove(f"{self.root}/{folder}/{name}")

    # ------------------------------------------------------------ reading

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(BUCKET_COL, T.IntegerType()), T.StructField(NUMBER_COL, T.LongType()),
                             T.StructField(PRINT_COL, T.LongType())])

    def _marked(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows as they are stored: with bucket, number, and the fingerprint by which a read finds winners without their other columns."""
        others = [c for c in self.schema.fieldNames() if c not in (*self.key, self.id_col)]
        return rows.withColumns({BUCKET_COL: bucket_of(self.key, self.id_col, self.buckets), NUMBER_COL: F.lit(n).cast("long"),
                                 PRINT_COL: fingerprint(rows, others)})

    def _deletes(self) -> T.StructType:
        by = list(dict.fromkeys([*self.key, self.id_col]))
        return T.StructType([*(T.StructField(c, self.schema[c].dataType) for c in by), T.StructField(SOLO_COL, self.schema[self.id_col].dataType),
                             T.StructField(NUMBER_COL, T.LongType())])

    def _written(self, paths: list[str], base: int) -> DataFrame:
        """Rows of put folders and, where it is not 0, of a base."""
        schema = self._stored()
        parts = [self.spark.read.schema(schema).parquet(*paths)] if paths else []
        if base:
            parts.append(self.spark.read.schema(schema).parquet(f"{self.root}/base/v{base:08d}").select(*schema.fieldNames()))
        if not parts:
            return self.spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    def _alive(self, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows written and not deleted since, with the id of rows whose key has a null part in ``_solo``."""
        base = self._base()
        changes = [c for c in self._changes(base) if upto is None or c[0] <= upto]
        cleared = max((c[0] for c in changes if c[1] == "clear"), default=0)
        put = [c[2] for c in changes if c[1] == "put" and c[0] > cleared]
        gone = [c[2] for c in changes if c[1] == "del" and c[0] > cleared]
        rows = self._written(put, base if base > cleared else 0)
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET_COL).isin(buckets))
        rows = rows.withColumn(SOLO_COL, F.when(_any_null(self.key), F.col(self.id_col)))
        if gone:
            by = list(dict.fromkeys([*self.key, SOLO_COL]))
            dead = self.spark.read.schema(self._deletes()).parquet(*gone).groupBy(*by).agg(F.max(NUMBER_COL).alias(NUMBER_COL))
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
            rows = rows.alias("r").join(dead.alias("g"), [*same, F.col(f"g.{NUMBER_COL}") > F.col(f"r.{NUMBER_COL}")], "left_anti")
        return rows

    def _identities(self) -> DataFrame:
        """Key, ``_solo`` and id of every record, read without its other columns."""
        by = [c for c in (*self.key, SOLO_COL) if c != self.id_col]
        if self.id_col in self.key:
            return self._alive().select(*by, self.id_col).distinct()
        return self._alive().groupBy(*by).agg(F.min(self.id_col).alias(self.id_col))

    def read(self, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The records: of every key the first id and the last write's other columns."""
        rows = self._alive(upto, buckets).select(*self.schema.fieldNames(), PRINT_COL)
        return upsert(rows, self.key, self.id_col, SEQ_COL, PRINT_COL).select(*self.schema.fieldNames())

    def keys(self) -> DataFrame:
        """Key of every record, once or more, read without its other columns."""
        return self._alive().select(*self.key)

    def change(self, batch: str) -> DataFrame:
        """The rows that one batch wrote."""
        n, done = self._claim(_name(batch))
        if not done:
            raise FileNotFoundError(f"{self.root}: batch {batch}")
        return self.spark.read.schema(self._stored()).parquet(f"{self.root}/changes/c{n:08d}-put-{_name(batch)}")

    def touched(self, batch: str) -> DataFrame:
        """The records, as they are now, whose keys a batch wrote; only its buckets are read."""
        own = self.change(batch).withColumn(SOLO_COL, F.when(_any_null(self.key), F.col(self.id_col)))
        buckets = [r[0] for r in own.select(BUCKET_COL).distinct().collect()]       # at most the bucket count
        now = self.read(buckets=buckets).withColumn(SOLO_COL, F.when(_any_null(self.key), F.col(self.id_col)))
        by = list(dict.fromkeys([*self.key, SOLO_COL]))
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
        return now.alias("t").join(own.select(*by).distinct().alias("o"), same, "left_semi").drop(SOLO_COL)

    def next_id(self) -> int:
        """One more than the highest id ever written: ids of deleted records don't come back."""
        base = self._base()
        return next_id(self._written([c[2] for c in self._changes(base) if c[1] == "put"], base), self.id_col)


def _name(batch: str | None) -> str:
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"batch names hold letters, digits, dots, dashes and underscores: {batch!r}")
    return batch


def delete_records(records: ChangeTable, vectors: ChangeTable | None, ids: DataFrame, batch: str | None = None) -> int:
    """Delete records by id, and their vectors; returns how many records there were."""
    n = records.delete(ids, batch)
    if vectors is not None:
        vectors.delete(ids, batch)
    return n


def delete_everything(records: ChangeTable, vectors: ChangeTable | None, confirm: str | None = None, batch: str | None = None) -> int:
    n = records.clear(confirm, batch)
    if vectors is not None:
        vectors.clear(confirm, batch)
    return n
