"""Record stores: JSON, CSV and a versioned parquet table.

All readers take the declared schema (no inference). Writers append or
replace whole DataFrames; there is no read-modify-write of a single file.
The keyed table is written as numbered version folders: a change reads the
newest version, computes the new table and writes the next version, so a
failed job leaves the previous version intact and a re-run repeats the
same change (upserts and deletes are idempotent by key).
"""

from __future__ import annotations

import itertools
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.records import flatten
from ledgerlens.schema import INVOICE_SCHEMA
from ledgerlens.sources.changes import ChangeTable, _Files

FORMATS = ("json", "csv", "db")
_VERSION = re.compile(r"^v(\d{8})$")


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    return fmt


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


def list_dir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p)]


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- JSON / CSV

def write_json(df: DataFrame, path: str, append: bool = True) -> str:
    """JSON lines, appended (or replacing with ``append=False``)."""
    df.write.mode("append" if append else "overwrite").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType = INVOICE_SCHEMA,
              multiline: bool = False) -> DataFrame:
    """Records from JSON; ``multiline=True`` also reads a JSON array file or a
    single object (which counts as a one-element list). Missing -> empty."""
    if not path_exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_json_files(spark: SparkSession, path: str, schema: T.StructType = INVOICE_SCHEMA, recursive: bool = False) -> DataFrame:
    """Records of JSON files of any of three forms, found out per file: one object per line, an array of objects, or a single
    object over several lines (a list of one). Missing -> empty; a file without text has no records.

    The form shows in the first line that is not blank: ``{...}`` whole in a line is a file of lines, anything else one
    document. Finding it out costs a scan of the files as text; the records are then read by Spark's JSON reader in either mode.
    """
    if not path_exists(spark, path):
        return _empty(spark, schema)
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                         F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    first = lines.filter("line <> ''").groupBy("file").agg(F.min_by("line", "at").alias("line"))
    forms = first.select("file", (F.col("line").startswith("{") & F.col("line").endswith("}")).alias("by_line")).collect()   # a row per file
    out = [_empty(spark, schema)]
    for by_line in (True, False):
        files = [r.file for r in forms if r.by_line == by_line]
        if files:
            out.append(spark.read.schema(schema).option("multiLine", not by_line).json(files))
    return out[-1] if len(out) < 3 else out[1].unionAll(out[2])


def csv_safe(df: DataFrame) -> DataFrame:
    """Flatten structs; maps and arrays become JSON text (CSV holds scalars)."""
    flat = flatten(df)
    cols = []
    for f in flat.schema.fields:
        if isinstance(f.dataType, (T.MapType, T.ArrayType)):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return flat.select(*cols)


# Line breaks and blanks inside a field survive, quotes are doubled.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, append: bool = True, single_file: bool = False) -> str:
    """CSV with a header; nested values flattened. ``single_file`` writes one file: every task writes its part of it, and on a ``file:``
    or ``hdfs:`` path no task takes another one's bytes. On other file systems one task writes them all."""
    out = csv_safe(df)
    scheme = _hadoop_fs(df.sparkSession, path)[0].getUri().getScheme()
    if single_file and scheme in ("file", "hdfs"):
        return _write_one_csv(out, path, append, scheme)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("append" if append else "overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def _write_one_csv(out: DataFrame, path: str, append: bool, scheme: str) -> str:
    """Parts without a header, written by all tasks, become one file: on HDFS its blocks are put together, on a local or mounted
    folder every part is copied to its own place in the file, by as many tasks. Files before it go once the new one is there whole."""
    spark = out.sparkSession
    files = _Files(spark, path)
    work = f"{path.rstrip('/')}/_one-{uuid.uuid4().hex}"
    try:
        _empty(spark, out.schema).coalesce(1).write.options(**CSV_OPTIONS).csv(f"{work}/a")
        out.write.options(**{**CSV_OPTIONS, "header": False}).csv(f"{work}/b")
        parts = [(s.getPath(), s.getLen()) for d in "ab" for s in sorted(files.fs.listStatus(files.path(f"{work}/{d}")), key=lambda s: s.getPath().getName())
                 if s.getPath().getName().endswith(".csv") and s.getLen()]
        whole = files.path(f"{work}/whole.csv")
        if scheme == "hdfs":
            files.fs.create(whole, True).close()
            files.fs.concat(whole, _paths(spark, [p for p, _ in parts]))
        else:
            _join_local(spark, files.fs.makeQualified(whole).toUri().getPath(), [(p.toUri().getPath(), n) for p, n in parts])
        if files.fs.getFileStatus(whole).getLen() != sum(n for _, n in parts):
            raise OSError(f"{path} is not whole: its parts must lie in a folder shared by all executors")
        before = [] if append else [n for n in files.names(path) if f"/{n}" != work[-len(n) - 1:]]
        files.fs.rename(whole, files.path(f"{path}/part-00000-{uuid.uuid4()}-c000.csv"))
        for n in before:
            files.remove(f"{path}/{n}")
    finally:
        files.remove(work)
    files.create(f"{path}/_SUCCESS", "")
    return path


def _join_local(spark: SparkSession, target: str, parts: list[tuple[str, int]]) -> None:
    """The parts one after another in one file of a local or mounted folder, a task a part."""
    ends = itertools.accumulate(n for _, n in parts)
    open(target, "wb").close()

    def place(rows) -> None:
        for source, at in rows:
            with open(source, "rb") as r, open(target, "r+b") as w:
                w.seek(at)
                shutil.copyfileobj(r, w, 1 << 20)

    places = [(p, end - n) for (p, n), end in zip(parts, ends, strict=True)]
    spark.sparkContext.parallelize(places, len(places)).foreachPartition(place)


def _paths(spark: SparkSession, paths: list):
    out = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, p in enumerate(paths):
        out[i] = p
    return out


# A line of whole fields, each without quotes or quoted with inner quotes doubled. Lines with more quotes or commas are not tried (Java's
# matcher goes down a level for each); their file is read as one with line breaks inside fields.
WHOLE_LINE = r'^(?:"(?:[^"]*+"")*+[^"]*+"|[^",]*+)(?:,(?:"(?:[^"]*+"")*+[^"]*+"|[^",]*+))*+$'
MOST_MARKS = 500


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of CSV files. Spark reads a file with line breaks inside fields in one task; one whose lines are each a whole
    record, as a scan of the files as text tells, is read in splits."""
    if not path_exists(spark, path):
        return _empty(spark, schema)
    options = dict(CSV_OPTIONS)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    marks = F.length("value") - F.length(F.translate("value", '",', ""))
    whole = (F.when(~F.col("value").contains('"'), True).when(marks <= MOST_MARKS, F.col("value").rlike(WHOLE_LINE)).otherwise(False)
             & ~F.col("value").contains("\r") & ~F.col("value").rlike(r"^[\x00-\x20]+$"))
    forms = lines.groupBy("file").agg(F.min(whole).alias("whole")).collect()             # a row per file
    out = [spark.read.schema(schema).options(**options).option("multiLine", not form).csv([r.file for r in forms if r.whole == form])
           for form in (True, False) if any(r.whole == form for r in forms)]
    if not out:
        return _empty(spark, schema)
    return out[0] if len(out) == 1 else out[0].unionAll(out[1])


# ---------------------------------------------------------------- versioned table

def latest_version(spark: SparkSession, root: str) -> int | None:
    """Newest committed version: a folder left by a job that died before its
    commit (no ``_SUCCESS`` marker) is ignored and later overwritten."""
    vs = sorted((int(m.group(1)) for n in list_dir(spark, root) if (m := _VERSION.match(n))), reverse=True)
    for v in vs:
        if path_exists(spark, f"{root.rstrip('/')}/v{v:08d}/_SUCCESS"):
            return v
    return None


def read_table_version(spark: SparkSession, root: str, schema: T.StructType | None = None,
                       version: int | None = None) -> DataFrame:
    """The newest (or given) version of a keyed table; missing -> empty."""
    v = latest_version(spark, root) if version is None else version
    if v is None:
        if schema is None:
            raise FileNotFoundError(root)
        return _empty(spark, schema)
    return spark.read.parquet(f"{root.rstrip('/')}/v{v:08d}")


def write_table_version(df: DataFrame, root: str) -> int:
    """Write ``df`` as the next version of the table; returns its number.

    The write goes to a fresh folder, so the plan may read the previous
    version while it writes this one. The number is claimed by a file that must not exist, so two writers
    never write to one folder; the number of a job that died is not used again.
    """
    files = _Files(df.sparkSession, root)
    root = root.rstrip("/")
    v = (latest_version(df.sparkSession, root) or 0) + 1
    while files.exists(f"{root}/v{v:08d}/_SUCCESS") or not files.create(f"{root}/claims/v{v:08d}", ""):
        v += 1
    df.write.mode("overwrite").parquet(f"{root}/v{v:08d}")
    return v


def stamp_ingestion(df: DataFrame, col: str = "extracted_at") -> DataFrame:
    """Fill the ingestion time as ISO text: one ``current_timestamp`` value
    for the whole batch (Spark evaluates it once per query)."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if col in df.columns:
        return df.withColumn(col, F.coalesce(F.col(col), now))
    return df.withColumn(col, now)


def load_newest_first(df: DataFrame) -> DataFrame:
    """The whole table, newest ingestion first (ties: higher id first)."""
    return df.orderBy(F.col("extracted_at").desc_nulls_last(), F.col("id").desc())


def save(df: DataFrame, root: str, formats: list[str] = list(FORMATS), upsert_fn=None,
         bucketed_key: list[str] | None = None, n_buckets: int | None = None) -> dict:
    """Write one batch to the chosen sinks in order json, csv, db.

    The batch is persisted once and reused by every sink. Returns, per sink,
    its path and row count (and the table version for ``db``). With
    ``bucketed_key`` the ``db`` table is a change table: a batch adds its own rows only (see ``changes``), and keyed
    rows are merged when it is read; without, every batch writes the whole table as its next version.
    """
    for f in formats:
        check_format(f)
    batch = df.persist()
    n = batch.count()
    out = {}
    try:
        if "json" in formats:
            out["json"] = {"path": write_json(batch, f"{root}/invoices_json"), "rows": n}
        if "csv" in formats:
            out["csv"] = {"path": write_csv(batch, f"{root}/invoices_csv"), "rows": n}
        if "db" in formats and bucketed_key:
            path = f"{root}/invoices_buckets"
            table = ChangeTable.create(df.sparkSession, path, batch.schema, bucketed_key, buckets=n_buckets)
            out["db"] = {"path": path, "change": table.put(batch), "rows": n}
        elif "db" in formats:
            spark = df.sparkSession
            path = f"{root}/invoices_table"
            current = read_table_version(spark, path, batch.schema)
            new = upsert_fn(current, batch) if upsert_fn else current.unionByName(batch)
            v = write_table_version(new, path)
            out["db"] = {"path": path, "version": v, "rows": n}
    finally:
        batch.unpersist()
    return out


# ---------------------------------------------------------------- change table

def read_bucketed(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The records of a change table (see ``changes``); missing -> empty where a schema is given."""
    if not ChangeTable.exists(spark, root):
        if schema is None:
            raise FileNotFoundError(root)
        return _empty(spark, schema)
    return ChangeTable.open(spark, root).read()
