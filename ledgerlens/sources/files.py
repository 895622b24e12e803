"""Document files as rows: directory scans and file names.

Folders that every task can open as local ones (``file:``) are listed, read and written by tasks. Spark's own file source, which reads any other, keeps
a status of every file on the driver, and Hadoop's local file system starts a process for the permissions of each file and folder it makes.
"""

from __future__ import annotations

import errno
import itertools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import written


def scan_directory(spark: SparkSession, directory: str, pattern: str = "*.pdf",
                   recursive: bool = False) -> DataFrame:
    """``(path, modificationTime, length, content, file_name)`` of matching files.

    Non-recursive and case-sensitive by default. Each file is one row; tasks list the folders, once, and read the files,
    those whose ``content`` is asked for.
    """
    wide_listing(spark)
    folder = task_folder(spark, directory, recursive)
    if folder:
        r = with_content(written(spark, list_files(spark, folder, pattern, recursive), "listing"))
    else:
        r = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", recursive).load(directory))
    return r.withColumn("file_name", file_name_from_path("path"))


LISTING_TASKS_PER_CORE = 8
FILES_PER_TASK = 500
CONTENT_BYTES = 16 << 20
LISTED = "path string, modificationTime timestamp, length long"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def wide_listing(spark: SparkSession) -> None:
    """Folders are listed by a few tasks per core, many to a task. Spark makes a task of every folder, up to 10,000, each of which costs the
    driver more than listing it does. A smaller number of the session stays."""
    most = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    if int(spark.conf.get(_LISTING)) > most:
        spark.conf.set(_LISTING, str(most))


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path in the local file system; None where another one holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def task_folder(spark: SparkSession, directory: str, recursive: bool) -> str | None:
    """The local path of a folder that tasks can list; None of globs, files, other file systems, and, without ``recursive``, of a folder
    with folders in it, where Spark's source looks for partitions."""
    folder = None if re.search(r"[\[\]{}*?\\]", directory) else local_path(spark, directory)
    if folder is None or not os.path.isdir(folder):
        return None
    if not recursive:
        with os.scandir(folder) as entries:
            if any(e.is_dir() for e in entries):
                return None
    return folder


def list_files(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    """``LISTED`` of the files of a local folder that Spark's source would read: a task lists the folder, and as many as list for Spark the folders in it."""
    matches = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    entries = "path string, mtime long, length long"       # of a folder without the last two
    found = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("path"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("length"))
    found = found.mapInArrow(_lister(matches, deep=False), entries)
    if recursive:
        found = found.repartition(LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism).mapInArrow(_lister(matches, deep=True), entries)
    return found.filter("length > 0").select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_micros("mtime").alias("modificationTime"), "length")


def _lister(matches: str, deep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        listed = (found for row in given for found in ([row] if row[2] is not None else _entries(row[0], re.compile(matches), deep)))
        while rows := list(itertools.islice(listed, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             ["path", "mtime", "length"])

    return run


def _entries(folder: str, matches: re.Pattern, deep: bool) -> Iterator[tuple[str, int | None, int | None]]:
    """Path, microseconds and bytes of the files in a folder and, if ``deep``, below, without hidden ones; else its folders too, by path alone."""
    inner = []
    with os.scandir(folder) as entries:
        for e in entries:
            if e.name.startswith(".") or (e.name.startswith("_") and "=" not in e.name) or e.name.endswith("._COPYING_"):
                continue
            try:
                e.name.encode()                            # the JVM can't open other names either
                if e.is_dir():
                    inner.append(e.path) if deep else (yield e.path, None, None)
                elif matches.fullmatch(e.name):
                    s = e.stat()
                    yield e.path, s.st_mtime_ns // 1_000_000 * 1000, s.st_size
            except UnicodeEncodeError:
                continue
            except OSError as x:
                if x.errno not in (errno.ENOENT, errno.ELOOP):      # gone since, or a link to nowhere
                    raise
    for path in inner:
        yield from _entries(path, matches, deep)


def with_content(files: DataFrame, gone_ok: bool = False) -> DataFrame:
    """Listed files with their bytes, ``FILES_PER_TASK`` to a task. With ``gone_ok`` a file that is no longer there has null."""
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for paths in batches:
            out, size = [], 0
            for p in paths.to_pylist():
                try:
                    with open(p.removeprefix("file:"), "rb") as f:
                        out.append(f.read())
                    size += len(out[-1])
                except FileNotFoundError:
                    if not gone_ok:
                        raise
                    out.append(None)
                if size >= CONTENT_BYTES:
                    yield pa.array(out, pa.binary())
                    out, size = [], 0
            yield pa.array(out, pa.binary())

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    content = F.arrow_udf(read, "binary")
    # so that a filter on null doesn't read the files once more
    content = content.asNondeterministic() if gone_ok else content
    return files.repartition(_tasks(files)).withColumn("content", content("path"))


def _tasks(rows: DataFrame) -> int:
    """Tasks for a file of each row: a file costs far more than its bytes, so files are dealt by number (AQE would put small ones in one task)."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILES_PER_TASK))


def write_text_files(df: DataFrame, key: str, path: str) -> str:
    """A folder ``<key>=<value>`` per key with one text file of its rows, from the other, string column.

    Tasks write their own files. Outside the local file system Spark's writer does, and tasks move their own
    files into place: the default committer moves them all on the driver.
    """
    value = next(c for c in df.columns if c != key)
    folder = local_path(df.sparkSession, path)
    if folder is None:
        (df.repartition(_tasks(df), key).write.partitionBy(key)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))
        return path
    os.makedirs(folder)
    rows = df.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).alias("value"))
    rows = rows.repartition(_tasks(df), "key").sortWithinPartitions("key")
    rows.mapInArrow(_text_writer(f"{folder}/{key}="), "files long").agg(F.sum("files")).collect()
    return path


def _text_writer(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.txt"
        files = 0
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for key, lines in itertools.groupby(rows, key=lambda row: row[0]):
            folder = prefix + ("__HIVE_DEFAULT_PARTITION__" if key is None else re.sub(_ESCAPED, lambda m: f"%{ord(m[0]):02X}", key))
            os.makedirs(folder, exist_ok=True)
            draft = f"{folder}/.{name}.{task.taskAttemptId()}"       # of a failed attempt: hidden; of two attempts one is left
            with open(draft, "wb") as f:
                for _, text in lines:
                    f.write((text or "").encode() + b"\n")
            os.replace(draft, f"{folder}/{name}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return run


_ESCAPED = r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"      # as Spark names folders of partitions


def file_name_from_path(path) -> Column:
    """Last path segment (query and fragment removed)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(F.regexp_replace(p, r"[?#].*$", ""), "/"), -1)
