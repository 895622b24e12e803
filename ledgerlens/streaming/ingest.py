"""Incremental ingestion with Structured Streaming.

New record or document files land in a folder; a stream with ``availableNow`` picks up whatever is new, and every micro-batch
adds its rows to change tables (see ``sources.changes``). A batch is named after its stream and epoch, so a
replayed one is skipped where it was committed and done over where it was not, and gives the same tables either way,
for records with and without a number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.dml import UPSERT_KEY, assign_ids
from ledgerlens.operators.vectors import DEFAULT_DIM, build_vectors
from ledgerlens.plans.documents import process_documents
from ledgerlens.session import scratch_path, written
from ledgerlens.sources.changes import ChangeTable, path_exists
from ledgerlens.sources.files import LISTED, file_name_from_path, list_files, task_folder, wide_listing, with_content
from ledgerlens.sources.store import read_bucketed, stamp_ingestion

LEDGER_SCHEMA = "id long, path string, content_hash string, success boolean, errors array<string>, seq long"
RECORD_SCHEMA = ("id long, invoice_number string, invoice_date string, seller_name string, buyer_name string, total_amount double, "
                 "currency string, file_name string, raw_text string, extraction_method string, page_count int, extracted_at string, "
                 "extras map<string,string>, seq long")
STORED_VECTOR_SCHEMA = "id long, matched_text string, embedding array<float>, seq long"


def upsert_batch_writer(table_root: str, schema: T.StructType, key: list[str] = UPSERT_KEY,
                        n_buckets: int | None = None, stream: str = "records"):
    """``foreachBatch`` function: add the micro-batch to the table."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        table = ChangeTable.create(batch.sparkSession, table_root, schema, key, buckets=n_buckets)
        table.put(batch.select(*schema.fieldNames()), f"{stream}-{epoch_id}")

    return write


def start_incremental_upsert(spark: SparkSession, landing: str, table_root: str, checkpoint: str,
                             schema: T.StructType, files_per_batch: int | None = None,
                             fmt: str = "parquet", n_buckets: int | None = None, stream: str = "records"):
    """Start the stream (``availableNow``): all new files, then stop. ``stream`` names its batches; streams
    with checkpoints of their own into one table need names of their own."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.load(landing).writeStream
            .foreachBatch(upsert_batch_writer(table_root, schema, n_buckets=n_buckets, stream=stream))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def incremental_upsert_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the record table as several files, stream them in, return the table."""
    from ledgerlens.plans import fixtures as fx

    rec = fx.invoices(spark, sf_dir).drop("raw_text").withColumn("seq", F.col("id"))
    landing = scratch_path(spark, "landing")
    rec.repartition("id").write.parquet(landing)
    schema = spark.read.parquet(landing).schema
    table = scratch_path(spark, "table")
    q = start_incremental_upsert(spark, landing, table, scratch_path(spark, "stream-ckpt"),
                                 schema, files_per_batch=2, n_buckets=16)
    q.awaitTermination()
    out = read_bucketed(spark, table)
    return out.select("id", "invoice_number", "file_name", "total_amount", "buyer_name", "extracted_at")


def file_texts(files: DataFrame, extractors: list, path_col: str = "path",
               content_col: str = "content", min_chars: int | None = None, keep: list[str] | tuple = ()) -> DataFrame:
    """``(path, *keep, text_1..text_n, file_name)`` from file bytes with user codecs.

    Each extractor maps ``bytes -> str``. Extractor ``i+1`` runs only for the
    files whose current text is still shorter than ``min_chars`` (the
    cascade would not look at it otherwise), so a slow OCR step touches only
    the files that need it. One that raises gives null for that file (a
    failed candidate counts as short): a bad file never stops the batch.
    """
    from ledgerlens.operators.extraction import MIN_TEXT_CHARS

    limit = MIN_TEXT_CHARS if min_chars is None else min_chars
    n = len(extractors)
    kept = files.select(path_col, *keep)
    out_schema = T.StructType([*kept.schema.fields, *(T.StructField(f"text_{i + 1}", T.StringType()) for i in range(n))])

    def run(batches):
        for pdf in batches:
            res = pdf[[path_col, *keep]].copy()
            current = [None] * len(pdf)
            for i, fn in enumerate(extractors):
                vals = []
                for j, b in enumerate(pdf[content_col]):
                    if i > 0 and current[j] is not None and len(current[j]) >= limit:
                        vals.append(None)           # cascade already settled for this file
                        continue
                    try:
                        v = None if b is None else fn(bytes(b))
                    except Exception:  # noqa: BLE001 - failed codec: null candidate
                        v = None
                    vals.append(v)
                    current[j] = v
                res[f"text_{i + 1}"] = vals
            yield res

    texts = files.select(path_col, *keep, content_col).mapInPandas(run, out_schema)
    return texts.withColumn("file_name", file_name_from_path(path_col))


def ingest_files_batch(batch: DataFrame, epoch_id: int, extractors: list, table_root: str,
                       vectors_root: str, n_buckets: int | None = None, stream: str = "files",
                       extractor: Callable | None = None, embedder=None, dim: int = DEFAULT_DIM,
                       use_ocr: bool = True) -> None:
    """One micro-batch of new files -> records, vectors and the ledger of applied files.

    A file is known by its path and the digest of its content; those in the ledger (``<table_root>_files``) are left out. The
    batch is worked out once, into a scratch table, so every codec and the extractor run once per file. Records get the next
    dense ids; equal keys take the last modified file's values. Vectors of the touched records are made anew from
    what is stored; a record that is no longer valid loses its vector. The three tables take the batch under one name: after a crash
    between them a replay adds what is missing and nothing twice.
    """
    spark = batch.sparkSession
    name = f"{stream}-{epoch_id}"
    schema = T._parse_datatype_string
    ledger = ChangeTable.create(spark, f"{table_root.rstrip('/')}_files", schema(LEDGER_SCHEMA), ["path", "content_hash"], buckets=n_buckets)
    if ledger.applied(name):
        return
    records = ChangeTable.create(spark, table_root, schema(RECORD_SCHEMA), UPSERT_KEY, buckets=n_buckets)
    vectors = ChangeTable.create(spark, vectors_root, schema(STORED_VECTOR_SCHEMA), ["id"], buckets=n_buckets)

    files = batch.withColumns({"content_hash": F.sha2("content", 256), "mtime": F.unix_micros("modificationTime")})
    fresh = files.join(ledger.keys(), ["path", "content_hash"], "left_anti")
    texts = file_texts(fresh, extractors, keep=["content_hash", "mtime"])
    cols = [f"text_{i + 1}" for i in range(len(extractors))]
    staged = written(spark, process_documents(texts, "path", cols, use_ocr=use_ocr, keep=["content_hash", "mtime", "file_name"],
                                              extractor=extractor), "ingested")

    rec = staged.filter("success").withColumns({"raw_text": F.col("text"), "seq": F.col("mtime")})
    rec = stamp_ingestion(rec.select(*[c for c in rec.columns if c in records.schema.fieldNames()]))
    records.put(assign_ids(rec, records.next_id()), name)
    touched = records.touched(name)
    vec = written(spark, build_vectors(touched, embedder=embedder, dim=dim), "vectors")
    vectors.put(vec, name)
    stale = touched.select("id").join(vec, "id", "left_anti")
    if not stale.isEmpty():
        vectors.delete(stale, f"{name}.stale")
    ledger.put(assign_ids(staged.select("path", "content_hash", "success", "errors"), ledger.next_id()), name)


def list_new_files(spark: SparkSession, folder: str, pattern: str, recursive: bool, listed: str, files_per_batch: int | None) -> None:
    """Add the files of a local folder that no listing under ``listed`` has, by path; with ``files_per_batch`` as one Parquet file
    for so many of them, the first modified first. A call writes a folder of its own; what one that died has left in place counts as listed."""
    to = f"{listed}/{uuid.uuid4().hex}"
    new = list_files(spark, folder, pattern, recursive)
    if path_exists(spark, listed):
        new = new.join(_listing(spark.read, listed).select("path"), "path", "left_anti").select(*new.columns)
    if not files_per_batch:
        new.write.parquet(to)
        return
    # numbered in order: by the place in the sorted partition, and the sizes of those before it
    new = new.orderBy("modificationTime", "path").withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    new = written(spark, new, "new-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = new.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    number = F.col("first") + F.col("place") - F.shiftleft(F.col("part").cast("long"), 33)
    new = new.join(F.broadcast(sizes), "part").withColumn("batch", F.floor(number / files_per_batch)).drop("part", "place", "first")
    new.repartition("batch").write.option("maxRecordsPerFile", 0).partitionBy("batch").parquet(to)


def _listing(reader, listed: str) -> DataFrame:
    return reader.schema(LISTED).option("recursiveFileLookup", True).parquet(listed)


def start_file_ingest(spark: SparkSession, landing: str, table_root: str, vectors_root: str,
                      checkpoint: str, extractors: list, pattern: str = "*.pdf",
                      files_per_batch: int | None = None, n_buckets: int | None = None, recursive: bool = False, **options):
    """Stream new files (``availableNow``) through extraction into
    the record table, the vector table and the ledger (see ``ingest_files_batch``, which takes ``options``). The checkpoint
    makes each file count once, the ledger does so when a checkpoint is lost, and a replayed batch adds nothing twice.

    New files of a local folder are listed by tasks before the stream starts, into ``<checkpoint>/listed``, and the stream is one of these
    listings, whose files the tasks open. A stream of the files themselves (``binaryFile``: other folders, and checkpoints
    begun so) keeps every file it ever saw on the driver.
    """
    wide_listing(spark)
    listed = f"{checkpoint.rstrip('/')}/listed"
    begun = path_exists(spark, listed)
    folder = task_folder(spark, landing, recursive or begun) if begun or not path_exists(spark, f"{checkpoint.rstrip('/')}/metadata") else None
    if folder:
        list_new_files(spark, folder, pattern, recursive, listed, files_per_batch)
        reader = spark.readStream.option("maxFilesPerTrigger", 1) if files_per_batch else spark.readStream
        files = _listing(reader, listed)
    else:
        reader = spark.readStream.format("binaryFile").schema(f"{LISTED}, content binary").option("pathGlobFilter", pattern)
        if recursive:
            reader = reader.option("recursiveFileLookup", True)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        files = reader.load(landing)

    def ingest(batch: DataFrame, epoch_id: int) -> None:
        if folder:      # as Spark's source does, without files that are gone by now
            batch = with_content(batch, gone_ok=True).filter(F.col("content").isNotNull())
        ingest_files_batch(batch, epoch_id, extractors, table_root, vectors_root, n_buckets, **options)

    return (files.writeStream
            .foreachBatch(ingest)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())
