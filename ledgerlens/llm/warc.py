"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by page_id, and those of one page_id by a digest of their payload, into shards: contiguous ranges of about
``SHARD_BYTES`` of payload, cut by exact running sums, so they depend
on the data alone and not on the cluster or on how dense the ids are. The sums are made per part of a range partitioning and put
together from the parts' totals, a row per part. One task streams a shard in order, a gzip
member per record, and starts a new file once the compressed size reaches ``FILE_BYTES``.
Headers, lengths and digests are made anew; the date is a parameter, so equal input gives equal bytes.

Of records with equal payloads, that with the largest page_id is the response
and the others are revisits of it, from ``min_bytes`` of payload on. The payloads' digests are grouped
with counts summed before the shuffle; what each shard needs to know of revisits is
sent along in sort order, so payloads are shuffled once and no task holds more than a record.

Commit: a file is written under a temporary name and renamed when it is
complete; a lost or repeated task writes the same bytes under the same name. The manifest,
a Parquet table with a row per file, is committed last by Spark, and the reader opens
only files that it lists, checking their size and every digest.

Defined results: null html is an empty payload; empty payloads equal each other. A null page_id sorts first.
A page_id given several times with one payload: one record is the response, the others revisit it. Records of a page_id that comes more than
once, null too, are dealt to shards by payload and have the payload's digest and a number in their record id. A null url is written as
``urn:null`` and read as null; control characters in a url become %XX. An empty table gives an empty manifest. Extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, kept, text_bytes
from ledgerlens.session import scratch_path

SHARD_BYTES = 64 << 20
FILE_BYTES = 32 << 20
MIN_BYTES = 0
RECORD_BYTES = 512         # what a record weighs besides its payload
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "file string, shard long, records long, bytes long, sha256 string"


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _check(data: bytes) -> int:
    """Second digest: payloads are equal when both and the length agree."""
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return None if name == "null" else int(name)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the same bytes for the same record."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, nth: str, url: str | None, payload: bytes, digest: str, original: tuple | None, date: str) -> bytes:
    """``nth``: what tells the records of one page_id apart. ``original``: None for a response, else a 1-tuple of the page_id that is revisited."""
    name = record_id(page_id)
    if nth:
        name = f"{name[:-1]}:{nth}>"
    uri = "urn:null" if url is None else _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url)
    head = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if original is None else http
    if original is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original[0]))]
    head += [("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return member(head, block)


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, on the driver and on executors."""
    if root.startswith("s3a://"):
        root = "s3://" + root[6:]
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)


class Shard:
    """Writes a shard's files; gives a manifest row for each."""

    def __init__(self, root: str, shard: int, file_bytes: int, date: str):
        self.fs, self.root = filesystem(root)
        self.shard, self.file_bytes, self.date, self.n = shard, file_bytes, date, 0
        self.out = None

    def add(self, data: bytes) -> list[tuple]:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.n:04d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", self.date),
                                ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.records += 1
        return self.close() if self.size >= self.file_bytes else []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        self.n += 1
        return [(self.name, self.shard, self.records, self.size, self.sha.hexdigest())]


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, digest, check, n of every payload."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in text_bytes(b, "html")]
            yield pa.RecordBatch.from_arrays(
                [column(b, "page_id"), pa.array([sha1_32(x) for x in data], pa.string()), pa.array([_check(x) for x in data], pa.int64()),
                 pa.array([len(x) for x in data], pa.int64())], ["page_id", "digest", "check", "n"])

    return _rows(pages).select("page_id", "html").mapInArrow(digest, "page_id long, digest string, check long, n long")


def shard_starts(found: DataFrame, shard_bytes: int) -> list[tuple[int | None, int]]:
    """First page_id and payload digest of every shard but the first, in order; a few bytes per ``shard_bytes`` of payload."""
    sums = found.groupBy("page_id", "check").agg(F.sum(F.col("n") + RECORD_BYTES).alias("n"))
    parts = kept(found.sparkSession, sums.repartitionByRange("page_id", "check").withColumn("part", F.spark_partition_id()), "parts")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)            # a row per part
    totals = parts.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("page_id", "check").rowsBetween(Window.unboundedPreceding, -1)
    at = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "part")
    shard = F.floor((F.col("start") + F.col("inside")) / shard_bytes)
    firsts = at.groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "check")).alias("first")).collect()
    return sorted(((r.first.page_id, r.first.check) for r in firsts), key=_order)[1:]


def _order(key: tuple[int | None, int]) -> tuple[bool, int, int]:
    return key[0] is not None, key[0] or 0, key[1]


def write_archive(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
                  min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """Writes the files and ``root/manifest``; returns the manifest."""
    spark = pages.sparkSession
    found = kept(spark, digests(pages), "digests")
    key = ["digest", "check", "n"]
    first = kept(spark, found.filter(F.col("n") >= min_bytes).groupBy(*key)
                 .agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).filter("copies > 1"), "originals")
    known = found.join(first, key).select("page_id", "check", "n", "original").distinct()
    several = found.groupBy("page_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("page_id").alias("several"))
    told = found.join(several, F.col("page_id").eqNullSafe(F.col("several")), "left_semi").select("page_id", "check").distinct()
    starts = spark.sparkContext.broadcast(shard_starts(found, shard_bytes))

    def with_shard(df: DataFrame) -> DataFrame:
        """``check`` of payloads that come without it, and the shard of every row."""
        kind = df.select(F.lit(0).cast("long").alias("shard"), *df.columns).schema

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = [_order(x) for x in starts.value]
            for b in batches:
                check = [c if k == 0 else _check(h or b"") for c, k, h in
                         zip(column(b, "check").to_pylist(), column(b, "kind").to_pylist(), text_bytes(b, "html"), strict=True)]
                shard = [bisect_right(bounds, _order(x)) for x in zip(column(b, "page_id").to_pylist(), check, strict=True)]
                named = {**dict(zip(b.schema.names, b.columns, strict=True)), "check": pa.array(check, pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *named.values()], ["shard", *named])

        return df.mapInArrow(add, kind)

    none = F.lit(None)
    # kind 0 tells the rows of its page_id and payload behind it: which record they revisit, or that the page_id has several rows
    info = (known.select("page_id", "check", "n", "original", F.lit(False).alias("many"))
            .unionByName(told.select("page_id", "check", none.cast("long").alias("n"), none.cast("long").alias("original"), F.lit(True).alias("many")))
            .select("page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "check", "n", "original", "many"))
    rows = _rows(pages).select("page_id", F.lit(1).alias("kind"), "url", "html", none.cast("long").alias("check"),
                               none.cast("long").alias("n"), none.cast("long").alias("original"), F.lit(False).alias("many"))
    n_shards = len(starts.value) + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        page: tuple = ()
        originals: dict[int, int | None] = {}
        nth, many, seen = 0, False, set()

        def manifest(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "records", "bytes", "sha256"])

        for b in batches:
            done = []
            cols = [column(b, c).to_pylist() for c in ("shard", "page_id", "check", "kind", "url", "n", "original", "many")]
            for k, page_id, check, kind, url, n, original, flag, html in zip(*cols, text_bytes(b, "html"), strict=True):
                if shard is None or k != shard.shard:
                    done += shard.close() if shard else []
                    shard, page = Shard(root, k, file_bytes, date), ()
                if page != (page_id, check):
                    page, originals, nth, many, seen = (page_id, check), {}, 0, False, set()
                if not kind:
                    many = many or flag
                    if not flag:
                        originals[n] = original
                    continue
                payload = html or b""
                same = len(payload)
                again = same in originals and (originals[same] != page_id or same in seen)
                seen.add(same)
                name = f"{check & 0xFFFFFFFFFFFFFFFF:016x}-{nth}" if many else ""
                done += shard.add(page_record(page_id, name, url, payload, sha1_32(payload), (originals[same],) if again else None, date))
                nth += 1
            yield manifest(done)
        if shard:
            yield manifest(shard.close())

    rows = (with_shard(info.unionByName(rows)).repartitionById(n_shards, F.col("shard").cast("int"))
            .sortWithinPartitions("shard", "page_id", "check", "kind", "url", "html"))
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a gzip file, one member at a time."""
    z, parts = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        parts.append(z.decompress(data))
        if not z.eof:
            data = stream.read(1 << 20)
            continue
        data = z.unused_data or stream.read(1 << 20)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
            raise ValueError("not a complete WARC record")
        yield headers, rest[:n]
        z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("file ends inside a record")


def read_archive(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """A row per page record of the files in the manifest: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to and, if asked for, the html of responses."""
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in kind.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(root)
        for b in batches:
            for name, size in zip(column(b, "file").to_pylist(), column(b, "bytes").to_pylist(), strict=True):
                if store.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} is not as the manifest has it")
                out: list[tuple] = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Block-Digest"] != f"sha1:{sha1_32(block)}" or head["WARC-Type"] == "response" and digest != sha1_32(payload):
                            raise ValueError(f"wrong digest of {head['WARC-Record-ID']}")
                        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                        url = head["WARC-Target-URI"]
                        out.append((page_of(head["WARC-Record-ID"]), None if url == "urn:null" else url, length, digest, head["WARC-Type"],
                                    page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None,
                                    payload.decode("utf-8", "replace") if payloads and head["WARC-Type"] == "response" else None))
                        if len(out) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
                            out = []
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").select("file", "bytes")
    out = files.repartition(max(1, files.count()), "file").mapInArrow(read, kind)
    return out if payloads else out.drop("html")


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages under the shared folder and reads the archive back."""
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    write_archive(pages, root)
    return read_archive(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
