"""Words, Arrow columns and shared tables used by several operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path, table_path

# A word is a run of digits, letters or non-ASCII characters; A-Z count as
# a-z. On UTF-8 bytes that is one table: every other ASCII byte is a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A
    else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256))

# Words a task remembers: some 10 MB, as six Python workers share an executor's memory with its JVM.
MEMO_WORDS = 50_000


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text; null and empty texts have none."""
    return text.translate(_WORD_BYTES).split() if text else []


class WordHash(dict):
    """64-bit hash of a word, remembered per task (bounded, see ``trim``)."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; fewer words, but not none, are one run."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = h[: n - k + 1].copy()
        for j in range(1, k):
            out *= _ODD
            out ^= out >> np.uint64(29)
            out += h[j: n - k + 1 + j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding it."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most 4 MB, besides the bound on rows: by rows alone a batch of long texts takes
    hundreds of MB in the JVM and in every worker. A smaller bound of the session stays."""
    given = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(_ARROW, None) or "").lower())
    if not given or int(given[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[given[2]] > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it again.

    Cuts the lineage at a table that every executor can reach, so a lost
    executor costs a read and not the jobs before it.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MAX_BITMAP_BITS = 1 << 24


class Bitmap:
    """Bits of hashed keys: no key that was put in is missed."""

    def __init__(self, bits: bytes):
        self.bits, self.size = bits, 8 * len(bits)

    @staticmethod
    def slot(key: bytes, size: int) -> int:
        return xxhash.xxh3_64_intdigest(key, seed=9) % size

    def __contains__(self, key: bytes) -> bool:
        s = self.slot(key, self.size)
        return bool(self.bits[s >> 3] >> (s & 7) & 1)


def bitmap(spark: SparkSession, keys: DataFrame):
    """Broadcast bitmap of the single string column's values: 16 bits a key, ``MAX_BITMAP_BITS`` at most."""
    size = 1 << 10
    while size < min(16 * keys.count(), MAX_BITMAP_BITS):
        size *= 2

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([Bitmap.slot(t, size) for t in text_bytes(b, "key")], pa.int64())], ["slot"])

    rows = (keys.toDF("key").mapInArrow(slots, "slot long")
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(slot & 63 as int))")).alias("bits")).collect())
    out = np.zeros(size // 64, "<i8")
    for r in rows:
        out[r.word] = r.bits
    return spark.sparkContext.broadcast(out.tobytes())


SALTS = 8


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links -> ``(node, label)``: label is the smallest node of the component.

    Large-star and small-star steps in turn, each a join on the smallest
    neighbour, until the links are stars. A hub's links are salted over
    several partitions; the smallest neighbour is aggregated before the shuffle.
    """
    spark = edges.sparkSession
    links = (edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    links = kept(spark, links, "links")
    last = None

    def with_least(pairs: DataFrame) -> DataFrame:
        low = (pairs.groupBy("u").agg(F.min("v").alias("m"))
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        return (pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
                .join(low, ["u", "salt"]).drop("salt"))

    while True:
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or state[0] == 0:
            break
        last = state
        both = links.union(links.select("v", "u"))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = with_least(large)
        links = kept(spark, small.select("u", F.col("m").alias("v"))
                     .union(small.filter("v <> m").select("v", "m")).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def keep_rows(docs: DataFrame, decided: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns.

    ``decided``: a row per different (doc_id, key) with ``copies`` and
    ``stays``; one copy of a key that stays remains. ``keyed`` gives
    ``(doc_id, key, row)`` of a frame; it is only run on doc_ids that come on several rows.
    """
    spark = docs.sparkSession
    decided = kept(spark, decided, "decided")
    several = kept(spark, decided.groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 1 or doc_id is null"), "several")
    gone = decided.filter(~F.col("stays")).select("doc_id").union(several.select("doc_id"))

    def same_id(a: str, b: str) -> Column:
        return F.col(f"{a}.doc_id").cast("long").eqNullSafe(F.col(f"{b}.doc_id"))

    out = docs.alias("d").join(gone.alias("g"), same_id("d", "g"), "left_anti")
    if several.isEmpty():
        return out
    again = keyed(docs.alias("d").join(several.alias("s"), same_id("d", "s"), "left_semi"))
    again = (again.alias("d").join(decided.filter("stays").alias("k"), same_id("d", "k") & F.col("d.key").eqNullSafe(F.col("k.key")), "left_semi")
             .groupBy("doc_id", "key").agg(F.min("row").alias("row")).select("row.*"))
    return out.unionByName(again)
