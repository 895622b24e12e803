"""Exact de-duplication by composable polynomial fingerprints.

Two texts are equal when their UTF-8 bytes agree after lower-casing A-Z.

1. A text of bytes ``x0 .. x(n-1)`` has the fingerprint
   ``sum (x_i + 1) * B^(n-1-i) mod p`` for two bases ``B``. It composes: a
   chunk that ends at byte ``e`` adds ``hash(chunk) * B^(n-e)``, so the chunks
   of a huge text are hashed by different tasks and summed in any order.
2. Rows with equal length and fingerprints form a group; only counts and the
   largest doc_id of each cross the network, summed before the shuffle.
3. Groups of two or more different rows are verified: their texts stream past
   the text of the row that stays, chunk by chunk, in sorted order. Large
   groups are spread over salted partitions, each with a copy of that text's
   chunks, so no task holds more than one chunk of it.
4. Rows that share a fingerprint but not the text go into another round with
   new bases, until none is left.

Defined results: a null text counts as empty; empty texts are equal to each
other. A null doc_id is smaller than any other. A row given several times (same
doc_id, same text) counts each time and stays once. Rows that repeat a doc_id
with another text are separate rows. An empty table gives no rows. Other
columns, whatever their names, are carried by ``drop_exact_duplicates``.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, keep_rows, kept, text_bytes

MODULUS = (1 << 31) - 1
CHUNK_BYTES = 64 * 1024
ROWS_PER_SALT = 1024
KEY = ["n_bytes", "f1", "f2"]


def bases(round_no: int, modulus: int) -> tuple[int, int]:
    """Two bases for a round, the same on every run."""
    rnd = random.Random(7919 * (round_no + 1))
    low = min(1 << 16, modulus // 2)
    return rnd.randrange(low, modulus), rnd.randrange(low, modulus)


def powers(base: int, n: int, modulus: int) -> np.ndarray:
    """``B^(n-1) .. B^1, B^0`` modulo ``modulus``."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have:have + step] = out[:step] * np.uint64(pow(base, have, modulus)) % np.uint64(modulus)
        have += step
    return out[::-1].copy()


class Polynomial:
    """Hash of one chunk under one base: a dot product with the base's powers."""

    def __init__(self, base: int, chunk_bytes: int, modulus: int):
        self.base, self.modulus = base, modulus
        self.powers = powers(base, chunk_bytes, modulus)

    def chunk(self, data: bytes) -> int:
        if not data:
            return 0
        x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        return int(np.dot(x, self.powers[-len(data):])) % self.modulus

    def shifted(self, data: bytes, after: int) -> int:
        """What the chunk adds to a text that has ``after`` more bytes."""
        return self.chunk(data) * pow(self.base, after, self.modulus) % self.modulus


def fingerprints(docs: DataFrame, round_no: int = 0, chunk_bytes: int = CHUNK_BYTES,
                 modulus: int = MODULUS) -> DataFrame:
    """``(doc_id, text)`` -> a row per different (doc_id, text): digest, length, fingerprints, copies."""
    one, two = bases(round_no, modulus)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = Polynomial(one, chunk_bytes, modulus), Polynomial(two, chunk_bytes, modulus)
        for b in batches:
            texts = [(t or b"").lower() for t in text_bytes(b)]
            yield pa.RecordBatch.from_arrays([
                column(b, "doc_id"),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([p.chunk(t) for t in texts], pa.int64()),
                pa.array([q.chunk(t) for t in texts], pa.int64())],
                ["doc_id", "text_sha256", "n_bytes", "f1", "f2"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(column(b, "doc_id").to_pylist(), text_bytes(b), strict=True):
                text = text.lower()
                sha = hashlib.sha256(text).hexdigest()
                for i, at in enumerate(range(0, len(text), chunk_bytes)):
                    part = text[at:at + chunk_bytes]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_id], pa.int64()), pa.array([sha]), pa.array([len(text)], pa.int64()),
                        pa.array([i], pa.int64()), pa.array([len(text) - at - len(part)], pa.int64()),
                        pa.array([part], pa.binary())],
                        ["doc_id", "text_sha256", "n_bytes", "chunk_no", "after", "chunk"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = Polynomial(one, chunk_bytes, modulus), Polynomial(two, chunk_bytes, modulus)
        for b in batches:
            parts = list(zip(column(b, "chunk").to_pylist(), column(b, "after").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [column(b, c) for c in ("doc_id", "text_sha256", "n_bytes", "chunk_no")]
                + [pa.array([x.shifted(d, a) for d, a in parts], pa.int64()) for x in (p, q)],
                ["doc_id", "text_sha256", "n_bytes", "chunk_no", "f1", "f2"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = (docs.filter(size <= chunk_bytes)
             .mapInArrow(whole, "doc_id long, text_sha256 string, n_bytes long, f1 long, f2 long")
             .groupBy("doc_id", "text_sha256", *KEY).agg(F.count("*").alias("copies")))
    row = ["doc_id", "text_sha256", "n_bytes"]
    long = (docs.filter(size > chunk_bytes)
            .mapInArrow(chunks, "doc_id long, text_sha256 string, n_bytes long, chunk_no long, after long, chunk binary")
            .repartition("doc_id", "chunk_no")
            .mapInArrow(hashed, "doc_id long, text_sha256 string, n_bytes long, chunk_no long, f1 long, f2 long")
            .groupBy(*row, "chunk_no", "f1", "f2").agg(F.count("*").alias("copies"))
            .groupBy(*row).agg((F.sum("f1") % modulus).alias("f1"), (F.sum("f2") % modulus).alias("f2"),
                               F.max("copies").alias("copies")))
    return short.unionByName(long)


def _same(a: str, b: str, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def mismatches(docs: DataFrame, rows: DataFrame, groups: DataFrame,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of groups whose text is not the text of the row that stays.

    ``rows``: fingerprint rows; ``groups``: KEY, keep_id, members (two or more).
    """
    cands = (rows.alias("r").join(groups.alias("g"), _same("r", "g", KEY))
             .select("r.doc_id", "r.text_sha256", *[f"r.{c}" for c in KEY],
                     F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")).alias("stays"),
                     F.ceil(F.col("g.members") / ROWS_PER_SALT).cast("long").alias("salts"))
             .filter("n_bytes > 0"))
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("d")
             .join(cands.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
             .select("c.*", "d.text"))
    out = "n_bytes long, f1 long, f2 long, chunk_no long, salt long, follows int, text_sha256 string, doc_id long, chunk binary"
    names = [c.split()[0] for c in out.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(),
                                            "binary": pa.binary()}[c.split()[1]]) for c in out.split(", ")])
        for b in batches:
            found: list[tuple] = []
            held = 0
            for r, text in zip(b.drop_columns(["text"]).to_pylist(), text_bytes(b), strict=True):
                text = (text or b"").lower()
                sha = r["text_sha256"]
                if len(text) != r["n_bytes"] or hashlib.sha256(text).hexdigest() != sha:
                    continue                      # another text under the same doc_id
                salts = range(r["salts"]) if r["stays"] else [int(sha[:12], 16) * 31 + (r["doc_id"] or 0)]
                for salt in salts:
                    for i, at in enumerate(range(0, len(text), chunk_bytes)):
                        found.append((r["n_bytes"], r["f1"], r["f2"], i, salt % r["salts"], int(not r["stays"]),
                                      sha, r["doc_id"], text[at:at + chunk_bytes]))
                        held += len(found[-1][-1])
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema)
                            found, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk = None, b""
        for b in batches:
            bad = []
            key = list(zip(*[column(b, c).to_pylist() for c in names[:5]], strict=True))
            for i, (k, data) in enumerate(zip(key, column(b, "chunk").to_pylist(), strict=True)):
                if k != at:                       # the row that stays sorts first
                    at, chunk = k, data
                elif data != chunk:
                    bad.append(i)
            yield b.take(pa.array(bad, pa.int64())).select(["doc_id", "text_sha256"])

    order = ["n_bytes", "f1", "f2", "chunk_no", "salt"]
    return (texts.mapInArrow(cut, out).repartition(*order)
            .sortWithinPartitions(*order, "follows", "text_sha256", "doc_id")
            .mapInArrow(compare, "doc_id long, text_sha256 string").distinct())


def decisions(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, modulus: int = MODULUS) -> DataFrame:
    """A row per different (doc_id, text): keep_id, group_size, copies, stays.

    ``stays`` marks the row of each group that remains (one of its copies).
    """
    spark = docs.sparkSession
    left, out, round_no = docs, None, 0
    while True:
        rows = kept(spark, fingerprints(left, round_no, chunk_bytes, modulus), "fingerprints")

        def grouped(r: DataFrame) -> DataFrame:
            return (r.groupBy(*KEY).agg(F.sum("copies").alias("group_size"), F.count("*").alias("members"),
                                        F.max("doc_id").alias("keep_id")).filter("members > 1"))

        groups = kept(spark, grouped(rows), "groups")
        bad = kept(spark, mismatches(left, rows, groups, chunk_bytes), "mismatches")
        more = not bad.isEmpty()
        if more:
            rows = rows.alias("r").join(bad.alias("b"), _same("r", "b", ["doc_id", "text_sha256"]), "left_anti")
            groups = kept(spark, grouped(rows), "groups")
        done = (rows.alias("r").join(groups.alias("g"), _same("r", "g", KEY), "left")
                .select("r.doc_id", "r.text_sha256", "r.copies",
                        F.when(F.col("g.members").isNull(), F.col("r.doc_id")).otherwise(F.col("g.keep_id")).alias("keep_id"),
                        F.coalesce("g.group_size", "r.copies").alias("group_size"))
                .withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
        out = done if out is None else out.unionByName(done)
        if not more:
            return out
        left = (left.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).alias("d")
                .join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
                .alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
                                 & (normal_digest("d.text") == F.col("b.text_sha256")), "left_semi"))
        round_no += 1


def normal_digest(text: str) -> Column:
    """SHA-256 of the normalised text as a column."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), upper, upper.lower()), 256)


def exact_duplicates(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, modulus: int = MODULUS) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    d = decisions(docs, chunk_bytes, modulus)
    return (d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def drop_exact_duplicates(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows that stay, with all their columns."""
    return keep_rows(docs, decisions(docs, chunk_bytes).withColumnRenamed("text_sha256", "key"),
                     lambda d: d.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                        normal_digest("text").alias("key")))
