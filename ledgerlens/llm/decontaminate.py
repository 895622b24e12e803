"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.
A window is 13 consecutive words of a test item; an item of fewer words, but
not none, is one window. Every word of a document inside an occurrence of a
window is hit.

The windows are made on the executors and broadcast as a hash set: sent in
one block while they are at most ``BLOCK_WINDOWS``, else in several blocks of
at most about that many, each scanned in turn (the hits of a row accumulate;
no window is dropped). A scan keeps 64-bit hashes of windows whose words all
occur in the tests, looks them up and verifies each hit word by word. Whole texts are
scanned; documents are not shuffled.

Defined results: null and empty texts have no words and are never
contaminated; items without words have no window. A null item_id hits words
but isn't counted as an item. Rows that repeat a doc_id are judged row by row. Repeated items count
once. An empty benchmark hits nothing. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, kept, text_bytes, words

WINDOW = 13
BLOCK_WINDOWS = 200_000
PASSES_PER_TABLE = 4
HITS = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<long>"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, text)`` -> a row per different (item_id, window of words)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, grams = [], []
            for item, text in zip(column(b, "item_id").to_pylist(), text_bytes(b), strict=True):
                ws = words(text)
                k = min(window, len(ws))
                for i in range(len(ws) - k + 1 if k else 0):
                    ids.append(item)
                    grams.append(b" ".join(ws[i:i + k]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.string())], ["item_id", "gram"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(cut, "item_id long, gram string").distinct())


class WindowSet:
    """Windows of one block: vocabulary, hashes of word-id runs, and the items of each run."""

    def __init__(self, vocab: dict[bytes, int], items: dict[bytes, set], hashes: dict[int, np.ndarray]):
        self.vocab, self.items, self.hashes = vocab, items, hashes

    @classmethod
    def parts(cls, rows: Iterable[tuple[int | None, str]]) -> tuple:
        """What ``__init__`` takes, as plain values to broadcast."""
        vocab: dict[bytes, int] = {}
        items: dict[bytes, set] = {}
        by_len: dict[int, list[np.ndarray]] = {}
        for item, gram in rows:
            ids = np.array([vocab.setdefault(w, len(vocab) + 1) for w in gram.encode().split(b" ")], np.uint64)
            by_len.setdefault(len(ids), []).append(ids)
            items.setdefault(ids.tobytes(), set()).add(item)
        return vocab, items, {k: np.unique(np.concatenate([cls.runs(v, k) for v in vs])) for k, vs in by_len.items()}

    @staticmethod
    def runs(ids: np.ndarray, k: int) -> np.ndarray:
        h = np.zeros(len(ids) - k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j:len(ids) - k + 1 + j]
        return h

    def scan(self, ws: list[bytes], spans: list[tuple[int, int]], items: set) -> list[tuple[int, int]]:
        """Hit spans of the words, merged with ``spans``; adds to ``items``."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in ws], np.uint64)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        found = list(spans)
        for k, hashes in self.hashes.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            h = self.runs(ids, k)[at]
            near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)]
            for i in at[near == h].tolist():
                hit = self.items.get(ids[i:i + k].tobytes())      # every word compared
                if hit is not None:
                    items.update(hit)
                    found.append((i, i + k))
        return merged(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with n_words, hit_spans and hit_items."""
    spark = docs.sparkSession
    grams = kept(spark, windows(benchmark, window), "windows")
    blocks = max(1, -(-grams.count() // block_windows))
    grams = grams.withColumn("block", F.pmod(F.xxhash64("gram", "item_id"), F.lit(blocks)))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scanner(b):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rules = WindowSet(*b.value)
            for batch in batches:
                n, at, items = [], [], []
                for text, old, seen in zip(text_bytes(batch, "scan_text"), column(batch, "hit_spans").to_pylist(),
                                           column(batch, "hit_items").to_pylist(), strict=True):
                    ws, got = words(text), set(seen)
                    at.append([{"start": a, "end": z} for a, z in
                               rules.scan(ws, [(x["start"], x["end"]) for x in old], got)])
                    n.append(len(ws))
                    items.append(sorted(x for x in got if x is not None))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "row"), column(batch, "scan_text"), pa.array(n, pa.int64()),
                     pa.array(at, spans), pa.array(items, pa.list_(pa.int64()))],
                    ["row", "scan_text", "n_words", "hit_spans", "hit_items"])
        return scan

    out = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("scan_text"),
                      F.expr("cast(0 as bigint) n_words"), F.expr("cast(array() as array<struct<start:int,end:int>>) hit_spans"),
                      F.expr("cast(array() as array<bigint>) hit_items"))
    for k in range(blocks):
        part = (tuple(r) for r in grams.filter(F.col("block") == k).select("item_id", "gram").toLocalIterator())
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast(WindowSet.parts(part))), out.schema)
        if k % PASSES_PER_TABLE == PASSES_PER_TABLE - 1 and k + 1 < blocks:
            out = kept(spark, out, "scanned")
    return out


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return (found.withColumn("n_hit", n_hit)
            .withColumn("n_items", F.size("hit_items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.array_join(names, ","), 256))
            .withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs.select("doc_id", "text"), benchmark, window, block_windows)
    return judged(found).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, pos = [], 0
    for a, z in spans:
        out.append(text[pos:at[a][0]])
        pos = at[z - 1][1]
    return b"".join([*out, text[pos:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit spans cut from
    contaminated ones (``remove="spans"``); the columns stay."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    found = judged(hits(docs, benchmark, window, block_windows))
    if remove == "documents":
        return found.filter(~F.col("contaminated")).select("row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [without_words(t, [(x["start"], x["end"]) for x in s]).decode("utf-8", "replace") if bad else t and t.decode("utf-8", "replace")
                   for t, s, bad in zip(text_bytes(b, "scan_text"), column(b, "hit_spans").to_pylist(),
                                        column(b, "contaminated").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(new, pa.string())], ["row", "scan_text"])

    cut_rows = (found.select("row", "scan_text", "hit_spans", "contaminated")
                .mapInArrow(cut, found.select("row", "scan_text").schema))
    fields = [F.col("scan_text").alias(f.name) if f.name == "text" else F.col("row").getField(f.name).alias(f.name)
              for f in docs.schema.fields]
    return cut_rows.select(*fields)
