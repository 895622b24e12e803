"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q and at least max(``MIN_WORDS``, ``MIN_PERIODS`` * q)
words that no neighbouring word extends keeping the period. A word of a run occurs in it three times or more, and for q > h
every run of h words in it twice or more. So:

1. Splitting. A word that occurs too rarely within its segment can be in no run of the segment and splits it; the
   parts are counted anew, until nothing changes. Whole texts start as segments.
2. The same with pairs, fours, eights ... of words (h = 2, 4, 8 ...; a group of 2h is a pair of groups of h), each time
   for the periods above h. Prose is gone after a few rounds, and every round leaves less.
3. Lag scan. For periods from h + 1 to 2h each group of 2h words of the surviving segments is compared with its next
   occurrence in its segment. Within a run of smallest period q that is q words on, as less would be a smaller period. Stretches of one such
   lag are widened to where words q apart differ, and kept if long enough.

All of it is exact: words and groups are numbered, never hashed. Texts are worked on together, ``GROUP_WORDS`` words at a time,
a longer text alone; work is n log n of its words whatever its periods. There is no shuffle.

Defined results: null and empty texts have no words, no runs, null columns for the greatest run and the digest of the empty string.
Rows that repeat are judged one by one. Null doc_ids are kept. An empty table gives no rows. Other columns are not read by
``periodic_runs``; ``collapse`` passes them through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, text_bytes

MIN_WORDS = 24
MIN_PERIODS = 3
GROUP_WORDS = 200_000


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each different tuple of the columns, and how often each number occurs. Columns hold 0 to 2**31."""
    out = keys[0].astype(np.int64)
    counts = None
    for k in (*keys[1:], None):
        if k is not None:
            out = out * (int(k.max(initial=0)) + 1) + k
        _, out, counts = np.unique(out, return_inverse=True, return_counts=True)
    return out, counts


class Segments:
    """Surviving group starts: text position, segment, and the number of the group of ``h`` words that starts there."""

    def __init__(self, at: np.ndarray, seg: np.ndarray, group: np.ndarray, h: int):
        self.at, self.seg, self.group, self.h = at, seg, group, h

    def split(self, least: int) -> None:
        """Groups that occur fewer than ``least`` times in their segment split it, until none is left.

        A stretch of k starts spans k + h - 1 words; those too short for a run of a period above h - 1 go too.
        """
        need = max(MIN_WORDS, MIN_PERIODS * self.h)
        while len(self.at):
            key, counts = _numbered(self.seg, self.group)
            stay = counts[key] >= least
            cut = np.ones(len(self.at), bool)
            cut[1:] = (self.seg[1:] != self.seg[:-1]) | (self.at[1:] != self.at[:-1] + 1) | ~stay[1:] | ~stay[:-1]
            piece = np.cumsum(cut) - 1
            sizes = np.bincount(piece)
            stay &= (sizes + self.h - 1 >= need)[piece]
            if stay.all() and np.array_equal(cut[1:], self.seg[1:] != self.seg[:-1]):
                return
            self.at, self.seg, self.group = self.at[stay], piece[stay], self.group[stay]

    def doubled(self) -> Segments:
        """Groups of 2h words: each of h with the one that starts h words on in the same segment."""
        n = len(self.at)
        on = np.arange(n) + self.h
        ok = on < n
        ok[ok] = self.seg[on[ok]] == self.seg[ok]
        here = np.flatnonzero(ok)
        group = _numbered(self.group[here], self.group[here + self.h])[0] if len(here) else here
        return Segments(self.at[here], self.seg[here], group, 2 * self.h)

    def lags(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """(position, lag) of the first of every stretch long enough whose groups come again ``lag`` words on, low < lag <= high."""
        if len(self.at) < 2:
            return
        order = np.lexsort((self.at, self.group, self.seg))
        at, seg, group = self.at[order], self.seg[order], self.group[order]
        lag = np.zeros(len(at), np.int64)
        again = (seg[1:] == seg[:-1]) & (group[1:] == group[:-1])
        lag[order[:-1][again]] = (at[1:] - at[:-1])[again]
        ok = (lag > low) & (lag <= high)
        first = np.ones(len(ok), bool)
        first[1:] = ~(ok[1:] & ok[:-1] & (lag[1:] == lag[:-1]) & (self.at[1:] == self.at[:-1] + 1))
        here = np.flatnonzero(first)
        sizes = np.diff(np.concatenate((here, [len(ok)])))
        # a run of n words has n - lag - h + 1 such groups in a row
        enough = ok[here] & (sizes > np.maximum(MIN_WORDS, MIN_PERIODS * lag[here]) - lag[here] - self.h)
        yield from zip(self.at[here[enough]].tolist(), lag[here[enough]].tolist(), strict=True)


def _reach(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """First position from ``at`` on whose word differs from the one ``lag`` on, or the last one that has one."""
    size = 64
    while at + lag < end:
        high = min(at + size, end - lag)
        differs = words[at:high] != words[at + lag:high + lag]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, size = high, size * 4
    return at


def _back(words: np.ndarray, at: int, lag: int, start: int) -> int:
    """First position of the stretch before ``at`` whose words equal those ``lag`` on."""
    size = 64
    while at > start:
        low = max(at - size, start)
        differs = (words[low:at] != words[low + lag:at + lag])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return at - k
        at, size = low, size * 4
    return at


def runs(words: np.ndarray, sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) by start and period of each of the texts whose word numbers lie end to end in ``words``."""
    ends = np.cumsum(np.asarray(sizes, np.int64))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    text = np.repeat(np.arange(len(sizes)), sizes)
    found: set[tuple[int, int]] = set()

    def scan(s: Segments, low: int, high: int) -> None:
        last: dict[int, int] = {}
        for at, lag in s.lags(low, high):
            if at < last.get(lag, -1):
                continue                       # inside a stretch of that lag that was widened already
            t = int(text[at])
            begin, end = int(ends[t] - sizes[t]), int(ends[t])
            stop = _reach(words, at, lag, end)
            start = _back(words, at, lag, begin)
            last[lag] = stop
            length = stop + lag - start
            if length >= max(MIN_WORDS, MIN_PERIODS * lag) and (start, lag) not in found:
                found.add((start, lag))
                out[t].append((start - begin, length, lag))

    s = Segments(np.arange(len(words)), text, words, 1)
    s.split(MIN_PERIODS)
    scan(s, 0, 1)
    while len(s.at):
        double = s.doubled()
        scan(double, s.h, 2 * s.h)
        double.split(MIN_PERIODS - 1)
        s = double
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word lies in a run behind that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text made periodic from some word on, for a tenth of the doc_ids; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


Plant = Callable[[int | None, int], "np.ndarray | None"]


def text_runs(texts: list[bytes | None], ids: list[int | None], plant: Plant | None = None) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs of each text and its kept words joined by one blank, in order."""
    def done() -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
        flat = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
        for (ws, x), found in zip(held, runs(flat, [len(x) for _, x in held]), strict=True):
            if found:
                keep = np.flatnonzero(~dropped(len(x), found)).tolist()
                ws = [ws[i] for i in keep]
            yield found, b" ".join(ws)

    numbers, held, size = _Numbers(), [], 0
    for text, doc_id in zip(texts, ids, strict=True):
        ws = (text or b"").split()
        moved = plant(doc_id, len(ws)) if plant else None
        if moved is not None:
            ws = [ws[i] for i in moved.tolist()]
        held.append((ws, np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws))))
        size += len(ws)
        if size > GROUP_WORDS:
            yield from done()
            numbers, held, size = _Numbers(), [], 0
    yield from done()


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; of equal ones the smallest start, then period."""
    best = None
    for r in sorted(found, key=lambda x: (x[0], x[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_runs(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """A row per document: doc_id, n_runs, the greatest run, and digests of all runs and of the collapsed text."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for found, collapsed in text_runs(text_bytes(b), column(b, "plant_id").to_pylist(), plant):
                top = greatest(found)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
                rows.append((len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                             hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.string()) for c in cols[5:]]],
                                             ["doc_id", *names])

    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("plant_id"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", *[F.lit(None).cast("long").alias(c) for c in names[:5]], *[F.lit("").alias(c) for c in names[5:]]).schema
    return rows.mapInArrow(find, schema)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with every run in ``text`` cut to its first period; texts without a run stay as they are."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b, "run_text")
            out = [c.decode("utf-8", "replace") if found else None for found, c in text_runs(texts, [None] * len(texts))]
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(out, pa.string())], ["row", "collapsed"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("run_text"))
    out = rows.mapInArrow(cut, rows.select("row", F.lit(None).cast("string").alias("collapsed")).schema)
    return out.select(*[F.coalesce("collapsed", F.col("row.text")).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
