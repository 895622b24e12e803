"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A-Z) and cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at blanks and tabs. Of
every word position the next ``MAX_WORDS`` words, or those up to the end of its piece, are one path; a phrase occurs as often as paths
start with it. So one automaton of all paths, with the language as the first arc, holds the counts
of all phrases of 1 to ``MAX_WORDS`` words as sums of weights below a state.

1. Words. One pass counts the words of each language. A phrase that holds a word below the minimum count can be no candidate and no part of
   one, so such words end paths from here on. The others are marked in a bitmap of 16 bits a word, 2 MB at most, that goes to all tasks; a word marked by
   chance stays in and changes no count.
2. Shards. A task builds the automaton of ``SHARD_WORDS`` words at a time from their sorted paths: a new path adds the states in
   which it differs from the last one (``Transducer``: per depth arrays of arc labels, parents and final weights). It is cut
   into prefix ranges, which are shuffled as compressed bytes; a phrase that is frequent in a shard crosses once.
3. Union. One task per range merges its shards' automata, adds the weights of equal paths and sums them per state. States with the minimum
   count leave as rows, and so do those on the first and last path of the range, whose other part lies in a neighbour: these are few, and
   added up afterwards.
4. Composition. The rows are the states of the union automaton. Each candidate is cut in two in all ways, and both
   parts are composed with the automaton: a look-up of the states they lead to, as joins on language and phrase.

Ranges hold about ``RANGE_WORDS`` positions each, whatever first words are common: their bounds are paths of a sample, one position in
``SAMPLE_EVERY``, cut into equal parts by Spark's range partitioning. The bounds only spread the work. They go to all
tasks too: one path per range, at most ``MAX_RANGES``. Counts cover all texts.

Scores are exact: decimals of 38 digits hold 1000 * a * n and l * r up to counts of 10^17.

Defined results: null and empty texts have no words; a null language is ``und``. Rows are counted one by one, repeated ones and
null doc_ids too; doc_id is not read. An empty table gives no rows. Other columns are not read. Phrases of equal
score and count rank by their UTF-8 bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Bitmap, bitmap, column, kept, small_batches, text_bytes

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
SHARD_WORDS = 1 << 20
RANGE_WORDS = 1 << 20
SAMPLE_EVERY = 1 << 12
PORTION_BYTES = 1 << 22
HELD_WORDS = 200_000
MAX_RANGES = 1 << 17
# Fixed value: characters that end a piece; as words they would be empty, so one of them marks the cut.
_CUTS = b".,;:!?\n\x0b\x0c\r"
_CUT = b"."
_PIECES = bytes(b + 32 if 0x41 <= b <= 0x5A else _CUT[0] if b in _CUTS else b for b in range(256))

Path = tuple[bytes, ...]


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with ``.`` between pieces."""
    return (text or b"").translate(_PIECES).replace(_CUT, b" . ").split()


def portions(text: bytes | None, ahead: int, size: int = PORTION_BYTES) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Words of a text in portions cut at blanks, each with the first ``ahead`` words after it."""
    text, at = text or b"", 0
    held: list[bytes] = []
    while at < len(text):
        cut = len(text)
        if cut - at > size:
            cut = text.rfind(b" ", at + 1, at + size)
            cut = cut if cut > at else text.find(b" ", at + size)
            cut = cut if cut > at else len(text)
        ws = tokens(text[at:cut])
        at = cut
        if len(ws) < ahead and at < len(text):
            held += ws
            continue
        if held:
            yield held, ws[:ahead]
        held = ws
    if held:
        yield held, []


def _sorted_paths(rows: np.ndarray, counts: np.ndarray | None, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in order and the sum of their counts (or how often each occurs). Entries are -1 to ``labels`` - 1."""
    per_key = max(1, 63 // max(1, int(labels + 1).bit_length()))
    keys = []
    for c in range(0, rows.shape[1], per_key):
        key = np.zeros(len(rows), np.int64)
        for j in range(c, min(c + per_key, rows.shape[1])):
            key = key * (labels + 1) + (rows[:, j] + 1)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    firsts = np.flatnonzero(new)
    if counts is None:
        sums = np.diff(np.concatenate((firsts, [len(rows)])))
    else:
        sums = np.add.reduceat(counts[order], firsts) if len(firsts) else counts[:0]
    return rows[order[firsts]], sums.astype(np.int64)


class Transducer:
    """Acyclic automaton of paths: per depth the label and parent state of every state, in path order, and the weight of paths that end there.

    ``words`` are the labels' words in byte order; depth 0 holds languages.
    """

    def __init__(self, words: list[bytes], labels: list[np.ndarray], parents: list[np.ndarray], final: list[np.ndarray]):
        self.words, self.labels, self.parents, self.final = words, labels, parents, final

    @classmethod
    def of_sorted(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From different paths in order, filled up with -1: a path adds its states from the first that differs from the last path's."""
        if 8 * rows.size < len(words):
            used, at = np.unique(rows, return_inverse=True)
            gaps = int(used[0] < 0)
            used, rows = used[gaps:], at.reshape(rows.shape) - gaps
        else:
            mark = np.zeros(len(words) + 1, bool)
            mark[rows] = True
            used = np.flatnonzero(mark[:-1])
            rank = np.full(len(words) + 1, -1, np.int64)
            rank[used] = np.arange(len(used))
            rows = rank[rows]
        words = [words[i] for i in used.tolist()]
        labels, parents, final = [], [], []
        differs = np.zeros(len(rows), bool)
        differs[:1] = True
        above = np.zeros(len(rows), np.int64)
        for d in range(rows.shape[1]):
            differs[1:] |= rows[1:, d] != rows[:-1, d]
            new = differs & (rows[:, d] >= 0)
            state = np.cumsum(new) - 1
            labels.append(rows[new, d])
            parents.append(above[new])
            ends = (rows[:, d] >= 0) & ((rows[:, d + 1] < 0) if d + 1 < rows.shape[1] else True)
            weight = np.zeros(int(new.sum()), np.int64)
            weight[state[ends]] = counts[ends]
            final.append(weight)
            above = state
        return cls(words, labels, parents, final)

    def totals(self) -> list[np.ndarray]:
        """Weight of all paths through each state, by depth."""
        out = [w.copy() for w in self.final]
        for d in range(len(out) - 1, 0, -1):
            np.add.at(out[d - 1], self.parents[d], out[d])
        return out

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths with their weights, as rows filled up with -1, in no order."""
        rows, counts, above = [], [], np.zeros((1, 0), np.int32)
        depth = len(self.labels)
        for d in range(depth):
            here = np.hstack([above[self.parents[d]], self.labels[d][:, None].astype(np.int32)])
            ends = np.flatnonzero(self.final[d])
            rows.append(np.hstack([here[ends], np.full((len(ends), depth - d - 1), -1, np.int32)]))
            counts.append(self.final[d][ends])
            above = here
        return np.concatenate(rows), np.concatenate(counts)

    def path(self, depth: int, state: int) -> Path:
        out = []
        for d in range(depth, -1, -1):
            out.append(self.words[self.labels[d][state]])
            state = self.parents[d][state]
        return tuple(out[::-1])

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """One automaton of all paths; weights of equal ones are added."""
        if len(parts) == 1:
            return parts[0]
        words = sorted(set().union(*(p.words for p in parts)))
        rank = {w: i for i, w in enumerate(words)}
        rows, counts = [], []
        for p in parts:
            own = np.array([*map(rank.__getitem__, p.words), -1], np.int32)
            r, c = p.paths()
            rows.append(own[r])
            counts.append(c)
        return cls.of_sorted(words, *_sorted_paths(np.concatenate(rows), np.concatenate(counts), len(words)))

    def to_bytes(self) -> bytes:
        """Numbers go as planes of their low, second ... bytes, which compress far better than the numbers in a row."""
        parts = [b"".join(self.words), _planes(np.array([len(w) for w in self.words]), "<u4")]
        for x, p, w in zip(self.labels, self.parents, self.final, strict=True):
            parts += [_planes(x, "<u4"), _planes(np.diff(p, prepend=0), "<u4"), _planes(w, "<i8")]
        return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def of_bytes(cls, data: bytes) -> Transducer:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8).tolist()
        parts, at = [], 8 + 8 * n
        for size in sizes:
            parts.append(data[at:at + size])
            at += size
        ends = np.cumsum(_numbers(parts[1], "<u4")).tolist()
        words = [parts[0][a:z] for a, z in zip([0, *ends], ends, strict=False)]
        rest = parts[2:]
        return cls(words, [_numbers(x, "<u4") for x in rest[::3]], [np.cumsum(_numbers(x, "<u4")) for x in rest[1::3]],
                   [_numbers(x, "<i8") for x in rest[2::3]])


def _planes(x: np.ndarray, kind: str) -> bytes:
    a = x.astype(kind)
    return a.view("u1").reshape(-1, a.dtype.itemsize).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, "u1").reshape(size, -1).T.copy().view(kind).ravel().astype(np.int64)


class Shard:
    """Words of texts as numbers, until there are enough for an automaton; words that ``frequent`` knows are rare count as cuts."""

    def __init__(self, max_words: int, frequent: Bitmap | None = None):
        self.max_words, self.frequent = max_words, frequent
        self.numbers: dict[bytes, int] = {}
        self.known: dict[bytes, dict[bytes, int]] = {}
        self.ids: list[np.ndarray] = []
        self.langs: list[tuple[int, int]] = []
        self.starts: list[np.ndarray] = []
        self.size = 0

    def _number(self, word: bytes) -> int:
        return self.numbers.setdefault(word, len(self.numbers))

    def add(self, lang: bytes, ws: list[bytes], ahead: list[bytes]) -> None:
        """Words whose paths count, and those after them that paths may end with."""
        known, both = self.known.setdefault(lang, {_CUT: -1}), ws + ahead
        for w in set(both).difference(known):
            known[w] = self._number(w) if self.frequent is None or _key(lang, w) in self.frequent else -1
        ids = np.fromiter(map(known.__getitem__, both), np.int32, len(both))
        self.ids += [ids, np.array([-1], np.int32)]
        self.starts += [ids[:len(ws)] >= 0, np.zeros(len(ahead) + 1, bool)]
        self.langs.append((self._number(lang), len(ids) + 1))
        self.size += len(ws)

    def paths(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words in byte order, different paths in order, and how often each occurs."""
        words = sorted(self.numbers)
        rank = np.full(len(words) + 1, -1, np.int32)
        for i, w in enumerate(words):
            rank[self.numbers[w]] = i
        flat = rank[np.concatenate([*self.ids, np.full(self.max_words, -1, np.int32)])]
        lang = rank[np.repeat([x for x, _ in self.langs], [k for _, k in self.langs])]
        here = np.flatnonzero(np.concatenate(self.starts))
        rows = np.empty((len(here), self.max_words + 1), np.int32)
        rows[:, 0], rows[:, 1] = lang[here], flat[here]
        for j in range(1, self.max_words):
            rows[:, j + 1] = np.where(rows[:, j] >= 0, flat[here + j], -1)
        return words, *_sorted_paths(rows, None, len(words))


def cut(words: list[bytes], rows: np.ndarray, bounds: list[Path]) -> list[int]:
    """For each bound the number of sorted rows before it."""
    out = []
    for bound in bounds:
        code = []
        for w in bound:
            k = bisect_left(words, w)
            known = k < len(words) and words[k] == w
            code.append(k if known else k - 0.5)
            if not known:
                break
        out.append(bisect_left(range(len(rows)), code, key=lambda i, n=len(code): rows[i, :n].tolist()))
    return out


def _key(lang: bytes, word: bytes) -> bytes:
    return lang + b"\t" + word


def word_counts(docs: DataFrame, max_words: int = MAX_WORDS, every: int = SAMPLE_EVERY) -> DataFrame:
    """``(lang, words, n)``: counts of single words per task, and with n = 0 the path of one position in ``every``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, {}

        def rows(langs: list[bytes], words: list[list[bytes]], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(n, pa.int64())],
                                              ["lang", "words", "n"])

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(_CUT, None)
                yield rows([lang] * len(c), [[w] for w in c], list(c.values()))
            held.clear()

        for b in batches:
            langs, out = [], []
            for lang, text in zip(text_bytes(b, "lang"), text_bytes(b), strict=True):
                for ws, _ in portions(text, 0):
                    held.setdefault(lang, Counter()).update(ws)
                    while at < len(ws):
                        own = ws[at:at + max_words]
                        own = own[:own.index(_CUT)] if _CUT in own else own
                        if own:
                            langs.append(lang)
                            out.append(own)
                        at += every
                    at -= len(ws)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from counted()
            yield rows(langs, out, [0] * len(out))
        yield from counted()

    return docs.mapInArrow(count, "lang binary, words array<binary>, n long")


def range_bounds(sample: DataFrame, range_words: int = RANGE_WORDS, every: int = SAMPLE_EVERY) -> list[Path]:
    """First paths of the ranges but the first, in order; at most ``MAX_RANGES``."""
    ranges = min(max(1, -(-sample.count() * every // range_words)), MAX_RANGES)
    if ranges == 1:
        return []
    firsts = (sample.repartitionByRange(ranges, "lang", "words").groupBy(F.spark_partition_id())
              .agg(F.min(F.struct("lang", "words")).alias("p")).select("p.*").collect())
    return sorted({(bytes(r.lang), *map(bytes, r.words)) for r in firsts})[1:]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def states(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS,
           range_words: int = RANGE_WORDS, every: int = SAMPLE_EVERY) -> DataFrame:
    """``(lang, phrase, size, f)`` of every phrase of up to ``max_words`` words with the minimum count; size 0 is the language."""
    spark, texts = docs.sparkSession, _texts(docs)
    small_batches(spark)
    first = kept(spark, word_counts(texts, max_words, every), "words")
    counts = first.filter("n > 0").groupBy("lang", F.col("words")[0].alias("word")).agg(F.sum("n").alias("n"))
    counts = kept(spark, counts, "counts")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("f"))
    marks = bitmap(spark, counts.filter(F.col("n") >= min_count).select(F.concat("lang", F.lit(b"\t"), "word").cast("string")))
    bounds = range_bounds(first.filter("n = 0").select("lang", "words"), range_words, every)
    sent = spark.sparkContext.broadcast(bounds)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, frequent = zstandard.ZstdCompressor(level=3), Bitmap(marks.value)

        def parts() -> Iterator[pa.RecordBatch]:
            words, rows, counts = shard.paths()
            ends = [0, *cut(words, rows, sent.value), len(rows)]
            for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if a < z:
                    part = press.compress(Transducer.of_sorted(words, rows[a:z], counts[a:z]).to_bytes())
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["range", "part"])

        shard = Shard(max_words, frequent)
        for b in batches:
            for lang, text in zip(text_bytes(b, "lang"), text_bytes(b), strict=True):
                for ws, ahead in portions(text, max_words - 1):
                    shard.add(lang, ws, ahead)
                    if shard.size >= shard_words:
                        yield from parts()
                        shard = Shard(max_words, frequent)
        if shard.size:
            yield from parts()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            whole = Transducer.union(held)
            totals = whole.totals()
            out = []
            for d, total in enumerate(totals[1:], 1):
                leave = total >= min_count
                leave[:1] = leave[-1:] = True       # holds the states of the first and last path
                out += [(whole.path(d, i), int(total[i])) for i in np.flatnonzero(leave).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p, _ in out], pa.binary()), pa.array([b" ".join(p[1:]) for p, _ in out], pa.binary()),
                                               pa.array([len(p) - 1 for p, _ in out], pa.int32()), pa.array([f for _, f in out], pa.int64())],
                                              ["lang", "phrase", "size", "f"])

        held: list[Transducer] = []
        size, last = 0, None
        for b in batches:
            for number, part in zip(column(b, "range").to_pylist(), column(b, "part").to_pylist(), strict=True):
                if number != last and held:
                    yield done()
                    held, size = [], 0
                last = number
                held.append(Transducer.of_bytes(opened.decompress(part)))
                size += sum(map(len, held[-1].labels))
                if size > 8 * range_words:
                    held = [Transducer.union(held)]
                    size = sum(map(len, held[-1].labels))
        if held:
            yield done()

    pieces = (texts.mapInArrow(shards, "range int, part binary").repartition(len(bounds) + 1, "range").sortWithinPartitions("range"))
    rows = pieces.mapInArrow(unite, "lang binary, phrase binary, size int, f long")
    found = rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)
    return (found.unionByName(langs.select("lang", F.lit(b"").alias("phrase"), F.lit(0).alias("size"), "f"))
            .select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "size", "f"))


def scored(found: DataFrame) -> DataFrame:
    """Every candidate of the states with its lowest-scoring cut: lang, phrase, size, a, l, r, n, score."""
    langs = found.filter("size = 0").select("lang", F.col("f").alias("n"))
    part = found.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("weight"))
    cuts = (found.filter("size > 1").withColumnRenamed("f", "a").withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
            .withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")}))
    for side, weight in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.select("lang", F.col("part").alias(side), F.col("weight").alias(weight)), ["lang", side])
    big = "cast({} as decimal(19,0))"
    score = F.expr(f"({big.format('1000 * a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')})")
    best = (cuts.join(langs, "lang").withColumn("score", score)
            .groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")))
    return best.select("lang", "phrase", "size", "a", "c.l", "c.r", "n", "c.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, **sizes: int) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = kept(docs.sparkSession, states(docs, max_words, min_count, **sizes), "states")
    # a phrase inside a longer one of the same count is also inside one that is a word longer and has that count
    longer = (found.filter("size > 2").select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    alone = (scored(found).join(longer, ["lang", "phrase"], "left")
             .filter(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (alone.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
