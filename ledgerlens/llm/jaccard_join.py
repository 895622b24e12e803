"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (fewer words, but not none: one
shingle); two texts are linked when their sets' Jaccard similarity is 0.8 or more.

1. Texts with equal sets form a class; the join works on classes, so copies
   are never expanded into pairs.
2. Each class has 128 MinHash values (16 bits of each are kept). Classes that
   agree on the four values of one of 32 bands are candidates: a pair at 0.8 is
   missed with probability (1 - 0.8^4)^32 = 5e-8.
3. A band's bucket is compared within a task, in blocks of at most about
   ``BLOCK`` classes; a larger bucket is dealt as pairs of blocks. A pair is
   looked at in the first band it shares. MinHash values are compared 32 at a time, and
   a pair is dropped once the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below ``TOLERANCE``. A block gives the classes that
   have a surviving pair in it, at most a row each; no pair leaves the task.
4. Survivors are verified exactly: texts and signatures of those classes are sent to
   their block, which prunes again (the same pairs are left), compares the sets, and
   returns each class's number of links and a spanning forest.
5. Documents get the smallest doc_id of their connected component as class_id.

Defined results: null texts count as empty. Texts without words have no shingles: they
are linked to equal texts only. A null doc_id is passed over where another id can name
the class. Repeated rows count as documents. Rows with one doc_id and other texts are separate. An
empty table gives no rows. Extra columns are carried by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordHash, column, components, keep_rows, kept, ngram_hashes, text_bytes, words

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BAND_ROWS = 4
BANDS = HASHES // BAND_ROWS
STEP = 32                  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 512                # classes of a block
BLOCK_SHINGLES = 2_000_000


def posterior_cut(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches of ``n`` with which a pair stays.

    With a uniform prior, P(similarity >= t | m of n match) is
    P(Binomial(n + 1, t) <= m).
    """
    total, m = 0.0, -1
    while total < tolerance:
        m += 1
        total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
    return m


class MinHash:
    def __init__(self, seed: int = 20_011):
        rnd = np.random.default_rng(seed)
        self.a = rnd.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rnd.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)

    def signature(self, shingles: np.ndarray) -> bytes:
        """16 bits of each MinHash value."""
        x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
        low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (x[at:at + 2048, None] * self.a + self.b).min(axis=0), out=low)
        return ((low * np.uint32(2654435761)) >> np.uint32(16)).astype("<u2").tobytes()


def shingles_of(text: bytes | None, memo: WordHash) -> np.ndarray:
    return np.unique(ngram_hashes(memo.of(words(text)), SHINGLE))


def set_id(text: bytes | None, shingles: np.ndarray) -> bytes:
    """Digest of the shingle set; of the text itself where it has no words."""
    if len(shingles):
        return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(text or b"", digest_size=16, person=b"no words").digest()


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, set_id, n_shingles, sig (null without words)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, minhash = WordHash(), MinHash()
        for b in batches:
            ids, sizes, sigs = [], [], []
            for text in text_bytes(b):
                s = shingles_of(text, memo)
                ids.append(set_id(text, s))
                sizes.append(len(s))
                sigs.append(minhash.signature(s) if len(s) else None)
            memo.trim()
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "set_id", "n_shingles", "sig"])

    return _ids(docs).mapInArrow(sketch, "doc_id long, set_id binary, n_shingles long, sig binary")


def blocks(classes: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """A row per class and pair of blocks in which it is compared."""
    spark = classes.sparkSession
    bands = classes.filter("sig is not null").select(
        "set_id", "n_shingles", F.posexplode(F.array(*[F.expr(f"substring(sig, {2 * BAND_ROWS * i + 1}, {2 * BAND_ROWS})")
                                                       for i in range(BANDS)])).alias("band", "values"))
    bands = bands.select("set_id", "n_shingles", "band", F.xxhash64("band", "values").alias("bucket"))
    full = kept(spark, bands.groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("n"))
                .filter("m > 1")
                .select("band", "bucket", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("n") / block_shingles)).cast("int").alias("parts")),
                "buckets")
    rows = bands.join(full, ["band", "bucket"]).withColumn("part", F.pmod(F.xxhash64("set_id", "bucket"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("set_id", "band", "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                       (F.col("part") > F.col("other")).cast("int").alias("side"))


BLOCK_KEY = ["band", "bucket", "lo", "hi"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with one block key, over batch ends."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [column(b, c).to_numpy() for c in BLOCK_KEY]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        ends = [0, *cut.tolist(), b.num_rows]
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            k = tuple(int(c[a]) for c in cols)
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(b.slice(a, z - a))
    if held:
        yield key, held


def surviving(sigs: np.ndarray, side: np.ndarray, band: int, cross: bool, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows left after all steps, looked at in the first band they share."""
    left = np.flatnonzero(side == 0) if cross else np.arange(len(sigs))
    right = np.flatnonzero(side == 1) if cross else left
    end, least = cuts[0]
    same = np.zeros((len(left), len(right)), np.uint8)
    for i in range(end):
        same += sigs[left, None, i] == sigs[None, right, i]
    p, q = np.nonzero(same >= least)
    count = same[p, q].astype(np.int32)
    p, q = left[p], right[q]
    if not cross:
        up = p < q
        p, q, count = p[up], q[up], count[up]
    start = end
    for end, least in cuts[1:]:
        for at in range(0, len(p), 65_536):
            count[at:at + 65_536] += (sigs[p[at:at + 65_536], start:end] == sigs[q[at:at + 65_536], start:end]).sum(axis=1)
        stay = count >= least
        p, q, count, start = p[stay], q[stay], count[stay], end
    if band and len(p):
        packed = np.ascontiguousarray(sigs).view("<u8")
        first = ~(packed[p, :band] == packed[q, :band]).any(axis=1)
        p, q = p[first], q[first]
    return p, q


def _cuts(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    return [(n, posterior_cut(n, threshold, tolerance)) for n in range(STEP, HASHES + 1, STEP)]


def _block_pairs(key: tuple, held: list[pa.RecordBatch], cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of one block's rows, as positions."""
    sigs = np.frombuffer(b"".join(x for b in held for x in column(b, "sig").to_pylist()), "<u2").reshape(-1, HASHES)
    side = np.concatenate([column(b, "side").to_numpy() for b in held])
    return surviving(sigs, side, key[0], key[2] != key[3], cuts)


def candidates(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Blocks with signatures -> the block's classes that have a surviving pair in it."""
    cuts = _cuts(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*BLOCK_KEY, "set_id", "side"]
        for key, held in _groups(batches):
            if sum(b.num_rows for b in held) < 2:
                continue
            p, q = _block_pairs(key, held, cuts)
            if len(p):
                block = pa.Table.from_batches(held).select(names).take(pa.array(np.union1d(p, q)))
                yield from block.combine_chunks().to_batches()

    return (rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
            .mapInArrow(compare, "band int, bucket long, lo int, hi int, set_id binary, side int"))


def verified(found: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, tolerance: float, pairs: bool = False) -> DataFrame:
    """Exact check of the survivors: a row per block and linked class with its
    links and a root of its tree, or with its partners and similarities."""
    cuts = _cuts(threshold, tolerance)
    reps = classes.select("set_id", "sig", "copies", "rep_id").join(found.select("set_id").distinct(), "set_id", "left_semi")
    memo_text = (_ids(docs).alias("d").join(reps.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.rep_id")))
                 .select("r.set_id", "r.sig", "r.copies", "d.text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in batches:
            right = [set_id(t, shingles_of(t, memo)) == s
                     for t, s in zip(text_bytes(b), column(b, "set_id").to_pylist(), strict=True)]
            memo.trim()
            yield b.filter(pa.array(right, pa.bool_()))

    # other texts under the doc_id of a class are passed over; equal ones count once
    texts = memo_text.mapInArrow(own, memo_text.schema).groupBy("set_id", "sig", "copies").agg(F.min("text").alias("text"))
    rows = found.join(texts, "set_id")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for key, held in _groups(batches):
            ids = [x for b in held for x in column(b, "set_id").to_pylist()]
            copies = [x for b in held for x in column(b, "copies").to_pylist()]
            sets = [shingles_of(t, memo) for b in held for t in text_bytes(b)]
            root: dict[bytes, bytes] = {}
            links: dict[bytes, int] = {}
            out = []

            def find(x: bytes) -> bytes:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, k in zip(*(x.tolist() for x in _block_pairs(key, held, cuts)), strict=True):
                j = jaccard(sets[i], sets[k])
                if j < threshold:
                    continue
                if pairs:
                    out.append((ids[i], ids[k], j))
                    continue
                links[ids[i]] = links.get(ids[i], 0) + copies[k]
                links[ids[k]] = links.get(ids[k], 0) + copies[i]
                a, z = find(ids[i]), find(ids[k])
                root[max(a, z)] = min(a, z)
            memo.trim()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()),
                                                  pa.array([x[2] for x in out], pa.float64())], ["set_id", "other", "jaccard"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(list(links), pa.binary()), pa.array(list(links.values()), pa.int64()),
                                                  pa.array([find(x) for x in links], pa.binary())], ["set_id", "links", "root"])

    return (rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
            .mapInArrow(check, "set_id binary, other binary, jaccard double" if pairs else "set_id binary, links long, root binary"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


class Join:
    """Tables of one join: rows, classes and surviving candidates, kept on shared storage."""

    def __init__(self, docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
                 block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES):
        spark = docs.sparkSession
        self.docs, self.threshold, self.tolerance = docs, threshold, tolerance
        self.rows = kept(spark, sketches(docs), "sketches")
        self.classes = kept(spark, self.rows.groupBy("set_id", "n_shingles", "sig")
                            .agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep_id")), "classes")
        rows = blocks(self.classes, block, block_shingles).join(self.classes.select("set_id", "sig"), "set_id")
        self.found = kept(spark, candidates(rows, threshold, tolerance), "candidates")

    def pairs(self) -> DataFrame:
        """Linked classes: set_id, other, jaccard (each pair once)."""
        return verified(self.found, self.classes, self.docs, self.threshold, self.tolerance, pairs=True)

    def classed(self) -> DataFrame:
        """A row per class with links: set_id, class_id, links (documents of other classes)."""
        spark = self.docs.sparkSession
        seen = kept(spark, verified(self.found, self.classes, self.docs, self.threshold, self.tolerance), "verified")
        label = components(seen.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
        named = label.join(self.classes.select(F.col("set_id").alias("node"), "rep_id"), "node")
        least = named.groupBy("label").agg(F.min("rep_id").alias("class_id"))
        links = seen.groupBy("set_id").agg(F.sum("links").alias("links"))
        return kept(spark, links.join(label.withColumnRenamed("node", "set_id"), "set_id").join(least, "label")
                    .select("set_id", "class_id", "links"), "classed")

    def documents(self) -> DataFrame:
        """A row per document: doc_id, set_id, class_id, n_links, n_copies, n_shingles."""
        c = self.classes.join(self.classed(), "set_id", "left").select(
            "set_id", F.coalesce("class_id", "rep_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        c = kept(self.docs.sparkSession, c, "class_table")
        return (self.rows.select("doc_id", "set_id", "n_shingles").join(c, "set_id")
                .select("doc_id", "set_id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"),
                        F.col("copies").alias("n_copies"), "n_shingles"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, class_id, n_links (documents at the threshold or above, copies too), n_copies, n_shingles."""
    return Join(docs, threshold).documents().drop("set_id")


def similar_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The join's pairs between class representatives: doc_id, other_id, jaccard."""
    j = Join(docs, threshold)
    name = j.classes.select("set_id", F.col("rep_id").alias("doc_id"))
    other = j.classes.select(F.col("set_id").alias("other"), F.col("rep_id").alias("other_id"))
    return j.pairs().join(name, "set_id").join(other, "other").select(
        F.least("doc_id", "other_id").alias("doc_id"), F.greatest("doc_id", "other_id").alias("other_id"), "jaccard")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with all its columns."""
    d = Join(docs, threshold).documents()
    d = (d.groupBy("doc_id", F.col("set_id").alias("key"), "class_id").agg(F.count("*").alias("copies"))
         .withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id"))).drop("class_id"))

    def keyed(part: DataFrame) -> DataFrame:
        rows = part.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = WordHash()
            for b in batches:
                ids = [set_id(t, shingles_of(t, memo)) for t in text_bytes(b)]
                yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "doc_id"), pa.array(ids, pa.binary())], ["row", "doc_id", "key"])

        kind = rows.select("row", "doc_id", F.lit(b"").alias("key")).schema
        return rows.mapInArrow(key, kind)

    return keep_rows(docs, d, keyed)
