"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded as
hashed bag-of-words counts, hashed word shapes and surface statistics (repeats, capitals,
symbols, lengths), and a learned layer turns that into a vector. Gated attention,
learned from document labels alone, weighs the passages:
``a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k)))``; the score is a logistic
function of the weighted sum of passage vectors.

Training uses a bounded sample, ``TRAIN_DOCS`` labelled rows in a hashed
order, half of each label, and of the labelled rows only those outside the held-out
fold: crc32(doc_id as text) mod 4 is not 2. The features of all their passages are made and kept in a table,
in slots of about ``SLOT_BYTES`` that each hold whole documents. Every epoch is a job over the slots: a task takes gradient steps
over the batches of its slot, ``STEP_PASSAGES`` at a time, from the weights that all start with, and the results are averaged by the
slots' documents. The driver holds nothing but weights, some 100 kB a slot. Scoring reads whole texts of all documents in one narrow pass.

Defined results: null and empty texts are one passage without words and get
the score of that. Labels other than 0 and 1, and null ones, are not learned from. Without labels of both
kinds every score is the share of 1 (0.5 without any). Repeated rows are scored row by row. A label
given several times counts once, at its smallest. Extra columns pass through ``keep_good``.
Label, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import MEMO_WORDS, column, kept, text_bytes

PASSAGE_WORDS = 64
WORD_BUCKETS = 192
SHAPE_BUCKETS = 48
TRAIN_DOCS = 4000
STEP_PASSAGES = 1 << 15
HIDDEN = 24
GATES = 12
EPOCHS = 30
THRESHOLD = 0.7
PIECE_BYTES = 1 << 20
GROUP_BYTES = 2 << 20
SCORED_ROWS = 1000
SLOT_BYTES = 32 << 20
MIN_SLOTS = 4
STATS = 12
FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + STATS
_SHAPE = bytes(ord("A") if 0x41 <= b <= 0x5A else ord("a") if 0x61 <= b <= 0x7A or b >= 0x80 else ord("0") if 0x30 <= b <= 0x39 else b
               for b in range(256))



class Tokens(dict):
    """Token -> row of a table of its properties, remembered per task (bounded, see ``trim``)."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((1024, 9), np.float32)
        self.waiting: list[tuple] = []
        self.done = 0

    def props(self) -> np.ndarray:
        """The table; tokens met since the last call are added to it and held there alone."""
        n = self.done + len(self.waiting)
        if n > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((2 * n - len(self.table), 9), np.float32)])
        if self.waiting:
            self.table[self.done:n] = self.waiting
            self.waiting, self.done = [], n
        return self.table[:n]

    def __missing__(self, token: bytes) -> int:
        shape = token.translate(_SHAPE)
        n = len(token)
        upper, lower, digit = shape.count(b"A"), shape.count(b"a"), shape.count(b"0")
        brief = shape if n < 5 else shape[:2] + shape[-2:]
        self.waiting.append((xxhash.xxh3_64_intdigest(token.lower()) % WORD_BUCKETS,
                             WORD_BUCKETS + xxhash.xxh3_64_intdigest(brief) % SHAPE_BUCKETS,
                             min(n, 40), upper, lower, digit, n - upper - lower - digit,
                             float(upper > 1 and not lower), float(not (upper or lower or digit))))
        self[token] = k = self.done + len(self.waiting) - 1
        return k

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.table, self.waiting, self.done = np.zeros((1024, 9), np.float32), [], 0


def passages(texts: list[bytes | None], tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and each passage's text number."""
    ids = []
    for t in texts:
        ws = (t or b"").split()
        ids.append(np.fromiter(map(tokens.__getitem__, ws), np.int64, len(ws)))
    n_words = np.array([len(x) for x in ids], np.int64)
    n_pass = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    owner = np.repeat(np.arange(len(texts)), n_pass)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    total = int(n_pass.sum())
    x = np.zeros((total, FEATURES), np.float32)
    if not len(flat):
        return x, owner
    nth = np.arange(total) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)      # of its text
    size = np.clip(n_words[owner] - nth * PASSAGE_WORDS, 0, PASSAGE_WORDS)      # words of each passage
    full = np.flatnonzero(size)
    size = size[full]
    starts = np.cumsum(size) - size
    at = np.repeat(np.arange(len(full)), size)
    props = tokens.props()[flat]
    counts = [np.bincount(at * n + props[:, c].astype(np.int64) - low, minlength=len(full) * n).reshape(len(full), n)
              for c, n, low in ((0, WORD_BUCKETS, 0), (1, SHAPE_BUCKETS, WORD_BUCKETS))]
    sums = np.add.reduceat(props[:, 2:], starts, axis=0)
    chars = np.maximum(sums[:, :1], 1)
    again = np.concatenate(([False], flat[1:] == flat[:-1]))
    again[starts] = False
    n = size.astype(np.float32)[:, None]
    stats = np.hstack([sums[:, :1] / n / 10, sums[:, 1:5] / chars, sums[:, 5:] / n,
                       np.add.reduceat(again.astype(np.float32), starts)[:, None] / n,
                       (counts[0] > 0).sum(axis=1, keepdims=True) / n, counts[0].max(axis=1, keepdims=True) / n,
                       np.log1p(n) / 5, n / PASSAGE_WORDS])
    x[full] = np.hstack([np.sqrt(counts[0] / n), np.sqrt(counts[1] / n), stats])
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """Passage features of training documents, as half floats."""

    def __init__(self, data: bytes = b"", sizes: list[int] | None = None):
        self.data = bytearray(data)
        self.starts = [0, *np.cumsum(sizes or [], dtype=np.int64).tolist()]

    def add(self, x: bytes, new: bool) -> None:
        """The next passages, of a new document or of the last one."""
        self.data += x
        if new:
            self.starts.append(self.starts[-1])
        self.starts[-1] += len(x) // (2 * FEATURES)

    def sizes(self) -> list[int]:
        return np.diff(self.starts).tolist()

    def steps(self, docs: np.ndarray, size: int = STEP_PASSAGES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Passages of the documents in their order and the place of each one's document, at most ``size`` at a time."""
        xs, own, held = [], [], 0
        for place, d in enumerate(docs.tolist()):
            at, end = self.starts[d], self.starts[d + 1]
            while at < end:
                n = min(end - at, size - held)
                xs.append(np.frombuffer(self.data, "<f2", n * FEATURES, at * 2 * FEATURES).reshape(n, FEATURES))
                own.append(np.full(n, place))
                at, held = at + n, held + n
                if held == size:
                    yield np.concatenate(xs).astype(np.float32), np.concatenate(own)
                    xs, own, held = [], [], 0
        if held:
            yield np.concatenate(xs).astype(np.float32), np.concatenate(own)


@dataclass
class State:
    """Adam's running means."""

    mean: dict[str, np.ndarray]
    var: dict[str, np.ndarray]
    step: int = 0

    @classmethod
    def start(cls, weights: dict[str, np.ndarray]) -> State:
        return cls({k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()})


@dataclass
class Model:
    """Weights of the passage layer (e, f), gated attention (v, u, w) and the score (c, b)."""

    weights: dict[str, np.ndarray]
    prior: float = 0.5

    @classmethod
    def start(cls, seed: int = 5) -> Model:
        r = np.random.default_rng(seed)
        shapes = {"e": (FEATURES, HIDDEN), "f": (HIDDEN,), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "w": (GATES,), "c": (HIDDEN,), "b": (1,)}
        return cls({k: (r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wc" else np.zeros(s)).astype(np.float32)
                    for k, s in shapes.items()})

    def passage(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vector, both parts of the gate, and the attention before its normalisation of every passage."""
        p = self.weights
        h = np.tanh(x @ p["e"] + p["f"])
        tv, su = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        return h, tv, su, (tv * su) @ p["w"]

    def gradients(self, bags: Bags, docs: np.ndarray, y: np.ndarray, size: int = STEP_PASSAGES) -> dict[str, np.ndarray]:
        """Attention is summed over the steps first; the second time each passage's share of the gradient is added."""
        p, n = self.weights, len(y)
        top, den, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        steps = list(bags.steps(docs, size)) if sum(bags.starts[i + 1] - bags.starts[i] for i in docs) <= size else None
        for x, owner in steps or bags.steps(docs, size):
            h, _, _, g = self.passage(x)
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            new = top.copy()
            new[owner[firsts]] = np.maximum(new[owner[firsts]], np.maximum.reduceat(g, firsts))
            scale = np.exp(top - np.where(np.isfinite(new), new, 0))
            ex = np.exp(g - new[owner])
            den = den * scale + np.bincount(owner, ex, minlength=n)
            z *= scale[:, None]
            z[owner[firsts]] += np.add.reduceat(ex[:, None] * h, firsts)
            top = new
        z /= den[:, None]
        d = ((_sigmoid(z @ p["c"] + p["b"]) - y) / n).astype(np.float32)
        dz = d[:, None] * p["c"]
        mean = (z * dz).sum(axis=1)
        out = {k: np.zeros(v.shape) for k, v in p.items()} | {"c": z.T @ d, "b": np.array([d.sum()])}
        for x, owner in steps or bags.steps(docs, size):
            h, tv, su, g = self.passage(x)
            a = (np.exp(g - top[owner]) / den[owner]).astype(np.float32)
            dg = (a * ((dz[owner] * h).sum(axis=1) - mean[owner])).astype(np.float32)
            gate = dg[:, None] * p["w"]
            dv, du = gate * su * (1 - tv ** 2), gate * tv * su * (1 - su)
            de = (a[:, None] * dz[owner] + dv @ p["v"].T + du @ p["u"].T) * (1 - h ** 2)
            for k, v in {"e": x.T @ de, "f": de.sum(0), "v": h.T @ dv, "u": h.T @ du, "w": (tv * su).T @ dg}.items():
                out[k] += v
        return out

    def epoch(self, state: State, bags: Bags, y: np.ndarray, order: np.ndarray, batch: int = 128, rate: float = 0.01,
              decay: float = 1e-4) -> None:
        """Adam over batches of documents in the given order; ``state`` goes on from epoch to epoch."""
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            state.step += 1
            for k, g in self.gradients(bags, docs, y[docs]).items():
                g = (g + decay * self.weights[k]).astype(np.float32)
                state.mean[k] = 0.9 * state.mean[k] + 0.1 * g
                state.var[k] = 0.999 * state.var[k] + 0.001 * g * g
                self.weights[k] = self.weights[k] - rate * (state.mean[k] / (1 - 0.9 ** state.step)) / (
                    np.sqrt(state.var[k] / (1 - 0.999 ** state.step)) + 1e-8)

    def scores(self, texts: list[bytes | None], tokens: Tokens) -> np.ndarray:
        """Attention is summed over pieces of the texts, so memory holds a few MB of them at a time."""
        n = len(texts)
        if not self.weights:
            return np.full(n, self.prior)
        p = self.weights
        top, den, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
        group: list[tuple[int, bytes]] = []
        held = 0

        def add() -> None:
            nonlocal top, den, z, group, held
            x, piece = passages([t for _, t in group], tokens)
            owner = np.array([i for i, _ in group])[piece]
            h = np.tanh(x @ p["e"] + p["f"])
            g = (np.tanh(h @ p["v"]) * _sigmoid(h @ p["u"])) @ p["w"]
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            new = top.copy()
            new[owner[firsts]] = np.maximum(new[owner[firsts]], np.maximum.reduceat(g, firsts))
            scale = np.exp(top - np.where(np.isfinite(new), new, 0))
            ex = np.exp(g - new[owner])
            den = den * scale + np.bincount(owner, ex, minlength=n)
            z *= scale[:, None]
            z[owner[firsts]] += np.add.reduceat(ex[:, None] * h, firsts)
            top, group, held = new, [], 0
            tokens.trim()

        for i, text in enumerate(texts):
            for part in pieces(text or b""):
                group.append((i, part))
                held += len(part)
                if held > GROUP_BYTES:
                    add()
        if group:
            add()
        return _sigmoid(z / den[:, None] @ p["c"] + p["b"])


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of at most ``PIECE_BYTES``, cut at white space where there is any."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = max(text.rfind(c, at, at + PIECE_BYTES) for c in (b" ", b"\n")) + 1
        cut = cut if cut > at else at + PIECE_BYTES
        yield text[at:cut]
        at = cut
    yield text[at:]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(text, quality)`` of at most ``train_docs`` labelled documents outside the held-out fold, half of each label."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("nth", F.xxhash64("doc_id")))
    part = [known.filter(F.col("quality") == q).orderBy("nth", "doc_id").limit(train_docs // 2) for q in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(part[0].unionAll(part[1])), "doc_id").select("doc_id", "nth", "text", "quality")


def training_slots(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """``(slot, x, sizes, y)``: features of whole documents, a row per slot."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            for i, text in enumerate(text_bytes(b)):
                for part, piece in enumerate(pieces(text or b"")):
                    x = passages([piece], tokens)[0].astype("<f2").tobytes()
                    tokens.trim()
                    yield pa.RecordBatch.from_arrays([*[column(b, c)[i:i + 1] for c in ("nth", "doc_id", "same", "quality", "row")],
                                                      pa.array([part], pa.int64()), pa.array([x], pa.binary())],
                                                     ["nth", "doc_id", "same", "quality", "row", "part", "x"])

    # rows of one doc_id go by text; ``row`` keeps the pieces of equal rows apart
    rows = kept(spark, training_sample(docs, labels, train_docs)
                .select("nth", "doc_id", F.xxhash64("text").alias("same"), "quality", F.monotonically_increasing_id().alias("row"), "text")
                .mapInArrow(encode, "nth long, doc_id long, same long, quality int, row long, part long, x binary"), "passages")
    each = ["nth", "doc_id", "same", "row"]
    if rows.filter("part = 0").count() > train_docs:         # doc_ids on several rows: the bound holds for rows
        rows = rows.join(rows.filter("part = 0").orderBy(*each).limit(train_docs).select(*each), each, "left_semi")
    total = rows.agg(F.sum(F.length("x"))).first()[0] or 0
    slots = max(MIN_SLOTS, -(-total // slot_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y, slot = Bags(), [], None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([bytes(bags.data)], pa.binary()),
                                               pa.array([np.array(bags.sizes(), "<i8").tobytes()], pa.binary()),
                                               pa.array([np.array(y, "i1").tobytes()], pa.binary())], ["slot", "x", "sizes", "y"])

        for b in batches:
            for k, q, part, x in zip(*[column(b, c).to_pylist() for c in ("slot", "quality", "part", "x")], strict=True):
                if k != slot:
                    if y:
                        yield packed()
                    bags, y, slot = Bags(), [], k
                bags.add(x, part == 0)
                if part == 0:
                    y.append(q)
        if y:
            yield packed()

    dealt = (rows.withColumn("slot", F.pmod(F.xxhash64("nth", F.lit(3)), F.lit(slots)).cast("int")).repartitionById(slots, "slot")
             .sortWithinPartitions("slot", "nth", "doc_id", "same", "row", "part"))
    return kept(spark, dealt.mapInArrow(pack, "slot int, x binary, sizes binary, y binary"), "slots")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fits the model to the sample's passage features."""
    spark = docs.sparkSession
    slots = training_slots(docs, labels, train_docs)
    ys = [np.frombuffer(r.y, "i1") for r in slots.select("y").collect()]          # a byte a document
    y = np.concatenate(ys) if ys else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    model = Model.start()
    state = State.start(model.weights)
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((model.weights, state))

        def learn(batches: Iterator[pa.RecordBatch], epoch=epoch, sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for slot, x, sizes, y in zip(*[column(b, c).to_pylist() for c in ("slot", "x", "sizes", "y")], strict=True):
                    weights, start = sent.value
                    mine = Model({k: v.copy() for k, v in weights.items()})
                    own = State({k: v.copy() for k, v in start.mean.items()}, {k: v.copy() for k, v in start.var.items()}, start.step)
                    bags, y = Bags(x, np.frombuffer(sizes, "<i8").tolist()), np.frombuffer(y, "i1").astype(float)
                    mine.epoch(own, bags, y, np.random.default_rng([seed, epoch, slot]).permutation(len(y)))
                    out = pickle.dumps((mine.weights, own.mean, own.var, own.step, len(y)))
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([out], pa.binary())], ["slot", "state"])

        got = [pickle.loads(r.state) for r in slots.mapInArrow(learn, "slot int, state binary").orderBy("slot").collect()]
        sent.unpersist()
        share = np.array([g[4] for g in got], np.float64) / sum(g[4] for g in got)
        model.weights, state.mean, state.var = ({k: sum(w * g[i][k] for w, g in zip(share, got, strict=True)).astype(np.float32) for k in model.weights}
                                                for i in range(3))
        state.step = max(g[3] for g in got)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, tokens = Model(*sent.value), Tokens()
        for b in batches:
            for at in range(0, b.num_rows, SCORED_ROWS):
                rows = column(b, "row").slice(at, SCORED_ROWS)
                text = pa.RecordBatch.from_arrays([pc.struct_field(rows, "text").cast(pa.string())], ["text"])
                yield pa.RecordBatch.from_arrays([rows, pa.array(mine.scores(text_bytes(text), tokens), pa.float64())], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(score, rows.select("row", F.lit(0.0).alias("score")).schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    model = train(docs, labels)
    return (scored(docs.select("doc_id", "text"), model)
            .select(F.col("row.doc_id").alias("doc_id"), held_out("row.doc_id").alias("held_out"), "score",
                    F.coalesce((F.col("score") >= THRESHOLD).cast("int"), F.lit(0)).alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score at the threshold or above, with all their columns."""
    return scored(docs, train(docs, labels)).filter(F.col("score") >= threshold).select("row.*")
