"""Chat formatting: token-level assembly with loss masks.

A turn is ``### role: text</turn>`` and a new line. Role and text are
encoded separately; the marks are reserved ids beyond the vocabulary, spliced between the segments, so
no text can yield one. In the text form, control strings inside a text
are escaped with a backslash, and so are backslashes, which makes it reversible. The loss mask
covers the text tokens of assistant turns; it and the turns' offsets are prefix sums of segment lengths.

Turns are encoded where they are read, in parallel whatever their conversation; the
tokens are then sorted by conversation and turn and streamed, a turn at a time, so a conversation of
any length needs no more memory than its longest turn. The output is a row per turn.

Defined results: null texts and roles count as empty. Turns sort by turn (null first), role, text; equal ones
are all kept. Null conv_ids form one conversation. An empty table gives no rows. Extra columns are ignored. Texts of over
``SEGMENT`` characters are encoded in segments, cut before a blank where there is one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import column, kept

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT = 8192
TURN, NAMED, END = "### ", ": ", "</turn>\n"
CONTROL = ("### ", "</turn>")
LOSS_ROLE = "assistant"
_TEXT = re.compile(r"\\|### |</turn>")
_ROLE = re.compile(r"\\|### |</turn>|:")
_ESCAPED = re.compile(r"\\(\\|### |</turn>|:)")
FORMATTED = ("conv_id long, nth long, ids array<int>, loss_mask array<boolean>, start long, n_chars long")


def escape(text: str, pattern: re.Pattern = _TEXT) -> str:
    return pattern.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Byte-level BPE of a rank file, with three reserved ids after it."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        free = max(ranks.values()) + 2
        self.marks = {free: TURN, free + 1: NAMED, free + 2: END}
        self.turn, self.named, self.end = self.marks

    @classmethod
    def of(cls, path: str) -> Codec:
        """Loaded once per Python worker: held by a module that is not sent with tasks."""
        held = sys.modules.setdefault("_chat_codecs", types.ModuleType("_chat_codecs")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        while len(text) - at > SEGMENT:
            cut = text.rfind(" ", at + 1, at + SEGMENT)
            cut = cut if cut > at else at + SEGMENT
            out += self.bpe.encode_ordinary(text[at:cut])
            at = cut
        return out + self.bpe.encode_ordinary(text[at:])

    def pieces(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[bytes, bool]]:
        """Bytes of every mark and of every run of ids between marks under one mask value."""
        mark = ids >= self.turn
        cut = mark[1:] | mark[:-1] | (mask[1:] != mask[:-1])
        ends = [0, *(np.flatnonzero(cut) + 1).tolist(), len(ids)]
        flat = ids.tolist()
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            if a < z:
                yield self.marks[flat[a]].encode() if mark[a] else self.bpe.decode_bytes(flat[a:z]), bool(mask[a])


def assembled(role: list[int], text: list[int], loss: bool, codec: Codec) -> tuple[np.ndarray, int, int]:
    """Ids of a turn and the bounds of its loss mask, from the ends of its segments."""
    parts = [[codec.turn], role, [codec.named], text, [codec.end]]
    ends = np.cumsum([len(p) for p in parts])
    return np.concatenate([np.asarray(p, "<i4") for p in parts]), int(ends[2]), int(ends[3] if loss else ends[2])


def formatted(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row per turn: conv_id, nth, ids, loss_mask, start (tokens before it), n_chars of its text form."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for b in batches:
            ids, bounds, chars = [], [], []
            for role, text in zip(column(b, "role").to_pylist(), column(b, "text").to_pylist(), strict=True):
                r, t = escape(role, _ROLE), escape(text)
                i, low, high = assembled(codec.encode(r), codec.encode(t), role == LOSS_ROLE, codec)
                ids.append(i.tobytes())
                bounds.append((low, high))
                chars.append(len(TURN) + len(r) + len(NAMED) + len(t) + len(END))
            yield pa.RecordBatch.from_arrays(
                [column(b, "conv_id"), column(b, "turn"), column(b, "role"), column(b, "text"),
                 pa.array(ids, pa.binary()), pa.array([x for x, _ in bounds], pa.int64()), pa.array([x for _, x in bounds], pa.int64()),
                 pa.array(chars, pa.int64())],
                ["conv_id", "turn", "role", "text", "ids", "low", "high", "n_chars"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, nth, start = (), 0, 0
        for b in batches:
            numbers, starts = [], []
            ids = [np.frombuffer(x, "<i4") for x in column(b, "ids").to_pylist()]
            at = [np.arange(len(x)) for x in ids]
            masks = [(x >= low) & (x < high) for x, low, high in zip(at, column(b, "low").to_pylist(), column(b, "high").to_pylist(), strict=True)]
            for c, n in zip(column(b, "conv_id").to_pylist(), map(len, ids), strict=True):
                if conv != (c,):
                    conv, nth, start = (c,), 0, 0
                numbers.append(nth)
                starts.append(start)
                nth, start = nth + 1, start + n
            yield pa.RecordBatch.from_arrays([column(b, "conv_id"), pa.array(numbers, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                              pa.array(masks, pa.list_(pa.bool_())), pa.array(starts, pa.int64()), column(b, "n_chars")],
                                             ["conv_id", "nth", "ids", "loss_mask", "start", "n_chars"])

    return (rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids binary, low long, high long, n_chars long")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "role", "text")
            .mapInArrow(place, FORMATTED))


def digested(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Reads formatted turns back: a row per conversation with digests of its turns and of the text under the mask.

    Tokens are decoded where they are read; what a conversation's task does is to hash them in order.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(tokenizer)
        for b in batches:
            ids, mask = column(b, "ids"), column(b, "loss_mask")
            flat, under, ends = ids.flatten().to_numpy(), mask.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().to_numpy()).tolist()
            said, losses, chars = [], [], []
            for a, z in zip([0, *ends[:-1]], ends, strict=True):
                parts = list(codec.pieces(flat[a:z], under[a:z]))
                form = b"".join(p for p, _ in parts).decode()
                role, text = parsed(form)
                loss = unescape(b"".join(p for p, m in parts if m).decode())
                said.append((role, text))
                losses.append(None if loss == text else loss)
                chars.append(len(form))
            yield pa.RecordBatch.from_arrays(
                [column(b, "conv_id"), column(b, "nth"), pa.array([r for r, _ in said], pa.string()), pa.array([t for _, t in said], pa.string()),
                 pa.array(losses, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "nth", "role", "text", "other_loss", "n_chars"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple = ()
        n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            out = []
            for c, role, text, under, form in zip(*[column(b, x).to_pylist() for x in ("conv_id", "role", "text", "other_loss", "n_chars")], strict=True):
                if conv != (c,):
                    if conv:
                        out.append((*conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, n, chars, loss_chars, turns, loss = (c,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                under = text if under is None else under
                n, chars, loss_chars = n + 1, chars + form, loss_chars + len(under)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
            yield batch()
        out = [(*conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)] if conv else []
        yield batch()

    return (rows.select("conv_id", "nth", "ids", "loss_mask").mapInArrow(decode, "conv_id long, nth long, role string, text string, other_loss string, n_chars long")
            .repartition("conv_id").sortWithinPartitions("conv_id", "nth")
            .mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


_FORM = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?)</turn>\n", re.DOTALL)


def parsed(form: str) -> tuple[str, str]:
    """Role and text of one turn's text form."""
    m = _FORM.fullmatch(form)
    if m is None:
        raise ValueError("not the text form of a turn")
    return unescape(m[1]), unescape(m[2])


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold the template's control strings."""
    said = r"\### Assistant: </turn> ok"
    return spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", {"said": said})


def chat_digests(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Formats, keeps the tokens on shared storage and reads them back."""
    spark = conversations.sparkSession
    return digested(kept(spark, formatted(conversations, tokenizer), "formatted"), tokenizer)
