"""Token counts of whole texts by rank-synchronous array merging (byte-level BPE).

A text is cut at special strings, and the parts into pre-tokens. The different pre-tokens that
a task has not met yet are laid end to end in ragged arrays, a symbol per byte. In each
round every sequence looks up the lowest merge rank among its neighbouring symbols, all its occurrences
of that pair are merged, leftmost first where they overlap, and all sequences do so at the same time;
a sequence without a known pair leaves the arrays, and its surviving symbols are its count.
Counts are remembered per task (``MEMO_TOKENS`` pre-tokens, then forgotten), so a common word is merged once.

The vocabulary file (``TOKENIZER``: a parameter, never copied) is read by the driver; its merge table, one
entry per merge, is broadcast. Executors need no vocabulary file. Texts pass through once, without a shuffle; long ones
in segments of ``SEGMENT`` characters cut before a blank between two other characters, which is always the
border of two pre-tokens. A pre-token without such a border is held whole.

The installed ``regex`` knows letters of a later Unicode version than the tokenizers library; up to ``SAME_CLASSES``
both agree, parts with later characters are split by the library's own byte-level pre-tokenizer.

Defined results: null and empty texts have 0 bytes and 0 tokens. A special string in a text counts as its one token, as
is the library's default. Rows are counted one by one, so repeated rows and null doc_ids are kept as they come. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import column

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters below this are letters, numbers and blanks to both libraries alike.
SAME_CLASSES = "԰"
LIMIT = 1024
SEGMENT = 1 << 18
MEMO_TOKENS = 100_000
GROUP_CHARS = 1 << 20
_NONE = np.iinfo(np.int32).max
_LATER = regex.compile(f"[{SAME_CLASSES}-\U0010ffff]")
_BORDER = regex.compile(r"\S(?= \S)")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge table of a vocabulary: sorted pair keys with the rank and symbol of each, and every byte's symbol."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"]
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
                 and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")))
        if not plain or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bytes = np.array([vocab[c] for c in _byte_letters()], np.int32)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; ``_NONE`` where there is no such merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Number of symbols that are left of each sequence once no pair of it can be merged."""
        out = np.zeros(len(sequences), np.int64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        owner = np.repeat(np.arange(len(sequences), dtype=np.int32), sizes)
        symbols = self.bytes[np.frombuffer(b"".join(sequences), np.uint8)]

        def ranks_at(at: np.ndarray) -> np.ndarray:
            nxt = np.minimum(at + 1, len(symbols) - 1)
            same = (at + 1 < len(symbols)) & (owner[nxt] == owner[at])
            return np.where(same, self.rank(symbols[at], symbols[nxt]), _NONE).astype(np.int32)

        ranks = ranks_at(np.arange(len(symbols))) if len(symbols) else np.zeros(0, np.int32)
        while len(symbols):
            firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            counts = np.diff(np.concatenate((firsts, [len(symbols)])))
            low = np.minimum.reduceat(ranks, firsts)
            if (low == _NONE).any():
                done = low == _NONE
                out[owner[firsts[done]]] = counts[done]
                stay = np.repeat(~done, counts)
                symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
                low, counts = low[~done], counts[~done]
            if not len(symbols):
                break
            hit = np.flatnonzero(ranks == np.repeat(low, counts))
            # in a row of overlapping pairs (a a a) every second one is merged, from the left
            heads = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            nth = np.arange(len(hit))
            hit = hit[(nth - np.maximum.accumulate(np.where(heads, nth, 0))) % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            at = hit - np.arange(len(hit))          # one symbol went behind each earlier hit
            ranks[at] = ranks_at(at)
            before = at[at > 0] - 1
            ranks[before] = ranks_at(before)
        return out


class Counter:
    """Counts tokens of texts; remembers the counts of pre-tokens."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.memo: dict[str, int] = {}
        self.special = regex.compile("(?:" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
        self.split = regex.compile(PATTERN).findall
        self.library = None

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Segments of the text between special strings, and whether one such string follows."""
        bounds = [m.span() for m in self.special.finditer(text)] if self.special else []
        at = 0
        for low, high in [*bounds, (len(text), 0)]:
            while low - at > SEGMENT:
                m = _BORDER.search(text, at + SEGMENT, low)
                if not m:
                    break
                yield text[at:m.end()], False
                at = m.end()
            yield text[at:low], high > 0
            at = high

    def pre_tokens(self, part: str) -> list[str]:
        if part.isascii() or not _LATER.search(part):
            return self.split(part)
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return [part[a:z] for _, (a, z) in self.library.pre_tokenize_str(part)]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def add() -> None:
            nonlocal held, size
            new = list(set().union(*(p for _, p in held)).difference(self.memo))
            self.memo.update(zip(new, self.merges.surviving([t.encode("utf-8", "surrogatepass") for t in new]).tolist(), strict=True))
            for i, own in held:
                out[i] += sum(map(self.memo.__getitem__, own))
            held, size = [], 0
            if len(self.memo) > MEMO_TOKENS:
                self.memo.clear()

        for i, text in enumerate(texts):
            for part, special in self.parts(text or ""):
                out[i] += special
                held.append((i, self.pre_tokens(part)))
                size += len(part)
                if size > GROUP_CHARS:
                    add()
        if held:
            add()
        return out


def counted(docs: DataFrame, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """Struct ``row`` of the columns ``keep``, with ``n_bytes`` and ``n_tokens`` of ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("counted_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for b in batches:
            text = column(b, "counted_text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n_tokens: list[int] = []
            for at in range(0, len(text), 500):
                n_tokens += counter.counts(text.slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([column(b, "row"), n_bytes, pa.array(n_tokens, pa.int64())], ["row", "n_bytes", "n_tokens"])

    zero = F.lit(0).cast("long")
    return rows.mapInArrow(count, rows.select("row", zero.alias("n_bytes"), zero.alias("n_tokens")).schema)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    return counted(docs, ["doc_id"], tokenizer).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
