"""Personal data, and terms that reveal it: information-theoretic sanitisation.

Base spans (e-mail, ip, card, phone) are found by pattern in whole texts,
leftmost and non-overlapping per kind. Their values are the protected entities.

A term reveals an entity when seeing it tells nearly as much as the entity
itself. Of N different texts (exact copies are one), ``d_c`` hold entity c, ``n_t`` hold term t, and ``n_ct`` both,
the term anywhere outside base spans:

    PMI(c; t) = log2((n_ct / d_c) / (n_t / N)),   IC(c) = log2(N / d_c)
    disclosure(c; t) = PMI(c; t) / IC(c) = 1 + log2(n_ct / n_t) / IC(c)

Few observations are no proof. A term is sanitised in documents that hold c if its disclosure is 0.8 or more and the lower end of the
one-sided 95 % confidence interval (Wilson) of P(c | t), seen n_ct times in n_t, is 0.4 or more: twice in two texts is enough, once is not,
however large the corpus. Removed, rather than generalised, are terms of disclosure 1. Generalised ones become their class:
``[NUMBER]`` with its count of digits, ``[NAME]`` for a capital letter, ``[WORD]`` else.

Both n_t and d_c must then be 2 or more, and n_t at most d_c / 0.4; other terms and entities are dropped before
entities and terms of a text are paired. Entities that stand in the same texts have the same figures and are paired as one. A
text of many entities is spread over several tasks.

Counts cover all documents. Term counts are needed for terms of texts with entities alone: those
are marked in a bitmap of 16 bits a term, 2 MB at most, which is all that is
broadcast by hand, with one like it for the documents that have terms to sanitise; counts are summed per task before the shuffle, and exact
joins follow. Rows outside the second bitmap are finished in the task that reads them; only the others meet their terms in a shuffle.

Defined results: null and empty texts have no spans. Rows that repeat a
doc_id are scanned row by row, and share the terms found for that doc_id. Rows with a null doc_id count in all
statistics and get their base spans alone. Extra columns pass through ``sanitise``, which replaces ``text`` only.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import MEMO_WORDS, Bitmap, bitmap, column, kept, small_batches, text_bytes, words

KINDS = ("email", "ip", "card", "phone")
GENERALISE = 0.8
REMOVE = 1.0
CONFIDENCE = 0.4
Z = 1.6448536269514722      # of the one-sided 95 % bound
SALT_CLASSES = 1000
SCAN_ROWS = 500

# The patterns of the base spans.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")     # a later start in the same digits can't match either
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, z) for a, z in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> bytes:
    """Digest of a protected value; spelling of the same number doesn't matter."""
    if kind in ("card", "phone"):
        value = "".join(c for c in value if c.isdigit())
    return hashlib.blake2b(f"{kind}:{value.translate(_LOWER)}".encode(), digest_size=16).digest()


def outside(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """Different words of the text outside its base spans."""
    taken = sorted((a, z) for _, a, z in spans)
    out, k, far = set(), 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            far, k = max(far, taken[k][1]), k + 1
        if far <= m.start():
            out.add(m.group().translate(_LOWER))
    return sorted(out)


PRINT = ["print_a", "print_b"]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the fingerprint that exact copies share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("print_a"), F.xxhash64(text, F.lit(7)).alias("print_b"))


def private_texts(docs: DataFrame) -> DataFrame:
    """A row per document with base spans: doc_id, fingerprint, its different entities and terms."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SCAN_ROWS) for whole in batches for at in range(0, whole.num_rows, SCAN_ROWS)):
            at, out = [], []
            for i, text in enumerate(column(b, "text").to_pylist()):
                spans = base_spans(text)
                if spans:
                    at.append(i)
                    out.append((sorted({entity(k, text[a:z]) for k, a, z in spans}), outside(text, spans)))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[column(b, c).take(rows) for c in ("doc_id", *PRINT)],
                 pa.array([e for e, _ in out], pa.list_(pa.binary())), pa.array([t for _, t in out], pa.list_(pa.string()))],
                ["doc_id", *PRINT, "entities", "terms"])

    return _texts(docs).mapInArrow(find, "doc_id long, print_a long, print_b long, entities array<binary>, terms array<string>")


class Marked(dict):
    """Whether a word's bit is set, remembered per task (bounded by ``trim``)."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bitmap = Bitmap(bits)

    def __missing__(self, word: bytes) -> bool:
        self[word] = hit = word in self.bitmap
        return hit

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()


def document_counts(docs: DataFrame, copies: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n_t)``: different texts with each of the terms. Each of n copies counts as 1 / n."""
    bits = bitmap(docs.sparkSession, terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = Marked(bits.value), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([t.decode("utf-8", "replace") for t in seen], pa.string()),
                                              pa.array(list(seen.values()), pa.float64())], ["term", "n"])
            seen.clear()
            return out

        for b in (whole.slice(at, SCAN_ROWS) for whole in batches for at in range(0, whole.num_rows, SCAN_ROWS)):
            for text, copied in zip(text_bytes(b), column(b, "copied").to_pylist(), strict=True):
                for w in set(words(text)):
                    if marked[w]:
                        seen[w] += 1 / copied
            marked.trim()
            if len(seen) > 100_000:
                yield rows()
        yield rows()

    rows = _texts(docs).join(copies, PRINT, "left").select("text", F.coalesce("copied", F.lit(1)).alias("copied"))
    return rows.mapInArrow(count, "term string, n double").groupBy("term").agg(
        F.round(F.sum("n")).cast("long").alias("n_t")).join(terms.select("term"), "term", "left_semi")


def least_support(confidence: float) -> int:
    """Fewest observations, all of them together, whose confidence bound reaches ``confidence``."""
    n = 1
    while lower_bound(n, n) < confidence:
        n += 1
    return n


def lower_bound(hits: float, n: float) -> float:
    """Lower end of the one-sided Wilson interval of a share seen ``hits`` times in ``n``."""
    p, zz = hits / n, Z * Z
    return (p + zz / (2 * n) - Z * ((p * (1 - p) + zz / (4 * n)) / n) ** 0.5) / (1 + zz / n)


def document_terms(docs: DataFrame, generalise: float = GENERALISE, confidence: float = CONFIDENCE) -> DataFrame:
    """``(doc_id, terms)``: the terms to sanitise in each document, with their disclosure."""
    spark = docs.sparkSession
    small_batches(spark)
    least = least_support(confidence)
    copies = kept(spark, _texts(docs).groupBy(*PRINT).agg(F.count("*").alias("copied")).filter("copied > 1"), "copies")
    n = docs.count() - (copies.agg(F.sum(F.col("copied") - 1)).first()[0] or 0)
    found = kept(spark, private_texts(docs), "private")

    # entities of the same texts are one class: their number and the sums of two fingerprints
    own = found.select(*PRINT, F.explode("entities").alias("entity")).distinct()
    classes = own.groupBy("entity").agg(F.count("*").alias("d_c"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(f"sum_{c}") for c in PRINT])
    classes = classes.filter(F.col("d_c") >= least).select("entity", "d_c", F.concat_ws(":", "d_c", "sum_print_a", "sum_print_b").alias("class"))
    own = kept(spark, own.join(classes, "entity").select(*PRINT, "class", "d_c").distinct(), "classes")

    def may(d_c: str) -> Column:      # a little wider than the bounds, for rounding
        by_ratio = F.col(d_c) * F.pow(F.lit(float(n)) / F.col(d_c), F.lit(1 - generalise))
        return (F.col("n_t") >= least) & (F.col("n_t") <= F.least(by_ratio, F.col(d_c) / confidence) * 1.000001)

    held = own.groupBy(*PRINT).agg(F.max("d_c").alias("most"), F.count("*").alias("n_classes"))
    terms = kept(spark, found.join(held, PRINT).select(*PRINT, "most", "n_classes", F.explode("terms").alias("term")).distinct(), "terms")
    counts = document_counts(docs, copies, terms.select("term").distinct())
    salts = F.ceil(F.col("n_classes") / SALT_CLASSES).cast("int")
    rare = (terms.join(counts, "term").filter(may("most"))
            .select(*PRINT, "term", "n_t", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    dealt = (own.join(held.select(*PRINT, "n_classes"), PRINT)
             .select(*PRINT, "class", "d_c", F.pmod(F.xxhash64("class"), salts).cast("int").alias("salt")))
    pairs = kept(spark, rare.join(dealt, [*PRINT, "salt"]).filter(may("d_c")).drop("salt"), "pairs")

    ic = F.log2(F.lit(float(n)) / F.col("d_c"))
    share, zz = F.col("n_ct") / F.col("n_t"), Z * Z
    low = ((share + zz / (2 * F.col("n_t")) - Z * F.sqrt((share * (1 - share) + zz / (4 * F.col("n_t"))) / F.col("n_t")))
           / (1 + zz / F.col("n_t")))
    disclosure = 1 + F.log2(share) / ic
    flagged = (pairs.groupBy("class", "d_c", "term", "n_t").agg(F.count("*").alias("n_ct"))
               .filter((ic > 0) & (low >= confidence) & (disclosure >= generalise))
               .select("class", "term", disclosure.alias("disclosure")))
    held_terms = pairs.join(flagged, ["class", "term"]).groupBy(*PRINT, "term").agg(F.max("disclosure").alias("disclosure"))
    return (found.filter("doc_id is not null").select("doc_id", *PRINT).distinct().join(held_terms, PRINT)
            .groupBy("doc_id", "term").agg(F.max("disclosure").alias("disclosure"))
            .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms")))


def term_spans(text: str, base: list[tuple[str, int, int]], terms: set[str]) -> list[tuple[str, int, int]]:
    """Occurrences of the terms outside base spans."""
    taken = sorted((a, z) for _, a, z in base)
    out, k, far = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            far, k = max(far, taken[k][1]), k + 1
        if far <= m.start() and m.group().translate(_LOWER) in terms:
            out.append(("term", *m.span()))
    return out


def general(word: str) -> str:
    """The class that stands for a generalised word."""
    if word.isdigit():
        return f"[NUMBER{len(word)}]"
    return "[NAME]" if word[0].isupper() else "[WORD]"


def masked(text: str, spans: list[tuple[str, int, int]], terms: dict[str, float]) -> str:
    """Base spans become their kind, terms become their class or go."""
    out, pos = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < pos:
            pos = max(pos, z)
            continue
        out.append(text[pos:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif terms[text[a:z].translate(_LOWER)] < REMOVE:
            out.append(general(text[a:z]))
        pos = z
    return "".join([*out, text[pos:]])


def scanned(docs: DataFrame, keep: list[str], generalise: float = GENERALISE, texts: bool = True) -> DataFrame:
    """Struct ``row`` of the columns ``keep``, with counts, spans and, if ``texts``, the sanitised text."""
    spark = docs.sparkSession
    terms = kept(spark, document_terms(docs, generalise), "document_terms")
    marks = bitmap(spark, terms.select(F.col("doc_id").cast("string")))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("scan_id"), F.col("text").cast("string").alias("scan_text"))
    schema = rows.select("row", *[F.lit(0).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")],
                         F.lit("").alias("base_sha256"), F.lit("").alias("spans"), *([F.col("scan_text").alias("sanitised")] if texts else [])).schema

    def split(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(marks.value)
        for b in batches:
            hit = [i is not None and str(i).encode() in bits for i in column(b, "scan_id").to_pylist()]
            yield b.filter(pa.array([h == marked for h in hit], pa.bool_()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SCAN_ROWS) for whole in batches for at in range(0, whole.num_rows, SCAN_ROWS)):
            out = []
            owned = column(b, "terms").to_pylist() if "terms" in b.schema.names else [None] * b.num_rows
            for text, own in zip(column(b, "scan_text").to_pylist(), owned, strict=True):
                base = base_spans(text) if text else []
                own = dict(own) if own else {}
                extra = term_spans(text, base, set(own)) if own and text else []
                n = Counter(s[0] for s in base)
                name = [f"{k}:{a}:{z}" for k, a, z in base]
                out.append((*[n[k] for k in KINDS], len(extra), hashlib.sha256(",".join(name).encode()).hexdigest(),
                            ",".join([*name, *(f"{k}:{a}:{z}" for k, a, z in extra)]),
                            *([masked(text, base + extra, own) if base or extra else text] if texts else [])))
            kinds = [pa.int64()] * 5 + [pa.string()] * (2 + texts)
            yield pa.RecordBatch.from_arrays([column(b, "row"), *[pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]], schema.names)

    plain = rows.mapInArrow(lambda batches: scan(split(batches, False)), schema)
    told = (rows.mapInArrow(lambda batches: split(batches, True), rows.schema).join(terms, F.col("scan_id") == F.col("doc_id"), "left")
            .select("row", "scan_text", "terms").mapInArrow(scan, schema))
    return plain.union(told)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    return scanned(docs, ["doc_id"], texts=False).select(
        F.col("row.doc_id").alias("doc_id"), *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_term")


def sanitise(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with ``text`` replaced by its sanitised form."""
    others = [c for c in docs.columns if c != "text"]
    out = scanned(docs, others, generalise)
    return out.select(*[F.col("sanitised").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
