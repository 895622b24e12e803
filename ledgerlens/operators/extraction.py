"""Text and field extraction over document tables.

Text producers (PDF text layers, layout parsers, OCR) are per-file codecs;
here they arrive as candidate text columns, or as user functions run by
``mapInPandas`` only on the rows that still need them. Everything else is
column expressions: the cascade, pages, the short-text gate, prompts,
rule-based field extraction and normalisation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.amounts import normalize_currency, normalize_date, nullif_blank, parse_amount
from ledgerlens.functions.jsonparse import let, salvage
from ledgerlens.schema import EXTRACTION_FIELDS

# A candidate shorter than this falls through to the next one.
MIN_TEXT_CHARS = 50
# Text shorter than this fails the document.
MIN_DOCUMENT_CHARS = 20
SHORT_TEXT_ERROR = "document text is shorter than the minimum"
# Method labels of the three candidates, in cascade order.
METHODS = ["pymupdf", "pdfplumber", "ocr"]
PAGE_BREAK = "\f"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cascade(df: DataFrame, candidates: list[str], methods: list[str] = METHODS,
            use_ocr: bool = True, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Pick the text of each document: the first candidate, replaced by the
    next one while the current text is shorter than ``min_chars``.

    The last step (OCR) runs only when ``use_ocr``. A later candidate wins
    even when it is shorter. A failed candidate is null and counts as short.
    Adds ``text`` and ``extraction_method``.
    """
    steps = list(zip(candidates, methods))
    if not use_ocr and len(steps) > 2:
        steps = steps[:2]
    text = F.col(steps[0][0])
    method = F.lit(steps[0][1])
    for cand, label in steps[1:]:
        short = F.coalesce(F.length(text), F.lit(0)) < min_chars
        text, method = F.when(short, F.col(cand)).otherwise(text), \
            F.when(short, F.lit(label)).otherwise(method)
    return df.withColumns({"text": text, "extraction_method": method})


def text_by_page(df: DataFrame, id_col: str, text_col: str = "text",
                 separator: str = PAGE_BREAK) -> DataFrame:
    """``(id, page_no, page_text)`` with 1-based page numbers."""
    return df.select(id_col, F.posexplode(F.split(text_col, _regex_literal(separator), -1))
                     .alias("page_no", "page_text")).withColumn("page_no", F.col("page_no") + 1)


def page_map(text_col: str = "text", separator: str = PAGE_BREAK) -> Column:
    """MAP<page_no, text> of one document, 1-based."""
    pages = F.split(text_col, _regex_literal(separator), -1)
    return F.map_from_arrays(F.sequence(F.lit(1), F.size(pages)), pages)


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in s)


def join_pages(pages, method: str = "pymupdf") -> Column:
    """Re-assemble an ordered page array into one text.

    ``pymupdf``: pages back to back; ``pdfplumber``: newline after each
    non-empty page; ``ocr``: newline after every page. Ends are stripped.
    """
    p = _col(pages)
    if method == "pymupdf":
        joined = F.array_join(p, "")
    elif method == "pdfplumber":
        joined = F.array_join(F.transform(F.filter(p, lambda x: x != ""), lambda x: F.concat(x, F.lit("\n"))), "")
    else:
        joined = F.array_join(F.transform(p, lambda x: F.concat(x, F.lit("\n"))), "")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def assemble_pages(page_rows: DataFrame, id_col: str, method: str = "pymupdf") -> DataFrame:
    """Page rows back to one text per document (one shuffle on the id)."""
    g = page_rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("page_no", "page_text"))).alias("_p"))
    return g.select(id_col, join_pages(F.transform("_p", lambda e: e["page_text"]), method).alias("text"))


def short_text_gate(df: DataFrame, text_col: str = "text",
                    min_chars: int = MIN_DOCUMENT_CHARS) -> DataFrame:
    """Adds ``passed`` and ``errors``; failing rows stay as data."""
    ok = F.coalesce(F.length(text_col), F.lit(0)) >= min_chars
    return df.withColumns({"passed": ok,
                           "errors": F.when(ok, F.array().cast("array<string>"))
                                      .otherwise(F.array(F.lit(SHORT_TEXT_ERROR)))})


# What each field's value looks like in the reply; other fields are text.
FIELD_TYPES = {"invoice_date": "date, YYYY-MM-DD", "total_amount": "number", "currency": "ISO 4217 code"}
PROMPT_TAIL = "\n</document>\nReply:"


def prompt_head(fields: list[str]) -> str:
    keys = "".join(f"  {f}: {FIELD_TYPES.get(f, 'text')} | null\n" for f in fields)
    return f"Reply with a JSON object of this shape, filled from the document.\n{{\n{keys}}}\n<document>\n"


def build_prompt(text_col: str = "text", fields: list[str] | None = None) -> Column:
    return F.concat(F.lit(prompt_head(fields or EXTRACTION_FIELDS)), F.col(text_col), F.lit(PROMPT_TAIL))


# Labels of the sample invoice layout, one field per line, as patterns over a whole text.
# ``[ \t]*`` after a label keeps an empty value from running into the next line.
FIELD_PATTERNS = {
    "invoice_number": r"(?im)^[ \t]*invoice[ \t]*(?:no\.|no\b|number\b|#)[ \t]*:?[ \t]*(.*)$",
    "invoice_date": r"(?im)^[ \t]*(?:invoice[ \t]+)?date[ \t]*:[ \t]*(.*)$",
    "seller_name": r"(?im)^[ \t]*(?:from|seller)[ \t]*:[ \t]*(.*)$",
    "buyer_name": r"(?im)^[ \t]*(?:to|buyer|bill to)[ \t]*:[ \t]*(.*)$",
    "amount_line": r"(?im)^[ \t]*total(?:[ \t]+amount)?[ \t]*:[ \t]*(.*)$",
}
AMOUNT_NUMBER = r"(-?[0-9](?:[0-9.,]*[0-9])?)"
# 1.234.567,89 / 1234,5: dots group thousands and the comma marks decimals
EUROPEAN_NUMBER = r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]{1,2}$|^-?[0-9]+,[0-9]{1,2}$"


def amount_number(text) -> Column:
    """The amount's number as plain ``1234.56`` text (null when none).

    Thousands separators go; a European spelling (``1.200,00``) has its dots
    dropped and its comma read as the decimal point.
    """
    def plain(num: Column) -> Column:
        euro = F.translate(num, ",.", ".")
        return F.when(num.rlike(EUROPEAN_NUMBER), euro).otherwise(F.translate(num, ",", ""))

    return let(F.nullif(F.regexp_extract(_col(text), AMOUNT_NUMBER, 1), F.lit("")), plain)


def extract_fields(text_col: str = "text") -> dict[str, Column]:
    """Rule-based extractor: the six fields as columns (null when absent)."""
    t = F.col(text_col)
    grab = {k: nullif_blank(F.regexp_extract(t, p, 1)) for k, p in FIELD_PATTERNS.items()}
    return {
        "invoice_number": grab["invoice_number"],
        "invoice_date": let(grab["invoice_date"], normalize_date),
        "seller_name": grab["seller_name"],
        "buyer_name": grab["buyer_name"],
        "total_amount": let(grab["amount_line"], lambda line: let(amount_number(line), parse_amount)),
        "currency": let(grab["amount_line"], normalize_currency),
    }


def extract_with_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns(extract_fields(text_col))


def extract_with(df: DataFrame, extractor=None, text_col: str = "text", fields: list[str] | None = None,
                 schema: str | None = None, make_extractor=None) -> DataFrame:
    """Run a user extractor over a text column with ``mapInPandas``.

    ``extractor(texts: pandas.Series) -> pandas.DataFrame`` has one column per
    field. Give ``make_extractor()`` instead when the extractor holds a client
    or model: it is called once per partition, and the extractor it returns
    is called once per Arrow batch. An exception for a batch is not raised:
    its rows get null fields and the message in ``extract_error``.
    """
    if (extractor is None) == (make_extractor is None):
        raise ValueError("give exactly one of extractor / make_extractor")
    flds = fields or EXTRACTION_FIELDS
    out_schema = schema or ", ".join(f"{f} string" for f in flds)
    base = df.schema.simpleString()[len("struct<"):-1]
    full_schema = f"{base}, {out_schema}, extract_error string"

    def run(batches):
        fn = extractor if extractor is not None else make_extractor()
        for pdf in batches:
            try:
                got = fn(pdf[text_col])
                err = None
            except Exception as e:  # noqa: BLE001 - a bad batch must not stop the job
                got, err = None, f"{type(e).__name__}: {e}"
            for f in flds:
                pdf[f] = got[f].values if got is not None and f in got else None
            pdf["extract_error"] = err
            yield pdf

    return df.mapInPandas(run, full_schema)


# ---------------------------------------------------------------- model replies

# A call to the model gets at most so many prompts and bytes of them; a longer prompt goes alone.
CALL_ROWS = 64
CALL_BYTES = 1 << 20
NOT_AN_OBJECT = "reply is JSON but no object"
EMPTY_REPLY = "no reply"


def ask_model(df: DataFrame, ask=None, prompt_col: str = "prompt", make_ask=None, call_rows: int = CALL_ROWS,
              call_bytes: int = CALL_BYTES) -> DataFrame:
    """Adds ``reply`` and ``reply_error``: what a model says to every prompt that is not null.

    ``ask(prompts: list[str]) -> list[str | None]``; give ``make_ask()`` instead where it holds a client or model, which is
    called once per partition. Calls are bounded by rows and bytes. When one raises, its prompts are asked one by one, so
    a prompt that fails costs its own row alone, whose message ``reply_error`` holds in full; the job goes on.
    """
    if (ask is None) == (make_ask is None):
        raise ValueError("give exactly one of ask / make_ask")
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("reply_error", T.StringType())])

    def called(fn, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            got = list(fn(prompts))
            if len(got) != len(prompts):
                raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
            return [(None if r is None else str(r), None) for r in got]
        except Exception as e:  # noqa: BLE001 - row errors are data
            if len(prompts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [called(fn, [p])[0] for p in prompts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = ask if ask is not None else make_ask()
        for b in batches:
            prompts = b.column(b.schema.names.index(prompt_col)).to_pylist()
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(prompts)
            todo: list[int] = []
            size = 0
            for i, p in enumerate([*prompts, None]):
                n = 0 if p is None else len(p.encode())
                if todo and (i == len(prompts) or len(todo) == call_rows or (p is not None and size + n > call_bytes)):
                    for j, r in zip(todo, called(fn, [prompts[j] for j in todo])):
                        out[j] = r
                    todo, size = [], 0
                if p is not None:
                    todo.append(i)
                    size += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())],
                                             names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def _parsed_reply(reply, flds: list[str]) -> Column:
    """STRUCT<fields ..., extras, reply_source, reply_problem>, all values as text: a reply is salvaged and read once, whatever is asked of it."""
    def read(s: Column) -> Column:
        value = s["value"]

        def parts(every: Column) -> Column:
            others = let(F.map_filter(every, lambda k, v: ~k.isin(*flds)), lambda o: F.when(F.size(o) > 0, o))
            problem = F.coalesce(s["error"], F.when(value.isNotNull() & every.isNull(), F.lit(NOT_AN_OBJECT)),
                                 F.when(_col(reply).isNull(), F.lit(EMPTY_REPLY)))
            return F.struct(*[F.element_at(every, f).alias(f) for f in flds], others.alias("extras"),
                            F.when(every.isNotNull(), s["source"]).alias("reply_source"), problem.alias("reply_problem"))

        return let(F.try_variant_get(value, "$", "map<string,string>"), parts)

    return let(salvage(reply), read)


def _reply_columns(parsed: Column, flds: list[str]) -> dict[str, Column]:
    got = {f: parsed[f] for f in (*flds, "extras", "reply_source", "reply_problem")}
    if "total_amount" in got:
        got["total_amount"] = parse_amount(got["total_amount"])
    return got


def reply_fields(reply, fields: list[str] | None = None) -> dict[str, Column]:
    """Record columns of a model's reply: the fields, ``extras``, ``reply_source`` and ``reply_problem``.

    The reply is salvaged strictly (``jsonparse.salvage``) and must be an object. Fields are its values as text, the amount parsed; a
    JSON null or an absent key is null. All other keys go to ``extras`` as text (nested values as JSON), null without any.
    """
    flds = fields or EXTRACTION_FIELDS
    return _reply_columns(_parsed_reply(reply, flds), flds)


def with_reply_fields(df: DataFrame, reply: str, fields: list[str] | None = None) -> DataFrame:
    """Adds ``reply_fields`` in two steps, so that no later column has a reply read again."""
    flds = fields or EXTRACTION_FIELDS
    return df.withColumn("_parsed", _parsed_reply(reply, flds)).withColumns(_reply_columns(F.col("_parsed"), flds)).drop("_parsed")


def model_extractor(ask=None, make_ask=None, fields: list[str] | None = None, **bounds: int):
    """An extractor for ``process_documents``: prompt, ask the model, turn its reply into a record.

    Only documents that passed the gate are asked about. Adds the fields, ``extras`` and ``extract_error``.
    """
    def extract(df: DataFrame) -> DataFrame:
        asked = ask_model(df.withColumn("prompt", F.when(F.col("passed"), build_prompt("text", fields))), ask, "prompt", make_ask, **bounds)
        read = with_reply_fields(asked, "reply", fields)
        read = read.withColumn("extract_error", F.when(F.col("passed"), F.coalesce("reply_error", "reply_problem")))
        return read.drop("prompt", "reply", "reply_error", "reply_source", "reply_problem")

    return extract


def rule_extractor(df: DataFrame) -> DataFrame:
    """The default extractor of ``process_documents``: rules over labelled lines, nothing but the six fields."""
    fields = {k: F.when(F.col("passed"), v) for k, v in extract_fields("text").items()}
    return df.withColumns({**fields, "extras": F.lit(None).cast("map<string,string>"), "extract_error": F.lit(None).cast("string")})
