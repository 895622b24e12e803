"""Strict JSON salvage of extractor replies, JVM-side.

A reply is used as is when it is one JSON value; otherwise the greedy
``{...}`` span (dot matches newline) is tried; otherwise the row records an
error with the first 200 characters of the reply.

Spark's JSON readers accept trailing text (``{"a":1} x`` parses), which a
strict parser rejects. The candidate is read as the first of two array
elements, the second being its own digest: text that ends the candidate early
would have to hold that digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEDY_OBJECT = r"(?s)\{.*\}"
ERROR_PREVIEW = 200


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often and wherever ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strict_json(text) -> Column:
    """VARIANT of the whole text when it is exactly one JSON value, else null."""
    def whole(digest: Column) -> Column:
        pair = F.try_parse_json(F.concat(F.lit("["), _col(text), F.lit(',"'), digest, F.lit('"]')))
        return let(pair, lambda p: F.when((F.try_variant_get(p, "$[1]", "string") == digest)
                                          & F.try_variant_get(p, "$[2]", "variant").isNull(), F.try_variant_get(p, "$[0]", "variant")))

    return let(F.md5(_col(text)), whole)


def greedy_span(text) -> Column:
    return F.nullif(F.regexp_extract(_col(text), GREEDY_OBJECT, 0), F.lit(""))


def salvage(text) -> Column:
    """STRUCT<value VARIANT, source STRING, error STRING>. The span is looked at only where the whole text fails."""
    preview = F.concat(F.lit("no valid JSON in reply: "), F.substring(_col(text), 1, ERROR_PREVIEW))

    def outcome(direct: Column) -> Column:
        return F.when(direct.isNotNull(), _outcome(direct, F.lit("direct"), F.lit(None))).otherwise(
            let(strict_json(greedy_span(text)), lambda span: _outcome(
                span, F.when(span.isNotNull(), F.lit("span")), F.when(span.isNull(), preview))))

    return let(strict_json(text), outcome)


def _outcome(value: Column, source: Column, error: Column) -> Column:
    return F.struct(value.alias("value"), source.cast("string").alias("source"), error.cast("string").alias("error"))


def field(value: Column, name: str, type_: str = "string") -> Column:
    """One field of a salvaged object, cast leniently (null on mismatch)."""
    return F.try_variant_get(value, f"$.{name}", type_)
