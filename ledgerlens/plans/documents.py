"""Per-document processing over a document table (batch ingest).

Every stage is a narrow projection of the same rows: candidates -> cascade
-> short-text gate -> field extraction -> validation -> result. Row errors
are data (an ``errors`` array), never task failures, so one bad document
never stops the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.extraction import METHODS, cascade, rule_extractor, short_text_gate
from ledgerlens.operators.records import validation
from ledgerlens.schema import EXTRACTION_FIELDS


def process_documents(candidates: DataFrame, id_col: str, candidate_cols: list[str],
                      use_ocr: bool = True, page_separator: str = "\n", keep: list[str] | tuple = (),
                      extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One result row per document.

    ``(id, *keep, success, errors, text, text_length, extraction_method, page_count,
    <six fields>, extras, validation)``. Failed rows keep null fields.

    ``extractor`` is ``extraction.rule_extractor`` (the default), ``extraction.model_extractor(...)`` or any function that, given rows with
    ``text`` and ``passed``, adds the six fields, ``extras`` (map of other values) and ``extract_error``. A document
    whose extraction failed is not successful, and has no fields.
    """
    df = cascade(candidates, candidate_cols, METHODS, use_ocr=use_ocr)
    df = (extractor or rule_extractor)(short_text_gate(df, "text"))
    wrong = F.col("extract_error").isNotNull()
    df = df.withColumns({"success": F.col("passed") & ~wrong, "errors": F.array_compact(F.array_append("errors", F.col("extract_error")))})
    df = df.withColumns({c: F.when(F.col("success"), F.col(c)) for c in (*EXTRACTION_FIELDS, "extras")})
    # a failed document has no fields: validation reports all of them missing
    df = df.withColumn("validation", validation(df))
    sep = page_separator.replace("\\", "\\\\")
    return df.select(
        id_col, *keep,
        "success",
        "errors",
        "text",
        F.length("text").alias("text_length"),
        "extraction_method",
        F.size(F.split(F.coalesce(F.col("text"), F.lit("")), sep, -1)).alias("page_count"),
        *EXTRACTION_FIELDS,
        "extras",
        "validation",
    )
