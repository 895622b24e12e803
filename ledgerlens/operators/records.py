"""Record-level projections: validity, validation, flattening, store form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.amounts import amount_warning, strip_text
from ledgerlens.schema import EXTRACTION_FIELDS, REPORT_COLUMNS, STORE_COLUMNS

# Texts that do not count as a meaningful field value.
EMPTY_MARKERS = ["None", "0", "0.0"]
# The key fields of the validity rule and how many must be set.
KEY_FIELDS = ["invoice_number", "seller_name", "buyer_name", "total_amount"]
MIN_KEY_FIELDS = 2
AMOUNT_WARNING = "total_amount is not numeric"


def meaningful(df: DataFrame, name: str) -> Column:
    """A field holds real data: present, not blank, not ``None``/``0``/``0.0``.

    Numbers are judged by how Python prints them: zero prints ``0.0``.
    """
    c = F.col(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & (c != 0)
    if isinstance(dtype, T.NumericType):
        return c.isNotNull() & (c != 0)
    s = c.cast("string")
    return (c.isNotNull() & (F.length(strip_text(s)) > 0) & ~s.isin(*EMPTY_MARKERS))


def is_valid_record(df: DataFrame, fields: list[str] = KEY_FIELDS,
                    min_fields: int = MIN_KEY_FIELDS) -> Column:
    """At least ``min_fields`` of the key fields hold meaningful data."""
    score = sum(F.when(meaningful(df, f), 1).otherwise(0) for f in fields if f in df.columns)
    return score >= min_fields


def valid_records(df: DataFrame) -> DataFrame:
    return df.filter(is_valid_record(df))


def validation(df: DataFrame, required_fields: list[str] | None = None) -> Column:
    """STRUCT<is_valid, missing_fields ARRAY, warnings ARRAY>.

    A required field that is absent or null is missing. An amount that is not
    a number after removing ``,`` (only) warns, a null amount included.
    """
    required = required_fields or EXTRACTION_FIELDS
    missing = F.array_compact(F.array(*[
        (F.when(F.col(f).isNull(), F.lit(f)) if f in df.columns else F.lit(f)) for f in required
    ]))
    if "total_amount" in df.columns:
        warnings = F.array_compact(F.array(F.when(amount_warning("total_amount"), F.lit(AMOUNT_WARNING))))
    else:
        warnings = F.array().cast("array<string>")
    return F.struct((F.size(missing) == 0).alias("is_valid"), missing.alias("missing_fields"),
                    warnings.alias("warnings"))


def validate_records(df: DataFrame, required_fields: list[str] | None = None) -> DataFrame:
    return df.withColumn("validation", validation(df, required_fields))


def assemble_record(extracted: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Merge extracted fields with file facts; file facts win on a clash."""
    return extracted.withColumns(facts)


def report_projection(df: DataFrame, columns: list[str] = REPORT_COLUMNS) -> DataFrame:
    """The report columns that the table has, in report order."""
    return df.select(*[c for c in columns if c in df.columns])


def store_projection(df: DataFrame) -> DataFrame:
    """Fixed store columns; missing text columns default to ``''``."""
    out = []
    for c in STORE_COLUMNS:
        if c in ("raw_text", "extraction_method"):
            src = F.col(c) if c in df.columns else F.lit(None).cast("string")
            out.append(F.coalesce(src, F.lit("")).alias(c))
        elif c in df.columns:
            out.append(F.col(c))
        else:
            out.append(F.lit(None).cast("double" if c == "total_amount" else "string").alias(c))
    keep = [c for c in ("id",) if c in df.columns]
    return df.select(*keep, *out)


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Flatten nested structs into ``parent_child`` columns; arrays and maps
    stay as they are; on a name clash the later column wins."""
    cols: dict[str, Column] = {}

    def walk(prefix: str, path: str, dtype: T.DataType) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f"{prefix}{sep}{f.name}" if prefix else f.name,
                     f"{path}.`{f.name}`" if path else f"`{f.name}`", f.dataType)
        else:
            cols.pop(prefix, None)
            cols[prefix] = F.col(path).alias(prefix)

    for f in df.schema.fields:
        walk(f.name, f"`{f.name}`", f.dataType)
    return df.select(*cols.values())
