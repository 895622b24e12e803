"""Declared schemas. Readers and writers use these; nothing is inferred."""

from pyspark.sql import types as T

# The six fields asked of an extractor, in this order.
EXTRACTION_FIELDS = [
    "invoice_number",
    "invoice_date",
    "seller_name",
    "buyer_name",
    "total_amount",
    "currency",
]

# The currency codes recognised in query text, in list order
# (the first one found wins).
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CNY", "AUD", "CAD", "CHF", "INR"]

# Columns of the record report, in display order.
REPORT_COLUMNS = [
    "invoice_number", "invoice_date", "seller_name",
    "buyer_name", "total_amount", "currency", "extracted_at",
]

# Columns of the stored record table, in store order.
STORE_COLUMNS = [
    "invoice_number", "invoice_date", "seller_name", "buyer_name",
    "total_amount", "currency", "file_name", "extracted_at",
    "raw_text", "extraction_method",
]

INVOICE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("invoice_number", T.StringType(), True),
    T.StructField("invoice_date", T.StringType(), True),
    T.StructField("seller_name", T.StringType(), True),
    T.StructField("buyer_name", T.StringType(), True),
    T.StructField("total_amount", T.DoubleType(), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("file_name", T.StringType(), True),
    # ISO text, as stored; lexical order is time order.
    T.StructField("extracted_at", T.StringType(), True),
    T.StructField("raw_text", T.StringType(), True),
    T.StructField("extraction_method", T.StringType(), True),
    T.StructField("page_count", T.IntegerType(), True),
    T.StructField("total_amount_raw", T.StringType(), True),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType()), True),
])

VECTOR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("matched_text", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
])

VALIDATION_TYPE = T.StructType([
    T.StructField("is_valid", T.BooleanType(), False),
    T.StructField("missing_fields", T.ArrayType(T.StringType(), False), False),
    T.StructField("warnings", T.ArrayType(T.StringType(), False), False),
])
