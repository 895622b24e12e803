"""Derived views over the driver's tables that feed every operator.

Each view is a pure DataFrame plan over the given parquet tables, so its
work grows with them. Modular arithmetic on keys only *varies* values
(nulls, blanks, amount spellings); no view drops rows by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import parse_amount
from ledgerlens.schema import CURRENCIES
from ledgerlens.sources.tables import read_table


def _money_text(price: Column) -> Column:
    """Price as plain text with two decimals, e.g. ``112946.26``."""
    return price.try_cast("decimal(15,2)").cast("string")


def thousands(amt: Column) -> Column:
    """Insert one thousands comma into two-decimal text below one million."""
    n = F.length(amt)
    return F.when(
        n > 6,
        F.concat(amt.substr(F.lit(1), n - 6), F.lit(","), amt.substr(n - 5, F.lit(1_000_000))),
    ).otherwise(amt)


# What each column of the raw view is made of besides ``orders``.
_FROM_CUSTOMER = {"buyer_name", "currency"}
_FROM_SUPPLIER = {"seller_name"}
RAW_COLUMNS = ["src_id", "invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency", "file_name",
               "extracted_at", "o_custkey", "o_totalprice", "o_orderdate"]


def invoices_raw(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One raw invoice record per order (extractor output before cleaning).

    orders -> customer (buyer, currency by nation) and per-order first
    supplier (seller). The lineitem side is pre-aggregated to one row per
    order before it meets orders, so the join is 1:1 on a unique key. With ``columns`` only these are made, and only the
    tables they come from are joined: an outer join on a key that is unique in the data can't be left out by the planner.
    """
    columns = columns or tuple(RAW_COLUMNS)
    j = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if _FROM_CUSTOMER & set(columns):
        c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
        j = j.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    if _FROM_SUPPLIER & set(columns):
        first_supp = (read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
                      .groupBy("l_orderkey").agg(F.min("l_suppkey").alias("first_suppkey")))
        s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
        j = (j.join(first_supp, F.col("o_orderkey") == F.col("l_orderkey"), "left")
              .join(s, F.col("first_suppkey") == F.col("s_suppkey"), "left"))

    k = F.col("o_orderkey")
    amt = _money_text(F.col("o_totalprice"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    m6 = k % 6
    made = {
        "src_id": lambda: k,
        "invoice_number": lambda: F.when(k % 13 != 0, F.concat(F.lit("INV-"), F.lpad((k % 12000).cast("string"), 8, "0"))),
        "invoice_date": lambda: date,
        "seller_name": lambda: F.col("s_name"),
        "buyer_name": lambda: F.when(k % 17 == 0, F.lit("")).otherwise(F.col("c_name")),
        "total_amount": lambda: (F.when(m6 == 1, F.lit("N/A"))
                                 .when(m6 == 2, amt)
                                 .when(m6 == 3, F.concat(F.lit("$"), thousands(amt)))
                                 .when(m6 == 4, F.concat(F.lit(" "), amt, F.lit(" ")))
                                 .when(m6 == 5, F.lit("0"))),
        "currency": lambda: F.when(k % 11 != 0, F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]),
                                                             (F.col("c_nationkey") % 9 + 1).cast("int"))),
        "file_name": lambda: F.concat(F.lit("doc_"), (k % 12000).cast("string"), F.lit(".pdf")),
        "extracted_at": lambda: F.concat(date, F.lit("T"), F.lpad((k % 86400).cast("string"), 6, "0")),
    }
    return j.select(*[made[c]().alias(c) if c in made else F.col(c) for c in columns])


def render_invoice_text(df: DataFrame) -> Column:
    """Plain invoice text with one labelled field per line (the sample layout)."""
    amt = _money_text(F.col("o_totalprice"))
    return F.concat_ws(
        "\n",
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice No: "), F.coalesce("invoice_number", F.lit(""))),
        F.concat(F.lit("Date: "), F.col("invoice_date")),
        F.concat(F.lit("From: "), F.coalesce("seller_name", F.lit(""))),
        F.lit(""),
        F.concat(F.lit("To: "), F.coalesce("buyer_name", F.lit(""))),
        F.concat(F.lit("Account "), F.col("o_custkey").cast("string")),
        F.lit(""),
        F.concat(F.lit("Total Amount: $"), thousands(amt), F.lit(" "), F.coalesce("currency", F.lit(""))),
    )


def invoice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src_id, text)``: one rendered invoice per order."""
    raw = invoices_raw(spark, sf_dir)
    return raw.select("src_id", render_invoice_text(raw).alias("text"))


INVOICE_COLUMNS = ["id", "invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency", "file_name",
                   "extracted_at", "raw_text", "extraction_method", "page_count", "total_amount_raw"]
_RENDERED = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "currency", "o_custkey", "o_totalprice"]


def invoices(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The cleaned record table (store form of every raw invoice), or the given columns of it."""
    columns = columns or tuple(INVOICE_COLUMNS)
    source = {"id": ["src_id"], "total_amount_raw": ["total_amount"], "raw_text": _RENDERED, "extraction_method": [], "page_count": []}
    need = {"src_id"}.union(*(source.get(c, [c]) for c in columns))
    raw = invoices_raw(spark, sf_dir, *[c for c in RAW_COLUMNS if c in need])
    made = {
        "id": lambda: F.col("src_id"),
        "total_amount": lambda: parse_amount("total_amount"),
        "raw_text": lambda: render_invoice_text(raw),
        "extraction_method": lambda: F.lit("pymupdf"),
        "page_count": lambda: F.lit(1),
        "total_amount_raw": lambda: F.col("total_amount"),
    }
    return raw.select(*[made[c]().alias(c) if c in made else F.col(c) for c in columns])


def invoice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extraction candidates per rendered invoice: the first is cut short for every fourth, the second for every eighth, and
    every 40th document is too short altogether."""
    t = invoice_text(spark, sf_dir)
    k = F.col("src_id")
    return t.select(
        "src_id",
        F.when(k % 4 == 0, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("text_1"),
        F.when(k % 8 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text_2"),
        F.when(k % 40 == 0, F.substring("text", 1, 12)).otherwise(F.col("text")).alias("text_3"),
    )


def supplier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s_suppkey, text)``: one short invoice text per supplier; every seventh has no number, and every tenth is no invoice."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal")
    k = F.col("s_suppkey")
    text = F.concat_ws(
        "\n",
        F.when(k % 7 != 0, F.concat(F.lit("Invoice Number: S-"), k.cast("string"))),
        F.lit("Date: 2024-03-05"),
        F.concat(F.lit("Seller: "), F.col("s_name")),
        F.concat(F.lit("Buyer: House "), (k % 5).cast("string")),
        F.concat(F.lit("Total: "), _money_text(F.col("s_acctbal")), F.lit(" EUR")),
    )
    return s.select("s_suppkey", F.when(k % 10 == 0, F.lit("a note")).otherwise(text).alias("text"))


def record_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, reply)``: model replies that hold a record, built around ``events.props``: plain, wrapped in prose, with JSON
    nulls and missing fields, an array, and no JSON at all."""
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    k = F.col("event_id")
    m = k % 6
    amount = _money_text(F.col("value"))
    body = F.concat(
        F.lit('{"invoice_number": "E-'), k.cast("string"), F.lit('", "invoice_date": "2024-01-15", "seller_name": "'), F.col("event_type"),
        F.when(m == 2, F.lit('", "buyer_name": null, "total_amount": ')).otherwise(
            F.concat(F.lit('", "buyer_name": "user '), F.col("user_id").cast("string"), F.lit('", "total_amount": '))),
        F.when(m == 1, F.concat(F.lit('"$'), amount, F.lit('"'))).when(m == 3, F.lit('"n/a"')).otherwise(amount),
        F.when(m != 2, F.lit(', "currency": "EUR"')).otherwise(F.lit("")),
        F.lit(", "), F.substring(F.col("props"), 2, 1_000_000))
    reply = (F.when(m == 4, F.concat(F.lit("["), body, F.lit("]"))).when(m == 5, F.concat(F.lit("sorry, "), F.col("event_type")))
             .when(m == 3, F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone."))).otherwise(body))
    return e.select("event_id", reply.alias("reply"))


def doc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extraction candidates per document (short first attempts vary by id)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    k = F.col("doc_id")
    return d.select(
        "doc_id",
        F.when(k % 4 == 0, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("text_1"),
        F.when(k % 8 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text_2"),
        F.col("text").alias("text_3"),
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractor replies of four shapes built from ``events.props``."""
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "props")
    m = F.col("event_id") % 4
    reply = (F.when(m == 0, F.col("props"))
             .when(m == 1, F.concat(F.lit("Sure! "), F.col("props"), F.lit(" Done.")))
             .when(m == 2, F.concat(F.lit("no json "), F.col("event_type")))
             .otherwise(F.concat(F.lit("x "), F.col("props"), F.lit("\n"), F.col("props"))))
    return e.select("event_id", reply.alias("reply"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-English search requests, one per order, in eight phrasings.

    ``(qid, text)``; numbers and currency codes come from the order, so the
    phrasings exercise every filter rule of the query-text parser.
    """
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    cur = F.element_at(F.array(*[F.lit(x) for x in CURRENCIES]), (F.col("o_custkey") % 9 + 1).cast("int"))
    whole = F.floor(F.col("o_totalprice")).cast("bigint").cast("string")
    small = (F.col("o_custkey") % 1000).cast("string")
    m = k % 8
    text = (F.when(m == 0, F.concat(F.lit("show invoices above "), whole, F.lit(" "), cur))
            .when(m == 1, F.concat(F.lit("not in "), F.lower(cur), F.lit(" under "), small, F.lit(".5")))
            .when(m == 2, F.concat(F.lit("European invoices over $"), small))
            .when(m == 3, F.concat(F.lit("moreover "), small))
            .when(m == 4, F.concat(F.lit("except "), cur, F.lit(" more than "), small,
                                   F.lit(" and less than "), whole))
            .when(m == 5, F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit(" from january 2024")))
            .when(m == 6, F.concat(F.lit(">= "), small, F.lit(" "), cur, F.lit(" or <= "), whole))
            .otherwise(F.concat(F.lit("other than "), F.lower(cur), F.lit(", thunder "), small)))
    return o.select(k.alias("qid"), text.alias("text"))
