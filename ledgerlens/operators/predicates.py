"""Record filters: attribute search (store side) and search-side filters.

Criteria become one Column predicate so Catalyst can push the comparable
parts (``=``, ``>=``, ``<=``) into the parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import parse_amount

# The criteria of an attribute search and the column each reads.
LIKE_CRITERIA = {
    "invoice_number": "invoice_number",
    "seller_name": "seller_name",
    "buyer_name": "buyer_name",
}


def _and(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def like_contains(col: str, value: str) -> Column:
    """``col LIKE '%value%'``, case-insensitive; ``%`` and ``_`` in the value
    stay wildcards, a backslash is itself. Null never matches."""
    value = value.replace("\\", "\\\\")
    return F.coalesce(F.col(col).ilike(f"%{value}%"), F.lit(False))


def amount_at_least(col: str, value: float) -> Column:
    return F.col(col) >= F.lit(float(value))


def amount_at_most(col: str, value: float) -> Column:
    return F.col(col) <= F.lit(float(value))


def currency_is(col: str, value: str) -> Column:
    return F.col(col) == F.lit(value)


def attribute_predicate(query: dict) -> Column:
    """AND of the given criteria; unknown keys are ignored, none -> all rows."""
    preds = []
    for key, col in LIKE_CRITERIA.items():
        if key in query:
            preds.append(like_contains(col, str(query[key])))
    if "min_amount" in query:
        preds.append(amount_at_least("total_amount", query["min_amount"]))
    if "max_amount" in query:
        preds.append(amount_at_most("total_amount", query["max_amount"]))
    if "currency" in query:
        preds.append(currency_is("currency", query["currency"]))
    return _and(preds)


def newest_first(df: DataFrame) -> DataFrame:
    """Order by ingestion time, newest first; ties by id (newest id first)."""
    return df.orderBy(F.col("extracted_at").desc_nulls_last(), F.col("id").desc())


def attribute_search(df: DataFrame, query: dict, ordered: bool = True) -> DataFrame:
    out = df.filter(attribute_predicate(query))
    return newest_first(out) if ordered else out


def search_filter(record_amount: Column, record_currency: Column, record_seller: Column,
                  record_buyer: Column, min_amount: Column | None = None,
                  max_amount: Column | None = None, currency: Column | None = None,
                  exclude_currency: Column | None = None, seller_name: Column | None = None,
                  buyer_name: Column | None = None, amount_parsed: bool = False) -> Column:
    """Search-side filters; each filter column applies only where it is set.

    The record amount is parsed first, and an unparsable amount fails any
    amount bound. Exclusion keeps records with no currency. Seller and buyer
    match as case-folded substrings; a missing name never matches.
    """
    preds = []
    if min_amount is not None or max_amount is not None:
        amt = record_amount.cast("double") if amount_parsed else parse_amount(record_amount)
    if min_amount is not None:
        preds.append(min_amount.isNull() | F.coalesce(amt >= min_amount, F.lit(False)))
    if max_amount is not None:
        preds.append(max_amount.isNull() | F.coalesce(amt <= max_amount, F.lit(False)))
    if currency is not None:
        preds.append(currency.isNull() | F.coalesce(record_currency == currency, F.lit(False)))
    if exclude_currency is not None:
        preds.append(exclude_currency.isNull() | ~record_currency.eqNullSafe(exclude_currency))
    for rec, flt in ((record_seller, seller_name), (record_buyer, buyer_name)):
        if flt is not None:
            preds.append(flt.isNull() | F.coalesce(F.instr(F.lower(rec), F.lower(flt)) > 0,
                                                   F.lit(False)))
    return _and(preds)


def filters_from_dict(filters: dict | None) -> dict:
    """Python filter dict -> literal filter columns for ``search_filter``."""
    filters = filters or {}
    out = {}
    for k in ("min_amount", "max_amount"):
        if k in filters:
            out[k] = F.lit(float(filters[k]))
    for k in ("currency", "exclude_currency", "seller_name", "buyer_name"):
        if k in filters:
            out[k] = F.lit(str(filters[k]))
    return out
