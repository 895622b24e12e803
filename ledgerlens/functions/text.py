"""Text columns: search text, prefixes, report labels, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import strip_text

# How many leading characters of the raw text go into the
# search text.
SEARCH_TEXT_PREFIX = 500
# Separator between the parts of the search text.
SEARCH_TEXT_SEPARATOR = " | "

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy_text(c) -> Column:
    """Python truthiness of a text field: present and not empty."""
    c = _col(c)
    return c.isNotNull() & (F.length(c) > 0)


def amount_text(c) -> Column:
    """A money amount in plain decimals, at least one: ``52500.0``, ``1234.567``.

    Going through DECIMAL (ten decimals) avoids Spark's ``1.0E7`` spelling.
    """
    return F.regexp_replace(_col(c).try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]+?)0+$", "$1")


def document_text(number="invoice_number", seller="seller_name", buyer="buyer_name",
                  amount="total_amount", currency="currency", date="invoice_date",
                  raw_text="raw_text", prefix: int | None = None) -> Column:
    """The text embedded for search: labelled parts joined by `` | ``.

    Empty parts are skipped (``concat_ws`` drops nulls). The amount part
    needs both a non-zero amount and a currency. ``prefix`` cuts the raw
    text to its first characters (``SEARCH_TEXT_PREFIX`` is the compatible value).
    """
    amt = _col(amount)
    amount_ok = amt.isNotNull() & (amt != 0) & truthy_text(currency)
    return F.concat_ws(
        SEARCH_TEXT_SEPARATOR,
        F.when(truthy_text(number), F.concat(F.lit("Invoice Number: "), _col(number))),
        F.when(truthy_text(seller), F.concat(F.lit("Seller: "), _col(seller))),
        F.when(truthy_text(buyer), F.concat(F.lit("Buyer: "), _col(buyer))),
        F.when(amount_ok, F.concat(F.lit("Amount: "), amount_text(amt), F.lit(" "), _col(currency))),
        F.when(truthy_text(date), F.concat(F.lit("Date: "), _col(date))),
        F.when(truthy_text(raw_text), _col(raw_text) if prefix is None else text_prefix(raw_text, prefix)),
    )


def text_prefix(c, n: int = SEARCH_TEXT_PREFIX) -> Column:
    """First ``n`` characters."""
    return F.substring(_col(c), 1, n)


def tokens(c) -> Column:
    """Lower-case word tokens split on anything that is not a letter or digit."""
    return F.filter(F.split(F.lower(_col(c)), TOKEN_SPLIT), lambda t: t != "")


def money_label(c) -> Column:
    """``$#,##0.00``; ``$0.00`` for a missing total."""
    return F.concat(F.lit("$"), F.format_number(F.coalesce(_col(c), F.lit(0.0)), 2))


def amount_currency_label(amount, currency) -> Column:
    """``<amount> <currency>`` with ``N/A`` for a missing part."""
    return F.concat_ws(" ", F.coalesce(amount_text(amount), F.lit("N/A")),
                       F.coalesce(_col(currency), F.lit("N/A")))


def size_kb_label(nbytes) -> Column:
    """Size in KB with two decimals."""
    return F.concat(F.format_number(_col(nbytes) / 1024.0, 2), F.lit(" KB"))


def na_label(c) -> Column:
    """The value as text, or ``N/A`` when missing."""
    return F.coalesce(_col(c).cast("string"), F.lit("N/A"))


def nonblank(c) -> Column:
    """True when the value's text, stripped, is not empty."""
    return F.length(strip_text(c)) > 0
