"""Filters read out of a plain-English search request, as Column expressions.

Applied to a table of requests, each rule is one JVM expression per row,
so a million requests parse in one narrow projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import CURRENCIES

# Words that mark an exclusion request.
EXCLUSION_WORDS = ["not in", "except", "other than", "excluding"]
# The lower-bound and upper-bound patterns.
MIN_PATTERN = r"(?:above|over|more than|greater than|>|>=)\s*\$?(\d+(?:\.\d+)?)"
MAX_PATTERN = r"(?:below|under|less than|<|<=)\s*\$?(\d+(?:\.\d+)?)"
# Whole-word variants (opt-in): keywords must not sit inside longer words.
MIN_PATTERN_WORDS = r"(?:\babove\b|\bover\b|\bmore than\b|\bgreater than\b|>|>=)\s*\$?(\d+(?:\.\d+)?)"
MAX_PATTERN_WORDS = r"(?:\bbelow\b|\bunder\b|\bless than\b|<|<=)\s*\$?(\d+(?:\.\d+)?)"
# With ``thousands=True`` the number may carry thousands commas.
NUMBER_THOUSANDS = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains(q: Column, word: str, word_bounds: bool) -> Column:
    if word_bounds:
        return q.rlike(r"\b" + word + r"\b")
    return F.instr(q, word) > 0


def exclusion_intent(text, word_bounds: bool = False) -> Column:
    q = F.lower(_col(text))
    return reduce(lambda a, b: a | b, [_contains(q, w, word_bounds) for w in EXCLUSION_WORDS])


def first_currency(text, word_bounds: bool = False) -> Column:
    """The first code of the list (in list order) that occurs in the text."""
    q = F.lower(_col(text))
    out = F.lit(None).cast("string")
    for code in reversed(CURRENCIES):
        out = F.when(_contains(q, code.lower(), word_bounds), F.lit(code)).otherwise(out)
    return out


def exclude_currency(text, word_bounds: bool = False) -> Column:
    return F.when(exclusion_intent(text, word_bounds), first_currency(text, word_bounds))


def _bound(text, pattern: str, thousands: bool) -> Column:
    if thousands:
        pattern = pattern.replace(r"(\d+(?:\.\d+)?)", NUMBER_THOUSANDS)
    num = F.nullif(F.regexp_extract(F.lower(_col(text)), pattern, 1), F.lit(""))
    return F.translate(num, ",", "").try_cast("double")


def min_amount(text, thousands: bool = False, word_bounds: bool = False) -> Column:
    return _bound(text, MIN_PATTERN_WORDS if word_bounds else MIN_PATTERN, thousands)


def max_amount(text, thousands: bool = False, word_bounds: bool = False) -> Column:
    return _bound(text, MAX_PATTERN_WORDS if word_bounds else MAX_PATTERN, thousands)


def text_currency(text, word_bounds: bool = False) -> Column:
    """Currency asked for, only when the request is not an exclusion."""
    return F.when(exclude_currency(text, word_bounds).isNull(), first_currency(text, word_bounds))


def form_amount(c) -> Column:
    """A form amount counts only when it is above zero."""
    c = _col(c)
    return F.when(c > 0, c.cast("double"))


def form_text(c) -> Column:
    """A form text counts only when it is not empty."""
    c = _col(c)
    return F.when(c.isNotNull() & (F.length(c) > 0), c)


def resolve_filters(df: DataFrame, text: str = "text", ui_min: str | None = None,
                    ui_max: str | None = None, ui_seller: str | None = None,
                    ui_currency: str | None = None, thousands: bool = False,
                    word_bounds: bool = False) -> DataFrame:
    """Add the filter columns of every request: form values beat text values.

    Adds ``min_amount, max_amount, currency, exclude_currency, seller_name``.
    """
    def form(c, kind):
        if c is None:
            return F.lit(None).cast("double" if kind == "amount" else "string")
        return form_amount(c) if kind == "amount" else form_text(c)

    # shared parts computed once as columns (a non-trivial expression used
    # twice keeps Catalyst from merging the projections, so it is not repeated)
    staged = df.withColumns({"_nl_text": F.lower(F.col(text))})
    staged = staged.withColumns({"_nl_excl": exclusion_intent("_nl_text", word_bounds),
                                 "_nl_code": first_currency("_nl_text", word_bounds)})
    excluded = F.when(F.col("_nl_excl"), F.col("_nl_code"))
    return staged.withColumns({
        "min_amount": F.coalesce(form(ui_min, "amount"), min_amount("_nl_text", thousands, word_bounds)),
        "max_amount": F.coalesce(form(ui_max, "amount"), max_amount("_nl_text", thousands, word_bounds)),
        "currency": F.coalesce(form(ui_currency, "text"), F.when(excluded.isNull(), F.col("_nl_code"))),
        "exclude_currency": excluded,
        "seller_name": form(ui_seller, "text"),
    }).drop("_nl_text", "_nl_excl", "_nl_code")
