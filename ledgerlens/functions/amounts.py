"""Amount, date and currency normalisation as Column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number as Python's float() reads it (after stripping): sign, digits
# with an optional fraction or a bare fraction, optional exponent, or
# inf / infinity / nan in any case. Spark's cast alone would also take
# suffixes such as "1d" or "1f", which float() rejects.
FLOAT_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"

_EDGE_SPACE = r"^\s+|\s+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_text(c) -> Column:
    """Remove leading and trailing whitespace (Python ``str.strip``)."""
    return F.regexp_replace(_col(c).cast("string"), _EDGE_SPACE, "")


def python_float(s: Column) -> Column:
    """Double from already-stripped text, null where float() would fail.

    NaN comes back as null: a NaN amount is stored as NULL by the record
    table, and Spark orders NaN above every number.
    """
    v = F.when(s.rlike(FLOAT_PATTERN), s.try_cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))


def parse_amount(c) -> Column:
    """Amount text to DOUBLE: drop every ``,`` and ``$``, strip, parse.

    Numbers pass through unchanged (as double); anything that does not parse
    is null.
    """
    s = strip_text(F.translate(_col(c).cast("string"), ",$", ""))
    return python_float(s)


def amount_warning(c) -> Column:
    """True when the amount is not a number after removing only ``,``.

    A null amount reads as the text ``None`` and warns too.
    """
    s = strip_text(F.translate(F.coalesce(_col(c).cast("string"), F.lit("None")), ",", ""))
    return python_float(s).isNull()


# Date layouts tried in order when normalising to ISO.
DATE_LAYOUTS = [
    "yyyy-MM-dd",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "dd/MM/yyyy",
    "yyyy/MM/dd",
    "dd.MM.yyyy",
]


def normalize_date(c) -> Column:
    """Date text to ISO ``yyyy-MM-dd`` using the first layout that parses.

    A layout is tried only on texts with its separators, as a failed parse is dear.
    """
    s = strip_text(c)
    tried = []
    for layout in DATE_LAYOUTS:
        fits = F.lit(True)
        for mark in (" ", ",", "-", "/", "."):
            has = s.contains(mark)
            if mark in layout:
                fits = fits & has
            elif mark in "/," or mark == "-":
                fits = fits & ~has
        tried.append(F.when(fits, F.try_to_date(s, layout)))
    return F.date_format(F.coalesce(*tried), "yyyy-MM-dd")


# Currency symbols mapped to ISO codes.
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR"}


# ISO 4217 codes in use.
ISO_CODES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC "
    "CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK "
    "JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR "
    "MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP "
    "STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
).split()


def normalize_currency(c) -> Column:
    """First ISO code (any case), or the code of a known symbol."""
    s = _col(c).cast("string")
    triples = F.regexp_extract_all(F.upper(s), F.lit(r"\b([A-Z]{3})\b"), 1)
    code = F.get(F.filter(triples, lambda t: t.isin(*ISO_CODES)), F.lit(0))
    sym = None
    for symbol, iso in CURRENCY_SYMBOLS.items():
        hit = F.when(F.instr(s, symbol) > 0, F.lit(iso))
        sym = hit if sym is None else F.coalesce(sym, hit)
    return F.coalesce(code, sym)


def nullif_blank(c) -> Column:
    """Null for null or whitespace-only text; the stripped text otherwise."""
    s = strip_text(c)
    return F.when(F.length(s) > 0, s)
