import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import normalize_currency, normalize_date, parse_amount


def run(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(parse_amount("s")).collect()]


CASES = {"52,500.00": 52500.0, "$52,500": 52500.0, " 123.45 ": 123.45, "\t7\n": 7.0, "1e5": 100000.0, ".5": 0.5, "1.": 1.0,
         "-$5": -5.0, "(500)": None, "N/A": None, None: None, "0": 0.0, "": None, "  ": None, "inf": math.inf,
         "-Infinity": -math.inf, "nan": None, "1,2,3": 123.0, "$": None, "12abc": None, "1d": None, "1f": None}


def test_parse_amount_cases(spark):
    assert run(spark, list(CASES)) == list(CASES.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=20), st.sampled_from(["{}", "${}", " {} ", "{} ", "\t{}"]))
def test_grouping_and_dollar_signs_do_not_change_an_amount(spark, cents, around):
    assert run(spark, [around.format(f"{c / 100:,.2f}") for c in cents]) == [c / 100 for c in cents]


def test_parse_amount_numbers_pass_through(spark):
    df = spark.createDataFrame([(52500.0,), (None,)], "x double")
    assert [r[0] for r in df.select(parse_amount("x")).collect()] == [52500.0, None]


def test_normalize_date_and_currency(spark):
    rows = [("January 15, 2024", "USD"), ("2024-01-15", "usd"), ("15/01/2024", "$"),
            ("Jan 15, 2024", " eur "), ("not a date", None), ("15.01.2024", "€ 20")]
    df = spark.createDataFrame(rows, "d string, c string")
    got = df.select(normalize_date("d"), normalize_currency("c")).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-15", "USD"), ("2024-01-15", "USD"), ("2024-01-15", "USD"),
        ("2024-01-15", "EUR"), (None, None), ("2024-01-15", "EUR")]
