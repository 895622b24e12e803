from pyspark.sql import functions as F

from ledgerlens.operators import analytics


def _inv(spark):
    rows = [("A", "B1", 10.0, "USD"), ("A", "B2", None, "EUR"), ("C", "B1", 5.0, None),
            (None, "", 1.0, "USD"), ("D", "B3", None, None)]
    return spark.createDataFrame(rows, "seller_name string, buyer_name string, total_amount double, "
                                       "currency string")


def test_summary_like_pandas(spark):
    s = analytics.summary_stats(_inv(spark)).first()
    # count all rows; sum/mean skip nulls; distinct skips null, counts '' as a value
    assert (s.n_records, s.total_value, s.avg_amount, s.n_currencies, s.n_sellers) == (5, 16.0, 16.0 / 3, 2, 3)
    d = analytics.distinct_counts(_inv(spark)).first()
    assert (d.n_currencies, d.n_sellers, d.n_buyers) == (2, 3, 4)
    empty = analytics.summary_stats(_inv(spark).filter(F.lit(False))).first()
    assert empty.total_value == 0.0 and empty.avg_amount is None


def test_frequencies_and_top(spark):
    assert [tuple(r) for r in analytics.currency_distribution(_inv(spark)).collect()] == [("USD", 2), ("EUR", 1)]
    assert [tuple(r) for r in analytics.top_sellers(_inv(spark), 2).collect()] == [("A", 2), ("C", 1)]
    t = {r.currency: (r.n_records, r.total_value) for r in analytics.per_currency_totals(_inv(spark)).collect()}
    assert t == {"USD": (2, 11.0), "EUR": (1, 0.0), None: (2, 5.0)}


def test_approx_distinct_close(spark):
    df = spark.range(0, 20000).select((F.col("id") % 5000).cast("string").alias("seller_name"),
                                      F.lit("b").alias("buyer_name"), F.lit("USD").alias("currency"))
    n = analytics.distinct_counts(df, approx=True, rsd=0.01).first().n_sellers
    assert abs(n - 5000) / 5000 < 0.05      # 5 sigma at rsd 1%
