"""Summary analytics over the record table.

Each summary is one aggregate job; Spark aggregates partially on every
partition before the shuffle, so a hot seller or currency costs one row
per partition, not one row per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many sellers the top-sellers report lists.
TOP_SELLERS = 10


def summary_stats(df: DataFrame) -> DataFrame:
    """Count, total (0 when no amount), mean, distinct currencies and sellers."""
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("total_value"),
        F.avg("total_amount").alias("avg_amount"),
        F.countDistinct("currency").alias("n_currencies"),
        F.countDistinct("seller_name").alias("n_sellers"),
    )


def distinct_counts(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Distinct currencies, sellers and buyers (nulls not counted).

    ``approx=True`` uses HyperLogLog++ sketches (relative standard deviation
    ``rsd``), which merge without a shuffle of the distinct values themselves.
    """
    f = (lambda c: F.approx_count_distinct(c, rsd)) if approx else (lambda c: F.countDistinct(c))
    return df.agg(f("currency").alias("n_currencies"), f("seller_name").alias("n_sellers"),
                  f("buyer_name").alias("n_buyers"))


def per_currency_totals(df: DataFrame) -> DataFrame:
    """Totals kept apart by currency (the mixed total adds unlike money)."""
    return (df.groupBy("currency")
              .agg(F.count(F.lit(1)).alias("n_records"),
                   F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("total_value")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first (ties by value)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.col("count").desc(), F.col(col)))


def currency_distribution(df: DataFrame) -> DataFrame:
    return value_counts(df, "currency")


def top_sellers(df: DataFrame, n: int = TOP_SELLERS) -> DataFrame:
    """The ``n`` sellers with the most records (a top-k report)."""
    return value_counts(df, "seller_name").limit(n)


def batch_tally(results: DataFrame, success_col: str = "success") -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.col(success_col)).alias("successful"),
                       F.count_if(~F.col(success_col)).alias("failed"))
