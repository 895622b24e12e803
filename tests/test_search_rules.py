from pyspark.sql import functions as F

from ledgerlens.functions.text import document_text
from ledgerlens.operators.predicates import attribute_search, like_contains, search_filter


def _recs(spark):
    rows = [(1, "$1,200", "USD", "ABC Ltd", "Buyer X"), (2, "N/A", "USD", "abc corp", None),
            (3, " 50 ", None, None, "Y"), (4, "300", "EUR", "Zed", "b")]
    return spark.createDataFrame(rows, "id long, amt string, currency string, seller string, buyer string")


def _ids(df, **flt):
    p = search_filter(F.col("amt"), F.col("currency"), F.col("seller"), F.col("buyer"),
                      **{k: F.lit(v) for k, v in flt.items()})
    return sorted(r.id for r in df.filter(p).collect())


def test_search_filters(spark):
    df = _recs(spark)
    assert _ids(df, min_amount=100.0) == [1, 4]            # 'N/A' never passes a bound
    assert _ids(df, max_amount=100.0) == [3]
    assert _ids(df, currency="USD") == [1, 2]
    assert _ids(df, exclude_currency="USD") == [3, 4]      # null currency is kept
    assert _ids(df, seller_name="ABC") == [1, 2]           # case-folded substring
    assert _ids(df, buyer_name="x") == [1]                 # null buyer never matches
    assert _ids(df) == [1, 2, 3, 4]


def test_attribute_search_like_and_order(spark):
    rows = [(1, "INV-10", "Acme", 5.0, "USD", "2024-01-01T1"), (2, "INV-1_0", "ACME", 50.0, "USD", "2024-01-02T1"),
            (3, "XINV-100", None, None, "EUR", "2024-01-03T1")]
    df = spark.createDataFrame(rows, "id long, invoice_number string, seller_name string, total_amount double, "
                                     "currency string, extracted_at string")
    assert [r.id for r in attribute_search(df, {"invoice_number": "inv-1_"}).collect()] == [3, 2, 1]
    assert [r.id for r in attribute_search(df, {"seller_name": "acme", "min_amount": 10}).collect()] == [2]
    assert [r.id for r in attribute_search(df, {"unknown": 1}).collect()] == [3, 2, 1]


RECORDS = [
    (("N1", "S", "B", 52500.0, "USD", "2024-01-15", "raw"),
     "Invoice Number: N1 | Seller: S | Buyer: B | Amount: 52500.0 USD | Date: 2024-01-15 | raw"),
    (("", None, "B", 0.0, "USD", None, ""), "Buyer: B"),
    ((None, "S", None, 1234.567, "KWD", "", None), "Seller: S | Amount: 1234.567 KWD"),
    ((None, None, None, 0.001, "", None, "x"), "x"),
    ((None, None, None, 1e7, "JPY", None, None), "Amount: 10000000.0 JPY"),
    ((None,) * 7, ""),
    ((None, None, None, None, None, None, "y" * 600 + "end"), "y" * 600 + "end"),
]


def test_document_text(spark):
    df = spark.createDataFrame([r for r, _ in RECORDS], "invoice_number string, seller_name string, buyer_name string, "
                                                        "total_amount double, currency string, invoice_date string, raw_text string")
    assert [r[0] for r in df.select(document_text()).collect()] == [t for _, t in RECORDS]
    assert df.select(document_text(prefix=500)).collect()[-1][0] == "y" * 500


def test_like_takes_a_backslash_as_it_is(spark):
    df = spark.createDataFrame([(1, "A\\B"), (2, "AB")], "id long, seller_name string")
    assert [r.id for r in df.filter(like_contains("seller_name", "a\\b")).collect()] == [1]
