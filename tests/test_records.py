from pyspark.sql import functions as F

from ledgerlens.operators.records import flatten, is_valid_record, store_projection, validation


def py_meaningful(v):
    return v is not None and str(v).strip() != "" and str(v) not in ("None", "0", "0.0")


def test_validity_rule_text(spark):
    rows = [("INV-1", "A", None, None), ("INV-1", None, None, "0"), (" ", "None", "B", "0.0"),
            ("0", "0.0", "x", " 0 "), (None, None, None, None), ("", "A", "", "0.00")]
    df = spark.createDataFrame(rows, "invoice_number string, seller_name string, buyer_name string, "
                                     "total_amount string")
    got = [r[0] for r in df.select(is_valid_record(df)).collect()]
    want = [sum(py_meaningful(v) for v in r) >= 2 for r in rows]
    assert got == want


def test_validity_rule_numeric_amount(spark):
    df = spark.createDataFrame([("INV-1", 0.0), ("INV-1", 5.0), ("INV-1", None)],
                               "invoice_number string, total_amount double")
    assert [r[0] for r in df.select(is_valid_record(df)).collect()] == [False, True, False]


def test_validation_missing_and_warning(spark):
    rows = [("INV-1", "2024-01-15", "A", "B", "$52,500", "USD"),
            ("INV-1", None, "A", "B", "52,500.00", "USD"),
            ("INV-1", "2024-01-15", "A", "B", None, None)]
    schema = ", ".join(f"{c} string" for c in
                       ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency"])
    df = spark.createDataFrame(rows, schema)
    got = df.select(validation(df).alias("v")).select("v.*").collect()
    # '$52,500' warns (only ',' is removed) yet is a valid record
    assert (got[0].is_valid, got[0].missing_fields, got[0].warnings) == \
        (True, [], ["total_amount is not numeric"])
    assert (got[1].is_valid, got[1].missing_fields, got[1].warnings) == (False, ["invoice_date"], [])
    assert got[2].missing_fields == ["total_amount", "currency"] and len(got[2].warnings) == 1


def test_flatten_and_store_projection(spark):
    df = spark.createDataFrame([(1, ("x", (2.0, "USD")), [1, 2])],
                               "id int, inv struct<seller:string, amount:struct<value:double, cur:string>>, "
                               "tags array<int>")
    flat = flatten(df)
    assert flat.columns == ["id", "inv_seller", "inv_amount_value", "inv_amount_cur", "tags"]
    assert flat.first()["tags"] == [1, 2]
    sp = store_projection(spark.createDataFrame([(1, "INV-1")], "id long, invoice_number string"))
    r = sp.first()
    assert r["raw_text"] == "" and r["extraction_method"] == "" and r["total_amount"] is None
