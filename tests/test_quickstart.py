"""The README quick start, run as a test."""
import os


def test_quickstart(spark, tmpdir_path):
    from pyspark.sql import functions as F

    from ledgerlens.functions.nlquery import resolve_filters
    from ledgerlens.operators import analytics, dml, extraction, vectors
    from ledgerlens.sources import store

    # 1. documents (here: already-extracted text) -> fields -> records
    docs = spark.createDataFrame([
        (1, "INVOICE\nInvoice No: INV-1\nDate: 2024-01-15\nFrom: ABC Exports\nTo: XYZ Imports\n"
            "Total Amount: $52,500.00 USD"),
        (2, "INVOICE\nInvoice No: INV-2\nDate: March 3, 2024\nFrom: Delta GmbH\nTo: XYZ Imports\n"
            "Total Amount: 1.200,00 EUR"),
    ], "id long, text string")
    recs = (extraction.extract_with_rules(docs)
            .withColumn("file_name", F.concat(F.lit("doc_"), F.col("id").cast("string"), F.lit(".pdf")))
            .withColumn("seq", F.col("id")))
    recs = store.stamp_ingestion(recs).withColumnRenamed("text", "raw_text")

    # 2. store: keyed upsert into a bucketed table (rewrites touched buckets only)
    root = os.path.join(tmpdir_path, "qs")
    store.save(recs, root, formats=["db"], upsert_fn=dml.upsert_into, bucketed_key=dml.UPSERT_KEY)
    table = store.read_bucketed(spark, f"{root}/invoices_buckets")

    # 3. index with payload, then search with a plain-English request
    index = vectors.build_vectors(table, payload=True)
    req = spark.createDataFrame([(1, "invoices from ABC above 1000 usd")], "qid long, text string")
    req = vectors.embed(resolve_filters(req), "text")
    hits = vectors.semantic_search(index, None, req, top_k=5).collect()
    assert [h.invoice_number for h in hits] == ["INV-1"]

    # 4. summaries
    s = analytics.summary_stats(table).first()
    assert s.n_records == 2 and s.n_currencies == 2


# Values that count as present, and values that do not.
PRESENT, ABSENT = ["x", "0.00", " 0"], [None, "", " ", "0", "0.0", "None"]


def test_two_present_key_fields_make_a_record_valid(spark):
    from ledgerlens.operators.records import is_valid_record

    rows = [(p, q, a, b) for p in PRESENT for q in PRESENT for a in ABSENT for b in ABSENT]
    rows += [(p, a, b, None) for p in PRESENT for a in ABSENT for b in ABSENT]
    df = spark.createDataFrame(rows, "buyer_name string, total_amount string, invoice_number string, seller_name string")
    assert [r[0] for r in df.select(is_valid_record(df)).collect()] == [i < 324 for i in range(len(rows))]
