from pyspark.sql import functions as F

from ledgerlens.functions.jsonparse import field, salvage
from ledgerlens.operators import extraction as ex

SAMPLE = """Invoice #: HB/77-4410
Date: March 3, 2023
Seller: Hollerbach Mills KG
Mill Lane 4, 90402 Nuremberg
Bill To: Orchard & Vine Ltd
8 Quay Road, Cork

Pos 1  oat flour, 40 sacks   1.840,50
Pos 2  freight                 159,50

Total: 2.000,00 EUR
"""


def test_whole_invoice(spark):
    df = spark.createDataFrame([(SAMPLE,)], "text string")
    r = ex.extract_with_rules(df).first()
    assert (r.invoice_number, r.invoice_date, r.seller_name, r.buyer_name, r.total_amount, r.currency) == \
        ("HB/77-4410", "2023-03-03", "Hollerbach Mills KG", "Orchard & Vine Ltd", 2000.0, "EUR")


def test_empty_label_does_not_run_on(spark):
    df = spark.createDataFrame([("Invoice No: \nTo:\nDate: 2024-01-15",)], "text string")
    r = ex.extract_with_rules(df).first()
    assert r.invoice_number is None and r.buyer_name is None and r.invoice_date == "2024-01-15"


def test_cascade(spark):
    long_a, long_b = "a" * 60, "b" * 70
    rows = [(1, long_a, long_b, "c" * 80), (2, "short", long_b, "c"), (3, "x", "y" * 10, "z" * 5),
            (4, None, None, "o" * 55)]
    df = spark.createDataFrame(rows, "id int, t1 string, t2 string, t3 string")
    got = {r.id: (r.extraction_method, r.text) for r in ex.cascade(df, ["t1", "t2", "t3"]).collect()}
    assert got[1] == ("pymupdf", long_a)
    assert got[2] == ("pdfplumber", long_b)
    assert got[3] == ("ocr", "z" * 5)      # a later candidate wins even when shorter
    assert got[4] == ("ocr", "o" * 55)     # failed candidates count as short
    off = {r.id: r.extraction_method for r in ex.cascade(df, ["t1", "t2", "t3"], use_ocr=False).collect()}
    assert off[3] == "pdfplumber"


def test_pages(spark):
    df = spark.createDataFrame([(1, " p1\f\fp3 ")], "id int, text string")
    pages = ex.text_by_page(df, "id").orderBy("page_no").collect()
    assert [(p.page_no, p.page_text) for p in pages] == [(1, " p1"), (2, ""), (3, "p3 ")]
    arr = df.select(F.split("text", "\f", -1).alias("p"))
    r = arr.select(*[ex.join_pages("p", m).alias(m) for m in ex.METHODS]).first()
    assert (r.pymupdf, r.pdfplumber, r.ocr) == ("p1p3", "p1\np3", "p1\n\np3")
    back = ex.assemble_pages(ex.text_by_page(df, "id"), "id", "ocr").first()
    assert back.text == "p1\n\np3"
    m = df.select(ex.page_map("text").alias("m")).first().m
    assert m == {1: " p1", 2: "", 3: "p3 "}


def test_short_text_gate(spark):
    df = spark.createDataFrame([("x" * 19,), ("x" * 20,), (None,)], "text string")
    got = [(r.passed, r.errors) for r in ex.short_text_gate(df).collect()]
    assert got == [(False, [ex.SHORT_TEXT_ERROR]), (True, []), (False, [ex.SHORT_TEXT_ERROR])]


def test_json_salvage(spark):
    replies = ['{"k": 1}', 'Sure! {"k": 2} Done.', "no json here", 'x {"k": 3}\n{"k": 3}',
               '{"k": 4} trailing', ' {"k": 5} ']
    df = spark.createDataFrame([(r,) for r in replies], "reply string").withColumn("s", salvage("reply"))
    got = [(r.source, r.k, r.err is not None) for r in
           df.select("s.source", field(F.col("s.value"), "k", "bigint").alias("k"),
                     F.col("s.error").alias("err")).collect()]
    assert got == [("direct", 1, False), ("span", 2, False), (None, None, True), (None, None, True),
                   ("span", 4, False), ("direct", 5, False)]


def test_prompt_lists_fields(spark):
    df = spark.createDataFrame([("some text",)], "text string")
    p = df.select(ex.build_prompt("text", ["a", "b"]).alias("p")).first().p
    assert "  a: text | null\n  b: text | null\n" in p and "some text" in p and "JSON" in p


def test_user_extractor(spark):
    import pandas as pd

    def extractor(texts):
        return pd.DataFrame({"invoice_number": texts.str.upper()})

    df = spark.createDataFrame([(1, "inv-9")], "id int, text string")
    r = ex.extract_with(df, extractor, fields=["invoice_number"]).first()
    assert r.invoice_number == "INV-9" and r.id == 1


def test_extractor_built_once_per_partition_and_bad_batch(spark):
    import pandas as pd

    def make():
        def fn(texts):
            if (texts == "boom").any():
                raise RuntimeError("bad input")
            return pd.DataFrame({"invoice_number": texts.str.upper()})
        return fn

    df = spark.createDataFrame([(1, "a"), (2, "boom")], "id int, text string").repartition(2, "id")
    rows = {r.id: r for r in ex.extract_with(df, make_extractor=make, fields=["invoice_number"]).collect()}
    assert rows[1].invoice_number == "A" and rows[1].extract_error is None
    assert rows[2].invoice_number is None and "bad input" in rows[2].extract_error


def test_amount_spellings(spark):
    lines = ["$52,500.00 USD", "1.200,00 EUR", "1234,5 EUR", "USD 7", "12.50 GBP", "1,234,567.89 USD", "n/a"]
    df = spark.createDataFrame([(f"Total Amount: {x}",) for x in lines], "text string")
    got = [r.total_amount for r in ex.extract_with_rules(df).collect()]
    assert got == [52500.0, 1200.0, 1234.5, 7.0, 12.5, 1234567.89, None]


def test_reply_becomes_a_record_with_extras(spark):
    rows = [(1, '{"invoice_number": "A", "total_amount": "$1,200.50", "currency": "EUR", "note": "x", "items": [1, {"a": null}], "n": 1.5, "gone": null}'),
            (2, 'Sure: {"seller_name": "S", "total_amount": 7} Bye'), (3, "[1]"), (4, "no"), (5, None), (6, "{}"), (7, '"text"')]
    df = spark.createDataFrame(rows, "id int, reply string")
    got = {r.id: r for r in df.withColumns(ex.reply_fields("reply")).collect()}
    assert (got[1].invoice_number, got[1].total_amount, got[1].currency, got[1].seller_name) == ("A", 1200.5, "EUR", None)
    assert got[1].extras == {"note": "x", "items": '[1,{"a":null}]', "n": "1.5", "gone": None} and got[1].reply_source == "direct"
    assert (got[2].seller_name, got[2].total_amount, got[2].extras, got[2].reply_source) == ("S", 7.0, None, "span")
    assert got[3].reply_problem == ex.NOT_AN_OBJECT and got[7].reply_problem == ex.NOT_AN_OBJECT
    assert got[4].reply_problem == "no valid JSON in reply: no" and got[5].reply_problem == ex.EMPTY_REPLY
    assert got[6].reply_problem is None and got[6].invoice_number is None and got[6].extras is None


def test_model_calls_are_bounded_and_fail_by_row(spark, tmpdir_path):
    def make_ask():
        import os
        import uuid

        def ask(prompts):
            with open(f"{tmpdir_path}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(prompts)} {sum(len(p) for p in prompts)}")
            if any("bad" in p for p in prompts):
                raise RuntimeError("refused " + "x" * 300)
            return [None if "none" in p else p.upper() for p in prompts]

        return ask

    texts = ["one", "two", None, "bad", "none", "y" * 50, "six"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, prompt string").coalesce(1)
    got = {r.i: (r.reply, r.reply_error) for r in ex.ask_model(df, make_ask=make_ask, call_rows=3, call_bytes=20).collect()}
    assert got == {0: ("ONE", None), 1: ("TWO", None), 2: (None, None), 3: (None, "RuntimeError: refused " + "x" * 300), 4: (None, None),
                   5: ("Y" * 50, None), 6: ("SIX", None)}
    import os

    calls = [tuple(map(int, open(os.path.join(tmpdir_path, n)).read().split())) for n in os.listdir(tmpdir_path)]
    assert all(n <= 3 and (size <= 20 or n == 1) for n, size in calls)


def test_process_documents_with_a_model(spark):
    from ledgerlens.plans.documents import process_documents

    def ask(prompts):
        if any("crash" in p for p in prompts):
            raise ValueError("down")
        return ['{"invoice_number": "Q", "vat": "19"}' if "good" in p else "what?" for p in prompts]

    rows = [(1, "good document of some length " * 2), (2, "good"), (3, "crash of a document that is long " * 2), (4, "other document, long enough " * 2)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r for r in process_documents(df, "id", ["t"], extractor=ex.model_extractor(ask)).collect()}
    assert got[1].success and got[1].invoice_number == "Q" and got[1].extras == {"vat": "19"} and got[1].errors == []
    assert got[2].errors == [ex.SHORT_TEXT_ERROR] and not got[2].success
    assert got[3].errors == ["ValueError: down"] and got[3].invoice_number is None and got[3].validation.missing_fields == ex.EXTRACTION_FIELDS
    assert got[4].errors == ["no valid JSON in reply: what?"] and got[4].extras is None
    plain = process_documents(df, "id", ["t"]).filter("id = 1").first()
    assert plain.success and plain.extras is None


def test_a_reply_is_salvaged_once_in_whole_document_results(spark):
    from ledgerlens.plans.documents import process_documents

    df = spark.createDataFrame([(1, "x" * 60)], "id int, t string")
    got = process_documents(df, "id", ["t", "t", "t"], extractor=ex.model_extractor(lambda prompts: ['see {"currency": "EUR", "k": 1}' for _ in prompts]))
    row = got.first()
    assert (row.currency, row.extras, row.success) == ("EUR", {"k": "1"}, True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parseJson") <= 2          # the whole reply and its span
