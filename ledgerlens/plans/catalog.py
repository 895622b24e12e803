"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (or views Spark derives from them)
in full. Outputs are scalar columns with rounded doubles so that they can
be compared value by value with the SQL statements in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import nlquery as nl
from ledgerlens.functions.amounts import normalize_currency, normalize_date, parse_amount
from ledgerlens.functions.jsonparse import field, salvage
from ledgerlens.functions.text import (
    SEARCH_TEXT_PREFIX, amount_currency_label, document_text, money_label, na_label, size_kb_label, text_prefix,
)
from ledgerlens.operators import analytics, dml, extraction, predicates, records, vectors
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans.documents import process_documents
from ledgerlens.schema import EXTRACTION_FIELDS, REPORT_COLUMNS, STORE_COLUMNS
from ledgerlens.session import scratch_path
from ledgerlens.sources import store
from ledgerlens.sources.changes import CLEAR_PHRASE, ChangeTable, delete_everything, delete_records
from ledgerlens.sources.files import file_name_from_path, scan_directory, write_text_files
from ledgerlens.sources.tables import read_table

# Parameters of the registered queries.
SEARCH = {"seller_name": "supplier#00000001", "min_amount": 50000, "currency": "USD"}
LIKE_NUMBER = {"invoice_number": "INV-0000_1"}
LIKE_SELLER = {"seller_name": "plier#00000005"}
LIKE_BUYER = {"buyer_name": "customer#0000001"}
AMOUNT_RANGE = {"min_amount": 100000, "max_amount": 200000}
CURRENCY_EQ = {"currency": "EUR"}
EXCLUDED = "USD"
SELLER_PART = "SUPPLIER#00000002"
KNN_K = 25
TOP_K = 5


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---------------------------------------------------------------- records

def q_parse_amount(spark, d):
    raw = fx.invoices_raw(spark, d, "src_id", "total_amount")
    return raw.select("src_id", F.col("total_amount").alias("raw_amount"),
                      parse_amount("total_amount").alias("amount"))


def q_valid_records(spark, d):
    raw = fx.invoices_raw(spark, d, "src_id", "invoice_number", "seller_name", "buyer_name", "total_amount")
    return records.valid_records(raw).select("src_id", "invoice_number", "seller_name",
                                             "buyer_name", "total_amount")


SEARCH_COLUMNS = ["id", "invoice_number", "seller_name", "buyer_name", "total_amount", "currency", "extracted_at"]


def _search_cols(df):
    return df.select(*SEARCH_COLUMNS)


def q_attribute_search(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), SEARCH))


def q_like_invoice_number(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), LIKE_NUMBER))


def q_like_seller(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), LIKE_SELLER))


def q_like_buyer(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), LIKE_BUYER))


def q_amount_range(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), AMOUNT_RANGE))


def q_currency_eq(spark, d):
    return _search_cols(predicates.attribute_search(fx.invoices(spark, d, *SEARCH_COLUMNS), CURRENCY_EQ))


def q_exclude_currency(spark, d):
    inv = fx.invoices(spark, d, "id", "currency")
    p = predicates.search_filter(None, F.col("currency"), None, None, exclude_currency=F.lit(EXCLUDED))
    return inv.filter(p).select("id", "currency")


def q_seller_contains(spark, d):
    inv = fx.invoices(spark, d, "id", "seller_name")
    p = predicates.search_filter(None, None, F.col("seller_name"), None, seller_name=F.lit(SELLER_PART))
    return inv.filter(p).select("id", "seller_name")


def q_load_table_newest_first(spark, d):
    return store.load_newest_first(fx.invoices(spark, d, "id", "extracted_at", "invoice_number")).select("id", "extracted_at", "invoice_number")


def q_upsert_invoices(spark, d):
    inv = fx.invoices(spark, d).withColumn("seq", F.col("id"))
    up = dml.upsert(inv.drop("raw_text"))
    return up.select("id", "invoice_number", "file_name", "total_amount", "buyer_name", "extracted_at")


def q_report_projection(spark, d):
    return records.report_projection(fx.invoices(spark, d).drop("raw_text"))


def q_store_projection(spark, d):
    raw = fx.invoices_raw(spark, d, "src_id", *[c for c in STORE_COLUMNS if c in fx.RAW_COLUMNS])
    raw = raw.withColumn("total_amount", parse_amount("total_amount"))
    return records.store_projection(raw.withColumnRenamed("src_id", "id"))


def q_report_labels(spark, d):
    inv = fx.invoices(spark, d)
    return inv.select("id",
                      amount_currency_label("total_amount", "currency").alias("amount_label"),
                      money_label("total_amount").alias("money_label"),
                      na_label("seller_name").alias("seller_label"),
                      size_kb_label(F.length("raw_text")).alias("size_label"))


def q_document_text(spark, d):
    inv = fx.invoices(spark, d)
    return inv.select("id", document_text(prefix=SEARCH_TEXT_PREFIX).alias("matched_text"))


def q_text_prefix(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", text_prefix("text").alias("prefix"))


def q_flatten_struct(spark, d):
    inv = fx.invoices(spark, d)
    nested = inv.select("id", F.struct(
        F.struct(F.col("seller_name").alias("name")).alias("seller"),
        F.struct(F.col("total_amount").alias("value"), F.col("currency")).alias("amount"),
    ).alias("inv"))
    return records.flatten(nested)


# ---------------------------------------------------------------- analytics

def q_summary_stats(spark, d):
    s = analytics.summary_stats(fx.invoices(spark, d, "total_amount", "currency", "seller_name"))
    return s.select("n_records", _r("total_value", 2).alias("total_value"),
                    _r("avg_amount", 4).alias("avg_amount"), "n_currencies", "n_sellers")


def q_distinct_counts(spark, d):
    return analytics.distinct_counts(fx.invoices(spark, d, "currency", "seller_name", "buyer_name"))


def q_currency_distribution(spark, d):
    return analytics.currency_distribution(fx.invoices(spark, d, "currency"))


def q_top_sellers(spark, d):
    return analytics.top_sellers(fx.invoices(spark, d, "seller_name"))


def q_per_currency_totals(spark, d):
    t = analytics.per_currency_totals(fx.invoices(spark, d, "currency", "total_amount"))
    return t.select("currency", "n_records", _r("total_value", 2).alias("total_value"))


def q_skipped_counts(spark, d):
    return vectors.skipped_counts(fx.invoices(spark, d, *records.KEY_FIELDS))


# ---------------------------------------------------------------- DML

def _pending_ids(spark, d):
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return o.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("id"))


def q_delete_by_id(spark, d):
    inv = fx.invoices(spark, d, "id", "invoice_number")
    return dml.delete_ids(inv, _pending_ids(spark, d)).select("id", "invoice_number")


def q_delete_selected(spark, d):
    """Delete the selected records, rebuild the vectors; report the counts."""
    inv = fx.invoices(spark, d)
    sel = inv.filter(F.col("currency") == "JPY").select("id")
    kept = dml.delete_ids(inv, sel)
    vec = vectors.build_vectors(kept)
    metric = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(name).alias("metric"), "value")
    n_del = dml.deleted_count(inv, sel).select(F.lit("deleted").alias("metric"),
                                               F.col("n_deleted").alias("value"))
    return n_del.unionByName(metric(kept, "remaining")).unionByName(metric(vec, "vectors"))


def q_append_records(spark, d):
    inv = fx.invoices(spark, d, "id", "invoice_number").withColumn("origin", F.lit("table"))
    raw = fx.invoices_raw(spark, d, "src_id", "invoice_number", "currency").select(F.col("src_id").alias("id"), "invoice_number",
                                            F.lit("raw").alias("origin"), "currency")
    return dml.append(inv, raw)


# ---------------------------------------------------------------- query text

def q_nl_exclude_currency(spark, d):
    q = fx.query_texts(spark, d)
    return q.select("qid", nl.exclude_currency("text").alias("exclude_currency"))


def q_nl_min_amount(spark, d):
    q = fx.query_texts(spark, d)
    return q.select("qid", nl.min_amount("text").alias("min_amount"))


def q_nl_max_amount(spark, d):
    q = fx.query_texts(spark, d)
    return q.select("qid", nl.max_amount("text").alias("max_amount"))


def q_nl_currency(spark, d):
    q = fx.query_texts(spark, d)
    return q.select("qid", nl.text_currency("text").alias("currency"))


def form_inputs(q: DataFrame) -> DataFrame:
    """Form values that vary with the request id (unset = 0 or empty)."""
    k = F.col("qid")
    return q.withColumns({
        "ui_min": F.when(k % 5 == 0, F.lit(1000.0)).when(k % 5 == 1, F.lit(0.0)),
        "ui_max": F.when(k % 7 == 0, F.lit(2000.0)),
        "ui_currency": F.when(k % 6 == 0, F.lit("GBP")).when(k % 6 == 1, F.lit("")),
        "ui_seller": F.when(k % 4 == 0, F.lit("Supplier#00000001")).when(k % 4 == 1, F.lit("")),
    })


def q_resolve_filters(spark, d):
    q = form_inputs(fx.query_texts(spark, d))
    r = nl.resolve_filters(q, "text", "ui_min", "ui_max", "ui_seller", "ui_currency")
    return r.select("qid", "min_amount", "max_amount", "currency", "exclude_currency", "seller_name")


# ---------------------------------------------------------------- extraction

def q_extraction_cascade(spark, d):
    c = extraction.cascade(fx.doc_candidates(spark, d), ["text_1", "text_2", "text_3"])
    return c.select("doc_id", "extraction_method", F.length("text").alias("text_length"))


def _docs(spark, d):
    return read_table(spark, d, "documents", "doc_id", "text")


def q_text_by_page(spark, d):
    return extraction.text_by_page(_docs(spark, d), "doc_id", "text", "\n")


def q_pages_to_text(spark, d):
    docs = _docs(spark, d).select("doc_id", F.split("text", "\n", -1).alias("pages"))
    out = [docs.doc_id]
    for i, m in enumerate(extraction.METHODS, start=1):
        t = extraction.join_pages("pages", m)
        out += [F.md5(t).alias(f"md5_{i}"), F.length(t).alias(f"len_{i}")]
    return docs.select(*out)


def q_page_counts(spark, d):
    docs = read_table(spark, d, "documents", "doc_id", "text", "lang", "source")
    meta = F.map_from_arrays(F.array(F.lit("lang"), F.lit("source")), F.array("lang", "source"))
    return docs.select("doc_id", F.size(F.split("text", "\n", -1)).alias("page_count"),
                       F.length("text").alias("n_chars"), meta["lang"].alias("meta_lang"))


def q_short_text_gate(spark, d):
    g = extraction.short_text_gate(_docs(spark, d))
    return g.select("doc_id", "passed", F.array_join("errors", "; ").alias("error"))


def q_build_prompts(spark, d):
    p = _docs(spark, d).select("doc_id", extraction.build_prompt("text").alias("prompt"))
    return p.select("doc_id", F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


def q_extract_fields_rules(spark, d):
    t = fx.invoice_text(spark, d)
    e = extraction.extract_with_rules(t)
    return e.select("src_id", "invoice_number", "invoice_date", "seller_name", "buyer_name",
                    "total_amount", "currency")


def q_normalize_fields(spark, d):
    raw = fx.invoices_raw(spark, d, "src_id", "invoice_date", "currency", "total_amount", "o_orderdate")
    k = F.col("src_id")
    date_raw = (F.when(k % 3 == 0, F.col("invoice_date"))
                .when(k % 3 == 1, F.date_format("o_orderdate", "MMMM d, yyyy"))
                .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")))
    cur_raw = (F.when(k % 4 == 0, F.col("currency"))
               .when(k % 4 == 1, F.lower("currency"))
               .when(k % 4 == 2, F.when(F.col("currency") == "USD", F.lit("$")).otherwise(
                   F.concat(F.col("currency"), F.lit(" "))))
               .otherwise(F.concat(F.lit(" "), F.col("currency"))))
    return raw.select("src_id", normalize_date(date_raw).alias("invoice_date"),
                      normalize_currency(cur_raw).alias("currency"),
                      parse_amount("total_amount").alias("total_amount"))


def q_json_salvage(spark, d):
    r = fx.model_replies(spark, d).withColumn("s", salvage("reply"))
    return r.select("event_id", F.col("s.source").alias("source"),
                    field(F.col("s.value"), "k", "double").alias("k"),
                    F.col("s.error").alias("error"))


def q_validate_records(spark, d):
    raw = fx.invoices_raw(spark, d)
    v = records.validate_records(raw)
    return v.select("src_id", F.col("validation.is_valid").alias("is_valid"),
                    F.size("validation.missing_fields").alias("n_missing"),
                    F.array_join("validation.missing_fields", ",").alias("missing"),
                    F.size("validation.warnings").alias("n_warnings"))


def q_assemble_record(spark, d):
    t = fx.invoice_text(spark, d)
    e = extraction.extract_with_rules(t).withColumn("file_name", F.lit(None).cast("string"))
    facts = {"file_name": F.concat(F.lit("doc_"), F.col("src_id").cast("string"), F.lit(".pdf")),
             "raw_text": F.col("text"), "extraction_method": F.lit("pymupdf"),
             "page_count": F.lit(1)}
    a = records.assemble_record(e, facts)
    return a.select("src_id", "invoice_number", "file_name", "extraction_method", "page_count",
                    F.length("raw_text").alias("text_length"))


def _processed(spark, d):
    return process_documents(fx.doc_candidates(spark, d), "doc_id", ["text_1", "text_2", "text_3"])


def q_process_documents(spark, d):
    p = _processed(spark, d)
    return p.select("doc_id", "success", F.array_join("errors", "; ").alias("error"), "text_length",
                    "extraction_method", "page_count",
                    F.col("validation.is_valid").alias("is_valid"),
                    F.size("validation.missing_fields").alias("n_missing"))


def q_batch_tally(spark, d):
    return analytics.batch_tally(_processed(spark, d))


# ---------------------------------------------------------------- vectors

def _embeddings(spark, d):
    return read_table(spark, d, "embeddings", "vec_id", "embedding", "label")


def _label_queries(spark, d):
    """One query per label: the label's mean vector, with filters by label."""
    c = vectors.centroids(_embeddings(spark, d), "label")
    lab = F.col("label")
    return c.select(lab.cast("long").alias("qid"), "embedding",
                    F.when(lab % 3 == 0, F.lit(100000.0)).alias("min_amount"),
                    F.when(lab % 4 == 1, F.lit("EUR")).alias("currency"),
                    F.when(lab % 5 == 2, F.lit("USD")).alias("exclude_currency"))


def q_embed_documents(spark, d):
    e = vectors.embed(_docs(spark, d), "text")
    s = vectors.sparse_weights(e, "doc_id")
    return s.select("doc_id", F.col("bucket").cast("long").alias("bucket"),
                    F.round(F.col("weight").cast("double"), 4).alias("weight"))


def q_l2_distance(spark, d):
    e = _embeddings(spark, d)
    c = vectors.centroids(e, "label").withColumnRenamed("embedding", "centroid")
    j = e.join(c, "label")
    return j.select("vec_id", "label", _r(vectors.l2_distance("embedding", "centroid")).alias("distance"))


def q_knn_candidates(spark, d):
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    cand = vectors.knn_candidates(idx, _label_queries(spark, d), KNN_K)
    return cand.select("qid", "id", "rank", _r("distance").alias("distance"))


def q_semantic_search(spark, d):
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    hits = vectors.semantic_search(idx, fx.invoices(spark, d), _label_queries(spark, d), top_k=TOP_K)
    return hits.select("qid", "rank", "position", "id", _r("distance").alias("distance"),
                       _r("score").alias("score"), "invoice_number", "total_amount", "currency")


def q_semantic_search_prefilter(spark, d):
    """Filter first (EUR records only), then the k nearest: no shortfall."""
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    q = _label_queries(spark, d).select("qid", "embedding")
    eur = fx.invoices(spark, d).filter(F.col("currency") == "EUR")
    hits = vectors.semantic_search(idx, eur, q, top_k=TOP_K, prefilter=True)
    return hits.select("qid", "rank", "position", "id", _r("distance").alias("distance"))


def q_semantic_search_prefilter_per_query(spark, d):
    """Per-query filters applied before ranking, all queries in one scan."""
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    hits = vectors.semantic_search(idx, fx.invoices(spark, d), _label_queries(spark, d), top_k=TOP_K,
                                   prefilter=True)
    return hits.select("qid", "rank", "position", "id", _r("distance").alias("distance"),
                       "invoice_number", "total_amount", "currency")


def seller_requests(spark, d):
    """Plain-English requests about the ten busiest sellers (a top-k report).

    ``(qid, text, ui_seller)``; the request text carries amount and currency
    wording, the form names the seller for every other request.
    """
    top = analytics.top_sellers(fx.invoices(spark, d, "seller_name"))
    qid = F.regexp_extract("seller_name", r"(\d+)$", 1).cast("long")
    m = qid % 3
    text = F.concat(F.lit("invoices from "), F.col("seller_name"),
                    F.when(m == 0, F.lit(" above 100000"))
                     .when(m == 1, F.lit(" not in usd"))
                     .otherwise(F.lit(" in eur under 300000")))
    return top.select(qid.alias("qid"), text.alias("text"),
                      F.when(qid % 2 == 0, F.col("seller_name")).alias("ui_seller"))


def q_semantic_search_text(spark, d):
    """Request text -> filters -> embedded with the index's model -> search."""
    req = nl.resolve_filters(seller_requests(spark, d), "text", ui_seller="ui_seller")
    req = vectors.embed(req, "text")
    index = vectors.build_vectors(fx.invoices(spark, d), payload=True)   # index holds its payload
    hits = vectors.semantic_search(index, None, req, top_k=TOP_K)
    return hits.select("qid", "rank", "position", "id", _r("distance").alias("distance"),
                       _r("score").alias("score"))


def q_rebuild_vectors(spark, d):
    v = vectors.build_vectors(fx.invoices(spark, d))
    return v.select("id", "matched_text",
                    F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_buckets"))


def q_add_documents(spark, d):
    inv = fx.invoices(spark, d)
    first = vectors.build_vectors(inv).withColumn("seq", F.lit(0))
    again = vectors.build_vectors(inv.filter(F.col("currency") == "EUR")).withColumn("seq", F.lit(1))
    out = vectors.add_documents(first, again)
    return out.select("id", "seq", F.length("matched_text").alias("text_length"))


def q_vector_stats(spark, d):
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    s = vectors.vector_stats(e)
    return s.select("n_vectors", F.col("dimension").cast("long").alias("dimension"), "model_name")


def q_vector_table_roundtrip(spark, d):
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding", "label")
    path = scratch_path(spark, "vectors")
    e.write.parquet(path)
    back = spark.read.parquet(path)
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return back.select("id", "label", F.size("embedding").cast("long").alias("dims"),
                       _r(sq).alias("sq_norm"))


# ---------------------------------------------------------------- sinks and files

def q_write_json_roundtrip(spark, d):
    inv = records.report_projection(fx.invoices(spark, d))
    path = scratch_path(spark, "json")
    store.write_json(inv, path, append=True)
    return store.read_json(spark, path, inv.schema)


def q_write_csv_roundtrip(spark, d):
    inv = fx.invoices(spark, d).select("id", "invoice_number", "seller_name", "buyer_name",
                                       "total_amount", "currency",
                                       F.struct(F.col("file_name").alias("name"),
                                                F.col("page_count").alias("pages")).alias("file"))
    path = scratch_path(spark, "csv")
    store.write_csv(inv, path)
    schema = store.csv_safe(inv).schema
    return store.read_csv(spark, path, schema)


def q_file_name_from_path(spark, d):
    p = read_table(spark, d, "pages", "page_id", "url")
    return p.select("page_id", file_name_from_path("url").alias("file_name"))


def q_ingest_batch(spark, d):
    """Batch ingest of the document table into a versioned record table."""
    p = _processed(spark, d).filter(F.col("success"))
    rec = p.select(F.col("doc_id").alias("id"), "invoice_number", "invoice_date", "seller_name",
                   "buyer_name", "total_amount", "currency",
                   F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
                   F.col("text").alias("raw_text"), "extraction_method",
                   F.col("doc_id").alias("seq"))
    root = scratch_path(spark, "ingest")
    store.save(rec, root, formats=["db"], upsert_fn=dml.upsert_into)
    t = store.read_table_version(spark, f"{root}/invoices_table")
    return t.select("id", "file_name", "extraction_method", F.length("raw_text").alias("text_length"))


def q_incremental_ingest(spark, d):
    from ledgerlens.streaming.ingest import incremental_upsert_demo
    return incremental_upsert_demo(spark, d)


# ---------------------------------------------------------------- many requests

KNN_BATCH_K = 5


def q_knn_batch(spark, d):
    """Every vector asks for its nearest ones, as a block join whatever their number."""
    e = _embeddings(spark, d)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    cand = vectors.knn_candidates(e.select(F.col("vec_id").alias("id"), "embedding"), q, KNN_BATCH_K, max_broadcast=0)
    return cand.select("qid", "id", "rank", _r("distance").alias("distance"))


def _vector_requests(spark, d):
    """Every vector asks, with filters that vary with its id."""
    k = F.col("vec_id")
    return _embeddings(spark, d).select(k.alias("qid"), "embedding",
                                        F.when(k % 3 == 0, F.lit(100000.0)).alias("min_amount"),
                                        F.when(k % 4 == 1, F.lit("EUR")).alias("currency"),
                                        F.when(k % 5 == 2, F.lit("USD")).alias("exclude_currency"))


def q_semantic_search_batch(spark, d):
    """Every vector asks under filters of its own; all rows that pass them compete."""
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding")
    inv = fx.invoices(spark, d, "id", "invoice_number", "seller_name", "buyer_name", "total_amount", "currency")
    hits = vectors.semantic_search(idx, inv, _vector_requests(spark, d), top_k=TOP_K, prefilter=True, max_broadcast=0)
    return hits.select("qid", "rank", "id", _r("distance").alias("distance"), "invoice_number", "currency")


def q_empty_index(spark, d):
    """A search in an empty index has no hits."""
    idx = _embeddings(spark, d).select(F.col("vec_id").alias("id"), "embedding").filter(F.lit(False))
    inv = fx.invoices(spark, d, "id", "invoice_number", "seller_name", "buyer_name", "total_amount", "currency")
    return vectors.semantic_search(idx, inv, _label_queries(spark, d), top_k=TOP_K).select("qid", "id", "rank")


def digest(vec):
    """Sum of a vector's entries, each times its place: tells vectors apart in a table of scalars."""
    return F.aggregate(F.transform(vec, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)


def _short_text(inv):
    return inv.withColumns({c: F.lit(None).cast("string") for c in ("invoice_date", "raw_text")})


def q_replace_vectors(spark, d):
    """Vectors made without date and raw text are replaced for EUR records by those of the whole search text."""
    inv = fx.invoices(spark, d)
    old = vectors.build_vectors(_short_text(inv)).withColumn("seq", F.lit(0))
    new = vectors.build_vectors(inv.filter(F.col("currency") == "EUR")).withColumn("seq", F.lit(1))
    out = vectors.add_documents(old, new)
    return out.select("id", "seq", F.round(digest("embedding"), 3).alias("digest"))


# ---------------------------------------------------------------- replies and extractors

def q_reply_to_record(spark, d):
    """A model's reply as a typed record with its extras, its validation and its problem."""
    r = extraction.with_reply_fields(fx.record_replies(spark, d), "reply")
    v = records.validate_records(r)
    return v.select("event_id", *EXTRACTION_FIELDS, F.col("extras")["k"].alias("extra_k"),
                    F.coalesce(F.size("extras"), F.lit(0)).alias("n_extras"), F.col("reply_source").alias("source"),
                    F.col("validation.is_valid").alias("is_valid"), F.array_join("validation.missing_fields", ",").alias("missing"),
                    F.size("validation.warnings").alias("n_warnings"), F.col("reply_problem").alias("problem"))


def _result_columns(p, key):
    return p.select(key, "success", F.array_join("errors", "; ").alias("error"), "text_length", "extraction_method", *EXTRACTION_FIELDS,
                    F.col("extras")["account"].alias("account"), F.col("validation.is_valid").alias("is_valid"))


def q_process_invoices(spark, d):
    """Whole document results with the rule extractor, over documents that are invoices."""
    p = process_documents(fx.invoice_candidates(spark, d), "src_id", ["text_1", "text_2", "text_3"])
    return _result_columns(p, "src_id")


def label_reader(prompts):
    """A stand-in for a model: replies with the labelled lines of the document in the prompt. It wraps replies about
    customers whose account number ends in 7 in prose, refuses those that end in 8, and fails for those that end in 9."""
    import json

    out = []
    for p in prompts:
        lines = dict(x.split(": ", 1) for x in p.split("<document>")[1].split("\n") if ": " in x)
        account = next(x.split(" ")[1] for x in p.split("\n") if x.startswith("Account "))
        if account.endswith("9"):
            raise RuntimeError(f"no answer for account {account}")
        money = lines.get("Total Amount", "").split(" ")
        reply = json.dumps({"invoice_number": lines.get("Invoice No") or None, "invoice_date": lines.get("Date"), "seller_name": lines.get("From") or None,
                            "buyer_name": lines.get("To") or None, "total_amount": money[0], "currency": money[1] or None, "account": account})
        out.append("I can't read this" if account.endswith("8") else f"Sure: {reply} Bye." if account.endswith("7") else reply)
    return out


def q_process_with_model(spark, d):
    """Whole document results with a model in place of the rules: its failures are row errors, its other keys extras."""
    p = process_documents(fx.invoice_candidates(spark, d), "src_id", ["text_1", "text_2", "text_3"],
                          extractor=extraction.model_extractor(label_reader))
    return _result_columns(p, "src_id")


def q_ingest_invoices(spark, d):
    """Batch ingest of documents that are invoices; records of equal number and file merge."""
    p = process_documents(fx.invoice_candidates(spark, d), "src_id", ["text_1", "text_2", "text_3"]).filter("success")
    k = F.col("src_id")
    rec = p.select(k.alias("id"), *EXTRACTION_FIELDS, F.concat(F.lit("doc_"), (k % 12000).cast("string"), F.lit(".pdf")).alias("file_name"),
                   "extraction_method", k.alias("seq"))
    root = scratch_path(spark, "ingest-invoices")
    store.save(rec, root, formats=["db"], bucketed_key=dml.UPSERT_KEY, n_buckets=16)
    return store.read_bucketed(spark, f"{root}/invoices_buckets").drop("seq")


# ---------------------------------------------------------------- written changes

STORED = ["id", "invoice_number", "file_name", "seller_name", "buyer_name", "total_amount", "currency", "seq"]


def _stored_invoices(spark, d):
    return fx.invoices(spark, d, *STORED[:-1]).withColumn("seq", F.col("id"))


def _change_tables(spark, d):
    """A record table written in three batches, the second one twice, and its vectors."""
    inv = _stored_invoices(spark, d)
    table = ChangeTable.create(spark, scratch_path(spark, "records"), inv.schema, dml.UPSERT_KEY, buckets=16)
    part = F.col("id") % 3
    for i in (0, 1, 1, 2):
        table.put(inv.filter(part == i), f"part-{i}")
    vec = vectors.build_vectors(_short_text(table.read()))
    vecs = ChangeTable.create(spark, scratch_path(spark, "vectors"), vec.schema, ["id"], buckets=16)
    vecs.put(vec, "first")
    return table, vecs


def q_change_table(spark, d):
    """Three batches and a compaction between them read as one upsert of all their rows."""
    inv = _stored_invoices(spark, d)
    table = ChangeTable.create(spark, scratch_path(spark, "changes"), inv.schema, dml.UPSERT_KEY, buckets=16)
    part = F.col("id") % 3
    table.put(inv.filter(part == 2), "c")
    table.put(inv.filter(part == 0), "a")
    table.compact()
    table.put(inv.filter(part == 1), "b")
    table.put(inv.filter(part == 0), "a")            # a replay
    return table.read().select("id", "invoice_number", "file_name", "total_amount", "buyer_name")


def q_delete_records(spark, d):
    """JPY records are deleted from the record and the vector table; what is left of both, the vectors by digest."""
    table, vecs = _change_tables(spark, d)
    delete_records(table, vecs, table.read().filter(F.col("currency") == "JPY").select("id"), "no-jpy")
    table.compact()
    left = table.read().select("id", "invoice_number", "currency")
    return left.join(vecs.read().select("id", F.round(digest("embedding"), 3).alias("digest")), "id", "left")


def q_delete_all(spark, d):
    """Everything is deleted, EUR records come back: how many there were, and what is there after."""
    table, vecs = _change_tables(spark, d)
    n = delete_everything(table, vecs, confirm=CLEAR_PHRASE, batch="all")
    table.put(_stored_invoices(spark, d).filter(F.col("currency") == "EUR"), "again")
    return table.read().select("id", "invoice_number", "total_amount", F.lit(n).cast("long").alias("n_deleted"),
                               F.lit(vecs.read().count()).cast("long").alias("n_vectors"))


# ---------------------------------------------------------------- files

def q_scan_directory(spark, d):
    """Files written from the pages, scanned as bytes."""
    path = scratch_path(spark, "pages")
    pages = read_table(spark, d, "pages", "page_id", "html")
    write_text_files(pages.select(F.col("page_id").alias("page"), F.coalesce("html", F.lit("")).alias("value")), "page", path)
    f = scan_directory(spark, path, pattern="*.txt", recursive=True)
    return f.select(F.regexp_extract("path", r"/page=(\d+)/", 1).cast("long").alias("page_id"), "length", F.md5("content").alias("content_md5"))


def q_load_json(spark, d):
    """Records of three forms of JSON files in one folder: lines, one array, one object over several lines."""
    inv = fx.invoices(spark, d, "id", "invoice_number", "total_amount", "currency")
    path = scratch_path(spark, "any-json")
    inv.filter(F.col("id") % 2 == 0).write.json(f"{path}/lines")
    # an array per partition, its records in lines between the brackets
    rows = inv.filter((F.col("id") % 2 == 1) & (F.col("id") > 1)).select(F.to_json(F.struct("*")).alias("value"))
    rows.mapInArrow(_as_array, "value string").write.text(f"{path}/arrays")
    one = inv.filter(F.col("id") == 1).select(F.regexp_replace(F.to_json(F.struct("*")), ",", ",\n").alias("value"))
    one.coalesce(1).write.text(f"{path}/object")
    return store.read_json_files(spark, path, inv.schema, recursive=True)


def _as_array(batches):
    import pyarrow as pa

    seen = False
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            v = b.column(0).slice(at, 1000).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("[" if not (seen or i) else ",") + x for i, x in enumerate(v)])], ["value"])
            seen = seen or bool(v)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def q_ingest_files(spark, d):
    """Document files streamed in two micro-batches into records, vectors and the ledger, and the whole folder streamed
    again without its checkpoint: records with their vectors, and the number of files in the ledger."""
    from ledgerlens.streaming.ingest import start_file_ingest

    landing, table, vecs = (scratch_path(spark, n) for n in ("inbox", "records", "vectors"))
    docs = fx.supplier_documents(spark, d)
    write_text_files(docs.select(F.col("s_suppkey").alias("doc"), F.col("text").alias("value")), "doc", landing)
    for run in ("first", "again"):
        start_file_ingest(spark, landing, table, vecs, scratch_path(spark, "ckpt"), [_utf8], pattern="*.txt", recursive=True,
                          files_per_batch=max(1, docs.count() // 2 + 1), n_buckets=8, stream=run).awaitTermination()
    rec = ChangeTable.open(spark, table).read().drop("seq", "extracted_at", "extras")
    vec = ChangeTable.open(spark, vecs).read().select("id", F.length("matched_text").alias("vector_text_length"))
    n = ChangeTable.open(spark, f"{table}_files").read().count()
    return rec.join(vec, "id", "left").select("invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency",
                                              F.length("raw_text").alias("text_length"), "vector_text_length", F.lit(n).cast("long").alias("n_files"))


def _utf8(content):
    return content.decode("utf-8")


def q_save_fan_out(spark, d):
    """One batch to all sinks: rows reported and rows read back, per sink."""
    inv = fx.invoices(spark, d, "id", "invoice_number", "file_name", "total_amount").withColumn("seq", F.col("id"))
    root = scratch_path(spark, "fan-out")
    out = store.save(inv, root, bucketed_key=dml.UPSERT_KEY, n_buckets=16)
    back = {"json": store.read_json(spark, out["json"]["path"], inv.schema), "csv": store.read_csv(spark, out["csv"]["path"], inv.schema),
            "db": store.read_bucketed(spark, out["db"]["path"])}
    parts = [df.agg(F.count(F.lit(1)).alias("n_read")).select(F.lit(k).alias("sink"), F.lit(out[k]["rows"]).cast("long").alias("n_saved"), "n_read")
             for k, df in back.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def q_export_csv(spark, d):
    """The report table as one CSV file, read back."""
    inv = records.report_projection(fx.invoices(spark, d, "id", *[c for c in REPORT_COLUMNS]))
    path = store.write_csv(inv, scratch_path(spark, "export"), append=False, single_file=True)
    return store.read_csv(spark, path, inv.schema).withColumn("n_files", F.lit(len([n for n in store.list_dir(spark, path) if n.endswith(".csv")])))


def q_missing_store(spark, d):
    """A store that is not there is an empty table: nothing is added to the records."""
    inv = fx.invoices(spark, d, "id", "invoice_number", "total_amount")
    none = scratch_path(spark, "none")
    empty = [store.read_json(spark, none, inv.schema), store.read_csv(spark, none, inv.schema), store.read_table_version(spark, none, inv.schema),
             store.read_json_files(spark, none, inv.schema)]
    for e in empty:
        inv = dml.append(inv, e)
    return inv


def q_stamp_ingestion(spark, d):
    """Rows without an ingestion time get one, the same for the whole batch; others keep theirs."""
    k = F.col("id")
    inv = fx.invoices(spark, d, "id", "extracted_at").withColumn("extracted_at", F.when(k % 2 == 0, F.col("extracted_at")))
    out = store.stamp_ingestion(inv)
    return out.agg(F.count_if(k % 2 == 0).alias("n_kept"), F.count_if((k % 2 == 1) & F.col("extracted_at").isNotNull()).alias("n_stamped"),
                   F.count_distinct(F.when(k % 2 == 1, F.col("extracted_at"))).alias("n_stamps"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
