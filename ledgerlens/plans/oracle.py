"""DuckDB statements that state, in plain SQL, what each registered query
must return. The driver runs them on the same parquet tables (views named
after the tables) and compares values with the Spark results.
"""

from __future__ import annotations

# What the queries are expected to do, written out here: nothing is taken from the code under test.
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CNY", "AUD", "CAD", "CHF", "INR"]
FIELDS = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency"]
METHODS = ["pymupdf", "pdfplumber", "ocr"]
FLOAT_PATTERN = '^[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|(?i:inf|infinity|nan))$'
MIN_TEXT_CHARS = 50
MIN_DOCUMENT_CHARS = 20
SHORT_TEXT_ERROR = 'document text is shorter than the minimum'
PROMPT_HEAD = (
    'Reply with a JSON object of this shape, filled from the document.\n'
    '{\n'
    '  invoice_number: text | null\n'
    '  invoice_date: date, YYYY-MM-DD | null\n'
    '  seller_name: text | null\n'
    '  buyer_name: text | null\n'
    '  total_amount: number | null\n'
    '  currency: ISO 4217 code | null\n'
    '}\n'
    '<document>\n'
)
PROMPT_TAIL = '\n</document>\nReply:'
LABELS = {
    'invoice_number': '(?im)^[ \\t]*invoice[ \\t]*(?:no\\.|no\\b|number\\b|#)[ \\t]*:?[ \\t]*(.*)$',
    'invoice_date': '(?im)^[ \\t]*(?:invoice[ \\t]+)?date[ \\t]*:[ \\t]*(.*)$',
    'seller_name': '(?im)^[ \\t]*(?:from|seller)[ \\t]*:[ \\t]*(.*)$',
    'buyer_name': '(?im)^[ \\t]*(?:to|buyer|bill to)[ \\t]*:[ \\t]*(.*)$',
    'amount_line': '(?im)^[ \\t]*total(?:[ \\t]+amount)?[ \\t]*:[ \\t]*(.*)$',
}
AMOUNT_NUMBER = '(-?[0-9](?:[0-9.,]*[0-9])?)'
EUROPEAN_NUMBER = '^-?[0-9]{1,3}(\\.[0-9]{3})*,[0-9]{1,2}$|^-?[0-9]+,[0-9]{1,2}$'
SEARCH_SELLER, SEARCH_MIN, SEARCH_CURRENCY = 'supplier#00000001', 50000.0, 'USD'
LIKE_NUMBER, LIKE_SELLER, LIKE_BUYER = 'INV-0000_1', 'plier#00000005', 'customer#0000001'
AMOUNT_LOW, AMOUNT_HIGH = 100000.0, 200000.0
ONLY_CURRENCY, EXCLUDED = 'EUR', 'USD'
SELLER_PART = 'SUPPLIER#00000002'
KNN_K = 25
TOP_K = 5

CUR_LIST = "[" + ", ".join(f"'{c}'" for c in CURRENCIES) + "]"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def py_float(s: str) -> str:
    v = f"TRY_CAST({s} AS DOUBLE)"
    return (f"(CASE WHEN regexp_matches({s}, {sql_str(FLOAT_PATTERN)}) AND NOT isnan({v}) "
            f"THEN {v} END)")


def parse_amount(e: str) -> str:
    return py_float(strip(f"replace(replace(CAST({e} AS VARCHAR), ',', ''), '$', '')"))


def thousands(a: str) -> str:
    return (f"(CASE WHEN length({a}) > 6 THEN substr({a}, 1, length({a}) - 6) || ',' || "
            f"substr({a}, length({a}) - 5) ELSE {a} END)")


AMT = "CAST(CAST(o.o_totalprice AS DECIMAL(15,2)) AS VARCHAR)"

INVOICES_RAW = f"""invoices_raw AS (
  SELECT o.o_orderkey AS src_id,
    CASE WHEN o.o_orderkey % 13 <> 0 THEN 'INV-' || lpad(CAST(o.o_orderkey % 12000 AS VARCHAR), 8, '0') END AS invoice_number,
    strftime(o.o_orderdate, '%Y-%m-%d') AS invoice_date,
    s.s_name AS seller_name,
    CASE WHEN o.o_orderkey % 17 = 0 THEN '' ELSE c.c_name END AS buyer_name,
    CASE o.o_orderkey % 6 WHEN 1 THEN 'N/A' WHEN 2 THEN {AMT}
      WHEN 3 THEN '$' || {thousands(AMT)} WHEN 4 THEN ' ' || {AMT} || ' ' WHEN 5 THEN '0' END AS total_amount,
    CASE WHEN o.o_orderkey % 11 <> 0 THEN ({CUR_LIST})[c.c_nationkey % 9 + 1] END AS currency,
    'doc_' || CAST(o.o_orderkey % 12000 AS VARCHAR) || '.pdf' AS file_name,
    strftime(o.o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o.o_orderkey % 86400 AS VARCHAR), 6, '0') AS extracted_at,
    o.o_custkey, o.o_totalprice, o.o_orderdate,
    {AMT} AS amt
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS first_suppkey FROM lineitem GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey
  LEFT JOIN supplier s ON l.first_suppkey = s.s_suppkey
)"""

TEXT = ("concat_ws(chr(10), 'INVOICE', 'Invoice No: ' || coalesce(invoice_number, ''), "
        "'Date: ' || invoice_date, 'From: ' || coalesce(seller_name, ''), '', "
        "'To: ' || coalesce(buyer_name, ''), 'Account ' || CAST(o_custkey AS VARCHAR), '', "
        f"'Total Amount: $' || {thousands('amt')} || ' ' || coalesce(currency, ''))")

INVOICES = f"""invoices AS (
  SELECT src_id AS id, invoice_number, invoice_date, seller_name, buyer_name,
    {parse_amount('total_amount')} AS total_amount, currency, file_name, extracted_at,
    {TEXT} AS raw_text, 'pymupdf' AS extraction_method, 1 AS page_count,
    total_amount AS total_amount_raw
  FROM invoices_raw
)"""

INVOICE_TEXT = f"""invoice_text AS (SELECT src_id, {TEXT} AS text FROM invoices_raw)"""

DOC_CANDIDATES = """doc_candidates AS (
  SELECT doc_id,
    CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 10) ELSE text END AS text_1,
    CASE WHEN doc_id % 8 = 0 THEN substr(text, 1, 40) ELSE text END AS text_2,
    text AS text_3
  FROM documents
)"""

CASCADE = f"""cascaded AS (
  SELECT doc_id,
    CASE WHEN coalesce(length(text_1), 0) >= {MIN_TEXT_CHARS} THEN text_1
         WHEN coalesce(length(text_2), 0) >= {MIN_TEXT_CHARS} THEN text_2 ELSE text_3 END AS text,
    CASE WHEN coalesce(length(text_1), 0) >= {MIN_TEXT_CHARS} THEN 'pymupdf'
         WHEN coalesce(length(text_2), 0) >= {MIN_TEXT_CHARS} THEN 'pdfplumber' ELSE 'ocr' END
      AS extraction_method
  FROM doc_candidates
)"""

MODEL_REPLIES = """model_replies AS (
  SELECT event_id,
    CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'Sure! ' || props || ' Done.'
      WHEN 2 THEN 'no json ' || event_type ELSE 'x ' || props || chr(10) || props END AS reply
  FROM events
)"""


def _cur_by_custkey() -> str:
    return f"({CUR_LIST})[o_custkey % 9 + 1]"


QUERY_TEXTS = f"""query_texts AS (
  SELECT o_orderkey AS qid,
    CASE o_orderkey % 8
      WHEN 0 THEN 'show invoices above ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' ' || {_cur_by_custkey()}
      WHEN 1 THEN 'not in ' || lower({_cur_by_custkey()}) || ' under ' || CAST(o_custkey % 1000 AS VARCHAR) || '.5'
      WHEN 2 THEN 'European invoices over $' || CAST(o_custkey % 1000 AS VARCHAR)
      WHEN 3 THEN 'moreover ' || CAST(o_custkey % 1000 AS VARCHAR)
      WHEN 4 THEN 'except ' || {_cur_by_custkey()} || ' more than ' || CAST(o_custkey % 1000 AS VARCHAR)
             || ' and less than ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
      WHEN 5 THEN 'status ' || o_orderstatus || ' from january 2024'
      WHEN 6 THEN '>= ' || CAST(o_custkey % 1000 AS VARCHAR) || ' ' || {_cur_by_custkey()} || ' or <= '
             || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
      ELSE 'other than ' || lower({_cur_by_custkey()}) || ', thunder ' || CAST(o_custkey % 1000 AS VARCHAR)
    END AS text
  FROM orders
)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body


INV = (INVOICES_RAW, INVOICES)


def _search(where: str) -> str:
    return with_views(f"""SELECT id, invoice_number, seller_name, buyer_name, total_amount, currency,
  extracted_at FROM invoices WHERE {where}""", *INV)


def _like(col: str, v: str) -> str:
    return f"coalesce({col} ILIKE {sql_str('%' + v + '%')}, false)"


def first_code(text: str) -> str:
    whens = " ".join(f"WHEN instr(lower({text}), '{c.lower()}') > 0 THEN '{c}'" for c in CURRENCIES)
    return f"(CASE {whens} END)"


def exclusion(text: str) -> str:
    words = " OR ".join(f"instr(lower({text}), '{w}') > 0" for w in ["not in", "except", "other than", "excluding"])
    return f"({words})"


def bound(text: str, pattern: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(lower({text}), {sql_str(pattern)}, 1), '') AS DOUBLE)"


EXCL = f"(CASE WHEN {exclusion('text')} THEN {first_code('text')} END)"
TEXT_CUR = f"(CASE WHEN {EXCL} IS NULL THEN {first_code('text')} END)"

DISTANCE_PAIRS = """pairs AS (
  SELECT q.qid, v.id, sum((CAST(v.x AS DOUBLE) - q.x) * (CAST(v.x AS DOUBLE) - q.x)) AS distance
  FROM vec v JOIN qvec q ON v.i = q.i GROUP BY q.qid, v.id
)"""

VEC = """vec AS (
  SELECT vec_id AS id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i
  FROM embeddings
)"""

CENTROIDS = """centroid_dims AS (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
  GROUP BY label, i
)"""

QVEC = """qvec AS (SELECT CAST(label AS BIGINT) AS qid, i, x FROM centroid_dims)"""

RANKED = """ranked AS (
  SELECT qid, id, distance,
    row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank
  FROM pairs
)"""


def valid_sql(amount_numeric: bool) -> str:
    def text_ok(c):
        return (f"(CASE WHEN {c} IS NOT NULL AND length({strip(c)}) > 0 "
                f"AND {c} NOT IN ('None', '0', '0.0') THEN 1 ELSE 0 END)")
    amt = ("(CASE WHEN total_amount IS NOT NULL AND total_amount <> 0 THEN 1 ELSE 0 END)"
           if amount_numeric else text_ok("total_amount"))
    return f"({text_ok('invoice_number')} + {text_ok('seller_name')} + {text_ok('buyer_name')} + {amt} >= 2)"


def amount_text(e: str) -> str:
    return f"regexp_replace(CAST(CAST({e} AS DECIMAL(38,2)) AS VARCHAR), '0$', '')"


def document_text_sql() -> str:
    def t(c):
        return f"({c} IS NOT NULL AND length({c}) > 0)"
    return ("concat_ws(' | ', "
            f"CASE WHEN {t('invoice_number')} THEN 'Invoice Number: ' || invoice_number END, "
            f"CASE WHEN {t('seller_name')} THEN 'Seller: ' || seller_name END, "
            f"CASE WHEN {t('buyer_name')} THEN 'Buyer: ' || buyer_name END, "
            f"CASE WHEN total_amount IS NOT NULL AND total_amount <> 0 AND {t('currency')} "
            f"THEN 'Amount: ' || {amount_text('total_amount')} || ' ' || currency END, "
            f"CASE WHEN {t('invoice_date')} THEN 'Date: ' || invoice_date END, "
            f"CASE WHEN {t('raw_text')} THEN substr(raw_text, 1, 500) END)")


def tokens_sql(text: str) -> str:
    return f"regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')"


def bucket_sql(tok: str) -> str:
    return f"(CAST(('0x' || substr(md5({tok}), 1, 8)) AS BIGINT) % 64)"


def join_pages_sql(method: str) -> str:
    parts = "string_split(text, chr(10))"
    if method == "pymupdf":
        j = f"array_to_string({parts}, '')"
    elif method == "pdfplumber":
        j = f"array_to_string(list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: x || chr(10)), '')"
    else:
        j = f"array_to_string(list_transform({parts}, lambda x: x || chr(10)), '')"
    return strip(j)


FIELD_SQL = {
    k: f"NULLIF({strip(f'regexp_extract(text, {sql_str(p)}, 1)')}, '')"
    for k, p in LABELS.items()
}


def _validation_cols(prefix: str = "") -> str:
    fields = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency"]
    return " + ".join(f"(CASE WHEN {prefix}{f} IS NULL THEN 1 ELSE 0 END)" for f in fields)


def amount_number_sql(line: str) -> str:
    num = f"NULLIF(regexp_extract({line}, {sql_str(AMOUNT_NUMBER)}, 1), '')"
    euro = f"replace(replace({num}, '.', ''), ',', '.')"
    return (f"(CASE WHEN regexp_matches({num}, {sql_str(EUROPEAN_NUMBER)}) THEN {euro} "
            f"ELSE replace({num}, ',', '') END)")


PROCESSED = f"""processed AS (
  SELECT doc_id, text, extraction_method,
    coalesce(length(text), 0) >= {MIN_DOCUMENT_CHARS} AS success,
    {FIELD_SQL['invoice_number']} AS invoice_number,
    strftime(coalesce(try_strptime({FIELD_SQL['invoice_date']}, '%Y-%m-%d'),
                      try_strptime({FIELD_SQL['invoice_date']}, '%B %-d, %Y')), '%Y-%m-%d') AS invoice_date,
    {FIELD_SQL['seller_name']} AS seller_name,
    {FIELD_SQL['buyer_name']} AS buyer_name,
    {parse_amount(amount_number_sql(FIELD_SQL['amount_line']))} AS total_amount,
    NULLIF(regexp_extract(upper({FIELD_SQL['amount_line']}), '\\b([A-Z]{{3}})\\b', 1), '') AS currency
  FROM cascaded
)"""


def build() -> dict[str, str]:
    q = {}
    q["parse_amount"] = with_views(
        f"SELECT src_id, total_amount AS raw_amount, {parse_amount('total_amount')} AS amount FROM invoices_raw",
        INVOICES_RAW)
    q["valid_records"] = with_views(
        f"SELECT src_id, invoice_number, seller_name, buyer_name, total_amount FROM invoices_raw "
        f"WHERE {valid_sql(False)}", INVOICES_RAW)
    q["attribute_search"] = _search(
        f"{_like('seller_name', SEARCH_SELLER)} AND total_amount >= {SEARCH_MIN} "
        f"AND currency = '{SEARCH_CURRENCY}'")
    q["like_invoice_number"] = _search(_like("invoice_number", LIKE_NUMBER))
    q["like_seller"] = _search(_like("seller_name", LIKE_SELLER))
    q["like_buyer"] = _search(_like("buyer_name", LIKE_BUYER))
    q["amount_range"] = _search(f"total_amount >= {AMOUNT_LOW} AND "
                                f"total_amount <= {AMOUNT_HIGH}")
    q["currency_eq"] = _search(f"currency = '{ONLY_CURRENCY}'")
    q["exclude_currency"] = with_views(
        f"SELECT id, currency FROM invoices WHERE currency IS DISTINCT FROM '{EXCLUDED}'", *INV)
    q["seller_contains"] = with_views(
        f"SELECT id, seller_name FROM invoices WHERE "
        f"coalesce(instr(lower(seller_name), lower({sql_str(SELLER_PART)})) > 0, false)", *INV)
    q["load_table_newest_first"] = with_views(
        "SELECT id, extracted_at, invoice_number FROM invoices ORDER BY extracted_at DESC, id DESC", *INV)
    q["upsert_invoices"] = with_views("""SELECT first_id AS id, invoice_number, file_name, total_amount,
  buyer_name, extracted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_number, file_name, solo ORDER BY id DESC) AS rn,
    min(id) OVER (PARTITION BY invoice_number, file_name, solo) AS first_id
  FROM (SELECT *, CASE WHEN invoice_number IS NULL OR file_name IS NULL THEN id END AS solo FROM invoices))
WHERE rn = 1""", *INV)
    q["incremental_ingest"] = q["upsert_invoices"]
    q["report_projection"] = with_views(
        "SELECT invoice_number, invoice_date, seller_name, buyer_name, total_amount, currency, extracted_at "
        "FROM invoices", *INV)
    q["store_projection"] = with_views(
        f"SELECT src_id AS id, invoice_number, invoice_date, seller_name, buyer_name, "
        f"{parse_amount('total_amount')} AS total_amount, currency, file_name, extracted_at, "
        f"'' AS raw_text, '' AS extraction_method FROM invoices_raw", INVOICES_RAW)
    q["report_labels"] = with_views(
        f"SELECT id, concat_ws(' ', coalesce({amount_text('total_amount')}, 'N/A'), coalesce(currency, 'N/A')) "
        f"AS amount_label, '$' || format('{{:,.2f}}', coalesce(total_amount, 0.0)) AS money_label, "
        f"coalesce(seller_name, 'N/A') AS seller_label, "
        f"format('{{:,.2f}}', length(raw_text) / 1024.0) || ' KB' AS size_label FROM invoices", *INV)
    q["document_text"] = with_views(f"SELECT id, {document_text_sql()} AS matched_text FROM invoices", *INV)
    q["text_prefix"] = "SELECT doc_id, substr(text, 1, 500) AS prefix FROM documents"
    q["flatten_struct"] = with_views(
        "SELECT id, seller_name AS inv_seller_name, total_amount AS inv_amount_value, "
        "currency AS inv_amount_currency FROM invoices", *INV)
    q["summary_stats"] = with_views(
        "SELECT count(*) AS n_records, round(coalesce(sum(total_amount), 0.0), 2) AS total_value, "
        "round(avg(total_amount), 4) AS avg_amount, count(DISTINCT currency) AS n_currencies, "
        "count(DISTINCT seller_name) AS n_sellers FROM invoices", *INV)
    q["distinct_counts"] = with_views(
        "SELECT count(DISTINCT currency) AS n_currencies, count(DISTINCT seller_name) AS n_sellers, "
        "count(DISTINCT buyer_name) AS n_buyers FROM invoices", *INV)
    q["currency_distribution"] = with_views(
        "SELECT currency, count(*) AS count FROM invoices WHERE currency IS NOT NULL GROUP BY currency "
        "ORDER BY count DESC, currency", *INV)
    q["top_sellers"] = with_views(
        f"SELECT seller_name, count(*) AS count FROM invoices WHERE seller_name IS NOT NULL "
        f"GROUP BY seller_name ORDER BY count DESC, seller_name LIMIT 10", *INV)
    q["per_currency_totals"] = with_views(
        "SELECT currency, count(*) AS n_records, round(coalesce(sum(total_amount), 0.0), 2) AS total_value "
        "FROM invoices GROUP BY currency", *INV)
    q["skipped_counts"] = with_views(
        f"SELECT count(*) AS n_input, CAST(count_if({valid_sql(True)}) AS BIGINT) AS n_valid, "
        f"CAST(count_if(NOT {valid_sql(True)}) AS BIGINT) AS n_skipped FROM invoices", *INV)
    q["delete_by_id"] = with_views(
        "SELECT id, invoice_number FROM invoices WHERE id NOT IN "
        "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IS NOT NULL)", *INV)
    q["delete_selected"] = with_views(f"""SELECT 'deleted' AS metric, count(*) AS value FROM invoices WHERE currency = 'JPY'
UNION ALL SELECT 'remaining', count(*) FROM invoices WHERE currency IS DISTINCT FROM 'JPY'
UNION ALL SELECT 'vectors', count(*) FROM invoices WHERE currency IS DISTINCT FROM 'JPY' AND {valid_sql(True)}""",
                                      *INV)
    q["append_records"] = with_views(
        "SELECT id, invoice_number, 'table' AS origin, NULL::VARCHAR AS currency FROM invoices "
        "UNION ALL SELECT src_id, invoice_number, 'raw', currency FROM invoices_raw", *INV)
    q["nl_exclude_currency"] = with_views(f"SELECT qid, {EXCL} AS exclude_currency FROM query_texts", QUERY_TEXTS)
    q["nl_min_amount"] = with_views(
        f"SELECT qid, {bound('text', r'(?:above|over|more than|greater than|>|>=)\s*\$?(\d+(?:\.\d+)?)')} "
        f"AS min_amount FROM query_texts", QUERY_TEXTS)
    q["nl_max_amount"] = with_views(
        f"SELECT qid, {bound('text', r'(?:below|under|less than|<|<=)\s*\$?(\d+(?:\.\d+)?)')} "
        f"AS max_amount FROM query_texts", QUERY_TEXTS)
    q["nl_currency"] = with_views(f"SELECT qid, {TEXT_CUR} AS currency FROM query_texts", QUERY_TEXTS)
    q["resolve_filters"] = with_views(f"""SELECT qid,
  coalesce(CASE WHEN ui_min > 0 THEN ui_min END, {bound('text', r'(?:above|over|more than|greater than|>|>=)\s*\$?(\d+(?:\.\d+)?)')}) AS min_amount,
  coalesce(CASE WHEN ui_max > 0 THEN ui_max END, {bound('text', r'(?:below|under|less than|<|<=)\s*\$?(\d+(?:\.\d+)?)')}) AS max_amount,
  coalesce(NULLIF(ui_currency, ''), {TEXT_CUR}) AS currency,
  {EXCL} AS exclude_currency,
  NULLIF(ui_seller, '') AS seller_name
FROM (SELECT *,
  CASE WHEN qid % 5 = 0 THEN 1000.0 WHEN qid % 5 = 1 THEN 0.0 END::DOUBLE AS ui_min,
  CASE WHEN qid % 7 = 0 THEN 2000.0 END::DOUBLE AS ui_max,
  CASE WHEN qid % 6 = 0 THEN 'GBP' WHEN qid % 6 = 1 THEN '' END AS ui_currency,
  CASE WHEN qid % 4 = 0 THEN 'Supplier#00000001' WHEN qid % 4 = 1 THEN '' END AS ui_seller
  FROM query_texts)""", QUERY_TEXTS)
    q["extraction_cascade"] = with_views(
        "SELECT doc_id, extraction_method, length(text) AS text_length FROM cascaded", DOC_CANDIDATES, CASCADE)
    q["text_by_page"] = ("SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS page_no, "
                         "unnest(string_split(text, chr(10))) AS page_text FROM documents")
    cols = ", ".join(f"md5({join_pages_sql(m)}) AS md5_{i}, length({join_pages_sql(m)}) AS len_{i}"
                     for i, m in enumerate(METHODS, start=1))
    q["pages_to_text"] = f"SELECT doc_id, {cols} FROM documents"
    q["page_counts"] = ("SELECT doc_id, len(string_split(text, chr(10))) AS page_count, length(text) AS n_chars, "
                        "lang AS meta_lang FROM documents")
    q["short_text_gate"] = (f"SELECT doc_id, coalesce(length(text), 0) >= {MIN_DOCUMENT_CHARS} AS passed, "
                            f"CASE WHEN coalesce(length(text), 0) >= {MIN_DOCUMENT_CHARS} THEN '' "
                            f"ELSE {sql_str(SHORT_TEXT_ERROR)} END AS error FROM documents")
    prompt = f"({sql_str(PROMPT_HEAD)} || text || {sql_str(PROMPT_TAIL)})"
    q["build_prompts"] = f"SELECT doc_id, length({prompt}) AS prompt_length, md5({prompt}) AS prompt_md5 FROM documents"
    q["extract_fields_rules"] = with_views(
        "SELECT src_id, invoice_number, invoice_date, NULLIF(seller_name, '') AS seller_name, "
        "NULLIF(buyer_name, '') AS buyer_name, CAST(amt AS DOUBLE) AS total_amount, "
        "CASE WHEN amt IS NULL THEN NULL ELSE coalesce(currency, 'USD') END AS currency FROM invoices_raw",
        INVOICES_RAW)
    q["normalize_fields"] = with_views(
        f"SELECT src_id, invoice_date, currency, {parse_amount('total_amount')} AS total_amount FROM invoices_raw",
        INVOICES_RAW)
    q["json_salvage"] = with_views("""SELECT event_id,
  CASE WHEN json_valid(reply) THEN 'direct' WHEN json_valid(span) THEN 'span' END AS source,
  CAST(json_extract(CASE WHEN json_valid(reply) THEN reply WHEN json_valid(span) THEN span END, '$.k') AS DOUBLE) AS k,
  CASE WHEN NOT json_valid(reply) AND NOT coalesce(json_valid(span), false)
    THEN 'no valid JSON in reply: ' || substr(reply, 1, 200) END AS error
FROM (SELECT *, NULLIF(regexp_extract(reply, '\\{.*\\}', 0, 's'), '') AS span FROM model_replies)""", MODEL_REPLIES)
    no_commas = "replace(coalesce(total_amount, 'None'), ',', '')"
    warn = f"{py_float(strip(no_commas))} IS NULL"
    miss = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FIELDS)
    q["validate_records"] = with_views(
        f"SELECT src_id, ({_validation_cols()}) = 0 AS is_valid, ({_validation_cols()}) AS n_missing, "
        f"concat_ws(',', {miss}) AS missing, CASE WHEN {warn} THEN 1 ELSE 0 END AS n_warnings FROM invoices_raw",
        INVOICES_RAW)
    q["assemble_record"] = with_views(
        "SELECT src_id, CASE WHEN invoice_number IS NULL THEN NULL ELSE invoice_number END AS invoice_number, "
        "'doc_' || CAST(src_id AS VARCHAR) || '.pdf' AS file_name, 'pymupdf' AS extraction_method, "
        "1 AS page_count, length(text) AS text_length FROM invoice_text JOIN invoices_raw USING (src_id)",
        INVOICES_RAW, INVOICE_TEXT)
    q["process_documents"] = with_views(f"""SELECT doc_id, success,
  CASE WHEN success THEN '' ELSE {sql_str(SHORT_TEXT_ERROR)} END AS error,
  length(text) AS text_length, extraction_method,
  len(string_split(coalesce(text, ''), chr(10))) AS page_count,
  success AND ({_validation_cols()}) = 0 AS is_valid,
  CASE WHEN success THEN ({_validation_cols()}) ELSE 6 END AS n_missing
FROM processed""", DOC_CANDIDATES, CASCADE, PROCESSED)
    q["ingest_batch"] = with_views(
        "SELECT doc_id AS id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file_name, extraction_method, "
        "length(text) AS text_length FROM processed WHERE success", DOC_CANDIDATES, CASCADE, PROCESSED)
    q["batch_tally"] = with_views(
        "SELECT count(*) AS total, CAST(count_if(success) AS BIGINT) AS successful, "
        "CAST(count_if(NOT success) AS BIGINT) AS failed FROM processed",
        DOC_CANDIDATES, CASCADE, PROCESSED)
    q["embed_documents"] = f"""WITH t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS tok FROM documents),
b AS (SELECT doc_id, {bucket_sql('tok')} AS bucket, count(*) AS c FROM t WHERE tok <> '' GROUP BY ALL)
SELECT doc_id, bucket, round(CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 4) AS weight
FROM b"""
    q["l2_distance"] = with_views("""SELECT v.vec_id, v.label, round(sum((CAST(v.x AS DOUBLE) - c.x) * (CAST(v.x AS DOUBLE) - c.x)), 6) AS distance
FROM (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) v
JOIN centroid_dims c ON v.label = c.label AND v.i = c.i GROUP BY v.vec_id, v.label""", CENTROIDS)
    q["knn_candidates"] = with_views(
        f"SELECT qid, id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= {KNN_K}",
        VEC, CENTROIDS, QVEC, DISTANCE_PAIRS, RANKED)
    q["semantic_search"] = with_views(f"""SELECT qid, rank, position, id, round(distance, 6) AS distance,
  round(1.0 / (1.0 + distance), 6) AS score, invoice_number, total_amount, currency FROM (
  SELECT r.*, i.invoice_number, i.total_amount, i.currency,
    row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS position
  FROM ranked r JOIN invoices i ON r.id = i.id
  WHERE r.rank <= {5 * TOP_K} AND {valid_sql(True)}
    AND (r.qid % 3 <> 0 OR coalesce(i.total_amount >= 100000.0, false))
    AND (r.qid % 4 <> 1 OR coalesce(i.currency = 'EUR', false))
    AND (r.qid % 5 <> 2 OR i.currency IS DISTINCT FROM 'USD'))
WHERE position <= {TOP_K}""", *INV, VEC, CENTROIDS, QVEC, DISTANCE_PAIRS, RANKED)
    q["semantic_search_prefilter"] = with_views(f"""SELECT qid, rank, rank AS position, id,
  round(distance, 6) AS distance FROM (
  SELECT p.qid, p.id, p.distance,
    row_number() OVER (PARTITION BY p.qid ORDER BY round(p.distance, 9), p.id) AS rank
  FROM pairs p JOIN invoices i ON p.id = i.id WHERE i.currency = 'EUR' AND {valid_sql(True)})
WHERE rank <= {TOP_K}""", *INV, VEC, CENTROIDS, QVEC, DISTANCE_PAIRS)
    q["semantic_search_prefilter_per_query"] = with_views(f"""SELECT qid, rank, rank AS position, id,
  round(distance, 6) AS distance, invoice_number, total_amount, currency FROM (
  SELECT p.qid, p.id, p.distance, i.invoice_number, i.total_amount, i.currency,
    row_number() OVER (PARTITION BY p.qid ORDER BY round(p.distance, 9), p.id) AS rank
  FROM pairs p JOIN invoices i ON p.id = i.id
  WHERE {valid_sql(True)}
    AND (p.qid % 3 <> 0 OR coalesce(i.total_amount >= 100000.0, false))
    AND (p.qid % 4 <> 1 OR coalesce(i.currency = 'EUR', false))
    AND (p.qid % 5 <> 2 OR i.currency IS DISTINCT FROM 'USD'))
WHERE rank <= {TOP_K}""", *INV, VEC, CENTROIDS, QVEC, DISTANCE_PAIRS)
    doc_text = document_text_sql()
    toks = f"list_filter({tokens_sql('matched_text')}, lambda t: t <> '')"
    q["rebuild_vectors"] = with_views(f"""SELECT id, matched_text,
  len(list_distinct(list_transform({toks}, lambda t: {bucket_sql('t')}))) AS n_buckets
FROM (SELECT id, {doc_text} AS matched_text FROM invoices WHERE {valid_sql(True)})""", *INV)
    q["add_documents"] = with_views(f"""SELECT id, CASE WHEN currency = 'EUR' THEN 1 ELSE 0 END AS seq,
  length({doc_text}) AS text_length FROM invoices WHERE {valid_sql(True)}""", *INV)
    min_re = r'(?:above|over|more than|greater than|>|>=)\s*\$?(\d+(?:\.\d+)?)'
    max_re = r'(?:below|under|less than|<|<=)\s*\$?(\d+(?:\.\d+)?)'
    q["semantic_search_text"] = with_views(f""", busiest AS (
  SELECT seller_name, count(*) AS n FROM invoices WHERE seller_name IS NOT NULL
  GROUP BY seller_name ORDER BY n DESC, seller_name LIMIT 10),
req AS (
  SELECT qid, text, {bound('text', min_re)} AS f_min, {bound('text', max_re)} AS f_max,
    {TEXT_CUR} AS f_cur, {EXCL} AS f_excl, CASE WHEN qid % 2 = 0 THEN seller_name END AS f_seller
  FROM (SELECT CAST(regexp_extract(seller_name, '(\\d+)$', 1) AS BIGINT) AS qid, seller_name,
    'invoices from ' || seller_name || CASE CAST(regexp_extract(seller_name, '(\\d+)$', 1) AS BIGINT) % 3
      WHEN 0 THEN ' above 100000' WHEN 1 THEN ' not in usd' ELSE ' in eur under 300000' END AS text FROM busiest)),
docs AS (SELECT id, {doc_text} AS matched_text FROM invoices WHERE {valid_sql(True)}),
dtok AS (SELECT id, unnest({tokens_sql('matched_text')}) AS tok FROM docs),
dcnt AS (SELECT id, {bucket_sql('tok')} AS b, count(*) AS c FROM dtok WHERE tok <> '' GROUP BY ALL),
dw AS (SELECT id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM dcnt),
qtok AS (SELECT qid, unnest({tokens_sql('text')}) AS tok FROM req),
qcnt AS (SELECT qid, {bucket_sql('tok')} AS b, count(*) AS c FROM qtok WHERE tok <> '' GROUP BY ALL),
qw AS (SELECT qid, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY qid)) AS FLOAT) AS DOUBLE) AS w FROM qcnt),
dims AS (SELECT range AS b FROM range(64)),
vd AS (SELECT d.id, dims.b, coalesce(dw.w, 0.0) AS w FROM docs d CROSS JOIN dims LEFT JOIN dw ON dw.id = d.id AND dw.b = dims.b),
qd AS (SELECT r.qid, dims.b, coalesce(qw.w, 0.0) AS w FROM req r CROSS JOIN dims LEFT JOIN qw ON qw.qid = r.qid AND qw.b = dims.b),
pairs AS (SELECT qd.qid, vd.id, sum((vd.w - qd.w) * (vd.w - qd.w)) AS distance FROM vd JOIN qd ON vd.b = qd.b GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM pairs)
SELECT qid, rank, position, id, round(distance, 6) AS distance, round(1.0 / (1.0 + distance), 6) AS score FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS position
  FROM ranked r JOIN invoices i ON r.id = i.id JOIN req ON req.qid = r.qid
  WHERE r.rank <= {5 * TOP_K}
    AND (f_min IS NULL OR coalesce(i.total_amount >= f_min, false))
    AND (f_max IS NULL OR coalesce(i.total_amount <= f_max, false))
    AND (f_cur IS NULL OR coalesce(i.currency = f_cur, false))
    AND (f_excl IS NULL OR i.currency IS DISTINCT FROM f_excl)
    AND (f_seller IS NULL OR coalesce(instr(lower(i.seller_name), lower(f_seller)) > 0, false)))
WHERE position <= {TOP_K}""", *INV)
    q["vector_stats"] = ("SELECT count(*) AS n_vectors, coalesce(max(len(embedding)), 0) AS dimension, "
                         "'hashed-bow-md5' AS model_name FROM embeddings")
    q["vector_table_roundtrip"] = ("SELECT vec_id AS id, label, len(embedding) AS dims, "
                                   "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) "
                                   "AS sq_norm FROM embeddings")
    q["write_json_roundtrip"] = q["report_projection"]
    q["write_csv_roundtrip"] = with_views(
        "SELECT id, NULLIF(invoice_number, '') AS invoice_number, NULLIF(seller_name, '') AS seller_name, "
        "NULLIF(buyer_name, '') AS buyer_name, total_amount, NULLIF(currency, '') AS currency, "
        "file_name AS file_name, page_count AS file_pages FROM invoices", *INV)
    q["file_name_from_path"] = ("SELECT page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] "
                                "AS file_name FROM pages")
    q.update(batch_statements())
    q.update(document_statements())
    q.update(change_statements())
    return q


def vector_digest(texts: str) -> str:
    """Views that end in ``digests(id, digest)`` of the texts of a view with id and matched_text."""
    return f"""dtok AS (SELECT id, unnest({tokens_sql('matched_text')}) AS tok FROM {texts}),
dcnt AS (SELECT id, {bucket_sql('tok')} AS b, count(*) AS c FROM dtok WHERE tok <> '' GROUP BY ALL),
dw AS (SELECT id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM dcnt),
digests AS (SELECT t.id, round(coalesce(sum(w * (b + 1)), 0.0), 3) AS digest FROM {texts} t LEFT JOIN dw ON dw.id = t.id GROUP BY t.id)"""


def batch_statements() -> dict[str, str]:
    """Searches with many requests, and replaced vectors."""
    all_pairs = """allpairs AS (
  SELECT a.id AS qid, b.id AS id, sum((CAST(b.x AS DOUBLE) - a.x) * (CAST(b.x AS DOUBLE) - a.x)) AS distance
  FROM vec a JOIN vec b ON a.i = b.i GROUP BY a.id, b.id)"""
    short = document_text_sql().replace("invoice_date", "no_date").replace("raw_text", "no_text")
    return {
        "knn_batch": with_views("""SELECT qid, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM allpairs) WHERE rank <= 5""", VEC, all_pairs),
        "semantic_search_batch": with_views(f"""SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance, invoice_number, currency FROM (
  SELECT p.*, i.invoice_number, i.currency, row_number() OVER (PARTITION BY p.qid ORDER BY round(p.distance, 9), p.id) AS rank
  FROM allpairs p JOIN invoices i ON p.id = i.id WHERE {valid_sql(True)}
    AND (p.qid % 3 <> 0 OR coalesce(i.total_amount >= 100000.0, false))
    AND (p.qid % 4 <> 1 OR coalesce(i.currency = 'EUR', false))
    AND (p.qid % 5 <> 2 OR i.currency IS DISTINCT FROM 'USD')) WHERE rank <= 5""", *INV, VEC, all_pairs),
        "empty_index": "SELECT vec_id AS qid, vec_id AS id, CAST(0 AS INTEGER) AS rank FROM embeddings WHERE false",
        "replace_vectors": with_views("SELECT d.id, t.seq, d.digest FROM digests d JOIN texts t ON t.id = d.id", *INV, f"""texts AS (
  SELECT id, CASE WHEN currency = 'EUR' THEN {document_text_sql()} ELSE {short} END AS matched_text, CASE WHEN currency = 'EUR' THEN 1 ELSE 0 END AS seq
  FROM (SELECT *, NULL::VARCHAR AS no_date, NULL::VARCHAR AS no_text FROM invoices) WHERE {valid_sql(True)})""", vector_digest("texts")),
    }


# What the rules read out of the rendered invoice of each order, and which documents are cut short.
INVOICE_FIELDS = """fields AS (
  SELECT src_id, o_custkey, src_id % 40 <> 0 AS long_enough,
    CASE WHEN src_id % 4 <> 0 THEN 'pymupdf' WHEN src_id % 8 <> 0 THEN 'pdfplumber' ELSE 'ocr' END AS extraction_method,
    CASE WHEN src_id % 40 = 0 THEN 12 ELSE length(text) END AS text_length,
    invoice_number, invoice_date, NULLIF(seller_name, '') AS seller_name, NULLIF(buyer_name, '') AS buyer_name,
    CAST(amt AS DOUBLE) AS total_amount, CASE WHEN amt IS NOT NULL THEN coalesce(currency, 'USD') END AS rule_currency, currency
  FROM invoices_raw JOIN invoice_text USING (src_id))"""


def _result(success: str, error: str, currency: str, account: str) -> str:
    six = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount"]
    cols = ", ".join(f"CASE WHEN {success} THEN {f} END AS {f}" for f in six)
    present = " AND ".join(f"{f} IS NOT NULL" for f in [*six, currency])
    return (f"SELECT src_id, {success} AS success, {error} AS error, text_length, extraction_method, {cols}, "
            f"CASE WHEN {success} THEN {currency} END AS currency, {account} AS account, {success} AND {present} AS is_valid FROM fields")


def document_statements() -> dict[str, str]:
    """Replies, extractors, batch and file ingest."""
    short = "'document text is shorter than the minimum'"
    last = "(o_custkey % 10)"
    asked = f"(long_enough AND {last} < 8)"
    told = (f"CASE WHEN NOT long_enough THEN {short} WHEN {last} = 9 THEN 'RuntimeError: no answer for account ' || CAST(o_custkey AS VARCHAR) "
            f"WHEN {last} = 8 THEN 'no valid JSON in reply: I can''t read this' ELSE '' END")
    fields = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount", "currency"]
    missing = ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fields)
    return {
        "reply_to_record": f"""SELECT *, concat_ws(',', {missing}) = '' AS is_valid, concat_ws(',', {missing}) AS missing,
  CASE WHEN total_amount IS NULL THEN 1 ELSE 0 END AS n_warnings FROM (
  SELECT event_id, CASE WHEN m < 4 THEN 'E-' || CAST(event_id AS VARCHAR) END AS invoice_number, CASE WHEN m < 4 THEN '2024-01-15' END AS invoice_date,
    CASE WHEN m < 4 THEN event_type END AS seller_name, CASE WHEN m IN (0, 1, 3) THEN 'user ' || CAST(user_id AS VARCHAR) END AS buyer_name,
    CASE WHEN m < 3 THEN CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) END AS total_amount, CASE WHEN m IN (0, 1, 3) THEN 'EUR' END AS currency,
    CASE WHEN m < 4 THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS extra_k, CASE WHEN m < 4 THEN 1 ELSE 0 END AS n_extras,
    CASE WHEN m = 3 THEN 'span' WHEN m < 3 THEN 'direct' END AS source,
    CASE WHEN m = 4 THEN 'reply is JSON but no object' WHEN m = 5 THEN 'no valid JSON in reply: sorry, ' || event_type END AS problem
  FROM (SELECT *, event_id % 6 AS m FROM events))""",
        "process_invoices": with_views(_result("long_enough", f"CASE WHEN long_enough THEN '' ELSE {short} END", "rule_currency", "NULL::VARCHAR"),
                                       INVOICES_RAW, INVOICE_TEXT, INVOICE_FIELDS),
        "process_with_model": with_views(_result(asked, told, "currency", f"CASE WHEN {asked} THEN CAST(o_custkey AS VARCHAR) END"),
                                         INVOICES_RAW, INVOICE_TEXT, INVOICE_FIELDS),
        "ingest_invoices": with_views("""SELECT first_id AS id, invoice_number, invoice_date, seller_name, buyer_name, total_amount, rule_currency AS currency,
  file_name, extraction_method FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_number, file_name, solo ORDER BY src_id DESC) AS rn,
    min(src_id) OVER (PARTITION BY invoice_number, file_name, solo) AS first_id
  FROM (SELECT *, 'doc_' || CAST(src_id % 12000 AS VARCHAR) || '.pdf' AS file_name, CASE WHEN invoice_number IS NULL THEN src_id END AS solo
        FROM fields WHERE long_enough)) WHERE rn = 1""", INVOICES_RAW, INVOICE_TEXT, INVOICE_FIELDS),
        "ingest_files": with_views(f"""SELECT invoice_number, invoice_date, seller_name, buyer_name, total_amount, currency, length(raw_text) AS text_length,
  length({document_text_sql()}) AS vector_text_length, (SELECT count(*) FROM supplier) AS n_files FROM docs""", """docs AS (
  SELECT *, concat_ws(chr(10), 'Invoice Number: ' || invoice_number, 'Date: 2024-03-05', 'Seller: ' || seller_name, 'Buyer: ' || buyer_name,
                      'Total: ' || CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS VARCHAR) || ' EUR') || chr(10) AS raw_text
  FROM (SELECT CASE WHEN s_suppkey % 7 <> 0 THEN 'S-' || CAST(s_suppkey AS VARCHAR) END AS invoice_number, '2024-03-05' AS invoice_date,
          s_name AS seller_name, 'House ' || CAST(s_suppkey % 5 AS VARCHAR) AS buyer_name, s_acctbal,
          CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS DOUBLE) AS total_amount, 'EUR' AS currency FROM supplier WHERE s_suppkey % 10 <> 0))"""),
        "scan_directory": ("SELECT page_id, CAST(strlen(coalesce(html, '')) + 1 AS BIGINT) AS length, md5(coalesce(html, '') || chr(10)) AS content_md5 "
                           "FROM pages"),
        "load_json": with_views("SELECT id, invoice_number, total_amount, currency FROM invoices", *INV),
        "missing_store": with_views("SELECT id, invoice_number, total_amount FROM invoices", *INV),
        "stamp_ingestion": with_views("SELECT CAST(count_if(id % 2 = 0) AS BIGINT) AS n_kept, CAST(count_if(id % 2 = 1) AS BIGINT) AS n_stamped, "
                                      "CAST(1 AS BIGINT) AS n_stamps FROM invoices", *INV),
        "export_csv": with_views(
            "SELECT NULLIF(invoice_number, '') AS invoice_number, invoice_date, NULLIF(seller_name, '') AS seller_name, NULLIF(buyer_name, '') AS buyer_name, "
            "total_amount, currency, extracted_at, 1 AS n_files FROM invoices", *INV),
    }


def _merged(rows: str) -> str:
    """Upsert of a view: of every number and file the first id and the last row's other columns."""
    return f"""merged AS (SELECT * EXCLUDE (id, rn, first_id, solo), first_id AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY invoice_number, file_name, solo ORDER BY id DESC) AS rn,
    min(id) OVER (PARTITION BY invoice_number, file_name, solo) AS first_id
  FROM (SELECT *, CASE WHEN invoice_number IS NULL OR file_name IS NULL THEN id END AS solo FROM {rows})) WHERE rn = 1)"""


def change_statements() -> dict[str, str]:
    """Written changes: what the tables hold after them."""
    short = document_text_sql().replace("invoice_date", "no_date").replace("raw_text", "no_text")
    texts = f"""texts AS (SELECT id, {short} AS matched_text FROM (SELECT *, NULL::VARCHAR AS no_date, NULL::VARCHAR AS no_text FROM merged)
  WHERE {valid_sql(True)})"""
    return {
        "change_table": with_views("SELECT id, invoice_number, file_name, total_amount, buyer_name FROM merged", *INV, _merged("invoices")),
        "delete_records": with_views("""SELECT m.id, m.invoice_number, m.currency, d.digest FROM merged m LEFT JOIN digests d ON d.id = m.id
WHERE m.currency IS DISTINCT FROM 'JPY'""", *INV, _merged("invoices"), texts, vector_digest("texts")),
        "delete_all": with_views("""SELECT id, invoice_number, total_amount, (SELECT count(*) FROM everything) AS n_deleted, CAST(0 AS BIGINT) AS n_vectors
FROM merged""", *INV, _merged("invoices").replace("merged AS", "everything AS", 1), "eur AS (SELECT * FROM invoices WHERE currency = 'EUR')", _merged("eur")),
        "save_fan_out": with_views("""SELECT 'json' AS sink, count(*) AS n_saved, count(*) AS n_read FROM invoices
UNION ALL SELECT 'csv', count(*), count(*) FROM invoices
UNION ALL SELECT 'db', (SELECT count(*) FROM invoices), count(*) FROM merged""", *INV, _merged("invoices")),
    }


ORACLE = build()
