"""Vectors and exact nearest-neighbour search.

Embedding: the default embedder is a hashed bag of words computed entirely
in JVM expressions per row (no shuffle). A user model plugs in as a
``pandas_udf`` returning ``array<float>``.

Search: exact squared-L2 k-NN of a *batch* of queries against a vector
table in one scan (see ``knn``): small batches are size-checked and broadcast, larger
ones joined in blocks. Tasks emit at most k rows per query, so no pair
table of queries x vectors is ever materialised. Final ranks come from a
``row_number`` window per query (Spark plans a WindowGroupLimit for it).
"""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import knn
from ledgerlens.operators.dml import fingerprint, latest
from ledgerlens.session import scratch_path, written
from ledgerlens.functions.amounts import parse_amount
from ledgerlens.functions.text import TOKEN_SPLIT, document_text, tokens
from ledgerlens.operators.predicates import search_filter
from ledgerlens.operators.records import is_valid_record

# Default embedder name and dimension, candidate factor of the
# search (candidates = factor x top_k) and the allowed top_k range.
DEFAULT_MODEL = "hashed-bow-md5"
DEFAULT_DIM = 64
CANDIDATE_FACTOR = 5
TOP_K_RANGE = (1, 20)
DEFAULT_TOP_K = 5

# Query batches are broadcast only below these bounds; larger batches are
# joined with the vectors in blocks.
MAX_QUERY_BATCH = 2048
MAX_QUERY_BYTES = 64 * 1024 * 1024


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------- embedding

def token_buckets(text, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of every token: first 8 hex digits of its md5, modulo ``dim``.

    The pure column form of the embedder's bucket rule, for inspecting or
    joining buckets in SQL; the embedder itself hashes distinct tokens in
    Arrow batches (see ``_histogram_udf``), which is much cheaper.
    """
    return F.transform(tokens(text), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


def _bucket_of(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def _histogram_udf(dim: int):
    """Arrow-batched: token arrays -> unit-length count vectors (float32).

    The flat token array of the batch is dictionary-encoded in Arrow; each
    distinct token is hashed once, then one ``np.bincount`` over
    (row x dim + bucket) counts the whole batch. No Python object per token.
    Bucket = first 8 hex digits of the token's md5 (UTF-8), modulo ``dim``:
    the number Spark's ``pmod(conv(substr(md5(t), 1, 8), 16, 10), dim)`` gives.
    """
    @F.arrow_udf("array<float>")
    def histogram(toks: pa.Array) -> pa.Array:
        if isinstance(toks, pa.ChunkedArray):
            toks = toks.combine_chunks()
        n = len(toks)
        lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(toks)
        rows = np.repeat(np.arange(n, dtype=np.int64), lens)
        enc = pc.dictionary_encode(flat)
        words = enc.dictionary.to_pylist()
        ub = np.fromiter((_bucket_of(w, dim) if w else -1 for w in words), dtype=np.int64, count=len(words))
        b = ub[enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else \
            np.empty(0, dtype=np.int64)
        keep = b >= 0
        counts = np.bincount(rows[keep] * dim + b[keep], minlength=n * dim).reshape(n, dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        w = np.divide(counts, norm[:, None], out=np.zeros_like(counts), where=norm[:, None] > 0)
        offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(w.astype(np.float32).ravel()))

    # Marked nondeterministic only so that Catalyst never copies the call into
    # a pushed-down filter (which would run the Python side twice).
    return histogram.asNondeterministic()


def hashed_embedding(text, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length ``array<float>`` of token counts per md5 bucket.

    Tokenising (lower-case, split on non letters/digits) is a JVM
    expression; hashing distinct tokens, counting and normalising run per
    Arrow batch in numpy. No shuffle. Text without tokens gives zeros.
    """
    return _histogram_udf(dim)(F.split(F.lower(_col(text)), TOKEN_SPLIT))


def _worker_models() -> dict:
    """Models of this Python worker process, by name.

    The package travels to workers by value, so its own globals start anew with every task; this holder
    is a module of the worker's interpreter and stays.
    """
    return sys.modules.setdefault("_ledgerlens_models", types.ModuleType("_ledgerlens_models")).__dict__


def model_embedder(load_model, dim: int, name: str = "user-model"):
    """Column function for a user embedding model, Arrow-batched.

    ``load_model()`` returns an object with ``encode(list[str]) -> array
    (n x dim)``; it runs once per Python worker process and is reused by
    every later batch and task (give another ``name`` for another model). A null text counts as empty.
    Use as ``embed(df, "text", embedder=model_embedder(...))``.
    """
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        models = _worker_models()
        if name not in models:
            models[name] = load_model()
        vecs = np.asarray(models[name].encode(texts.fillna("").tolist()), dtype=np.float32).reshape(len(texts), dim)
        return pd.Series(list(vecs))

    # Nondeterministic: Catalyst then never copies the call, so every row is encoded once.
    run = run.asNondeterministic()
    return lambda c: run(c)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding", embedder=None,
          dim: int = DEFAULT_DIM) -> DataFrame:
    """Add an embedding column. ``embedder`` is ``None`` (hashed words) or a
    Column function such as a ``pandas_udf`` wrapping a user model."""
    f = embedder or (lambda c: hashed_embedding(c, dim))
    return df.withColumn(out_col, f(F.col(text_col)))


def sparse_weights(df: DataFrame, id_col: str, vec_col: str = "embedding") -> DataFrame:
    """``(id, bucket, weight)`` for the non-zero entries of a vector column.

    ``posexplode_outer``: the plain generator makes Catalyst infer a
    ``size(vec) > 0`` filter and push it below the scan's exchange, which
    would evaluate a UDF-made vector twice. The outer form's null rows are
    dropped by the weight filter.
    """
    return (df.select(id_col, F.posexplode_outer(vec_col).alias("bucket", "weight"))
              .filter(F.col("weight") != 0))


def l2_distance(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays, in DOUBLE."""
    sq = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v)


def similarity(distance) -> Column:
    return 1.0 / (1.0 + _col(distance))


def centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group. Exploded per dimension and aggregated with a
    partial (map-side) average, so a group of any size never sits in one task."""
    per_dim = (df.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
                 .groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x")))
    return (per_dim.groupBy(group_col)
                   .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_s"))
                   .select(group_col, F.transform("_s", lambda e: e["x"]).alias(vec_col)))


# --------------------------------------------------------------- k-NN

def _query_filters(batch: pa.RecordBatch) -> dict:
    """Per-query filter values of a block of query rows."""
    out = {}
    for name in batch.schema.names[2:]:
        col = batch.column(batch.schema.names.index(name))
        out[name] = col.cast(pa.float64()).to_numpy(zero_copy_only=False) if name in ("min_amount", "max_amount") else col.to_pylist()
    return out


def _query_mask(batch: pa.RecordBatch, flt: dict, lo: int, hi: int) -> np.ndarray:
    """(rows x queries) boolean mask of the per-query filters of queries lo..hi."""
    n = batch.num_rows
    names = batch.schema.names
    mask = np.ones((n, hi - lo), dtype=bool)

    def col(name):
        return batch.column(names.index(name))

    if "min_amount" in flt or "max_amount" in flt:
        amt = col("_amt").to_numpy(zero_copy_only=False).astype(np.float64)   # nan = null
        with np.errstate(invalid="ignore"):
            for key, op in (("min_amount", np.greater_equal), ("max_amount", np.less_equal)):
                if key in flt:
                    b = flt[key][lo:hi]
                    mask &= np.isnan(b)[None, :] | op(amt[:, None], b[None, :])
    if "currency" in flt or "exclude_currency" in flt:
        cur = pc.dictionary_encode(col("currency"))
        codes = pc.fill_null(cur.indices, -1).to_numpy(zero_copy_only=False)[:, None]      # a null equals nothing
        code = {v: i for i, v in enumerate(cur.dictionary.to_pylist())}
        if "currency" in flt:
            want = np.array([-3 if v is None else code.get(v, -2) for v in flt["currency"][lo:hi]])
            mask &= (want == -3)[None, :] | (codes == want[None, :])
        if "exclude_currency" in flt:
            mask &= codes != np.array([code.get(v, -2) for v in flt["exclude_currency"][lo:hi]])[None, :]
    for key, name in (("seller_name", "seller_name"), ("buyer_name", "buyer_name")):
        if key in flt:
            vals = col(name).to_pylist()
            low = np.array(["" if v is None else v.lower() for v in vals], dtype=str)
            present = np.array([v is not None for v in vals])
            for j, part in enumerate(flt[key][lo:hi]):
                if part is not None:
                    mask[:, j] &= present & (np.char.find(low, part.lower()) >= 0)
    return mask


def materialize_queries(queries: DataFrame) -> DataFrame:
    """Evaluate a query batch once.

    A batch of at most ``MAX_QUERY_BATCH`` rows becomes a local relation (it is
    re-read for the candidate search and the filter join without
    recomputing its plan); a larger one is written under the shared
    checkpoint folder and read back.
    """
    spark = queries.sparkSession
    rows = queries.limit(MAX_QUERY_BATCH + 1).collect()
    if len(rows) <= MAX_QUERY_BATCH:
        return spark.createDataFrame(rows, queries.schema)
    path = scratch_path(spark, "queries")
    queries.write.parquet(path)
    return spark.read.schema(queries.schema).parquet(path)


def knn_candidates(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id",
                   vec_col: str = "embedding", qid_col: str = "qid",
                   qvec_col: str = "embedding", payload: list[str] | tuple = (),
                   filter_cols: list[str] | tuple = (), max_broadcast: int | None = None) -> DataFrame:
    """``(qid, id, distance, rank, *payload)``: the ``k`` nearest vectors of every query.

    Order is (distance rounded to ORDER_DECIMALS, id), cut at exactly ``k``. Up to ``max_broadcast`` queries
    (``MAX_QUERY_BATCH``, and ``MAX_QUERY_BYTES`` of vectors) are broadcast; more are joined with the vectors in
    blocks (see ``knn``). Either way the vectors are scanned once. Query ids are expected to be unique.
    ``payload`` columns of the vector table come with the candidates: out of the same scan where queries are
    broadcast, by a join on the id of the few that are left otherwise.
    ``filter_cols`` (query columns among FILTER_COLUMNS) make it a pre-filtered
    search: each query ranks only the vectors passing its own filters; the
    vector table must then hold ``_amt`` (parsed amount), ``currency``,
    ``seller_name`` and ``buyer_name``.
    """
    payload, filter_cols = tuple(payload), tuple(filter_cols)
    most = MAX_QUERY_BATCH if max_broadcast is None else max_broadcast
    needed = tuple(c for c in ("_amt", "currency", "seller_name", "buyer_name") if filter_cols and c in vectors.columns)
    spark = vectors.sparkSession
    queries = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvec_col).cast("array<double>").alias("embedding"), *filter_cols)
    if not _is_local(queries):
        queries = materialize_queries(queries)
    n_q, low, dim = queries.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n_q and low != dim:
        raise ValueError(f"query vectors of mixed dimension: {low} to {dim}")
    paid = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*payload).schema.fields)
    if n_q == 0:
        return spark.createDataFrame([], f"qid long, id long, distance double{paid}, rank int")
    emb = F.col(vec_col).cast("array<float>")
    wrong = F.raise_error(F.concat(F.lit(f"index vector is null or not of size {dim}: id "), F.col(id_col).cast("string")))

    def scan(*extra: str) -> DataFrame:
        return vectors.select(F.col(id_col).cast("long").alias("id"),
                              F.when(F.size(emb) == dim, emb).otherwise(wrong.cast("array<float>")).alias("embedding"), *extra)

    masks = _query_mask if filter_cols else None
    if n_q <= most and n_q * dim * 8 <= MAX_QUERY_BYTES:
        batch = queries.toArrow().combine_chunks().to_batches()[0]
        sent = spark.sparkContext.broadcast((batch.column(0).to_numpy(), knn.matrix(batch.column(1), n_q, dim),
                                             _query_filters(batch) if filter_cols else None))
        extra = payload + tuple(c for c in needed if c not in payload)
        found = knn.broadcast_search(scan(*extra), sent, k, dim, payload, masks,
                                     f"qid long, id long, order_key double, distance double{paid}")
        return knn.ranked(found, k)
    if payload or needed:               # counted, searched and joined with the hits: a view is worked out once
        keep = dict.fromkeys([*payload, *needed])
        vectors = written(spark, vectors.select(id_col, vec_col, *keep), "searched")
    best = knn.ranked(knn.block_search(scan(*needed), queries, k, dim, masks, _query_filters if filter_cols else None), k)
    if not payload:
        return best
    return best.join(vectors.select(F.col(id_col).cast("long").alias("id"), *payload), "id").select(
        "qid", "id", "distance", *payload, "rank")


def _is_local(df: DataFrame) -> bool:
    try:
        return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LocalRelation"
    except Exception:  # noqa: BLE001
        return False


def check_top_k(top_k: int) -> int:
    """Any positive number; the search form's own range is ``TOP_K_RANGE``."""
    if int(top_k) < 1:
        raise ValueError("top_k must be at least 1")
    return int(top_k)


FILTER_COLUMNS = ["min_amount", "max_amount", "currency", "exclude_currency",
                  "seller_name", "buyer_name"]


def semantic_search(index: DataFrame, records: DataFrame | None, queries: DataFrame, top_k: int = DEFAULT_TOP_K,
                    prefilter: bool = False, id_col: str = "id", qid_col: str = "qid",
                    amount_col: str = "total_amount", max_broadcast: int | None = None) -> DataFrame:
    """Search many queries at once: candidates -> validity -> filters -> top_k.

    ``index``: ``(id, embedding)``; ``records``: the record payload by id, or
    ``None`` when the index carries the payload itself (``build_vectors(...,
    payload=True)``): then the candidates bring their payload out of the one
    k-NN scan and no record table is read at all.
    ``queries``: ``(qid, embedding)`` plus optional filter columns
    (``min_amount, max_amount, currency, exclude_currency, seller_name,
    buyer_name``; null = not set).

    Default (post-filter): ``CANDIDATE_FACTOR x top_k`` nearest candidates are
    ranked first and filtered after, so a query may get fewer than ``top_k``
    hits; ``rank`` keeps the candidate position (gaps after filtering) and
    ``position`` numbers the hits 1..n. ``prefilter=True`` filters first, so
    every query gets ``top_k`` hits when that many match.
    """
    top_k = check_top_k(top_k)
    fcols = [c for c in FILTER_COLUMNS if c in queries.columns]
    queries = materialize_queries(queries.select(qid_col, "embedding", *fcols))
    qf = queries.select(F.col(qid_col).alias("qid"), *[F.col(c).alias(f"f_{c}") for c in fcols])
    source = index if records is None else records
    numeric_amount = isinstance(source.schema[amount_col].dataType, T.NumericType)

    def predicate():
        return search_filter(
            F.col(amount_col), F.col("currency"), F.col("seller_name"), F.col("buyer_name"),
            amount_parsed=numeric_amount, **{c: F.col(f"f_{c}") for c in fcols})

    if prefilter:
        # filter first, per query, inside the one k-NN scan: every query gets
        # top_k hits whenever that many records pass its filters
        if records is None:
            src = index
        else:
            rec = records.select(F.col(id_col).alias("id"), *[c for c in records.columns if c != id_col])
            src = index.select(F.col(id_col).alias("id"), "embedding").join(rec, "id")
        payload = [c for c in src.columns if c not in (id_col, "id", "embedding")]
        amt = F.col(amount_col).cast("double") if numeric_amount else parse_amount(F.col(amount_col))
        ok = src.filter(is_valid_record(src)).withColumn("_amt", amt)
        hits = knn_candidates(ok, queries, top_k, id_col="id" if records is not None else id_col,
                              qid_col=qid_col, payload=payload, filter_cols=fcols, max_broadcast=max_broadcast)
    elif records is None:
        payload = [c for c in index.columns if c not in (id_col, "embedding")]
        cand = knn_candidates(index, queries, CANDIDATE_FACTOR * top_k, id_col=id_col,
                              qid_col=qid_col, payload=payload, max_broadcast=max_broadcast)
        hits = (cand.filter(is_valid_record(cand)).join(qf, "qid").filter(predicate()))
    else:
        rec = records.select(F.col(id_col).alias("id"), *[c for c in records.columns if c != id_col])
        rec = rec.filter(is_valid_record(rec))
        own = ["matched_text"] if "matched_text" in index.columns and "matched_text" not in rec.columns else []
        cand = knn_candidates(index, queries, CANDIDATE_FACTOR * top_k, id_col=id_col, qid_col=qid_col, payload=own,
                              max_broadcast=max_broadcast)
        # both sides grow with the request batch: the planner broadcasts them only below its threshold
        hits = (rec.join(cand, "id")
                   .join(qf, "qid")
                   .filter(predicate()))
    w = Window.partitionBy("qid").orderBy("rank")
    out = hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top_k)
    return out.withColumn("score", similarity("distance"))


# Record columns a denormalised index carries for filtering and display.
PAYLOAD_COLUMNS = ["invoice_number", "invoice_date", "seller_name", "buyer_name", "total_amount",
                   "currency", "file_name"]


def build_vectors(records: DataFrame, embedder=None, dim: int = DEFAULT_DIM,
                  id_col: str = "id", payload: bool = False) -> DataFrame:
    """Vector table of the valid records: ``(id, matched_text, embedding)``.

    ``payload=True`` also keeps the record columns the search filters and
    shows (``PAYLOAD_COLUMNS``), like an index that stores its metadata: a
    search over it reads one table in one pass.
    """
    valid = records.filter(is_valid_record(records))
    extra = [c for c in PAYLOAD_COLUMNS if c in records.columns] if payload else []
    txt = valid.select(F.col(id_col).alias("id"), document_text().alias("matched_text"), *extra)
    return embed(txt, "matched_text", embedder=embedder, dim=dim)


def skipped_counts(records: DataFrame) -> DataFrame:
    """How many records indexing would take and skip (fail the validity rule)."""
    v = is_valid_record(records)
    return records.agg(F.count(F.lit(1)).alias("n_input"), F.count_if(v).alias("n_valid"),
                       F.count_if(~v).alias("n_skipped"))


def add_documents(existing: DataFrame, new_vectors: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Append vectors; a re-added id replaces its older vector (latest seq wins).

    Both sides are written first, so a vector that is still to be computed is computed once.
    """
    both = existing.unionByName(new_vectors, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("id", seq_col)]
    both = written(both.sparkSession, both.withColumn("_print", fingerprint(both, [*cols, seq_col])), "vectors")
    return latest(both, ["id"], seq_col, print_col="_print").select("id", *cols, seq_col)


def read_vectors(spark, path: str) -> DataFrame:
    """The saved vector table. A missing one is empty; one that can't be read raises."""
    from ledgerlens.schema import VECTOR_SCHEMA
    from ledgerlens.sources.store import path_exists

    if not path_exists(spark, path):
        return spark.createDataFrame([], VECTOR_SCHEMA)
    return spark.read.parquet(path)


def vector_stats(vectors: DataFrame, model_name: str = DEFAULT_MODEL) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"),
                       F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
                       F.lit(model_name).alias("model_name"))
