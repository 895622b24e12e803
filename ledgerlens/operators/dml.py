"""Changes to the record table: keyed upsert, deletes, append, id assignment.

Parquet has no row-level MERGE or DELETE, so every change is a plan
``old -> new`` that the store writes as a new version (see
``ledgerlens.sources.store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The natural key of a record.
UPSERT_KEY = ["invoice_number", "file_name"]


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """62 bits of a hash over the columns (maps by their sorted entries)."""
    parts = [F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in columns]
    return F.shiftrightunsigned(F.xxhash64(F.lit(0), *parts), 2)


def latest(rows: DataFrame, by: list[str], seq_col: str, first: str | None = None, print_col: str | None = None) -> DataFrame:
    """The row with the highest ``seq_col`` of each group, in two phases; ``first`` columns take their minimum.

    First narrow: a hash aggregate over (group, order) alone, combined partially on each partition, so a hot
    group reaches the shuffle as one row per partition. Then one join brings the winners' other columns. Rows of the same
    order differ in a fingerprint of their columns, so one of them wins however often it is computed; equal rows
    are one. Null groups are groups, a null order is the lowest.

    Both phases read ``rows``. Where these are dear, write them first with their ``fingerprint`` as a column and name it as ``print_col``: the first phase
    then reads group, order and fingerprint alone.
    """
    others = [c for c in rows.columns if c not in (*by, first, print_col)]
    mark = F.col(print_col) if print_col else fingerprint(rows, others)
    order = (F.coalesce(F.col(seq_col).cast("decimal(19,0)"), F.lit(-(2 ** 63)).cast("decimal(19,0)")) * F.lit(2 ** 62).cast("decimal(19,0)")
             + mark.cast("decimal(19,0)")).cast("decimal(38,0)")
    tagged = rows.withColumn("_order", order)
    best = tagged.groupBy(*by).agg(F.max("_order").alias("_order"), *([F.min(first).alias(first)] if first else []))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*by, "_order")]
    won = tagged.alias("r").join(best.alias("w"), same)
    won = won.select(*([F.col(f"w.{first}")] if first else []), *[F.col(f"r.{c}") for c in (*by, *others)])
    return won.groupBy(*won.columns).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def upsert(rows: DataFrame, key: list[str] = UPSERT_KEY, id_col: str = "id",
           seq_col: str = "seq", print_col: str | None = None) -> DataFrame:
    """Collapse writes that share a key into one record.

    The first write's id is kept; every other column takes the last write
    (highest ``seq``, a whole number). A null in any key part never matches, so such a row
    stays on its own, keyed by its id. See ``latest`` for the plan.
    """
    if id_col in key:        # keyed by id itself (e.g. the vector table)
        return latest(rows, key, seq_col, print_col=print_col)
    any_null = F.lit(False)
    for k in key:
        any_null = any_null | F.col(k).isNull()
    others = [c for c in rows.columns if c not in (*key, id_col, print_col)]
    solo = rows.withColumn("_solo", F.when(any_null, F.col(id_col)))
    return latest(solo, [*key, "_solo"], seq_col, first=id_col, print_col=print_col).select(id_col, *key, *others)


def upsert_into(existing: DataFrame, batch: DataFrame, key: list[str] = UPSERT_KEY,
                id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """Upsert a batch (with ids already assigned) into an existing table."""
    both = existing.unionByName(batch, allowMissingColumns=True)
    return upsert(both, key, id_col, seq_col)


def assign_ids(df: DataFrame, start: int = 1, id_col: str = "id") -> DataFrame:
    """Dense ids ``start, start+1, ...`` without moving rows to one task.

    Each row's position inside its partition comes from
    ``monotonically_increasing_id``; a tiny per-partition count table (one
    row per partition) gives each partition its offset. ``start`` is a
    number, e.g. ``next_id(existing)``.
    The input must be deterministic (a table scan), since it is read twice.
    """
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    offsets = offsets.withColumn("_start", F.lit(int(start)))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, (F.col("_start") + F.col("_off") + local).cast("long")).drop(
        "_pid", "_mid", "_off", "_start")


def next_id(df: DataFrame, id_col: str = "id") -> int:
    """``max(id) + 1`` of a table (1 when empty): one scalar to the driver."""
    m = df.agg(F.max(id_col)).first()[0]
    return 1 if m is None else int(m) + 1


def delete_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove the rows whose id is listed (anti join)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_anti")


def deleted_count(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """How many listed ids matched a row (``deleted`` is count > 0 per id)."""
    listed = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    hit = listed.join(df.select(id_col), id_col, "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("n_deleted"))


def delete_all(df: DataFrame, confirm: str | None = None, phrase: str = "DELETE ALL") -> DataFrame:
    """An empty table of the same schema; the confirmation text must match."""
    if confirm != phrase:
        raise ValueError(f"delete_all needs confirm={phrase!r}")
    return df.sparkSession.createDataFrame([], df.schema)


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """List-extend semantics: rows of ``more`` after ``df``; missing columns null."""
    return df.unionByName(more, allowMissingColumns=True)


def empty_like(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
