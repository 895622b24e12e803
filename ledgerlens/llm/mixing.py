"""Mixing sources to target weights by weighted fair queueing.

Sources, by code point (null last), weigh 5, 2, 1 and so on in turn and share
the budget: the words of all documents. No target exceeds three times its source's
size; what is above is shared again by weight until none is above.

Every source queues its documents in a hashed order, up to three rounds. A
copy's virtual finish time is the source's words up to its end divided by the
source's target. All copies are sorted by finish time and taken while their words fit the budget.

Running sums need no task that holds a source: documents are dealt by the
hash into 4096 slices of each source, summed per slice before the shuffle; a
slice starts at the sum of those before it, and only the slice that the budget
ends in is sorted to find the last copy taken. That one row is all that comes to the driver.

Defined results: a null text has size 0, as a blank one; size-0 documents take 0.
A null source is a source of its own. Rows with equal doc_id, source and size
queue one behind the other, whatever their texts. An empty table gives no rows; a table without words takes none. Other
columns pass through ``mix``. The order depends on doc_id and seed alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import kept

# Weights in turn, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MAX_ROUNDS = 3
SEED = "mix-1"
SLICE_DIGITS = 3          # hex digits: 4096 slices of a source
TIME_SLICES = 16384       # slices of one unit of virtual time


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(source, source_size)`` -> with rank, weight and target (a row per source).

    With sources in the order of cap / weight, the first k of them reach
    their cap; the level of the others is (budget - caps of the k) / (their
    weights). The level that holds is the largest not above its own cap / weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", turn.cast("long"))
         .withColumn("cap", F.col("source_size") * rounds)
         .withColumn("per_weight", F.col("cap") / F.col("weight")))
    every = Window.partitionBy(F.lit(1))
    by_cap = Window.partitionBy(F.lit(1)).orderBy("per_weight", "rank")
    before = F.sum("cap").over(by_cap) - F.col("cap")
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before).cast("double") / rest
    s = s.withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("per_weight"), F.col("level"))).over(every)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "rank", "weight", "target")


def queued(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """A row per (source, doc_id, size): copies, and the source's words before it in the first round."""
    spark = docs.sparkSession
    units = kept(spark, docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"))
                 .groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
                 .withColumn("h", order_key("doc_id", seed))
                 .withColumn("slice", F.substring("h", 1, SLICE_DIGITS)), "units")
    words = F.col("size") * F.col("copies")
    slices = units.groupBy("source", "slice").agg(F.sum(words).alias("words"))
    start = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("start", F.coalesce(F.sum("words").over(start), F.lit(0))).drop("words")
    per_source = targets(units.groupBy("source").agg(F.sum(words).alias("source_size")), weights, rounds)
    inside = (Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    units = units.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return kept(spark, units.alias("u")
                .join(slices.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")) & (F.col("u.slice") == F.col("s.slice")))
                .join(per_source.alias("p"), F.col("u.source").eqNullSafe(F.col("p.source")))
                .select("u.source", "u.doc_id", "u.size", "u.copies", "u.h", "p.source_size", "p.rank", "p.target",
                        (F.col("s.start") + F.col("u.inside")).alias("before")), "queued")


ORDER = ["finish", "rank", "h", "id_known", "id", "size", "round", "copy"]


def copies_of(units: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """A row per copy and round, with its virtual finish time."""
    end = F.col("round") * F.col("source_size") + F.col("before") + (F.col("copy") + 1) * F.col("size")
    return (units.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("round", F.explode(F.array(*[F.lit(r).cast("long") for r in range(rounds)])))
            .withColumn("finish", F.when(F.col("target") > 0, end.cast("double") / F.col("target")).otherwise(F.lit(0.0)))
            .withColumn("id_known", F.col("doc_id").isNotNull().cast("int"))
            .withColumn("id", F.coalesce("doc_id", F.lit(0))))


def last_taken(units: DataFrame, rounds: int = MAX_ROUNDS) -> tuple | None:
    """Sort key of the last copy that fits the budget; None if none does."""
    every = copies_of(units, rounds).withColumn("time_slice", F.floor(F.col("finish") * TIME_SLICES).cast("long"))
    so_far = Window.partitionBy(F.lit(1)).orderBy("time_slice")
    sums = (every.groupBy("time_slice").agg(F.sum("size").alias("words"))
            .withColumn("until", F.sum("words").over(so_far)))
    budget = units.select("source", "source_size").distinct().agg(F.sum("source_size")).first()[0]
    if budget is None:
        return None
    # the slice in which the budget ends, or the last one
    cut = (sums.withColumn("over", F.col("until") > F.lit(budget))
           .orderBy(F.col("over").desc(), F.when(F.col("over"), F.col("time_slice")).otherwise(-F.col("time_slice"))).first())
    within = Window.partitionBy("time_slice").orderBy(*ORDER)
    row = (every.filter(F.col("time_slice") == cut.time_slice)
           .withColumn("until", F.sum("size").over(within) + F.lit(cut.until - cut.words))
           .filter(F.col("until") <= budget).orderBy(*[F.col(c).desc() for c in ORDER]).select(*ORDER).first())
    if row is None:       # the first copy of that slice is too large: all slices before it are taken
        row = every.filter(F.col("time_slice") < cut.time_slice).orderBy(*[F.col(c).desc() for c in ORDER]).select(*ORDER).first()
    return tuple(row) if row is not None else None


def taken_copies(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS,
                 rounds: int = MAX_ROUNDS) -> DataFrame:
    """Every copy and round with ``in_mix``: whether the mix takes it."""
    units = queued(docs, seed, weights, rounds)
    last = last_taken(units, rounds)
    items = copies_of(units, rounds)
    if last is None:
        return items.withColumn("in_mix", F.lit(False))
    types = {f.name: f.dataType for f in items.schema.fields}
    end = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(ORDER, last, strict=True)])
    return items.withColumn("in_mix", F.struct(*ORDER) <= end)


def mixed_sizes(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    return (taken_copies(docs, seed, weights)
            .groupBy("doc_id", "rank", "size", "copy")
            .agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                 F.sum(F.when(F.col("in_mix"), F.col("size")).otherwise(F.lit(0))).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix in its order: the columns of ``docs``, mix_round and mix_finish."""
    items = (taken_copies(docs, seed, weights).filter("in_mix and size > 0")
             .groupBy("source", "doc_id", "size", "copy")
             .agg(F.first("copies").alias("copies"), F.collect_list(F.struct("round", "finish")).alias("mix_rounds")))
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("mix_source"), F.col("doc_id").cast("long").alias("mix_id"),
                       word_count("text").alias("mix_size"))
    match = (F.col("u.source").eqNullSafe(F.col("r.mix_source")) & F.col("u.doc_id").eqNullSafe(F.col("r.mix_id"))
             & (F.col("u.size") == F.col("r.mix_size")))
    once = rows.alias("r").join(items.filter("copies = 1").alias("u"), match).select("r.row", "u.mix_rounds")
    # rows that repeat (source, doc_id, size): number them and give each its own place
    several = items.filter("copies > 1")
    out = once
    if not several.isEmpty():
        number = Window.partitionBy("mix_source", "mix_id", "mix_size").orderBy(F.xxhash64("row"))
        again = rows.alias("r").join(several.select("source", "doc_id", "size").distinct().alias("u"), match, "left_semi")
        again = again.withColumn("copy", F.row_number().over(number).cast("long") - 1)
        out = out.unionByName(again.alias("r").join(several.alias("u"), match & (F.col("u.copy") == F.col("r.copy")))
                              .select("r.row", "u.mix_rounds"))
    out = out.withColumn("at", F.explode("mix_rounds"))
    return (out.select("row.*", F.col("at.round").alias("mix_round"), F.col("at.finish").alias("mix_finish"))
            .orderBy("mix_finish", F.col("doc_id"), "mix_round"))
