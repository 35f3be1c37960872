"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a fixed shuffled order.  A document's virtual
finish time is the running token total of its source divided by the source's
target, so every source finishes its target at time 1.  Ordering all documents
by virtual finish time and truncating at the total budget takes from each
source in proportion to its target at every prefix of the order.  A source
whose target exceeds its size queues again, ``max_epochs`` times at most; the
running total simply goes on.

Running totals are prefix sums in two steps, sums per bucket and then windows
inside a bucket, for a source's queue as for the global order: no source and no
order passes through one task, however large.

Contract for unusual input: a null text has size 0 and a null source is a source
of its own, after all others; documents of size 0 are taken 0 times; a source
without words has target 0; an empty table gives an empty result; repeated rows
queue as separate documents; columns other than id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import WORD, fresh, stored, text_or_empty

#: Weights given to the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source may be repeated.
MAX_EPOCHS = 3
#: Buckets of a source's queue (hash of the id) and of the global order.
QUEUE_BUCKETS = 1 << 12
ORDER_BUCKETS = 1 << 14


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, size) rows.

    Targets share the total of all sizes by weight; a target stops at
    ``max_epochs`` times its source's size and the excess goes to the others by
    weight until none is above (water filling).  Sources fill up in the order of
    limit / weight, so the water level is the first at which the next source
    stays below its limit.  The table has one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = total.withColumn("source_rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
    filled = ranked.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "source_rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = filled.withColumn("level", level)
    open_level = F.min(F.when(F.col("limit") > F.col("weight") * F.col("level"), F.struct(F.col("limit") / F.col("weight"), "source_rank", "level")))
    water = open_level.over(everything)["level"]
    target = F.when(water.isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * water))
    return levels.select("source", "source_rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
    carry: str | None = None,
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, and
    ``taken``, the words the mix takes of it (its size times the number of
    times it is within the budget); also the column ``carry`` of ``docs``."""
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    carried = [F.col(f"`{carry}`").alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), order.alias("pos"), *carried)
    bucket = F.shiftright(F.conv(F.substring("pos", 1, 4), 16, 10).cast("int"), 16 - QUEUE_BUCKETS.bit_length() + 1)
    # one pass over the texts; what follows reads ids and counts only
    rows = stored(rows.withColumn("bucket", bucket), "mix-sizes")

    targets = stored(source_targets(rows.select("source", "size"), weights, max_epochs), "mix-targets")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(targets, sums["source"].eqNullSafe(targets["source"]))
        .select(targets["source_rank"], sums["source"].alias("_source"), F.col("bucket").alias("_bucket"), "bucket_start", "source_size", "target")
    )
    queue = Window.partitionBy("source", "bucket").orderBy("pos", F.asc_nulls_last("id"), "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    queued = (
        rows.withColumn("in_bucket", F.sum("size").over(queue))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
        .withColumn("finish", F.col("bucket_start") + F.col("in_bucket"))
        .drop("_source", "_bucket", "bucket", "in_bucket", "bucket_start")
    )
    queued = stored(queued, "mix-queued")

    # an item is one turn of a document; its place is its virtual finish time, ties broken by what follows
    def place(turn) -> Column:
        time = (F.col("finish") + turn * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
        return F.struct(time.alias("time"), F.col("source_rank"), turn.cast("int").alias("turn"), F.col("pos"), F.col("id"), F.col("size"))

    def slot(at: Column) -> Column:
        return F.least(F.floor(at["time"] * (ORDER_BUCKETS // 2)), F.lit(ORDER_BUCKETS - 1)).cast("int")

    served = queued.where("size > 0")
    items = served.select("size", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("turn"), "finish", "source_size", "target", "source_rank", "pos", "id")
    items = items.select("size", place(F.col("turn")).alias("place")).withColumn("slot", slot(F.col("place")))
    slots = items.groupBy("slot").agg(F.sum("size").alias("slot_size"))  # ORDER_BUCKETS rows at most
    upto = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    budget = targets.agg(F.sum("source_size").alias("budget"))
    cut_slot = (
        slots.withColumn("slot_end", F.sum("slot_size").over(upto))
        .join(F.broadcast(budget))  # one row
        .where("slot_end > budget")
        .agg(F.min(F.struct("slot", (F.col("slot_end") - F.col("slot_size")).alias("before"), "budget")).alias("cut"))
        .select(F.col("cut.slot").alias("cut_slot"), F.col("cut.before").alias("before"), F.col("cut.budget").alias("budget"))
    )
    line = Window.partitionBy("slot").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        items.join(F.broadcast(cut_slot), F.col("slot") == F.col("cut_slot"))  # one row
        .withColumn("total", F.col("before") + F.sum("size").over(line))
        .where("total <= budget")
        .agg(F.max("place").alias("last_place"))
    )
    cut = stored(cut_slot.join(F.broadcast(last)), "mix-cut")  # one row: where the budget ends
    taken = sum(
        F.when(
            F.col("cut_slot").isNull()
            | (slot(place(F.lit(turn))) < F.col("cut_slot"))
            | ((slot(place(F.lit(turn))) == F.col("cut_slot")) & F.coalesce(place(F.lit(turn)) <= F.col("last_place"), F.lit(False))),
            F.col("size"),
        ).otherwise(F.lit(0))
        for turn in range(max_epochs)
    )
    return queued.join(F.broadcast(cut)).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.cast("long").alias("taken"), *([F.col("carried").alias(carry)] if carry else [])
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **mix_options) -> DataFrame:
    """The documents of the mix with all their columns, one row per time a
    document is taken.  Rows are numbered first, so each comes back as often as
    the mix takes that row, whether or not others have its id, size or text."""
    number = fresh(docs, "row_number")
    keyed = stored(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(keyed, id_col, carry=number, **mix_options).where("taken > 0")
    times = taken.select(F.col(number).alias("_number"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    rows = keyed.alias("d").join(times.alias("t"), F.col(f"d.`{number}`") == F.col("t._number"))
    turn = F.explode(F.sequence(F.lit(1), F.col("t._times"))).alias("_turn")
    return rows.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), turn).select("row.*")
