"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsift.llm.staging import staged

WEIGHTS = (5, 2, 1)
# Share of all words to take, and how often a document may be taken.
BUDGET, REPEATS = 1.5, 2
WORD = "[^\\x20\\x09-\\x0D]+"
# Least number of parts that a source's shuffled order and the common queue are cut into for running sums, and most rows a part should have.
PARTS, PART_ROWS = 1024, 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target: weights by code point of the name, null last, repeating.

    Sources stop at ``repeats`` times their size and the excess is shared by weight among the rest: with sources in order of limit by
    weight, a source gets ``rate * weight`` at the rate left by those before it, once that is not above its limit. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    limit = F.col("source_size") * repeats
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (sizes.withColumns({"weight": share, "limit": limit}).withColumns({
        "used": F.coalesce(F.sum("limit").over(before), F.lit(0)), "taken_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "all_size": F.sum("source_size").over(Window.partitionBy()), "all_weight": F.sum("weight").over(Window.partitionBy())}))
    ranked = ranked.withColumn("rate", (F.col("all_size") * F.lit(float(budget)) - F.col("used")) / (F.col("all_weight") - F.col("taken_weight")))
    ranked = ranked.withColumn("place", F.row_number().over(full))
    open_at = F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("place"))
    rate = F.coalesce(F.min_by("rate", open_at).over(Window.partitionBy()), F.lit(float("inf")))
    return ranked.select("source", "source_size", F.least(F.col("limit").cast("double"), rate * F.col("weight")).alias("target"))


def _before(rows: DataFrame, group: list[str], order: list[Column], part: Column, name: str) -> DataFrame:
    """Sum of ``size`` up to and with each row, in ``order`` within ``group``: sums of parts first, then within each part."""
    cut = rows.withColumn("part", part)
    sums = cut.groupBy(*group, "part").agg(F.sum("size").alias("part_size"))
    up = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(c).alias(f"of_{c}") for c in [*group, "part"]), F.coalesce(F.sum("part_size").over(up), F.lit(0)).alias("offset"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*group, "part"]]
    placed = cut.join(offsets, on).drop(*(f"of_{c}" for c in [*group, "part"]))
    inside = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, F.col("offset") + F.sum("size").over(inside)).drop("part", "offset")


def _first(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """Of rows with the sum ``begin`` of all before them, those that come in ``order`` until ``total`` is reached.

    Many small sources end together, so these may be most of the queue: they are sorted into ranges, and a range begins where the sum of
    those before it ends.
    """
    ranged = staged(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "edge")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("range_size"))
    up = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("range_size").over(up), F.lit(0)).alias("offset"))  # a row a range
    upto = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(offsets), "range").withColumn("sum", F.col("begin") + F.col("offset") + F.sum("size").over(upto))
    return summed.where(F.col("sum") <= total).select("row", "size")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source; other columns are ignored): doc_id, size, source_size, target, taken.

    Each source queues all its documents in a shuffled order, ``repeats`` times over. A queued document's virtual finish time is the
    source's words up to and with it, divided by the source's target. The queues are merged by finish time, and the merged order is
    cut where it reaches the budget: so every source comes near its target and every beginning of the order is mixed as asked.
    The order hashes doc_id, so reruns agree. Rows that repeat a doc_id are queued one after the other. Null text has size 0;
    a source without words, and an empty table, take nothing. Running sums are made of parts: no source is one task.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumns({"key": key, "row": F.monotonically_increasing_id()})
    rows = staged(rows, "sizes")
    goals = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats), "targets")

    parts = max(PARTS, 1 << (rows.count() // PART_ROWS).bit_length())
    lane = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)
    part = F.floor(lane).cast("int")
    queued = _before(rows, ["source"], [F.col("key"), F.col("doc_id"), F.col("size"), F.col("row")], part, "reached")
    goal = goals.withColumnRenamed("source", "of_source")
    queued = queued.join(goal, F.col("source").eqNullSafe(F.col("of_source")))
    again = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("reached") + F.col("turn") * F.col("source_size")) / F.col("target")
    queue = staged(again.withColumn("finish", finish).where("size > 0").select("row", "key", "turn", "size", "finish"), "queue")

    # A finish time past 1 is past its source's target: such documents only compete for what rounding leaves of the budget.
    slot = F.least(F.floor(F.col("finish") * parts), F.lit(2 * parts))
    total = math.floor((goals.agg(F.sum("source_size")).first()[0] or 0) * budget)
    slots = queue.groupBy(slot.alias("slot")).agg(F.sum("size").alias("slot_size"))
    ends = slots.select("slot", F.sum("slot_size").over(Window.orderBy("slot")).alias("end"), "slot_size")
    ends = ends.select("slot", "end", (F.col("end") - F.col("slot_size")).alias("begin")).where(F.col("begin") < total)
    known = queue.withColumn("slot", slot).join(F.broadcast(ends), "slot")  # at most 2 * parts + 1 rows
    inside = known.where(F.col("end") <= total).select("row", "size")
    edge = _first(known.where(F.col("end") > total), ["finish", "key", "turn", "row"], total)
    taken = inside.unionByName(edge).groupBy("row").agg(F.sum("size").alias("taken"))
    out = rows.join(taken, "row", "left").join(goal, F.col("source").eqNullSafe(F.col("of_source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
