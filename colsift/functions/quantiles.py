"""Exact quantiles of many columns without holding a column in one task.

Values are counted in bins whose order is that of the values: first by sign
and a 64th of an octave, then in equal steps between the ends of the bin that
holds the wanted rank. Only counts per bin move, summed before they are
shuffled; a bin with equal ends is the answer. A double has no more than 46
bits below a 64th of an octave, so a few passes decide any rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import local_table

OCTAVE_BINS = 64
STEPS = 4096
# Fixed value: above the binary exponent of every double's inverse, so that keys of magnitudes are positive.
LEAST_EXPONENT = 1076


def _between(a: float, b: float, share: float) -> float:
    """Linear interpolation, measured from the nearer end."""
    gap = b - a
    return a + gap * share if share < 0.5 else b - gap * (1 - share)


def quantiles(frame: DataFrame, values: dict[str, Column], counts: dict[str, int], probs=(0.25, 0.75)) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of finite double columns; ``counts`` holds the number of non-null values of each."""
    places = {name: [p * (counts[name] - 1) for p in probs] for name in values}
    found = ranked(frame, values, {name: {r for x in at for r in (math.floor(x), math.ceil(x))} for name, at in places.items()})
    return {name: [_between(found[name, math.floor(x)], found[name, math.ceil(x)], x - math.floor(x)) for x in at]
            for name, at in places.items()}


def ranked(frame: DataFrame, values: dict[str, Column], ranks: dict[str, Iterable[int]]) -> dict[tuple[str, int], float]:
    """The finite value at each 0-based rank among the non-null values of a column, by column and rank."""
    found: dict[tuple[str, int], float] = {}
    # (column, rank) to its bracket's ends, both included, and the number of values below it
    pending = {(name, rank): (None, None, 0) for name, some in ranks.items() for rank in some}
    while pending:
        pending = _narrowed(frame, values, pending)
        found |= {key: low for key, (low, high, _) in pending.items() if low == high}
        pending = {key: bracket for key, bracket in pending.items() if key not in found}
    return found


def rank_error(size: int) -> float:
    """How far, as a share of all values, the rank of a sketched quantile may be off: twice the 99 % bound of KLL sketches, five standard deviations."""
    return 2 * 2.296 / size ** 0.9021


def sketched(frame: DataFrame, values: dict[str, Column], size: int, probs=(0.25, 0.75)) -> dict[str, list[float]]:
    """Quantiles of finite double columns within ``rank_error(size)``, in one pass: mergeable KLL sketches, a few KB a column and task."""
    asked = F.array(*[F.lit(p) for p in probs])
    row = frame.agg(*[F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(v.cast("double"), size), asked).alias(name) for name, v in values.items()]).first()
    return {name: list(row[name]) for name in values}


def _narrowed(frame: DataFrame, values: dict[str, Column], pending: dict) -> dict:
    """Each rank with the bin of its bracket that holds it as the new bracket."""
    targets: dict[tuple, str] = {}
    cells, facts, places = [], [], []
    for (name, rank), (low, high, before) in pending.items():
        key = (name, low, high)
        if key not in targets:
            targets[key] = f"r{len(targets)}"
            v = values[name].cast("double")
            cells.append((v if low is None else F.when(v.between(F.lit(low), F.lit(high)), v)).alias(targets[key]))
            facts.append({"target": targets[key], "start": low, "width": None if low is None else high - low})
        places.append({"target": targets[key], "name": name, "rank": rank, "before": before})

    spark = frame.sparkSession
    text, number, whole = T.StringType(), T.DoubleType(), T.LongType()
    cut = local_table(spark, facts, T.StructType([
        T.StructField("target", text), T.StructField("start", number), T.StructField("width", number)]))
    wanted = local_table(spark, places, T.StructType([
        T.StructField("target", text), T.StructField("name", text), T.StructField("rank", whole), T.StructField("before", whole)]))
    octave = F.coalesce(F.signum("value") * (F.log2(F.abs("value")) + LEAST_EXPONENT), F.lit(0.0)) * OCTAVE_BINS
    step = (F.col("value") - F.col("start")) / F.col("width") * STEPS
    counted = (frame.select(*cells).unpivot([], list(targets.values()), "target", "value").filter(F.col("value").isNotNull())
               .join(F.broadcast(cut), "target")
               .groupBy("target", F.floor(F.when(F.col("start").isNull(), octave).otherwise(step)).alias("bin"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")))
    upto = F.sum("n").over(W.partitionBy("target").orderBy("bin"))  # at most 2 * 2100 * OCTAVE_BINS rows a target
    place = F.col("rank") - F.col("before")
    hits = (counted.withColumn("upto", upto).join(F.broadcast(wanted), "target")
            .filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
            .select("name", "rank", "low", "high", (F.col("before") + F.col("upto") - F.col("n")).alias("below")))
    return {(h["name"], h["rank"]): (h["low"], h["high"], h["below"]) for h in hits.collect()}  # one row per rank
