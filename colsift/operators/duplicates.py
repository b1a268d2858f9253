"""Exact duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.measures import four_bands, pct
from ..functions.stage import local_table, small, stage
from .checks import STRINGS
from .profile import ORD, TableProfile

ADVICE = {
    True: "Look at the listed order keys, then keep one row of each group where no event can occur twice.",
    False: "No two rows are equal in all columns.",
}


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return False


def _hashable(rows: DataFrame) -> bool:
    return not any(_has_map(f.dataType) for f in rows.schema.fields)


def _plain(c) -> Column:
    """A column in a form that rows can be grouped and hashed by."""
    col = F.col(c.ref)
    if isinstance(c.kind, T.VariantType):
        return F.to_json(col)
    if isinstance(c.kind, T.MapType) and not _has_map(c.kind.keyType) and not _has_map(c.kind.valueType):
        return F.array_sort(F.map_entries(col))
    return col


def _rows(p: TableProfile) -> DataFrame:
    cols = [_plain(c).alias(c.ref) for c in p.columns]
    return p.frame.select(*cols, *([ORD] if p.ordered else []))


def repeated_rows(p: TableProfile, hash_first: bool | None = None, first: bool = False) -> DataFrame:
    """Groups of equal rows that hold two rows or more, with their size ``n``.

    Rows are first grouped by a 64-bit hash, so that only those which may repeat
    are moved with all their columns. Where a text column is nearly unique, the
    hashes of its repeated values, which are counted already, tell as much
    without that pass. Missing equals missing. ``first`` adds the least order key of the group and its ``last``.
    """
    refs = [c.ref for c in p.columns]
    rows = _rows(p)
    if hash_first is None:
        hash_first = True
    if hash_first and _hashable(rows):
        text = p.telling_text()
        row_hash = F.xxhash64(X.token(F.col(text.ref))) if text else F.xxhash64(*refs)
        if text:
            hashes = p.values.filter((F.col("column") == text.ref) & (F.col("n") > 1)).select(F.xxhash64("token").alias("_h"))
        else:
            hashes = rows.select(row_hash.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h")
        hashes = stage(hashes)
        rows = rows.withColumn("_h", row_hash).join(small(hashes, hashes.count(), 16), "_h", "left_semi").drop("_h")
    ends = [F.min(ORD).alias("first"), F.max(ORD).alias("last")] if first else []
    return rows.groupBy(*refs).agg(F.count(F.lit(1)).alias("n"), *ends).filter("n > 1")


def _upto(groups: DataFrame, count: int, limit: int) -> Column | None:
    """Which rows can be among the first ``limit`` extra copies, by their order key; None where that cannot be told.

    Every group has an extra copy no later than its last key, so ``limit`` groups that end by some key hold that many by then.
    """
    kind = groups.schema["last"].dataType
    plain = isinstance(kind, (T.IntegralType, T.DateType)) or (isinstance(kind, T.StringType) and kind.collation == "UTF8_BINARY")
    if not plain or count < limit:
        return None
    end = groups.select("last").orderBy("last").limit(limit).agg(F.max("last").alias("end")).first()["end"]  # null keys come first
    return F.col(ORD).isNull() if end is None else F.col(ORD).isNull() | (F.col(ORD) <= F.lit(end).cast(kind))


def _examples(p: TableProfile, groups: DataFrame, count: int) -> list[str]:
    """Order keys of the first extra copies.

    Rows move as a 128-bit digest with their order key, counted per key first,
    so neither wide rows nor a hot group reach one task. In a group every copy
    but one at the least key is extra. Only rows up to the key by which there
    are enough extra copies are looked at.
    """
    limit = p.config.duplicate_examples
    refs = [c.ref for c in p.columns]
    rows, upto = _rows(p), _upto(groups, count, limit)
    if upto is not None:
        rows = rows.filter(upto)
    digest = [F.xxhash64(*refs).alias("_h"), F.xxhash64(F.lit(1), *refs).alias("_g")]
    firsts = groups.select(*digest, "first")
    if not isinstance(groups.schema["first"].dataType, (T.StringType, T.BinaryType, T.StructType)):
        firsts = small(firsts, count, 40)
    copies = (rows.select(*digest, ORD).join(firsts, ["_h", "_g"])
              .groupBy("_h", "_g", ORD, "first").agg(F.count(F.lit(1)).alias("copies")))
    extra = F.col("copies") - F.when(F.col(ORD).eqNullSafe(F.col("first")), 1).otherwise(0)
    top = (copies.select(ORD, extra.alias("extra")).filter("extra > 0").orderBy(ORD).limit(limit)
           .select(F.col(ORD).cast("string").alias("id"), F.least("extra", F.lit(limit)).cast("int").alias("extra")))
    ids = [r["id"] for r in top.collect() for _ in range(r["extra"])]  # at most ``limit`` rows
    return ids[:limit]


def duplicates(p: TableProfile, *, examples: bool = True, hash_first: bool | None = None) -> DataFrame:
    """One row with the counts of exact duplicate rows."""
    examples = examples and p.ordered and p.config.duplicate_examples > 0 and _hashable(_rows(p))
    groups = repeated_rows(p, hash_first, first=examples)
    if examples:
        groups = stage(groups)
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    grouped, count = row["n"] or 0, row["g"]
    ids = _examples(p, groups, count) if examples and count else []
    schema = T.StructType([
        T.StructField("dataset", T.StringType()), T.StructField("row_count", T.LongType()),
        T.StructField("duplicate_rows", T.LongType()), T.StructField("rows_in_duplicate_groups", T.LongType()),
        T.StructField("duplicate_group_count", T.LongType()), T.StructField("example_duplicate_indices", STRINGS)])
    facts = local_table(p.spark, [dict(
        dataset=p.dataset, row_count=p.rows, duplicate_rows=grouped - count, rows_in_duplicate_groups=grouped,
        duplicate_group_count=count, example_duplicate_indices=ids)], schema)
    hit: Column = F.col("duplicate_rows") > 0
    return (facts.withColumn("duplicate_percentage", pct("duplicate_rows", "row_count"))
            .select("dataset", "duplicate_rows", "duplicate_percentage", "rows_in_duplicate_groups",
                    "duplicate_group_count",
                    four_bands(F.col("duplicate_rows"), F.col("duplicate_percentage"),
                               p.config.duplicate_bands).alias("severity"),
                    F.when(hit, "ISSUE").otherwise("PASS").alias("status"), "example_duplicate_indices",
                    F.when(hit, ADVICE[True]).otherwise(ADVICE[False]).alias("recommendation")))
