"""Value frequencies as an operator of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import TableProfile


def value_frequencies(df: DataFrame, columns: list[str] | None = None, *, dataset: str = "table") -> DataFrame:
    """Rows per value of every text column (or of ``columns``), whole values as text."""
    p = TableProfile(df, dataset)
    chosen = [c for c in p.columns if (c.name in columns if columns is not None else c.group == "categorical")]
    refs = [c.ref for c in chosen]
    names = F.create_map(*[F.lit(x) for c in chosen for x in (c.ref, c.name)])
    cells = p.frame.select(*[F.col(r).cast("string").alias(r) for r in refs])
    return (cells.unpivot([], refs, "ref", "value").filter(F.col("value").isNotNull())
            .groupBy("ref", "value").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(dataset).alias("dataset"), names[F.col("ref")].alias("column"), "value", "n"))
