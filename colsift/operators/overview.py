"""The one-row overview of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import pct
from ..functions.stage import local_table
from .checks import STRINGS
from .duplicates import duplicates
from .profile import TableProfile

GROUPS = ("numeric", "categorical", "datetime", "boolean", "other")


def dimensions(p: TableProfile) -> DataFrame:
    """Dimensions, missing cells and columns by group, from the first counts alone."""
    schema = T.StructType(
        [T.StructField("dataset", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("row_count", "column_count", "missing_cells")]
        + [T.StructField(f"{g}_columns", STRINGS) for g in GROUPS])
    facts = dict(dataset=p.dataset, row_count=p.rows, column_count=len(p.columns),
                 missing_cells=sum(p.rows - p.non_null(c) for c in p.columns),
                 **{f"{g}_columns": [c.name for c in p.of_group(g)] for g in GROUPS})
    return (local_table(p.spark, [facts], schema)
            .withColumn("total_cells", F.col("row_count") * F.col("column_count"))
            .withColumn("missing_percentage", pct("missing_cells", "total_cells"))
            .withColumns({f"{g}_column_count": F.size(f"{g}_columns") for g in GROUPS}))


def dataset_overview(p: TableProfile, duplicate_row: DataFrame | None = None) -> DataFrame:
    """Dimensions, missing cells, duplicate rows and columns by group."""
    if duplicate_row is None:
        duplicate_row = duplicates(p, examples=False)
    copies = duplicate_row.select("dataset", "duplicate_rows", "duplicate_percentage")
    return (dimensions(p).join(F.broadcast(copies), "dataset")
            .select("dataset", "row_count", "column_count", "total_cells", "missing_cells", "missing_percentage",
                    "duplicate_rows", "duplicate_percentage",
                    *[f"{g}_column_count" for g in GROUPS], *[f"{g}_columns" for g in GROUPS]))
