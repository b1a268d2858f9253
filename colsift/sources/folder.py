"""A folder of CSV files with different headers, delimiters and encodings, each a data set of its own.

Files are judged, cut into records, parsed and typed by the same few jobs, however many files there are: what differs between files goes
to the tasks as a few bytes a file, and what is found out about them comes from aggregates grouped by file.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AuditError, IntakeConfig
from ..functions import text as X
from ..functions.stage import stage, stage_columns
from ..operators.profile import check_names
from .csv import MISSING_TEXTS, manifest_of, number_value, type_counts
from .records import Formats, read_records
from .streams import listing

END = "\x01end"


def data_set(path: Column, root: str) -> Column:
    """The name of a file's data set: its path below the folder without the suffix; the file's name where the path is a file."""
    inside = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(inside, r"(?i)\.csv\z", "")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark writes the paths of files below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(p).toString().rstrip("/")


def parsed(records: DataFrame, formats: DataFrame, delimiters: list[str], width: int) -> DataFrame:
    """Adds ``cells`` (missing texts as null, as many as the header has) and ``overflow`` to records with their file's delimiter and width.

    A mark behind the last field tells how many there are; it is out of sight where there are more than any header has.
    """
    schema = ", ".join(f"c{i} STRING" for i in range(width + 1))
    rows = records.join(formats, "file")
    cells = None
    for d in delimiters:
        one = F.from_csv(F.concat("record", F.lit(d + END)), schema, {"sep": d, "quote": '"', "escape": '"', "multiLine": "true"})
        one = F.array(*[one[f"c{i}"] for i in range(width + 1)])
        cells = F.when(F.col("delimiter") == d, one) if cells is None else cells.when(F.col("delimiter") == d, one)
    rows = rows.withColumn("all", cells).withColumn("fields", F.array_position("all", END) - 1)
    # Behind the mark of a short row stands nothing.
    shown = F.transform(F.slice("all", F.lit(1), F.col("width")), lambda x, i: F.when((i < F.col("fields")) & ~x.isin(*MISSING_TEXTS), x))
    return rows.select("file", "rank", "n", shown.alias("cells"), ((F.col("fields") < 0) | (F.col("fields") > F.col("width"))).alias("overflow"))


@dataclass(frozen=True)
class FolderScan:
    """What a folder holds: ``files`` (a row a file, ``code`` for the first rule it breaks), ``columns`` (a row a column) and its staged cells."""

    files: DataFrame
    columns: DataFrame
    cells: DataFrame

    def names(self) -> list[str]:
        """The data sets that can be audited, by name."""
        return [r["dataset"] for r in self.files.where("code IS NULL").select("dataset").orderBy("dataset").collect()]

    def table(self, dataset: str) -> DataFrame:
        """One data set as a typed table with ``_ord``, the position of a row from 0."""
        known = self.columns.where(F.col("dataset") == dataset).select("file", "position", "name", "dtype").orderBy("position").collect()
        if not known:
            raise AuditError(f"no data set {dataset} that can be read", "no_such_data_set")
        check_names([r["name"] for r in known])
        rows = self.cells.where(F.col("file") == known[0]["file"])
        return rows.select(*[number_value(F.col("cells")[r["position"]], r["dtype"]).alias(r["name"]) for r in known], F.col("_ord"))


def scan_folder(spark: SparkSession, path: str, config: IntakeConfig = IntakeConfig()) -> FolderScan:
    """Read every CSV file below ``path`` as a data set of its own.

    A file that breaks a rule keeps its row in ``files`` with the code; the others are not affected. Types are inferred over all rows of a
    file. The number of jobs does not depend on the number of files.
    """
    root = qualified(spark, path)
    judged = manifest_of(spark, path, config).join(listing(spark, path).select("path", "file"), "path")
    manifest = stage(judged.withColumn("dataset", data_set(F.col("path"), root)))
    good = manifest.where("code IS NULL").select("file", "delimiter", "encoding", F.size("names").alias("width"))
    facts = good.toArrow().combine_chunks()  # some 10 bytes a file go to the tasks
    pairs = list(zip(facts["delimiter"].to_pylist(), facts["encoding"].to_pylist()))
    known = sorted(set(pairs))
    kinds = np.array([known.index(p) for p in pairs], np.int16)
    width = pc.max(facts["width"]).as_py() or 0
    records = read_records(spark, path, Formats(facts["file"].to_numpy(), kinds, known))
    rows = parsed(records, good.select("file", "delimiter", "width"), sorted({d for d, _ in known}) or [","], width)
    rows = stage_columns(rows)
    # Rows of a block are numbered without gaps: only one row a block is summed up.
    blocks = rows.groupBy("file", "rank").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = stage(blocks.select("file", "rank", before.alias("start")))
    cells = rows.join(starts, ["file", "rank"]).select("file", "cells", "overflow", (F.col("start") + F.col("n")).alias("_ord"))

    per_file = rows.groupBy("file").agg(F.count("*").alias("row_count"), F.count_if("overflow").alias("overflows"))
    each = rows.select("file", F.posexplode("cells").alias("position", "value"))
    typed = stage(each.groupBy("file", "position").agg(*type_counts("value")))
    kind = (F.when(F.col("value_n") == 0, "double").when(F.col("value_int") == F.col("value_n"), "long").when(F.col("value_num") == F.col("value_n"), "double")
            .when(F.col("value_bool") == F.col("value_n"), "boolean").otherwise("string"))
    header = manifest.where("code IS NULL").select("file", "dataset", F.posexplode("names").alias("position", "name"))
    columns = stage(header.join(typed, ["file", "position"]).select(
        "file", "dataset", "position", F.when(X.strip(F.col("name")) == "", F.concat(F.lit("Unnamed: "), F.col("position").cast("string"))).otherwise(F.col("name")).alias("name"),
        (X.strip(F.col("name")) == "").alias("blank"), kind.alias("dtype"), F.col("value_n").alias("non_null_count")))
    found = columns.groupBy("file").agg(F.max("non_null_count").alias("most"), F.count_if(F.col("non_null_count") == 0).alias("empty"), F.count_if("blank").alias("blanks"),
                                        F.count_if(F.lower(X.strip(F.col("name"))).startswith("unnamed:")).alias("unnamed"))
    files = manifest.join(per_file, "file", "left").join(found, "file", "left")
    too_many = F.lit(False) if config.max_rows is None else F.col("row_count") > config.max_rows
    code = (F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("overflows") > 0, "parser_error").when(too_many, "too_many_rows")
            .when(F.coalesce("row_count", F.lit(0)) == 0, "no_data_rows").when(F.col("most") == 0, "all_rows_empty"))
    notes = F.array_compact(F.array(
        F.when(F.col("blanks") > 0, "blank_header_names"), F.when(~F.col("encoding").startswith("utf-8"), "fallback_encoding"),
        F.when(F.col("unnamed") > 0, "unnamed_columns"), F.when(F.col("column_count") == 1, "single_column"), F.when(F.col("empty") > 0, "empty_columns")))
    files = stage(files.select("dataset", "path", "file_name", "file_size_bytes", "encoding", "delimiter", "fingerprint_sha256", notes.alias("warnings"),
                               F.coalesce("row_count", F.lit(0)).alias("row_count"), F.col("column_count").cast("long").alias("column_count"), code.alias("code"), "file"))
    right = files.where("code IS NULL").select("file")
    return FolderScan(files.drop("file"), columns.join(right, "file", "left_semi"), cells.drop("overflow"))
