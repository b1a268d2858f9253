"""Where results go: JSON reports, issue tables as CSV, and previews."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.report import ordered_maps
from ..plans.views import check_limit, issues_table


MAX_PREVIEW = 100


def finite_only(value, kind: T.DataType):
    """``value`` with every non-finite number in it replaced by null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[finite_only(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite_only(x, kind.elementType))
    return value


def report_json(report: DataFrame) -> DataFrame:
    """One strict JSON document per data set: numbers are finite, nulls are kept."""
    cols = [finite_only(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in report.schema.fields]
    return report.select("dataset", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))


def _line(df: DataFrame):
    """Each row of ``df`` but its data set as strict JSON."""
    cols = [finite_only(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name != "dataset"]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def report_lines(report: DataFrame, issues: DataFrame, checks: dict[str, DataFrame] | None = None) -> DataFrame:
    """dataset, section, place, later, line: the lines that make a data set's document when read in that order.

    The first holds all of the report but its lists; each issue and each result of a check is a line of its own; the rest are brackets.
    No row holds more than one issue.
    """
    sets = report.select("dataset")
    head = F.concat(F.lit('{"dataset":'), F.regexp_extract(F.to_json(F.array("dataset")), r"(?s)^\[(.*)\]$", 1), F.lit(","),
                    F.substring(_line(report), 2, 1 << 30))
    # the closing bracket of the first line makes way for the lists
    parts = [report.select("dataset", F.lit(0).alias("section"), F.lit("").alias("place"), F.lit(False).alias("later"), F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"issues":[')).alias("line"))]

    def listed(df: DataFrame, section: int, place) -> DataFrame:
        rows = df.select("dataset", F.lit(section).alias("section"), place.alias("place"), _line(df).alias("line"))
        first = rows.groupBy("dataset").agg(F.min(F.struct("place", "line")).alias("first"))
        later = F.struct("place", "line") != F.col("first")
        return rows.join(first, "dataset").select("dataset", "section", "place", later.alias("later"), F.concat(F.when(later, ",").otherwise(""), "line").alias("line"))

    def fixed(section: int, text: str) -> DataFrame:
        return sets.select("dataset", F.lit(section).alias("section"), F.lit("").alias("place"), F.lit(False).alias("later"), F.lit(text).alias("line"))

    parts.append(listed(issues, 1, F.lpad(F.col("priority_rank").cast("string"), 12, "0")))
    last = 2
    for i, (name, df) in enumerate((checks or {}).items()):
        df = ordered_maps(df)
        parts.append(fixed(last, (',"' if i else '],"quality_check_results":{"') + name + '":['))
        parts.append(listed(df, last + 1, F.coalesce("column", F.lit("")) if "column" in df.columns else F.lit("")))
        parts.append(fixed(last + 2, "]"))
        last += 3
    parts.append(fixed(last, "}}" if checks else "]}"))
    return reduce(DataFrame.unionByName, parts)


def write_report_json(report: DataFrame, path: str, issues: DataFrame, checks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Write the document of each data set as ``path``/report/dataset=NAME/part-*.txt and return the manifest, also in ``path``/manifest.

    The files of a data set, one after the other by name, are one strict JSON document: lines are sorted into ranges, so neither a task nor
    a row holds a whole document. The manifest has dataset, file, lines, in that order.
    """
    if "issues" in report.columns:
        report = report.drop("issues", "quality_check_results")
    order = ["dataset", "section", "place", "later", "line"]
    lines = report_lines(report, issues, checks).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("dataset", "line").write.mode("error").partitionBy("dataset").text(f"{path}/report")
    read = report.sparkSession.read.schema("value string, dataset string").text(f"{path}/report")
    found = read.groupBy("dataset", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("lines"))
    found.coalesce(1).sortWithinPartitions("dataset", "file").write.mode("error").json(f"{path}/manifest")
    return report.sparkSession.read.schema("dataset string, file string, lines long").json(f"{path}/manifest")


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """dataset, file, at, line of a written report; its documents are these lines in that order."""
    rows = spark.read.schema("value string, dataset string").text(f"{path}/report")
    return rows.select("dataset", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def report_document(spark: SparkSession, path: str, dataset: str) -> Iterator[str]:
    """The lines of one document in order, fetched a task at a time."""
    rows = read_report_lines(spark, path).where(F.col("dataset") == dataset).orderBy("file", "at")
    return (r["line"] for r in rows.select("line").toLocalIterator())


def write_issues_csv(issues: DataFrame, path: str) -> None:
    """Write the display columns of an issue table as CSV with a header; ``dataset`` comes first."""
    (issues_table(issues).write.mode("error").option("header", True)
     .option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path))


def preview_rows(df: DataFrame, order_by, limit: int = 25) -> DataFrame:
    """The first rows of a table."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(f"`{k}`") for k in keys]).limit(check_limit(limit, MAX_PREVIEW))
