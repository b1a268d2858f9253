"""Read-only views over an audit's tables. Each works for many data sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import COMPONENTS, AuditError, ScoreConfig
from ..functions import text as X
from ..functions.measures import SEVERITIES, severity_rank
from ..operators.overview import GROUPS
from .issues import with_issue_ids
from .report import COUNTS, DISCLAIMER
from .score import CHECKS

DEFAULT_LIMIT = 10
MAX_LIMIT = 25

# What a finding means for model preparation.
ML_CATEGORIES = {
    "missing_values": "MISSINGNESS",
    "duplicates": "ROW_INTEGRITY",
    "constant_columns": "FEATURE_VARIANCE",
    "near_constant_columns": "FEATURE_VARIANCE",
    "potential_identifiers": "IDENTIFIER_RISK",
    "high_cardinality_categories": "ENCODING_COMPLEXITY",
    "numeric_outliers": "DISTRIBUTION_RISK",
    "category_consistency": "CATEGORY_ENCODING",
    "data_type_warnings": "TYPE_CONVERSION",
}
# What the audit does not look at.
NOT_ASSESSED = ("target_column", "target_balance", "data_leakage", "train_validation_split", "model_performance",
                "fairness", "deployment_readiness")


def check_limit(limit: int, most: int = MAX_LIMIT) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise AuditError(f"the limit must be a whole number from 1 to {most}", "invalid_limit")
    return limit


def check_name(name: str | None) -> str | None:
    if name is None:
        return None
    plain = name.strip().casefold().replace("-", "_").replace(" ", "_")
    if plain not in CHECKS:
        raise AuditError(f"unknown check {name!r}", "unknown_check_name")
    return plain


def check_severity(name: str) -> str:
    plain = name.strip().upper()
    if plain not in SEVERITIES:
        raise AuditError(f"unknown severity {name!r}", "unknown_severity")
    return plain


def same_column(column: str | None) -> Column:
    """Column filter: the name without regard to case and outer blanks.

    Names that differ in no more than that cannot meet in one table.
    """
    if column is None:
        return F.lit(True)
    if not column.strip():
        raise AuditError("the column name is empty", "empty_column_name")
    return X.casefold(X.strip(F.col("column"))) == column.strip().casefold()


def audited_columns(overview: DataFrame) -> DataFrame:
    """Every audited column with its group."""
    kinds = F.array(*[F.struct(F.lit(g).alias("column_type"), F.col(f"{g}_columns").alias("names")) for g in GROUPS])
    return overview.select("dataset", F.inline(kinds)).select("dataset", "column_type", F.explode("names").alias("column"))


def require_column(overview: DataFrame, column: str) -> str:
    """The exact name of a column; an error when no audited table has it."""
    hit = audited_columns(overview).filter(same_column(column)).select("column").first()
    if hit is None:
        raise AuditError(f"no audited table has a column {column!r}", "unknown_column")
    return hit["column"]


def first_ranked(items: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` issues per data set by rank, with the number of all."""
    check_limit(limit)
    totals = items.groupBy("dataset").agg(F.count(F.lit(1)).alias("total_matching_count"))
    place = F.row_number().over(W.partitionBy("dataset").orderBy("priority_rank"))
    return (items.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")
            .join(totals, "dataset")
            .withColumn("returned_count", F.least("total_matching_count", F.lit(limit)))
            .withColumn("truncated", F.col("total_matching_count") > limit)
            .orderBy("dataset", "priority_rank"))


def overview_view(overview: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dimensions, column groups and basic rates, with the file's facts."""
    file = metadata.select("dataset", "file_name", "file_size_bytes", "encoding", "delimiter", "fingerprint_sha256",
                           "loader_warnings")
    return overview.select(
        "dataset", "row_count", "column_count", "total_cells", *[f"{g}_column_count" for g in GROUPS],
        *[f"{g}_columns" for g in GROUPS], "missing_cells", "missing_percentage", "duplicate_rows",
        "duplicate_percentage").join(file, "dataset")


def summary_view(summary: DataFrame, score: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Score, bands, gates, counts, components and weights."""
    parts = score.select("dataset", *COMPONENTS, *[f"{c}_contribution" for c in COMPONENTS])
    return (summary.drop("prioritized_recommendation_count").join(parts, "dataset")
            .select("*", *[F.lit(config.weights[c]).alias(f"{c}_weight") for c in COMPONENTS],
                    F.lit(DISCLAIMER).alias("disclaimer")))


def missing_view(issues: DataFrame, limit: int = DEFAULT_LIMIT, min_percentage: float = 0.0,
                 column: str | None = None) -> DataFrame:
    """Missing-value issues from a share upwards."""
    if isinstance(min_percentage, bool) or not 0 <= min_percentage <= 100:
        raise AuditError("the percentage must lie within 0..100", "invalid_percentage")
    items = issues.filter((F.col("check_name") == "missing_values") & same_column(column)
                          & (F.coalesce("percentage", F.lit(0.0)) >= min_percentage))
    return first_ranked(items, limit)


def duplicate_view(overview: DataFrame, issues: DataFrame) -> DataFrame:
    """Duplicate counts with the issue, if any."""
    found = issues.filter("check_name = 'duplicates'").select(
        "dataset", "issue_id", "priority_rank", "severity", "evidence", "recommendation")
    return (overview.select("dataset", (F.col("duplicate_rows") > 0).alias("has_exact_duplicates"), "duplicate_rows",
                            "duplicate_percentage").join(found, "dataset", "left"))


def column_summary(column: str, overview: DataFrame, issues: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Group, issue counts and score burden of one column; empty if no table has it."""
    known = audited_columns(overview).filter(same_column(column))
    counts = issues.filter(same_column(column)).groupBy("dataset").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES], F.count(F.lit(1)).alias("issue_count"))
    return (known.join(counts, "dataset", "left").na.fill(0, [*COUNTS, "issue_count"])
            .join(diagnostics, ["dataset", "column"], "left")
            .select("dataset", "column", "column_type", (F.col("issue_count") == 0).alias("is_clean"), "issue_count", *COUNTS,
                    "schema_penalty", "category_affected_percentage", "outlier_percentage"))


def column_view(column: str, issues: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The issues of one column by rank."""
    return first_ranked(issues.filter(same_column(column)), limit)


def column_recommendations(column: str, recommendations: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return first_ranked(recommendations.filter(same_column(column)), limit)


def priority_view(issues: DataFrame, limit: int = DEFAULT_LIMIT, min_severity: str = "LOW", check: str | None = None,
                  column: str | None = None) -> DataFrame:
    """Issues by rank from a severity upwards."""
    most = SEVERITIES.index(check_severity(min_severity))
    test = (severity_rank(F.col("severity")) <= most) & same_column(column)
    if check is not None:
        test = test & (F.col("check_name") == check_name(check))
    return first_ranked(issues.filter(test), limit)


def ml_category() -> Column:
    out = None
    for check, name in ML_CATEGORIES.items():
        test = F.col("check_name") == check
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def ml_view(issues: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Issues by rank with their meaning for model preparation."""
    return first_ranked(issues.withColumn("ml_category", ml_category()), limit)


def ml_summary(issues: DataFrame, summary: DataFrame) -> DataFrame:
    """Issue counts per category and data set, and what was not assessed."""
    counts = issues.groupBy("dataset", ml_category().alias("ml_category")).agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("high_or_critical_count"))
    return (counts.join(summary.select("dataset", "overall_score", "readiness_status"), "dataset")
            .select("*", F.lit("GENERIC_FEATURE_QUALITY_ONLY").alias("assessment_scope"),
                    *[F.lit(False).alias(f"{n}_assessed") for n in NOT_ASSESSED]))


# ---- tables for display ------------------------------------------------------


def issues_table(issues: DataFrame) -> DataFrame:
    return issues.select("dataset", F.col("priority_rank").alias("rank"), "severity", F.col("check_name").alias("check"),
                         "issue_type", "column", "count", "percentage", "evidence", "recommendation", "limitation")


def recommendations_table(recommendations: DataFrame) -> DataFrame:
    return with_issue_ids(recommendations).select(
        "dataset", F.col("priority_rank").alias("rank"), F.col("priority_level").alias("priority"), "severity", "column",
        "issue_type", "action", "rationale", F.concat_ws(", ", "source_checks").alias("source_checks"),
        F.concat_ws(", ", "related_issue_ids").alias("related_issues"))


def filter_issues(issues: DataFrame, severities=None, check: str | None = None, column: str | None = None) -> DataFrame:
    """Issues of any of the severities, of one check and of one column."""
    test = F.lit(True)
    if severities is not None:
        test = test & F.col("severity").isin([s.upper() for s in severities])
    if check is not None:
        test = test & (F.col("check_name") == check)
    if column is not None:
        test = test & (F.col("column") == column)
    return issues.filter(test)


def trim_conversations(conversations: DataFrame, messages: int = 12) -> DataFrame:
    """The last messages of every conversation, from the first user message on.

    The newest are found by a top-k window per conversation; the messages that
    are left are few, so the second window sees no long group.
    """
    latest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    whole = W.partitionBy("conv_id")
    start = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(whole)
    return (conversations.withColumn("_place", F.row_number().over(latest)).filter(F.col("_place") <= messages)
            .withColumn("_start", start).filter(F.col("turn") >= F.col("_start")).drop("_place", "_start"))
