"""The weighted quality score, as grouped frames over check results.

All inputs lead with ``dataset`` and may hold any number of data sets.
``checks`` maps a check's name to its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COMPONENTS, ScoreConfig
from ..functions.measures import SEVERITIES, clamp_score, half_even_sql

CHECKS = ("missing_values", "duplicates", "constant_columns", "near_constant_columns",
          "potential_identifiers", "high_cardinality_categories", "numeric_outliers",
          "category_consistency", "data_type_warnings")
SCHEMA_CHECKS = ("constant_columns", "near_constant_columns", "potential_identifiers",
                 "high_cardinality_categories", "data_type_warnings")
EXACT = T.DecimalType(28, 2)

METHODOLOGY = {
    "completeness": "100 less the share of missing cells",
    "duplicate_free": "100 less the share of extra copies among the rows",
    "schema_usability": "100 less the mean over columns of the worst schema penalty",
    "categorical_consistency": "100 less the mean share of inconsistent labels over text columns",
    "outlier_risk": "100 less the mean outlier share over numeric columns",
}


def score_completeness(overview: DataFrame) -> DataFrame:
    return overview.select("dataset", clamp_score("100 - missing_percentage").alias("completeness"))


def score_duplicate_free(duplicates: DataFrame) -> DataFrame:
    return duplicates.select("dataset", clamp_score("100 - duplicate_percentage").alias("duplicate_free"))


def schema_penalties(checks: dict[str, DataFrame], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """The worst penalty per column; overlapping checks count once."""
    penalty: Column | None = None
    for name, points in config.penalties.items():
        test = F.col("severity") == name
        penalty = F.when(test, F.lit(float(points))) if penalty is None else penalty.when(test, F.lit(float(points)))
    union = None
    for name in SCHEMA_CHECKS:
        part = checks[name].select("dataset", "column", penalty.alias("penalty"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("dataset", "column").agg(F.max("penalty").alias("schema_penalty"))


def category_burden(category: DataFrame) -> DataFrame:
    """Share of inconsistent labels per column, at most 100. Sums are exact decimals."""
    total = F.sum(F.col("affected_percentage").cast(EXACT)).cast("double")
    return category.groupBy("dataset", "column").agg(
        F.least(F.lit(100.0), total).alias("category_affected_percentage"))


def outlier_burden(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("dataset", "column").agg(
        F.least(F.lit(100.0), F.max("outlier_percentage")).alias("outlier_percentage"))


def _mean_score(overview: DataFrame, burden: DataFrame, measure: str, columns: str, name: str) -> DataFrame:
    total = burden.groupBy("dataset").agg(F.sum(F.col(measure).cast(EXACT)).cast("double").alias("total"))
    mean = f"coalesce(total, 0D) / {columns}"
    return (overview.select("dataset", columns).join(total, "dataset", "left")
            .select("dataset", F.when(F.col(columns) == 0, F.lit(100.0))
                    .otherwise(clamp_score(f"100 - {mean}")).alias(name)))


def score_schema(overview: DataFrame, checks: dict[str, DataFrame], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    return _mean_score(overview, schema_penalties(checks, config), "schema_penalty", "column_count",
                       "schema_usability")


def score_category(overview: DataFrame, category: DataFrame) -> DataFrame:
    return _mean_score(overview, category_burden(category), "category_affected_percentage",
                       "categorical_column_count", "categorical_consistency")


def score_outlier(overview: DataFrame, outliers: DataFrame) -> DataFrame:
    return _mean_score(overview, outlier_burden(outliers), "outlier_percentage", "numeric_column_count",
                       "outlier_risk")


def issue_counts(overview: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """Findings by severity over all checks."""
    union = None
    for name in CHECKS:
        part = checks[name].select("dataset", "severity")
        union = part if union is None else union.unionByName(part)
    counts = union.groupBy("dataset").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    names = [s.lower() for s in SEVERITIES]
    return (overview.select("dataset").join(counts, "dataset", "left")
            .select("dataset", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
            .withColumn("issue_count_total", sum((F.col(n) for n in names[1:]), F.col(names[0]))))


def score_band(score: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    return (F.when(score >= config.ready_score, "READY_WITH_MINOR_REVIEW")
            .when(score >= config.cleaning_score, "NEEDS_CLEANING")
            .when(score >= config.significant_score, "SIGNIFICANT_QUALITY_ISSUES")
            .otherwise("NOT_READY"))


GATES = {
    "CRITICAL": "A critical issue sets the readiness to NOT_READY.",
    "HIGH": "A high issue keeps the readiness below READY_WITH_MINOR_REVIEW.",
}


def readiness(scored: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Add the readiness after gates to a frame with band and issue counts."""
    band = F.col("score_band_status")
    none = F.array().cast("array<string>")
    if not config.gates:
        return (scored.withColumn("readiness_status", band).withColumn("status_adjusted_by_gates", F.lit(False))
                .withColumn("readiness_gates", none))
    critical = F.col("critical") > 0
    high = ~critical & (F.col("high") > 0) & (band == "READY_WITH_MINOR_REVIEW")
    status = F.when(critical, "NOT_READY").when(high, "NEEDS_CLEANING").otherwise(band)
    return (scored.withColumn("readiness_status", status)
            .withColumn("status_adjusted_by_gates", status != band)
            .withColumn("readiness_gates", F.when(critical, F.array(F.lit(GATES["CRITICAL"])))
                        .when(high, F.array(F.lit(GATES["HIGH"]))).otherwise(none)))


def quality_score(overview: DataFrame, checks: dict[str, DataFrame], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """One row per data set: components, contributions, total, counts and readiness."""
    parts = (score_completeness(overview)
             .join(score_duplicate_free(checks["duplicates"]), "dataset")
             .join(score_schema(overview, checks, config), "dataset")
             .join(score_category(overview, checks["category_consistency"]), "dataset")
             .join(score_outlier(overview, checks["numeric_outliers"]), "dataset"))
    for c in COMPONENTS:
        parts = parts.withColumn(f"{c}_contribution", F.expr(half_even_sql(f"({c} * {float(config.weights[c])!r}D)", 4)))
    total = " + ".join(f"{c}_contribution" for c in COMPONENTS)
    scored = (parts.withColumn("overall_score", clamp_score(total))
              .withColumn("score_band_status", score_band(F.col("overall_score"), config))
              .join(issue_counts(overview, checks), "dataset"))
    return readiness(scored, config)


def score_diagnostics(checks: dict[str, DataFrame], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Per column what each component holds against it."""
    return (schema_penalties(checks, config)
            .join(category_burden(checks["category_consistency"]), ["dataset", "column"], "full")
            .join(outlier_burden(checks["numeric_outliers"]), ["dataset", "column"], "full"))


def component_scores(score: DataFrame, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Components of the score as rows."""
    rows = [F.struct(F.lit(c).alias("component"), F.col(c).alias("score"), F.lit(config.weights[c]).alias("weight"),
                     F.col(f"{c}_contribution").alias("weighted_contribution")) for c in COMPONENTS]
    return score.select("dataset", F.inline(F.array(*rows)))
