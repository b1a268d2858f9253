"""Summary, file metadata, reconciliation and the assembled report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import COMPONENTS, ReportConfig, ScoreConfig
from ..functions.measures import SEVERITIES
from .issues import counted, with_issue_ids
from .score import METHODOLOGY

HEADLINES = {
    "READY_WITH_MINOR_REVIEW": "Few points lost: skim the issue table, then go on.",
    "NEEDS_CLEANING": "Work through the first recommendations, then audit again.",
    "SIGNIFICANT_QUALITY_ISSUES": "Several components lost many points: mend the sources before building on this table.",
    "NOT_READY": "Do not publish this table: most of the score is lost.",
}
LIMITATIONS = (
    "The audit sees one table at a time: keys into other tables are not followed.",
    "Texts over 64 characters are compared by 128-bit digests.",
    "Nested columns take part in the missing and duplicate checks only.",
    "Examples follow the given order key; without one they come in value order and duplicates have none.",
    "CSV rows with too few fields are padded with nulls, which then count as missing.",
)
DISCLAIMER = "The score is arithmetic over the counted findings; what a column is for is not known to it."
METHODS = {
    "issue_prioritization": "one order over severity, share of rows, count and check",
    "recommendation_deduplication": "issues of a column with equal advice are one action",
    "report_type": "computed from exact counts over all rows",
}
COUNTS = [s.lower() for s in SEVERITIES]


def report_summary(score: DataFrame, issues: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Headline, score, readiness and counts per data set."""
    headline = F.lit(None).cast("string")
    for status, text in HEADLINES.items():
        headline = F.coalesce(headline, F.when(F.col("readiness_status") == status, text))
    highest = F.lit("PASS")
    for s in reversed(SEVERITIES):
        highest = F.when(F.col(s.lower()) > 0, s).otherwise(highest)
    listed = recommendations.groupBy("dataset").agg(F.count(F.lit(1)).alias("r"))
    table = counted(issues)
    base = score.select("dataset", "overall_score", "score_band_status", "readiness_status",
                        "status_adjusted_by_gates", "readiness_gates")
    return (base.join(table, "dataset", "left").join(listed, "dataset", "left")
            .na.fill(0, [*COUNTS, "issue_count_total", "r"])
            .select("dataset", headline.alias("headline"), "overall_score", "score_band_status", "readiness_status",
                    "status_adjusted_by_gates", "issue_count_total", *COUNTS,
                    F.col("r").alias("prioritized_recommendation_count"), highest.alias("highest_severity"),
                    "readiness_gates"))


def report_reconcile(score: DataFrame, issues: DataFrame) -> DataFrame:
    """Data sets whose issue table and score disagree on a count; empty when all is well."""
    names = [*COUNTS, "issue_count_total"]
    table = counted(issues).select("dataset", *[F.col(n).alias(f"table_{n}") for n in names])
    both = score.select("dataset", *names).join(table, "dataset", "left").na.fill(0, [f"table_{n}" for n in names])
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(n) != F.col(f"table_{n}"))
    return both.filter(differs)


def file_metadata(overview: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """File facts next to the audited dimensions.

    ``files`` may hold file_name (or name), file_size_bytes, encoding,
    delimiter, fingerprint_sha256 (or fingerprint), warnings (or
    loader_warnings), row_count and column_count. ``code`` names a mismatch.
    """
    have = set(files.columns) if files is not None else set()

    def pick(kind: str, *names: str):
        found = [F.col(n).cast(kind) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    fields = [
        pick("string", "file_name", "name").alias("file_name"),
        pick("long", "file_size_bytes").alias("file_size_bytes"), pick("string", "encoding").alias("encoding"),
        pick("string", "delimiter").alias("delimiter"),
        pick("string", "fingerprint_sha256", "fingerprint").alias("fingerprint_sha256"),
        pick("array<string>", "warnings", "loader_warnings").alias("loader_warnings"),
        pick("long", "row_count").alias("file_rows"), pick("long", "column_count").alias("file_columns")]
    sizes = overview.select("dataset", "row_count", "column_count")
    if files is None:
        out = sizes.select("*", *fields)
    else:
        out = sizes.join(files.select("dataset", *fields), "dataset", "left")
    code = (F.when(F.col("file_rows") != F.col("row_count"), "metadata_row_count_mismatch")
            .when(F.col("file_columns") != F.col("column_count"), "metadata_column_count_mismatch"))
    return out.select(
        "dataset", F.coalesce("file_name", F.lit("uploaded.csv")).alias("file_name"), "file_size_bytes", "encoding",
        "delimiter", "fingerprint_sha256", F.coalesce("loader_warnings", F.array().cast("array<string>")).alias("loader_warnings"),
        "row_count", "column_count", code.alias("code"))


def ordered_maps(df: DataFrame) -> DataFrame:
    """Maps have no order, their entries do."""
    return df.select(*[F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else f"`{f.name}`" for f in df.schema.fields])


def audit_report(*, overview: DataFrame, score: DataFrame, summary: DataFrame, issues: DataFrame,
                 recommendations: DataFrame, diagnostics: DataFrame, metadata: DataFrame,
                 generated_at: str | None = None, config: ReportConfig = ReportConfig(),
                 score_config: ScoreConfig = ScoreConfig(), checks: dict[str, DataFrame] | None = None,
                 nested: bool = True) -> DataFrame:
    """One row per data set that nests all parts of its report.

    All issues and, if asked for, the results of all checks are nested. With
    ``nested`` off these lists are left out and recommendations name their
    issues as runs of ranks: such a row stays small whatever was found, and
    ``write_report_json`` streams the lists into its document.
    """
    def nest(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("dataset", order)]
        return df.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    when = F.to_timestamp(F.lit(generated_at)) if generated_at else F.current_timestamp()
    out = (overview.select("dataset", F.struct(*[c for c in overview.columns if c != "dataset"]).alias("overview"))
           .join(score.select("dataset", "overall_score",
                              F.struct(*COMPONENTS).alias("component_scores"),
                              F.struct(*[F.col(f"{c}_contribution").alias(c) for c in COMPONENTS]).alias("weighted_contributions"),
                              F.struct(*[F.lit(score_config.weights[c]).alias(c) for c in COMPONENTS]).alias("score_weights")),
                 "dataset")
           .join(summary.select("dataset", F.struct(*[c for c in summary.columns if c != "dataset"]).alias("summary")), "dataset")
           .join(metadata.select("dataset", F.col("fingerprint_sha256").alias("_print"), F.col("file_name").alias("_name"),
                                 F.struct(*[c for c in metadata.columns if c not in ("dataset", "code")]).alias("file_metadata")), "dataset")
           .join(nest(with_issue_ids(recommendations) if nested else recommendations, "priority_rank", "prioritized_recommendations"), "dataset", "left")
           .join(nest(diagnostics, "column", "scoring_diagnostics"), "dataset", "left"))
    raw = []
    if nested:
        out = out.join(nest(issues, "priority_rank", "issues"), "dataset", "left")
    if nested and config.include_check_results and checks:
        for name, df in checks.items():
            df = ordered_maps(df)
            out = out.join(nest(df, [c for c in df.columns if c != "dataset"][0], f"_{name}"), "dataset", "left")
            raw.append(F.col(f"_{name}").alias(name))
    stamp = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    source = F.concat_ws("|", F.coalesce("_print", F.lit("")), F.coalesce("_name", F.lit("")), F.col("_at"),
                         F.format_string("%.2f", "overall_score"))
    texts = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    empty = [F.coalesce("issues", F.array()).alias("issues")] if nested else []
    return (out.withColumn("_at", stamp)
            .select("dataset", F.lit(config.version).alias("report_version"),
                    F.concat(F.lit("AUD-"), F.substring(F.sha2(source, 256), 1, 12)).alias("report_id"),
                    F.col("_at").alias("generated_at_utc"), "file_metadata", "summary", "overview", "component_scores",
                    "weighted_contributions", "score_weights", *empty, "prioritized_recommendations",
                    "scoring_diagnostics", F.struct(texts(METHODOLOGY).alias("scoring"),
                                                    *[F.lit(v).alias(k) for k, v in METHODS.items()]).alias("methodology"),
                    F.array(*[F.lit(t) for t in LIMITATIONS]).alias("limitations"), F.lit(DISCLAIMER).alias("disclaimer"),
                    *([F.struct(*raw).alias("quality_check_results")] if raw else [])))

