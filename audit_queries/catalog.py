"""Registered queries: every operator of the engine over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colsift import Audit, CheckConfig, TableProfile, audit
from colsift.functions.quantiles import rank_error
from colsift.operators import checks as C
from colsift.operators.duplicates import duplicates
from colsift.operators.overview import dataset_overview
from colsift.operators.values import value_frequencies
from colsift.plans import issues as I
from colsift.plans import report as R
from colsift.plans import score as S
from colsift.plans import views as V
from colsift.sources import csv as X
from colsift.sources import sinks as K
from colsift.sources.folder import scan_folder

from . import inputs

Query = Callable[[SparkSession, str], DataFrame]
_audits: dict[tuple[str, str], Audit] = {}


def profile(spark: SparkSession, sf_dir: str) -> TableProfile:
    return TableProfile(inputs.dirty(spark, sf_dir), inputs.NAME, order_by="order_id")


def shared_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """One audit per session and folder, which the report queries all look at."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _audits:
        _audits[key] = audit({inputs.NAME: inputs.dirty(spark, sf_dir)}, order_by="order_id")
    return _audits[key]


def forget_audits() -> None:
    _audits.clear()


def joined(df: DataFrame, *drop: str) -> DataFrame:
    """Arrays as text, so that results compare as plain values."""
    cols = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        kind = f.dataType.simpleString()
        if kind.startswith("array"):
            cols.append(F.concat_ws(",", F.transform(f.name, lambda x: x.cast("string"))).alias(f.name))
        elif kind.startswith("map"):
            pairs = F.transform(F.map_entries(f.name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
            cols.append(F.concat_ws(",", pairs).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def on_dirty(check, *drop: str) -> Query:
    return lambda spark, d: joined(check(profile(spark, d)), *drop)


def on_documents(check, *drop: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = TableProfile(inputs.documents(spark, d), inputs.DOCS_NAME, order_by=inputs.DOCS_INDEX)
        return joined(check(p), *drop)
    return run


def on_table(check, name: str, *columns: str, drop=(), order_by=None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = inputs.table(spark, d, name)
        if columns:
            df = df.select(*columns)
        return joined(check(TableProfile(df, name, order_by=order_by)), *drop)
    return run


def of_audit(view: Callable[[Audit], DataFrame], *drop: str) -> Query:
    return lambda spark, d: joined(view(shared_audit(spark, d)), *drop)


def warning_query(status: str) -> Query:
    return on_dirty(lambda p: C.data_type_warnings(p, only=status))


def findings(a: Audit, names) -> DataFrame:
    """The findings of several checks in one table."""
    union = None
    for n in names:
        df = a.check(n)
        column = F.col("column") if "column" in df.columns else F.lit(None).cast("string")
        part = df.select("dataset", F.lit(n).alias("check_name"), column.alias("column"), "status", "severity")
        union = part if union is None else union.unionByName(part)
    return union


def recorder(check: str) -> Query:
    return of_audit(lambda a: I.RECORDERS[check](a.check(check)), "details")


def _scan(spark: SparkSession, d: str) -> X.CsvTable:
    path = inputs.scratch(spark)
    (inputs.dirty(spark, d).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    names = tuple(inputs.COLUMNS)
    return X.scan_csv(spark, path, fmt=X.CsvFormat(names, ",", "utf-8-sig"))


def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).table.drop("_ord")


def load_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).warnings()


def scan_csv_multi_line(spark: SparkSession, d: str) -> DataFrame:
    """Pages as CSV, whose html holds line ends and quotes, written and read back."""
    path = inputs.scratch(spark)
    pages = inputs.table(spark, d, "pages").select("page_id", "url", "html")
    (pages.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    found = X.scan_csv(spark, path, fmt=X.CsvFormat(("page_id", "url", "html"), ",", "utf-8-sig"), multi_line=True).table
    return found.select("page_id", "url", F.length("html").cast("long").alias("chars"), F.sha2("html", 256).alias("html_sha256"))


def folder_columns(spark: SparkSession, d: str) -> DataFrame:
    """Some hundred and fifty CSV files of four tables, read as data sets of their own: the columns of each."""
    path = inputs.scratch(spark)
    for name, key, columns, sep, encoding in inputs.FOLDER:
        table = inputs.table(spark, d, name).selectExpr(f"{key} AS k", *columns)
        (table.repartition("k").write.partitionBy("k").option("header", True).option("escape", '"').option("sep", sep).option("encoding", encoding)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/{name}"))
    scan = scan_folder(spark, path)
    part = F.regexp_extract("dataset", "^([a-z]+/k=[^/]+)/", 1)
    files = scan.files.select("dataset", part.alias("part"), "row_count", "column_count", "encoding", "delimiter", "code", F.concat_ws(",", "warnings").alias("warnings"))
    return files.join(scan.columns.select("dataset", "position", "name", "dtype", "non_null_count"), "dataset").drop("dataset")


def audit_several(spark: SparkSession, d: str) -> DataFrame:
    """The findings of one audit of four tables."""
    tables = {inputs.NAME: inputs.dirty(spark, d), inputs.DOCS_NAME: inputs.documents(spark, d),
              "customer": inputs.table(spark, d, "customer"), "labels": inputs.table(spark, d, "labels")}
    return findings(audit(tables, order_by={inputs.NAME: "order_id", inputs.DOCS_NAME: inputs.DOCS_INDEX}), S.CHECKS)


def approximate_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Sketched quartiles of lineitem's numbers, and whether their exact ranks are within the stated error."""
    size = 1024
    p = TableProfile(inputs.table(spark, d, "lineitem"), "lineitem", config=CheckConfig(approx_quartiles=size))
    columns = {c.name: c for c in p.of_group("numeric")}
    error, counts = rank_error(size), []
    for c in columns.values():
        for place, q in zip((0.25, 0.75), p.sketched_quartiles[c.ref]):
            below, upto = F.count_if(F.col(c.ref) < F.lit(q)) / F.count(c.ref), F.count_if(F.col(c.ref) <= F.lit(q)) / F.count(c.ref)
            counts.append(((below <= place + error) & (upto >= place - error)).alias(f"{c.name}_{place}"))
    ranks = p.frame.agg(*counts)
    within = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}_0.25`").alias("q1_within"), F.col(f"`{n}_0.75`").alias("q3_within")) for n in columns])
    found = C.numeric_outliers(p, include_clean=True).select("dataset", "column", "method", "non_null_count", "finite_count")
    return found.join(ranks.select(F.inline(within)), "column")


def write_report_json(spark: SparkSession, d: str) -> DataFrame:
    """The written document, read back line by line: its facts, and every issue with its place in the document."""
    path = inputs.scratch(spark)
    shared_audit(spark, d).write_report(path, inputs.STAMP)
    lines = K.read_report_lines(spark, path).withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy("file", "at")) - 1)
    head = lines.where("place = 0").select("dataset", F.concat("line", F.lit("]}")).alias("document"))
    get = lambda p, c="document": F.get_json_object(c, p)
    facts = head.select("dataset", get("$.summary.overall_score").cast("double").alias("overall_score"), get("$.summary.readiness_status").alias("readiness_status"),
                        get("$.overview.row_count").cast("long").alias("row_count"))
    issue = F.from_json(F.regexp_replace("line", "^,", ""), "priority_rank int, issue_id string, check_name string, issue_type string, `column` string, severity string, "
                                                            "count long, percentage double, evidence string, recommendation string")
    return lines.where("place > 0").select("dataset", "place", issue.alias("i")).where("i.issue_id IS NOT NULL").select("dataset", "place", "i.*").join(facts, "dataset")


def write_issues_csv(spark: SparkSession, d: str) -> DataFrame:
    path = inputs.scratch(spark)
    K.write_issues_csv(shared_audit(spark, d).issues, path)
    schema = ("dataset string, rank int, severity string, check string, issue_type string, column string, count long, percentage double, "
              "evidence string, recommendation string, limitation string")
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return shared_audit(spark, d).report(inputs.STAMP).select(
        "dataset", "report_version", "report_id", "generated_at_utc", "summary.overall_score",
        F.size("issues").cast("long").alias("issue_count"),
        F.size("prioritized_recommendations").cast("long").alias("recommendation_count"),
        F.col("issues")[0]["issue_type"].alias("first_issue_type"))


def file_metadata(spark: SparkSession, d: str) -> DataFrame:
    a = shared_audit(spark, d)
    facts = a.overview.select("dataset", F.lit("orders.csv").alias("name"), "row_count", (F.col("column_count") + 1).alias("column_count"))
    return joined(R.file_metadata(a.overview, facts))


def trim(spark: SparkSession, d: str) -> DataFrame:
    return V.trim_conversations(inputs.table(spark, d, "conversations"), 3)


def file_query(operator, *drop: str) -> Query:
    return lambda spark, d: joined(operator(inputs.files(spark, d)), *drop)


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    pages = inputs.table(spark, d, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return X.file_fingerprint(pages)


QUERIES: dict[str, Query] = {
    # sources
    "file_manifest": file_query(X.file_manifest, "fingerprint_sha256", "encoding"),
    "file_fingerprint": fingerprints,
    "file_encoding": file_query(X.file_encoding),
    "detect_delimiter": file_query(X.detect_delimiter),
    "validate_header": file_query(X.validate_header),
    "scan_csv": scan_csv,
    "load_warnings": load_warnings,
    "scan_csv_multi_line": scan_csv_multi_line,
    "folder_columns": folder_columns,
    # sinks
    "write_report_json": write_report_json,
    "write_issues_csv": write_issues_csv,
    "preview_rows": lambda spark, d: K.preview_rows(inputs.dirty(spark, d), "order_id", 25),
    # profile and checks
    "dataset_overview": on_dirty(dataset_overview),
    "value_frequencies": lambda spark, d: value_frequencies(inputs.dirty(spark, d), dataset=inputs.NAME),
    "missing_values": on_dirty(C.missing_values),
    "duplicates": on_dirty(duplicates),
    "constant_columns": on_dirty(C.constant_columns),
    "near_constant_columns": on_dirty(C.near_constant_columns),
    "potential_identifiers": on_dirty(C.potential_identifiers),
    "high_cardinality_categories": on_dirty(C.high_cardinality_categories),
    "numeric_outliers": on_dirty(C.numeric_outliers, "example_outlier_values"),
    "category_consistency": on_dirty(C.category_consistency),
    "data_type_warnings": on_dirty(C.data_type_warnings),
    "numeric_like_text": warning_query("NUMERIC_LIKE_TEXT"),
    "mixed_datetime_formats": warning_query("MIXED_DATETIME_FORMATS"),
    "basic_checks": of_audit(lambda a: findings(a, ("missing_values", "duplicates", "constant_columns"))),
    "advanced_checks": of_audit(lambda a: findings(a, S.CHECKS[3:])),
    "all_checks": of_audit(lambda a: findings(a, S.CHECKS)),
    "duplicates_lineitem": on_table(duplicates, "lineitem", "l_partkey", "l_suppkey", "l_quantity"),
    "identifiers_documents": on_table(C.potential_identifiers, "documents"),
    "identifiers_customer": on_table(C.potential_identifiers, "customer"),
    "cardinality_documents": on_table(C.high_cardinality_categories, "documents"),
    "category_documents": on_table(C.category_consistency, "documents", drop=("variants", "variant_frequencies", "normalized_value")),
    "outliers_events": on_table(C.numeric_outliers, "events", drop=("example_outlier_values",)),
    "outliers_documents": on_table(C.numeric_outliers, "documents", drop=("example_outlier_values",)),
    "outliers_lineitem": on_table(C.numeric_outliers, "lineitem", drop=("example_outlier_values",)),
    "outliers_lineitem_approx": approximate_outliers,
    "audit_several": audit_several,
    "near_constant_labels": on_table(C.near_constant_columns, "labels"),
    "missing_values_documents_dirty": on_documents(C.missing_values),
    "near_constant_documents_dirty": on_documents(C.near_constant_columns),
    "outliers_documents_dirty": on_documents(C.numeric_outliers, "example_outlier_values"),
    "category_documents_dirty": on_documents(C.category_consistency, "variants", "variant_frequencies"),
    "unnamed_columns": on_documents(lambda p: C.data_type_warnings(p, only="UNNAMED_COLUMN")),
    "datetime_like_text": on_documents(lambda p: C.data_type_warnings(p, only="DATETIME_LIKE_TEXT")),
    # score
    "score_completeness": of_audit(lambda a: S.score_completeness(a.overview)),
    "score_duplicate_free": of_audit(lambda a: S.score_duplicate_free(a.check("duplicates"))),
    "score_schema": of_audit(lambda a: S.score_schema(a.dimensions, a.checks(S.SCHEMA_CHECKS))),
    "score_category": of_audit(lambda a: S.score_category(a.overview, a.check("category_consistency"))),
    "score_outlier": of_audit(lambda a: S.score_outlier(a.overview, a.check("numeric_outliers"))),
    "quality_score": of_audit(lambda a: a.score, "readiness_gates"),
    "issue_counts": of_audit(lambda a: S.issue_counts(a.overview, a.checks())),
    "score_band": of_audit(lambda a: a.score.select("dataset", "overall_score", "score_band_status")),
    "readiness_gate": of_audit(lambda a: a.score.select(
        "dataset", "score_band_status", "readiness_status", "status_adjusted_by_gates",
        F.size("readiness_gates").alias("gate_count"))),
    "score_diagnostics": of_audit(lambda a: a.diagnostics),
    "score_table": lambda spark, d: audit({inputs.NAME: inputs.dirty(spark, d)}).score.select(
        "dataset", "overall_score", "readiness_status", "issue_count_total"),
    # issues and report
    **{f"issues_{name}": recorder(check) for name, check in (
        ("missing", "missing_values"), ("duplicate", "duplicates"), ("constant", "constant_columns"),
        ("near_constant", "near_constant_columns"), ("identifier", "potential_identifiers"),
        ("cardinality", "high_cardinality_categories"), ("outlier", "numeric_outliers"),
        ("category", "category_consistency"), ("type", "data_type_warnings"))},
    "issue_type_impact": of_audit(lambda a: a.check("data_type_warnings").select(
        "dataset", "column", "status", I.issue_type_impact().alias("impact_percentage"))),
    "ranked_issues": of_audit(lambda a: a.issues, "details"),
    "recommendations": of_audit(lambda a: I.with_issue_ids(a.recommendations)),
    "recommendation_ranges": of_audit(lambda a: a.recommendations.select("dataset", "recommendation_id", F.inline("related_issue_ranges"))),
    "recommendation_links": of_audit(lambda a: I.recommendation_links(a.issues)),
    "report_summary": of_audit(lambda a: a.summary, "readiness_gates"),
    "file_metadata": file_metadata,
    "report_reconcile": of_audit(lambda a: R.report_reconcile(a.score, a.issues)),
    "audit_report": audit_report,
    # views
    "overview_view": of_audit(lambda a: V.overview_view(a.overview, a.metadata)),
    "summary_view": of_audit(lambda a: V.summary_view(a.summary, a.score), "readiness_gates", "disclaimer"),
    "missing_view": of_audit(lambda a: V.missing_view(a.issues, limit=2, min_percentage=3.0), "details"),
    "duplicate_view": of_audit(lambda a: V.duplicate_view(a.overview, a.issues)),
    "column_view": of_audit(lambda a: V.column_view("priority", a.issues, limit=3), "details"),
    "column_summary": of_audit(lambda a: V.column_summary("priority", a.overview, a.issues, a.diagnostics)),
    "column_recommendations": of_audit(lambda a: V.column_recommendations("ref_code", I.with_issue_ids(a.recommendations))),
    "priority_view": of_audit(lambda a: V.priority_view(a.issues, limit=5, min_severity="HIGH", check="category consistency"), "details"),
    "ml_view": of_audit(lambda a: V.ml_view(a.issues), "details"),
    "ml_summary": of_audit(lambda a: V.ml_summary(a.issues, a.summary)),
    "component_scores": of_audit(lambda a: S.component_scores(a.score)),
    "issues_table": of_audit(lambda a: V.issues_table(a.issues)),
    "recommendations_table": of_audit(lambda a: V.recommendations_table(a.recommendations)),
    "filter_issues": of_audit(lambda a: V.filter_issues(a.issues, severities=["high", "critical"], column="ref_code"), "details"),
    "trim_conversations": trim,
}
