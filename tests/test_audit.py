import json
import os
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from audit_queries import inputs
from colsift import AuditError, ReportConfig, ScoreConfig, audit, audit_csv
from colsift.plans import issues as I
from colsift.plans import report as R
from colsift.plans import score as S
from colsift.plans import views as V
from colsift.sources import sinks

SF = "/root/testdata/sf0.001"
COMPONENTS = ("completeness", "duplicate_free", "schema_usability", "categorical_consistency", "outlier_risk")


@pytest.fixture(scope="module")
def clean(spark):
    data = [(20 + i, ["Rome", "Oslo", "Lima", "Bern"][i % 4], 100.0 + 50 * i) for i in range(20)]
    return spark.createDataFrame(data, "age int, city string, purchases double")


@pytest.fixture(scope="module")
def two(spark, clean):
    return audit({"dirty": inputs.dirty(spark, SF), "clean": clean}, order_by={"dirty": "order_id", "clean": None})


def test_clean_table_is_perfect(two):
    r = two.score.filter("dataset = 'clean'").first()
    assert r.overall_score == 100.0 and r.readiness_status == "READY_WITH_MINOR_REVIEW" and r.issue_count_total == 0
    s = two.summary.filter("dataset = 'clean'").first()
    assert (s.highest_severity, s.issue_count_total, s.prioritized_recommendation_count) == ("PASS", 0, 0)


def test_score_invariants(two):
    for r in two.score.collect():
        assert all(0 <= r[c] <= 100 for c in COMPONENTS)
        assert r.overall_score == round(sum(r[f"{c}_contribution"] for c in COMPONENTS), 2)


def test_issues_reconcile_and_ranks_are_gapless(two):
    assert R.report_reconcile(two.score, two.issues).isEmpty()
    assert not R.report_reconcile(two.score, two.issues.filter("priority_rank > 1")).isEmpty()
    ranks = [r.priority_rank for r in two.issues.filter("dataset = 'dirty'").orderBy("priority_rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


def test_row_order_and_partitioning_do_not_matter(spark, two):
    again = audit({"dirty": inputs.dirty(spark, SF).orderBy(F.hash("order_id")).repartition(13)}, order_by="order_id")
    keep = lambda a: [tuple(r) for r in a.issues.filter("dataset = 'dirty'").orderBy("priority_rank").collect()]
    assert keep(again) == keep(two)
    assert again.score.first()["overall_score"] == two.score.filter("dataset = 'dirty'").first()["overall_score"]


def test_ranking_over_ranges_equals_the_window(two):
    plain = {(r.dataset, r.evidence, r.column): r.priority_rank for r in two.issues.collect()}
    window = W.partitionBy("dataset").orderBy(*I._order())
    one = I.all_issues(two.checks()).withColumn("priority_rank", F.row_number().over(window))
    assert {(r.dataset, r.evidence, r.column): r.priority_rank for r in one.collect()} == plain


def test_worked_example_end_to_end(spark, tmp_path):
    """A table small enough to audit by hand.

    20 rows, 5 columns, 10 of 100 cells missing: completeness 90. No row repeats: 100. Penalties: an identifier by name 50, a constant 50,
    a text of distinct values 25, over 5 columns: 100 - 125 / 5 = 75. Spellings of Rome cover all of one of 3 text columns: 100 - 100 / 3 = 66.67.
    One of 20 amounts lies outside, of 2 numeric columns: 100 - 5 / 2 = 97.5.
    Weighted: 31.5 + 20 + 11.25 + 10.0005 + 14.625 = 87.3755. Half of notes missing is critical, so the table is not ready.
    """
    lines = ["id,flag,city,amount,note"] + [f"{i},x,{'rome' if i in (3, 7) else 'Rome'},{1000 if i == 19 else 10 + i},{f'n{i} text' if i < 10 else ''}" for i in range(20)]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    a = audit_csv(spark, str(tmp_path / "t.csv"), dataset="t")
    s = a.score.first()
    assert [s[c] for c in COMPONENTS] == [90.0, 100.0, 75.0, 66.67, 97.5]
    assert [s[f"{c}_contribution"] for c in COMPONENTS] == [31.5, 20.0, 11.25, 10.0005, 14.625] and s.overall_score == 87.38
    assert (s.critical, s.high, s.medium, s.low) == (1, 3, 2, 0)
    assert (s.score_band_status, s.readiness_status) == ("READY_WITH_MINOR_REVIEW", "NOT_READY")
    issues = [(r.check_name, r.column, r.severity, r["count"], r.percentage) for r in a.issues.orderBy("priority_rank").collect()]
    assert issues == [("missing_values", "note", "CRITICAL", 10, 50.0), ("potential_identifiers", "id", "HIGH", 20, 100.0),
                      ("category_consistency", "city", "HIGH", 20, 100.0), ("constant_columns", "flag", "HIGH", 1, 100.0), ("potential_identifiers", "note", "MEDIUM", 10, 100.0), ("numeric_outliers", "amount", "MEDIUM", 1, 5.0)]
    bounds = a.check("numeric_outliers").first()
    assert (bounds.q1, bounds.q3, bounds.lower_bound, bounds.upper_bound) == (14.75, 24.25, 0.5, 38.5) and bounds.example_outlier_values == [1000.0]


def test_critical_gate_and_disabled_gates(spark, two):
    r = two.score.filter("dataset = 'dirty'").first()
    assert r.critical == 2 and r.readiness_status == "NOT_READY" and len(r.readiness_gates) == 1
    free = audit({"dirty": inputs.dirty(spark, SF)}, score_config=ScoreConfig(gates=False)).score.first()
    assert free.readiness_status == free.score_band_status and not free.status_adjusted_by_gates


@pytest.mark.parametrize("bad", [dict(weights=dict(completeness=1.0)), dict(ready_score=60.0), dict(penalties=dict(
    PASS=0, LOW=30, MEDIUM=25, HIGH=50, CRITICAL=100))])
def test_score_config_is_checked(bad):
    with pytest.raises(ValueError):
        ScoreConfig(**bad)


def test_recommendations_merge_one_action_per_column(two):
    recs = I.with_issue_ids(two.recommendations).filter("dataset = 'dirty'").orderBy("priority_rank").collect()
    assert [r.recommendation_id for r in recs] == [f"REC-{i:03d}" for i in range(1, len(recs) + 1)] and len(recs) == 10
    merged = next(r for r in recs if r.issue_type == "CATEGORY_LABEL_INCONSISTENCY")
    assert merged.related_issue_count == len(merged.related_issue_ids) == 5 and merged.related_issue_ids == sorted(merged.related_issue_ids)
    assert I.recommendation_links(two.issues).filter("related_issue_count > 2").count() == 5


def test_runs_of_related_issues_expand_to_all(spark):
    rng = random.Random(2)
    rows = [("d" if i % 7 else "e", "c" + str(rng.randrange(3)), "act" + str(rng.random() < 0.3), "HIGH", "P1", "T", "x", "k" + str(i % 2), i, f"ISSUE-{i:03d}") for i in range(1, 1500)]
    issues = spark.createDataFrame(rows, "dataset string, `column` string, recommendation string, severity string, priority_level string, issue_type string, evidence string, check_name string, priority_rank int, issue_id string")
    found = {(r.dataset, r["column"], r.action): r.related_issue_ids for r in I.with_issue_ids(I.recommendations(issues, 50)).collect()}
    plain = {}
    for r in rows:
        plain.setdefault((r[0], r[1], r[2]), []).append(r[-1])
    assert found == plain
    one = spark.createDataFrame([("d", "c", "a", "HIGH", "P1", "T", "x", "k", i, f"ISSUE-{i:03d}") for i in range(1, 3000)], issues.schema)
    assert [tuple(x) for x in I.recommendations(one).first().related_issue_ranges] == [(1, 2999)]


def test_views(two):
    dirty = two.issues.filter("dataset = 'dirty'")
    view = V.priority_view(two.issues, limit=3, min_severity="high").collect()
    assert [r.priority_rank for r in view] == [1, 2, 3] and view[0].truncated and view[0].returned_count == 3
    assert view[0].total_matching_count == dirty.filter("severity IN ('CRITICAL', 'HIGH')").count()
    assert {r.column for r in V.missing_view(two.issues, column=" NOTES ").collect()} == {"notes"}
    assert V.column_summary("age", two.overview, two.issues, two.diagnostics).first()["is_clean"]
    assert V.require_column(two.overview, " REF_code ") == "ref_code"
    assert V.column_summary("nope", two.overview, two.issues, two.diagnostics).isEmpty()
    assert V.priority_view(two.issues, check="Category-Consistency").count() == 5
    assert {r.has_exact_duplicates for r in V.duplicate_view(two.overview, two.issues).collect()} == {True, False}
    for call, code in ((lambda: V.missing_view(two.issues, limit=0), "invalid_limit"),
                       (lambda: V.missing_view(two.issues, limit=26), "invalid_limit"),
                       (lambda: V.missing_view(two.issues, column=" "), "empty_column_name"),
                       (lambda: V.require_column(two.overview, "nope"), "unknown_column"),
                       (lambda: V.missing_view(two.issues, limit=True), "invalid_limit"),
                       (lambda: V.missing_view(two.issues, min_percentage=101), "invalid_percentage"),
                       (lambda: V.priority_view(two.issues, min_severity="huge"), "unknown_severity"),
                       (lambda: V.priority_view(two.issues, check="nope"), "unknown_check_name")):
        with pytest.raises(AuditError) as e:
            call()
        assert e.value.code == code


def test_report_documents(spark, two, tmp_path):
    stamp = "2026-01-01T00:00:00Z"
    docs = {r.dataset: json.loads(r.document) for r in sinks.report_json(two.report(stamp)).collect()}
    again = {r.dataset: json.loads(r.document) for r in sinks.report_json(two.report(stamp)).collect()}
    assert docs == again
    dirty = docs["dirty"]
    assert dirty["generated_at_utc"] == stamp and dirty["report_id"].startswith("AUD-") and len(dirty["report_id"]) == 16
    assert len(dirty["issues"]) == dirty["summary"]["issue_count_total"] and docs["clean"]["issues"] == []
    assert [i["priority_rank"] for i in dirty["issues"]] == sorted(i["priority_rank"] for i in dirty["issues"])
    ids = {d: [r.pop("related_issue_ids") for r in docs[d]["prioritized_recommendations"] or []] for d in docs}
    for path, manifest in ((str(tmp_path / n), two.write_report(str(tmp_path / n), stamp)) for n in ("one", "again")):
        for name, doc in docs.items():
            folder = tmp_path / path / "report" / f"dataset={name}"
            files = [r.file for r in manifest.where(F.col("dataset") == name).orderBy("file").collect()]
            text = "".join((folder / f).read_text() for f in files)
            written = json.loads(text, parse_constant=lambda c: pytest.fail(c))
            ranges = [r.pop("related_issue_ranges") for r in written["prioritized_recommendations"] or []]
            assert written == doc and "\n".join(sinks.report_document(spark, path, name)) + "\n" == text
            assert [[f"ISSUE-{i:03d}" for x in r for i in range(x["first"], x["last"] + 1)] for r in ranges] == ids[name]
            assert manifest.where(F.col("dataset") == name).agg(F.sum("lines")).first()[0] == text.count("\n") == len(doc["issues"]) + 2


def test_documents_with_check_results_are_strict_json(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = audit({'q"\n/=': inputs.dirty(spark, SF), "b": inputs.table(spark, SF, "labels")}, report_config=ReportConfig(include_check_results=True))
        manifest = a.write_report(str(tmp_path / "out"), "2026-01-01T00:00:00Z")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = {r.dataset: json.loads(r.document) for r in sinks.report_json(a.report("2026-01-01T00:00:00Z")).collect()}
    assert {r.dataset for r in manifest.collect()} == set(docs) and manifest.groupBy("dataset").count().agg(F.max("count")).first()[0] > 1
    for name, doc in docs.items():
        written = json.loads("\n".join(sinks.report_document(spark, str(tmp_path / "out"), name)))
        key = lambda rows: sorted(map(json.dumps, rows))
        assert written["issues"] == doc["issues"] and written["summary"] == doc["summary"]
        assert {c: key(rows) for c, rows in written["quality_check_results"].items()} == {c: key(rows or []) for c, rows in doc["quality_check_results"].items()}


def test_reports_hold_all_issues_and_check_results(spark):
    a = audit({"d": inputs.dirty(spark, SF)}, report_config=ReportConfig(include_check_results=True))
    r = a.report().first()
    assert len(r.issues) == r.summary.issue_count_total == a.issues.count()
    assert len(r.quality_check_results.missing_values) == 10 and r.quality_check_results.category_consistency


def test_non_finite_numbers_become_null(spark):
    df = spark.sql("SELECT 'd' dataset, double('inf') x, array(double('nan'), 1d) y, named_struct('z', double('-inf')) s")
    assert json.loads(sinks.report_json(df).first()["document"]) == {"dataset": "d", "x": None, "y": [None, 1.0], "s": {"z": None}}


def test_metadata_must_match(spark, clean):
    files = spark.createDataFrame([("t", "a.csv", 99)], "dataset string, file_name string, row_count int")
    a = audit({"t": clean}, files=files)
    with pytest.raises(AuditError) as e:
        a.report()
    assert e.value.code == "metadata_row_count_mismatch"


def test_trim_conversations_keeps_the_last_messages(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"{c}{t}") for c in "ab" for t in range(1, 8 if c == "a" else 3)] + [("c", 1, "bot", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r.conv_id, r.turn) for r in V.trim_conversations(df, 4).collect()}
    assert got == {("a", 5), ("a", 6), ("a", 7), ("b", 1), ("b", 2)}


@pytest.mark.skipif("AUDIT_SAMPLE_CSV" not in os.environ, reason="no sample file named")
def test_published_results_of_the_sample_file(spark):
    a = audit_csv(spark, os.environ["AUDIT_SAMPLE_CSV"])
    s = a.score.first()
    assert (s.overall_score, s.critical, s.high, s.medium, s.low) == (92.02, 0, 14, 7, 6)
    assert [s[c] for c in COMPONENTS] == [97.56, 96.15, 76.92, 81.11, 99.61]
    assert a.check("duplicates").first()["example_duplicate_indices"] == [str(i) for i in range(200, 208)]
    got = [(r.check_name, r.column, r["count"], r.percentage) for r in a.issues.orderBy("priority_rank").collect()]
    assert got[:4] == [("constant_columns", "country", 1, 100.0), ("data_type_warnings", "signup_date", 2, 99.03),
                       ("potential_identifiers", "Unnamed: 0", 200, 96.15), ("potential_identifiers", "customer_id", 200, 96.15)]
    assert got[-1] == ("numeric_outliers", "purchase_amount", 1, 0.48)
    bounds = {r["column"]: (r.q1, r.q3, r.lower_bound, r.upper_bound) for r in a.check("numeric_outliers").collect()}
    assert bounds["purchase_amount"] == (889.3225, 1724.965, -364.1413, 2978.4288)


def test_score_of_the_schema_needs_its_own_checks_only(spark, two):
    from audit_queries import catalog
    catalog.forget_audits()
    got = catalog.QUERIES["score_schema"](spark, SF)
    alone = catalog.shared_audit(spark, SF)
    assert set(alone._checks) == set(S.SCHEMA_CHECKS) and "overview" not in alone.__dict__
    assert got.first()["schema_usability"] == two.score.filter("dataset = 'dirty'").first()["schema_usability"]
    kept = [c for c in two.dimensions.columns]
    assert sorted(map(str, two.dimensions.collect())) == sorted(map(str, two.overview.select(*kept).collect()))
    catalog.forget_audits()


def test_duplicates_run_beside_the_other_checks(spark, clean):
    """The score asks for all checks at once, not for the overview's duplicates first."""
    a = audit(clean)
    asked = []
    a.checks = lambda names=S.CHECKS, run=a.checks: (asked.append(sorted(a._checks)), run(names))[1]
    assert a.score.count() == 1 and asked[0] == []
