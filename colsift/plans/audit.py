"""The whole audit of one or many tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..config import AuditError, CheckConfig, IntakeConfig, ReportConfig, ScoreConfig
from ..functions.stage import stage, stage_columns
from ..operators import checks as C
from ..operators.duplicates import duplicates
from ..operators.overview import dataset_overview, dimensions
from ..operators.profile import TableProfile
from ..sources import csv as X
from ..sources import sinks as K
from ..sources.folder import scan_folder
from . import issues as I
from . import report as R
from . import score as S

OPERATORS = dict(zip(S.CHECKS, (
    C.missing_values, duplicates, C.constant_columns, C.near_constant_columns, C.potential_identifiers,
    C.high_cardinality_categories, C.numeric_outliers, C.category_consistency, C.data_type_warnings)))
# Results that read the data once more when they are looked at; they are kept.
STAGED = ("numeric_outliers", "category_consistency", "data_type_warnings")
# Near constants follow the outliers, whose quartiles settle the dominant numbers.
BRANCHES = (
    ("duplicates",),
    ("numeric_outliers", "near_constant_columns"),
    ("category_consistency",),
    ("data_type_warnings", "high_cardinality_categories"),
    ("potential_identifiers", "constant_columns"),
)
BASIC = ("missing_values", "duplicates", "constant_columns")
ADVANCED = tuple(c for c in S.CHECKS if c not in BASIC)


class Audit:
    """Lazy results of an audit. Every table leads with ``dataset``.

    Checks run once per table and are staged, so that score, issues and views
    read findings instead of the audited data.
    """

    def __init__(self, profiles: list[TableProfile], *, score_config: ScoreConfig | None = None,
                 report_config: ReportConfig | None = None, files: DataFrame | None = None) -> None:
        if not profiles:
            raise AuditError("nothing to audit", "no_tables")
        self.profiles = profiles
        self.score_config = score_config or ScoreConfig()
        self.report_config = report_config or ReportConfig()
        self.files = files
        self._checks: dict[str, DataFrame] = {}

    def check(self, name: str) -> DataFrame:
        """The result of one check over all tables."""
        if name not in self._checks:
            found = reduce(DataFrame.unionByName, [OPERATORS[name](p) for p in self.profiles])
            self._checks[name] = stage(found) if name in STAGED else found
        return self._checks[name]

    def _branch(self, names) -> None:
        for name in names:
            self.check(name)

    def checks(self, names=S.CHECKS) -> dict[str, DataFrame]:
        """Several checks by name.

        The branches share the first counts and the text values only, so their
        jobs run side by side and fill the cluster.
        """
        if any(n not in self._checks for n in names):
            spark = self.profiles[0].spark
            for p in self.profiles:
                p.rows
            with ThreadPoolExecutor(len(BRANCHES)) as pool:
                runs = [pool.submit(inheritable_thread_target(spark)(self._branch), [n for n in b if n in names])
                        for b in BRANCHES]
                for run in runs:
                    run.result()
            self._branch(names)  # missing values come from the first counts
        return {n: self._checks[n] for n in names}

    @cached_property
    def dimensions(self) -> DataFrame:
        """Rows, missing cells and columns of each table: the overview without its duplicate rows."""
        return reduce(DataFrame.unionByName, [dimensions(p) for p in self.profiles])

    @cached_property
    def overview(self) -> DataFrame:
        rows = self.check("duplicates")
        return reduce(DataFrame.unionByName, [
            dataset_overview(p, rows.filter(rows["dataset"] == p.dataset)) for p in self.profiles])

    def basic_checks(self) -> dict[str, DataFrame]:
        checks = self.checks(BASIC)
        return {"overview": self.overview} | checks

    def advanced_checks(self) -> dict[str, DataFrame]:
        return self.checks(ADVANCED)

    def all_checks(self) -> dict[str, DataFrame]:
        checks = self.checks()
        return {"overview": self.overview} | checks

    @cached_property
    def score(self) -> DataFrame:
        checks = self.checks()  # first, so that the duplicates of the overview run beside the others
        return stage(S.quality_score(self.overview, checks, self.score_config))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return S.score_diagnostics(self.checks(), self.score_config)

    @cached_property
    def issues(self) -> DataFrame:
        return stage(I.ranked_issues(self.checks()))

    @cached_property
    def recommendations(self) -> DataFrame:
        return stage(I.recommendations(self.issues, self.report_config.max_recommendations))

    @cached_property
    def metadata(self) -> DataFrame:
        return R.file_metadata(self.overview, self.files)

    @cached_property
    def summary(self) -> DataFrame:
        return R.report_summary(self.score, self.issues, self.recommendations)

    def report(self, generated_at: str | None = None, nested: bool = True) -> DataFrame:
        """One row per data set; refuses results that contradict each other.

        ``nested`` rows hold all issues; without it a row stays small.
        """
        checks = self.checks()  # first, as in ``score``
        wrong = self.metadata.filter("code IS NOT NULL").select("code").first()
        if wrong:
            raise AuditError("file metadata and table differ", wrong["code"])
        if not R.report_reconcile(self.score, self.issues).isEmpty():
            raise AuditError("issue table and score differ", "issue_count_mismatch")
        return R.audit_report(
            overview=self.overview, score=self.score, summary=self.summary, issues=self.issues,
            recommendations=self.recommendations, diagnostics=self.diagnostics, metadata=self.metadata,
            generated_at=generated_at, config=self.report_config, score_config=self.score_config, checks=checks, nested=nested)

    def write_report(self, path: str, generated_at: str | None = None) -> DataFrame:
        """Write one JSON document per data set, of any size, below ``path``; returns the manifest of its files."""
        checks = self.checks() if self.report_config.include_check_results else None
        return K.write_report_json(self.report(generated_at, nested=False), path, self.issues, checks)


def audit(tables: dict[str, DataFrame] | DataFrame, *, order_by=None, row_id: str | None = None,
          config: CheckConfig | None = None, score_config: ScoreConfig | None = None,
          report_config: ReportConfig | None = None, files: DataFrame | None = None) -> Audit:
    """Audit one table, or several by name.

    ``order_by`` is a list of columns, or a mapping from table name to one.
    """
    if isinstance(tables, DataFrame):
        tables = {"table": tables}
    orders = order_by if isinstance(order_by, dict) else dict.fromkeys(tables, order_by)
    profiles = [TableProfile(df, name, order_by=orders.get(name), row_id=row_id, config=config, reuse=True)
                for name, df in tables.items()]
    return Audit(profiles, score_config=score_config, report_config=report_config, files=files)


def audit_csv(spark: SparkSession, path: str, *, dataset: str = "table", intake: IntakeConfig = IntakeConfig(),
              config: CheckConfig | None = None, score_config: ScoreConfig | None = None,
              report_config: ReportConfig | None = None, per_file: bool = False) -> Audit:
    """Audit a CSV file, or a folder of files with one header, from its path.

    The text is parsed and typed once and staged by columns; rows are known by
    their position from 0. The report holds the facts of the files.

    With ``per_file`` every file of the folder is a data set of its own, named
    by its path below the folder, whatever its header and encoding. Files that
    break a rule are left out; ``scan_folder`` tells which and why.
    """
    if per_file:
        folder = scan_folder(spark, path, intake)
        return audit({name: folder.table(name) for name in folder.names()}, row_id="_ord", config=config, score_config=score_config,
                     report_config=report_config, files=folder.files.where("code IS NULL").drop("path", "code"))
    manifest = X.manifest_of(spark, path, intake)
    scan = X.scan_csv(spark, path, intake, fmt=X.common_format(manifest, path))
    rows = X.with_positions(stage_columns(scan.placed))
    return audit({dataset: rows}, row_id="_ord", config=config, score_config=score_config, report_config=report_config,
                 files=scan.facts(manifest, path, dataset))
