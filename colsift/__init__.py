"""Data-quality audits of tables of any size, as Spark DataFrames."""

from .config import AuditError, CheckConfig, IntakeConfig, ReportConfig, ScoreConfig
from .operators.profile import TableProfile
from .plans.audit import Audit, audit, audit_csv


__all__ = ["Audit", "AuditError", "CheckConfig", "IntakeConfig", "ReportConfig",
           "ScoreConfig", "TableProfile", "audit", "audit_csv"]
