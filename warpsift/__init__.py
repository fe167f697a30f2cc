"""Code security analytics on Spark: tables of files in, findings and reports out."""

from .plans.audit import Dependencies, audit, changed_files_scan, quick
from .rules.base import Pattern, Rule, ci
from .rules.catalog import PACKS, SCANS
from .session import build_session

__all__ = ["Dependencies", "PACKS", "Pattern", "Rule", "SCANS", "audit", "build_session",
           "changed_files_scan", "ci", "quick"]
