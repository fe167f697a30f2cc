"""Writing findings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REPORT_FIELDS = ("id", "severity", "type", "category", "title", "file", "line", "column",
                 "remediation", "suggestedEnvVar", "owaspReference", "matchedPattern")


def write_findings(findings: DataFrame, path: str) -> DataFrame:
    """Persist findings by pack and return the stored table for further reports."""
    findings.write.mode("overwrite").partitionBy("pack").parquet(path)
    return findings.sparkSession.read.schema(findings.schema).parquet(path) \
        .select(*findings.columns)


def json_report(findings: DataFrame) -> DataFrame:
    """The twelve fields of the machine-readable report."""
    values = {"id": F.col("finding_id"), "file": F.col("path"),
              "column": F.lit(None).cast("bigint"),
              "suggestedEnvVar": F.col("suggested_env_var"), "owaspReference": F.col("owasp"),
              "matchedPattern": F.col("matched_text")}
    return findings.select(*[values.get(f, F.col(f)).alias(f)
                             for f in REPORT_FIELDS])


def write_json_report(findings: DataFrame, path: str) -> DataFrame:
    """Write the report as JSON lines and return it as read back."""
    report = json_report(findings)
    report.write.mode("overwrite").json(path)
    return findings.sparkSession.read.schema(report.schema).json(path)
