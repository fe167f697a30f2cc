"""Counts, grades and gates over findings.

Every aggregation here combines rows before its shuffle, so a repository, pack or file
with a large share of all findings costs no more than any other. Functions that report
on repositories take a `repos` table as well, so that clean ones appear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import quoted
from ..rules.base import CRITICAL, HIGH, MEDIUM, SEVERITIES
from ..rules.catalog import (DASHBOARD_PACKS, JSON_REPORT_PACKS, PACK_ORDER, REQUIRED_FILES,
                             SCANS)
from ..session import constant_table
from .env import ENV, GITIGNORE
from .joins import lookup_join
from .select import selected


def of_packs(findings: DataFrame, packs) -> DataFrame:
    return findings.where(F.col("pack").isin(list(packs)))


def quiet(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == CRITICAL)


def explain_candidates(findings: DataFrame) -> DataFrame:
    """Findings worth an explanation: critical and high ones."""
    return findings.where(F.col("severity").isin(CRITICAL, HIGH))


def fixable(findings: DataFrame) -> DataFrame:
    """Findings that name a file and a line (line 0 counts as none)."""
    return findings.where("path IS NOT NULL AND line > 0")


def _count(severity):
    return F.count_if(F.col("severity") == severity).cast("bigint")


def _severities():
    return [_count(s).alias(s) for s in SEVERITIES]


def _total():
    return F.count("*").cast("bigint").alias("total")


def _per_repo(findings: DataFrame, repos: DataFrame, *aggregates) -> DataFrame:
    """Aggregates per repository, null for repositories without findings.

    Both sides are one row per repository when they meet.
    """
    return repos.select("repo_id").distinct().join(
        findings.groupBy("repo_id").agg(*aggregates), "repo_id", "left")


def _zero(name):
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def category_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pack", "category").agg(F.count("*").cast("bigint").alias("findings"))


def pack_severity(findings: DataFrame, packs=SCANS) -> DataFrame:
    """none, critical, high or medium per pack; low findings alone count as medium."""
    per_pack = findings.groupBy("pack").agg(
        F.max(F.col("severity") == CRITICAL).alias("_c"),
        F.max(F.col("severity") == HIGH).alias("_h"))
    return _all_packs(findings, packs).join(F.broadcast(per_pack), "pack", "left").select(
        "pack", F.when(F.col("_c").isNull(), "none").when(F.col("_c"), CRITICAL)
        .when(F.col("_h"), HIGH).otherwise(MEDIUM).alias("severity"))


def _all_packs(df: DataFrame, packs) -> DataFrame:
    return constant_table(df.sparkSession, [(p,) for p in packs], "pack string")


def scans_performed(findings: DataFrame, packs=JSON_REPORT_PACKS) -> DataFrame:
    """Findings per pack, zeros kept. One row per pack is at most fifteen rows."""
    per_pack = findings.groupBy("pack").agg(F.count("*").alias("findings"))
    return _all_packs(findings, packs).join(F.broadcast(per_pack), "pack", "left").select(
        "pack", _zero("findings"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(_total(), *_severities())


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count("*").cast("bigint").alias("findings"))


def file_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id", "path").agg(F.count("*").cast("bigint").alias("findings"))


def report_rollup(findings: DataFrame) -> DataFrame:
    """Total and breakdowns by severity, type and file in one aggregation."""
    rolled = findings.groupingSets(
        [[], ["severity"], ["type"], ["repo_id", "path"]], "severity", "type", "repo_id",
        "path").agg(F.grouping_id().alias("_g"), F.count("*").cast("bigint").alias("findings"))
    # One bit per column, set where the column is rolled up.
    level = F.when(F.col("_g") == 0b1111, "total").when(F.col("_g") == 0b0111, "severity") \
        .when(F.col("_g") == 0b1011, "type").otherwise("file")
    return rolled.select(level.alias("level"), "severity", "type", "repo_id", "path", "findings")


def overall_status(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """fail with a critical finding, warning with a high one, else pass."""
    done = _per_repo(of_packs(findings, JSON_REPORT_PACKS), repos, _total(), *_severities())
    return done.select("repo_id", *[_zero(c) for c in ("total", *SEVERITIES)],
                       F.when(F.col(CRITICAL) > 0, "fail").when(F.col(HIGH) > 0, "warning")
                       .otherwise("pass").alias("status"))


def grade_of(total: str):
    """A+ for none, then A below 5, B below 15, C below 30, else F."""
    n = F.col(total)
    return F.when(n == 0, "A+").when(n < 5, "A").when(n < 15, "B").when(n < 30, "C") \
        .otherwise("F")


def security_grade(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """The grade of each repository by its number of findings."""
    return _per_repo(findings, repos, _total()).select("repo_id", _zero("total")).select(
        "repo_id", "total", grade_of("total").alias("grade"))


def release_gate(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Blocked by any critical finding of any scan."""
    return _per_repo(findings, repos, F.max(F.col("severity") == CRITICAL).alias("blocked")) \
        .select("repo_id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def commit_gate(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Blocked by any critical or high finding; `findings` come from changed files."""
    done = _per_repo(findings, repos, _total(), _count(CRITICAL).alias(CRITICAL),
                     _count(HIGH).alias(HIGH))
    return done.select("repo_id", *[_zero(c) for c in ("total", CRITICAL, HIGH)],
                       (F.coalesce(F.col(CRITICAL) + F.col(HIGH), F.lit(0)) > 0).alias("blocked"))


def assessment(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """excellent without findings, critical with a critical one, else warning."""
    done = _per_repo(of_packs(findings, JSON_REPORT_PACKS), repos, _total(),
                     _count(CRITICAL).alias(CRITICAL))
    return done.select("repo_id", _zero("total"),
                       F.when(F.col("total").isNull(), "excellent")
                       .when(F.col(CRITICAL) > 0, "critical").otherwise("warning")
                       .alias("assessment"))


def dashboard_tiles(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Critical, high and all remaining findings per repository."""
    done = _per_repo(of_packs(findings, DASHBOARD_PACKS), repos, _total(),
                     _count(CRITICAL).alias(CRITICAL), _count(HIGH).alias(HIGH))
    rest = F.col("total") - F.col(CRITICAL) - F.col(HIGH)
    return done.withColumn("rest", rest).select(
        "repo_id", *[_zero(c) for c in (CRITICAL, HIGH, "rest")])


def dashboard_table(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """One row per finding with its repository's grade and tiles.

    The per-repository table is broadcast only if it is small; else the findings of very
    large repositories are spread over several tasks.
    """
    facts = security_grade(findings, repos).join(dashboard_tiles(findings, repos), "repo_id") \
        .withColumnRenamed("total", "repo_total")
    rows = of_packs(findings, DASHBOARD_PACKS).select(
        "repo_id", "finding_id", "severity", "title", "path", "line", "category", "owasp",
        "mitre", "nist", "remediation")
    return lookup_join(rows, facts, ["repo_id"])


def required_files_check(files: DataFrame) -> DataFrame:
    """ok, missing or optional per repository and expected file; warns if .gitignore does
    not list the environment file."""
    has = [F.max(F.col("path") == p).alias(f"_{i}") for i, (p, _) in enumerate(REQUIRED_FILES)]
    # Presence comes from the paths; the only texts read are those of .gitignore.
    unlisted = files.where(F.col("path") == GITIGNORE).groupBy("repo_id").agg(
        F.expr(f"max(NOT contains(content, '{ENV}'))").alias("_unlisted"))
    facts = files.groupBy("repo_id").agg(*has).join(unlisted, "repo_id", "left").withColumn(
        "_open", F.coalesce("_unlisted", F.lit(False)))
    rows = ", ".join(
        f"named_struct('path', '{p}', 'required', {str(need).lower()}, "
        f"'status', CASE WHEN _{i} THEN 'ok' ELSE '{'missing' if need else 'optional'}' END, "
        f"'warning', {'_open' if p == GITIGNORE else 'false'})"
        for i, (p, need) in enumerate(REQUIRED_FILES))
    return facts.selectExpr("repo_id", f"inline(array({rows}))")


# (condition on a finding, priority, title, advice); the wording is our own.
RECOMMENDATIONS = (
    ("type = 'hardcoded-secret'", CRITICAL, "Manage secrets outside the code",
     "Move every secret to the environment or a vault."),
    ("category = 'sql-injection'", CRITICAL, "Stop SQL injection",
     "Bind values instead of joining strings."),
    ("type = 'xss'", HIGH, "Stop script injection", "Clean or escape what users supply."),
    ("type = 'authentication'", HIGH, "Improve sign-in",
     "Hash passwords, limit attempts, expire tokens."),
    ("type = 'database-security'", HIGH, "Secure the database",
     "Encrypt connections and narrow access."),
    (None, MEDIUM, "Keep up general hygiene", "Headers, origins, logs, updates and training."),
)


def recommendations(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Advice that applies to a repository; the last item always does."""
    tests = [F.expr(f"max({test})").alias(f"_{i}")
             for i, (test, *_) in enumerate(RECOMMENDATIONS) if test]
    facts = _per_repo(of_packs(findings, JSON_REPORT_PACKS), repos, *tests)
    items = ", ".join(
        f"CASE WHEN {f'_{i}' if test else 'true'} THEN named_struct('position', {i + 1}, "
        f"'priority', '{priority}', 'title', {quoted(title)}, 'advice', {quoted(advice)}) END"
        for i, (test, priority, title, advice) in enumerate(RECOMMENDATIONS))
    return facts.selectExpr("repo_id", f"inline(array_compact(array({items})))")


def _listed(findings: DataFrame, column: str) -> DataFrame:
    """`a:3,b:1` per repository: as many entries as the catalog has values of the column."""
    counts = findings.groupBy("repo_id", column).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(column, "n")))
    return counts.groupBy("repo_id").agg(F.array_join(F.transform(
        entries, lambda e: F.concat(e[column], F.lit(":"), e["n"].cast("string"))), ",")
        .alias("text"))


def json_summary(findings: DataFrame, repos: DataFrame, generated: str) -> DataFrame:
    """The report's record of each repository: when, how many, of what, and what to do.

    The findings themselves are rows beside it (`sinks.json_report`), keyed by repository.
    """
    advice = recommendations(findings, repos).groupBy("repo_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "priority", "title"))),
        lambda e: F.concat(e["position"].cast("string"), F.lit(". ["), e["priority"],
                           F.lit("] "), e["title"])), "; ").alias("recommendations"))
    scans = _listed(findings, "pack").withColumnRenamed("text", "scans")
    kinds = _listed(findings, "type").withColumnRenamed("text", "types")
    return overall_status(findings, repos).withColumn("generated", F.lit(generated)).join(
        scans, "repo_id", "left").join(kinds, "repo_id", "left").join(
        advice, "repo_id", "left").na.fill("", ["scans", "types"])


def prompt_files_scanned(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(
        F.expr(f"count_if({selected('prompts')})").cast("bigint").alias("prompt_files"))


def threat_coverage(findings: DataFrame) -> DataFrame:
    """Files and repositories hit per threat; threats without a hit show zero."""
    from ..rules.matrix import THREAT_ROWS

    threat = F.split_part("rule_id", F.lit("/"), F.lit(1))
    # One row per threat and file first: that is what spreads over the cluster.
    per_file = findings.where(F.col("pack") == "matrix").select(
        threat.alias("threat"), "repo_id", "path").distinct()
    per_repo = per_file.groupBy("threat", "repo_id").agg(F.count("*").alias("_files"))
    hit = per_repo.groupBy("threat").agg(F.sum("_files").alias("files"),
                                         F.count("*").alias("repos"))
    threats = constant_table(findings.sparkSession, THREAT_ROWS, (
        "threat string,name string,severity string,category string,owasp string,patterns int"))
    return threats.join(F.broadcast(hit), "threat", "left").select(
        *threats.columns, _zero("files"), _zero("repos"))


def pack_ord():
    """Order of a pack in reports, as a column over `pack`."""
    return F.coalesce(*[F.when(F.col("pack") == p, i) for p, i in PACK_ORDER.items()])
