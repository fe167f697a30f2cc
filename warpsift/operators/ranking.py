"""Ranked views of findings. Order: scan, repository, path, rule, match."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lines import lines_of
from ..rules.base import CRITICAL, HIGH, MEDIUM, SEVERITY_RANK
from ..rules.catalog import FIXER_PACKS, JSON_REPORT_PACKS
from .reports import of_packs
from .scan import explode_hits, scan_files

ORDER = ["pack_ord", "repo_id", "path", "rule_ord", "match_ord"]


def severity_rank():
    return F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()])


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Critical first, report order within; a range-partitioned sort, no single task."""
    return of_packs(findings, JSON_REPORT_PACKS).orderBy(severity_rank(), *ORDER)


def top_categories(findings: DataFrame, shown=5) -> DataFrame:
    """The first categories of each pack in first-seen order, and how many more there are.

    Findings collapse to one row per pack and category before any ranking, so the window
    runs over catalog-sized data.
    """
    seen = F.struct("repo_id", "path", "rule_ord", "match_ord")
    counts = findings.groupBy("pack", "category").agg(
        F.count("*").cast("bigint").alias("findings"), F.min(seen).alias("_first"))
    window = Window.partitionBy("pack").orderBy("_first", "category")
    ranked = counts.withColumns({
        "position": F.row_number().over(window),
        "_all": F.count("*").over(Window.partitionBy("pack"))})
    return ranked.where(F.col("position") <= shown).select(
        "pack", "category", "findings", "position",
        F.greatest(F.col("_all") - shown, F.lit(0)).cast("bigint").alias("more"))


def remediation_queue(findings: DataFrame, high=10, medium=5) -> DataFrame:
    """Every critical finding, the first ten high and five medium ones, and the remainders.

    The short lists are distributed top-k selections; critical findings are never ranked,
    so none of this gathers an unbounded group.
    """
    reported = of_packs(findings, JSON_REPORT_PACKS)
    caps = {HIGH: high, MEDIUM: medium}
    columns = ["severity", "repo_id", "path", "line", "rule_id", "remediation"]

    def listed(rows):
        return rows.select(F.lit("finding").alias("kind"), *columns,
                           F.lit(1).cast("bigint").alias("findings"))

    queue = listed(reported.where(F.col("severity") == CRITICAL))
    for severity, cap in caps.items():
        first = reported.where(F.col("severity") == severity).orderBy(*ORDER).limit(cap)
        queue = queue.unionByName(listed(first))
    counts = reported.where(F.col("severity").isin(*caps)).groupBy("severity") \
        .agg(F.count("*").alias("_n"))
    left_over = F.col("_n") - F.when(F.col("severity") == HIGH, high).otherwise(medium)
    more = counts.where(left_over > 0).select(
        F.lit("more").alias("kind"), "severity", left_over.cast("bigint").alias("findings"))
    return queue.unionByName(more, allowMissingColumns=True)


def context_window(files: DataFrame, packs=FIXER_PACKS, around=5) -> DataFrame:
    """Critical and high findings that name a line, with the lines around it.

    The lines come from the file's own row; texts are never shuffled.
    """
    scanned = scan_files(files, packs).selectExpr(
        "repo_id", "path", f"{lines_of('content')} AS _lines",
        "filter(hits, h -> h.line > 0) AS hits")
    first = f"greatest(h.line - {around}, 1)"
    text = (f"array_join(slice(_lines, CAST({first} AS INT), "
            f"CAST(h.line + {around} + 1 - {first} AS INT)), '\\n')")
    shown = scanned.selectExpr(
        "repo_id", "path", "transform(hits, h -> named_struct('rule_no', h.rule_no, "
        "'line', h.line, 'match_ord', h.match_ord, 'matched_text', h.matched_text, "
        f"'first_line', {first}, 'context', {text})) AS hits")
    rows = explode_hits(shown, packs, hit_fields=("first_line", "context"))
    return rows.where(F.col("severity").isin(CRITICAL, HIGH)).select(
        "repo_id", "path", "rule_id", "match_ord", "line", "first_line", "context")


def fix_order(files: DataFrame, packs=FIXER_PACKS) -> DataFrame:
    """Position of each fixable finding in its file: bottom line first, then report order.

    The hits of a file are sorted inside its row, so no window and no shuffle is needed.
    """
    scanned = scan_files(files, packs).selectExpr(
        "repo_id", "path",
        "array_sort(transform(filter(hits, h -> h.line > 0), h -> named_struct("
        "'up', -h.line, 'rule_no', h.rule_no, 'match_ord', h.match_ord, 'line', h.line, "
        "'matched_text', h.matched_text))) AS _sorted")
    placed = scanned.selectExpr(
        "repo_id", "path", "transform(_sorted, (h, i) -> named_struct('rule_no', h.rule_no, "
        "'line', h.line, 'match_ord', h.match_ord, 'matched_text', h.matched_text, "
        "'position', CAST(i + 1 AS BIGINT))) AS hits")
    return explode_hits(placed, packs, hit_fields=("position",)).select(
        "repo_id", "path", "rule_id", "match_ord", "line", "position")
