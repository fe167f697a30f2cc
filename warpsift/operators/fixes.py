"""Proposed line fixes. The result is a new table; sources are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lines import lines_of
from ..functions.patterns import quoted
from ..rules.catalog import FIXER_PACKS, rules_of
from .scan import explode_hits, scan_files

MARKER = " // fixed by warpsift"
_FIRST_LITERAL = quoted(r"""(?s)^(.*?)['"`][^'"`]+['"`]""")
_FIRST_MARKUP = quoted(r"(?s)^(.*?)innerHTML")


def apply_fixes(files: DataFrame, packs=FIXER_PACKS) -> DataFrame:
    """New content of each file that can be fixed, and the number of fixes made.

    Secrets on a line with an equals sign: the first quoted text becomes a read of the
    suggested variable. Raw markup in prompts: innerHTML becomes textContent. Several
    findings on one line apply one after the other, in report order.
    """
    packs = [p for p in FIXER_PACKS if p in set(packs)]
    rules = rules_of(packs)
    env_vars = {i: r.env_var for i, r in enumerate(rules) if r.env_var}
    markup = [i for i, r in enumerate(rules) if r.category == "xss-risk"]
    numbers = ", ".join(map(str, [*env_vars, *markup])) or "NULL"
    var = "CASE f.rule_no " + " ".join(
        f"WHEN {i} THEN '$1process.env.{v}'" for i, v in env_vars.items()) + " END"

    # Only the two kinds of rule that can change a line take part, each line folds its own.
    fixed = (f"CASE WHEN f.rule_no IN ({', '.join(map(str, env_vars)) or 'NULL'}) "
             f"AND contains(s.text, '=') THEN regexp_replace(s.text, {_FIRST_LITERAL}, {var}) "
             f"WHEN f.rule_no IN ({', '.join(map(str, markup)) or 'NULL'}) "
             f"THEN regexp_replace(s.text, {_FIRST_MARKUP}, '$1textContent') ELSE s.text END")
    step = (f"(s, f) -> named_struct('text', CASE WHEN {fixed} != s.text "
            f"THEN concat({fixed}, {quoted(MARKER)}) ELSE s.text END, "
            f"'fixes', s.fixes + CASE WHEN {fixed} != s.text THEN 1L ELSE 0L END)")
    folded = (f"transform(_lines, (l, i) -> CASE WHEN array_contains(_at, i + 1) THEN aggregate("
              f"filter(_fixes, f -> f.line = i + 1), named_struct('text', l, 'fixes', 0L), {step})"
              f" ELSE named_struct('text', l, 'fixes', 0L) END)")
    scanned = scan_files(files, packs).selectExpr(
        "repo_id", "path", "content",
        f"array_sort(filter(hits, h -> h.line > 0 AND h.rule_no IN ({numbers}))) AS _fixes")
    fixed = scanned.selectExpr(
        "repo_id", "path", f"CASE WHEN size(_fixes) > 0 THEN {lines_of('content')} END AS _lines",
        "_fixes", "array_distinct(transform(_fixes, f -> CAST(f.line AS INT))) AS _at") \
        .selectExpr("repo_id", "path", f"{folded} AS _new") \
        .selectExpr("repo_id", "path", "_new", "aggregate(_new, 0L, (a, n) -> a + n.fixes) AS _n")
    # Rows pass through an outer inline rather than a filter: Catalyst would push a filter
    # down to the scan and evaluate the rules twice.
    return fixed.selectExpr(
        "inline_outer(CASE WHEN _n > 0 THEN array(named_struct('repo_id', repo_id, 'path', path, "
        "'content', array_join(transform(_new, n -> n.text), '\\n'), 'fixes', _n)) END)") \
        .where("fixes IS NOT NULL")


def fix_summary(fixed: DataFrame) -> DataFrame:
    return fixed.agg(F.coalesce(F.sum("fixes"), F.lit(0)).cast("bigint").alias("fixes_applied"),
                     F.count("*").cast("bigint").alias("files_fixed"))


def fix_lines(files: DataFrame, packs=FIXER_PACKS) -> DataFrame:
    """Findings that name a line, with the text of that line.

    The line is taken inside the file's own row, where the finding arises: texts are not
    joined and not shuffled.
    """
    scanned = scan_files(files, packs).selectExpr(
        "repo_id", "path", f"{lines_of('content')} AS _lines",
        "filter(hits, h -> h.line > 0) AS hits")
    lined = scanned.selectExpr(
        "repo_id", "path", "transform(hits, h -> named_struct('rule_no', h.rule_no, "
        "'line', h.line, 'match_ord', h.match_ord, 'matched_text', h.matched_text, "
        "'text', element_at(_lines, CAST(h.line AS INT)))) AS hits")
    return explode_hits(lined, packs, hit_fields=("text",)).select(
        "repo_id", "path", "line", "rule_id", "match_ord", "text")
