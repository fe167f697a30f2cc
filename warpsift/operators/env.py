"""Environment files: format checks inside the row, repository checks by one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lines import lines_of
from ..functions.patterns import NOT_EOL, java, js_trim, quoted
from ..rules.catalog import PACK_ORDER
from ..rules.env import (ISSUE_KEY, ISSUE_QUOTES, ISSUE_SPACES, KEY_FORM, PACK, QUOTED, SPACED,
                         UNQUOTED)
from ..schema import FINDING_COLUMNS
from .scan import finding_id

ENV, SAMPLE, GITIGNORE = ".env", ".env.example", ".gitignore"
_RULES = {r.rule_id: (i, r) for i, r in enumerate(PACK.rules)}


def _rx(pattern: str) -> str:
    return quoted(java(pattern, one_line=True, dot=NOT_EOL))


_FIRST_SPACED = quoted("^" + java(r"([^=]*?)\s*=\s*", one_line=True, dot=NOT_EOL))
_FIRST_VALUE = quoted("^" + java(r"([^=]*)=(.*)", one_line=True, dot=NOT_EOL))


def format_issues(text: str) -> str:
    """SQL: array of (line, issue, suggestion) of an environment file."""
    def issue(test, name, suggestion):
        return (f"CASE WHEN {test} THEN named_struct('line', CAST(x.i AS BIGINT), "
                f"'issue', {quoted(name)}, 'suggestion', {suggestion}) END")

    checks = ", ".join([
        issue(f"NOT x.l RLIKE {_rx(KEY_FORM)}", ISSUE_KEY, "x.l"),
        issue(f"x.l RLIKE {_rx(SPACED)}", ISSUE_SPACES,
              f"regexp_replace(x.l, {_FIRST_SPACED}, '$1=')"),
        issue(f"x.l RLIKE {_rx(UNQUOTED)} AND NOT x.l RLIKE {_rx(QUOTED)}", ISSUE_QUOTES,
              f"regexp_replace(x.l, {_FIRST_VALUE}, '$1=\"$2\"')")])
    numbered = (f"transform({lines_of(text)}, (l, i) -> "
                f"named_struct('i', i + 1, 'l', {js_trim('l')}))")
    return (f"flatten(transform(filter({numbered}, x -> x.l != '' AND NOT startswith(x.l, '#')),"
            f" x -> array_compact(array({checks}))))")


def dotenv_lines(files: DataFrame) -> DataFrame:
    """Trimmed lines of each repository's environment file."""
    return files.where(F.col("path") == ENV).selectExpr(
        "repo_id", f"posexplode({lines_of('content')}) AS (i, l)") \
        .selectExpr("repo_id", "CAST(i + 1 AS BIGINT) AS line", f"{js_trim('l')} AS text")


def env_issues(files: DataFrame) -> DataFrame:
    return files.where(F.col("path") == ENV).selectExpr(
        "repo_id", f"inline({format_issues('content')})")


def env_file_stats(files: DataFrame) -> DataFrame:
    """Lines, valid entries and issues; each repository has one such file at most."""
    lines = lines_of("content")
    return files.where(F.col("path") == ENV).selectExpr(
        "repo_id", f"CAST(size({lines}) AS BIGINT) AS total_lines",
        f"CAST(size(filter({lines}, l -> {js_trim('l')} RLIKE {_rx(KEY_FORM)})) AS BIGINT)"
        " AS valid_entries",
        f"CAST(size({format_issues('content')}) AS BIGINT) AS issues")


def env_config_status(files: DataFrame) -> DataFrame:
    """Which environment files a repository has, from the paths; texts of .gitignore only."""
    there = files.groupBy("repo_id").agg(
        F.expr(f"max(path = '{ENV}')").alias("env_exists"),
        F.expr(f"max(path = '{SAMPLE}')").alias("env_example_exists"))
    listed = files.where(F.col("path") == GITIGNORE).groupBy("repo_id").agg(
        F.expr(f"max(contains(content, '{ENV}'))").alias("_listed"))
    return there.join(listed, "repo_id", "left").select(
        "repo_id", "env_exists", F.coalesce("_listed", F.lit(False)).alias("env_in_gitignore"),
        "env_example_exists", F.col("env_exists").alias("has_validation"))


def file_facts(numbers: list[int]) -> list:
    """What the repository rules need of a scanned file; `numbers`: the pack's rule numbers."""
    mine = f"h.rule_no IN ({', '.join(map(str, numbers))})" if numbers else "false"
    return [F.expr(f"path = '{GITIGNORE}' AND contains(content, '{ENV}')").alias("_ignored"),
            F.expr(f"CASE WHEN path = '{ENV}' THEN size({format_issues('content')}) END")
            .alias("_issues"), F.expr(f"size(filter(hits, h -> {mine}))").alias("_env_hits")]


def env_repo_findings(passed: DataFrame) -> DataFrame:
    """The four repository-level findings, from the facts of all files of a pass."""
    facts = passed.groupBy("repo_id").agg(
        F.expr(f"max(path = '{ENV}')").alias("env_exists"), F.max("_ignored").alias("ignored"),
        F.expr(f"max(path = '{SAMPLE}')").alias("sample"),
        F.coalesce(F.max("_issues"), F.lit(0)).alias("n_issues"),
        F.sum("_env_hits").alias("n_hits")).na.fill({"ignored": False})
    cases = [("gitignore_missing", "NOT ignored", GITIGNORE),
             ("no_env_example", "NOT sample", SAMPLE),
             ("env_missing", "NOT env_exists AND n_hits > 0", ENV),
             ("env_format", "n_issues > 0", ENV)]
    rows = []
    for rule_id, test, path in cases:
        number, r = _RULES[rule_id]
        title = quoted(r.title) if rule_id != "env_format" \
            else "concat(CAST(n_issues AS STRING), ' formatting issue(s) in the environment file')"
        rows.append(f"CASE WHEN {test} THEN named_struct('rule_id', '{rule_id}', 'path', '{path}',"
                    f"'category', '{r.category}', 'severity', '{r.severity}', 'title', {title},"
                    f"'remediation', {quoted(r.remediation)}, 'rule_ord', {number}) END")
    found = facts.selectExpr("repo_id", f"inline(array_compact(array({', '.join(rows)})))")
    empty = {c: F.lit(None).cast("string") for c in
             ("matched_text", "suggested_env_var", "best_practice", "package")}
    return found.withColumns({
        **empty, "pack": F.lit("env"), "type": F.lit(PACK.type), "line": F.lit(None).cast("bigint"),
        "match_ord": F.lit(0).cast("bigint"), "owasp": F.lit(PACK.rules[0].owasp_ref),
        "pack_ord": F.lit(PACK_ORDER["env"])}) \
        .withColumn("finding_id", finding_id("repo_id", "path", "rule_id", "match_ord")) \
        .select(*FINDING_COLUMNS, "pack_ord", "rule_ord")
