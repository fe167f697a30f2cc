"""The single pass: every requested pack over every file, with no shuffle.

`scan_files` adds an array of hits to each file row. `explode_hits` turns hits into
finding rows. Only keys and findings leave the pass, never file texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.lines import NO_HITS, hit, hit_per_match
from ..functions.patterns import (Text, ascii_lower, flagged, quoted, shared_words,
                                  without_nel)
from ..rules.base import OTHER, PER_FILE, PER_MATCH, Pattern, Rule
from ..rules.catalog import FILE_PACKS, PACK_ORDER, rules_of
from ..rules.prompts import COMMENT_PREFIX
from ..schema import FINDING_COLUMNS
from ..session import constant_table
from .iac import docker_hits, workflow_hits
from .prompts import comment_hits
from .routes import route_hits
from .select import selected

_WORK = "_scan_"
_EXTRA_SELECTORS = {"prompts": ["prompts", "comments"], "iac": ["dockerfiles", "workflows"]}


def _condition(rule: Rule, text: Text) -> str:
    """SQL test of a rule, in the order written: cheap path tests first."""
    def on_path(pattern):
        return f"abs_path RLIKE {quoted(flagged(pattern))}"

    tests = [on_path(p) for p in rule.path_all] + [f"NOT {on_path(p)}" for p in rule.path_none]
    if rule.longer_than is not None:
        tests.append(f"length({text.text}) > {rule.longer_than}")
    tests += [text.matches(p) for p in rule.all_of]
    tests += [f"NOT {text.matches(p)}" for p in rule.none_of]
    return " AND ".join(tests)


def selectors_of(rule: Rule) -> list[str]:
    """The selectors whose files a rule looks at."""
    if rule.emits == COMMENT_PREFIX:
        return ["comments"]
    if rule.pack == "iac":
        return ["workflows" if rule.rule_id.startswith("gha_") else "dockerfiles"]
    return [rule.pack]


def _line(rule: Rule, text: Text):
    return text.first_line(rule.line) if isinstance(rule.line, Pattern) else rule.line


def _asked(packs, extra_rules, only) -> tuple[list[str], list[Rule]]:
    """The packs in report order and their rules, or the rules of `only` and their packs."""
    if only is not None:
        if any(r.emits == OTHER for r in only):
            raise ValueError("rules with an operator of their own run with their pack")
        packs = {r.pack for r in only}
    packs = [p for p in PACK_ORDER if p in set(packs) and p != "deps"]
    return packs, rules_of(packs, extra_rules) if only is None else list(only)


def scan_files(files: DataFrame, packs=FILE_PACKS, extra_rules=(), select=True,
               only=None) -> DataFrame:
    """Add `hits`, an array of rule hits in report order, to each file.

    `extra_rules` are further rules of the given packs; `only` lists rules to test in place of
    whole packs. With `select=False` every file is tested whatever its path (changed-file scans).
    """
    packs, rules = _asked(packs, extra_rules, only)
    number = {id(r): i for i, r in enumerate(rules)}
    by_pack = {p: [(number[id(r)], r) for r in rules if r.pack == p] for p in packs}
    keep = files.columns

    selectors = [s for p in packs for s in _EXTRA_SELECTORS.get(p, [p])]
    chosen = {s: f"{_WORK}in_{s}" for s in selectors}
    work = files.selectExpr(*keep, *[f"{selected(s) if select else 'true'} AS {c}"
                                     for s, c in chosen.items()])
    body, lower = _WORK + "text", _WORK + "lower"
    work = work.selectExpr("*", f"CASE WHEN {' OR '.join(chosen.values())} "
                                f"THEN {without_nel('content')} END AS {body}")
    work = work.selectExpr("*", f"{ascii_lower(body)} AS {lower}")
    words = shared_words([r for r in rules if r.emits == PER_FILE])
    plain = Text(body, lower)
    work = work.selectExpr("*", *[
        f"{lower} IS NOT NULL AND {plain.has_word(*key)} AS {_WORK}w{i}"
        for i, key in enumerate(words)])

    text = Text(body, lower, {key: f"{_WORK}w{i}" for i, key in enumerate(words)})
    parts = []
    for pack in packs:
        inside = chosen.get(pack)
        single = [(no, r) for no, r in by_pack[pack] if r.emits == PER_FILE]
        if single:
            cases = ", ".join(f"CASE WHEN {_condition(r, text)} THEN {hit(no, _line(r, text))} END"
                              for no, r in single)
            parts.append(f"CASE WHEN {inside} THEN array_compact(array({cases})) END")
        for no, r in by_pack[pack]:
            if r.emits == PER_MATCH:
                parts.append(f"CASE WHEN {inside} AND {plain.matches(r.all_of[0])} THEN "
                             f"{hit_per_match('content', r.all_of[0], no, r.match_chars)} END")
        numbers = {r.rule_id: no for no, r in by_pack[pack]}
        special = {}
        in_comments = [(no, r) for no, r in by_pack[pack] if r.emits == COMMENT_PREFIX]
        if in_comments:
            special["comments"] = comment_hits("content", in_comments)
        elif only is not None:
            pass
        elif pack == "iac":
            special["dockerfiles"] = docker_hits("content", numbers)
            special["workflows"] = workflow_hits("content", numbers)
        elif pack == "routes":
            special["routes"] = route_hits("content", numbers["route_no_auth"])
        parts += [f"CASE WHEN {chosen[s]} THEN {e} END" for s, e in special.items()]
    hits = f"flatten(array_compact(array({', '.join(parts)}))) AS hits" if parts \
        else f"{NO_HITS} AS hits"
    return work.selectExpr(*keep, hits)


def rule_table(spark: SparkSession, packs, extra_rules=(), only=None) -> DataFrame:
    """The rules as a small table keyed by `rule_no` (fixed size: the catalog)."""
    packs, rules = _asked(packs, extra_rules, only)
    # Position of a rule in its own pack, whatever packs are asked for.
    within = {id(r): n for p in packs for n, r in enumerate(r for r in rules if r.pack == p)}
    rows = [(i, r.pack, PACK_ORDER[r.pack], within[id(r)], r.rule_id, r.type, r.category,
             r.severity, r.title, r.env_var, r.remediation, r.best_practice, r.owasp_ref)
            for i, r in enumerate(rules)]
    return constant_table(spark, rows, (
        "rule_no int,pack string,pack_ord int,rule_ord int,rule_id string,type string,"
        "category string,severity string,title string,suggested_env_var string,"
        "remediation string,best_practice string,owasp string"))


def finding_id(*parts) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def explode_hits(scanned: DataFrame, packs=FILE_PACKS, extra_rules=(), keep=(),
                 hit_fields=(), only=None) -> DataFrame:
    """Finding rows of a scanned table.

    `keep` names further file columns to carry along, `hit_fields` further fields of a hit.
    """
    # The outer form keeps Catalyst from adding a "has hits" filter below the explode, which
    # would evaluate the whole catalog a second time.
    rows = scanned.select("repo_id", "path", *keep, F.explode_outer("hits").alias("h")) \
        .where("h IS NOT NULL").select("repo_id", "path", *keep, "h.*")
    return finding_rows(rows, rule_table(scanned.sparkSession, packs, extra_rules, only),
                        [*keep, *hit_fields])


def finding_rows(rows: DataFrame, rules: DataFrame, keep=()) -> DataFrame:
    """Findings of single hits, by joining the rules' own texts (fixed size: the catalog)."""
    return rows.join(F.broadcast(rules), "rule_no").select(
        *[c for c in FINDING_COLUMNS if c not in ("finding_id", "package")],
        finding_id("repo_id", "path", "rule_id", "match_ord").alias("finding_id"),
        F.lit(None).cast("string").alias("package"), "pack_ord", "rule_ord", *keep) \
        .select(*FINDING_COLUMNS, "pack_ord", "rule_ord", *keep)
