"""Which stored files a rule can hit, from the trigram index alone.

A rule is compiled to a test over index rows: its selector and path tests, its least length, and
for each pattern that must match the words that any match holds. Words that must be absent say
nothing here: a set bit does not prove a word. Files that pass are candidates; only their texts
are read, and the rule itself decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.patterns import flagged, plan, quoted
from ..rules.base import PER_FILE, PER_MATCH, Pattern, Rule
from ..rules.prompts import COMMENT_PREFIX
from ..sources.trigrams import holds
from .scan import selectors_of
from .select import selected


def _any(tests: list[str]) -> str:
    return "true" if "true" in tests else "(" + " OR ".join(dict.fromkeys(tests)) + ")"


def may_match(pattern: Pattern) -> str:
    """SQL over index rows: can the pattern match anywhere in the text?"""
    fixed, rest = plan(pattern)
    tests = [holds(w) for w in fixed]
    for needs, _ in rest:
        each = [t for t in (_any([holds(w) for w in words]) for words in needs) if t != "true"]
        tests.append("(" + " AND ".join(each) + ")" if each else "true")
    return _any(tests)


def may_hit(rule: Rule) -> str:
    """SQL over index rows: can the rule hit the file?"""
    tests = [_any([selected(s) for s in selectors_of(rule)])]
    tests += [f"abs_path RLIKE {quoted(flagged(p))}" for p in rule.path_all]
    tests += [f"NOT abs_path RLIKE {quoted(flagged(p))}" for p in rule.path_none]
    if rule.longer_than is not None:
        tests.append(f"chars > {rule.longer_than}")
    if rule.emits in (PER_FILE, PER_MATCH, COMMENT_PREFIX):
        tests += [may_match(p) for p in rule.all_of]
    return "(" + " AND ".join(t for t in tests if t != "true") + ")"


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """Keys of the files that any of the rules can hit."""
    return index.where(_any([may_hit(r) for r in rules])).select("repo_part", "repo_id", "path")
