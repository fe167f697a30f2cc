"""Line-wise SQL expressions on whole texts. Lines end at a newline only, counted from 1."""

from __future__ import annotations

from ..rules.base import Pattern
from ..schema import HIT
from .patterns import NEWLINE, find_all, linear_regex, quoted, without_nel

# Two code points Unicode reserves for private marking inside a program.
_MARK, _OTHER = chr(0xFDD0), chr(0xFDD1)
NO_HITS = f"CAST(array() AS array<{HIT}>)"


def lines_of(text: str) -> str:
    return f"split({text}, {NEWLINE})"


def hit(rule_no: int, line, match_ord="0", matched="NULL") -> str:
    return (f"named_struct('rule_no', {rule_no}, "
            f"'line', CAST({'NULL' if line is None else line} AS BIGINT), "
            f"'match_ord', CAST({match_ord} AS BIGINT), "
            f"'matched_text', CAST({matched} AS STRING))")


def hit_per_match(text: str, pattern: Pattern, rule_no: int, chars: int | None) -> str:
    """Array of hits, one per match; the pattern must not span lines."""
    # The test first: collecting matches may go back over a line, the test does not.
    found = (f"flatten(array_compact(transform({lines_of(text)}, (line, i) -> "
             f"CASE WHEN {without_nel('line')} RLIKE {quoted(linear_regex(pattern))} THEN "
             f"transform({find_all('line', pattern)}, "
             f"m -> named_struct('line', i + 1, 'm', m)) END)))")
    matched = "x.m" if chars is None else f"left(x.m, {chars})"
    return f"transform({found}, (x, k) -> {hit(rule_no, 'x.line', 'k', matched)})"


def match_lines(text: str, regex: str) -> str:
    """Array with the line each match of `regex` starts on; matches may span lines."""
    marked = (f"regexp_replace(replace({text}, '{_MARK}', '{_OTHER}'), {quoted(regex)}, "
              f"'{_MARK}$0')")
    return (f"flatten(transform(split({marked}, {NEWLINE}), (line, i) -> array_repeat("
            f"CAST(i + 1 AS BIGINT), length(line) - length(replace(line, '{_MARK}', '')))))")
