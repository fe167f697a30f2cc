"""Comments that instruct a code assistant."""

from __future__ import annotations

from ..functions.lines import hit, match_lines
from ..functions.patterns import (NOT_EOL, Text, ascii_lower, find_all, flagged, quoted,
                                  without_nel)
from ..rules.prompts import COMMENTS, MATCH_CHARS

OPENER = r"(?i)(?://|/\*|#)\s*(?:AI|GPT|Claude|Copilot|Cursor)"


def comments(text: str) -> str:
    """Array of (line, words) of all such comments: line, block, then hash comments."""
    parts = []
    for pattern in COMMENTS:
        words = (f"zip_with({find_all(text, pattern, 1)}, {find_all(text, pattern)}, "
                 "(inner, whole) -> if(inner = '', whole, inner))")
        parts.append(f"zip_with({match_lines(text, flagged(pattern, NOT_EOL))}, {words}, "
                     "(line, words) -> named_struct('line', line, 'words', words, "
                     f"'tested', {without_nel('words')}, 'lowered', {ascii_lower('words')}))")
    return f"concat({', '.join(parts)})"


def comment_hits(text: str, rules) -> str:
    """`rules` are (rule_no, rule) pairs; each is tried once per comment."""
    words = Text("c.tested", "c.lowered")
    tried = ", ".join(
        f"CASE WHEN {words.matches(r.all_of[0])} "
        f"THEN {hit(no, 'c.line', 'k', f'left(c.words, {MATCH_CHARS})')} END"
        for no, r in rules)
    # Structs sort by rule, then line; hits of one rule keep the order of comments by line.
    return (f"CASE WHEN {text} RLIKE {quoted(OPENER)} THEN array_sort(flatten(transform("
            f"{comments(text)}, (c, k) -> array_compact(array({tried}))))) END")
