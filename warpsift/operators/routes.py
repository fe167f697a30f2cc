"""Route handlers that change data and never look at the caller.

A text is read as one list of its calls of the form `x.post(path, handler` with an inline handler,
brackets, strings, comments, line ends and telling words. A fold over that list keeps a stack of
the calls that are open: a call is put on it with the depth of brackets it stands at, and taken
off at the bracket that brings the text back to that depth. What is read belongs to the innermost
open call, so a handler inside a handler is judged by itself, and a look at the caller inside it
says nothing about the outer one. Strings, template strings and comments are passed over whole.

Limit: a quote inside a regular expression literal can hide the rest of its line.
"""

from __future__ import annotations

from ..functions.lines import hit
from ..functions.patterns import NEWLINE, quoted
from ..rules.routes import ROUTE_METHODS, WRITE_METHODS

_METHODS = "|".join(ROUTE_METHODS)
HANDLER = (r"(?:async\s*)?(?:function\s*[\w$]*\s*\([^()]*\)"
           r"|\([^()]*\)\s*(?::[^=(){}]*)?=>|[A-Za-z_$][\w$]*\s*=>)")
FIRST_ARGUMENT = r"""(?:'[^'\n]*'|"[^"\n]*"|`[^`]*`|[^,()'"`]+)"""
CALL = rf"\.(?:{_METHODS})\s*\(\s*{FIRST_ARGUMENT}\s*,\s*{HANDLER}"
HEAD = rf"(?:(?<![\w$])[A-Za-z_$][\w$]*+\s*+)?{CALL}"
_WRITES = r"\.(?:" + "|".join(WRITE_METHODS) + r")\s*\("
_SKIPPED = r"""'[^'\n]*'|"[^"\n]*"|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/"""
READS_CALLER = r"(?<![\w$.])req\.user(?![\w$])"


def token(head: str = HEAD, reads: str = READS_CALLER) -> str:
    """The pattern of all that is read."""
    return rf"{_SKIPPED}|{head}|{_WRITES}|{reads}|,\s*\)|[(){{}}\[\],\n]"


TOKEN = token()

# What a token does, by its first and last characters.
_SKIPS = "left(t, 1) IN ('\"', '`', '/') OR startswith(t, '\\'')"
_HEADS = f"NOT ({_SKIPS}) AND (endswith(t, '=>') OR (right(t, 1) = ')' AND left(t, 1) NOT IN (')', ',')))"
_CLOSES = "(left(t, 1) IN (')', ']', '}') OR (left(t, 1) = ',' AND length(t) > 1))"
_OPENS = "t IN ('(', '[', '{')"
_CALLS = "array<struct<at: int, line: bigint, k: bigint, writes: boolean, guarded: boolean>>"
_TOP = "element_at(s.open, -1)"
_BELOW = "slice(s.open, 1, size(s.open) - 1)"


def _state(depth="s.depth", line="s.line", k="s.k", open_="s.open", done="s.done") -> str:
    return (f"named_struct('depth', {depth}, 'line', {line}, 'k', {k}, 'open', {open_}, "
            f"'done', {done})")


def _noted(field: str) -> str:
    """The stack with a fact about its innermost call."""
    facts = {"writes": f"{_TOP}.writes", "guarded": f"{_TOP}.guarded"} | {field: "true"}
    return (f"CASE WHEN size(s.open) > 0 THEN array_append({_BELOW}, named_struct("
            f"'at', {_TOP}.at, 'line', {_TOP}.line, 'k', {_TOP}.k, "
            f"'writes', {facts['writes']}, 'guarded', {facts['guarded']})) ELSE s.open END")


def handlers(text: str) -> str:
    """SQL: the calls with inline handlers in their order: line, number, what their own code does."""
    lines = f"(length(t) - length(replace(t, {NEWLINE}, '')))"
    after = f"(s.line + {lines})"
    opened = ("array_append(s.open, named_struct('at', s.depth, 'line', s.line, 'k', s.k, "
              "'writes', false, 'guarded', false))")
    ends = f"(size(s.open) > 0 AND {_TOP}.at >= s.depth - 1)"
    third = f"(size(s.open) > 0 AND s.depth = {_TOP}.at + 1)"
    step = f"""CASE
        WHEN {_SKIPS} OR t = {NEWLINE} THEN {_state(line=after)}
        WHEN {_HEADS} THEN {_state('s.depth + 1', after, 's.k + 1', opened)}
        WHEN {_OPENS} THEN {_state('s.depth + 1')}
        WHEN left(t, 1) = '.' THEN {_state('s.depth + 1', after, open_=_noted('writes'))}
        WHEN left(t, 1) = 'r' THEN {_state(open_=_noted('guarded'))}
        WHEN t = ',' THEN CASE WHEN {third} THEN {_state(open_=_noted('guarded'))} ELSE s END
        WHEN {_CLOSES} AND {ends} THEN {_state('s.depth - 1', after, open_=_BELOW,
                                              done=f'array_append(s.done, {_TOP})')}
        WHEN {_CLOSES} THEN {_state('s.depth - 1', after)}
        ELSE s END"""
    empty = f"CAST(array() AS {_CALLS})"
    return f"""aggregate(regexp_extract_all({text}, {quoted(TOKEN)}, 0),
        named_struct('depth', 0, 'line', 1L, 'k', 0L, 'open', {empty}, 'done', {empty}),
        (s, t) -> {step},
        s -> array_sort(concat(s.done, s.open), (a, b) -> CAST(a.k - b.k AS INT)))"""


def route_hits(text: str, rule_no: int) -> str:
    def has(words):
        return "(" + " OR ".join(f"contains({text}, '.{w}')" for w in words) + ")"

    bad = f"filter({handlers(text)}, c -> c.writes AND NOT c.guarded)"
    return (f"CASE WHEN {has(ROUTE_METHODS)} AND {has(WRITE_METHODS)} "
            f"AND {text} RLIKE {quoted(CALL)} "
            f"THEN transform({bad}, c -> {hit(rule_no, 'c.line', 'c.k')}) END")
