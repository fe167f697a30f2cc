"""The entries of a workflow file: key paths and plain values, without a parser library.

A fold over lines keeps a stack of the keys that are open, by their indentation. It reads block
maps and lists, quoted keys and values, tags and anchors, comments, block texts (passed over),
values that begin on the next line, and flow maps on one line. An entry is (path, value, line);
path elements are joined by dots, list items add `[]`. What is no workflow gives few or no entries.
"""

from __future__ import annotations

from ..functions.patterns import NEWLINE, quoted

ENTRIES = "array<struct<path: string, value: string, line: bigint>>"
_KEY = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'#{\[&*!|>%@`,?-][^:#]*?|-[^\s:#][^:#]*?))\s*:(?:\s+(.*)|$)"""
_COMMENT = r"""^((?:"[^"]*"|'[^']*'|[^"'#]|(?<!\s)#|["'])*?)(?:(?<=\s)|^)#.*$"""
_MARKS = r"^(?:[&!][^\s]*\s*)+"
_PAIR = r"""(?:^|[{,])\s*(?:"([^"]*)"|'([^']*)'|([^\s{}\[\],:"']+))\s*:\s+([^{},]*)"""
_STACK = "array<struct<indent: int, key: string>>"


def _bare(value: str) -> str:
    """A value without tags, anchors and quotes."""
    plain = f"btrim(regexp_replace({value}, {quoted(_MARKS)}, ''))"
    return f"regexp_replace({plain}, {quoted(r'''^(["'])(.*)\1$''')}, '$2')"


def _group(text: str, pattern: str, *groups: int) -> str:
    """The first of several groups that is there."""
    found = [f"nullif(regexp_extract({text}, {quoted(pattern)}, {g}), '')" for g in groups]
    return f"coalesce({', '.join(found)}, '')"


def _path(stack: str, more: str = "array()") -> str:
    return (f"array_join(concat(transform({stack}, x -> x.key), CAST({more} AS array<string>)), "
            "'.')")


def entries(text: str) -> str:
    """SQL: the entries of a text, in its order."""
    start = (f"named_struct('stack', CAST(array() AS {_STACK}), 'block', -1, 'waits', false, "
             f"'line', 0L, 'out', CAST(array() AS {ENTRIES}))")
    # A line in four steps: its indentation and body, list marks taken off, its key and value,
    # and the stack that the line stands on.
    indent = "length(l) - length(ltrim(l))"
    body = f"btrim(regexp_replace(regexp_replace(l, '\\r', ''), {quoted(_COMMENT)}, '$1'))"
    dashes = "regexp_extract(y.body, '^(?:-\\\\s+|-$)+', 0)"
    key = _group("z.rest", f"^{_KEY}", 1, 2, 3)
    value = f"coalesce(btrim(regexp_extract(z.rest, {quoted(f'^{_KEY}')}, 4)), '')"
    shorter = "filter(s.stack, x -> x.indent < z.indent)"
    items = ("CASE WHEN z.dashes > 0 THEN array(named_struct('indent', z.indent, 'key', '[]')) "
             f"ELSE CAST(array() AS {_STACK}) END")
    placed = f"concat({shorter}, {items})"
    keyed = (f"concat(v.stack, array(named_struct('indent', z.indent + z.dashes, 'key', v.key)))")
    none = f"CAST(array() AS {ENTRIES})"
    marked = f"regexp_replace(v.value, {quoted(_MARKS)}, '')"

    def flow(map_, stack):
        key_of = _group("p", _PAIR, 1, 2, 3)
        return (f"transform(regexp_extract_all({map_}, {quoted(_PAIR)}, 0), p -> named_struct("
                f"'path', {_path(stack, f'array({key_of})')}, "
                f"'value', {_bare(_group('p', _PAIR, 4))}, 'line', s.line + 1))")

    def one(stack, value_):
        return (f"array(named_struct('path', {_path(stack)}, 'value', {_bare(value_)}, "
                "'line', s.line + 1))")

    def state(stack, block, waits, found):
        return (f"named_struct('stack', {stack}, 'block', {block}, 'waits', {waits}, "
                f"'line', s.line + 1, 'out', concat(s.out, {found}))")

    is_block = f"{marked} RLIKE '^[|>]'"
    with_key = state(
        keyed, f"CASE WHEN {is_block} THEN z.indent + z.dashes ELSE -1 END", f"{marked} = ''",
        f"CASE WHEN {marked} = '' OR {is_block} THEN {none} "
        f"WHEN startswith({marked}, '{{') THEN {flow(marked, keyed)} "
        f"ELSE {one(keyed, 'v.value')} END")
    without_key = state(
        "CASE WHEN s.waits AND z.dashes = 0 THEN s.stack ELSE v.stack END", "-1", "false",
        f"CASE WHEN startswith(z.rest, '{{') THEN {flow('z.rest', 'v.stack')} "
        f"WHEN z.dashes > 0 THEN {one('v.stack', 'z.rest')} "
        "WHEN s.waits AND size(s.stack) > 0 AND z.indent > element_at(s.stack, -1).indent "
        f"THEN {one('s.stack', 'z.rest')} ELSE {none} END")
    skipped = ("named_struct('stack', s.stack, 'block', s.block, 'waits', s.waits, "
               "'line', s.line + 1, 'out', s.out)")
    reset = (f"named_struct('stack', CAST(array() AS {_STACK}), 'block', -1, 'waits', false, "
             "'line', s.line + 1, 'out', s.out)")

    def let(name, expr, inner):
        return f"transform(array({expr}), {name} -> {inner})[0]"

    step = let("y", f"named_struct('indent', {indent}, 'body', {body})", (
        f"CASE WHEN y.body = '' OR (s.block >= 0 AND y.indent > s.block) THEN {skipped} "
        f"WHEN y.body RLIKE '^(?:---|[.][.][.])(?:\\\\s|$)' AND y.indent = 0 THEN {reset} ELSE "
        + let("z", f"named_struct('indent', y.indent, 'dashes', length({dashes}), "
                   f"'rest', substr(y.body, length({dashes}) + 1))",
              let("v", f"named_struct('key', {key}, 'value', {value}, 'stack', {placed})",
                  f"CASE WHEN z.rest RLIKE {quoted(f'^{_KEY}')} THEN {with_key} "
                  f"ELSE {without_key} END")) + " END"))
    return f"aggregate(split({text}, {NEWLINE}), {start}, (s, l) -> {step}, s -> s.out)"
