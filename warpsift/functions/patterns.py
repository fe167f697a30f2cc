"""Catalog patterns as Spark SQL expressions.

The catalog writes patterns in the ECMAScript dialect. `Text.matches` turns one into a
boolean expression over whole texts that means the same but costs far less than
running the pattern on every text:

* a branch that stands for a few fixed words becomes `contains` tests;
* any other branch is guarded by `contains` tests of the words it cannot do without;
* `a.*b.*c` is matched line by line without going back, so time stays linear in
  the length of a line (minified files have lines of megabytes).

Expressions are SQL text with literal patterns: Catalyst sees ordinary built-in
functions, and a catalog of rules is one parse instead of thousands of calls from Python.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

from ..rules.base import Pattern

_TOKEN = re.compile(r"\[\^?(?:\\.|[^\]\\])*\]|\\.|\(\?:|\(\?!|.", re.S)
_SPACES = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_LINE_SPACES = _SPACES.replace(r"\n", "")
NOT_EOL = r"[^\n\r\u2028\u2029]"
_WORD_EDGE = (r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
JS_TRIM = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + \
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
_MAX_WORDS = 12


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _cut(parts: list[str], at) -> list[list[str]]:
    """Cut a token list at the top-level places where `at(i)` gives a width."""
    out, depth, i, start = [], 0, 0, 0
    while i < len(parts):
        width = at(parts, i) if depth == 0 else 0
        if width:
            out.append(parts[start:i])
            i += width
            start = i
            continue
        depth += parts[i].startswith("(") - (parts[i] == ")")
        i += 1
    return out + [parts[start:]]


def branches(text: str) -> list[str]:
    """Top-level alternatives; a group around the whole pattern is opened."""
    out = []
    for cut in _cut(tokens(text), lambda p, i: int(p[i] == "|")):
        branch = "".join(cut)
        inner = re.match(r"^\((?:\?:)?(.*)\)$", branch, re.S)
        if inner and not branch.startswith("(?!") and _balanced(inner.group(1)):
            out += branches(inner.group(1))
        else:
            out.append(branch)
    return out


def _balanced(text: str) -> bool:
    depth = 0
    for t in tokens(text):
        depth += t.startswith("(") - (t == ")")
        if depth < 0:
            return False
    return depth == 0


def same_line_parts(branch: str) -> list[str]:
    """The pieces between the top-level `.*` of a branch."""
    def dots(p, i):
        if p[i] != "." or i + 1 >= len(p) or p[i + 1] != "*":
            return 0
        return 3 if i + 2 < len(p) and p[i + 2] == "?" else 2
    return ["".join(p) for p in _cut(tokens(branch), dots)]


def java(text: str, one_line: bool = False, dot: str = ".") -> str:
    """The pattern for Java's engine; with `one_line` no match can span lines.

    Java's dot differs from the catalog's in one character, NEL. Tests run on texts without
    it (see `without_nel`), where the fast dot is right; else pass `dot=NOT_EOL`.
    """
    spaces = _LINE_SPACES if one_line else _SPACES
    out = []
    for t in tokens(text):
        if t == ".":
            out.append(dot)
        elif t == r"\s":
            out.append(f"[{spaces}]")
        elif t == r"\S":
            out.append(f"[^{_SPACES}]")
        elif t == r"\b":
            out.append(_WORD_EDGE)
        elif t.startswith("["):
            if t == r"[\s\S]":
                out.append(r"[^\n]" if one_line else r"[\s\S]")
            else:
                body = t.replace(r"\s", spaces)
                if one_line and t.startswith("[^"):
                    body = body[:2] + r"\n" + body[2:]
                out.append(body)
        else:
            out.append(t)
    return "".join(out)


# ---- a pattern as a tree ------------------------------------------------------------

_QUANTIFIER = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "0": "\0"}


def _literal(token: str) -> str | None:
    """The character a token stands for, if it is a single one."""
    if len(token) == 1:
        return None if token in ".^$|()" else token
    if token[0] == "\\" and len(token) == 2:
        if token[1] in _CONTROLS:
            return _CONTROLS[token[1]]
        return None if token[1].isalnum() else token[1]
    return None


def _class(token: str):
    """A set of characters: its members if they are single characters, else nothing is known."""
    members, body = [], tokens(token[1:-1].replace("[", "\\["))
    if token.startswith("[^") or any(t == "-" for t in body[1:-1]):
        return "IN", None
    for t in body:
        char = t if len(t) == 1 else _literal(t)
        if char is None:
            return "IN", None
        members.append(char)
    return ("LITERAL", members[0]) if len(members) == 1 else ("IN", members)


def _repeated(parts: list[str], i: int) -> tuple[int, int | None, int]:
    """The least and the greatest count of a quantifier at `i`, and where it ends."""
    text = "".join(parts[i:i + 12])
    found = _QUANTIFIER.match(text)
    if not found:
        return 1, 1, i
    mark = found[0]
    width = len(mark) + (text[len(mark):len(mark) + 1] in ("?", "+"))
    if mark in "*+?":
        low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[mark]
    else:
        low, _, rest = mark[1:-1].partition(",")
        low, high = int(low), int(rest) if rest else (None if "," in mark else int(low))
    return low, high, i + width


def tree_of(parts: list[str]) -> list[tuple]:
    """Items in their order: LITERAL, IN, GROUP (trees of its alternatives), REPEAT, OTHER."""
    out, i = [], 0
    while i < len(parts):
        t = parts[i]
        if t in ("(", "(?:", "(?!"):
            depth, end = 1, i + 1
            while depth:
                depth += parts[end].startswith("(") - (parts[end] == ")")
                end += 1
            inner = _cut(parts[i + 1:end - 1], lambda p, k: int(p[k] == "|"))
            item = ("OTHER", None) if t == "(?!" else ("GROUP", [tree_of(b) for b in inner])
            i = end
        else:
            char = _literal(t)
            item = ("LITERAL", char) if char is not None else _class(t) if t[0] == "[" \
                else ("OTHER", None)
            i += 1
        low, high, i = _repeated(parts, i)
        out.append(item if (low, high) == (1, 1) else ("REPEAT", (low, high, [item])))
    return out


# ---- words a pattern stands for, or cannot do without ------------------------------

def _words(tree) -> list[str] | None:
    """All texts a tree stands for, or None if there are too many."""
    out = [""]
    for kind, arg in tree:
        if kind == "LITERAL":
            step = [arg]
        elif kind == "GROUP":
            parts = [_words(b) for b in arg]
            step = None if None in parts else list(itertools.chain(*parts))
        elif kind == "IN":
            step = arg
        elif kind == "REPEAT" and arg[:2] == (0, 1):
            step = _words(arg[2])
            step = None if step is None else ["", *step]
        else:
            step = None
        if step is None or len(step) * len(out) > _MAX_WORDS:
            return None
        out = [a + b for a in out for b in step]
    return out


def _needs(tree) -> list[tuple[str, ...]]:
    """Word lists; each match contains at least one word of every list."""
    out, run = [], ""
    for kind, arg in [*tree, (None, None)]:
        if kind == "LITERAL":
            run += arg
            continue
        if len(run) > 1:
            out.append((run,))
        run = ""
        if kind == "GROUP":
            words = _words([(kind, arg)])
            if words and min(map(len, words)) > 1:
                out.append(tuple(words))
            elif len(arg) == 1:
                out += _needs(arg[0])
            else:
                best = [max(_needs(b), key=lambda w: min(map(len, w)), default=None)
                        for b in arg]
                if None not in best:
                    out.append(tuple(itertools.chain(*best)))
        elif kind == "REPEAT" and arg[0] > 0:
            out += _needs(arg[2])
    return out


def linear(branch: str, one_line: bool = False) -> str:
    """One branch as an expression that never goes back over a line."""
    parts = [java(p, one_line) for p in same_line_parts(branch)]
    if len(parts) == 1:
        return parts[0]
    return "(?m)^" + "".join(f"(?>.*?(?:{p}))" for p in parts if p)


def linear_regex(pattern: Pattern) -> str:
    """The whole pattern as such an expression, for a single line of text."""
    return ("(?i)" if pattern.ignore_case else "") + "|".join(
        f"(?:{linear(b, one_line=True)})" for b in branches(pattern.text))


@lru_cache(maxsize=None)
def plan(pattern: Pattern):
    """Fixed words of the pattern, and (needed words, expression) of every other branch."""
    fold = str.lower if pattern.ignore_case else str
    out, fixed = [], []
    for branch in branches(pattern.text):
        tree = tree_of(tokens(branch))
        words = _words(tree)
        if words and min(map(len, words)) > 1:
            fixed += [fold(w) for w in words]
            continue
        needs = [tuple(dict.fromkeys(fold(w) for w in ws)) for ws in _needs(tree)]
        out.append((tuple(dict.fromkeys(needs)),
                    ("(?i)" if pattern.ignore_case else "") + linear(branch)))
    return tuple(dict.fromkeys(fixed)), tuple(out)


def quoted(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


NEWLINE = quoted("\n")


def flagged(pattern: Pattern, dot: str = ".") -> str:
    return ("(?i)" if pattern.ignore_case else "") + java(pattern.text, dot=dot)


def without_nel(text: str) -> str:
    """The text with NEL replaced by another character that no pattern names."""
    return f"replace({text}, '{chr(0x85)}', '{chr(0xac)}')"


class Text:
    """A text without NEL, its lower-case twin and the word tests shared between rules."""

    def __init__(self, text: str, lowered: str, shared: dict | None = None):
        self.text, self.lowered, self.shared = text, lowered, shared or {}

    def has_word(self, word: str, ignore_case: bool) -> str:
        known = self.shared.get((word, ignore_case))
        if known:
            return known
        test = f"contains({self.lowered if ignore_case else self.text}, {quoted(word)})"
        # A shared word inside this one must be there too, and its test is free.
        inner = max((w for w, case in self.shared if case == ignore_case and w in word),
                    key=len, default=None)
        return f"({self.shared[inner, ignore_case]} AND {test})" if inner else test

    def _any_word(self, words, ignore_case) -> str:
        # A word that contains another one of the list adds nothing.
        words = [w for w in words if not any(v != w and v in w for v in words)]
        return "(" + " OR ".join(self.has_word(w, ignore_case) for w in words) + ")"

    def matches(self, pattern: Pattern) -> str:
        """Whether the pattern matches anywhere in the text."""
        fixed, rest = plan(pattern)
        found = [self._any_word(fixed, pattern.ignore_case)] if fixed else []
        for needs, regex in rest:
            tests = [self._any_word(words, pattern.ignore_case) for words in needs]
            found.append("(" + " AND ".join([*tests, f"{self.text} RLIKE {quoted(regex)}"]) + ")")
        return "(" + " OR ".join(found) + ")"

    def first_line(self, pattern: Pattern) -> str:
        """1-based number of the first line the pattern matches within, else null."""
        lines = f"split({self.text}, {NEWLINE})"
        if any(len(same_line_parts(b)) > 1 for b in branches(pattern.text)):
            found = f"transform({lines}, l -> l RLIKE {quoted(linear_regex(pattern))})"
            return f"nullif(array_position({found}, true), 0)"
        upto = f"^(?s:.)*?(?:{java(pattern.text, one_line=True)})"
        upto = quoted(("(?i)" if pattern.ignore_case else "") + upto)
        return (f"array_size(split(nullif(regexp_extract({self.text}, {upto}, 0), ''), "
                f"{NEWLINE}))")


def ascii_lower(text: str) -> str:
    """Lower case for word tests: no other character may turn into an ASCII letter."""
    # The Kelvin sign and the dotted capital i are the only two that would.
    return f"lower(replace(replace({text}, '{chr(0x212a)}', ' '), '{chr(0x130)}', ' '))"


def shared_words(rules) -> list[tuple[str, bool]]:
    """Words that open the test of more than one rule: worth testing once per text."""
    uses: dict[tuple[str, bool], int] = {}
    for rule in rules:
        seen = set()
        for pattern in rule.all_of[:1]:
            fixed, rest = plan(pattern)
            seen |= {(w, pattern.ignore_case) for w in fixed}
            for needs, _ in rest:
                seen |= {(w, pattern.ignore_case) for ws in needs[:1] for w in ws}
        for key in seen:
            uses[key] = uses.get(key, 0) + 1
    return [key for key, n in uses.items() if n > 1]


def find_all(text: str, pattern: Pattern, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {quoted(flagged(pattern, NOT_EOL))}, {group})"


def js_trim(text: str) -> str:
    return f"btrim({text}, {quoted(JS_TRIM)})"
