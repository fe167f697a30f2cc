"""Version ranges of manifests as sorted disjoint intervals of sortable texts.

`^1.2.3`, `~1.2`, `1.x`, `>=1.2 <2`, `1.2 - 2.3`, `1 || 3.x`, exact versions and pre-releases
become arrays of [lo, hi) over version keys. A key is three numbers of nine digits, then `~` for
a release, or `!` and the identifiers of a pre-release, so keys sort as versions do: a release
above its pre-releases, numbers below words. Upper bounds that come from a release lie below its
pre-releases; pre-releases inside an interval count as inside. Tags (`latest`), addresses and
anything else that is no range give null: nothing is guessed.

All of it is one SQL expression, with no Python per row.
"""

from __future__ import annotations

from .patterns import quoted

INTERVALS = "array<struct<lo: string, hi: string>>"
#: Below and above every key.
FIRST, BEYOND = "", ":"
_NUMBER = r"(\d{1,9}|[xX*])"
_COMPARATOR = (rf"^(>=|<=|>|<|=|\^|~>|~)?[v=]*(?:{_NUMBER}(?:\.{_NUMBER})?(?:\.{_NUMBER})?"
               r"(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)$")
_AFTER = "chr(1)"  # below every character of a key: what follows it directly


def _key(a: str, b: str, c: str, end: str) -> str:
    return f"concat(lpad({a}, 9, '0'), lpad({b}, 9, '0'), lpad({c}, 9, '0'), {end})"


def _more(number: str) -> str:
    return f"CAST(CAST({number} AS BIGINT) + 1 AS STRING)"


def _parts(c: str) -> str:
    """SQL: a comparator's operator, numbers (null: missing or x) and pre-release."""
    def group(n):
        return f"regexp_extract({c}, {quoted(_COMPARATOR)}, {n})"

    def number(n):
        return f"CASE WHEN {group(n)} RLIKE '^[0-9]' THEN {group(n)} END"

    ids = ("array_join(transform(split(nullif({0}, ''), '[.]'), x -> CASE WHEN x RLIKE "
           "'^[0-9]{{1,20}}$' THEN concat('0', lpad(x, 20, '0')) ELSE concat('1', x) END), ' ')")
    return (f"named_struct('op', {group(1)}, 'a', {number(2)}, 'b', {number(3)}, "
            f"'c', {number(4)}, 'pre', {ids.format(group(5))})")


def _interval(p: str) -> str:
    """SQL: [lo, hi) of a comparator's parts; an `x` hides the numbers behind it."""
    a, b = f"{p}.a", f"{p}.b"
    full = f"({p}.b IS NOT NULL AND {p}.c IS NOT NULL)"
    minor, patch = f"coalesce({p}.b, '0')", f"CASE WHEN {full} THEN {p}.c ELSE '0' END"
    pre = f"({full} AND {p}.pre IS NOT NULL)"
    point = _key(a, minor, patch, f"CASE WHEN {pre} THEN concat('!', {p}.pre) ELSE '~' END")
    floor = _key(a, minor, patch, f"CASE WHEN {pre} THEN concat('!', {p}.pre) ELSE '!' END")

    def bumped(end):  # the first version behind a partial one
        return (f"CASE WHEN {b} IS NULL THEN {_key(_more(a), quoted('0'), quoted('0'), end)} "
                f"ELSE {_key(a, _more(b), quoted('0'), end)} END")

    major = _key(_more(a), "'0'", "'0'", "'!'")
    caret = (f"CASE WHEN CAST({a} AS BIGINT) > 0 OR {b} IS NULL THEN {major} "
             f"WHEN CAST({b} AS BIGINT) > 0 OR NOT {full} THEN "
             f"{_key(a, _more(b), quoted('0'), quoted('!'))} "
             f"ELSE {_key(a, b, _more(f'{p}.c'), quoted('!'))} END")
    lo = (f"CASE WHEN {a} IS NULL THEN CASE WHEN {p}.op IN ('<', '>') THEN '{BEYOND}' "
          f"ELSE '{FIRST}' END WHEN {p}.op IN ('<', '<=') THEN '{FIRST}' "
          f"WHEN {p}.op = '>' THEN CASE WHEN {full} THEN concat({point}, {_AFTER}) "
          f"ELSE {bumped(quoted('~'))} END ELSE {point} END")
    hi = (f"CASE WHEN {a} IS NULL OR {p}.op IN ('>', '>=') THEN '{BEYOND}' "
          f"WHEN {p}.op = '<' THEN {floor} WHEN {p}.op = '^' THEN {caret} "
          f"WHEN {p}.op IN ('~', '~>') OR NOT {full} THEN {bumped(quoted('!'))} "
          f"ELSE concat({point}, {_AFTER}) END")
    return f"named_struct('lo', {lo}, 'hi', {hi})"


def intervals(text: str) -> str:
    """SQL: the intervals of a range, sorted and disjoint; null if it is no range."""
    spans = quoted(r"^\s*(\S+)\s+-\s+(\S+)\s*$")
    glued = quoted(r"(>=|<=|>|<|=|\^|~>|~)\s+")
    pieces = (f"filter(split(regexp_replace(regexp_replace(alt, {spans}, '>=$1 <=$2'), {glued}, "
              r"'$1'), '\\s+'), c -> c != '')")
    each = (f"transform(split({text}, '\\\\|\\\\|'), alt -> CASE WHEN btrim(alt) = '' "
            f"THEN array('*') ELSE {pieces} END)")
    valid = f"forall(alts, cs -> forall(cs, c -> c RLIKE {quoted(_COMPARATOR)}))"
    bounds = (f"transform(cs, c -> {_parts('c')})")
    meet = ("named_struct('lo', array_max(transform(ps, p -> p.lo)), "
            "'hi', array_min(transform(ps, p -> p.hi)))")
    found = (f"transform(alts, cs -> transform(array(transform({bounds}, p -> {_interval('p')})), "
             f"ps -> {meet})[0])")
    merged = (f"aggregate(array_sort(filter({found}, i -> i.lo < i.hi)), "
              f"CAST(array() AS {INTERVALS}), (s, i) -> CASE "
              "WHEN size(s) > 0 AND i.lo <= element_at(s, -1).hi THEN array_append("
              "slice(s, 1, size(s) - 1), named_struct('lo', element_at(s, -1).lo, "
              "'hi', greatest(element_at(s, -1).hi, i.hi))) ELSE array_append(s, i) END)")
    return (f"transform(array({each}), alts -> CASE WHEN {valid} THEN {merged} END)[0]")
