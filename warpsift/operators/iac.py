"""Container and workflow files, read line by line inside their own row.

A workflow is read into its entries first (see `workflow`), so only the permissions of the whole
workflow count, however the key is written, and not those of a job or words inside a script.
"""

from __future__ import annotations

from ..functions.lines import hit, lines_of
from ..functions.patterns import js_trim, quoted
from ..rules.iac import WRITE_ALL, WRITE_ALL_KEY, WRITE_ALL_TEXT
from .workflow import entries

_TRIMMED = js_trim("l")
_IS_USER = f"startswith(upper({_TRIMMED}), 'USER ')"
_IS_ROOT = f"element_at(split({_TRIMMED}, ' '), 2) IN ('root', '0')"
_PIPED = f"contains({_TRIMMED}, 'curl ') AND contains({_TRIMMED}, '| bash')"


def _hit_lines(text: str, rule_no: int, test: str) -> str:
    numbers = f"array_compact(transform({lines_of(text)}, (l, i) -> if({test}, i + 1, NULL)))"
    return f"transform({numbers}, (n, k) -> {hit(rule_no, 'n', 'k')})"


def docker_hits(text: str, numbers: dict[str, int]) -> str:
    leaves_root = f"exists({lines_of(text)}, l -> {_IS_USER} AND NOT {_IS_ROOT})"
    return (f"concat({_hit_lines(text, numbers['docker_root'], f'{_IS_USER} AND {_IS_ROOT}')}, "
            f"{_hit_lines(text, numbers['curl_bash'], _PIPED)}, "
            f"array_compact(array(if({leaves_root}, NULL, "
            f"{hit(numbers['docker_implicit'], 1)}))))")


def workflow_hits(text: str, numbers: dict[str, int]) -> str:
    at = (f"array_position(transform({lines_of(text)}, "
          f"l -> contains(l, {quoted(WRITE_ALL_TEXT)})), true)")
    told = f"contains({text}, '{WRITE_ALL_KEY}') AND contains({text}, '{WRITE_ALL}')"
    top = f"e.path = '{WRITE_ALL_KEY}' AND e.value = '{WRITE_ALL}'"
    return (f"CASE WHEN {told} THEN CASE WHEN exists({entries(text)}, e -> {top}) "
            f"THEN array({hit(numbers['gha_write_all'], f'greatest({at}, 1)')}) END END")
