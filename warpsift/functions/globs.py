"""File globs as regular expressions over repository-relative paths.

Wildcards do not match names that begin with a dot unless the glob names the dot;
ignore globs do. The expressions avoid look-around, so any engine can run them.
"""

from __future__ import annotations

import re

_SPECIAL = re.compile(r"([.^$+(){}\[\]|\\])")


def _segment(text: str, dot: bool) -> str:
    out = []
    for piece in re.split(r"(\*|\{[^}]*\})", text):
        if piece == "*":
            out.append(piece)
        elif piece.startswith("{"):
            out.append("(?:" + "|".join(_SPECIAL.sub(r"\\\1", p)
                                        for p in piece[1:-1].split(",")) + ")")
        elif piece:
            out.append(_SPECIAL.sub(r"\\\1", piece))
    if out and out[0] == "*" and not dot:
        rest = out[1:]
        # A leading star may be empty only if what follows is no dot either.
        must = not rest or rest[0].startswith("\\.")
        out = ["[^/.][^/]*" if must else "(?:[^/.][^/]*)?"] + rest
    return "".join("[^/]*" if piece == "*" else piece for piece in out)


def glob_regex(glob: str, dot: bool = False) -> str:
    """Regular expression (without anchors) of one glob."""
    name = "[^/]+" if dot else "[^/.][^/]*"
    parts = glob.split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append(f"(?:{name}/)*" + (name if last else ""))
        else:
            out.append(_segment(part, dot) + ("" if last else "/"))
    return "".join(out)


def any_glob(globs, dot: bool = False) -> str:
    """One anchored expression for a list of globs."""
    return "^(?:" + "|".join(glob_regex(g, dot) for g in globs) + ")$"
