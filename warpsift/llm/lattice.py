"""The cheapest edits that turn a row of chat roles into a well-formed conversation.

A conversation is written as one letter per row: the class of its role (system, user, assistant,
other) and its fault (none, cut off, blank, repeated). The edit lattice has a node for each row
boundary and state of the grammar `(s?(ua)+)?`:

    0 nothing yet    1 after a system row    2 after a user row    3 after an assistant row

Edges: Delete a row (3), Keep it (0) or Rerole it to what the state waits for (2), both 1 dearer
for a row that is cut off and closed to blank and repeated ones, Insert an empty row of the role
that the state waits for (2). A letter leads from a node to one other node, so audits are read
off node by node.

`solve` searches from both ends: a heap of costs from the entry and one from the exits grow level
by level until their levels add up to the least cost found. Then each cheapest path has an edge
from a node that the forward search has finished to one that the backward search has finished;
all such crossings are marked back to the entry, and the walk along them takes the least letter
wherever several are left.

A long conversation is cut into segments. `through` gives the cheapest cost from each state
before a segment to each state after it; with those, `exits` of every segment are known from the
end, and each segment is solved by itself for the state that the one before it ends in.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

CLASSES, FAULTS = "suao", "-tbd"  # other roles; none, truncated, blank, duplicate
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
STATES = 4
#: The state after a kept row of each class.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: The state after a row of the role that a state waits for.
FILL = (2, 2, 3, 2)
WAITS = ("u", "u", "a", "u")
#: What it costs to end in each state, and the rows inserted for it.
CLOSING, CLOSED_BY = (0, 4, 2, 0), ("", "ua", "a", "")
NEVER = 1 << 60


def letter(kind: str, fault: str) -> str:
    return chr(97 + 4 * CLASSES.index(kind) + FAULTS.index(fault))


#: By letter: the class, the price of leaving the row in (None: it must go).
ROWS = {letter(c, f): (c, {"-": 0, "t": TRUNCATED}.get(f)) for c in CLASSES for f in FAULTS}
FAULT_OF = {letter(c, f): f for c in CLASSES for f in FAULTS}
LEGAL = {"su", "ua", "au"}


def _onward(rows: str, node: int) -> list[tuple[str, int, int]]:
    """Edges of a node, least letter first: letter, price, next node."""
    i, s = divmod(node, STATES)
    if i == len(rows):
        return []
    kind, stays = ROWS[rows[i]]
    below = node + STATES
    out = [("D", DELETE, below), ("I", INSERT, node - s + FILL[s])]
    if stays is not None:
        if s in STEP[kind]:
            out.append(("K", stays, below - s + STEP[kind][s]))
        out.append(("R", REROLE + stays, below - s + FILL[s]))
    return out


_BEFORE_FILL = tuple([s for s in range(STATES) if FILL[s] == t] for t in range(STATES))
_BEFORE_STEP = {k: tuple([s for s, n in to.items() if n == t] for t in range(STATES))
                for k, to in STEP.items()}


def _back(rows: str, node: int) -> list[tuple[int, int]]:
    """Edges into a node: price, node that they come from."""
    i, s = divmod(node, STATES)
    out = []
    if i < len(rows):
        out += [(INSERT, node - s + p) for p in _BEFORE_FILL[s]]
    if i:
        kind, stays = ROWS[rows[i - 1]]
        above = node - s - STATES
        out.append((DELETE, above + s))
        if stays is not None:
            out += [(stays, above + p) for p in _BEFORE_STEP[kind][s]]
            out += [(REROLE + stays, above + p) for p in _BEFORE_FILL[s]]
    return out


class _Side:
    """One search: costs so far, nodes that are final, all nodes up to cost `level` done."""

    def __init__(self, starts: list[tuple[int, int]]):
        self.cost = {node: c for c, node in starts}
        self.heap = sorted(starts)
        self.final: list[int] = []
        self.level = -1

    def grow(self, edges, other: _Side, best: int) -> int:
        """Finish the next level of cost; the least cost of a path seen so far."""
        if not self.heap:
            self.level = NEVER
            return best
        self.level = self.heap[0][0]
        while self.heap and self.heap[0][0] == self.level:
            c, node = heapq.heappop(self.heap)
            if c > self.cost[node]:
                continue
            self.cost[node] = c
            self.final.append(node)
            best = min(best, c + other.cost.get(node, NEVER))
            for price, to in edges(node):
                if c + price < self.cost.get(to, NEVER):
                    self.cost[to] = c + price
                    heapq.heappush(self.heap, (c + price, to))
                    best = min(best, c + price + other.cost.get(to, NEVER))
        return best


def solve(rows: str, entry: int = 0, exits: tuple[int, ...] = CLOSING) -> tuple[int, str, int]:
    """Least cost, the edits of the least audit, and the state at the end.

    In the edits an inserted row is `u` or `a`, a row reroled to user or assistant `U` or `A`.
    """
    ahead = _Side([(0, entry)])
    behind = _Side([(c, STATES * len(rows) + s) for s, c in enumerate(exits) if c < NEVER])

    def out(node):
        return [e[1:] for e in _onward(rows, node)]

    def back(node):
        return _back(rows, node)

    best = min(NEVER, behind.cost.get(entry, NEVER))
    while ahead.level + behind.level < best and (ahead.heap or behind.heap):
        if behind.heap and (not ahead.heap or len(behind.heap) < len(ahead.heap)):
            best = behind.grow(back, ahead, best)
        else:
            best = ahead.grow(out, behind, best)

    def near_exit(node):
        # What it costs to end at a node behind the last row is known without a search.
        return node >= STATES * len(rows) or behind.cost.get(node, NEVER) <= behind.level

    # Nodes of the forward search that lie on a cheapest path, from the crossings back.
    useful = set()
    for node in sorted(ahead.final, key=lambda v: (ahead.cost[v], v // STATES), reverse=True):
        c = ahead.cost[node]
        if near_exit(node) and c + behind.cost.get(node, NEVER) == best or any(
                near_exit(to) and c + price + behind.cost.get(to, NEVER) == best
                or to in useful and c + price == ahead.cost[to] for price, to in out(node)):
            useful.add(node)

    edits, node, c = [], entry, 0
    while True:
        i, s = divmod(node, STATES)
        if i == len(rows):
            return best, "".join(edits), s
        for name, price, to in _onward(rows, node):
            if near_exit(to) and c + price + behind.cost.get(to, NEVER) == best \
                    or to in useful and c + price == ahead.cost[to]:
                break
        edits.append({"I": WAITS[s], "R": WAITS[s].upper()}.get(name, name))
        node, c = to, c + price


@lru_cache(maxsize=1 << 15)
def solve_short(rows: str) -> tuple[int, str, int]:
    return solve(rows)


def through(rows: str) -> list[list[int]]:
    """The cheapest cost from each state before the rows to each state after them."""
    out = []
    for entry in range(STATES):
        now = [NEVER] * STATES
        now[entry] = 0
        for r in rows:
            kind, stays = ROWS[r]
            for _ in range(2):  # two inserts lead to every state that inserts lead to
                for s in range(STATES):
                    now[FILL[s]] = min(now[FILL[s]], now[s] + INSERT)
            after = [c + DELETE for c in now]
            if stays is not None:
                for s, c in enumerate(now):
                    if s in STEP[kind]:
                        after[STEP[kind][s]] = min(after[STEP[kind][s]], c + stays)
                    after[FILL[s]] = min(after[FILL[s]], c + REROLE + stays)
            now = [min(c, NEVER) for c in after]
        out.append(now)
    return out


def audit(edits: str) -> str:
    """The initials of the edits: Delete, Insert, Keep, Rerole."""
    return edits.translate(str.maketrans("uaUA", "IIRR"))
