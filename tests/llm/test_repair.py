import random

import pytest
from pyspark.sql import functions as F

from warpsift.llm import lattice, repair
from warpsift.llm.lattice import CLOSED_BY, CLOSING, FILL, ROWS, STEP, audit, solve, through


def by_table(rows):
    """The least (cost, audit), from the best path to every state, row after row."""
    def inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                best[FILL[s]] = min(best.get(FILL[s], (99999, "")), (c + 2, a + "I"))
        return best

    now = {0: (0, "")}
    for r in rows:
        kind, stays = ROWS[r]
        after = {}
        for s, (c, a) in inserts(now).items():
            moves = [(s, c + 3, "D")]
            if stays is not None:
                moves += [(FILL[s], c + 2 + stays, "R")]
                moves += [(STEP[kind][s], c + stays, "K")] if s in STEP[kind] else []
            for to, cost, name in moves:
                after[to] = min(after.get(to, (99999, "")), (cost, a + name))
        now = after
    now = inserts(now)
    return min(now[s] for s in (0, 3) if s in now)


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "aeim", "eeif", "egim", "kkee"])
def test_search_equals_the_table(letters):
    rng = random.Random(7)
    for _ in range(1500):
        rows = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
        cost, edits, end = solve(rows)
        edits += CLOSED_BY[end]
        assert (cost, audit(edits)) == by_table(rows), rows
        assert repair._price(rows, edits) == cost
        if len(rows) > 1:
            cut = rng.randrange(1, len(rows))
            costs = through(rows[cut:])
            exits = tuple(min(c + e for c, e in zip(line, CLOSING)) for line in costs)
            _, first, state = solve(rows[:cut], 0, exits)
            _, second, end = solve(rows[cut:], state)
            assert audit(first + second + CLOSED_BY[end]) == audit(edits), (rows, cut)


def test_long_rows_take_linear_time():
    rng = random.Random(3)
    rows = "".join(rng.choice("eiaf") for _ in range(20_000))
    cost, edits, end = solve(rows)
    assert repair._price(rows, edits + CLOSED_BY[end]) == cost


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(repair.op12_edit_lattice(spark, sf_dir)) == duck(repair.OP12_SQL)


def test_query_equals_sql_on_odd_rows(spark, odd_talks, no_talks, duck, rows_of, tmp_path):
    for name, talks in (("odd", odd_talks), ("none", no_talks), ("extra", odd_talks.withColumns(
            {c: F.lit(1) for c in ("key", "place", "letters", "range", "mark", "copies")}))):
        folder = str(tmp_path / name)
        talks.write.parquet(f"{folder}/conversations.parquet")
        assert rows_of(repair.op12_edit_lattice(spark, folder)) == duck(repair.OP12_SQL, folder)


def test_a_hot_conversation_is_cut_into_segments(spark, odd_talks, rows_of):
    rows = repair.canonical(odd_talks)
    whole = repair.placed(rows)
    cut = repair.placed(rows, range_rows=20)
    parts = repair.segments(cut)
    assert parts.groupBy("key").count().agg(F.max("count")).first()[0] > 5
    found = repair.solved(whole), repair.solved(cut)
    assert rows_of(repair.audits(found[0])) == rows_of(repair.audits(found[1]))
    edited = [repair.repaired(t, f) for t, f in zip((whole, cut), found)]
    assert rows_of(repair.digests(edited[0])) == rows_of(repair.digests(edited[1]))
    assert rows_of(edited[0].select("key", "turn", "role", "text", "edit")) == rows_of(
        edited[1].select("key", "turn", "role", "text", "edit"))


def test_repaired_rows_are_well_formed(spark, odd_talks):
    table = repair.placed(repair.canonical(odd_talks))
    found = repair.solved(table)
    rows = repair.repaired(table, found).orderBy("key", "place", "nth").collect()
    talks = {}
    for r in rows:
        talks.setdefault(r.key, []).append(r.role[:1])
    for kinds in talks.values():
        kinds = "".join(kinds).removeprefix("s")
        assert kinds == "ua" * (len(kinds) // 2)
    kept = [r.text for r in rows if r.edit == "K"]
    assert max(map(len, kept)) > 300_000


def test_letters_are_told_apart():
    assert len(ROWS) == 16 and lattice.letter("u", "-") == "e" and lattice.letter("o", "d") == "p"
