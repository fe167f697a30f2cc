"""Conversation structure repair: the cheapest edits by bidirectional Dijkstra (see `lattice`).

Rows of a conversation are taken by turn (nulls first), rows of the same turn by role, then
text. Each row has at most one fault, the first that holds: blank (nothing but white space),
duplicate (role and text seen earlier in the conversation), truncated (the last character that
is not white space ends no sentence). Blank and duplicate rows must go.

Nothing is gathered by conversation but its letters:

* equal rows are counted together before anything is sorted;
* a duplicate is found by the least turn of its role and text, combined before the shuffle;
* rows are sorted by conversation and turn over range partitions, so a conversation that holds a
  third of all rows lies in many ranges; its rows in one range are a segment;
* a segment is one string with a letter a row. Conversations of one segment are solved at once.
  Of the others each segment first yields a table of 4 x 4 costs; these are chained, and each
  segment is then solved by itself;
* texts are read again in the order of their segments and edited while they stream by.

Rows: a null conversation, turn, role or text stands for one space (a null turn sorts first).
An empty role is a class of its own. Repeated rows are copies: the first stays. Very long texts
are never edited, only kept or deleted. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import column, stored
from .lattice import (CLOSED_BY, CLOSING, FAULT_OF, FAULTS, LEGAL, ROWS, STATES, audit, solve,
                      solve_short, through)
from .neardup import _joined

RANGE_ROWS = 50_000
_SHORT = 40
_LETTERS = "".join(chr(97 + i) for i in range(16))


def or_space(name: str) -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(" "))


def canonical(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """`key` (the conversation as text), `turn`, `role`, `text`."""
    return rows.select(or_space(conv_id).alias("key"), column(turn).cast("long").alias("turn"),
                       or_space(role).alias("role"), or_space(text).alias("text"))


def placed(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct rows in order: `place` numbers them through, its upper part numbers the range.

    `letters` has the row's letter, and one for each further copy of it.
    """
    same = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    base = stored(same.withColumns({"mark": F.unhex(F.md5("text")), "when": when}), "rows")
    again = base.groupBy("key", "role", "mark").agg(
        F.count("*").alias("n"), F.min("when").alias("first")).where("n > 1").drop("n")
    flagged = _joined(base, again, ["key", "role", "mark"], "left")

    # White space is the blank and the control characters from tab to carriage return.
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    blank = F.length(bare) == 0
    fault = F.when(blank, 2).when(F.col("when") > F.col("first"), 3).when(
        ~F.right(bare, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    kind = F.coalesce(*[F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate("sua")],
                      F.lit(3)) * 4
    one = lambda number: F.substring(F.lit(_LETTERS), number + 1, F.lit(1))
    copy = kind + F.when(blank, 2).otherwise(3)
    letters = F.concat(one(kind + fault), F.repeat(one(copy), F.col("copies") - 1))
    order = ["key", "turn", "role", "text"]
    ranges = max(1, -(-base.count() // range_rows))
    return stored(flagged.select(*order, letters.alias("letters")).repartitionByRange(
        ranges, *order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id()), "placed")


def segments(table: DataFrame) -> DataFrame:
    """One row per conversation and range: its letters, and what stands around it."""
    parts = table.groupBy("key", F.shiftright("place", 33).cast("int").alias("range")).agg(
        F.array_sort(F.collect_list(F.struct("place", "letters"))).alias("rows")).select(
        "key", "range", F.array_join(F.col("rows.letters"), "").alias("letters"))
    order = Window.partitionBy("key").orderBy("range")
    return stored(parts.select(
        "key", "range", "letters",
        F.right(F.lag("letters").over(order), F.lit(1)).alias("before"),
        F.lead("range").over(order).isNull().alias("last"),
        (F.count("*").over(Window.partitionBy("key")) > 1).alias("split")), "segments")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 4 x 4 costs of each segment."""
    for batch in batches:
        costs = [sum(through(rows), []) for rows in batch.column("letters").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("range"), pa.array(costs, pa.list_(pa.int64()))],
            names=["key", "range", "costs"])


def _chain(table: pa.Table) -> pa.Table:
    """The costs to end from each state behind each segment of a conversation."""
    table = table.sort_by("range")
    behind, out = list(CLOSING), []
    for costs in reversed(table["costs"].to_pylist()):
        out.append(behind)
        behind = [min(costs[STATES * s + t] + behind[t] for t in range(STATES))
                  for s in range(STATES)]
    return table.select(["key", "range"]).append_column(
        "exits", pa.array(out[::-1], pa.list_(pa.int64())))


def _solve_from_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and last state of each segment, for each state that it may start in."""
    for batch in batches:
        edits, ends = [], []
        for rows, exits in zip(batch.column("letters").to_pylist(),
                               batch.column("exits").to_pylist()):
            found = [solve(rows, s, tuple(exits)) for s in range(STATES)]
            edits.append([e for _, e, _ in found])
            ends.append([s for _, _, s in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("range"), pa.array(edits, pa.list_(pa.string())),
             pa.array(ends, pa.list_(pa.int32()))], names=["key", "range", "edits", "ends"])


def _walk(table: pa.Table) -> pa.Table:
    """The state in which each segment of a conversation starts."""
    table = table.sort_by("range")
    state, out = 0, []
    for ends in table["ends"].to_pylist():
        out.append(state)
        state = ends[state]
    return table.select(["key", "range"]).append_column("entry", pa.array(out, pa.int32()))


def _solve_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [solve_short(r) if len(r) <= _SHORT else solve(r)
                 for r in batch.column("letters").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("range"),
             pa.array([e + CLOSED_BY[s] for _, e, s in found], pa.string())],
            names=["key", "range", "edits"])


def _price(rows: str, edits: str) -> int:
    """What edits cost, row by row."""
    cost, at = 0, 0
    for e in edits:
        if e in "ua":
            cost += 2
            continue
        cost += 3 if e == "D" else ROWS[rows[at]][1] + (0 if e == "K" else 2)
        at += 1
    return cost


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of faults, the cost and the audit of each solved segment."""
    for batch in batches:
        out = []
        for rows, before, edits in zip(*[batch.column(c).to_pylist()
                                         for c in ("letters", "before", "edits")]):
            faults = [FAULT_OF[r] for r in rows]
            kinds = [ROWS[r][0] for r in (before or "") + rows]
            out.append([faults.count(f) for f in FAULTS[1:]] + [
                sum(a + b not in LEGAL for a, b in zip(kinds, kinds[1:])), _price(rows, edits)])
        named = dict(zip(("truncated", "blank", "duplicate", "illegal", "cost"), zip(*out)))
        yield pa.RecordBatch.from_pydict({
            "key": batch.column("key"), "range": batch.column("range"),
            "edits": batch.column("edits"),
            "audit": pa.array([audit(e) for e in batch.column("edits").to_pylist()], pa.string()),
            **{n: pa.array(v, pa.int64()) for n, v in named.items()}})


_DESCRIBED = ("key string, range int, edits string, audit string, truncated long, blank long, "
              "duplicate long, illegal long, cost long")


def solved(table: DataFrame) -> DataFrame:
    """Each segment's `edits`, `audit`, faults, illegal neighbours and cost."""
    parts = segments(table)
    edits = parts.where("not split").select("key", "range", "letters").mapInArrow(
        _solve_whole, "key string, range int, edits string")
    cut = parts.where("split")
    if cut.limit(1).count():
        cut = cut.select("key", "range", "letters", "last")
        costs = cut.mapInArrow(_tables, "key string, range int, costs array<long>")
        exits = costs.groupBy("key").applyInArrow(_chain, "key string, range int, exits array<long>")
        each = stored(cut.join(exits, ["key", "range"]).mapInArrow(
            _solve_from_each, "key string, range int, edits array<string>, ends array<int>"), "cut")
        entries = each.select("key", "range", "ends").groupBy("key").applyInArrow(
            _walk, "key string, range int, entry int")
        closing = F.when(F.col("last"), F.get(
            F.array(*[F.lit(c) for c in CLOSED_BY]), F.get("ends", F.col("entry")))).otherwise("")
        edits = edits.union(each.join(entries, ["key", "range"]).join(
            cut.select("key", "range", "last"), ["key", "range"]).select(
            "key", "range", F.concat(F.get("edits", F.col("entry")), closing)))
    return stored(parts.join(edits, ["key", "range"]).select(
        "key", "range", "letters", "before", "edits").mapInArrow(_described, _DESCRIBED), "solved")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stream by behind their segment's edits; what stays or is inserted goes on."""
    role_of = {"u": "user", "a": "assistant"}
    edits, at, end = "", 0, 0
    for batch in batches:
        out = []
        for key, place, plan, turn, role, text, copies in zip(*[
                batch.column(c).to_pylist() for c in (
                    "key", "place", "edits", "turn", "role", "text", "copies")]):
            if plan is not None:
                edits, at = plan, 0
                end = len(plan.rstrip("ua"))
                continue
            nth = 0
            while copies or at >= end and at < len(edits):
                e = edits[at]
                at += 1
                if e in "ua":
                    out.append((key, place, nth, turn, role_of[e], "", "I"))
                else:
                    copies -= 1
                    if e != "D":
                        out.append((key, place, nth, turn, role if e == "K" else
                                    role_of[e.lower()], text, "K" if e == "K" else "R"))
                nth += 1
        columns = zip(*out) if out else [()] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (
                pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                pa.string()))], names=["key", "place", "nth", "turn", "role", "text", "edit"])


def repaired(table: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations in the order of `place`, `nth`; `edit` is Keep,
    Rerole or Insert (an inserted row carries the turn of the row that it stands beside)."""
    rows = table.select("key", F.shiftright("place", 33).cast("int").alias("range"), "place",
                        F.lit(None).cast("string").alias("edits"), "turn", "role", "text",
                        F.length("letters").alias("copies"))
    plans = found.select("key", "range", (F.col("range").cast("long") * (1 << 33)).alias("place"),
                         "edits").unionByName(rows.limit(0), allowMissingColumns=True)
    both = plans.unionByName(rows).repartition("key", "range").sortWithinPartitions(
        "key", "range", "place", F.col("edits").isNull())
    return both.drop("range").mapInArrow(_edited, (
        "key string, place long, nth long, turn long, role string, text string, edit string"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's lines, which come in order; only its state is held."""
    now, state = None, None

    def row():
        return pa.RecordBatch.from_pydict({
            "key": pa.array([now], pa.string()),
            "repaired_sha256": pa.array([state.hexdigest()], pa.string())})

    for batch in batches:
        for key, role, text in zip(*[batch.column(c).to_pylist() for c in ("key", "role", "text")]):
            if key != now:
                if now is not None:
                    yield row()
                now, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if now is not None:
        yield row()


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation. One hash is one chain: its rows pass through one
    task, none of them held."""
    return rows.select("key", "place", "nth", "role", "text").repartition("key") \
        .sortWithinPartitions("key", "place", "nth").mapInArrow(
        _digests, "key string, repaired_sha256 string")


def audits(found: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and the whole audit."""
    whole = F.array_sort(F.collect_list(F.struct("range", "audit")))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in counts], whole.alias("w")).select(
        "key", *counts, F.array_join(F.col("w.audit"), "").alias("audit"))


def damaged(rows: DataFrame) -> DataFrame:
    """The canonical rows of `conversations`, damaged as a checksum of their place says."""
    mark = F.pmod(F.crc32(F.concat_ws(":", "key", F.coalesce(
        F.col("turn").cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    return rows.withColumn("mark", mark).where("mark != 0").select(
        "key", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate(
            "text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("mark") == 3, 2).otherwise(1)))
        .alias("copy")).drop("copy")


def op12_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(canonical(given))
    table = placed(rows)
    found = solved(table)
    gaps = rows.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"))
                                   .alias("gaps"))
    out = given.select(column("conv_id").alias("conv_id"), or_space("conv_id").alias("key")) \
        .distinct().join(gaps, "key", "left").join(audits(found), "key", "left").join(
        digests(repaired(table, found)), "key", "left")
    none = F.lit(0).cast("long")
    return out.select(
        "conv_id", *[F.coalesce(c, none).alias(c) for c in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias(
            "repaired_sha256"))


def _move(state: str, price: str, letter: str, line: str = "''") -> str:
    return (f"{{'c': {state}.c + {price}, 'a': {state}.a || '{letter}', "
            f"'l': {state}.l || {line}}}")


def _let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_OWN = "chr(10) || x.role || ':' || x.text"


def _inserted(states: str, body: str) -> str:
    """SQL: `body` over f, the best paths (cost, audit, lines) to the four states after inserts."""
    third = _let("u", f"list_min([{states}[1], {states}[2], {states}[4]])",
                 f"list_min([{states}[3], {_move('u', '2', 'I', _USER)}])")
    fourth = _let("t", third, f"[{states}[1], {states}[2], t, list_min([{states}[4], "
                              f"{_move('t', '2', 'I', _ASSISTANT)}])]")
    return _let("f", fourth, body)


def _row_taken() -> str:
    stays = "CASE x.f WHEN '-' THEN 0 WHEN 't' THEN 1 ELSE 1000000 END"

    def kept(kind):
        return f"{stays} + CASE x.k WHEN '{kind}' THEN 0 ELSE 1000000 END"

    after = [[_move("f[1]", "3", "D")],
             [_move("f[2]", "3", "D"), _move("f[1]", kept("s"), "K", _OWN)],
             [_move("f[3]", "3", "D"), _move("m", kept("u"), "K", _OWN),
              _move("m", f"2 + {stays}", "R", f"{_USER} || x.text")],
             [_move("f[4]", "3", "D"), _move("f[3]", kept("a"), "K", _OWN),
              _move("f[3]", f"2 + {stays}", "R", f"{_ASSISTANT} || x.text")]]
    states = ", ".join(f"list_min([{', '.join(paths)}])" for paths in after)
    return _inserted("acc", _let("m", "list_min([f[1], f[2], f[4]])", f"[{states}]"))


_FIRST = ", ".join(f"{{'c': {c}::BIGINT, 'a': '', 'l': ''}}" for c in (0, *[1_000_000] * 3))

#: The same rows from DuckDB, by a plain table of the best path to each state, row after row.
#: The CRC-32 of the short keys is worked out byte by byte.
OP12_SQL = f"""
WITH polynomial AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(n))),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
marked AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS m
  FROM given, polynomial),
rows AS (
  SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role,
    CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE m WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM marked WHERE m <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
faults AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS k, left(before, 1) AS b,
    CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS f FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated,
    count(*) FILTER (b IS NOT NULL AND b || k NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'k': k, 'f': f, 'role': role, 'text': text}} ORDER BY i) AS seq
  FROM faults GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(seq, lambda acc, x: {_row_taken()}, [{_FIRST}]) AS e FROM counts),
ended AS (SELECT *, {_inserted("e", "list_min([f[1], f[4]])")} AS z FROM folded)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(z.c, 0)::BIGINT AS cost,
  coalesce(z.a, '') AS audit, sha256(coalesce(substr(z.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM given) g
LEFT JOIN ended ON g.conv_id IS NOT DISTINCT FROM ended.conv_id
"""
