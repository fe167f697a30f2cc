"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are counted by membership pattern (the set of sources that a document belongs to).
Tokens flow from the patterns to the quotas of the sources: the first pass over a pattern is
free, each further pass costs more (1, 3, 5, ...), so that repetition is used only where
quotas cannot be met otherwise, and is spread evenly. The flow of a pattern is then turned
into documents: all of them as often as the flow covers the pattern whole, and for the rest a
seeded choice of whole documents, the last few of them by size, so that their words come near it.

Only one row per pattern reaches the driver. Patterns are bounded by the vocabulary of
sources, not by the documents; more than `MAX_PATTERNS` is an error, never a cut.

Rows: a null text has size 0; documents of size 0 bring no words and are taken 0 words.
A null source is a source of its own, the last. Repeated rows are documents of their own, and so
are rows that share an id or have none. Rows that are equal in all columns of `order` follow each
other in no stated order, so these should tell all rows apart that differ. An empty table gives
an empty result. Columns of the input keep their names; the new ones
(`size`, `copies`, `taken`, ...) must not clash, else ValueError.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import column, running, seeded, stored

SEED = 20240131
WEIGHTS = (5, 2, 1)
REPEATS = 3
MAX_PATTERNS = 100_000
#: Documents chosen by size, per pattern, to close the gap that the seeded choice leaves.
FILLS = 3


def words_of(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Share the sum of sizes by weight, none above `repeats` times its own size."""
    caps = [repeats * s for s in sizes]
    full: set[int] = set()
    while True:
        rest = sum(sizes) - sum(caps[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        level = rest / weight if weight else 0.0
        over = {i for i in range(len(sizes)) if i not in full and weights[i] * level >= caps[i]}
        if not over:
            return [float(caps[i]) if i in full else weights[i] * level
                    for i in range(len(sizes))]
        full |= over


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int],
                  repeats: int = REPEATS) -> list[dict[int, int]]:
    """Tokens that each pattern sends to each of its sources.

    `patterns` holds (size, source numbers). Successive cheapest paths over the network
    start -> pattern (one arc per pass, the k-th costing 2k - 1 a token) -> source -> end.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    arcs: list[list[int]] = []                    # from, to, room, cost; the reverse follows
    leaving: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            leaving[x].append(len(arcs))
            arcs.append([x, y, r, c])
        return len(arcs) - 2

    routes = []
    for p, (size, sources) in enumerate(patterns):
        for k in range(repeats):
            arc(start, p, size, 2 * k - 1 if k else 0)
        routes.append({s: arc(p, n + s, repeats * size, 0) for s in sources})
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota, 0)

    while True:
        cost: list[float] = [float("inf")] * (n + m + 2)
        came = [-1] * (n + m + 2)
        cost[start], queue, waiting = 0, deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in leaving[a]:
                _, b, room, price = arcs[e]
                if room and cost[a] + price < cost[b]:
                    cost[b], came[b] = cost[a] + price, e
                    if b not in waiting:
                        queue.append(b)
                        waiting.add(b)
        if came[end] < 0:
            return [{s: arcs[e + 1][2] for s, e in r.items() if arcs[e + 1][2]} for r in routes]
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = arcs[came[at]][0]
        amount = min(arcs[e][2] for e in path)
        for e in path:
            arcs[e][2] -= amount
            arcs[e ^ 1][2] += amount


def mix(docs: DataFrame, size: Column, members: Column, order: list[str],
        weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Add what the mix takes of each document.

    `members` is an array of the sources that a document belongs to, `size` its number of
    words. Sources in code point order (null last) get the weights in turn; together they
    want as many words as there are. New columns: `size`, `pattern_size` (words of all
    documents of the same pattern), `target` (words that the pattern's sources want),
    `flow` (words routed from the pattern), `copies` and `taken` (copies times size).
    `order` names columns that identify a document, for the seeded choice.
    """
    new = ["size", "pattern_size", "target", "flow", "copies", "taken"]
    clash = set(new) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    ids = [names[docs.columns.index(c)] for c in order]
    inner = docs.withColumns({"_size": size, "_members": F.array_sort(F.array_distinct(members))}) \
        .toDF(*names, "_size", "_members")
    keyed = inner.withColumn("_pattern", F.to_json("_members", {"ignoreNullFields": "false"})) \
        .drop("_members").withColumn("_h", seeded(seed, *[column(c) for c in ids]))
    # A place of its own for each row: rows of one size and id stay apart.
    summed = stored(running(keyed, ["_pattern"], ["_h", *ids], {"_upto": "_size"}, "mix")
                    .withColumn("_place", F.monotonically_increasing_id()), "mix-places")

    found = summed.groupBy("_pattern").agg(F.first("_upto_all").alias("size")) \
        .withColumn("members", F.from_json("_pattern", "array<string>")) \
        .limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: r["_pattern"] or "")
    sources = sorted({s for r in found for s in r["members"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(sources)}
    own = [0] * len(sources)
    for r in found:
        # A document's words count for each of its sources in equal parts, the rest for the first.
        for i, s in enumerate(r["members"]):
            own[number[s]] += r["size"] // len(r["members"]) + (
                r["size"] % len(r["members"]) if i == 0 else 0)
    targets = fill_targets(own, [weights[i % len(weights)] for i in range(len(sources))], repeats)
    flows = min_cost_flow([(r["size"], [number[s] for s in r["members"]]) for r in found],
                          [int(t) for t in targets], repeats)
    rows = [(r["_pattern"], sum(targets[number[s]] for s in r["members"]), sum(f.values()))
            for r, f in zip(found, flows)]
    # Wholly covered passes, and the words still wanted after them.
    plan = spark.createDataFrame(pa.table({
        "_pattern": pa.array([r[0] for r in rows], pa.string()),
        "target": pa.array([r[1] for r in rows], pa.float64()),
        "flow": pa.array([r[2] for r in rows], pa.int64())}))
    wanted = summed.join(F.broadcast(plan), "_pattern").withColumns({
        "_times": F.expr("if(_upto_all = 0, 0, flow div _upto_all)"),
        "_rest": F.expr("if(_upto_all = 0, 0, flow % _upto_all)")})
    # The seeded documents up to the rest; then, a few times, the one that closes the gap best.
    chosen = wanted.withColumn("_more", F.col("_upto") <= F.col("_rest"))
    for turn in range(FILLS):
        gaps = chosen.groupBy("_pattern").agg((F.first("_rest") - F.sum(
            F.when(F.col("_more"), F.col("_size")).otherwise(0))).alias("_gap"))
        open_ = chosen.where("not _more and _size > 0").join(F.broadcast(gaps), "_pattern")
        # Only the last may go beyond the gap, if that brings it nearer.
        fits = "_size <= _gap" if turn < FILLS - 1 else "_size < 2 * _gap"
        last = open_.where(fits).groupBy("_pattern").agg(F.min(F.struct(
            F.abs(F.col("_gap") - F.col("_size")).alias("s"), "_h", *ids, "_place")).alias("_last"))
        same = F.col("_last._place") == F.col("_place")
        chosen = chosen.join(F.broadcast(last), "_pattern", "left").withColumn(
            "_more", F.col("_more") | F.coalesce(F.col("_last").isNotNull() & same, F.lit(False))
        ).drop("_last")
    more = F.col("_more")
    copies = (F.col("_times") + F.when(more, 1).otherwise(0)).cast("int")
    return chosen.select(
        *[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("_size").alias("size"),
        F.col("_upto_all").alias("pattern_size"), "target", "flow", copies.alias("copies"),
        (copies * F.col("_size")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as `copies` says."""
    return docs.withColumn(copies, F.explode(F.array_repeat(F.lit(1), column(copies)))).drop(copies)


def op8_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows are told apart by id and text, so that reruns agree where ids are shared or missing.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        words_of(F.col("text")).alias("words"),
        F.coalesce(F.md5("text"), F.lit("")).alias("mark"))
    mixed = mix(docs, F.col("words"), F.array("source"), ["doc_id", "mark"])
    return mixed.select("doc_id", "source", "size", F.col("pattern_size").alias("source_size"),
                        "target", "taken")


def _fill_sql(turn: int) -> str:
    """One more document per source: the one that closes the gap best."""
    table = f"taken{turn - 1}" if turn else "(SELECT *, upto <= rest AS more FROM ordered)"
    fits = "size <= gap" if turn < FILLS - 1 else "size < 2 * gap"
    return f""",
gap{turn} AS (
  SELECT *, rest - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM {table}),
fit{turn} AS (
  SELECT place, row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), h, place) AS r
  FROM gap{turn} WHERE NOT more AND size > 0 AND {fits}),
taken{turn} AS (
  SELECT g.* EXCLUDE (gap, more), more OR f.place IS NOT NULL AS more
  FROM gap{turn} g LEFT JOIN (SELECT place FROM fit{turn} WHERE r = 1) f USING (place))"""


OP8_SQL = f"""
WITH docs AS (
  SELECT doc_id::BIGINT AS doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(md5(text), ''))) AS h,
    row_number() OVER () AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1)
      % {len(WEIGHTS)} + 1)::INTEGER] AS w
  FROM docs GROUP BY source),
filled AS (  -- full sources are those with the least room for their weight
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({REPEATS} * source_size) OVER (ORDER BY source_size / w, source
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(w) OVER (ORDER BY source_size / w, source
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight
  FROM sources),
stops AS (
  SELECT *, w * ((total - caps)::DOUBLE / weight::DOUBLE) >= {REPEATS} * source_size AS stop
  FROM filled),
levels AS (
  SELECT source, source_size, w, stop,
    ((any_value(total) OVER () - coalesce(sum({REPEATS} * source_size) FILTER (stop) OVER (), 0))
      ::DOUBLE / (sum(w) FILTER (NOT stop) OVER ())::DOUBLE) AS level
  FROM stops),
quotas AS (
  SELECT source, source_size,
    CASE WHEN stop THEN ({REPEATS} * source_size)::DOUBLE ELSE w * level END AS target
  FROM levels),
ordered AS (
  SELECT d.*, q.source_size, q.target,
    CASE WHEN q.source_size = 0 THEN 0 ELSE floor(q.target)::BIGINT // q.source_size END AS times,
    CASE WHEN q.source_size = 0 THEN 0 ELSE floor(q.target)::BIGINT % q.source_size END AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
{''.join(map(_fill_sql, range(FILLS)))}
SELECT doc_id, source, size, source_size, target,
  (size * (times + CASE WHEN more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM taken{FILLS - 1}
"""
