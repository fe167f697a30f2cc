"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of `RUN` consecutive sentences is hashed (of more, see
`lengths`, where they have fewer than `LEAST_CHARS` characters); runs that occur more than once anywhere are joined over all
documents; and every sentence covered by a run that is not its first occurrence is removed. The
first occurrence is the one with the smallest (doc_id, hash of the text, position).

A sentence ends after a word with a full stop, question or exclamation mark, comma, colon or
semicolon at its end, at a line break, or after `MOST_WORDS` words: so prose without marks is
compared as well, and a passage that stands in the middle of another sentence falls into step at
its first mark. Its white space belongs to it: the sentences of a text joined together are the
text. Where sentences are short, a run takes more of them, so lists, verse and short lines are
compared too, and a few short words that repeat by chance are not. Spans are compared exactly
(128-bit hashes of their words and white space, without the white space around each sentence).

Rows: a null text stays null, an empty or blank one stays as it is; both have no sentences. A
text with fewer than `RUN` sentences or `LEAST_CHARS` characters has no run and stays. Rows with
the same doc_id and the same text are one document and get the same result; texts are told apart
by 128-bit hashes, also among rows that share an id or have none. Null ids come first in the
order. An empty table gives an empty result. Extra columns are kept; `n_sentences`, `n_removed`
must not clash, else ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import fits_broadcast
from .common import stored

RUN = 3
MOST_WORDS = 16
LEAST_CHARS = 60

# The five white-space characters that all regular-expression engines agree on.
_WS = r"\t\n\f\r "
SENTENCE = (rf"[{_WS}]*(?:[^{_WS}]*[^{_WS}.!?,;:][\t\f\r ]+){{0,{MOST_WORDS - 1}}}"
            rf"[^{_WS}]+[{_WS}]*")

def sentences_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)),
                      F.array().cast("array<string>"))


def _mark(text: str) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.col(text)))


def lengths(run: int = RUN, least: int = LEAST_CHARS) -> list[int]:
    """How many sentences a run may have: the first that gives it `least` characters counts. One
    more at a time, then twice as many; no sentence is empty, so the last is enough."""
    out = [run]
    while 2 * out[-1] - 1 < least:
        out.append(out[-1] + 1 if out[-1] < 2 * run else 2 * out[-1])
    return out


def _run_at(numbers: list[int], least: int) -> str:
    """SQL: the run at sentence `i`."""
    n, longer = numbers[0], _run_at(numbers[1:], least) if numbers[1:] else "NULL"
    return (f"transform(array(array_join(slice(_s, i + 1, {n}), '\\n')), x{n} -> "
            f"CASE WHEN length(x{n}) >= {least} THEN x{n} ELSE {longer} END)[0]")


def _spans(docs: DataFrame, run: int, least: int) -> DataFrame:
    """One row per run: key, id, text hash, position, sentences. `docs` has _id and _text."""
    trimmed = F.transform(sentences_of(F.col("_text")),
                          lambda s: F.btrim(s, F.lit("\t\n\f\r ")))
    bare = docs.select("_id", _mark("_text").alias("_th"), trimmed.alias("_s"))
    last = F.size("_s") - run
    runs = F.expr(f"transform(sequence(0, size(_s) - {run}), i -> {_run_at(lengths(run, least), least)})")
    spans = bare.where(last >= 0).select("_id", "_th", F.posexplode(runs).alias("_pos", "_run"))
    # Sentences hold no line break: a run has one sentence more than it has line breaks.
    n = F.length("_run") - F.length(F.replace("_run", F.lit("\n"), F.lit(""))) + 1
    # Two independent 64-bit hashes: fixed width, so that the rows that are shuffled stay short.
    return spans.where("_run IS NOT NULL").select(
        F.xxhash64("_run").alias("_key"), F.xxhash64(F.concat(F.lit("#"), "_run")).alias("_key2"),
        "_id", "_th", "_pos", n.alias("_len"))


def _with_first(candidates: DataFrame, repeated: DataFrame) -> DataFrame:
    """Each repeated span with its first occurrence. The rows of a span that has more than a
    task's share of them are dealt out over several tasks."""
    tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max((repeated.agg(F.sum("_n")).first()[0] or 0) / tasks, 1)
    # At most as many spans as tasks can have more than a task's share.
    hot = F.broadcast(repeated.where(F.col("_n") > share).select(
        "_key", "_key2", F.ceil(F.col("_n") / share).cast("int").alias("_salts")))
    on = ["_key", "_key2"]
    turn = F.pmod(F.xxhash64("_id", "_th", "_pos"), F.coalesce("_salts", F.lit(1))).cast("int")
    rows = candidates.join(hot, on, "left").withColumn("_salt", turn).drop("_salts")
    firsts = repeated.drop("_n").join(hot, on, "left").withColumn("_salt", F.explode(
        F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return rows.join(firsts, [*on, "_salt"]).drop("_salt")


def dedup_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run: int = RUN,
                least: int = LEAST_CHARS) -> DataFrame:
    """`docs` with repeated spans removed from `text`; adds `n_sentences`, `n_removed`."""
    clash = {"n_sentences", "n_removed"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    names = [f"c{i}" for i in range(len(docs.columns))]
    at_text, at_id = names[docs.columns.index(text)], names[docs.columns.index(doc_id)]
    inner = docs.toDF(*names).withColumns({"_id": F.col(at_id), "_text": F.col(at_text)})
    spans = _spans(inner.select("_id", "_text"), run, least)
    # Keys that occur twice: short rows, and counts combine before the shuffle, so that a passage
    # in every document is one row a task. Only spans with such a key go on.
    keys = stored(spans.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(
        "_key"), "span-keys")
    candidates = stored(spans.join(keys, "_key", "left_semi"), "spans")
    at = F.struct("_id", "_th", "_pos")
    repeated = stored(candidates.groupBy("_key", "_key2").agg(
        F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "repeated-spans")
    later = _with_first(candidates, repeated).where(~at.eqNullSafe(F.col("_first")))
    # At most one entry per sentence of the document.
    covered = later.groupBy(F.col("_id").alias("_i"), F.col("_th").alias("_t")).agg(
        F.array_distinct(F.flatten(F.collect_set(
            F.sequence("_pos", F.col("_pos") + F.col("_len") - 1)))).alias("_gone"))
    inner = inner.withColumn("_th", _mark("_text"))
    on = inner["_id"].eqNullSafe(covered["_i"]) & (inner["_th"] == covered["_t"])
    if fits_broadcast(covered.select("_i", F.hex("_t").alias("_t"), F.concat_ws(",", F.transform(
            "_gone", lambda p: p.cast("string"))).alias("_gone"))):
        covered = F.broadcast(covered)
    out = inner.join(covered, on, "left").withColumn("_s", sentences_of(F.col("_text")))
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(
        F.array().cast("array<int>"))
    left = F.array_join(F.transform(F.array_except(places, F.col("_gone")),
                                    lambda i: F.get(F.col("_s"), i)), "")
    return out.select(*[
        (F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left) if n == at_text
         else F.col(n)).alias(c) for n, c in zip(names, docs.columns)],
        F.size("_s").cast("long").alias("n_sentences"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_spans(docs)


def _run_sql(numbers: list[int]) -> str:
    """The run that begins at `pos`, in DuckDB."""
    run = f"array_to_string(s[pos + 1:pos + {numbers[0]}], chr(10))"
    longer = _run_sql(numbers[1:]) if numbers[1:] else "NULL"
    return f"CASE WHEN length({run}) >= {LEAST_CHARS} THEN {run} ELSE {longer} END"


def span_sql(documents: str, columns: str = "") -> str:
    """DuckDB SQL of `dedup_spans`; `columns` are carried along. Documents are told apart by id
    and text, as sentences hold no line break a run has one sentence more than line breaks."""
    return f"""
  SELECT doc_id, {columns} CASE WHEN gone IS NULL THEN text ELSE coalesce(
      list_aggregate(list_transform(list_filter(range(len(s)), lambda i: NOT list_contains(gone, i)),
        lambda i: s[i + 1]), 'string_agg', ''), '') END AS text,
    len(s)::BIGINT AS n_sentences, coalesce(len(gone), 0)::BIGINT AS n_removed
  FROM (SELECT *, coalesce(regexp_extract_all(text, '{SENTENCE}'), []) AS s, md5(text) AS th
    FROM {documents}) d
  LEFT JOIN (
    SELECT id, t, list_distinct(flatten(list(range(pos, pos + 1 + length(run)
        - length(replace(run, chr(10), '')))))) AS gone
    FROM (SELECT id, t, r.pos AS pos, r.run AS run, row_number() OVER (
        PARTITION BY r.run ORDER BY id NULLS FIRST, t, r.pos) AS nth
      FROM (SELECT id, t, unnest(list_transform(range(len(s) - {RUN - 1}),
          lambda pos: {{'pos': pos, 'run': {_run_sql(lengths())}}})) AS r
        FROM (SELECT DISTINCT doc_id AS id, md5(text) AS t,
            list_transform(regexp_extract_all(text, '{SENTENCE}'),
              lambda x: trim(x, chr(9) || chr(10) || chr(12) || chr(13) || ' ')) AS s
          FROM {documents}))
      WHERE r.run IS NOT NULL)
    WHERE nth > 1 GROUP BY id, t) g ON d.doc_id IS NOT DISTINCT FROM g.id AND d.th = g.t"""


OP4_SQL = span_sql("documents")
