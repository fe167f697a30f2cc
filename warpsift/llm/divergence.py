"""Source divergence audit: in which words the sources of a language differ.

Words are runs of letters (A-Z and everything beyond ASCII), A-Z lower-cased. A language keeps
the words that stand in at least `least` of its documents. Two passes over the texts:

1. Document frequencies: each task combines its own, then they are added up and filtered. The
   words that are kept are cut into shards by their hash, and each shard gets a minimal perfect
   hash, built in a task.
2. The recount: with all shards at hand, a task looks its words up (a word that is not the one
   stored at its slot is passed over) and adds to one dense row of slots per language and
   source. The shards are broadcast after their size has been measured. Beyond `bound` bytes,
   words are counted per task, added up by word, and each shard's perfect hash then gives the
   slots of its own words: the same rows by a shuffle.

Shares are p = 1 + floor(10^9 * (count + 1) / (N + V)) with N the group's count over its
language's V words. A shard's slots of all sources make a matrix; from it come the shard's part
of every sum over words, and its highest words of each source. Matrices hold at most about
`CELLS` numbers, so more sources mean smaller shards.

Numbers are whole and exact: a share is divided out in three steps of a thousand, which stays
within 64 bits up to 9 * 10^15 words of a language.

Rows: null text, language and source count as empty. Repeated rows are documents of their own.
An empty table gives an empty result; a language without kept words still has its pairs (value
0); a source that is alone in its language has none. Very long texts are read piece by piece.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import column, stored
from .neardup import _joined
from .perfect import PAD, PerfectHash, Shards, build, hashed

LEAST = 3
TOP = 200
SCALE = 1_000_000_000
SHARD_WORDS = 16_384
CELLS = 2_000_000
BOUND = 64 << 20
_HELD_WORDS = 300_000
_HELD_BYTES = 80 << 20
_HELD_COUNTS = 1 << 30
_PIECE = 1 << 20

#: Letters in lower case and bytes beyond ASCII as they are, all else a blank.
_LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32
                 for c in range(256))


def pieces(data: bytes) -> Iterator[bytes]:
    """The words of a text between blanks, about a megabyte at a time."""
    data, start = data.translate(_LETTERS), 0
    while len(data) - start > _PIECE:
        gap = data.find(b" ", start + _PIECE)
        if gap < 0:
            break
        yield data[start:gap]
        start = gap
    yield data[start:]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The values of the other columns, and the text, row by row."""
    *keys, texts = batch.columns
    for *key, text in zip(*[k.to_pylist() for k in keys], texts):
        yield tuple(key), text.as_py()


def _hashes(words: list[bytes]) -> pa.Array:
    return pa.array(hashed(words).view(np.int64), pa.int64())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Language, word with its hash, and in how many documents of this task (so far) it stands."""
    found: dict[str, Counter] = {}
    held = 0

    def flushed():
        for lang, words in found.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(words), pa.string()),
                "word": pa.array(list(words), pa.binary()), "hash": _hashes(list(words)),
                "n": pa.array(list(words.values()), pa.int64())})
        found.clear()

    for batch in batches:
        for (lang,), data in _texts(batch):
            mine: set[bytes] = set()
            for piece in pieces(data):
                mine.update(piece.split())
            words = found.setdefault(lang, Counter())
            held -= len(words)
            words.update(mine)
            held += len(words)
            if held > _HELD_WORDS:
                yield from flushed()
                held = 0
    yield from flushed()


def _build(table: pa.Table) -> pa.Table:
    """One shard's words as a perfect hash."""
    shard = build(table["word"].to_pylist())
    return pa.table({
        "lang": table["lang"][:1], "shard": table["shard"][:1],
        "sizes": pa.array([shard.sizes], pa.list_(pa.int64())),
        "places": pa.array([shard.table.tobytes()], pa.binary()),
        "keys": pa.array([shard.keys], pa.list_(pa.binary())),
        "spare": pa.array([shard.spare], pa.int32())})


_SHARD = "lang string, shard int, sizes array<long>, places binary, keys array<binary>, spare int"


def _opened(row) -> tuple:
    return (list(row["sizes"]), np.frombuffer(bytes(row["places"]), np.int32),
            [bytes(k) for k in row["keys"]], row["spare"])


class _Counts:
    """Dense rows of slots of the groups that one task meets.

    Texts wait until there is about a megabyte of a language; their words are then looked up
    at once.
    """

    def __init__(self, shards: dict[str, list[tuple]]):
        self.shards = {lang: Shards([PerfectHash(*s) for s in of]) for lang, of in shards.items()}
        self.rows: dict[tuple[str, str], np.ndarray] = {}
        self.waiting: dict[str, list[tuple[str, bytes]]] = {lang: [] for lang in shards}
        self.size = dict.fromkeys(shards, 0)
        self.held = self.counted = 0

    def add(self, lang: str, source: str, piece: bytes) -> None:
        if lang in self.shards:
            self.waiting[lang].append((source, piece))
            self.size[lang] += len(piece)
            if self.size[lang] > _PIECE:
                self.settle(lang)

    def settle(self, lang: str) -> None:
        texts, self.waiting[lang], self.size[lang] = self.waiting[lang], [], 0
        data = np.frombuffer(b" ".join([b"", *[t for _, t in texts], PAD]), np.uint8)
        edges = np.flatnonzero(np.diff((data[:-len(PAD)] != 32).view(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        at = self.shards[lang].find(data, starts, ends - starts)
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for _, t in texts]))
        for (source, _), a, b in zip(texts, cuts[:-1], cuts[1:]):
            row = self.rows.get((lang, source))
            if row is None:
                row = self.rows[lang, source] = np.zeros(
                    int(self.shards[lang].starts[-1]), np.int32)
                self.held += row.nbytes
            mine = at[a:b]
            np.add.at(row, mine[mine >= 0], np.int32(1))
        self.counted += len(at)

    def full(self) -> bool:
        return self.held > _HELD_BYTES or self.counted > _HELD_COUNTS

    def flushed(self) -> Iterator[pa.RecordBatch]:
        for lang, texts in self.waiting.items():
            if texts:
                self.settle(lang)
        for (lang, source), row in self.rows.items():
            starts = self.shards[lang].starts
            there = np.flatnonzero(row)
            cuts = np.searchsorted(there, starts)
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield pa.RecordBatch.from_pydict({
                        "lang": [lang], "source": [source], "shard": pa.array([s], pa.int32()),
                        "slots": pa.array([there[a:b] - starts[s]], pa.list_(pa.int32())),
                        "counts": pa.array([row[there[a:b]]], pa.list_(pa.int32()))})
        self.rows, self.held, self.counted = {}, 0, 0


def _recount(shared):
    """Second pass with all shards at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(shared.value)
        for batch in batches:
            for (lang, source), data in _texts(batch):
                for piece in pieces(data):
                    counts.add(lang, source, piece)
                if counts.full():
                    yield from counts.flushed()
        yield from counts.flushed()
    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass without them: the words themselves, combined as far as a task holds them."""
    counts: dict[tuple[str, str], Counter] = {}
    held = 0

    def flushed():
        for (lang, source), words in counts.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(words), pa.string()),
                "source": pa.array([source] * len(words), pa.string()),
                "word": pa.array(list(words), pa.binary()), "hash": _hashes(list(words)),
                "n": pa.array(list(words.values()), pa.int64())})
        counts.clear()

    for batch in batches:
        for key, data in _texts(batch):
            for piece in pieces(data):
                words = counts.setdefault(key, Counter())
                held -= len(words)
                words.update(piece.split())
                held += len(words)
                if held > _HELD_WORDS:
                    yield from flushed()
                    held = 0
    yield from flushed()


def _shard_slots(words: pa.Table, shard: pa.Table) -> pa.Table:
    """Slots of the words that fall to one shard; words it does not hold go."""
    row = shard.slice(0, 1).to_pylist()
    found = words["word"].to_pylist()
    at = PerfectHash(*_opened(row[0])).slots(found) if row else np.full(len(found), -1, np.int64)
    out = words.select(["lang", "source", "shard", "n"]).append_column(
        "slot", pa.array(at.astype(np.int32)))
    return out.filter(pa.array(at >= 0)).select(["lang", "source", "shard", "slot", "n"])


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / whole), exactly; `whole` is above every count."""
    rest, out = counts + 1, np.zeros_like(counts)
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _compare(top: int):
    def run(table: pa.Table) -> pa.Table:
        """One shard of a language: its part of each pair's sum, its highest words."""
        kind = table["kind"].to_numpy()
        groups = table.filter(pa.array(kind == 0)).sort_by("source")
        sources, whole = groups["source"].to_pylist(), groups["n"].to_numpy()
        v = groups["slot"].to_numpy()
        named = table.filter(pa.array(kind == 1)).sort_by("slot")
        words = named["word"].to_pylist()
        cells = table.filter(pa.array(kind == 2))
        number = {s: i for i, s in enumerate(sources)}
        counts = np.zeros((len(sources), len(words)), np.int64)
        counts[[number[s] for s in cells["source"].to_pylist()], cells["slot"].to_numpy()] = \
            cells["n"].to_numpy()
        size = int(v[0])
        p = shares(counts, (whole + size)[:, None])
        q = shares(counts.sum(0), np.int64(whole.sum() + size))
        rank = np.empty(len(words), np.int64)
        rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = \
            np.arange(len(words))
        rows = []
        for i, source in enumerate(sources):
            value = ((p[i] - p) ** 2 // p).sum(1)
            rows += [(source, "pair", sources[j].encode(), int(value[j]))
                     for j in range(len(sources)) if j != i]
            there = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = (p[i][there] - q[there]) ** 2 // q[there]
            best = np.lexsort((rank[there], -f))[:top]
            rows += [(source, "term", words[there[b]], int(f[b])) for b in best.tolist()]
        source, part, item, value = zip(*rows) if rows else ((), (), (), ())
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(rows), pa.string()),
                         "source": pa.array(source, pa.string()),
                         "part": pa.array(part, pa.string()),
                         "item": pa.array(item, pa.binary()),
                         "value": pa.array(value, pa.int64())})
    return run


def _shard():
    """The shard of a word among `shards`: its hash, without a sign, modulo their number."""
    whole = F.col("hash").cast("decimal(20,0)") + F.when(
        F.col("hash") < 0, F.lit(str(2 ** 64)).cast("decimal(20,0)")).otherwise(0)
    return F.pmod(whole, F.col("shards").cast("decimal(20,0)")).cast("int")


def _recounted(spark: SparkSession, docs: DataFrame, shards: DataFrame, bound: int) -> DataFrame:
    """`lang`, `source`, `shard`, `slot`, `n`: how often the kept words occur."""
    size = shards.agg(F.sum(F.expr("length(places) + aggregate(keys, 0L, (s, k) -> "
                                   "s + length(k) + 40L)"))).first()[0] or 0
    if size <= bound:
        table: dict[str, list] = {}
        for row in sorted(shards.collect(), key=lambda r: r["shard"]):
            table.setdefault(row["lang"], []).append(_opened(row))
        shared = spark.sparkContext.broadcast(table)
        parts = docs.mapInArrow(_recount(shared), (
            "lang string, source string, shard int, slots array<int>, counts array<int>"))
        cells = parts.select("lang", "source", "shard", F.expr("inline(arrays_zip(slots, counts))"))
        return cells.groupBy("lang", "source", "shard", F.col("slots").alias("slot")).agg(
            F.sum("counts").alias("n"))
    words = docs.mapInArrow(
        _count_words, "lang string, source string, word binary, hash long, n long").groupBy(
        "lang", "source", "word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))
    per = shards.groupBy("lang").agg(F.count("*").alias("shards"))
    dealt = _joined(words, per, ["lang"], "inner").withColumn("shard", _shard())
    return dealt.groupBy("lang", "shard").cogroup(shards.groupBy("lang", "shard")).applyInArrow(
        _shard_slots, "lang string, source string, shard int, slot int, n long")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least: int = LEAST, top: int = TOP, bound: int = BOUND) -> DataFrame:
    """`lang`, `source`, `part`, `item`, `value`, `rank`.

    Part `pair`: each other source of the language, valued by the sum over all words of
    floor((p - q)^2 / q). Part `term`: words that the source uses more than the language (q: the
    language's share), the first `top` of them.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang, "lang"), (source, "source"), (text, "text"))]).withColumn(
        "text", F.col("text").cast("binary"))
    kept = docs.select("lang", "text").mapInArrow(
        _frequencies, "lang string, word binary, hash long, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"), F.first("hash").alias("hash")).where(F.col("n") >= least)
    kept = stored(kept.select("lang", "word", "hash"), "kept-words")

    groups = stored(docs.select("lang", "source").distinct(), "groups")
    per_lang = stored(groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select(
        "lang", F.coalesce("v", F.lit(0)).alias("v"), F.greatest(F.lit(1), F.ceil(
            F.coalesce("v", F.lit(0)) / F.greatest(F.lit(64), F.least(
                F.lit(SHARD_WORDS), F.floor(F.lit(CELLS) / F.col("sources")))))).cast("int")
        .alias("shards")), "languages")
    dealt = _joined(kept, per_lang, ["lang"], "inner").select(
        "lang", _shard().alias("shard"), "word")
    # A shard may come out empty; it must be there, as words are dealt out by their number.
    seeds = per_lang.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias(
        "shard"))
    full = dealt.groupBy("lang", "shard").applyInArrow(_build, _SHARD)
    shards = stored(seeds.join(full, ["lang", "shard"], "left").select(
        "lang", "shard", F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes"),
        F.coalesce("places", F.unhex(F.lit(""))).alias("places"),
        F.coalesce("keys", F.array().cast("array<binary>")).alias("keys"),
        F.coalesce("spare", F.lit(0)).alias("spare")), "perfect-hashes")

    cells = stored(_recounted(spark, docs.select("lang", "source", "text"), shards, bound),
                   "recount")
    whole = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")),
                        ["lang", "source"], "left")
    nothing = F.lit(None)
    sides = whole.join(per_lang, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.lit(0).alias("kind"), "source", F.col("v").cast("long").alias("slot"),
        F.coalesce("n", F.lit(0)).alias("n"), nothing.cast("binary").alias("word"))
    names = shards.select("lang", "shard", F.posexplode("keys").alias("slot", "word")).select(
        "lang", "shard", F.lit(1).alias("kind"), nothing.cast("string").alias("source"),
        F.col("slot").cast("long").alias("slot"), F.lit(0).cast("long").alias("n"), "word")
    found = cells.select("lang", "shard", F.lit(2).alias("kind"), "source",
                         F.col("slot").cast("long").alias("slot"), "n",
                         nothing.cast("binary").alias("word"))
    parts = stored(sides.unionByName(names).unionByName(found).groupBy("lang", "shard").applyInArrow(
        _compare(top), "lang string, source string, part string, item binary, value long"),
        "divergence")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum("value").alias("value"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.withColumn("item", F.col("item").cast("string"))


def op13_perfect_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT id, lang, source,
    unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM d),
kept AS (SELECT lang, word FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
counted AS (SELECT lang, source, word, count(*) AS c FROM words GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
found AS (SELECT lang, source, word, c FROM counted SEMI JOIN kept USING (lang, word)),
totals AS (
  SELECT s.lang, s.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM sources s
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM found GROUP BY ALL) USING (lang, source)
  LEFT JOIN sizes USING (lang)),
cells AS (
  SELECT t.lang, t.source, k.word, coalesce(f.c, 0) AS c,
    1 + ({SCALE}::HUGEINT * (coalesce(f.c, 0) + 1)) // (t.n + t.v) AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, word)),
whole AS (SELECT lang, word, sum(c) AS c FROM found GROUP BY ALL),
norm AS (
  SELECT w.lang, w.word, 1 + ({SCALE}::HUGEINT * (w.c + 1)) // (t.n + t.v) AS q
  FROM whole w JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM totals GROUP BY lang) t
    USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.word = b.word AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT c.lang, c.source, c.word AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM cells c JOIN norm USING (lang, word) WHERE c.c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
  FROM terms) WHERE rank <= {TOP}
"""
