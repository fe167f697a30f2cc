"""Near-duplicate classes by DartMinHash signatures and a banded join.

A document is the weighted set of its five-word shingles (weight: number of places). Darts are
thrown at the plane of (weight, rank) of each shingle: in cells that double in size, a hash of
the shingle and the cell says how many darts fall there (Poisson) and where. A dart counts if it
lies below the shingle's weight. Each dart belongs to one of `COORDINATES` coordinates; of each
coordinate the dart of least rank is kept. Cells are visited in order of rank until every
coordinate has a dart, so the time is about the number of shingles plus the number of darts
needed, not their product, and two documents agree in a coordinate with the probability of their
weighted Jaccard similarity (sum of minima over sum of maxima).

`BANDS` bands of `ROWS` coordinates are joined: at a similarity of 0.8 a pair shares no band with
a probability of 3e-6. Candidates are verified on their texts, then joined into components:

1. Texts that are equal are one class from the start; only classes are compared.
2. Of each band bucket one class is the leader (the one whose buckets are the fullest), and every
   other class of the bucket is verified against it: as many pairs as rows, however large the
   bucket is.
3. Buckets whose classes are then still in several components are compared whole, in one group
   each: pairs of different components, in the first such band that they share. Only links that
   join components leave the group. A bucket that is larger than a group may be (`GROUP` texts or
   `GROUP_BYTES`) is split: each member goes to `SPLITS` parts of the bucket, by the keys of two
   further bands each, so that only texts that agree in twelve coordinates meet; parts that are
   still too large are split again, `DEPTH` times at most, and what is left then is compared with
   one leader.
4. Large buckets that still hold several components after that are compared exactly: all members
   outside the bucket's largest component with all members, in blocks of a group's size, each
   pair in the first large bucket that it shares. Where the steps before have joined the copies,
   the rows made grow with the members of a bucket; a large bucket of texts that are not alike
   makes as many as its members times its blocks, in bounded groups. So every pair of similarity
   0.8 or more that shares a band ends in one component, whatever the size of its buckets.

Rows: a null text, or one without a word, is compared for equality only; a null text is never a
copy of another. Fewer than five words are one shingle. Rows with equal text are one class,
repeated rows included. Texts are read whole. An empty table gives an empty result. Extra
columns are ignored by `classes` and kept by `keep_one`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import fits_broadcast
from .common import stored
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 24
COORDINATES = ROWS * BANDS
GROUP = 512
GROUP_BYTES = 16 << 20
SPLITS = 4
DEPTH = 3
KEPT_WORDS = 200_000

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a multiply-shift finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and their numbers of places."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        whole = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            whole = _mix(whole * _STEP + h[k:k + n])
    return np.unique(whole, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; that of two empty sets is 0."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    shared = np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum() if len(a[0]) else 0
    return float(shared / (total - shared))


@lru_cache(maxsize=64)
def _poisson(mean: float) -> np.ndarray:
    """Cumulated Poisson probabilities, far enough for 53-bit uniform numbers."""
    last = int(mean + 12 * np.sqrt(mean) + 30)
    k = np.arange(1, last + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean
    return np.cumsum(np.exp(logs))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def sketch(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The DartMinHash signature: k 64-bit dart ids (none: empty set)."""
    best = np.zeros(k, np.uint64)
    missing = np.ones(k, bool)
    top = float(weights.max())
    low, cell = 0.0, 0
    while missing.any():
        high = 1.0 if cell == 0 else low * 2
        ranks, places, ids = [], [], []
        bottom, level = 0.0, 0
        while bottom < top:
            ceiling = 1.0 if level == 0 else bottom * 2
            reach = weights > bottom
            those, limit = elements[reach], weights[reach]
            seed = np.uint64((cell * 64 + level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            cells = _mix(those ^ seed)
            darts = np.searchsorted(_poisson((high - low) * (ceiling - bottom)), _uniform(cells),
                                    side="right")
            total = int(darts.sum())
            if total:
                first = np.cumsum(darts) - darts
                turn = (np.arange(total) - np.repeat(first, darts) + 1).astype(np.uint64)
                with np.errstate(over="ignore"):
                    dart = _mix(np.repeat(cells, darts) + turn * _STEP)
                    spot = _mix(dart + _STEP)
                if limit.min() < ceiling:
                    with np.errstate(over="ignore"):
                        height = bottom + _uniform(_mix(spot + _STEP)) * (ceiling - bottom)
                    under = height < np.repeat(limit, darts)
                    dart, spot = dart[under], spot[under]
                ids.append(dart)
                ranks.append(low + _uniform(spot) * (high - low))
                places.append((dart % np.uint64(k)).astype(np.int64))
            bottom, level = ceiling, level + 1
        if ids:
            dart, place = np.concatenate(ids), np.concatenate(places)
            # Written from the largest rank to the least: the least stays.
            order = np.argsort(-np.concatenate(ranks), kind="stable")
            found = np.zeros(k, np.uint64)
            there = np.zeros(k, bool)
            found[place[order]] = dart[order]
            there[place] = True
            new = there & missing
            best[new] = found[new]
            missing &= ~there
        low, cell = high, cell + 1
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = signature.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
        for i in range(ROWS):
            key = _mix(key * _STEP + rows[:, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of each text; copies that follow each other are worked out once."""
    known: dict[bytes, np.ndarray | None] = {}
    for batch in batches:
        keys = []
        for mark, text in zip(batch.column("th").to_pylist(), batch.column("text")):
            if mark is None:
                keys.append(None)
                continue
            if mark not in known:
                if len(known) > 5_000:
                    known.clear()
                elements, weights = shingles(text.as_py())
                known[mark] = band_keys(sketch(elements, weights)) if len(elements) else None
            keys.append(known[mark])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "th", "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_mark, last = None, None
    for batch in batches:
        kept = []
        rows = zip(*[batch.column(c) for c in ("a", "b", "a_text", "b_text")])
        for a, b, a_text, b_text in rows:
            if b.as_py() != last_mark:
                last_mark, last = b.as_py(), shingles(b_text.as_py())
            if similarity(shingles(a_text.as_py()), last) >= SIMILARITY:
                kept.append((a.as_py(), b.as_py()))
        a, b = zip(*kept) if kept else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                         names=["a", "b"])


class _Sets:
    """Shingles of the texts of a group, worked out when they are first asked for."""

    def __init__(self, texts):
        self.texts, self.known = texts, {}

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.known:
            self.known[i] = shingles(self.texts[i])
        return self.known[i]


def joining_links(sets, keys: np.ndarray, roots: list, band: int, whole: np.ndarray, split: bool
                  ) -> list[tuple[int, int]]:
    """Links of 0.8 or more that join components, among the members of one group.

    `whole` says of each member's bands which buckets are compared whole. A pair is looked at in
    the first such bucket that it shares; in a part of a split bucket, if it shares none.
    """
    parent = list(range(len(keys)))
    first: dict = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, r in enumerate(roots):
        parent[i] = first.setdefault(r, i)
    before = keys.shape[1] if split else band
    links = []
    for i in range(len(keys)):
        later = np.arange(i + 1, len(keys))
        if before and len(later):
            shared = (keys[later, :before] == keys[i, :before]) & whole[i, :before]
            later = later[~shared.any(1)]
        for j in later.tolist():
            if root(i) == root(j):
                continue
            a, b = sets[i], sets[j]
            sizes = sorted((a[1].sum(), b[1].sum()))
            if sizes[0] >= SIMILARITY * sizes[1] and similarity(a, b) >= SIMILARITY:
                links.append((i, j))
                parent[root(j)] = root(i)
    return links


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """All members of one bucket, or of one part of a split bucket."""
    marks = table["th"].to_pylist()
    keys = np.array(table["keys"].to_pylist(), np.int64)
    bits = table["whole"].to_numpy()[:, None] >> np.arange(BANDS) & 1
    texts = [t.as_py() for t in table["text"]]
    links = joining_links(_Sets(texts), keys, table["root"].to_pylist(),
                          table["band"][0].as_py(), bits.astype(bool), table["split"][0].as_py())
    return pa.table({"a": pa.array([marks[i] for i, _ in links], pa.binary()),
                     "b": pa.array([marks[j] for _, j in links], pa.binary())})


def _compare_sides(key: tuple, table: pa.Table) -> pa.Table:
    """The outer members of a block with the members of another, of one large bucket."""
    marks, roots = table["th"].to_pylist(), table["root"].to_pylist()
    keys = np.array(table["keys"].to_pylist(), np.int64)
    whole = (table["whole"].to_numpy()[:, None] >> np.arange(BANDS) & 1).astype(bool)
    outer = np.array(table["outer"].to_pylist(), bool)
    others = np.flatnonzero(~outer)
    band, sets = table["band"][0].as_py(), _Sets([t.as_py() for t in table["text"]])
    parent: dict = {}

    def root(r):
        while parent.setdefault(r, r) != r:
            r = parent[r]
        return r

    links = []
    for i in np.flatnonzero(outer).tolist():
        same = keys[others] == keys[i]
        # Pairs of a bucket that was compared whole are known; others meet in their first band.
        fresh = ~(same & whole[i] & whole[others]).any(1) & (same.argmax(1) == band)
        for j in others[fresh].tolist():
            if root(roots[i]) == root(roots[j]):
                continue
            a, b = sets[i], sets[j]
            sizes = sorted((a[1].sum(), b[1].sum()))
            if sizes[0] >= SIMILARITY * sizes[1] and similarity(a, b) >= SIMILARITY:
                links.append((i, j))
                parent[root(roots[j])] = root(roots[i])
    return pa.table({"a": pa.array([marks[i] for i, _ in links], pa.binary()),
                     "b": pa.array([marks[j] for _, j in links], pa.binary())})


def _across(large: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the components that are left in buckets too large to be compared whole."""
    now = stored(large.drop("root").join(roots.select(F.col("node").alias("th"), "root"), "th",
                                         "left").withColumn("root", F.coalesce("root", "th")),
                 "large")
    parts = now.groupBy("unit", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    most = F.max(F.struct("n", "root", "size"))
    whole = parts.groupBy("unit").agg(
        F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        most.alias("most")).where("roots > 1")

    def blocks(n, size):
        return F.expr(f"CAST(ceil(greatest(({n}) / {GROUP}, ({size}) / {GROUP_BYTES})) AS INT)")

    whole = whole.select("unit", F.col("most.root").alias("main"), blocks("n", "size").alias("js"),
                         blocks("n - most.n", "size - most.size").alias("is"))
    rows = _joined(now, whole, ["unit"], "inner")

    def dealt(own, count, other, others):
        return {own: F.pmod(F.xxhash64("th"), F.col(count)).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.col(others) - 1))}

    outer = rows.where("root != main").withColumns(
        {"outer": F.lit(True), **dealt("i", "is", "j", "js")})
    every = rows.withColumns({"outer": F.lit(False), **dealt("j", "js", "i", "is")})
    names = ["unit", "i", "j", "th", "root", "band", "keys", "whole", "outer"]
    return outer.select(*names).union(every.select(*names)).join(texts, "th").groupBy(
        "unit", "i", "j").applyInArrow(_compare_sides, "a binary, b binary")


def _several(units: DataFrame) -> DataFrame:
    """Units that hold several components: their members and bytes."""
    return units.groupBy("unit").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"),
        F.sum("bytes").alias("size")).where("lo != hi").select(
        "unit", (F.col("members") <= GROUP).alias("few"), F.col("size").alias("size")).select(
        "unit", (F.col("few") & (F.col("size") <= GROUP_BYTES)).alias("fits"))


def _parts(units: DataFrame, depth: int) -> DataFrame:
    """Members of units that are too large, each in several parts of its unit."""
    def part(turn):
        # Two further bands, others for each turn and depth.
        step = 2 * (SPLITS * depth + turn) + 1
        keys = [F.get("keys", F.pmod(F.col("band") + F.lit(step + i), F.lit(BANDS)).cast("int"))
                for i in (0, 1)]
        return F.xxhash64("unit", F.lit(turn), *keys)
    return units.withColumn("unit", F.explode(F.array(*[part(t) for t in range(SPLITS)])))


def _joined(table: DataFrame, lookup: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join with a table whose size is measured first: sent whole, or shuffled."""
    return table.join(F.broadcast(lookup) if fits_broadcast(lookup) else lookup, on, how)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs `a`, `b` that are alike enough."""
    a, b = (texts.select(F.col("th").alias(n), F.col("text").alias(f"{n}_text")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_text", "b_text").mapInArrow(
        _verify, "a binary, b binary")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id`, `th` (hash of the text), `class_id` (the smallest doc_id of an equal text) and
    `cluster_id` (the smallest doc_id of the near-duplicate group)."""
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("text")).withColumn(
        "th", F.unhex(F.md5("text")))
    # An id to join on, for rows without one.
    some = F.coalesce("doc_id", F.lit(-1 << 63)).alias("some_id")
    signed = stored(base.mapInArrow(_sign, "doc_id long, th binary, keys array<long>"), "signed")
    nodes = signed.where("th is not null").groupBy("th").agg(
        F.min("doc_id").alias("class_id"), F.min(some).alias("some_id"))

    # Buckets with two classes or more; copies of a class are combined before the shuffle.
    rows = signed.where("keys is not null").select("th", F.posexplode("keys").alias("band", "key"))
    many = rows.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where(
        "lo != hi").select("key")
    shared = stored(_joined(rows, many, ["key"], "left_semi").distinct(), "buckets")
    fullness = shared.groupBy("key").agg(F.count("*").alias("n"))
    scores = shared.join(fullness, "key").groupBy("th").agg(F.sum("n").alias("score"))
    scored = shared.join(scores, "th")
    leaders = scored.groupBy("key").agg(F.max(F.struct("score", "th")).alias("l")).select(
        "key", F.col("l.th").alias("b"))
    pairs = stored(shared.join(leaders, "key").where("th != b").select(
        F.col("th").alias("a"), "b").distinct(), "pairs")

    # The texts of all classes in shared buckets, one each.
    involved = scores.join(nodes, "th").select("th", "some_id")
    texts = stored(_joined(base.select("*", some), involved, ["some_id", "th"], "left_semi").dropDuplicates(
        ["th"]).select("th", "text"), "texts")
    links = stored(_verified(pairs, texts), "links")
    roots = components(links, "a", "b")

    # Buckets that still hold several components; those that are too large in parts.
    sized = texts.select("th", F.octet_length("text").cast("long").alias("bytes"))
    rooted = stored(shared.join(roots, shared["th"] == roots["node"], "left").join(
        sized, "th").select(F.col("key").alias("unit"), "band", "th", F.coalesce(
            "root", "th").alias("root"), "bytes"), "rooted")
    apart = stored(_several(rooted), "apart")
    members = _joined(rooted, apart, ["unit"], "inner")
    keyed = signed.where("keys is not null").select("th", "keys")
    marked = members.groupBy("th").agg(F.expr(
        "bit_or(if(fits, shiftleft(1L, band), 0L))").alias("whole"))
    known = stored(_joined(keyed, marked, ["th"], "inner").dropDuplicates(["th"]), "members")
    full = stored(members.join(known, "th"), "units")
    units = [full.where("fits").withColumn("split", F.lit(False))]
    large = rest = full.where("not fits").drop("fits")
    split = not large.isEmpty()
    for depth in range(DEPTH):
        if not rest.limit(1).count():
            break
        parts = stored(_parts(rest, depth), "parts")
        judged = stored(_joined(parts, _several(parts), ["unit"], "inner"), "judged-parts")
        units.append(judged.where("fits").withColumn("split", F.lit(True)))
        rest = judged.where("not fits").drop("fits")
    # What no split makes small enough meets one leader.
    last = rest.groupBy("unit").agg(F.min("th").alias("b"))
    stars = stored(rest.join(last, "unit").where("th != b").select(
        F.col("th").alias("a"), "b").distinct(), "stars")
    names = ["unit", "band", "th", "root", "keys", "whole", "split"]
    grouped = reduce(DataFrame.unionByName, [u.select(*names) for u in units])
    more = grouped.join(texts, "th").groupBy("unit").applyInArrow(
        _compare, "a binary, b binary").union(_verified(stars, texts))
    every = stored(links.union(more.distinct()), "links")
    final = components(every, "a", "b")
    if split:
        every = stored(every.union(_across(large, final, texts)).distinct(), "links")
        final = components(every, "a", "b")

    merged = nodes.join(final, nodes["th"] == final["node"], "left").select(
        "th", "class_id", F.coalesce("root", "th").alias("root"))
    least = merged.groupBy("root").agg(F.min("class_id").alias("cluster_id"))
    named = merged.join(least, "root").select("th", "class_id", "cluster_id")
    out = signed.select("doc_id", "th").join(named, "th", "left")
    return out.select("doc_id", "th", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("cluster_id", "doc_id").alias("cluster_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay: of each group the document with the smallest id, once.

    Null texts all stay.
    """
    found = stored(classes(docs, text, doc_id), "classes")
    gone = found.where("th is not null and not (doc_id <=> cluster_id)").select(
        F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_th")).distinct()
    mark = F.unhex(F.md5(docs[text].cast("string")))
    on = docs[doc_id].cast("long").eqNullSafe(F.col("_gone")) & (mark == F.col("_gone_th"))
    left = docs.join(F.broadcast(gone) if fits_broadcast(gone) else gone, on, "left_anti")
    twice = found.where("th is not null and doc_id <=> cluster_id").groupBy("th").count().where(
        "count > 1").limit(1).count()
    if not twice:
        return left
    # The same id and text in several rows: one of them stays.
    copies = left.withColumn("_th", F.unhex(F.md5(left[text].cast("string"))))
    return copies.where("_th is not null").dropDuplicates(["_th"]).union(
        copies.where("_th is null")).drop("_th")


def op7_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", "class_id", "cluster_id",
                                F.expr("doc_id <=> cluster_id").alias("stays"))
