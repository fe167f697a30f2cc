"""Nearest neighbours by largest inner product, with an adaptive scan of dimensions.

Vectors get one more component, so that all have the same length and the nearest vector is the
one with the largest inner product; then all are rotated at random, which spreads their
differences evenly over the dimensions. Rows are dealt into lists around centres (k-means on a
bounded sample, `SAMPLE` rows; every row is indexed).

A query probes the lists nearest to it until they hold `PROBE` of all rows (and `LEAST` rows at
any rate). Its nearest lists are scanned in full and give a first k-th distance. In all others
the columns are read in blocks of `COLUMNS`: after each block the distance so far tells, by a
hypothesis test, whether the whole one can still fall below the k-th distance
(partial > k-th * d/D * (1 + EPSILON / sqrt(d))^2 abandons the candidate); only what is left is
read further. Survivors are scored by their exact inner products on the original vectors in
double precision, ties going to the smaller id.

Lists are split into chunks of about `CHUNK` rows and their queries into blocks of about
`QUERIES`, each pair a task's unit, so no list grows with the data and no vectors are broadcast
but the centres (at most `MOST_LISTS`).

Rows: vectors that are null, empty, zero or hold a null or a component that is not finite take
no part, nor do null ids. Of vectors of several lengths the most frequent takes part (of equally
frequent ones the longest). A repeated id is a candidate in each of its rows. Fewer candidates
than k: all are returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import column, seeded, stored

K = 20
PROBE, FIRST = 0.7, 0.05
LEAST = 200
COLUMNS = 16
EPSILON = 2.1
SAMPLE = 20_000
MOST_LISTS = 4096
CHUNK, QUERIES = 4096, 2048
SEED = 11


def rotation(size: int) -> np.ndarray:
    """A seeded random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of equal length: one more component makes up for what a vector lacks."""
    rest = np.sqrt(np.maximum(longest - (vectors * vectors).sum(1), 0.0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def k_means(points: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    random = np.random.default_rng(SEED)
    centres = points[random.choice(len(points), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)
        order = np.argsort(own, kind="stable")
        there, starts = np.unique(own[order], return_index=True)
        centres[there] = np.add.reduceat(points[order], starts) / np.diff(
            np.append(starts, len(points)))[:, None]
    return centres


def scan(x: np.ndarray, q: np.ndarray, limits: np.ndarray, columns: int = COLUMNS,
         epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate, squared distance) that no test abandons.

    Columns are read block by block: while many pairs are left for all at once, then only for
    the pairs that are.
    """
    size = x.shape[1]
    far = np.zeros((len(q), len(x)), np.float32)
    pairs = None
    for low in range(0, size, columns):
        high = min(low + columns, size)
        a, b = q[:, low:high], x[:, low:high]
        share = np.float32(1.0) if high == size else np.float32(
            high / size * (1 + epsilon / np.sqrt(high)) ** 2)
        bound = limits * share * np.float32(1 + 1e-4)
        if pairs is None:
            far += (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
            left = far <= bound[:, None]
            if left.mean() < 0.25 or high == size:
                i, j = np.nonzero(left)
                pairs = i, j, far[i, j]
        else:
            i, j, d = pairs
            step = a[i] - b[j]
            d = d + (step * step).sum(1)
            left = d <= bound[i]
            pairs = i[left], j[left], d[left]
    return pairs


def nearest(x, x_ids, x_own, q, q_ids, q_own, limits, k: int) -> tuple:
    """The k best candidates of each query: query ids, candidate ids, exact inner products."""
    out = [], [], []
    for at in range(0, len(q), 128):
        part = slice(at, at + 128)
        i, j, d = scan(x, q[part], limits[part])
        other = x_ids[j] != q_ids[part][i]
        i, j, d = i[other], j[other], d[other]
        if not len(i):
            continue
        # Those that rounding may have put behind the k-th are kept for the exact scores.
        order = np.lexsort((d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(q[part])))
        kth = np.minimum(first + k - 1, np.append(first[1:], len(i)) - 1)
        close = d <= d[np.maximum(kth, 0)][i] * (1 + 1e-4) + 1e-4
        i, j = i[close], j[close]
        score = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            c = slice(s, s + (1 << 16))
            score[c] = (x_own[j[c]] * q_own[part][i[c]]).sum(1)
        order = np.lexsort((x_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        for o, v in zip(out, (q_ids[part][i[best]], x_ids[j[best]], score[best])):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def _matrix(array, kind) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(kind, copy=False)


def usable(vector: Column) -> Column:
    """A vector with finite components, not all of them 0."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda v: v != 0)


class Index:
    """Lists of rotated vectors in a stored table, and what a search needs of them."""

    def __init__(self, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding"):
        raw = column(vector).cast("array<double>")
        rows = vectors.select(column(vec_id).cast("long").alias("id"), raw.alias("own")).where(
            F.col("id").isNotNull() & usable(F.col("own")))
        widths = rows.groupBy(F.size("own").alias("w")).agg(
            F.count("*").alias("n"), F.max(F.aggregate(
                "own", F.lit(0.0), lambda a, v: a + v * v)).alias("longest"))
        top = widths.orderBy(F.desc("n"), F.desc("w")).first()
        self.empty = top is None
        self.schema = "query_id long, vec_id long, score double"
        if self.empty:
            self.rows = vectors.sparkSession.createDataFrame([], self.schema)
            return
        width, self.count, longest = top
        rows = rows.where(F.size("own") == width)
        turn = rotation(width + 1).astype(np.float64)
        sample = rows.orderBy(seeded(SEED, F.col("id")), "id").limit(SAMPLE).select("own") \
            .toArrow()
        points = lifted(_matrix(sample["own"], np.float64), longest) @ turn
        wanted = int(np.clip(round(np.sqrt(self.count) / 2), 1, MOST_LISTS))
        centres = k_means(points, min(wanted, len(points)))
        self.turn, self.longest, self.centres = turn, float(longest), centres

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            half = 0.5 * (centres * centres).sum(1)
            for batch in batches:
                if not len(batch):
                    continue
                own = _matrix(batch.column("own"), np.float64)
                x = lifted(own, longest) @ turn
                lists = np.argmax(x @ centres.T - half, axis=1)
                flat = pa.array(x.astype(np.float32).reshape(-1))
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("own"), pa.array(lists, pa.int32()),
                     pa.ListArray.from_arrays(at, flat)], names=["id", "own", "list", "x"])

        self.rows = stored(rows.mapInArrow(
            deal, "id long, own array<double>, list int, x array<float>"), "index")

    def _probes(self, queries: DataFrame, k: int) -> DataFrame:
        """Query rows, once for each list to probe; `first` marks those scanned in full."""
        sizes = np.zeros(len(self.centres), np.int64)
        for r in self.rows.groupBy("list").count().collect():       # one row per list
            sizes[r["list"]] = r["count"]
        centres, turn = self.centres, self.turn
        enough = max(PROBE * self.count, min(self.count, max(LEAST, 2 * k)))
        early = max(FIRST * self.count, min(self.count, 2 * k))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                own = _matrix(batch.column("own"), np.float64)
                # The query's own extra component is 0: a shorter vector is no nearer for it.
                q = np.concatenate([own, np.zeros((len(own), 1))], axis=1) @ turn
                near = np.argsort(0.5 * (centres * centres).sum(1) - q @ centres.T, axis=1,
                                  kind="stable")
                before = np.cumsum(sizes[near], axis=1) - sizes[near]
                i, rank = np.nonzero((before < enough) & (sizes[near] > 0))
                flat = pa.array(q[i].astype(np.float32).reshape(-1))
                at = pa.array(np.arange(len(i) + 1, dtype=np.int32) * q.shape[1])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(i)), batch.column("own").take(pa.array(i)),
                    pa.array(near[i, rank], pa.int32()), pa.ListArray.from_arrays(at, flat),
                    pa.array(before[i, rank] < early)],
                    names=["id", "own", "list", "x", "first"])

        return queries.select("id", "own").mapInArrow(
            route, "id long, own array<double>, list int, x array<float>, first boolean")

    def _scan(self, probes: DataFrame, k: int) -> DataFrame:
        """Scan each probed list for its queries; `probes` has a `limit` (squared distance)."""
        units = self.rows.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(
            probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "list")
        units = F.broadcast(units)                                  # one row per list
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))                          # noqa: E731
        left = self.rows.join(units, "list").withColumn("chunk", place("chunks")).withColumn(
            "block", every("blocks"))
        right = probes.join(units, "list").withColumn("block", place("blocks")).withColumn(
            "chunk", every("chunks"))
        keys = ["list", "chunk", "block"]

        def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
            found = ([], [], [])
            if len(rows) and len(queries):
                found = nearest(
                    _matrix(rows["x"], np.float32), rows["id"].to_numpy(),
                    _matrix(rows["own"], np.float64), _matrix(queries["x"], np.float32),
                    queries["id"].to_numpy(), _matrix(queries["own"], np.float64),
                    queries["limit"].to_numpy().astype(np.float32), k)
            return pa.table({"query_id": pa.array(found[0], pa.int64()),
                             "vec_id": pa.array(found[1], pa.int64()),
                             "score": pa.array(found[2], pa.float64())})

        return left.select(*keys, "id", "own", "x").groupBy(*keys).cogroup(
            right.select(*keys, "id", "own", "x", "limit").groupBy(*keys)).applyInArrow(
            run, self.schema)

    def search(self, queries: Column, k: int = K) -> DataFrame:
        """`query_id`, `rank`, `vec_id`, `score` for the indexed rows that `queries` selects.

        `queries` is a condition on the column `id`.
        """
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        if self.empty:
            return self.rows.selectExpr("query_id", "0 as rank", "vec_id", "score")
        probes = stored(self._probes(self.rows.where(queries), k), "probes")
        first = stored(self._scan(probes.where("first").withColumn(
            "limit", F.lit(float("inf"))), k), "first")
        ranked = first.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        # The k-th score so far, as a squared distance between lifted vectors.
        kth = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
        square = F.aggregate("own", F.lit(0.0), lambda a, v: a + v * v)
        limit = F.coalesce(square + self.longest - 2 * F.col("score"), F.lit(float("inf")))
        rest = probes.where("not first").join(kth, "id", "left").withColumn("limit", limit)
        found = first.union(self._scan(rest, k))
        return found.withColumn("rank", F.row_number().over(rank)).where(
            F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Index(vectors).search(F.col("id") % 20 == 0)
