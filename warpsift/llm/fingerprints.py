"""Improbable-feature digests of documents, compared by the overlap of Bloom filters.

A text is its UTF-8 bytes. Each window of `WINDOW` bytes has an entropy; the farther it is from
the entropy that is usual for text, the rarer the window (nearly constant windows are left out,
as they say nothing). Of every `WINDOW` consecutive windows the rarest is given a point, and
windows with `POPULARITY` points or more are the features: they depend on the bytes around them
only, so an edit changes the features near it and no others. Features go in order of place into
a chain of Bloom filters of `FILTER_BITS` bits, `PER_FILTER` to each, five bits a feature.

The likeness of two digests compares each filter of the shorter chain with its best match in the
other: the bits in common, less those that chance alone would give, over what the emptier of the
two could have in common, less the same. 1: equal; 0: no more than chance.

The digest is the filters as hexadecimal text; its parameters are constants, no statistic of the
corpus enters, so digests of different runs can be compared.

Rows: a null text is an empty one. A text shorter than a window is one feature; an empty one has
no filter and an empty digest, which is like another empty digest (1) and no other (0). Texts are
read whole, in blocks. Equal texts have equal digests; repeated rows get one each. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import column, stored

WINDOW = 64
POPULARITY = 16
FILTER_BITS = 2048
PER_FILTER = 128
BITS = 5
#: Entropies of a window in bits: usual in text, and the least that tells anything.
USUAL, LEAST = 4.1, 1.0
#: Bytes worked on at a time.
BLOCK = 1 << 17

# c log2 c of the counts in a window, and how that changes when a count goes from c - 1 to c.
_COUNTS = np.arange(WINDOW + 1)
_PHI = np.rint(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 1e6).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_PHI)])


def _popular(data: np.ndarray) -> np.ndarray:
    """Places of the windows that are features; `data` has `WINDOW` bytes at least."""
    n = len(data)
    ahead = np.zeros(n, np.uint8)       # how often the byte comes again within the window after it
    behind = np.zeros(n, np.uint8)      # ... and before it
    for d in range(1, WINDOW):
        same = data[:-d] == data[d:] if d < n else np.empty(0, bool)
        ahead[:n - d] += same
        behind[d:] += same
    windows = n - WINDOW + 1
    first = np.bincount(data[:WINDOW])
    change = _STEP[behind[WINDOW:] + 1] - _STEP[ahead[:windows - 1] + 1]
    total = _PHI[first].sum() + np.concatenate([[0], np.cumsum(change)])
    entropy = np.log2(WINDOW) - total / (WINDOW * 1e6)
    rarity = np.minimum((np.abs(entropy - USUAL) * 1e4).astype(np.int64), (1 << 20) - 1)
    rarity[entropy < LEAST] = 0
    # The rarest of WINDOW windows, the leftmost of equals: one number orders both.
    order = (rarity << 32) | (np.int64(0xFFFFFFFF) - np.arange(windows))
    span = 1
    while span < WINDOW:
        order = np.maximum(order[:-span], order[span:]) if len(order) > span else order.max()[None]
        span *= 2
    best = np.int64(0xFFFFFFFF) - (order & np.int64(0xFFFFFFFF))
    points = np.bincount(best, minlength=windows)
    if windows < WINDOW:                # a short text: its one rarest window
        points[best] = POPULARITY
    return np.flatnonzero((points >= POPULARITY) & (rarity > 0))


def features(text: bytes) -> np.ndarray:
    """64-bit hashes of the features of a text, in order of place, each once."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) < WINDOW:
        return np.array([xxhash.xxh3_64_intdigest(text)], np.uint64)
    data = np.frombuffer(text, np.uint8)
    # Blocks overlap so far that each window has all its neighbours in one of them.
    margin, hashes = 3 * WINDOW, []
    for at in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        low = max(0, at - margin)
        block = data[low:at + BLOCK + margin]
        places = _popular(block) + low if len(block) >= WINDOW else np.empty(0, np.int64)
        places = places[(places >= at) & (places < at + BLOCK)]
        hashes += [xxhash.xxh3_64_intdigest(text[p:p + WINDOW]) for p in places.tolist()]
    if not hashes:                      # nothing stands out: the text as a whole
        hashes = [xxhash.xxh3_64_intdigest(text)]
    every, first = np.unique(np.array(hashes, np.uint64), return_index=True)
    return every[np.argsort(first)]


def digest(text: str | None) -> bytes:
    """The chained Bloom filters of a text, one after the other."""
    found = features((text or "").encode("utf-8", "surrogatepass"))
    if not len(found):
        return b""
    filters = np.zeros((-(-len(found) // PER_FILTER), FILTER_BITS), np.uint8)
    which = np.arange(len(found)) // PER_FILTER
    for k in range(BITS):
        filters[which, ((found >> np.uint64(11 * k)) % FILTER_BITS).astype(np.int64)] = 1
    return np.packbits(filters, axis=1).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal digests."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8)).reshape(-1, FILTER_BITS).astype(np.float32)
            for d in sorted((a, b), key=lambda d: (len(d), d)))
    ones_x, ones_y = x.sum(1)[:, None], y.sum(1)[None, :]
    chance = ones_x * ones_y / FILTER_BITS
    room = np.maximum(np.minimum(ones_x, ones_y) - chance, 1.0)
    score = np.clip((x @ y.T - chance) / room, 0.0, 1.0)
    weights = ones_x[:, 0]
    return float((score.max(1) * weights).sum() / weights.sum())


class _Digests(dict):
    """Digests of the texts seen last, for copies that follow each other."""

    def __missing__(self, text: str) -> bytes:
        if len(self) > 256:
            self.clear()
        value = self[text] = digest(text)
        return value


def fingerprint(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`doc_id`, `fingerprint` (hexadecimal) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Digests()
        for batch in batches:
            marks = [known[t.as_py() or ""].hex() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())],
                                             names=["doc_id", "fingerprint"])

    return docs.select(column(doc_id).cast("long").alias("doc_id"),
                       column(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _edited_row(doc_id, text: str, after: str, known: dict) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + after[:half]
    mark, edited_mark = known[text], digest(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            mark.hex(), edited_mark.hex(), likeness(mark, edited_mark),
            likeness(mark, known[after]))


def _edited_batch(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
             pa.float64()]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return [pa.array(list(c), k) for c, k in zip(columns, kinds)]


_NAMES = [f.split()[0] for f in EDITED.split(", ")]


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprint each document, its edited text, and the document after it.

    Documents are dealt into ranges of doc_id once, so that the next document lies in the same
    task. Only the last document of a range misses its successor: the first and last text of
    each range are put aside and paired at the end. A null id comes before all others; rows with
    equal ids follow each other in the order of their texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Digests(), None
        for batch in batches:
            rows, edges = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if held is None:
                    edges.append((key, text, "first"))
                else:
                    rows.append(_edited_row(*held, text, known))
                held = (key, text)
            yield full(rows, edges)
        if held is not None:
            yield full([], [(*held, "last")])

    def full(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        every = [(*r, None, None) for r in rows] + [
            (key, *[None] * 6, text, role) for key, text, role in edges]
        columns = _edited_batch([r[:7] for r in every])
        columns += [pa.array([r[7] for r in every], pa.string()),
                    pa.array([r[8] for r in every], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "text", "role"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Digests()
        for batch in batches:
            rows = [_edited_row(key.as_py(), text.as_py(), after.as_py(), known)
                    for key, text, after in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays(_edited_batch(rows), names=_NAMES)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ordered.mapInArrow(run, EDITED + ", text string, role string").withColumn(
        "part", F.spark_partition_id()), "digests")
    # Two rows per range. Each last text is followed by the first of the next range, the very
    # last by the very first.
    edges = made.where("role is not null").groupBy("part").agg(
        F.max(F.when(F.col("role") == "first", F.col("text"))).alias("first"),
        F.max(F.when(F.col("role") == "last", F.col("text"))).alias("last"),
        F.max(F.when(F.col("role") == "last", F.col("doc_id"))).alias("doc_id"))
    line = Window.partitionBy(F.lit(0)).orderBy("part")
    after = F.coalesce(F.lead("first").over(line), F.first("first").over(
        line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = edges.select("doc_id", F.col("last").alias("text"), after.alias("after")).repartition(
        "doc_id").mapInArrow(pair, EDITED)
    return made.where("role is null").select(*_NAMES).union(last)


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_study(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
