"""Best-fit decreasing packing of token documents into windows of a fixed length.

A document's ids (its text's, then an end mark) are first cut into full windows; what
remains is shorter than a window. Remainders are taken longest first, and a segment tree
over the remaining capacities finds the tightest open window that still has room.

A corpus is packed in blocks of at most `BLOCK_PIECES` pieces, dealt out evenly whatever the
documents are; each block leaves at most a few windows unfilled, so the padding does not
depend on the number of blocks in any way that matters.

Rows: a null text is an empty one, and an empty text is the end mark alone. Repeated rows are
documents of their own, each with its own pieces. Very long texts are cut, never shortened.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import column, stored
from .tokens import encoder

WINDOW = 4096
END = 2
BLOCK_PIECES = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  window: int = WINDOW, tokenizer: str | None = None, end: int = END,
                  with_ids: bool = False) -> DataFrame:
    """One row per piece: full windows of a long document, then its remainder.

    `tokenizer` is the path of a tokenizer file, the same on every machine (None: the box's
    word tokenizer). With `with_ids` each piece also has its ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end)).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at:at + window]
                    row = (key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))
                    rows.append((*row, piece.astype(np.int32)) if with_ids else row)
            columns = list(zip(*rows)) if rows else [[]] * (6 if with_ids else 5)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    pairs = docs.select(column(doc_id).cast("long").alias("doc_id"),
                        column(text).cast("string").alias("text"))
    return pairs.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


class OpenWindows:
    """A segment tree over capacities 0 to `size`: which open windows have how much room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _mark(self, capacity: int, there: bool) -> None:
        node = capacity + self.leaves
        self.some[node] = there
        while node > 1:
            node >>= 1
            now = self.some[2 * node] or self.some[2 * node + 1]
            if self.some[node] == now:
                return
            self.some[node] = now

    def add(self, window: int, capacity: int) -> None:
        self.windows[capacity].append(window)
        if len(self.windows[capacity]) == 1:
            self._mark(capacity, True)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least capacity of `length` or more."""
        node = length + self.leaves
        while not self.some[node]:
            while node & 1:          # a right child: nothing more to the right below its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1                # the sibling to the right
        while node < self.leaves:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            self._mark(capacity, False)
        return window, capacity


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; lengths must come longest first."""
    open_windows, opened = OpenWindows(size), 0
    windows, offsets = [], []
    for length in lengths:
        found = open_windows.tightest(length)
        if found is None:
            found = (opened, size)
            opened += 1
        window, room = found
        windows.append(window)
        offsets.append(size - room)
        if room > length:
            open_windows.add(window, room - length)
    return windows, offsets


def pack(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK_PIECES) -> DataFrame:
    """Add `sequence_id` (gapless from 0) and `offset` to pieces with a `length`.

    Each row needs the columns of `PIECES`; further ones are carried along, so leave ids out
    and join them to the plan afterwards (`sequences`).
    """
    table = stored(pieces, "pieces")
    blocks = max(1, -(-table.count() // block))
    schema = T.StructType([*table.schema.fields, T.StructField("_block", T.LongType()),
                           T.StructField("_window", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).sort_by([
            ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
            ("ids_crc32", "ascending")])
        windows, offsets = best_fit_decreasing(rows["length"].to_pylist(), window)
        at = [TaskContext.get().partitionId()] * len(windows)
        for name, values in (("_block", at), ("_window", windows), ("offset", offsets)):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        yield from rows.to_batches()

    # Dealt out in turn, not by key: no group of equal rows can fill a block of its own.
    dealt = table.repartition(blocks).mapInArrow(run, schema)
    packed = stored(dealt, "packed")
    sizes = packed.groupBy("_block").agg((F.max("_window") + 1).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row per block of 20,000 pieces.
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return packed.join(starts, "_block").withColumn(
        "sequence_id", F.col("_from") + F.col("_window")).select(
        *table.columns, "sequence_id", "offset")


def sequences(packed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The token sequences themselves: one row each, padded to the window.

    `packed` has `sequence_id`, `offset` and `ids`. A sequence is one window long, so a
    group is bounded by it.
    """
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("_i"))
    return joined.select("sequence_id", F.size("_i").cast("long").alias("length"), F.concat(
        "_i", F.array_repeat(F.lit(pad), F.lit(window) - F.size("_i"))).alias("ids"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(cut_documents(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
