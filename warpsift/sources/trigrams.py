"""A trigram index beside stored files: which texts can hold a word, without reading them.

One narrow row per file: its keys, the length of its text, and a set of bits with one bit for
each sequence of three ASCII characters that the text holds, A-Z lower-cased. The set is sized by
the text (two to four bits per distinct sequence), so short files cost little and long ones are
told apart as well. A word can stand in a text only if the bits of all its sequences are set; bits
that several sequences share let some texts pass that lack the word, never the other way round.

The bits are worked out batch by batch in Arrow when files are stored; tests of the bits are
built-in functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Spark's readers pass over names that begin with an underscore, so the files' own folder can
#: hold the index without showing it.
FOLDER = "_trigrams"
INDEX = ("repo_part int, repo_id bigint, path string, abs_path string, chars int, "
         "bits array<bigint>")
_BITS_EACH = 2


def _spread(codes: np.ndarray) -> np.ndarray:
    """A 32-bit number for each code of three characters, its low bits well mixed."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
    return mixed ^ mixed >> np.uint64(15)


def _codes(data: bytes) -> np.ndarray:
    """The distinct sequences of three ASCII characters of a lower-cased text."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return np.unique(codes[codes & 0x808080 == 0])


def bits_of(data: bytes) -> np.ndarray:
    """The set of bits of a text, as 64-bit numbers; their count is a power of two."""
    codes = _codes(data.lower()) if len(data) > 2 else np.empty(0, np.uint32)
    size = 64
    while size < _BITS_EACH * len(codes):
        size *= 2
    flags = np.zeros(size, bool)
    flags[(_spread(codes) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.int64)


def numbers_of(word: str) -> list[int]:
    """The numbers of a word's sequences; those with other than ASCII characters are left out."""
    data = word.encode().lower()
    return _spread(_codes(data)).tolist() if len(data) > 2 else []


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [bits_of(t.as_py() or b"") for t in batch.column("data")]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("repo_part", "repo_id", "path", "abs_path", "chars")],
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))],
            names=["repo_part", "repo_id", "path", "abs_path", "chars", "bits"])


def indexed(files: DataFrame) -> DataFrame:
    """The index rows of files in the stored layout."""
    return files.select(
        "repo_part", "repo_id", "path", "abs_path",
        F.coalesce(F.length("content"), F.lit(0)).cast("int").alias("chars"),
        F.col("content").cast("binary").alias("data")).mapInArrow(_index, INDEX)


def write_index(files: DataFrame, path: str) -> None:
    """Build the index of files stored at `path`; each task writes the folders that it reads."""
    indexed(files).write.mode("overwrite").partitionBy("repo_part").parquet(f"{path}/{FOLDER}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/{FOLDER}")


def holds(word: str, bits: str = "bits") -> str:
    """SQL: can a text with these bits hold this word?"""
    mask = f"(CAST(size({bits}) AS BIGINT) * 64 - 1)"
    tests = [f"getbit({bits}[CAST(shiftright({n}L & {mask}, 6) AS INT)], "
             f"CAST({n}L & 63 AS INT)) = 1" for n in numbers_of(word)]
    return "(" + " AND ".join(tests) + ")" if tests else "true"
