"""Fuzzy search for short licence notices.

A text is brought to lower-case words joined by single spaces. A notice that may have `k` edits
is split into `k + 1` pieces: by the pigeonhole principle one piece must stand there unedited.
All pieces of all notices are found in one pass (Aho-Corasick); each find proposes a place of its
notice, and the regex library's bounded-error matching verifies it there, from the bound of a
word to the bound of a word, counts the edits and gives the span (edits are edits of UTF-8 bytes). Overlapping proposals of a notice are verified as one stretch, so a piece that is
repeated all over a text costs no more than the text.

Beside the notices, exact phrases are counted: places where their words stand one after the other.

Rows: a null text is an empty one; an empty text has no words, no labels and score 0. Very long
texts are searched whole. Repeated rows are searched each. An empty table gives an empty result.
Extra columns are ignored. Everything happens in the task that reads the row; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import column

#: Exact phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"),
           ("cc by", "cc-by"), ("mit license", "mit"))

#: Short notices of common public licences, as words, and their labels.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("creative commons attribution", "cc-by"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
    ("apache license", "apache"),
    ("apache license version 2 0", "apache"),
    ("the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under cc by", "cc-by"),
)
#: One edit for every so many characters, `MOST_EDITS` at most.
CHARS_PER_EDIT = 12
MOST_EDITS = 4

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122
               else 32 for c in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, spans array<struct<label: string, "
          "start: long, end: long, edits: int, found: string>>")


@lru_cache(maxsize=1)
def _matcher():
    """The automaton of all pieces, and the pattern and edits of each notice."""
    automaton, patterns, at = ahocorasick.Automaton(), [], {}
    for n, (notice, _) in enumerate(NOTICES):
        edits = max(1, min(MOST_EDITS, len(notice) // CHARS_PER_EDIT))
        cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            at.setdefault(notice[a:b], []).append((n, a))
        # Bounds of words on both sides; the edits are inside.
        patterns.append((regex.compile(
            f"(?e)(?<![^ ])(?:{regex.escape(notice)}){{e<={edits}}}(?![^ ])"), edits))
    for piece, places in at.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, patterns


def fuzzy_places(words: str) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of each verified place in a text of single-spaced words."""
    automaton, patterns = _matcher()
    proposed: dict[int, list[list[int]]] = {}
    for end, (length, places) in automaton.iter(words):
        for n, offset in places:
            edits = patterns[n][1]
            low = max(0, end - length + 1 - offset - edits)
            high = end - length + 1 - offset + len(NOTICES[n][0]) + edits
            stretches = proposed.setdefault(n, [])
            if stretches and low <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], high)
                stretches[-1][0] = min(stretches[-1][0], low)
            else:
                stretches.append([low, high])
    found = []
    for n, stretches in sorted(proposed.items()):
        for low, high in stretches:
            # A stretch ends with a word, as the end of the search counts as one.
            high = words.find(" ", high)
            for m in patterns[n][0].finditer(words, low, high if high >= 0 else len(words)):
                found.append((n, m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def scan_text(text: str) -> tuple:
    """The columns of `RESULT` after doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    joined = b" ".join(words)
    padded = b" " + joined + b" "
    hits, labels = [], set()
    for phrase, label in PHRASES:
        needle = b" " + phrase.encode() + b" "
        at = padded.find(needle)
        while at >= 0:
            hits.append(at)
            labels.add(label)
            at = padded.find(needle, at + 1)
    base, score, spans = sorted(labels), 1.0 if labels else 0.0, []
    # Bytes as characters one to one, so that offsets and words agree.
    places = fuzzy_places(joined.decode("latin-1"))
    if hits or places:
        begins = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    starts = [bisect.bisect_right(begins, at) - 1 for at in hits]
    if places:
        bounds = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        for n, low, high, edits in places:
            notice, label = NOTICES[n]
            first = bisect.bisect_right(begins, low + (joined[low:low + 1] == b" ")) - 1
            last = bisect.bisect_right(begins, high - 1 - (joined[high - 1:high] == b" ")) - 1
            start, end = bounds[first][0], bounds[last][1]
            spans.append({"label": label, "start": start, "end": end, "edits": edits,
                          "found": text[start:end]})
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(base), ",".join(sorted(labels)), score, spans)


def find_notices(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: counts, labels, score and the spans of all notices found."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
        ("edits", pa.int32()), ("found", pa.string())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
             "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *scan_text(value.as_py() or ""))
                    for key, value in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(column(doc_id).cast("long").alias("doc_id"),
                       column(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def op3_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_notices(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word",
                                     "base_labels", "labels", "score", "spans")
