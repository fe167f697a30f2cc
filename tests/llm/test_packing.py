import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from warpsift.llm import packing
from warpsift.llm.tokens import encoder


def whole(text):
    return [*encoder(None).whole(text or "").tolist(), 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(
    list("abz'st 's 're<|>endoftext½²µßÿ\t\n\x0b\x1c\x85\xa0éÉİſΣς😀")))))
def test_word_table_gives_the_tokenizers_ids(text):
    assert encoder(None).encode(text).tolist() == encoder(None).whole(text).tolist()


def test_table_starts_anew(monkeypatch):
    from warpsift.llm import tokens
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    e = tokens.Encoder(__import__("public_tokenizers").path("word_bpe_49k.json"))
    for t in ("a b c d e f", "g h a", "i j k l m", "a b"):
        assert e.encode(t).tolist() == e.whole(t).tolist()


def naive(lengths, size):
    rooms, windows = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(size)
            fits = [(size, len(rooms) - 1)]
        room, i = min(fits)
        rooms[i] = room - n
        windows.append(room)
    return windows, len(rooms)


def test_tightest_window_against_a_plain_search():
    r = random.Random(3)
    for size in (1, 7, 64, 100, 4096):
        for _ in range(20):
            lengths = sorted((r.randint(1, size) for _ in range(r.randint(0, 200))), reverse=True)
            windows, offsets = packing.best_fit_decreasing(lengths, size)
            rooms, count = naive(lengths, size)
            assert [size - o for o in offsets] == rooms
            assert len(set(windows)) == count


def check(spark, docs, window=packing.WINDOW):
    pieces = packing.cut_documents(docs, window=window, with_ids=True)
    packed = packing.pack(pieces, window=window, block=7).collect()
    by = {}
    for r in packed:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(
            np.array(r.ids, "<u4").tobytes())
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(by) == list(range(len(by)))
    return packed


def test_round_trip(spark, odd_docs):
    packed = check(spark, odd_docs, window=256)
    want = sorted(map(str, (whole(r.text) for r in odd_docs.collect())))
    docs, copies = {}, []
    for r in sorted(packed, key=lambda r: (str(r.doc_id), r.start)):
        docs.setdefault((r.doc_id, r.start), []).append(r)
    for r in packed:                       # rows with equal ids are told apart by their pieces
        if r.start == 0:
            ids, at = list(r.ids), len(r.ids)
            while at < r.doc_tokens:
                following = docs[(r.doc_id, at)][0]
                ids += following.ids
                at += following.length
            copies.append(str(ids))
    assert sorted(copies) == want


def test_query(spark, sf_dir, no_docs, tables):
    rows = packing.op10_best_fit(spark, sf_dir).collect()
    used = sum(r.length for r in rows)
    full = 4096 * len({r.sequence_id for r in rows})
    assert used / full > 0.97
    assert packing.op10_best_fit(spark, tables(no_docs)).count() == 0


def test_sequences(spark, odd_docs):
    packed = packing.pack(packing.cut_documents(odd_docs, with_ids=True))
    rows = packing.sequences(packed, pad=9).collect()
    assert all(len(r.ids) == 4096 and set(r.ids[r.length:]) <= {9} for r in rows)
    assert sum(r.length for r in rows) == sum(len(whole(r.text)) for r in odd_docs.collect())
