import random

import numpy as np
from pyspark.sql import functions as F

from warpsift.llm import divergence, perfect
from warpsift.llm.common import stored

DOCS = "doc_id bigint, text string, lang string, source string"


def folder_of(docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return f"{tmp_path}/{name}"


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(divergence.op13_perfect_recount(spark, sf_dir)) == duck(divergence.OP13_SQL)


def test_query_equals_sql_on_odd_rows(spark, odd_docs, no_docs, duck, rows_of, tmp_path):
    more = spark.createDataFrame(
        [(i, f"Ünï UNÏ word{'abc'[i % 3]} KELVINK {'x' * (i % 5)}`{{\x7f é", "xx", s)
         for i in range(40) for s in ("a", "b", None, "ß")]
        + [(i, "only here", lang, "a") for i, lang in enumerate(("l1", "l2", None, ""))]
        + [(i, None, "nothing", s) for i, s in enumerate("abc")], DOCS)
    docs = odd_docs.drop("n_chars").unionByName(more)
    for name, some in (("odd", docs), ("none", no_docs), ("extra", docs.withColumns(
            {c: F.lit(1) for c in ("word", "n", "shard", "slot", "kind", "value", "item")}))):
        folder = folder_of(some, tmp_path, name)
        assert rows_of(divergence.op13_perfect_recount(spark, folder)) == duck(
            divergence.OP13_SQL, folder)


def test_small_shards_and_the_shuffled_recount_give_the_same(spark, sf_dir, rows_of, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = rows_of(divergence.divergence(docs))
    assert rows_of(divergence.divergence(docs, bound=0)) == want
    monkeypatch.setattr(divergence, "SHARD_WORDS", 100)
    assert rows_of(divergence.divergence(docs)) == want
    assert rows_of(divergence.divergence(docs, bound=0)) == want


def test_few_words_at_a_time(spark, sf_dir):
    """Tables that are handed on early add up to the same."""
    import pyarrow as pa
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(50))
             for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 60, "text": [t.encode() for t in texts]})

    def found():
        total = {}
        for b in divergence._frequencies(iter([batch])):
            for w, n in zip(b["word"].to_pylist(), b["n"].to_pylist()):
                total[w] = total.get(w, 0) + n
        return total
    whole = found()
    assert whole == {w.encode(): sum(w in t.split() for t in texts)
                     for w in set(" ".join(texts).split())}
    held, divergence._HELD_WORDS = divergence._HELD_WORDS, 5
    try:
        assert found() == whole
    finally:
        divergence._HELD_WORDS = held


def test_long_texts_are_cut_between_words():
    parts = [p.split() for p in divergence.pieces(
        b"Ab cd\t" * 400_000 + b"e" * 3_000_000 + b" f")]
    assert len(parts) > 2 and [len(p) for p in parts].count(0) == 0
    words = [w for p in parts for w in p]
    assert len(words) == 800_002 and words[-1] == b"f" and words[0] == b"ab"


def test_words_are_runs_of_letters():
    import re
    text = "".join(map(chr, range(256))) + "Ünï-UNÏ_x9y`Z{\u212a\u0130"
    data = text.encode()
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain)
    assert [w.decode() for p in divergence.pieces(data) for w in p.split()] == want


def test_counts_with_little_room(spark, sf_dir, rows_of, monkeypatch):
    """Rows of slots handed on early, and forgotten words, change nothing."""
    import pyarrow as pa
    rng = random.Random(8)
    docs = [(rng.choice("xy"), rng.choice("ab"), " ".join(
        rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(40))) for _ in range(80)]
    kept = {lang: [w * n for w in map(str.encode, "abcdef") for n in (1, 2, 3)] for lang in "xz"}

    class Shared:
        value = {}

    for lang, words in kept.items():
        shard = perfect.hashed(words) % np.uint64(2)
        tables = [perfect.build([w for w, x in zip(words, shard) if x == s]) for s in range(2)]
        Shared.value[lang] = [(t.sizes, t.table, t.keys, t.spare) for t in tables]
    batch = pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), [
        list(c) for c in zip(*[(a, b, t.encode()) for a, b, t in docs])])))

    def found():
        total = {}
        for b in divergence._recount(Shared)(iter([batch])):
            r = b.to_pylist()[0]
            keys = perfect.PerfectHash(*Shared.value[r["lang"]][r["shard"]]).keys
            for s, n in zip(r["slots"], r["counts"]):
                key = r["lang"], r["source"], keys[s]
                total[key] = total.get(key, 0) + n
        return total

    want = {}
    for lang, source, text in docs:
        for w in text.encode().split():
            if w in kept.get(lang, []):
                want[lang, source, w] = want.get((lang, source, w), 0) + 1
    assert found() == want
    monkeypatch.setattr(divergence, "_PIECE", 100)
    assert found() == want
    monkeypatch.setattr(divergence, "_HELD_BYTES", 10)
    assert found() == want


def test_shares_are_exact():
    rng = random.Random(1)
    whole = [rng.randrange(1, 9 * 10 ** 15) for _ in range(2000)] + [1, 2, 10 ** 9]
    counts = [rng.randrange(0, w) for w in whole]
    got = divergence.shares(np.array(counts, np.int64), np.array(whole, np.int64))
    assert got.tolist() == [1 + 10 ** 9 * (c + 1) // w for c, w in zip(counts, whole)]


def test_perfect_hash():
    rng = random.Random(2)
    keys = list({rng.randbytes(rng.choice([1, 3, 7, 8, 9, 16, 17, 64, 65, 200]))
                 for _ in range(5000)} | {b"", b"\0", b"\0\0"})
    table = perfect.build(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert [table.keys[s] for s in slots] == keys
    others = [k + b"!" * 203 for k in keys] + [b"\0\0\0", *[
        k[:-1] + bytes([k[-1] ^ 1]) for k in keys if len(k) > 6]]
    others = [w for w in others if w not in set(keys)]
    assert (table.slots(others) == -1).all()
    none = perfect.build([])
    assert len(none) == 0 and none.slots([b"x"]).tolist() == [-1] and none.slots([]).tolist() == []


def test_shards_side_by_side():
    rng = random.Random(4)
    keys = list({rng.randbytes(rng.randrange(1, 20)) for _ in range(3000)})
    shard = perfect.hashed(keys) % np.uint64(7)
    parts = [perfect.build([k for k, x in zip(keys, shard) if x == s]) for s in range(7)]
    both = perfect.Shards(parts)
    at = both.find(*perfect.laid_out(keys))
    assert sorted(at.tolist()) == list(range(len(keys)))
    named = [k for p in parts for k in p.keys]
    assert [named[i] for i in at] == keys
    assert (both.find(*perfect.laid_out([k + b"xyz" * 9 for k in keys])) == -1).all()


def test_keys_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(perfect, "hashes_of", lambda data, starts, lengths: lengths.astype(np.uint64))
    keys = [b"a", b"b", b"cc", b"d", b"eee"]
    table = perfect.build(keys)
    assert table.spare == 3
    assert sorted(table.slots(keys).tolist()) == list(range(5))
    assert table.slots([b"x", b"yy"]).tolist() == [-1, -1]


def test_words_are_dealt_out_alike_in_spark(spark):
    words = [bytes([97 + i % 26]) * (i % 30 + 1) for i in range(300)]
    hashes = perfect.hashed(words)
    for n in (1, 3, 50):
        df = spark.createDataFrame([(int(h), n) for h in hashes.view(np.int64)],
                                   "hash long, shards int")
        assert [r[0] for r in df.select(divergence._shard()).collect()] == (
            hashes % np.uint64(n)).tolist()


def test_pairs_of_a_language_without_words(spark):
    docs = stored(spark.createDataFrame([(1, "a", "x", "s"), (2, "b", "x", "t")], DOCS), "two")
    rows = divergence.divergence(docs).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in rows) == [
        ("s", "pair", "t", 0, 1), ("t", "pair", "s", 0, 1)]
