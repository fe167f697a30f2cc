import hashlib
import random

import numpy as np
import pytest

from warpsift.llm import fingerprints as fp


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij klmnop") for _ in range(r.randint(2, 9)))
                    for _ in range(n))


def entropy(window):
    p = np.bincount(np.frombuffer(window, np.uint8)) / len(window)
    return -(p[p > 0] * np.log2(p[p > 0])).sum()


def slow_features(text):
    """Window by window."""
    n = len(text) - fp.WINDOW + 1
    e = [entropy(text[i:i + fp.WINDOW]) for i in range(n)]
    rare = [0 if x < fp.LEAST else int(abs(x - fp.USUAL) * 1e4 + 1e-9) for x in e]
    points = [0] * n
    for i in range(n - fp.WINDOW + 1):
        points[max(range(i, i + fp.WINDOW), key=lambda j: (rare[j], -j))] += 1
    return [i for i in range(n) if points[i] >= fp.POPULARITY and rare[i] > 0]


@pytest.mark.parametrize("seed", range(6))
def test_features_against_the_slow_way(seed):
    text = words(seed, 300).encode()
    fast = fp._popular(np.frombuffer(text, np.uint8)).tolist()
    slow = slow_features(text)
    # Entropies that differ in the 12th digit may order two windows of equal rarity otherwise.
    assert len(set(fast) ^ set(slow)) <= 0.05 * len(slow) + 1


def test_blocks_do_not_show(monkeypatch):
    text = words(1, 5000).encode()
    whole = fp.features(text)
    monkeypatch.setattr(fp, "BLOCK", 777)
    assert fp.features(text).tolist() == whole.tolist()


def test_likeness():
    a, b = words(1, 900), words(2, 900)
    x, y = fp.digest(a), fp.digest(b)
    half = fp.digest(a[:len(a) // 2] + b[len(b) // 2:])
    assert fp.likeness(x, x) == 1 and fp.likeness(x, y) == fp.likeness(y, x) < 0.15
    assert 0.25 < fp.likeness(x, half) < 0.9
    assert fp.likeness(b"", b"") == 1 and fp.likeness(b"", x) == 0
    assert len(fp.digest(words(3, 20_000))) > 10 * fp.FILTER_BITS // 8


def plain(rows):
    out = {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = fp.digest(text), fp.digest(edited), fp.digest(after)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(),
                    fp.likeness(a, b), fp.likeness(a, c))
    return out


def test_query_against_the_plain_way(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = plain([(r.doc_id, r.text or "") for r in docs])
    assert {r.doc_id: tuple(r)[1:] for r in fp.op2_digest(spark, sf_dir).collect()} == want


def test_odd_rows(spark, odd_docs, no_docs, tables):
    rows = fp.op2_digest(spark, tables(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    marks = {r.doc_id: r.fingerprint for r in rows}
    assert marks[6] == marks[7] and marks[2] == marks[3] == ""
    assert fp.op2_digest(spark, tables(no_docs)).count() == 0
    one = fp.op2_digest(spark, tables(odd_docs.where("doc_id = 1"))).collect()
    assert one[0].near_next == 1.0
    assert fp.fingerprint(odd_docs.withColumnRenamed("lang", "fingerprint")).count() == 12
