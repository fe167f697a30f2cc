import itertools
import random

import numpy as np

from pyspark.sql import functions as F

from warpsift.llm import neardup as nd
from warpsift.llm.components import components
from tests.llm.conftest import doc


def make(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10 ** 6)}" for _ in range(n)]


def edit(words, seed, n):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10 ** 6)}"
    return out


def plain(rows):
    """Smallest id of each group, comparing all pairs."""
    sets = [nd.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a is not None and (a == b or b is not None and nd.similarity(
                sets[i], sets[j]) >= nd.SIMILARITY):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return {key: least[find(i)] for i, (key, _) in enumerate(rows)}


def clusters(df):
    return {r.doc_id: r.cluster_id for r in df.collect()}


def test_signatures_agree_as_often_as_the_sets_are_alike():
    r = np.random.default_rng(1)
    for shared, weight in ((300, 1), (150, 3), (30, 1)):
        hits = []
        for trial in range(60):
            ids = r.integers(0, 2 ** 63, 600 - shared).astype(np.uint64)
            a, b = ids[:300], np.concatenate([ids[:shared], ids[300:]])
            w = lambda x: np.where(np.arange(len(x)) % 2, weight, 1)
            x = (np.sort(a), w(a)[np.argsort(a)])
            y = (np.sort(b), w(b)[np.argsort(b)])
            want = nd.similarity(x, y)
            hits.append((nd.sketch(*x) == nd.sketch(*y)).mean() - want)
        assert abs(np.mean(hits)) < 0.03


def test_sketch_of_few_and_of_many():
    one = nd.sketch(np.array([5], np.uint64), np.array([1]))
    assert (one != 0).all()
    many = nd.sketch(np.arange(1, 50_000, dtype=np.uint64), np.ones(49_999))
    assert (many != 0).all()
    heavy = nd.sketch(np.array([5, 9], np.uint64), np.array([1000, 1]))
    assert (heavy != 0).all()


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    out = nd.op7_dartminhash(spark, sf_dir)
    assert clusters(out) == plain(rows)
    assert all(r.stays == (r.doc_id == r.cluster_id) and r.class_id >= r.cluster_id
               for r in out.collect())


def test_group_of_copies_and_near_copies(spark, monkeypatch):
    """Copies of a base, some farther than 0.8 from it but near each other."""
    base = make(1, 150)
    rows = [(i, " ".join(edit(base, i, i % 8))) for i in range(60)]
    far = edit(base, 99, 9)
    rows += [(100 + i, " ".join(edit(far, 200 + i, 1))) for i in range(6)]
    rows += [(300 + i, rows[0][1]) for i in range(50)] + [(400 + i, " ".join(make(i + 5, 80)))
                                                         for i in range(20)]
    docs = spark.createDataFrame([doc(*r) for r in rows]).toDF(
        "doc_id", "text", "lang", "source", "n_chars")
    assert clusters(nd.classes(docs)) == plain(rows)
    kept = nd.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain(rows).values()))


def test_links_within_a_group():
    base = make(7, 120)
    sets = [nd.shingles(" ".join(edit(base, i, i % 3))) for i in range(10)]
    keys = np.stack([nd.band_keys(nd.sketch(*s)) for s in sets])
    apart, whole = keys * 0 + np.arange(10)[:, None], np.ones((10, nd.BANDS), bool)
    one = nd.joining_links(sets, apart, list(range(10)), 0, whole, False)
    assert 0 < len(one) <= 9
    assert nd.joining_links(sets, keys, [0] * 10, 0, whole, False) == []
    same = np.ones_like(keys)               # all share band 0, so band 1 looks at none of them
    assert nd.joining_links(sets, same, list(range(10)), 1, whole, False) == []
    assert nd.joining_links(sets, same, list(range(10)), 1, whole, True) == []
    # Shared buckets that are split do not count: the pair is looked at here.
    none = ~whole
    assert len(nd.joining_links(sets, same, list(range(10)), 1, none, False)) == len(one)
    assert len(nd.joining_links(sets, same, list(range(10)), 1, none, True)) == len(one)


class Counted:
    """Numbers of rows that the stages of `classes` store."""

    def __init__(self, monkeypatch):
        self.rows = {}
        plain_stored = nd.stored

        def stored(df, name):
            out = plain_stored(df, name)
            self.rows[name] = self.rows.get(name, 0) + out.count()
            return out
        monkeypatch.setattr(nd, "stored", stored)


def near_group(n, words=130, edits=12):
    """Texts around a base that is not among them: about 0.4 to 0.8 alike, in pairs near copies."""
    base = make(1, words)
    rows = []
    for i in range(n):
        mine = edit(base, 1000 + i // 2, edits // 2 if i % 8 else edits // 6)
        rows.append((i, " ".join(edit(mine, 5000 + i, 1))))
    return rows


def test_large_buckets_are_split_in_proportion(spark, monkeypatch):
    """Groups of 1x, 2x, 4x texts: the rows made grow with the texts, and links are found."""
    monkeypatch.setattr(nd, "GROUP", 12)
    made = []
    for n in (100, 200, 400):
        counted = Counted(monkeypatch)
        rows = near_group(n)
        docs = spark.createDataFrame([doc(*r) for r in rows]).toDF(
            "doc_id", "text", "lang", "source", "n_chars")
        got, want = clusters(nd.classes(docs)), plain(rows)
        pairs = [(i, j) for i, j in itertools.combinations(range(n), 2) if want[i] == want[j]]
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs)
        assert all(want[i] == want[got[i]] for i in range(n))
        made.append(sum(counted.rows.get(k, 0) for k in (
            "units", "parts", "judged-parts", "stars")))
    assert made[2] < 2.6 * made[1] < 2.6 * 2.6 * made[0]


def test_texts_too_long_for_a_group(spark, monkeypatch):
    monkeypatch.setattr(nd, "GROUP_BYTES", 3000)
    rows = near_group(60)
    docs = spark.createDataFrame([doc(*r) for r in rows]).toDF(
        "doc_id", "text", "lang", "source", "n_chars")
    got, want = clusters(nd.classes(docs)), plain(rows)
    pairs = [(i, j) for i, j in itertools.combinations(range(60), 2) if want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.98 * len(pairs) > 0


def test_odd_rows(spark, odd_docs, no_docs):
    found = nd.classes(odd_docs)
    rows = found.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].cluster_id == by[7][0].cluster_id == 6
    assert by[3][0].cluster_id == 3 and by[4][0].cluster_id == 4 and by[2][0].cluster_id == 2
    kept = nd.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "None", "None"])
    assert nd.classes(no_docs).count() == 0 and nd.keep_one(no_docs).count() == 0
    clash = odd_docs.withColumnRenamed("lang", "th").withColumn("keys", F.lit(1))
    assert nd.keep_one(clash).columns == clash.columns


def test_ids_that_are_null(spark):
    text = " ".join(make(3, 60))
    docs = spark.createDataFrame([doc(None, text), doc(4, text + " more"), doc(None, "x y z")]).toDF(
        "doc_id", "text", "lang", "source", "n_chars")
    assert sorted(str(r.cluster_id) for r in nd.classes(docs).collect()) == ["4", "4", "None"]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)},
                   200: 200, 201: 200}
    assert components(df.limit(0), "a", "b").count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """With splits that part everything, links still come out: those left are compared exactly."""
    monkeypatch.setattr(nd, "GROUP", 12)
    monkeypatch.setattr(nd, "DEPTH", 0)
    rows = near_group(120)
    docs = spark.createDataFrame([doc(*r) for r in rows]).toDF(
        "doc_id", "text", "lang", "source", "n_chars")
    assert clusters(nd.classes(docs)) == plain(rows)
