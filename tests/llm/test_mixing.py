import itertools

import pytest
from pyspark.sql import functions as F

from warpsift.llm import mixing
from tests.llm.conftest import doc


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(mixing.op8_min_cost_mix(spark, sf_dir)) == duck(mixing.OP8_SQL)


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert mixing.fill_targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.fill_targets([], []) == []
    for sizes in itertools.product([0, 1, 50, 3000], repeat=4):
        t = mixing.fill_targets(list(sizes), [5, 2, 1, 5])
        assert sum(t) == pytest.approx(sum(sizes)) and all(
            x <= 3 * s + 1e-9 for x, s in zip(t, sizes))


def cost(sizes, used):
    total = 0
    for size, tokens in zip(sizes, used):
        for price in (0, 1, 3):
            step = min(size, tokens)
            total, tokens = total + price * step, tokens - step
    return total


def test_flow_is_the_cheapest():
    """Against all ways of sending a few tokens."""
    patterns = [(2, [0]), (2, [0, 1]), (1, [1])]
    for quotas in itertools.product(range(5), repeat=2):
        best = None
        for a, b0, b1, c in itertools.product(range(7), range(7), range(7), range(4)):
            if a + b0 <= quotas[0] and b1 + c <= quotas[1] and b0 + b1 <= 6:
                key = (-(a + b0 + b1 + c), cost([2, 2, 1], [a, b0 + b1, c]))
                best = key if best is None else min(best, key)
        flows = mixing.min_cost_flow(patterns, list(quotas))
        used = [sum(f.values()) for f in flows]
        for s, quota in enumerate(quotas):
            assert sum(f.get(s, 0) for f in flows) <= quota
        assert (-sum(used), cost([2, 2, 1], used)) == best


def test_overlapping_sources(spark):
    rows = [(i, 10, [["x"], ["x", "y"], ["y"], ["z", None]][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, words bigint, members array<string>")
    out = mixing.mix(df, F.col("words"), F.col("members"), ["doc_id"]).collect()
    assert sum(r.taken for r in out) == pytest.approx(4000, abs=40)
    assert all(r.copies <= 3 for r in out)
    for pattern in (["x"], ["x", "y"], ["y"]):
        of = [r for r in out if r.members == pattern]
        assert sum(r.taken for r in of) == pytest.approx(of[0].flow, abs=10)


def test_odd_rows(spark, odd_docs, no_docs, tables):
    out = mixing.op8_min_cost_mix(spark, tables(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    assert all(r.taken <= 3 * r["size"] and r.size is not None for r in out)
    assert mixing.op8_min_cost_mix(spark, tables(no_docs)).count() == 0
    blank = spark.createDataFrame([doc(1, None, None), doc(2, "", "b")], odd_docs.schema)
    assert {r.taken for r in mixing.op8_min_cost_mix(spark, tables(blank)).collect()} == {0}
    with pytest.raises(ValueError):
        mixing.mix(odd_docs.withColumnRenamed("lang", "Copies"), F.lit(1), F.array("source"),
                   ["doc_id"])


def test_rows_repeat(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 3)], "k string, copies int")
    assert sorted(r.k for r in mixing.repeat_rows(df).collect()) == ["b", "c", "c", "c"]


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    """A third of the rows have no id, a third share one; no source goes beyond its target by them."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, "ab"[i % 2], 20 + i * 37 % 101)
            for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, words bigint")
    out = mixing.mix(df, F.col("words"), F.array("source"), ["doc_id"]).collect()
    assert len(out) == 600
    for source in "ab":
        of = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].flow) <= 10


def test_reruns_agree_where_ids_are_shared_or_missing(spark, sf_dir, duck, rows_of, tmp_path):
    """The same rows in three physical orders, a third of them without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 5 == 0, 7).otherwise(
        F.col("doc_id"))
    odd = docs.withColumn("doc_id", key).unionByName(docs.where("doc_id % 9 = 0"))
    found = []
    for n, rows in enumerate((odd, odd.orderBy("text"), odd.repartition(5, F.length("text")))):
        folder = str(tmp_path / str(n))
        rows.write.parquet(f"{folder}/documents.parquet")
        found.append(rows_of(mixing.op8_min_cost_mix(spark, folder)))
    assert found[0] == found[1] == found[2] == duck(mixing.OP8_SQL, folder)
