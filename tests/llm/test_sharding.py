import collections

import pytest
from pyspark.sql import functions as F

from warpsift.llm import sharding
from warpsift.llm.common import running


def test_query_equals_sql(spark, sf_dir, duck, rows_of):
    assert rows_of(sharding.op1_interleave(spark, sf_dir)) == duck(sharding.OP1_SQL)


def test_shards_match_the_mixture_with_a_hot_source(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    rows = sharding.interleave(df, shards=10).collect()
    assert collections.Counter(r.shard for r in rows) == {s: 300 for s in range(10)}
    for s in range(10):
        of = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in of) == list(range(300))
        # Seven equal sources come in turns of seven.
        assert abs(sum(r.source == "hot" for r in of) - 200) <= 3


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.interleave(odd_docs.select("doc_id", "source", "n_chars"), shards=5).collect()
    assert len(rows) == odd_docs.count()
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.interleave(no_docs).count() == 0
    assert len(sharding.interleave(odd_docs.limit(2), shards=40).collect()) == 2


def test_names(spark, odd_docs):
    with pytest.raises(ValueError):
        sharding.interleave(odd_docs.withColumnRenamed("lang", "Shard"))
    out = sharding.interleave(odd_docs.withColumns({"_h": F.lit(1), "_rank": F.lit("x"),
                                                    "a`b.c": F.lit(2)}))
    assert {"_h", "_rank", "a`b.c", "shard", "slot"} <= set(out.columns) and out.count() == 12


def test_whole_rows_are_written(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == odd_docs.count() and back.select("shard").distinct().count() == 3


def test_running_sums_across_ranges(spark, monkeypatch):
    from warpsift.llm import common
    monkeypatch.setattr(common, "RANGE_ROWS", 40)
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                  (F.col("id") * 7 % 11).cast("long").alias("v"))
    seen = collections.defaultdict(int)
    for r in sorted(running(df, ["g"], ["o"], {"s": "v"}, "t").collect(), key=lambda r: r.o):
        seen[r.g] += r.v
        assert r.s == seen[r.g]
        assert r.s_all == sum(i * 7 % 11 for i in range(1000) if i % 3 == r.g)
