"""Stored sketches: near the exact counts, merged over any parts, updated part by part."""

from pyspark.sql import functions as F

from warpsift.operators import sketches


def manifest(spark, n, shift=0):
    return spark.range(n).select((F.col("id") % 500).alias("repo_id"), F.concat(
        F.lit("p"), (F.col("id") * 7 % 30_011 + shift).cast("string")).alias("package"),
        F.lit("1").alias("version"))


def test_estimates_and_partial_updates(spark, tmp_path):
    path, first = str(tmp_path / "s"), manifest(spark, 60_000)
    sketches.write_sketches(first, path)
    stored = sketches.read_sketches(spark, path)
    assert stored.count() == sketches.PARTS
    row = sketches.estimates(stored).first()
    assert abs(row.packages - 30_011) < 4 * sketches.ERROR * 30_011 and row.declared == 60_000
    assert abs(row.uses - 60_000) < 4 * sketches.ERROR * 60_000
    # Two parts change: their sketches are replaced, all others stay as they are.
    before = {r.part: (bytes(r.packages), r.declared) for r in stored.collect()}
    change = manifest(spark, 6_000, 100_000).where("repo_id % 64 IN (3, 5, 7)")
    sketches.write_sketches(change, path, only=[3, 5])
    after = {r.part: (r.packages and bytes(r.packages), r.declared)
             for r in sketches.read_sketches(spark, path).collect()}
    assert {p for p in before if before[p] != after[p]} == {3, 5}
    assert after[3][1] == change.where("repo_id % 64 = 3").count()
    sketches.write_sketches(change.limit(0), path, only=[5])
    some = sketches.read_sketches(spark, path).where("part IN (3, 5)")
    assert sketches.estimates(some, "part").where("part = 5").first().packages == 0
    assert sketches.estimates(some).first().declared == after[3][1]


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, "a"), (1, "a"), (-1, "a")],
                               "repo_id bigint, package string")
    row = sketches.estimates(sketches.sketched(df)).first()
    assert (row.packages, row.uses, row.declared) == (1, 2, 3)
    none = sketches.estimates(sketches.sketched(df.limit(0))).first()
    assert (none.packages, none.uses, none.declared) == (0, 0, 0)
