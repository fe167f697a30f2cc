"""Joins of a large fact table with a lookup table of unknown size.

A lookup table is broadcast only after its size has been measured. Beyond the bound the
join shuffles, and keys that hold a large share of the fact rows are spread over several
tasks: each fact row of a hot key gets a salt, each lookup row of that key is repeated
once per salt. No row is dropped or capped, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
_SALT = "_salt"


def fits_broadcast(table: DataFrame, max_rows=BROADCAST_ROWS, max_bytes=BROADCAST_BYTES) -> bool:
    """Measure a table, reading at most max_rows + 1 rows of it."""
    def bytes_of(f):
        if f.dataType.typeName() == "array":  # of hits and the like: a guess for each element
            return 16 + 64 * F.coalesce(F.size(F.col(f.name)), F.lit(0))
        if f.dataType.simpleString() == "string":
            return F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        return F.lit(16)

    width = sum(bytes_of(f) for f in table.schema.fields)
    rows, size = table.limit(max_rows + 1).agg(F.count("*"), F.sum(width)).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def hot_keys(facts: DataFrame, on: list[str], tasks: int | None = None) -> DataFrame:
    """Keys with more than a task's fair share of rows, and how many tasks each needs.

    Counts are combined before the shuffle and stored, so the facts are worked out for them
    once. At most `tasks` keys can qualify, so the result is small by construction.
    """
    spark = facts.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts, path = facts.where(F.col(on[0]).isNotNull()).groupBy(*on).count(), shared_dir(
        spark, "counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = max(total / tasks, 1)
    return counts.where(F.col("count") > share).select(
        *on, F.ceil(F.col("count") / share).cast("int").alias("_salts"))


def salted_join(facts: DataFrame, lookup: DataFrame, on: list[str], how="inner",
                tasks: int | None = None) -> DataFrame:
    hot = F.broadcast(hot_keys(facts, on, tasks))
    # Equal rows go to different tasks too; rows without a key match nothing and go anywhere.
    turn = F.xxhash64(*facts.columns, F.monotonically_increasing_id())
    anywhere = tasks or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col(on[0]).isNull(), F.pmod(turn, F.lit(anywhere))).when(
        F.col("_salts").isNull(), 0).otherwise(F.pmod(turn, F.col("_salts")))
    left = facts.join(hot, on, "left").withColumn(_SALT, spread.cast("int")).drop("_salts")
    right = lookup.join(hot, on, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], how="inner",
                max_rows=BROADCAST_ROWS) -> DataFrame:
    """Inner, left, left_semi or left_anti join of facts with a lookup table."""
    if fits_broadcast(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on, how)
    return salted_join(facts, lookup, on, how)
