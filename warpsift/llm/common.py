"""Helpers that several operators share: stored tables, running ranks, whole-word splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import fits_broadcast
from ..session import shared_dir

#: Rows that one task ranks at a time; only the number of tasks grows with the data.
RANGE_ROWS = 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what is stored, and
    values that depend on how rows were dealt out (partition numbers) are fixed.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, lengthened until no column of `df` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(column(name).cast("string"), F.lit(""))


def seeded(seed: int, *columns: Column) -> Column:
    """32 hex digits that order rows at random but alike in every run and engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def running(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, str],
            name: str) -> DataFrame:
    """Add running sums within `groups` in the order `order`, with no group in one task.

    `sums` maps a new column to the long column that it adds up, row by row and inclusive;
    each also gets its whole in `<new>_all`. Rows are cut into ranges of the order, summed
    per range, and each range starts from the total of those before it. Only one row per
    range and group meets in one place. The ranges are stored, so a retried task sees the
    same ones. Rows that tie in `order` get their places in no stated order.
    """
    keys = [*groups, *order]
    # Stored first: counting, finding the ranges and dealing out each read the rows.
    table = stored(df, name)
    n = max(1, -(-table.count() // RANGE_ROWS))
    ranged = stored(table.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()),
                    name)
    inside = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    totals = ranged.groupBy(*groups, "_range").agg(
        *[F.sum(src).alias(f"_t_{new}") for new, src in sums.items()])
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"_g_{g}") for g in groups],
                            F.col("_range").alias("_g_range"), *[
        x for new in sums for x in (
            F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}"),
            F.sum(f"_t_{new}").over(whole).alias(f"{new}_all"))])
    # One row per range and group: at most (ranges + groups) rows, so measured, then sent.
    if fits_broadcast(offsets):
        offsets = F.broadcast(offsets)
    on = F.col("_range") == F.col("_g_range")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = ranged.select("*", *[F.sum(src).over(inside).alias(f"_r_{new}")
                               for new, src in sums.items()])
    out = out.join(offsets, on)
    return out.select(*df.columns, *[
        c for new in sums for c in ((F.col(f"_r_{new}") + F.col(f"_b_{new}")).alias(new),
                                    F.col(f"{new}_all"))])
