"""Watching file changes: each tick scans the files that were added or changed.

A tick is an event-time window. Within a tick a file counts once, however often it
changes; removals and ignored paths do not count. Changes are combined per file before
the shuffle, so one very busy file is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scan import explode_hits, scan_files
from ..schema import HIT
from ..sources.files import only_files

# Paths the watcher does not follow.
IGNORED = r"node_modules|\.git|dist|build|\.(log|png|jpg|jpeg|gif|ico|pdf|zip)$"
PACKS = ("secrets",)
_TICK = ("tick", "repo_id", "path")
WATCHED = f"tick timestamp, repo_id bigint, path string, hits array<{HIT}>"


def watch_ignore(changes: DataFrame) -> DataFrame:
    return changes.where(~F.col("path").rlike(IGNORED))


def ticks(changes: DataFrame, interval: str) -> DataFrame:
    """Files to scan per tick; works on batch and streaming changes alike."""
    wanted = watch_ignore(changes.where(F.col("op").isin("add", "change")))
    return wanted.groupBy(F.window("ts", interval).alias("w"), "repo_id", "path") \
        .agg(F.count("*").cast("bigint").alias("changes")) \
        .select(F.col("w.start").alias("tick"), "repo_id", "path", "changes")


def scan_ticks(due: DataFrame, files: DataFrame) -> DataFrame:
    """One row per tick and file with its hits; each changed file is scanned once."""
    due = due.select(*_TICK).distinct()
    touched = due.select("repo_id", "path").distinct()
    # Semi join from the side of the files: few files change, so texts need not move.
    seen = scan_files(only_files(files, touched), PACKS, select=False)
    # A file has at most one row per tick, so no key is hot here.
    return due.join(seen.select("repo_id", "path", "hits"), ["repo_id", "path"])


def watch_findings(scanned: DataFrame) -> DataFrame:
    return explode_hits(scanned, PACKS, keep=("tick",))


def watch_batch_summary(scanned: DataFrame) -> DataFrame:
    """Files and issues per tick; every secret rule is critical, so quiet mode shows all."""
    return scanned.groupBy("tick").agg(
        F.count("*").cast("bigint").alias("files_scanned"),
        F.sum(F.size("hits")).cast("bigint").alias("issues"))


def watch_stream(changes: DataFrame, files: DataFrame, out: str, checkpoint: str,
                 interval="5 seconds", trigger=None):
    """Start watching a stream of changes; scanned ticks are appended to a table at `out`.

    Each micro-batch is cut into ticks and scanned by itself, so nothing is kept between
    batches and no change is too late. It writes its own folder, so a repeated batch after
    a failure replaces what it wrote before.
    """
    spark = changes.sparkSession
    spark.createDataFrame([], WATCHED).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int):
        due = ticks(batch, interval).persist()
        scan_ticks(due, files).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        due.unpersist()

    return changes.writeStream.outputMode("append").foreachBatch(write) \
        .option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": interval})).start()


def watched(spark: SparkSession, out: str) -> DataFrame:
    """All scanned ticks so far. A file that changed again in a later batch of the same tick
    was scanned again; the newest scan of a tick and file counts."""
    rows = spark.read.schema(f"{WATCHED}, batch bigint").parquet(out)
    newest = F.max_by("hits", "batch").alias("hits")
    return rows.groupBy(*_TICK).agg(newest)
