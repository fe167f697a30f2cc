"""Watching with state: a file is scanned once per tick, in whatever batches its changes come.

State is keyed by repository and path and holds the ticks that the file was already scanned in.
A change whose tick is there is dropped; else the tick is noted and the file is due. Changes are
combined per file and tick before they are shuffled to the state. Each noted tick expires by
itself some time after it was noted, so a file costs state only while its ticks are fresh; a
change that comes later than that would be scanned again. Nothing is dropped for being late.

The state lives in the stream's checkpoint (RocksDB, so it may exceed memory). A batch that is
repeated after a failure starts from the state before it, finds the same files due, and replaces
what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scan import explode_hits
from ..schema import HIT
from .watch import PACKS, scan_ticks, watch_ignore

DUE = "tick timestamp, repo_id bigint, path string"
SCANNED = f"{DUE}, hits array<{HIT}>"
#: Changes that a task holds to combine them.
HELD_ROWS = 1 << 19
#: Ticks of a file in a batch that are looked up one by one.
FEW = 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OncePerTick(StatefulProcessor):
    """Passes a (file, tick) on when it first comes."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "tick bigint", "n int", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values
                        ) -> Iterator[pd.DataFrame]:
        ticks = list(dict.fromkeys(
            tick for batch in rows for tick in batch["tick_us"].drop_duplicates().tolist()))
        # Every call of the state is a round trip: several ticks are compared with all noted ones.
        if len(ticks) > FEW:
            noted = {tick for tick, in self.seen.keys()}
        else:
            noted = {tick for tick in ticks if self.seen.containsKey((tick,))}
        new = [tick for tick in ticks if tick not in noted]
        for tick in new:
            self.seen.updateValue((tick,), (1,))
        if new:
            yield pd.DataFrame({"repo_id": key[0], "path": key[1], "tick_us": new}).astype(
                {"repo_id": "int64", "tick_us": "int64"})

    def close(self) -> None:
        pass


def combined(batches: Iterator[pa.RecordBatch], held_rows: int = HELD_ROWS
             ) -> Iterator[pa.RecordBatch]:
    """Each row of a task once, as far as that many rows reach."""
    held, rows = [], 0

    def once_each():
        table = pa.Table.from_batches(held)
        return table.group_by(table.column_names).aggregate([]).to_batches()

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= held_rows:
            held = once_each()
            rows = sum(b.num_rows for b in held)
            if 2 * rows > held_rows:
                yield from held
                held, rows = [], 0
    if held:
        yield from once_each()


def due_once(changes: DataFrame, interval: str, keep: str = "1 day") -> DataFrame:
    """The files to scan and their ticks, from a stream of changes; each comes out once.

    `keep` is how long a tick is remembered after it was noted (processing time).
    """
    spark = changes.sparkSession
    keep_ms = spark.sql(f"SELECT CAST(INTERVAL '{keep.split()[0]}' {keep.split()[1]} AS "
                        "INTERVAL DAY TO SECOND) AS i").first()["i"].total_seconds() * 1000
    wanted = watch_ignore(changes.where(F.col("op").isin("add", "change"))).where(
        "repo_id IS NOT NULL AND path IS NOT NULL AND ts IS NOT NULL")
    ticked = wanted.select("repo_id", "path", F.unix_micros(
        F.window("ts", interval).getField("start")).alias("tick_us"))
    ticked = ticked.mapInArrow(combined, ticked.schema)
    due = ticked.groupBy("repo_id", "path").transformWithStateInPandas(
        OncePerTick(int(keep_ms)), "repo_id bigint, path string, tick_us bigint", "Append",
        "ProcessingTime")
    return due.select(F.timestamp_micros("tick_us").alias("tick"), "repo_id", "path")


def watch_once(changes: DataFrame, files: DataFrame, out: str, checkpoint: str,
               interval="5 seconds", keep="1 day", trigger=None):
    """Start watching; the files of each tick are scanned once and appended to a table at `out`."""
    spark = changes.sparkSession
    spark.conf.set(_PROVIDER, _ROCKSDB)
    # Noted ticks expire when they are met or cleaned up; no batch is needed for that alone.
    spark.conf.set(_IDLE, "false")
    spark.createDataFrame([], SCANNED).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int):
        due = batch.persist()
        scan_ticks(due, files).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        due.unpersist()

    return due_once(changes, interval, keep).writeStream.outputMode("append") \
        .foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(**(trigger or {"processingTime": interval})).start()


def scanned_once(spark: SparkSession, out: str) -> DataFrame:
    """All scanned ticks so far, one row per tick and file."""
    return spark.read.schema(f"{SCANNED}, batch bigint").parquet(out).drop("batch")


def scans_per_tick(scanned: DataFrame) -> DataFrame:
    """How often each file was scanned in each tick (always once), and what was found."""
    return scanned.groupBy("tick", "repo_id", "path").agg(
        F.count("*").cast("bigint").alias("scans"),
        F.sum(F.size("hits")).cast("bigint").alias("issues"))


def once_findings(scanned: DataFrame) -> DataFrame:
    return explode_hits(scanned, PACKS, keep=("tick",))
