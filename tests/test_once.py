"""The watch with state: one scan per file and tick, across batches, restarts and orders."""

import os
import shutil

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from warpsift.sources import corpus
from warpsift.streaming import once, watch

SF = "/root/testdata/sf0.01"
CHANGES = "ts timestamp, repo_id bigint, path string, op string"


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def run(spark, folder, files, schema, tick="1 day", **options):
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{folder}/in")
    query = once.watch_once(arriving, files, f"{folder}/out", f"{folder}/cp", tick,
                            trigger={"availableNow": True}, **options)
    query.awaitTermination()
    return query


@pytest.fixture(scope="module")
def batch(spark):
    return watch.scan_ticks(watch.ticks(corpus.changes(spark, SF), "1 day"),
                            corpus.files(spark, SF))


def test_shuffled_batches_equal_one_batch(spark, tmp_path, batch):
    changes, files = corpus.changes(spark, SF), corpus.files(spark, SF)
    # Every file's changes lie in all input files, in no order of time.
    changes.repartition(3, F.rand(5)).write.parquet(f"{tmp_path}/in")
    query = run(spark, str(tmp_path), files, changes.schema)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = once.scanned_once(spark, f"{tmp_path}/out")
    per = once.scans_per_tick(got)
    assert per.where("scans != 1").count() == 0 and per.count() == got.count() == batch.count()
    assert rows(once.once_findings(got)) == rows(watch.watch_findings(batch))


def test_restart_from_the_checkpoint(spark, tmp_path, batch):
    """Half the files, a stop, the rest and a repetition of the first half: nothing twice."""
    changes, files = corpus.changes(spark, SF), corpus.files(spark, SF)
    changes.repartition(2, F.rand(9)).write.parquet(f"{tmp_path}/all")
    parts = sorted(f for f in os.listdir(f"{tmp_path}/all") if f.endswith(".parquet"))
    os.makedirs(f"{tmp_path}/in")
    for i, name in enumerate((parts[0], parts[1], parts[0])):
        shutil.copy(f"{tmp_path}/all/{name}", f"{tmp_path}/in/{i}.parquet")
        run(spark, str(tmp_path), files, changes.schema)
    got = once.scanned_once(spark, f"{tmp_path}/out")
    assert rows(once.scans_per_tick(got).select("tick", "repo_id", "path")) == rows(
        batch.select("tick", "repo_id", "path"))
    assert once.scans_per_tick(got).where("scans != 1").count() == 0


def test_odd_changes_and_expiry(spark, tmp_path, files_of):
    files = files_of({"a.js": "x", "dist/b.js": "x", "c.js": "x"})
    stamp = "2024-01-01 00:00:0"
    first = [(stamp + "1", 1, "a.js", "add"), (stamp + "2", 1, "a.js", "change"),
             (stamp + "7", 1, "a.js", "change"), (stamp + "1", 1, "dist/b.js", "add"),
             (stamp + "1", 1, "c.js", "unlink"), (None, 1, "c.js", "add"),
             (stamp + "1", None, "c.js", "add"), (stamp + "1", 1, None, "add"),
             (stamp + "1", 1, "c.js", None), (stamp + "1", 2, "gone.js", "add")]
    os.makedirs(f"{tmp_path}/in")

    def arrive(n, some):
        spark.createDataFrame(some, "ts string, repo_id bigint, path string, op string").withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/{n}")
        (name,) = [f for f in os.listdir(f"{tmp_path}/{n}") if f.endswith(".parquet")]
        shutil.copy(f"{tmp_path}/{n}/{name}", f"{tmp_path}/in/{n}.parquet")

    def seen():
        return sorted((r.tick.second, r.repo_id, r.path, r.scans) for r in once.scans_per_tick(
            once.scanned_once(spark, f"{tmp_path}/out")).collect())

    arrive(0, first)
    run(spark, str(tmp_path), files, CHANGES, "5 seconds", keep="1 second")
    assert seen() == [(0, 1, "a.js", 1), (5, 1, "a.js", 1)]
    # By now the noted ticks have expired, so the same change counts anew.
    arrive(1, first[:1])
    run(spark, str(tmp_path), files, CHANGES, "5 seconds", keep="1 second")
    assert seen() == [(0, 1, "a.js", 2), (5, 1, "a.js", 1)]


class Noted:
    """State of one file that counts its round trips."""

    def __init__(self, ticks=()):
        self.ticks, self.calls = set(ticks), 0

    def keys(self):
        self.calls += 1
        return iter([(t,) for t in self.ticks])

    def containsKey(self, key):
        self.calls += 1
        return key[0] in self.ticks

    def updateValue(self, key, value):
        self.calls += 1
        self.ticks.add(key[0])


@pytest.mark.parametrize("n", [1, 50])
def test_noted_ticks_are_read_in_one_call(n):
    file = once.OncePerTick(1000)
    file.seen = Noted(range(n))
    rows = pd.DataFrame({"tick_us": [*range(n), *range(n)]})
    assert not list(file.handleInputRows((1, "a.js"), iter([rows, rows]), None))
    assert file.seen.calls == 1
    rows = pd.DataFrame({"tick_us": range(n + 1)})
    (out,) = file.handleInputRows((1, "a.js"), iter([rows]), None)
    assert out["tick_us"].tolist() == [n] and out["path"].tolist() == ["a.js"]


@pytest.mark.parametrize("held", [1, 4, 1000])
def test_changes_are_combined_before_the_state(held):
    rows = [(r, p, t) for r in (1, 2) for p in "ab" for t in (0, 5)] * 9
    batches = [pa.RecordBatch.from_pylist([dict(zip(("repo_id", "path", "tick_us"), row))])
               for row in rows]
    out = [tuple(row.values()) for b in once.combined(iter(batches), held) for row in b.to_pylist()]
    assert set(out) == set(rows)
    assert held < 1000 or len(out) == 8
    assert not list(once.combined(iter([])))
