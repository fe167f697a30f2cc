"""Session settings, shared folder and small constant tables."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Sensible for a large cluster; anything the caller sets wins.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods above this size are not compiled by the JVM, so do not fuse beyond it.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName("warpsift")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that all executors share.

    `spark.checkpoint.dir` names that folder. Where it is unset, one machine (a master of
    `local`) uses a temporary folder of its own, as in tests; a cluster is refused, since
    its executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="warpsift-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def constant_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A DataFrame over fixed rows held in code (never over data)."""
    fields = [f.split() for f in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(),
             "boolean": pa.bool_()}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table({
        name: pa.array(list(values), kinds[kind])
        for (name, kind), values in zip(fields, columns)}))
