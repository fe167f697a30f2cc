"""Proportional stratified interleaving: shards that each match the mixture of sources.

Rows of a source are shuffled by a seeded hash and ranked; the rank over the source's size
is a fraction between 0 and 1. Sorted by that fraction, every stretch of rows holds each
source in its share of the whole, so equal cuts of the sorted rows give equal shards with
equal mixtures.

Rows: a null source is a source of its own. A null id or text is an ordinary value. Equal
rows are all kept, their places among each other being interchangeable. An empty table gives
an empty result. Columns of the input keep their names; the new ones must not clash
(`shard`, `slot`: rename yours first, else ValueError).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import column, running, seeded, text_or_empty

SEED = 20240131
SHARDS = 40


def interleave(df: DataFrame, source: str = "source", order: list[str] = ("doc_id",),
               shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard).

    Shards differ by one row at most. `order` names the columns that identify a row; the
    seeded shuffle is a hash of them. Select only the columns you need before the call:
    what `df` holds is shuffled twice.
    """
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    # Internal names throughout, so that no column of the caller can clash.
    names = [f"c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    src = names[df.columns.index(source)]
    ids = [names[df.columns.index(c)] for c in order]
    shuffled = inner.withColumn("_h", seeded(seed, *[column(c) for c in ids])) \
        .withColumn("_one", F.lit(1).cast("long"))
    ranked = running(shuffled, [src], ["_h", *ids], {"_rank": "_one"}, "shard-rank")
    placed = ranked.withColumn(
        "_frac", (2 * F.col("_rank") - 1).cast("double") / (2 * F.col("_rank_all")).cast("double")
    ).drop("_rank", "_rank_all")
    ordered = running(placed, [], ["_frac", src, "_h", *ids], {"_pos": "_one"}, "shard-order")
    shard = F.expr(f"((_pos - 1) * {shards}) div _pos_all")
    return ordered.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.expr(f"_pos - 1 - ((cast(shard as bigint) * _pos_all + {shards - 1})"
                       f" div {shards})")).select(
        *[F.col(n).alias(c) for n, c in zip(names, df.columns)], "shard", "slot")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Interleave whole rows and write one folder per shard, in slot order."""
    out = interleave(df, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)


def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(text_or_empty(), "utf-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"))
    return interleave(docs, order=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The same rows from DuckDB. Its CRC-32 is worked out byte by byte, for lack of a function.
OP1_SQL = f"""
WITH polynomial AS (
  SELECT list(v ORDER BY n) AS tab FROM (
    SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(n))),
docs AS (
  SELECT doc_id::BIGINT AS doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 16
      AS size, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
summed AS (
  SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(size - 16), lambda i:
        ('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM docs, polynomial),
hashed AS (
  SELECT *, md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), text_crc32::VARCHAR,
    size::VARCHAR)) AS h FROM summed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r,
    count(*) OVER (PARTITION BY source) AS n FROM hashed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE,
    source NULLS FIRST, h, doc_id) AS pos, count(*) OVER () AS rows FROM ranked)
SELECT doc_id, source, size, text_crc32, 'rows' AS law,
  (((pos - 1) * {SHARDS}) // rows)::INTEGER AS shard,
  (pos - 1 - (((((pos - 1) * {SHARDS}) // rows) * rows + {SHARDS - 1}) // {SHARDS}))::BIGINT
    AS slot,
  NULL::INTEGER AS grown_shard
FROM placed
"""
