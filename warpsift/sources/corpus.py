"""Tables of files, dependencies and changes derived from the given parquet tables.

Everything is a projection of the source table, so the derived tables grow with it. The raw
rows of texts are dealt out over all tasks by a hash first: the given files may hold all rows
in one row group, which one task would scan alone. Tables of files that are kept as such need
no shuffle: see `sources.files.write_table` for their layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..rules.catalog import FRAMEWORKS, UNMAINTAINED
from .slots import (COMMENT, ENV_LINES, ENV_SLOT, JSON, NO_ENV_PATH, SAMPLE_PATH, SAMPLE_SLOT,
                    SLOTS)

N_SLOTS = len(SLOTS)
AS_OF = "2024-01-31 00:00:00"
PAGES_REPO, TALK_REPO = 1, 2
PHRASES = ["Build the following.", *SLOTS[16][1].split("\n")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a hash of their key, the same way at every size."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key)


def _path(k, repo):
    return F.when((k == SAMPLE_SLOT) & (repo % 5 == 0), SAMPLE_PATH) \
        .when((k == ENV_SLOT) & (repo % 4 == 0), NO_ENV_PATH) \
        .otherwise(_pick([s[0] for s in SLOTS], k))


def _with_text(form, base, text, repo):
    """A file's telling or clean part, followed by the document's text in the file's form."""
    lines = F.concat(F.lit("\n# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))
    entry = F.concat(F.lit("\nKEY_"), (repo % 97).cast("string"), F.lit("="),
                     F.col("doc_id").cast("string"))
    own = F.concat(F.lit('"dependencies":{"lib-'), (repo % 997).cast("string"), F.lit('":"'),
                   (1 + F.col("doc_id") % 5).cast("string"), F.lit("."),
                   (F.col("doc_id") % 10).cast("string"), F.lit('.0",'))
    declared = F.replace(base, F.lit('"dependencies":{'), own)
    about = F.concat(F.lit(',"about":"'),
                     F.regexp_replace(text, r'["\\\x00-\x1f]', " "), F.lit('"}'))
    return F.when(form == COMMENT, F.concat(base, lines)) \
        .when(form == ENV_LINES, F.concat(base, entry, lines)) \
        .when(form == JSON, F.concat(F.expr("left(_declared, length(_declared) - 1)"), about)) \
        .otherwise(F.concat(base, F.lit("\n"), text)), declared


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents become the files of repositories of 24 files each."""
    k, repo = F.col("doc_id") % N_SLOTS, F.floor(F.col("doc_id") / N_SLOTS)
    path = _path(k, repo)
    base = F.when(repo % 3 != 0, _pick([s[1] for s in SLOTS], k)) \
        .otherwise(_pick([s[2] for s in SLOTS], k))
    content, declared = _with_text(_pick([s[3] for s in SLOTS], k), base,
                                   F.coalesce("text", F.lit("")), repo)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs.withColumn("_declared", declared).select(
        "doc_id", repo.alias("repo_id"), path.alias("path"),
        F.concat(F.lit("/corpus/r"), repo.cast("string"), F.lit("/"), path).alias("abs_path"),
        content.alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as source files: their address, then their markup."""
    path = F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".js"))
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        F.lit(PAGES_REPO).cast("bigint").alias("repo_id"), path.alias("path"),
        F.concat(F.lit("/corpus/pages/"), path).alias("abs_path"),
        F.concat_ws("\n", "url", "html").alias("content"))


def talk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as prompt files, each under one phrase of the prompt slot."""
    path = F.concat(F.lit("prompts/c"), F.col("conv_id").cast("string"), F.lit("/t"),
                    F.col("turn").cast("string"), F.lit(".md"))
    return spread(table(spark, sf_dir, "conversations"), "conv_id").select(
        F.lit(TALK_REPO).cast("bigint").alias("repo_id"), path.alias("path"),
        F.concat(F.lit("/corpus/talk/"), path).alias("abs_path"),
        F.concat(_pick(PHRASES, F.col("conv_id") % len(PHRASES)), F.lit("\n"), "text")
        .alias("content"))


NAMED = [u[0] for u in UNMAINTAINED] + [f[0] for f in FRAMEWORKS]


def _package(key):
    names = F.array(*[F.lit(n) for n in NAMED])
    return F.when(key.between(1, len(NAMED)),
                  F.get(names, (key - 1).cast("int"))) \
        .otherwise(F.concat(F.lit("pkg-"), key.cast("string")))


def raw_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as declared dependencies; a pair may be declared more than once."""
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"),
                          (F.col("l_quantity").cast("int") % 10).cast("string"),
                          (F.col("l_suppkey") % 5).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("repo_id"),
        _package(F.col("l_partkey")).alias("package"),
        version.alias("version"))


#: What a manifest can declare, from a version's numbers (a, b, c).
RANGE_FORMS = ("{a}.{b}.{c}", "^{a}.{b}.{c}", "~{a}.{b}.{c}", "{a}.x", "{a}.{b}",
               ">={a}.{b}.{c} <{a1}.5.0", "{a}.{b}.{c} - {a1}.2", "^{a}.{b}.{c} || {a2}.{b}.{c}",
               "{a}.{b}.{c}-beta.{c}", "latest")


def range_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as declared dependencies, most of them as ranges."""
    a = F.col("l_linenumber").cast("bigint")
    numbers = {"a": a, "a1": a + 1, "a2": a + 2, "b": F.col("l_quantity").cast("int") % 10,
               "c": F.col("l_suppkey") % 5}
    form = (F.col("l_partkey") + F.col("l_linenumber")) % len(RANGE_FORMS)
    text = _pick(RANGE_FORMS, form)
    for name, number in numbers.items():
        text = F.replace(text, F.lit("{" + name + "}"), number.cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("repo_id"), _package(F.col("l_partkey")).alias("package"),
        text.alias("version"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages that require others: halves, some far ones, some neighbours."""
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    most = parts.agg(F.max("p_partkey")).first()[0] or 1
    needs = F.array_compact(F.array(
        F.when(key > 1, F.floor(key / 2)), F.when(key % 10 == 0, (3 * key + 1) % most + 1),
        F.when((key % 11 == 0) & (key < most), key + 1)))
    version = F.concat_ws(".", (1 + key % 5).cast("string"), (key % 10).cast("string"), F.lit("0"))
    return parts.select(key, F.explode(needs).alias("need"), version.alias("version")).select(
        _package(key).alias("package"), _package(F.col("need")).alias("requires"), "version")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    created = F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp"))
                                  - (key % 400) * 86400 - 3600)
    return table(spark, sf_dir, "part").where(key % 10 != 0).select(
        _package(key).alias("package"), created.alias("created"))


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    level = F.get(F.array(*[F.lit(s) for s in ("critical", "high", "moderate", "low", "info")]),
                  (size % 5).cast("int"))
    return table(spark, sf_dir, "part").where(F.col("p_partkey") % 7 == 3).select(
        _package(F.col("p_partkey")).alias("package"), level.alias("severity"),
        F.concat((1 + size % 3).cast("string"), F.lit(".0.0")).alias("introduced"),
        F.concat((2 + size % 3).cast("string"), F.lit(".5.0")).alias("fixed"),
        F.when(size % 2 == 0, F.concat(F.lit("CVE-2024-"), (10_000 + F.col("p_partkey")).cast(
            "string"))).alias("cve"),
        F.when(size % 3 > 0, F.concat(F.lit("advisory "), F.col("p_partkey").cast("string")))
        .alias("advisory"))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _package(F.col("p_partkey")).alias("package"),
        F.concat((3 + F.col("p_size") % 6).cast("string"), F.lit(".0.0")).alias("latest"))


# What an event says about a file.
OPS = {"view": "add", "click": "change", "purchase": "change", "signup": "unlink",
       "error": "unlink"}


def changes_of(events: DataFrame, documents: int) -> DataFrame:
    """Events as changes of the files of that many documents (batch or stream)."""
    doc = F.col("user_id") % max(documents, 1)
    k, repo = doc % N_SLOTS, F.floor(doc / N_SLOTS)
    path = _path(k, repo)
    op = F.coalesce(*[F.when(F.col("event_type") == e, o) for e, o in OPS.items()])
    return events.select(F.col("ts").cast("timestamp").alias("ts"), repo.alias("repo_id"),
                         path.alias("path"), op.alias("op"))


def documents(spark: SparkSession, sf_dir: str) -> int:
    """How many documents events can speak of: a count, answered by the file footers."""
    return table(spark, sf_dir, "documents").count()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(table(spark, sf_dir, "events"), documents(spark, sf_dir))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a version-control status letter."""
    status = F.get(F.array(*[F.lit(s) for s in "ACMDR"]), (F.col("doc_id") % 5).cast("int"))
    return files(spark, sf_dir).select("repo_id", "path", status.alias("status"))
