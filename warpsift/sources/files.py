"""Reading source trees, manifests and environment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import lookup_join
from ..schema import FILES
from . import trigrams
from .tree import tree

def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """Whole texts below a mounted folder whose direct children are repositories.

    The repository id is a hash of its folder name. Tests of `path` reach the source, which then
    opens only the files that pass; `options` are those of `sources.tree`.
    """
    return tree(spark, root, **options).select(
        F.xxhash64("repo").alias("repo_id"), "path", "abs_path", "content")


#: Folders of the stored layout. A scan of a few repositories opens their folders only.
PARTS = 64
_FILES_PER_PART = 4


def part_of(repo_id="repo_id") -> Column:
    return F.pmod(F.xxhash64(repo_id), F.lit(PARTS)).cast("int")


def write_table(files: DataFrame, path: str, files_per_part: int = _FILES_PER_PART) -> None:
    """Keep files in the layout that scans prune, with a trigram index beside them.

    A folder per hash of the repository, `files_per_part` files in each (about the folder's bytes
    over half a gigabyte on large estates) so that one large repository is no single task, sorted
    by path.
    """
    files.withColumn("repo_part", part_of()).repartition(
        PARTS * files_per_part, "repo_part", F.pmod(F.xxhash64("path"), F.lit(files_per_part))) \
        .sortWithinPartitions("repo_part", "path").write.partitionBy("repo_part").parquet(path)
    trigrams.write_index(read_stored(files.sparkSession, path), path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Files already kept as a parquet table with the columns of `schema.FILES`.

    Of a table in the stored layout `repo_part` comes along, by which joins prune folders.
    """
    table = spark.read.parquet(path)
    return table.select("repo_id", "path", "abs_path", "content",
                        *[c for c in table.columns if c == "repo_part"])


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """Files kept by `write_table`: the layout is known, so no file is opened to plan a read."""
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in FILES)}"
                             ", repo_part int").parquet(path)


def in_folders(table: DataFrame, keys: DataFrame, folder: str) -> DataFrame:
    """The rows of a table partitioned by `folder` that lie in the folders that `keys` names.

    The numbers of the folders, no more than there are folders, come to the driver and become a
    filter on partitions: other folders are not even listed in the read.
    """
    wanted = sorted(r[0] for r in keys.select(folder).distinct().collect() if r[0] is not None)
    return table.where(F.col(folder).isin(wanted))


def only_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of given repositories and paths."""
    on = ["repo_id", "path"]
    if "repo_part" in files.columns:
        wanted, on = wanted.withColumn("repo_part", part_of()), ["repo_part", *on]
    return lookup_join(files, wanted, on, "left_semi")


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per repository and path. Needed only where inputs overlap: it shuffles texts."""
    return files.dropDuplicates(["repo_id", "path"])


def merged_dependencies(files: DataFrame) -> DataFrame:
    """Each root package.json as one map of package to version; development entries win."""
    parsed = F.from_json("content", "dependencies map<string,string>, "
                                    "devDependencies map<string,string>")
    return files.where(F.col("path") == "package.json").select(
        "repo_id", parsed.alias("j")).selectExpr(
        "repo_id", "coalesce(j.dependencies, map()) AS a", "coalesce(j.devDependencies, map()) AS b"
    ).selectExpr(
        "repo_id",
        "map_concat(map_filter(a, (k, v) -> NOT map_contains_key(b, k)), b) AS dependencies")


def manifest_source(files: DataFrame) -> DataFrame:
    """Declared packages, one row each."""
    return merged_dependencies(files).select(
        "repo_id", F.explode("dependencies").alias("package", "version"))
