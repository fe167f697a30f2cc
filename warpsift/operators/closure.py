"""What dependencies bring along: advisories reached through other packages.

The closure is worked out once for all packages, backwards from the requirements that an advisory
affects, and only then joined with the manifests: packages are few where repositories are many.
Each round extends the pairs (package, affected package) that the round before has found by one
requirement and keeps those that are new, so a pair is extended once, cycles end by themselves,
and the first path found is a shortest one. Rounds are stored; there are as many as the longest
shortest path has steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from .joins import lookup_join

_STEP = " > "
_PAIR = ["package", "target", "version"]


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shortest(paths: DataFrame) -> DataFrame:
    """One path per pair; of several, the least text."""
    return paths.groupBy(*_PAIR).agg(F.min("path").alias("path"))


def reached(requirements: DataFrame, affected: DataFrame) -> DataFrame:
    """Affected requirements that each package reaches: `package, target, version, hops, path`.

    `requirements` has `package`, `requires` and `version`; `affected` the requirements (`requires`,
    `version`) that an advisory is about. A package that requires an affected one is one hop away.
    Of the shortest paths the least text is kept.
    """
    root = shared_dir(requirements.sparkSession, "closure")
    edges = written(requirements.select("package", "requires", "version").where(
        "package IS NOT NULL AND requires IS NOT NULL").distinct(), f"{root}/edges")
    steps = edges.select("package", "requires").distinct()
    first = lookup_join(edges, affected.select("requires", "version").distinct(),
                        ["requires", "version"], "left_semi")
    front = written(_shortest(first.select(
        "package", F.col("requires").alias("target"), "version", F.concat(
            "package", F.lit(_STEP), "requires", F.lit("@"), "version").alias("path"))),
        f"{root}/hops=1")
    rounds = [front.withColumn("hops", F.lit(1))]
    while not front.isEmpty():
        known = reduce(DataFrame.unionByName, rounds).select(*_PAIR)
        longer = steps.join(front.withColumnRenamed("package", "requires"), "requires").select(
            "package", "target", "version", F.concat("package", F.lit(_STEP), "path").alias("path"))
        front = written(_shortest(longer.join(known, _PAIR, "left_anti")),
                        f"{root}/hops={len(rounds) + 1}")
        rounds.append(front.withColumn("hops", F.lit(len(rounds) + 1)))
    return reduce(DataFrame.unionByName, rounds)
