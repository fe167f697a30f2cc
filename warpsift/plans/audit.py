"""One call from tables of files and dependencies to findings."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import deps, env
from ..operators.candidates import candidates
from ..operators.joins import lookup_join
from ..operators.scan import explode_hits, scan_files
from ..operators.select import ignore_paths
from ..rules.catalog import PACK_ORDER, SCANS, rules_of
from ..session import shared_dir
from ..sources.files import in_folders, only_files, read_stored
from ..sources.trigrams import read_index


@dataclass
class Dependencies:
    """Inputs of the dependency scan; `manifest` has one row per repository and package."""

    manifest: DataFrame
    advisories: DataFrame
    latest_versions: DataFrame
    registry: DataFrame
    as_of: str
    facts: DataFrame | None = None

    def findings(self) -> DataFrame:
        return deps.dependency_findings(self.manifest, self.advisories, self.latest_versions,
                                        self.registry, self.as_of, self.facts)

    def stored(self) -> Dependencies:
        """The same with the manifest and the facts about packages written to the shared folder:
        both are read several times."""
        spark = self.manifest.sparkSession

        def kept(df, name):
            path = shared_dir(spark, name)
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        facts = deps.package_facts(self.latest_versions, self.registry)
        return replace(self, manifest=kept(self.manifest, "manifest"), facts=kept(facts, "facts"))


def _passed(scanned: DataFrame, packs, extra_rules) -> DataFrame:
    """The hits of every file and what repository rules need, stored: the texts' one pass."""
    rules = rules_of([p for p in PACK_ORDER if p in set(packs)], extra_rules)
    numbers = [i for i, r in enumerate(rules) if r.pack == "env"]
    table = scanned.select("repo_id", "path", "hits", *env.file_facts(numbers))
    path = shared_dir(scanned.sparkSession, "pass")
    table.write.parquet(path)
    return scanned.sparkSession.read.schema(table.schema).parquet(path)


def audit(files: DataFrame, packs=SCANS, dependencies: Dependencies | None = None,
          extra_rules=(), ignore=()) -> DataFrame:
    """Findings of the requested packs.

    All file packs share one pass over the texts. With the `env` pack its hits (keys and
    matches, no texts) are stored in the shared folder when this is called, since findings
    of files and of repositories are both drawn from them. Ignore globs reach the secret
    scan only, as in the command the option belongs to. Write the result to a table before
    drawing several reports from it.
    """
    packs = list(packs)
    parts = []
    together = [p for p in packs if p != "deps" and not (ignore and p == "secrets")]
    if together:
        scanned = scan_files(files, together, extra_rules)
        if "env" in together:
            scanned = _passed(scanned, together, extra_rules)
            parts.append(env.env_repo_findings(scanned))
        parts.append(explode_hits(scanned, together, extra_rules))
    if ignore and "secrets" in packs:
        kept = ignore_paths(files, ignore)
        parts.append(explode_hits(scan_files(kept, ["secrets"], extra_rules), ["secrets"],
                                  extra_rules))
    if "deps" in packs and dependencies is not None:
        parts.append(dependencies.findings())
    return reduce(DataFrame.unionByName, parts)


def quick(files: DataFrame) -> DataFrame:
    """Secrets only."""
    return audit(files, ["secrets"])


def indexed_scan(spark: SparkSession, stored: str, packs=(), rules=()) -> DataFrame:
    """Findings of packs, or of some rules alone, over files kept by `write_table`.

    Candidates come from the trigram index; only the folders that hold some are opened, and only
    the candidates' texts are tested. The `env` pack judges whole repositories and is refused.
    """
    only = list(rules) or None
    asked = only or rules_of([p for p in packs if p != "deps"])
    if any(r.pack == "env" for r in asked):
        raise ValueError("the env pack needs every file of a repository")
    path = shared_dir(spark, "candidates")
    candidates(read_index(spark, stored), asked).write.parquet(path)
    chosen = spark.read.schema("repo_part int, repo_id bigint, path string").parquet(path)
    files = in_folders(read_stored(spark, stored), chosen, "repo_part")
    texts = lookup_join(files, chosen, ["repo_part", "repo_id", "path"], "left_semi")
    return explode_hits(scan_files(texts, packs, only=only), packs, only=only)


def changed_files_scan(files: DataFrame, changed: DataFrame, packs=("secrets",)) -> DataFrame:
    """Scan only files that were added, copied or modified, whatever their path.

    Files in the stored layout are read from the folders of the changed repositories only.
    """
    wanted = changed.where("status IN ('A', 'C', 'M')").select("repo_id", "path").distinct()
    touched = only_files(files, wanted)
    return explode_hits(scan_files(touched, packs, select=False), packs)
