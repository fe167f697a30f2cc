"""Dependency checks as joins of a manifest with advisory, version and registry tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import quoted
from ..functions.ranges import intervals
from ..functions.versions import major, version_key
from ..rules.base import SEVERITY_RANK
from ..rules.catalog import (ADVISORY_SEVERITY, FRAMEWORKS, NEW_PACKAGE_DAYS, PACK_ORDER,
                             REGISTRY_SKIP, UNMAINTAINED, deps)
from ..schema import FINDING_COLUMNS
from ..session import constant_table, shared_dir
from .closure import reached, written
from .intervals import overlaps
from .joins import lookup_join

_RULES = {r.rule_id: (i, r) for i, r in enumerate(deps.rules)}


def latest_declared(manifest: DataFrame) -> DataFrame:
    """One row per repository and package: the highest declared version."""
    best = F.max(F.struct(version_key("version").alias("key"), F.col("version")))
    return manifest.groupBy("repo_id", "package").agg(best.alias("_best")) \
        .select("repo_id", "package", "_best.version")


@dataclass(frozen=True)
class _Seed:
    """When a rule finds a row, and what the finding has beyond its rule, as SQL."""

    rule_id: str
    test: str
    detail: str
    severity: str | None = None
    remediation: str | None = None
    key: str = "''"

    @property
    def number(self) -> int:
        return _RULES[self.rule_id][0]


def _by_rule(seeds, field: str) -> str:
    """SQL: that field of the seed whose rule a row is about."""
    cases = "".join(f" WHEN {s.number} THEN {getattr(s, field)}" for s in seeds
                    if getattr(s, field) is not None)
    return f"CASE rule_ord{cases} END" if cases else "CAST(NULL AS STRING)"


def _rule_rows(spark) -> DataFrame:
    """The five rules, to be joined to their seeds (fixed size: the catalog)."""
    return constant_table(spark, [
        (n, r.rule_id, r.type, r.category, r.severity, r.title, r.remediation, r.best_practice,
         r.owasp_ref) for n, r in _RULES.values()],
        "rule_ord int,rule_id string,type string,category string,_severity string,_title string,"
        "_remediation string,best_practice string,owasp string")


def _emit(df: DataFrame, *seeds: _Seed) -> DataFrame:
    """Finding rows of all seeds, in one pass over the rows; the rules' texts come after it.

    Only the tests run for every row: texts are made of findings, and only if they are asked for.
    """
    rows = df.selectExpr("*", *[f"{s.test} AS _test{i}" for i, s in enumerate(seeds)])
    found = rows.selectExpr("*", "posexplode_outer(array("
                            + ", ".join(f"_test{i}" for i in range(len(seeds)))
                            + ")) AS (_seed, _found)").where("_found")
    numbers = ", ".join(str(s.number) for s in seeds)
    found = found.selectExpr("*", f"get(array({numbers}), _seed) AS rule_ord").selectExpr(
        "repo_id", "package", "rule_ord",
        *[f"{_by_rule(seeds, name)} AS {name}" for name in (
            "detail", "severity", "remediation", "key")])
    found = found.join(F.broadcast(_rule_rows(df.sparkSession)), "rule_ord")
    ids = F.concat_ws("|", F.col("repo_id").cast("string"), F.lit("package.json"), "rule_id",
                      "package", F.when(F.col("key") != "", F.col("key")))
    empty = F.lit(None).cast("string")
    return found.withColumns({
        "pack": F.lit("deps"), "finding_id": F.sha2(ids, 256), "path": F.lit("package.json"),
        "severity": F.coalesce("severity", "_severity"), "title": F.concat("_title", "detail"),
        "remediation": F.coalesce("remediation", "_remediation"),
        "line": F.lit(None).cast("bigint"), "match_ord": F.lit(0).cast("bigint"),
        "matched_text": empty, "suggested_env_var": empty,
        "pack_ord": F.lit(PACK_ORDER["deps"])}).select(*FINDING_COLUMNS, "pack_ord", "rule_ord")


_LEVEL = "CASE _level " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in ADVISORY_SEVERITY.items()) + " ELSE 'medium' END"
_FIX = (f"coalesce(concat('Move to version ', fixed, ' or later.'), "
        f"{quoted(_RULES['known_cve'][1].remediation)})")
_ADVICE = "CASE package " + " ".join(
    f"WHEN '{p}' THEN {quoted(advice)}" for p, advice in UNMAINTAINED) + " END"
# Local and repository references are not looked up.
_CHECKABLE = " AND ".join(f"NOT startswith(package, '{p}')" for p in REGISTRY_SKIP)


def severity_rank(severity):
    """0 for the worst."""
    return F.coalesce(*[F.when(severity == s, n) for s, n in SEVERITY_RANK.items()])


def _age(as_of: str) -> str:
    """SQL: fractional days since a package was created."""
    return (f"((unix_micros(CAST('{as_of}' AS TIMESTAMP)) - unix_micros(created))"
            " / 86400000000D)")


def _newest(latest: DataFrame) -> DataFrame:
    """With the major number of the latest version, read once per package."""
    return latest.withColumn("_newest", F.expr(major("latest")))


def _gaps(rows: DataFrame) -> DataFrame:
    """With the number of major versions that a row is behind."""
    return rows.withColumn("_gap", F.expr(f"_newest - {major('version')}"))


def _outdated_seed() -> _Seed:
    """At least one major version behind; more than one is worse."""
    return _Seed("outdated_major", "_gap > 0",
                 "concat(package, ' by ', _gap, ' major version(s)')",
                 severity="CASE WHEN _gap > 1 THEN 'medium' ELSE 'low' END")


def _unmaintained_seed() -> _Seed:
    return _Seed("unmaintained", f"{_ADVICE} IS NOT NULL", "package", remediation=_ADVICE)


def _hallucinated_seed(test: str) -> _Seed:
    return _Seed("hallucinated", test, "package")


def _brand_new_seed(as_of: str) -> _Seed:
    """Created less than seven days before `as_of`."""
    return _Seed("brand_new", f"{_CHECKABLE} AND {_age(as_of)} < {NEW_PACKAGE_DAYS}",
                 f"concat(package, ' (', CAST(round({_age(as_of)}) AS INT), ' days)')")


def known_vulnerabilities(manifest: DataFrame, advisories: DataFrame) -> DataFrame:
    """Declared versions inside an advisory's range: introduced <= version < fixed."""
    ours = manifest.select("repo_id", "package", "version", version_key("version").alias("_v"))
    known = advisories.select("package", F.col("severity").alias("_level"), "introduced", "fixed",
                              version_key("introduced").alias("_from"),
                              version_key("fixed").alias("_to"))
    hit = lookup_join(ours, known, ["package"]).where(
        "_from <= _v AND (_to IS NULL OR _v < _to)")
    return _emit(hit, _Seed("known_cve", "true", "concat(package, '@', version)",
                            severity=_LEVEL, key="concat_ws('-', introduced, fixed)",
                            remediation=_FIX))


def range_vulnerabilities(manifest: DataFrame, advisories: DataFrame) -> DataFrame:
    """Declared ranges that allow versions inside an advisory's range.

    `exposure` is `all` where every allowed version is affected, else `some`. What is declared
    is compared once per package and text, however many repositories declare it; the pairs come
    from an interval join, which stays in proportion to its result for a package with thousands
    of advisories. A plain version allows itself only; tags and addresses match nothing. What no
    advisory is about leaves first.
    """
    root = shared_dir(manifest.sparkSession, "ranges")
    manifest = written(lookup_join(
        manifest.select("repo_id", "package", "version"), advisories.select("package").distinct(),
        ["package"], "left_semi").distinct(), f"{root}/declared")
    declared = manifest.select("package", "version").distinct().selectExpr(
        "package", "version", f"{intervals('version')} AS spans").where("size(spans) > 0")
    ours = written(declared.select("package", "version", F.size("spans").alias("n"), F.explode(
        "spans").alias("i")).select("package", "version", "n", "i.*"), f"{root}/spans")
    bounds = "concat('>=', introduced, coalesce(concat(' <', fixed), ''))"
    known = advisories.selectExpr(
        "package", "severity AS _level", "introduced", "fixed",
        f"explode({intervals(bounds)}) AS i").select(
        "package", "_level", "introduced", "fixed", "i.*")
    inside = "lo >= other_lo AND hi <= other_hi"
    met = overlaps(ours, known, ["package"]).groupBy(
        "package", "version", "n", "_level", "introduced", "fixed").agg(
        F.count_if(F.expr(inside)).alias("within")).select(
        "package", "version", F.expr(_LEVEL).alias("severity"), "introduced", "fixed",
        F.when(F.col("within") == F.col("n"), "all").otherwise("some").alias("exposure"),
        F.expr(_FIX).alias("remediation"))
    return lookup_join(manifest, met, ["package", "version"]).select(
        "repo_id", "package", "version", "severity", "introduced", "fixed", "exposure",
        "remediation")


def indirect_vulnerabilities(manifest: DataFrame, requirements: DataFrame,
                             advisories: DataFrame) -> DataFrame:
    """Affected packages that a repository gets through its direct dependencies.

    One row per repository, affected package and version, with the shortest path that leads
    there (of several the least text) as the reason. Paths are numbered in the order of their
    hops and texts, so that repositories meet numbers and only what is reported gets its text.
    """
    needs = requirements.select("requires", "version").distinct().select(
        "requires", "version", version_key("version").alias("_v"))
    known = advisories.select(F.col("package").alias("requires"), F.col("severity").alias("_level"),
                              version_key("introduced").alias("_from"),
                              version_key("fixed").alias("_to"))
    levels = F.expr(_LEVEL)
    worst = F.min(F.struct(severity_rank(levels).alias("rank"), levels.alias("severity")))
    affected = lookup_join(needs, known, ["requires"]).where(
        "_from <= _v AND (_to IS NULL OR _v < _to)").groupBy("requires", "version").agg(
        worst.getField("severity").alias("severity"))
    root = shared_dir(manifest.sparkSession, "indirect")
    affected = written(affected.withColumn("pair", F.monotonically_increasing_id()),
                       f"{root}/affected")
    paths = lookup_join(reached(requirements, affected).withColumnRenamed("target", "requires"),
                        affected, ["requires", "version"])
    paths = written(paths.orderBy("hops", "path").withColumn(
        "place", F.monotonically_increasing_id()), f"{root}/paths")
    hit = lookup_join(manifest.select("repo_id", "package").distinct(),
                      paths.select("package", "pair", "place"), ["package"])
    found = hit.groupBy("repo_id", "pair").agg(F.min("place").alias("place"))
    told = paths.select("place", F.col("requires").alias("package"), "version", "severity", "hops",
                        F.col("path").alias("reason"))
    return lookup_join(found.select("repo_id", "place"), told, ["place"]).select(
        "repo_id", "package", "version", "severity", "hops", "reason")


def vulnerability_details(manifest: DataFrame, advisories: DataFrame) -> DataFrame:
    """What an advisory says of each declared version in its range; absent facts are N/A."""
    ours = manifest.select("repo_id", "package", "version", version_key("version").alias("_v"))
    known = advisories.select("package", "severity", "introduced", "fixed", "cve", "advisory",
                              version_key("introduced").alias("_from"),
                              version_key("fixed").alias("_to"))
    hit = lookup_join(ours, known, ["package"]).where(
        "_from <= _v AND (_to IS NULL OR _v < _to)")

    def known_or(column):
        return F.coalesce(column, F.lit("N/A"))

    return hit.select(
        "repo_id", "package", "version", F.expr(_LEVEL.replace("_level", "severity")).alias(
            "severity"), known_or(F.col("cve")).alias("cve"),
        known_or(F.col("advisory")).alias("advisory"),
        known_or(F.concat(F.lit(">="), "introduced", F.concat(F.lit(" <"), "fixed"))).alias(
            "vulnerable_range"),
        known_or(F.concat(F.lit(">="), "fixed")).alias("patched_range"),
        F.expr(_FIX).alias("remediation"))


def outdated_major(manifest: DataFrame, latest_versions: DataFrame) -> DataFrame:
    return _emit(_gaps(lookup_join(manifest.select("repo_id", "package", "version"),
                                   _newest(latest_versions.select("package", "latest")),
                                   ["package"])), _outdated_seed())


def unmaintained(manifest: DataFrame) -> DataFrame:
    """Packages on the fixed list of unmaintained ones."""
    return _emit(manifest, _unmaintained_seed())


def hallucinated_package(manifest: DataFrame, registry: DataFrame) -> DataFrame:
    """Packages the registry does not know; a repository may declare one several times.

    The registry is asked once per package, and only what it does not know is brought down to
    one row per repository.
    """
    declared = manifest.where(_CHECKABLE).select("repo_id", "package")
    unknown = declared.select("package").distinct().join(registry.select("package").distinct(),
                                                         "package", "left_anti")
    unknown = written(unknown, shared_dir(manifest.sparkSession, "unknown"))
    return _emit(lookup_join(declared, unknown, ["package"], "left_semi").distinct(),
                 _hallucinated_seed("true"))


def brand_new_package(manifest: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    # Only young packages matter, so the lookup is small before it is joined.
    young = registry.where(f"{_age(as_of)} < {NEW_PACKAGE_DAYS}").select("package", "created")
    return _emit(lookup_join(manifest.select("repo_id", "package"), young, ["package"]),
                 _brand_new_seed(as_of))


def package_facts(latest_versions: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per package that either table knows."""
    known = registry.groupBy("package").agg(F.min("created").alias("created")) \
        .withColumn("registered", F.lit(True))
    newest = latest_versions.groupBy("package").agg(
        F.max_by("latest", F.struct(version_key("latest"), F.col("latest"))).alias("latest"))
    return newest.join(known, "package", "full")


def dependency_findings(manifest: DataFrame, advisories: DataFrame, latest_versions: DataFrame,
                        registry: DataFrame, as_of: str, facts: DataFrame | None = None
                        ) -> DataFrame:
    """All five checks; `manifest` holds one row per repository and package.

    The manifest meets the advisories once, and the facts about packages once: four of the
    checks come out of that one join. It is read for both, so give it in stored form; likewise
    `facts` (see `package_facts`), which are measured before they are joined.
    """
    if facts is None:
        facts = package_facts(latest_versions, registry)
    rows = _gaps(lookup_join(manifest.select("repo_id", "package", "version"),
                             _newest(facts).drop("latest"), ["package"], "left"))
    return known_vulnerabilities(manifest, advisories).unionByName(_emit(
        rows, _outdated_seed(), _unmaintained_seed(),
        _hallucinated_seed(f"registered IS NULL AND {_CHECKABLE}"), _brand_new_seed(as_of)))


def dependency_scan(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings per repository and the merged severity, which is never below medium."""
    per_repo = findings.groupBy("repo_id").agg(
        F.count("*").alias("_n"), F.max(F.col("severity") == "critical").alias("_c"),
        F.max(F.col("severity") == "high").alias("_h"))
    return repos.select("repo_id").distinct().join(per_repo, "repo_id", "left").select(
        "repo_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("findings"),
        F.when(F.col("_c"), "critical").when(F.col("_h"), "high").otherwise("medium")
        .alias("severity"))


def dependencies_scanned(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("repo_id").agg(
        F.count_distinct("package").cast("bigint").alias("dependencies"))


def framework_of_repo(manifest: DataFrame, repos: DataFrame) -> DataFrame:
    """First framework, by priority, among a repository's dependencies; else unknown."""
    known = constant_table(manifest.sparkSession, FRAMEWORKS,
                           "package string,framework string,priority int")
    named = manifest.join(F.broadcast(known), "package")  # six rows
    # Repositories without any join in as empty rows, so one shuffle serves both.
    rows = named.select("repo_id", "framework", "priority").unionByName(
        repos.select("repo_id"), allowMissingColumns=True)
    return rows.groupBy("repo_id").agg(
        F.coalesce(F.min_by("framework", "priority"), F.lit("unknown")).alias("framework"))
