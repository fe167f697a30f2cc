"""Named queries over the given tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import deps, env, fixes, ranking, reports, sketches
from ..operators.enrich import compliance_enrich
from ..operators.maintained import MaintainedFindings
from ..operators.scan import explode_hits, scan_files
from ..operators.select import select_files, selector_counts
from ..rules.catalog import FILE_PACKS, FIXER_PACKS, JSON_REPORT_PACKS
from ..schema import FINDING_COLUMNS
from ..session import shared_dir
from ..sources import corpus, files as sources, sinks
from ..sources.tree import tree, write_tree
from ..streaming import once, watch
from .audit import Dependencies, audit, changed_files_scan, indexed_scan, quick
from .late import LATE_RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TICK = "1 day"
ARRIVALS = 3
IGNORE = "prompts/**,src/config.js"
INDEXED_PACKS = ("secrets", "owasp", "db", "prompts")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _deps(spark, sf) -> Dependencies:
    return Dependencies(_manifest(spark, sf), corpus.advisories(spark, sf),
                        corpus.latest_versions(spark, sf), corpus.registry(spark, sf),
                        corpus.AS_OF).stored()


def _manifest(spark, sf) -> DataFrame:
    return deps.latest_declared(corpus.raw_manifest(spark, sf))


def _found(spark, sf, packs) -> DataFrame:
    return audit(corpus.files(spark, sf), packs)


def _everything(spark, sf, dependencies: Dependencies | None = None) -> DataFrame:
    return audit(corpus.files(spark, sf), dependencies=dependencies or _deps(spark, sf))


def _repos(spark, sf, manifest: DataFrame) -> DataFrame:
    """Every repository that has files or dependencies, one row each."""
    return corpus.files(spark, sf).select("repo_id") \
        .unionByName(manifest.select("repo_id")).distinct()


def _all_of(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All findings and all repositories, from one stored manifest."""
    dependencies = _deps(spark, sf)
    return _everything(spark, sf, dependencies), _repos(spark, sf, dependencies.manifest)


def _file_repos(spark, sf) -> DataFrame:
    return corpus.files(spark, sf).select("repo_id").distinct()


def _out(findings: DataFrame) -> DataFrame:
    return findings.select(*FINDING_COLUMNS)


def _stored(spark, findings: DataFrame) -> DataFrame:
    """Findings written once, for reports that read them several times."""
    return sinks.write_findings(findings, shared_dir(spark, "findings"))


def _pack_query(pack: str) -> Query:
    return lambda spark, sf: _out(_found(spark, sf, [pack]))


for _pack in (*FILE_PACKS, "matrix"):
    QUERIES[f"pack_{_pack}"] = _pack_query(_pack)


# ---- selectors, sources and sinks ---------------------------------------------------

@query
def selector_counts_all(spark, sf):
    return selector_counts(corpus.files(spark, sf))


@query
def ignore_user_patterns(spark, sf):
    return _out(audit(corpus.files(spark, sf), ["secrets"], ignore=IGNORE))


@query
def distinct_files(spark, sf):
    both = select_files(corpus.files(spark, sf), "owasp").unionByName(
        select_files(corpus.files(spark, sf), "db"))
    return sources.distinct_files(both).select("repo_id", "path")


@query
def manifest_source(spark, sf):
    return sources.manifest_source(corpus.files(spark, sf))


@query
def merge_dependency_maps(spark, sf):
    merged = sources.merged_dependencies(corpus.files(spark, sf))
    return merged.selectExpr("repo_id", "CAST(size(dependencies) AS BIGINT) AS packages", (
        "array_join(array_sort(transform(map_entries(dependencies), "
        "e -> concat(e.key, '@', e.value))), ',') AS declared"))


@query
def dotenv_source(spark, sf):
    return env.dotenv_lines(corpus.files(spark, sf))


@query
def env_issues(spark, sf):
    return env.env_issues(corpus.files(spark, sf))


@query
def findings_sink(spark, sf):
    return _stored(spark, _out(_found(spark, sf, JSON_REPORT_PACKS)))


@query
def json_report_sink(spark, sf):
    return sinks.write_json_report(_found(spark, sf, JSON_REPORT_PACKS),
                                   shared_dir(spark, "report"))


@query
def json_report(spark, sf):
    found = _stored(spark, _found(spark, sf, JSON_REPORT_PACKS))
    return reports.json_summary(found, _file_repos(spark, sf), corpus.AS_OF)


@query
def stored_changed_files(spark, sf):
    """Files kept in the stored layout, then the scan of the changed ones only."""
    files = sources.read_table(spark, _estate(spark, sf))
    return _out(changed_files_scan(files, corpus.changed(spark, sf)))


def _tree(spark, sf) -> str:
    """The files as a source tree in the shared folder, a folder per repository."""
    root = shared_dir(spark, "tree")
    write_tree(corpus.files(spark, sf).withColumn("repo", F.concat(
        F.lit("r"), F.col("repo_id").cast("string"))), root)
    return root


def _repo_of_tree():
    return F.substring("repo", 2, 20).cast("bigint").alias("repo_id")


@query
def tree_scan(spark, sf):
    """A pack over a source tree; the source opens the files that the selector takes."""
    found = tree(spark, _tree(spark, sf), selector="auth").select(
        _repo_of_tree(), "path", F.concat(F.lit("/corpus/"), "repo", F.lit("/"), "path").alias(
            "abs_path"), "content")
    return _out(audit(found, ["auth"]))


@query
def tree_listing(spark, sf):
    """Names only, by a test that the source takes over: no file is opened."""
    names = tree(spark, _tree(spark, sf), content=False)
    return names.where(F.col("path").startswith("src/") & ~F.col("path").endswith(".ts")).select(
        _repo_of_tree(), "path")


def _estate(spark, sf) -> str:
    """The files kept in the stored layout, with their index."""
    path = shared_dir(spark, "files")
    sources.write_table(corpus.files(spark, sf), path)
    return path


@query
def indexed_packs(spark, sf):
    """Whole packs over the texts that the trigram index lets through."""
    return _out(indexed_scan(spark, _estate(spark, sf), INDEXED_PACKS))


@query
def late_rules(spark, sf):
    """Rules added after the files were stored: only their candidates are read."""
    return _out(indexed_scan(spark, _estate(spark, sf), rules=LATE_RULES))


def change_batches(files: DataFrame) -> list[DataFrame]:
    """All files, then files removed, emptied of risks, edited; then some restored and moved."""
    def some(condition, op, content="content", path="path", root="abs_path"):
        return files.where(condition).selectExpr(
            "repo_id", f"{path} AS path", f"{root} AS abs_path", f"'{op}' AS op",
            f"{content} AS content")

    moved = dict(path="concat('moved/', path)",
                 root="concat(left(abs_path, length(abs_path) - length(path)), 'moved/', path)")
    edited = "concat(content, '\n', \"const feed = 'http://feed.example.com';\")"
    return [some("true", "A"),
            some("doc_id % 7 = 1", "D").unionByName(some("doc_id % 7 = 2", "M", "'const ok = 1;'"))
            .unionByName(some("doc_id % 7 = 3", "M", edited)),
            some("doc_id % 14 = 8", "A").unionByName(some("doc_id % 7 = 3", "M"))
            .unionByName(some("doc_id % 7 = 4", "D")).unionByName(
                some("doc_id % 7 = 4", "A", **moved))]


def _maintained(spark, sf) -> MaintainedFindings:
    state = MaintainedFindings(spark, shared_dir(spark, "state"), JSON_REPORT_PACKS).start()
    for changes in change_batches(corpus.files(spark, sf)):
        state.apply(changes)
    return state


@query
def maintained_findings(spark, sf):
    """Findings after three batches of changes, from what the batches changed alone."""
    return _out(_maintained(spark, sf).findings())


@query
def maintained_grades(spark, sf):
    return _maintained(spark, sf).grades()


@query
def dashboard_table(spark, sf):
    found, repos = _all_of(spark, sf)
    return reports.dashboard_table(_stored(spark, compliance_enrich(found)), repos)


@query
def pages_owasp(spark, sf):
    pages = corpus.page_files(spark, sf)
    return _out(explode_hits(scan_files(pages, ["owasp"]), ["owasp"]))


@query
def talk_prompts(spark, sf):
    talk = corpus.talk_files(spark, sf)
    return _out(explode_hits(scan_files(talk, ["prompts"]), ["prompts"]))


# ---- predicates ---------------------------------------------------------------------

@query
def scan_toggles(spark, sf):
    found = _found(spark, sf, ["owasp", "headers", "iac"])
    return found.groupBy("pack").agg(F.count("*").cast("bigint").alias("findings"))


@query
def quick_scan(spark, sf):
    return _out(quick(corpus.files(spark, sf)))


@query
def quiet_filter(spark, sf):
    return reports.quiet(_found(spark, sf, FILE_PACKS)).select(
        "repo_id", "path", "rule_id", "severity", "line")


@query
def explain_candidates(spark, sf):
    return reports.explain_candidates(_found(spark, sf, FILE_PACKS)).select(
        "repo_id", "path", "rule_id", "severity", "line")


@query
def fixable_filter(spark, sf):
    return reports.fixable(_found(spark, sf, FIXER_PACKS)).select(
        "repo_id", "path", "rule_id", "line")


# ---- joins --------------------------------------------------------------------------

@query
def known_vulnerabilities(spark, sf):
    return _out(deps.known_vulnerabilities(_manifest(spark, sf), corpus.advisories(spark, sf)))


@query
def range_vulnerabilities(spark, sf):
    return deps.range_vulnerabilities(corpus.range_manifest(spark, sf),
                                      corpus.advisories(spark, sf))


@query
def indirect_vulnerabilities(spark, sf):
    return deps.indirect_vulnerabilities(
        corpus.raw_manifest(spark, sf), corpus.requirements(spark, sf),
        corpus.advisories(spark, sf))


@query
def vulnerability_details(spark, sf):
    return deps.vulnerability_details(_manifest(spark, sf), corpus.advisories(spark, sf))


@query
def outdated_major(spark, sf):
    return _out(deps.outdated_major(_manifest(spark, sf), corpus.latest_versions(spark, sf)))


@query
def unmaintained(spark, sf):
    return _out(deps.unmaintained(_manifest(spark, sf)))


@query
def hallucinated_package(spark, sf):
    return _out(deps.hallucinated_package(corpus.raw_manifest(spark, sf),
                                          corpus.registry(spark, sf)))


@query
def brand_new_package(spark, sf):
    return _out(deps.brand_new_package(_manifest(spark, sf), corpus.registry(spark, sf),
                                       corpus.AS_OF))


@query
def dependency_scan(spark, sf):
    dependencies = _deps(spark, sf)
    return deps.dependency_scan(dependencies.findings(),
                                _repos(spark, sf, dependencies.manifest))


@query
def dependencies_scanned(spark, sf):
    return deps.dependencies_scanned(corpus.raw_manifest(spark, sf))


@query
def estate_dependencies(spark, sf):
    """Distinct packages of shares of the estate, from stored sketches, beside exact counts."""
    manifest, path = corpus.raw_manifest(spark, sf), shared_dir(spark, "sketches")
    sketches.write_sketches(manifest, path)
    share = (F.col("part") % 8).alias("share")
    told = sketches.estimates(sketches.read_sketches(spark, path), share)
    pairs = manifest.groupBy("repo_id", "package").agg(F.count("*").alias("n"))
    exact = pairs.groupBy((sketches.part_of() % 8).alias("share")).agg(
        F.count_distinct("package").alias("packages"), F.count("*").alias("uses"),
        F.sum("n").alias("declared"))
    return sketches.audited(told, exact, ["share"])


@query
def framework_of_repo(spark, sf):
    manifest = corpus.raw_manifest(spark, sf)
    return deps.framework_of_repo(manifest, _repos(spark, sf, manifest))


@query
def compliance_enrich_findings(spark, sf):
    return compliance_enrich(_found(spark, sf, FILE_PACKS)).select(
        "repo_id", "path", "rule_id", "match_ord", "owasp", "mitre", "nist")


@query
def changed_files(spark, sf):
    return _out(changed_files_scan(corpus.files(spark, sf), corpus.changed(spark, sf)))


@query
def fix_lines(spark, sf):
    return fixes.fix_lines(corpus.files(spark, sf))


# ---- aggregations -------------------------------------------------------------------

@query
def all_findings(spark, sf):
    return _out(_everything(spark, sf))


@query
def category_summary(spark, sf):
    return reports.category_summary(_everything(spark, sf))


@query
def pack_severity(spark, sf):
    return reports.pack_severity(_everything(spark, sf))


@query
def severity_counts(spark, sf):
    return reports.severity_counts(_found(spark, sf, JSON_REPORT_PACKS))


@query
def type_counts(spark, sf):
    return reports.type_counts(_found(spark, sf, JSON_REPORT_PACKS))


@query
def file_counts(spark, sf):
    return reports.file_counts(_found(spark, sf, JSON_REPORT_PACKS))


@query
def report_rollup(spark, sf):
    return reports.report_rollup(_found(spark, sf, JSON_REPORT_PACKS))


@query
def scans_performed(spark, sf):
    return reports.scans_performed(_found(spark, sf, JSON_REPORT_PACKS))


@query
def overall_status(spark, sf):
    return reports.overall_status(_found(spark, sf, JSON_REPORT_PACKS), _file_repos(spark, sf))


@query
def security_grade(spark, sf):
    return reports.security_grade(*_all_of(spark, sf))


@query
def owasp_grade(spark, sf):
    """The flagship: enriched findings of one pack, graded per repository."""
    found = compliance_enrich(_found(spark, sf, ["owasp"]))
    return reports.security_grade(found, _file_repos(spark, sf))


@query
def release_gate(spark, sf):
    return reports.release_gate(*_all_of(spark, sf))


@query
def commit_gate(spark, sf):
    found = changed_files_scan(corpus.files(spark, sf), corpus.changed(spark, sf))
    return reports.commit_gate(found, _file_repos(spark, sf))


@query
def assessment(spark, sf):
    return reports.assessment(_found(spark, sf, JSON_REPORT_PACKS), _file_repos(spark, sf))


@query
def dashboard_tiles(spark, sf):
    return reports.dashboard_tiles(*_all_of(spark, sf))


@query
def prompt_files_scanned(spark, sf):
    return reports.prompt_files_scanned(corpus.files(spark, sf))


@query
def env_config_status(spark, sf):
    return env.env_config_status(corpus.files(spark, sf))


@query
def env_file_stats(spark, sf):
    return env.env_file_stats(corpus.files(spark, sf))


@query
def required_files_check(spark, sf):
    return reports.required_files_check(corpus.files(spark, sf))


@query
def recommendations(spark, sf):
    return reports.recommendations(_found(spark, sf, JSON_REPORT_PACKS), _file_repos(spark, sf))


@query
def threat_coverage(spark, sf):
    return reports.threat_coverage(_found(spark, sf, ["matrix"]))


# ---- ranking ------------------------------------------------------------------------

@query
def findings_by_severity(spark, sf):
    return ranking.findings_by_severity(_found(spark, sf, JSON_REPORT_PACKS)).select(
        "severity", "pack", "repo_id", "path", "rule_id", "match_ord", "line")


@query
def top_categories(spark, sf):
    return ranking.top_categories(_found(spark, sf, JSON_REPORT_PACKS))


@query
def remediation_queue(spark, sf):
    return ranking.remediation_queue(_stored(spark, _found(spark, sf, JSON_REPORT_PACKS)))


@query
def context_window(spark, sf):
    return ranking.context_window(corpus.files(spark, sf))


@query
def fix_order(spark, sf):
    return ranking.fix_order(corpus.files(spark, sf))


# ---- rewriting ----------------------------------------------------------------------

@query
def apply_fixes(spark, sf):
    return fixes.apply_fixes(corpus.files(spark, sf))


@query
def fix_summary(spark, sf):
    return fixes.fix_summary(fixes.apply_fixes(corpus.files(spark, sf)))


# ---- streaming ----------------------------------------------------------------------

def _replay(spark, sf) -> DataFrame:
    """Stream the events of the table as file changes until all are read."""
    path = f"{sf}/events.parquet"
    # A stream source reads folders; the bracket makes a glob, which takes a single file too.
    events = spark.readStream.schema(spark.read.parquet(path).schema) \
        .parquet(f"{sf}/[e]vents.parquet")
    out = shared_dir(spark, "watch")
    changes = corpus.changes_of(events, corpus.documents(spark, sf))
    watch.watch_stream(changes, corpus.files(spark, sf), f"{out}/rows", f"{out}/checkpoint", TICK,
                       trigger={"availableNow": True}).awaitTermination()
    return watch.watched(spark, f"{out}/rows")


def _tick_text(df: DataFrame) -> DataFrame:
    return df.withColumn("tick", F.date_format("tick", "yyyy-MM-dd"))


@query
def watch_ignore(spark, sf):
    return watch.watch_ignore(corpus.changes(spark, sf)).groupBy("repo_id", "path", "op").agg(
        F.count("*").cast("bigint").alias("changes"))


@query
def watch_scan(spark, sf):
    return _tick_text(watch.watch_findings(_replay(spark, sf))).select(
        "tick", "repo_id", "path", "rule_id", "match_ord", "line")


@query
def watch_batch_summary(spark, sf):
    return _tick_text(watch.watch_batch_summary(_replay(spark, sf)))


@query
def watch_once(spark, sf):
    """Changes that arrive in several files, in no order; each file is scanned once a tick."""
    out = shared_dir(spark, "once")
    changes = corpus.changes(spark, sf)
    changes.repartition(ARRIVALS, "path", "ts").write.parquet(f"{out}/arriving")
    arriving = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{out}/arriving")
    once.watch_once(arriving, corpus.files(spark, sf), f"{out}/rows", f"{out}/checkpoint", TICK,
                    trigger={"availableNow": True}).awaitTermination()
    return _tick_text(once.scans_per_tick(once.scanned_once(spark, f"{out}/rows")))
