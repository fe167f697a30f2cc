"""Joins, environment checks, reports, fixes, sources and the stream."""

import pytest
from pyspark.sql import functions as F

from warpsift.functions.globs import any_glob
from warpsift.functions.versions import version_key
from warpsift.operators import deps, env, fixes, joins
from warpsift.operators.enrich import compliance_enrich
from warpsift.operators.select import selected
from warpsift.plans.audit import audit, changed_files_scan
from warpsift.plans.queries import QUERIES
from warpsift.sources import corpus, files as sources
from warpsift.streaming import watch


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # One key holds most rows; one lookup key repeats; some match nothing; some are null.
    facts = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 100 == 2, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"))
    lookup = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k2", 3), ("k5", 4), ("none", 5), (None, 6)],
        "k string, v int")
    mine = joins.salted_join(facts, lookup, ["k"], how, tasks=8)
    plain = facts.join(lookup, ["k"], how)
    assert sorted(map(str, mine.select(plain.columns).collect())) == \
        sorted(map(str, plain.collect()))
    assert joins.hot_keys(facts, ["k"], 8).first()["_salts"] > 1
    assert sorted(map(str, joins.lookup_join(facts, lookup, ["k"], how, max_rows=2)
                      .select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_broadcast_needs_a_measured_size(spark):
    table = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert joins.fits_broadcast(table, max_rows=100)
    assert not joins.fits_broadcast(table, max_rows=99)
    assert not joins.fits_broadcast(table, max_bytes=50)


def test_version_keys(spark):
    cases = {"1.2.3": [1, 2, 3], "^1.2": [1, 2, 0], "~4": [4, 0, 0], "v2.0.10+x.9": [2, 0, 10],
             "1.x": None, "*": None, ">=1.0.0": None, "1.2.3-beta": None, "latest": None,
             "": None, "10.0.0": [10, 0, 0], "1.2.3.4": None, "1..2": None}
    rows = spark.createDataFrame([(v,) for v in cases], "v string") \
        .select("v", version_key("v").alias("k")).collect()
    assert {r["v"]: r["k"] for r in rows} == cases


def test_dependency_checks(spark):
    manifest = spark.createDataFrame([
        (1, "a", "1.9.0"), (1, "b", "^2.0.0"), (1, "moment", "2.0.0"), (2, "ghost", "1.0.0"),
        (2, "file:x", "1.0.0"), (2, "young", "9.0.0"), (3, "a", "1.10.0"), (3, "future", "1.0.0")],
        "repo_id bigint, package string, version string")
    advisories = spark.createDataFrame([
        ("a", "moderate", "1.2.0", "1.10.0"), ("b", "odd", "2.0.0", None)],
        "package string, severity string, introduced string, fixed string")
    latest = spark.createDataFrame([("a", "3.0.0"), ("b", "3.0.0"), ("young", "8.0.0")],
                                   "package string, latest string")
    registry = spark.createDataFrame(
        [("a", "2020-01-01 00:00:00"), ("b", None), ("moment", "2020-01-01 00:00:00"),
         ("young", "2024-01-24 00:00:01"), ("future", "2024-02-01 00:00:00")],
        "package string, created string").withColumn("created", F.col("created")
                                                     .cast("timestamp"))
    got = deps.dependency_findings(manifest, advisories, latest, registry, "2024-01-31 00:00:00")
    rows = {(r["repo_id"], r["package"], r["rule_id"], r["severity"]) for r in got.collect()}
    assert rows == {
        (1, "a", "known_cve", "medium"), (1, "b", "known_cve", "medium"),
        (1, "a", "outdated_major", "medium"), (3, "a", "outdated_major", "medium"),
        (1, "moment", "unmaintained", "medium"), (2, "ghost", "hallucinated", "high"),
        (2, "young", "brand_new", "critical"), (3, "future", "brand_new", "critical")}
    titles = {r["package"]: r["title"] for r in got.where("rule_id = 'brand_new'").collect()}
    assert titles["young"].endswith("(7 days)")
    scan = {r["repo_id"]: r["severity"] for r in deps.dependency_scan(
        got, manifest.select("repo_id").unionByName(spark.range(9, 10).toDF("repo_id"))).collect()}
    assert scan == {1: "medium", 2: "critical", 3: "critical", 9: "medium"}


def test_compliance_by_prefix(spark):
    refs = ["A03:2021 \u2013 Injection", "A03:2021", "see A10:2021 and more", "Injection",
            "A99", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, owasp string")
    got = [r["nist"] for r in compliance_enrich(df).orderBy("i").collect()]
    assert got == ["DE.CM-8 Vulnerability Scans"] * 4 + [None] * 3


def test_environment_files(files_of):
    text = "# note\nGOOD=1\n\nbad-key=2\n  SPACED = 3 = 4\nRAW=a b\r\nQUOTED='a b'\nX=a$b=c"
    files = files_of({".env": text, "a.js": "x", "sub/.gitignore": ".env"})
    issues = [(r["line"], r["suggestion"]) for r in env.env_issues(files).collect()]
    assert sorted(issues) == sorted([
        (4, "bad-key=2"), (5, "SPACED = 3 = 4"), (5, "SPACED=3 = 4"), (6, 'RAW="a b"'),
        (8, 'X="a$b=c"')])
    stats = env.env_file_stats(files).first()
    assert (stats["total_lines"], stats["valid_entries"], stats["issues"]) == (8, 4, 5)
    assert {r["rule_id"]: r["title"] for r in audit(files, ["env"]).collect()} == {
        "gitignore_missing": "Environment file is not ignored by version control",
        "no_env_example": "No sample environment file",
        "env_format": "5 formatting issue(s) in the environment file"}


def test_repository_without_interesting_files_still_lacks_them(files_of):
    rows = audit(files_of({"readme.txt": "hi"}), ["env"]).collect()
    assert {r["rule_id"] for r in rows} == {"gitignore_missing", "no_env_example"}


def test_fixes_apply_in_order(files_of):
    key, token = "AK" + "IA" + "A" * 16, "gh" + "p_" + "b" * 36
    text = f"const a = '{key}', b = \"{token}\";\nsay '{key}'\nlast"
    done = fixes.apply_fixes(files_of({"a.js": text, "clean.js": "x"})).collect()
    assert len(done) == 1 and done[0]["fixes"] == 2
    first, second, last = done[0]["content"].split("\n")
    assert first == ("const a = process.env.AWS_ACCESS_KEY_ID, b = process.env.GITHUB_TOKEN;"
                     + fixes.MARKER * 2)
    assert (second, last) == (f"say '{key}'", "last")


def test_globs():
    import re

    def hit(globs, path, dot=False):
        return bool(re.search(any_glob([globs], dot), path))
    assert hit("**/*api*", "x/myapi.js") and not hit("**/*api*", "api/users.js")
    assert hit("**/*.js", "a.js") and not hit("**/*.js", ".a.js") and not hit("**/*.js", "a/.js")
    assert not hit("**/*.js", ".hidden/a.js") and hit("**/routes/**", "a/routes/b/c")
    assert hit("**/.env*", "a/.env.local") and not hit("**/.env*", "a/x.env")
    assert hit("node_modules/**", "node_modules/.bin/a", True)
    assert not hit("node_modules/**", "a/node_modules/b", True)
    assert hit("*.test.*", "a.test.js", True) and not hit("*.test.*", "s/a.test.js", True)
    assert hit("**/config/*", "a/config/b") and not hit("**/config/*", "a/config/b/c")
    assert hit("**/*.{js,ts}", "a.ts") and not hit("**/*.{js,ts}", "a.tsx")


def test_route_selector_skips(spark):
    df = spark.createDataFrame([("src/scanners/a.js",), ("src/a.js",)], "path string")
    assert [r[0] for r in df.where(selected("routes")).collect()] == ["src/a.js"]


def test_tree_and_manifest_are_read(spark, tmp_path):
    for path, text in {"one/src/a.js": "eval(x)\n", "one/package.json":
                       '{"dependencies":{"a":"1","b":"2"},"devDependencies":{"b":"3"}}',
                       "two/.env": "A=1", "two/package.json": "{broken"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    files = sources.read_tree(spark, str(tmp_path))
    got = {(r["path"], r["abs_path"], r["content"]) for r in files.collect()}
    assert ("src/a.js", f"{tmp_path}/one/src/a.js", "eval(x)\n") in got and len(got) == 4
    assert files.select("repo_id").distinct().count() == 2
    assert {(r["package"], r["version"]) for r in sources.manifest_source(files).collect()} == {
        ("a", "1"), ("b", "3")}


def test_stream_equals_batch(spark, tmp_path):
    """Changes arriving in several files give the ticks one batch job gives."""
    sf = "/root/testdata/sf0.01"
    changes, files = corpus.changes(spark, sf), corpus.files(spark, sf)
    # In no order of time, so that most of them are late.
    changes.repartition(4, "path").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1) \
        .parquet(str(tmp_path / "in"))
    query = watch.watch_stream(arriving, files, str(tmp_path / "out"), str(tmp_path / "cp"),
                               "1 day", trigger={"availableNow": True})
    query.awaitTermination()
    stream = watch.watched(spark, str(tmp_path / "out"))
    batch = watch.scan_ticks(watch.ticks(changes, "1 day"), files)
    for view in (watch.watch_findings, watch.watch_batch_summary):
        assert sorted(map(str, view(stream).collect())) == sorted(map(str, view(batch).collect()))
    assert watch.watch_findings(batch).count() > 0


def test_stored_layout_prunes_folders(spark, tmp_path):
    """A scan of changed files opens the folders of their repositories only."""
    sf = "/root/testdata/sf0.001"
    kept = str(tmp_path / "files")
    sources.write_table(corpus.files(spark, sf), kept)
    files = sources.read_table(spark, kept)
    assert files.count() == corpus.files(spark, sf).count()
    one = corpus.changed(spark, sf).where("repo_id = 1")
    scanned = changed_files_scan(files, one)
    plan = scanned._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "repo_part" in plan
    want = changed_files_scan(corpus.files(spark, sf), one)
    assert sorted(map(str, scanned.collect())) == sorted(map(str, want.collect()))


def test_false_calm_is_not_reported(spark, sf_dir):
    """Packs with findings are never called `none` or 0."""
    counts = {r["pack"]: r["n"] for r in QUERIES["all_findings"](spark, sf_dir).groupBy(
        "pack").agg(F.count("*").alias("n")).collect()}
    for r in QUERIES["pack_severity"](spark, sf_dir).collect():
        assert (r["severity"] == "none") == (r["pack"] not in counts)
    for r in QUERIES["scans_performed"](spark, sf_dir).collect():
        assert r["findings"] == counts.get(r["pack"], 0)


def test_the_pass_reads_the_texts_once(spark, tmp_path):
    """The union of all findings is drawn from stored hits: no text column is left in it."""
    kept = str(tmp_path / "files")
    sources.write_table(corpus.files(spark, "/root/testdata/sf0.001"), kept)
    found = audit(sources.read_table(spark, kept))
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.where("pack = 'env'").count() > 0


def test_texts_are_dealt_out_evenly(spark, sf_dir):
    rows = [r[0] for r in corpus.files(spark, "/root/testdata/sf0.01").groupBy(
        F.spark_partition_id().alias("p")).count().select("count").collect()]
    assert len(rows) == 8 and max(rows) < 1.5 * min(rows)


def test_equal_and_keyless_rows_spread(spark):
    facts = spark.createDataFrame([(None, 1)] * 900 + [("hot", 1)] * 900 + [("b", 2)] * 9,
                                  "k string, v int")
    out = joins.salted_join(facts, spark.createDataFrame([("hot", 7), ("b", 8)],
                                                         "k string, w int"), ["k"], "left", 4)
    assert out.count() == 1809 and out.where("w = 7").count() == 900
    assert out.where("w is null").count() == 900


def test_rules_need_a_condition():
    from warpsift.rules.base import Rule
    with pytest.raises(ValueError):
        Rule("secrets", "x", "high", "c", "t", None, "title", "fix")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_are_read_from_stored_counts(spark):
    """The facts may be costly: they are worked out once for the counts, not again by each use."""
    facts = spark.range(100).select((F.col("id") % 2).alias("k"))
    hot = joins.hot_keys(facts, ["k"], 8)
    assert hot.inputFiles() and "Range" not in _plan(hot)
    assert {(r.k, r._salts) for r in hot.collect()} == {(0, 4), (1, 4)}


def test_counts_of_dependency_findings_make_no_texts(spark, sf_dir):
    found = deps.dependency_findings(
        deps.latest_declared(corpus.raw_manifest(spark, sf_dir)), corpus.advisories(spark, sf_dir),
        corpus.latest_versions(spark, sf_dir), corpus.registry(spark, sf_dir), corpus.AS_OF)
    plan = _plan(found.groupBy("repo_id").count())
    assert "major version(s)" not in plan and "sha2" not in plan
    assert "lambda" not in _plan(compliance_enrich(found.select("owasp")))


def test_hallucinated_packages_come_once(spark):
    manifest = spark.createDataFrame(
        [(1, "a", "1.0.0"), (1, "a", "2.0.0"), (1, "a", "2.0.0"), (2, "a", "1.0.0"),
         (None, "a", "1.0.0"), (1, "known", "1.0.0"), (1, None, "1.0.0"), (1, "file:x", "1.0.0")],
        "repo_id bigint, package string, version string")
    registry = spark.createDataFrame([("known",), ("known",), (None,)], "package string")
    out = deps.hallucinated_package(manifest, registry)
    assert sorted((str(r.repo_id), r.package) for r in out.collect()) == [
        ("1", "a"), ("2", "a"), ("None", "a")]
