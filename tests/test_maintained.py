"""Maintained findings equal a full scan after any batches, and only changed texts are tested."""

import random

import pytest

from warpsift.operators.maintained import MaintainedFindings
from warpsift.operators.reports import security_grade
from warpsift.plans.audit import audit
from warpsift.rules.base import HIGH, Pattern, Rule
from warpsift.sources.slots import SLOTS

PACKS = ("secrets", "iac", "headers")
CHANGES = "repo_id bigint, path string, abs_path string, op string, content string"
FILES = "repo_id bigint, path string, abs_path string, content string"


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def changes_of(spark, changes):
    return spark.createDataFrame([(r, p, f"/corpus/r{r}/{p}", "D" if t is None else "M", t)
                                  for (r, p), t in changes.items()], CHANGES)


def test_random_batches_equal_full_scans(spark, tmp_path):
    rng = random.Random(11)
    texts = [t for s in SLOTS for t in s[1:3]] + [""]
    paths = [s[0] for s in SLOTS] + ["docs/x.md", "test/a.js", "node_modules/b.js"]
    state = MaintainedFindings(spark, str(tmp_path / "state"), PACKS).start()
    tree, hot = {}, rng.choice(texts)
    for batch in range(3):
        changes = {}
        for _ in range(60 if batch == 0 else 12):
            key = rng.randrange(6), rng.choice(paths)
            # A third of all files hold the same text.
            changes[key] = None if rng.random() < 0.2 else \
                hot if rng.random() < 0.33 else rng.choice(texts)
        if batch == 1:
            changes = {}
        state.apply(changes_of(spark, changes))
        tree = {k: t for k, t in {**tree, **changes}.items() if t is not None}
        files = spark.createDataFrame([(r, p, f"/corpus/r{r}/{p}", t)
                                       for (r, p), t in tree.items()], FILES)
        full = audit(files, PACKS)
        assert rows(state.findings()) == rows(full)
        assert rows(state.grades()) == rows(security_grade(full, files))
        assert rows(state.counts()) == rows(
            full.groupBy("repo_id", "severity").count().withColumnRenamed("count", "findings"))
    small = state.compacted(str(tmp_path / "small"))
    assert rows(small.findings()) == rows(full) and rows(small.grades()) == rows(state.grades())
    assert small.last() == 1 and state.last() == 3
    more = {(1, "src/app.js"): SLOTS[0][1]}
    for kept in (state, small):
        kept.apply(changes_of(spark, more))
    assert rows(small.findings()) == rows(state.findings())


def test_known_texts_are_not_tested_again(spark, tmp_path):
    state = MaintainedFindings(spark, str(tmp_path / "state"), ["owasp"]).start()
    risky, path = SLOTS[0][1], "src/app.js"

    def tested(changes):
        gen = state.apply(changes_of(spark, changes))
        return state._read("hits").where(f"gen = {gen}").count()

    def moves():
        return [tuple(r) for r in state._read("changes").where(
            f"gen = {state.last()}").selectExpr("path", "sum(sign) over (partition by path)")
            .distinct().orderBy("path").collect()]

    assert tested({(1, path): risky, (2, path): risky, (3, "src/b.js"): risky}) == 1
    n = state.findings().where("repo_id = 1").count()
    assert n > 2
    assert tested({(1, "src/moved.js"): risky, (1, path): None}) == 0
    assert moves() == [(path, -n), ("src/moved.js", n)]
    assert tested({(1, "src/moved.js"): risky}) == 0 and moves() == []
    # One more line: the hits of both texts cancel out, the new one stays.
    assert tested({(2, path): risky + "\nconst z = 'http://other.example.com';"}) == 1
    assert sum(abs(s) for _, s in moves()) <= 2
    # A file that no selector takes is never tested; the same text elsewhere is another profile.
    assert tested({(4, "notes.txt"): risky + "!"}) == 0
    assert tested({(4, "test/a.js"): risky}) == 0


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    state = MaintainedFindings(spark, str(tmp_path / "state"), ["owasp"]).start()
    first = changes_of(spark, {(1, "src/app.js"): SLOTS[0][1]})
    second = changes_of(spark, {(1, "src/app.js"): "const ok = 1;", (2, "a.js"): SLOTS[0][1]})
    state.apply(first)
    whole = rows(state.findings())
    state._finish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        state.apply(second)
    again = MaintainedFindings(spark, str(tmp_path / "state"), ["owasp"])
    assert rows(again.findings()) == whole and again.last() == 1
    again.apply(second)
    after = rows(again.findings())
    again.apply(second, gen=2)
    assert rows(again.findings()) == after and again.last() == 2


def test_only_touched_folders_of_the_state_are_read(spark, tmp_path):
    """Folders of other repositories and other hashes may hold anything."""
    import glob
    state = MaintainedFindings(spark, str(tmp_path / "state"), ["owasp"]).start()
    risky = SLOTS[0][1]
    state.apply(changes_of(spark, {(r, "src/app.js"): f"{risky}\n// {r}" for r in range(40)}))
    keep = spark.createDataFrame([(3,)], "repo_id bigint").selectExpr(
        "pmod(xxhash64(repo_id), 64) AS p").first().p
    spoiled = 0
    for f in glob.glob(f"{state.root}/*/tree/gen=*/repo_part=*/*.parquet"):
        if f"repo_part={keep}/" not in f:
            open(f, "wb").write(b"spoiled")
            spoiled += 1
    assert spoiled > 10
    gen = state.apply(changes_of(spark, {(3, "src/app.js"): "const ok = 1;"}))
    delta = state._read("changes").where(f"gen = {gen}")
    assert delta.count() > 2 and delta.where("repo_id != 3 OR sign != -1").count() == 0


def test_other_rules_are_another_state(spark, tmp_path):
    root, rule = str(tmp_path / "state"), Rule(
        "owasp", "late", HIGH, "c", "t", None, "title", "fix", all_of=(Pattern("zzz"),))
    plain = MaintainedFindings(spark, root, ["owasp"])
    more = MaintainedFindings(spark, root, ["owasp"], [rule])
    assert plain.catalog != more.catalog
    with pytest.raises(ValueError):
        MaintainedFindings(spark, root, ["env"])


def test_a_batch_writes_few_files(spark, tmp_path):
    changes = changes_of(spark, {(r, p): SLOTS[0][1] + f"\n// {r}" for r in range(300)
                                 for p in ("src/app.js", "src/b.js")}).repartition(40)
    state = MaintainedFindings(spark, str(tmp_path / "state"), PACKS).start()
    gen = state.apply(changes)
    for table in ("tree", "hits", "changes", "counts"):
        written = list((tmp_path / "state").glob(f"*/{table}/gen={gen}/**/*.parquet"))
        assert 0 < len(written) <= 80, table
