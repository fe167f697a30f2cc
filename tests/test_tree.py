"""The source tree reader: names are tested first, parts follow bytes, nothing is lost or doubled."""

import os

import pytest
from pyspark.sql import functions as F

from warpsift.operators.select import SELECTORS, selected
from warpsift.sources import files as sources
from warpsift.sources.slots import SLOTS
from warpsift.sources.tree import Part, TreeReader, path_test, tree, write_tree


@pytest.fixture()
def root(tmp_path):
    texts = {f"one/{s[0]}": s[1] for s in SLOTS}
    texts |= {"one/.git/config": "x", "one/node_modules/a/b.js": "x", "one/lib/.git/y.js": "x",
              "one/lib/node_modules/z.js": "x", "two/.env": "A=1", "two/.github/workflows/a.yml": "",
              "two/a b/ü.js": "ü\r\n\n", "two/__init__.py": "", "loose.txt": "x"}
    for path, text in texts.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        with open(target, "w", newline="") as f:
            f.write(text)
    (tmp_path / "empty").mkdir()
    return str(tmp_path), texts


def in_repos(texts):
    return {p: t for p, t in texts.items() if "/" in p
            and p.split("/")[1] not in (".git", "node_modules")}


def test_all_files_come_once(spark, root):
    folder, texts = root
    got = {f"{r.repo}/{r.path}": r.content for r in tree(spark, folder).collect()}
    assert got == in_repos(texts)
    small = tree(spark, folder, bytes_per_task="200")
    assert small.rdd.getNumPartitions() > 10
    assert sorted((f"{r.repo}/{r.path}", r.content) for r in small.collect()) == sorted(got.items())
    whole = tree(spark, f"file://{folder}", plan="repos")
    assert whole.rdd.getNumPartitions() == 3 and whole.count() == len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_parts_of_a_few_files(root, n):
    folder, texts = root

    class Field:
        name = "path"

    class Schema:
        fields = [Field()]

    reader = TreeReader(Schema(), {"path": folder, "files_per_task": str(n)})
    parts = reader.partitions()
    listed = [(p.repo, *at) for p in parts for at, _ in reader._files(p)]
    assert len(listed) == len(set(listed)) == len(in_repos(texts))
    assert len(parts) >= len(listed) / n


def test_a_large_repository_is_dealt_over_many_tasks(tmp_path):
    for d in range(40):
        (tmp_path / "big" / f"d{d}").mkdir(parents=True)
        for f in range(50):
            (tmp_path / "big" / f"d{d}" / f"{f}.js").write_text("x" * 100)

    class Field:
        name = "content"

    class Schema:
        fields = [Field()]

    reader = TreeReader(Schema(), {"path": str(tmp_path), "bytes_per_task": "10000"})
    parts = reader.partitions()
    assert len(parts) == 20
    assert [sum(1 for _ in reader._files(p)) for p in parts] == [100] * 20
    # A part lists the folders that it reaches into, and no others.
    listed, scandir = [], os.scandir
    os.scandir = lambda p: (listed.append(p), scandir(p))[1]
    try:
        list(reader._files(parts[7]))
    finally:
        os.scandir = scandir
    assert len(listed) <= 5


def test_paths_are_tested_before_texts(spark, root, tmp_path):
    """Files that fail a test of their names may be unreadable; the plan shows the tests."""
    folder, texts = root
    wanted = F.col("path").endswith(".js") & F.col("path").startswith("src/") \
        & ~F.col("path").contains("session") & (F.col("repo") == "one") & (F.length("content") > 5)
    df = tree(spark, folder).where(wanted)
    want = sorted(p for p, t in in_repos(texts).items() if p.startswith("one/src/")
                  and p.endswith(".js") and "session" not in p and len(t) > 5)
    assert sorted(f"{r.repo}/{r.path}" for r in df.collect()) == want and want
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if line.lstrip(" +-*(1)").startswith("Filter")]
    assert "source_tree" in plan and not any("EndsWith" in x or "StartsWith" in x for x in left)
    opened, reader = [], TreeReader(type("S", (), {"fields": [
        type("F", (), {"name": n}) for n in ("repo", "path", "content")]})(), {"path": folder})
    import builtins
    from pyspark.sql.datasource import StringEndsWith
    assert list(reader.pushFilters([StringEndsWith(("path",), ".py")])) == []
    real = builtins.open
    builtins.open = lambda name, *a, **k: (opened.append(str(name)), real(name, *a, **k))[1]
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        builtins.open = real
    assert len(opened) == len(rows) and all(o.endswith(".py") for o in opened) and rows


def test_selectors_mean_the_same(spark, root):
    folder, texts = root
    paths = [p.split("/", 1)[1] for p in texts if "/" in p] + [
        "src/scanners/a.js", "dist/a.js", ".env", ".env.js", "test/x.py", "a/config/b", "x.test.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for name in SELECTORS:
        takes = path_test(name)
        assert sorted(r.path for r in df.where(selected(name)).collect()) == sorted(
            p for p in paths if takes(p)), name
    picked = tree(spark, folder, selector="workflows")
    assert [r.path for r in picked.where("repo = 'two'").collect()] == [".github/workflows/a.yml"]


def test_names_only_and_folders_left_out(spark, root):
    folder, texts = root
    names = tree(spark, folder, content=False, skip="node_modules, .git")
    assert names.columns == ["repo", "path", "abs_path"]
    assert sorted(f"{r.repo}/{r.path}" for r in names.collect()) == sorted(
        p for p in in_repos(texts) if "/lib/" not in p)


def test_written_trees_come_back(spark, tmp_path):
    files = spark.createDataFrame([("r1", "a/b.js", "x\r\ny\n"), ("r2", ".env", "ü"),
                                   ("r2", "no.js", None)], "repo string, path string, content string")
    assert write_tree(files, f"file:{tmp_path}/t") == 3
    got = sources.read_tree(spark, f"{tmp_path}/t")
    assert sorted(r.content for r in got.collect()) == ["", "x\r\ny\n", "ü"]
    assert tree(spark, f"{tmp_path}/t").where("path = 'none'").count() == 0
    os.mkdir(f"{tmp_path}/void")
    assert tree(spark, f"{tmp_path}/void").count() == 0
    assert TreeReader(type("S", (), {"fields": []})(), {"path": f"{tmp_path}/void"}).partitions() \
        == [Part("")]


def test_small_repositories_share_a_task(spark, tmp_path):
    for n in range(300):
        target = tmp_path / f"r{n:03}" / "src" / "a.js"
        target.parent.mkdir(parents=True)
        target.write_text(f"const n = {n};")
    read = tree(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() < 20
    assert sorted((r.repo, r.path, r.content) for r in read.collect()) == [
        (f"r{n:03}", "src/a.js", f"const n = {n};") for n in range(300)]
    names = tree(spark, str(tmp_path), content=False, files_per_task="50")
    assert names.rdd.getNumPartitions() == 6 and names.count() == 300
