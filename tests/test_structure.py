"""Nested route handlers and the entries of workflow files."""

import pytest

from warpsift.operators.routes import handlers
from warpsift.operators.workflow import entries
from warpsift.plans.audit import audit


def lines(files_of, text):
    return sorted(r.line for r in audit(files_of({"a.js": text}), ["routes"]).collect())


INNER = "r2.post('/in', (req, res) => {\n  db.save(1);\n});\n"
SAFE = "r2.put('/in', (req, res) => {\n  if (req.user) db.save(1);\n});\n"


@pytest.mark.parametrize("text, bad", [
    (f"app.post('/out', async (req, res) => {{\n{INNER}  db.update(2);\n}});", [1, 2]),
    # A look at the caller inside the inner handler says nothing about the outer one.
    (f"app.post('/out', (req, res) => {{\n{SAFE}  db.update(2);\n}});", [1]),
    (f"app.post('/out', (req, res) => {{\n  check(req.user);\n{INNER}  db.update(2);\n}});", [3]),
    # What the inner one writes is not the outer one's.
    (f"app.post('/out', (req, res) => {{\n{INNER}}});", [2]),
    (f"app.post('/out', (req, res) => {{\n{INNER}{INNER}}});\n{INNER}", [2, 5, 9]),
    (f"app.post('/o', req => {{\n  r.put('/m', q => {{\n{INNER}  }});\n  x.destroy();\n}});", [1, 3]),
    ("app.post('/a', (req, res) => {\n  s(`text ) } ${x}`);\n  db.save(1);\n});", [1]),
    ("app.post('/a', (req, res) => {\n  s(`\n)});\n`); // )});\n  /* )\n} */ db.save(1);\n});", [1]),
    ("// app.post('/a', (q) => {\napp.put('/b', (q) => {\n  db.save(1);\n});", [2]),
    ("const t = \"app.post('/a', (q) => {\";\nok();\ndb.save(1);", []),
    ("app.post('/a', (q) => {\n  db.save(1);\n}, last);", []),
    ("app.post('/a', (q) => {\n  f(q.b, 2);\n  db.save([1, { a: 2 }]);\n});", [1]),
    ("app.post('/a', (q) => {\n  db.save(1);", [1]),
    (")))\napp.post('/a', (q) => {\n  db.save(1);\n});\n(", [2]),
    ("app.post('/a', (q) => {\n});\ndb.save(1); req.user;", []),
    ("app.delete('/a', (q) => {\n  r.delete('/b', (p) => { p.insert(1); });\n});", [2])])
def test_nested_handlers(files_of, text, bad):
    assert lines(files_of, text) == bad


def test_order_of_nested_handlers(spark):
    text = f"app.post('/out', (req, res) => {{\n{INNER}{SAFE}  db.update(2);\n}});"
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"{handlers('t')} AS h").first()
    assert [(c.k, c.line, c.at, c.writes, c.guarded) for c in row.h] == [
        (0, 1, 0, True, False), (1, 2, 2, True, False), (2, 5, 2, True, True)]


def test_a_large_file_of_many_handlers(files_of):
    text = "".join(SAFE if i % 2 else INNER for i in range(600))
    assert len(lines(files_of, text)) == 300


WORKFLOW = """\
# permissions: write-all
name: "ci: all"   # a comment
'on': { push: main, "pull_request": 'x y' }
env: &defaults
  A: 1
  url: http://host/#frag
jobs:
  build:
    permissions: write-all
    steps:
      - uses: actions/checkout@v4
      - run: |
          permissions: write-all
          echo done

        name: after
      - plain
    needs:
      deep
tail: !!str end
---
second: doc
"""


def test_entries_of_a_workflow(spark):
    df = spark.createDataFrame([(WORKFLOW,)], "t string").selectExpr(f"{entries('t')} AS e")
    assert [(e.path, e.value, e.line) for e in df.first().e] == [
        ("name", "ci: all", 2), ("on.push", "main", 3), ("on.pull_request", "x y", 3),
        ("env.A", "1", 5), ("env.url", "http://host/#frag", 6),
        ("jobs.build.permissions", "write-all", 9),
        ("jobs.build.steps.[].uses", "actions/checkout@v4", 11),
        ("jobs.build.steps.[].name", "after", 16), ("jobs.build.steps.[]", "plain", 17),
        ("jobs.build.needs", "deep", 19), ("tail", "end", 20), ("second", "doc", 22)]


@pytest.mark.parametrize("text, bad", [
    ("permissions: write-all", True), ("name: x\r\npermissions: write-all\r\njobs:", True),
    ('"permissions": "write-all" # all', True), ("permissions : 'write-all'", True),
    ("permissions:\n  write-all\njobs: x", True), ("permissions: # all\n\n  write-all", True),
    ("{permissions: write-all, on: push}", True), ("{on: push, 'permissions': write-all}", True),
    ("permissions: &p write-all", True), ("permissions: write-all-not", False),
    ("permissions: read-all # write-all", False), ("jobs:\n  a:\n    permissions: write-all", False),
    ("x: |\n  permissions: write-all", False), ("permissions: { contents: write-all }", False),
    ("# permissions: write-all", False), ("- permissions: write-all", False),
    ("x: 'permissions: write-all'", False), ("permissions:write-all", False),
    ("permissions:\nwrite-all: x", False), ("x: >\n\n  a\n  permissions: write-all\ny: 1", False)])
def test_permissions_of_the_whole_workflow(files_of, text, bad):
    found = audit(files_of({".github/workflows/a.yml": text}), ["iac"])
    assert [r.rule_id for r in found.collect()] == (["gha_write_all"] if bad else [])


def test_the_twin_reads_the_same(files_of):
    import duckdb
    from warpsift.plans.oracle import _WRITE_ALL, q
    cases = test_permissions_of_the_whole_workflow.pytestmark[0].args[1]
    for text, bad in cases:
        got = duckdb.execute(f"SELECT regexp_matches(?, {q(_WRITE_ALL)})", [text]).fetchall()
        assert got == [(bad,)], text
