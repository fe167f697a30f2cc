"""Version ranges against a plain evaluator, overlaps against all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from warpsift.functions.ranges import intervals
from warpsift.operators import deps
from warpsift.operators.intervals import overlaps

VERSIONS = [f"{a}.{b}.{c}{p}" for a, b, c in itertools.product((0, 1, 2, 3, 10), (0, 1, 2, 9),
                                                               (0, 1, 3))
            for p in ("", "-alpha", "-alpha.1", "-alpha.beta", "-beta.2", "-beta.11", "-1", "-1.x")]


def order(version):
    """A version as a sortable value."""
    core, _, pre = version.partition("-")
    ids = [(0, int(i), "") if i.isdigit() else (1, 0, i) for i in pre.split(".")] if pre else []
    return (*map(int, core.split(".")), not pre, ids)


def below(version):
    """A bound below all pre-releases of a release."""
    return (*map(int, version.split(".")), False, [])


def allowed(text, v):
    """Whether a range takes a version, comparator by comparator."""
    v = order(v)
    for part in text.split("||"):
        part = re.sub(r"^\s*(\S+)\s+-\s+(\S+)\s*$", r">=\1 <=\2", part)
        part = re.sub(r"([<>=^~])\s+", r"\1", part)
        if all(one(c, v) for c in part.split()):
            return True
    return False


def one(c, v):
    op, rest = re.match(r"(>=|<=|>|<|=|\^|~>|~)?[v=]*(.*)$", c).groups()
    core, _, pre = rest.split("+")[0].partition("-")
    numbers = []
    for n in core.split("."):
        if not n.isdigit():
            break
        numbers.append(int(n))
    if not numbers:
        return op not in ("<", ">")
    full = len(numbers) == 3
    a, b, d = (numbers + [0, 0])[:3]
    point = order(f"{a}.{b}.{d}" + (f"-{pre}" if pre and full else ""))
    floor = point if pre and full else below(f"{a}.{b}.{d}")
    behind = f"{a + 1}.0.0" if len(numbers) == 1 else f"{a}.{b + 1}.0"
    if op == ">=":
        return v >= point
    if op == ">":
        return v > point if full else v >= order(behind)
    if op == "<":
        return v < floor
    if op == "<=":
        return v <= point if full else v < below(behind)
    if op in ("~", "~>"):
        return point <= v < below(behind)
    if op == "^":
        if a or len(numbers) == 1:
            behind = f"{a + 1}.0.0"
        elif b or not full:
            behind = f"0.{b + 1}.0"
        else:
            behind = f"0.0.{d + 1}"
        return point <= v < below(behind)
    return v == point if full else point <= v < below(behind)


RANGES = ["1.2.3", "v1.2.1", "=1.2.0", "==1.2.0", "^1.2.3", "^0.2.1", "^0.0.3", "^0.0", "^0", "^1.x",
          "~1.2.1", "~1.2", "~1", "~>2.1", "1.x", "1.2.x", "1.2.*", "1", "*", "", "x", ">=1.2.0",
          ">1.2.0", ">1.2", ">1", "<2.0.0", "<2", "<=1.2.1", "<=1.2", "<=1", ">=1.0.0 <2.1.0",
          ">= 1.0.0  < 2.1.0", "1.0.0 - 2.1.0", "1.0 - 2.1", "1 - 2", "^1.0.0 || ^3.0.0",
          "1.x||>=2.1.0 <3 || 10.0.0", "^1.0.0 || >=1.5 <3.0.0", "1.2.0-alpha", "^1.2.0-alpha.1",
          ">=1.0.0-beta.2 <1.0.0", "<1.0.0-beta.11", ">1.0.0-1", "~1.2.0-beta.2", ">2 <1", "<0.0.0",
          "10.9.3+build.5", ">*", "<x", "1.2.x-beta", "3.0.0 || 3.0.0", "<=1.0.0-alpha"]
NO_RANGES = ["latest", "next", "file:../x", "git+ssh://host/x", "1.2.3.4", "1..2", "a.b.c", ">=",
             "^1.0.0 || latest", "http://x/y.tgz", "1.2.3 - ", "workspace:*", "1.0.0 beta", None]


def test_intervals_equal_the_plain_evaluator(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(RANGES)], "i int, t string") \
        .selectExpr("i", f"{intervals('t')} AS spans")
    points = spark.createDataFrame([(v,) for v in VERSIONS], "v string").selectExpr(
        "v", f"{intervals('v')}[0].lo AS k")
    keys = {r.v: r.k for r in points.collect()}
    assert sorted(VERSIONS, key=keys.get) == sorted(VERSIONS, key=order)
    for r in df.collect():
        spans = [(s.lo, s.hi) for s in r.spans]
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        got = {v for v in VERSIONS if any(lo <= keys[v] < hi for lo, hi in spans)}
        want = {v for v in VERSIONS if allowed(RANGES[r.i] or "*", v)}
        assert got == want, (RANGES[r.i], sorted(got ^ want)[:5])


def test_what_is_no_range_is_null(spark):
    df = spark.createDataFrame([(t,) for t in NO_RANGES], "t string")
    assert [r[0] for r in df.selectExpr(intervals("t")).collect()] == [None] * (len(NO_RANGES) - 1) \
        + [None]


@pytest.mark.parametrize("seed, hot", [(1, 40), (2, 400)])
def test_overlaps_equal_all_pairs(spark, seed, hot):
    rng = random.Random(seed)

    def side(n, name):
        rows = []
        for i in range(n):
            lo = rng.randrange(60)
            key = "hot" if i < hot else rng.choice(["a", "b", None])
            rows.append((key, lo, lo + rng.choice([0, 1, 2, 5, 80, -3]), i))
        rows.append(("a", None, 3, n))
        return rows, spark.createDataFrame(rows, f"k string, lo bigint, hi bigint, {name} int")

    (a, left), (b, right) = side(hot + 60, "x"), side(hot + 70, "y")
    got = [tuple(r) for r in overlaps(left, right, ["k"]).select("k", "x", "y").collect()]
    want = [(p[0], p[3], s[3]) for p in a for s in b
            if p[0] is not None and p[0] == s[0] and None not in (p[1], s[1])
            and p[1] < p[2] and s[1] < s[2] and p[1] < s[2] and s[1] < p[2]]
    assert sorted(got) == sorted(want)


def test_the_join_makes_no_row_too_many(spark):
    """Thousands of advisories of one package: rows grow with the pairs that overlap."""
    n = 4000
    left = spark.range(n).selectExpr("'hot' AS k", "id * 10 AS lo", "id * 10 + 5 AS hi", "id AS x")
    right = spark.range(n).selectExpr("'hot' AS k", "id * 10 + 4 AS lo", "id * 10 + 9 AS hi",
                                      "id AS y")
    out = overlaps(left, right, ["k"])
    assert out.count() == n and out.where("x != y").count() == 0
    assert "Cartesian" not in out._jdf.queryExecution().toString()
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_plain_versions_keep_their_rows(spark, sf_dir):
    from warpsift.sources import corpus
    manifest = deps.latest_declared(corpus.raw_manifest(spark, sf_dir))
    known = corpus.advisories(spark, sf_dir)
    old = deps.known_vulnerabilities(manifest, known).select("repo_id", "package", "severity")
    new = deps.range_vulnerabilities(manifest, known)
    assert sorted(map(str, new.select(*old.columns).collect())) == sorted(map(str, old.collect()))
    assert {r[0] for r in new.select("exposure").distinct().collect()} == {"all"}


def test_exposure(spark):
    manifest = spark.createDataFrame(
        [(r, "p", v) for r in range(3) for v in ("^1.2.0", "1.2.0 || 1.3.0", "latest", "~2.0.0")]
        + [(9, "other", "1.0.0"), (9, None, "1.0.0"), (9, "p", None)],
        "repo_id bigint, package string, version string")
    advisories = spark.createDataFrame(
        [("p", "critical", "1.1.0", "1.5.0"), ("p", "low", "2.0.0", None), ("q", "low", "0", "9"),
         ("p", "high", "bad", "2.0.0")],
        "package string, severity string, introduced string, fixed string")
    got = deps.range_vulnerabilities(manifest, advisories)
    assert {(r.version, r.introduced, r.fixed, r.exposure) for r in got.collect()} == {
        ("^1.2.0", "1.1.0", "1.5.0", "some"), ("1.2.0 || 1.3.0", "1.1.0", "1.5.0", "all"),
        ("~2.0.0", "2.0.0", None, "all")}
    assert got.count() == 9
