"""Only what an advisory is about is compared, and groups of a few intervals need no tree."""

import pytest

from warpsift.operators import deps, intervals


@pytest.fixture()
def no_tree(monkeypatch):
    def refused(*args):
        raise AssertionError("a tree for a few intervals")
    monkeypatch.setattr(intervals, "_by_tree", refused, raising=False)
    monkeypatch.setattr(intervals, "_NODES", "no such expression")


def test_few_intervals_meet_one_by_one(spark, no_tree):
    left = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, 9, "y"), ("b", 0, 3, "z"),
                                  (None, 0, 3, "n"), ("a", 4, 4, "e")],
                                 "g string, lo int, hi int, name string")
    right = spark.createDataFrame([("a", 4, 6, 1), ("a", 9, 12, 2), ("b", 0, 3, 3),
                                   (None, 0, 3, 4)], "g string, lo int, hi int, n int")
    met = intervals.overlaps(left, right, ["g"])
    assert sorted((r.name, r.n) for r in met.collect()) == [("x", 1), ("y", 1), ("z", 3)]


def test_range_vulnerabilities_without_a_tree(spark, no_tree):
    manifest = spark.createDataFrame(
        [(1, "a", "^1.2.0"), (1, "a", "^1.2.0"), (2, "a", "3.x"), (3, "b", "1.0.0"),
         (None, "a", "1.4.0"), (4, None, "1.0.0")], "repo_id bigint, package string, version string")
    known = spark.createDataFrame([("a", "high", "1.0.0", "1.5.0", None, None)],
                                  "package string, severity string, introduced string, "
                                  "fixed string, cve string, advisory string")
    found = deps.range_vulnerabilities(manifest, known)
    assert sorted((r.repo_id or 0, r.version, r.exposure) for r in found.collect()) == [
        (0, "1.4.0", "all"), (1, "^1.2.0", "some")]
