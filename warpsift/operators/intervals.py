"""Pairs of overlapping intervals, found by equal keys.

A plain join on the group followed by a comparison costs the product of both sides' rows in a
group. Here the ends of all intervals of a group are numbered in order, and an interval becomes
the few nodes of a binary tree over those numbers that cover it. Two intervals overlap exactly if
the start of one lies in the other; a start lies in an interval exactly if one of the nodes above
it is one of the interval's. So both sides grow by the logarithm of the group, and the join makes
one row for each pair that overlaps, and no others.

Groups with a few intervals on the right need no tree: there each left row meets those few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .joins import lookup_join

#: So many intervals of the right side in a group are compared one by one.
FEW = 8
_NODES = """flatten(transform(sequence(0, _levels), l -> array_compact(array(
    CASE WHEN shiftright({a} + shiftleft(1L, l) - 1, l) < shiftright({b}, l)
          AND shiftright({a} + shiftleft(1L, l) - 1, l) % 2 = 1
         THEN named_struct('level', l, 'node', shiftright({a} + shiftleft(1L, l) - 1, l)) END,
    CASE WHEN shiftright({a} + shiftleft(1L, l) - 1, l) < shiftright({b}, l)
          AND shiftright({b}, l) % 2 = 1
         THEN named_struct('level', l, 'node', shiftright({b}, l) - 1) END))))"""
_ABOVE = "transform(sequence(0, _levels), l -> named_struct('level', l, 'node', shiftright(_a, l)))"


def _numbered(side: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
    first = ends.select(*on, F.col("_end").alias("lo"), F.col("_at").alias("_a"), "_levels")
    last = ends.select(*on, F.col("_end").alias("hi"), F.col("_at").alias("_b"))
    return side.join(first, [*on, "lo"]).join(last, [*on, "hi"])


def overlaps(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of the same group whose intervals [lo, hi) overlap.

    Both sides are read more than once, so give them in stored form if they are costly.

    The result has the columns of `left`, and those of `right` with `lo` and `hi` named
    `other_lo` and `other_hi`; other names must differ. Empty intervals overlap nothing, rows
    without a group or an end go. Ends are compared as they are (numbers, texts).
    """
    left, right = (s.where(" AND ".join([f"`{k}` IS NOT NULL" for k in on] + ["lo < hi"]))
                   for s in (left, right))
    groups = right.groupBy(*on).agg(F.count("*").alias("_n"))
    least, most = groups.agg(F.min("_n"), F.max("_n")).first()
    if not most or most <= FEW:
        return _one_by_one(left, right, on)
    if least > FEW:
        return _by_tree(left, right, on)
    crowded = groups.where(F.col("_n") > FEW).select(*on)
    few = [lookup_join(s, crowded, on, "left_anti") for s in (left, right)]
    many = [lookup_join(s, crowded, on, "left_semi") for s in (left, right)]
    return _one_by_one(*few, on).unionByName(_by_tree(*many, on))


def _one_by_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    others = right.withColumnsRenamed({"lo": "other_lo", "hi": "other_hi"})
    met = lookup_join(left, others, on).where("lo < other_hi AND other_lo < hi")
    return met.select(*left.columns, *[c for c in others.columns if c not in on])


def _by_tree(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    both = left.select(*on, "lo", "hi").unionByName(right.select(*on, "lo", "hi"))
    place = Window.partitionBy(*on)
    ends = both.select(*on, F.explode(F.array("lo", "hi")).alias("_end")).distinct().select(
        "*", (F.row_number().over(place.orderBy("_end")) - 1).cast("long").alias("_at"),
        F.ceil(F.log2(F.count("*").over(place) + F.lit(1))).cast("int").alias("_levels"))
    mine, others = _numbered(left, ends, on), _numbered(right, ends, on)
    others = others.withColumnsRenamed({"lo": "other_lo", "hi": "other_hi"})
    names = [*left.columns, *[c for c in others.columns if c not in (*on, "_a", "_b", "_levels")]]

    def meet(intervals, starts, begin):
        nodes = intervals.select("*", F.explode(F.expr(_NODES.format(a=begin, b="_b"))).alias("_n"))
        points = starts.select("*", F.explode(F.expr(_ABOVE)).alias("_n"))
        nodes, points = (s.select("*", F.col("_n.level").alias("_tree_level"), F.col("_n.node").alias(
            "_tree_node")).drop("_a", "_b", "_levels", "_n") for s in (nodes, points))
        return nodes.join(points, [*on, "_tree_level", "_tree_node"]).select(*names)

    # Starts of the right side in intervals of the left, then the left's strictly behind the
    # right's: a pair that starts together comes out once.
    return meet(mine, others, "_a").unionByName(meet(others, mine, "(_a + 1)"))
