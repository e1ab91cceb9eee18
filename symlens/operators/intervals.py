"""Joins of points and intervals by dyadic blocks, as equi-joins.

An interval of whole numbers is cut into the fewest blocks of the form
[b * 2^k, (b + 1) * 2^k), at most two of each size, which don't overlap. A point
lies in one block of each size, so it meets each interval around it in exactly one
block: rows after the join are results, and a hot group spreads over its blocks.
Two intervals overlap if the first begins in the second, or the second begins
after the first does and within it; never both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of its own that a join adds and drops.
LEVEL, BLOCK = "__level", "__block"


def _shifted(x: Column, level: Column) -> Column:
    """``x`` divided by 2^level, rounded down."""
    return F.call_function("shiftright", x, level)


def blocks_of(lo: Column, hi: Column, levels: int) -> Column:
    """Blocks (level, block) of [lo, hi], for lengths below 2^(levels + 1); none where hi is below lo or one is null."""

    def of(level: Column) -> Column:
        left, right = -_shifted(-lo, level), _shifted(hi + 1, level)  # what smaller blocks have left over
        cuts = F.array(F.when((left < right) & (left % 2 != 0), left), F.when((left < right) & (right % 2 != 0), right - 1))
        return F.transform(F.array_compact(cuts), lambda b: F.struct(level.alias(LEVEL), b.alias(BLOCK)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of))


def blocks_around(at: Column, levels: int) -> Column:
    """The blocks (level, block) that hold a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias(LEVEL), _shifted(at, level).alias(BLOCK)))


def levels_of(intervals: DataFrame, lo: str, hi: str) -> int:
    """The largest size of block, as a power of two, that these intervals may be cut into."""
    longest = intervals.agg(F.max(F.col(hi) - F.col(lo) + 1)).first()[0]
    return max(1, int(longest or 1)).bit_length() - 1


def contains_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """One row for each point and interval with ``lo <= at <= hi`` and equal ``on``: the columns of both.

    The two tables share the columns ``on`` alone. Bounds and points are whole
    numbers, negative ones too; a null one, a null in ``on`` and an interval that
    ends before it begins meet nothing. The length of the longest interval is
    asked for first, as it bounds the blocks around a point.
    """
    levels = levels_of(intervals, lo, hi)
    number = lambda c: F.col(c).cast("long")
    cut = intervals.filter(F.col(lo) <= F.col(hi)).select("*", F.inline(blocks_of(number(lo), number(hi), levels)))
    held = points.filter(F.col(at).isNotNull()).select("*", F.inline(blocks_around(number(at), levels)))
    # neither side may be broadcast: their sizes are guessed from files, before they are cut into blocks
    return held.hint("merge").join(cut.hint("merge"), [*on, LEVEL, BLOCK]).drop(LEVEL, BLOCK)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """One row for each pair of intervals that share a number, with equal ``on``: the columns of both, as :func:`contains_join` has it."""
    (lo, hi), (first, last) = left_bounds, right_bounds
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    begins = contains_join(left.filter(F.col(lo) <= F.col(hi)), right, on, lo, first, last)
    after = "__after"
    later = contains_join(right.filter(F.col(first) <= F.col(last)), left.withColumn(after, F.col(lo) + 1), on, first, after, hi)
    return begins.select(*columns).unionByName(later.select(*columns))
