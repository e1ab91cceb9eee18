"""Running values over long ordered groups, split into blocks.

A window over a group runs in one task. Here a group is cut into blocks along its
order. One row a block is summed up and scanned over the group; what it gives
stands at the head of the next block, and each block runs by itself. Rows are
moved once, as a plain window would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of its own that a scan adds and drops.
BLOCK, HEAD, VALUE = "__block", "__head", "__value"


def _scanned(cut: DataFrame, summary: DataFrame, keys: Sequence[str], order: Sequence[str], run) -> DataFrame:
    """``cut`` with ``run`` over each block, headed by what ``run`` says of the blocks before."""
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    heads = summary.withColumn(VALUE, run(earlier)).filter(F.col(VALUE).isNotNull()).withColumn(HEAD, F.lit(0))
    rows = cut.withColumn(HEAD, F.lit(1)).unionByName(heads, allowMissingColumns=True)
    own = Window.partitionBy(*keys, BLOCK).orderBy(HEAD, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(VALUE, run(own)).filter(F.col(HEAD) == 1)


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over a group's rows up to and with this one, as long or double.

    ``order`` names the columns of a total order, ascending, and ``block`` never
    falls along it; it decides how a group is cut and never the result. Nulls
    add nothing; null keys are a group.
    """
    kind = "long" if rows.select(F.sum(value)).dtypes[0][1] == "bigint" else "double"
    cut = rows.withColumns({BLOCK: block, VALUE: F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind))})
    summary = cut.groupBy(*keys, BLOCK).agg(F.sum(VALUE).alias(VALUE))
    return _scanned(cut, summary, keys, order, lambda w: F.sum(VALUE).over(w)).withColumn(name, F.col(VALUE)).drop(BLOCK, HEAD, VALUE)


def carried_forward(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str, name: str) -> DataFrame:
    """``rows`` and ``name``: the last ``value`` that isn't null among a group's rows up to and with this one; null if there is none.

    ``order``, ``block`` and keys are as for :func:`running_sum`.
    """
    cut = rows.withColumns({BLOCK: block, VALUE: F.col(value)})
    place = F.when(F.col(VALUE).isNotNull(), F.struct(*order))
    summary = cut.groupBy(*keys, BLOCK).agg(F.max_by(VALUE, place).alias(VALUE))
    return _scanned(cut, summary, keys, order, lambda w: F.last(VALUE, ignorenulls=True).over(w)).withColumn(name, F.col(VALUE)).drop(BLOCK, HEAD, VALUE)
