"""Connected components by alternating large and small stars.

The edges of each partition first become one star a component found in that
partition, which loses no connection and leaves fewer edges than nodes there.
Each round is a grouped minimum and a join over the edges; rounds are written to
the shared folder, so that a lost executor doesn't restart the chain. The number
of rounds grows with the logarithm of the largest component. Neither links nor
components reach the driver: it sees one count and one checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import materialize


#: Nodes whose stars a task holds at a time; bounds a worker's memory.
FOREST_NODES = 500_000


def _forest(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: stars around the least node of what is connected within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            pairs = [(r, x) for x in up if (r := top(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for b in batches:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = top(a), top(c)
                if a != c:
                    up[max(a, c)] = min(a, c)
            if len(up) >= FOREST_NODES:
                yield stars()
                up.clear()
        yield stars()

    return edges.select("src", "dst").mapInArrow(run, "src long, dst long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour."""
    near = _both(edges)
    # a table of its own, so that the edges of a node with very many can be split
    least = materialize(near.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), "components-least")
    return near.join(least, "src").filter("dst > src").select(F.col("m").alias("src"), "dst").filter("src <> dst").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = materialize(down.groupBy("src").agg(F.min("dst").alias("m")), "components-less")
    joined = down.join(least, "src").select("m", F.col("dst").alias("node"))
    out = joined.union(least.select("m", F.col("src").alias("node")))
    return out.filter("m <> node").select(F.col("m").alias("src"), F.col("node").alias("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for each node of ``edges`` (src, dst)."""
    now, seen = materialize(_forest(edges.filter("src <> dst")), "components"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen, now = mark, materialize(_small(materialize(_large(now), "components-large")), "components")
    roots = now.select(F.col("dst").alias("node"), F.col("src").alias("root"))
    return roots.union(now.select("src").distinct().select(F.col("src").alias("node"), F.col("src").alias("root"))).distinct()
