"""Mixing sources to target weights by Poisson replication.

The target repetition rate of a source is its weight's part of the total size
over the source's own size. Each document draws its count by inverting the
Poisson distribution of that mean at a uniform number hashed from seed and id, so
that any task gives the same count at any time. Copies are dealt to partitions by
a hash and sorted within them by another: a global shuffle without sampling.
Built-in expressions only; sizes are aggregated before they reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import free_name, without

#: Means above this are drawn as a sum of equal parts, which keeps exp(-mean) exact.
PART = 16.0


def poisson_steps(mean: float) -> list[float]:
    """Cumulated probabilities of 0, 1, 2, ... until they reach one in a double."""
    term, total, out, k = math.exp(-mean), 0.0, [], 0
    while k <= mean or term > 1e-18:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return out


def uniform(*parts: Column | str) -> Column:
    """52 bits of the MD5 of the parts joined by colons, as a number from 0 to below 1."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", text_col: str = "text") -> dict[str, float]:
    """Mean repetitions of each weighted source; sizes are counted in characters of text.

    The driver gets one row for each source in ``weights``. A source without any
    text has rate 0, and so has each where all weights are 0.
    """
    size = F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("size")
    rows = docs.filter(F.col(source_col).isin(*weights)).groupBy(source_col).agg(size).collect() if weights else []
    sizes = {r[0]: int(r["size"] or 0) for r in rows}
    total, whole = sum(sizes.values()), sum(weights.values())
    return {s: (w / whole * total / sizes[s] if whole and sizes.get(s) else 0.0) for s, w in weights.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, float], seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", other_rate: float = 1.0) -> DataFrame:
    """A row for each copy: the columns of ``docs`` and __copy (from 1), __rate, __order.

    Sources that ``weights`` doesn't name, null among them, have ``other_rate``.
    A null or empty text has size 0 and is drawn like others of its source. Rows
    of one id draw alike; a null id draws by the hash of its text. An empty table
    gives no rows. Columns of ``docs`` that are called like the three new ones
    give way to them.
    """
    found = rates(docs, weights, source_col, text_col)
    groups = [*found.items(), (None, other_rate)]
    parts = [max(1, math.ceil(r / PART)) for _, r in groups]
    steps = F.array(*[F.array(*map(F.lit, poisson_steps(r / n))) for (_, r), n in zip(groups, parts, strict=True)])
    known = F.array(*[F.lit(s) for s, _ in groups[:-1]]).cast("array<string>")
    group = F.array_position(known, F.col(source_col))
    at = F.when(group > 0, group - 1).otherwise(F.lit(len(groups) - 1)).cast("int")
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    columns = without(docs, "__copy", "__rate", "__order")
    at_name, own_name, parts_name, n_name = (free_name(docs.columns, c) for c in ("__at", "__own", "__parts", "__n"))
    drawn = docs.withColumns({at_name: at, own_name: own})
    at, own = F.col(at_name), F.col(own_name)
    drawn = drawn.withColumns({"__rate": F.array(*[F.lit(float(r)) for _, r in groups])[at], parts_name: F.array(*map(F.lit, parts))[at]})
    count = F.aggregate(
        F.sequence(F.lit(0), F.col(parts_name) - 1),
        F.lit(0),
        lambda total, part: total + F.size(F.filter(F.transform(F.array(uniform(str(seed), own, part.cast("string"))), lambda u: F.filter(steps[at], lambda c: c <= u))[0], lambda c: F.lit(True))),
    )
    copies = drawn.withColumn(n_name, count).filter(F.col(n_name) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col(n_name))))
    copies = copies.withColumn("__order", F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), own, F.col("__copy").cast("string"))))
    chosen = copies.select(*[F.col(f"`{c}`") for c in columns], "__copy", "__rate", "__order")
    return chosen.repartition("__order").sortWithinPartitions("__order")
