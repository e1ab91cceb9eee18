"""Filter interaction audit: what each filter removes at each step of every order.

Each document becomes a mask of the filters it fails. Masks are counted into
cells by part and label, of which a part has at most 2^n times four, whatever its
size. All orders of the filters are then visited by single swaps of neighbours
(plain changes): such a swap leaves the documents that reach the other steps as
they were, so that only the figures of the two swapped steps are taken anew from
the cells. The sum of what a filter removes over all orders, its Shapley value
times their number, accumulates along the walk.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlens.llm.work import id_key, materialize, text_bytes

UPPER = string.ascii_uppercase.encode()
#: Bytes of UTF-8 that begin no code point.
FOLLOWERS = bytes(range(0x80, 0xC0))
#: Texts are split into words by pieces of about this many bytes.
PIECE = 1 << 20
FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """When a text fails: fewer words, fewer distinct words or more capitals (in hundredths), one of the marks."""

    min_words: int = 100
    min_distinct: int = 80
    max_capitals: int = 10
    marks: bytes = b"#$%&*|"


def _word_lists(body: bytes) -> Iterator[list[bytes]]:
    """The words of ``body``, in pieces that end where one does."""
    at = 0
    while len(body) - at > PIECE:
        head, cut = body[at : at + PIECE], None
        for space in b" \t\n\x0b\x0c\r":
            cut = max(cut or 0, head.rfind(space) + 1)
        if not cut:
            break
        yield head[:cut].split()
        at += cut
    yield body[at:].split()


def text_failures(body: bytes, limits: Limits = Limits()) -> int:
    """Bits 1, 2, 4 and 8: too few words, too few distinct ones, too many capitals, a mark."""
    n, distinct = 0, set()
    for words in _word_lists(body):
        n += len(words)
        distinct.update(words)
    points = len(body.translate(None, FOLLOWERS))
    capitals = len(body) - len(body.translate(None, UPPER))
    marked = len(body.translate(None, limits.marks)) < len(body)
    return (n < limits.min_words) | (100 * len(distinct) < limits.min_distinct * n) << 1 | (100 * capitals > limits.max_capitals * points) << 2 | marked << 3


def _masked(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, halves = [], []
            for t in b.column(2):
                body = t.as_py()
                masks.append(text_failures(body, limits))
                halves.append(hashlib.blake2b(body, digest_size=16).digest())
            h = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["key", "part", "mask", "h1", "h2"])

    return run


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """(part, mask, good, toxic), one row per row of ``docs``; bit k of the mask is the k-th filter of ``FILTERS``.

    E fails where the same text stands under a smaller id, anywhere in the
    table; texts are compared by 128 bits. A null id orders first and has no
    labels, a null text counts as empty, a null part as the empty string. Rows
    that share id and text are rows of their own, and none fails for the other.
    A document is good or toxic if any of its label rows says 1. Other columns
    are ignored, whatever their names.
    """
    cells = docs.select(id_key(id_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_bytes(text_col).alias("body"))
    rows = materialize(cells.mapInArrow(_masked(limits), "key long, part string, mask int, h1 long, h2 long"), "audit-rows")
    # tables of their own let adaptive execution split a text or an id that many rows share
    copies = rows.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("h1", "h2", "least")
    flags = labels.select(F.col(id_col).cast("long").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("key is not null")
    flags = flags.groupBy("key").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    out = rows.join(materialize(copies, "audit-copies"), ["h1", "h2"], "left").select("key", "part", F.when(F.col("key") > F.col("least"), F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")).alias("mask"))
    out = out.join(materialize(flags, "audit-labels"), "key", "left")
    return out.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def plain_changes(n: int) -> Iterator[int]:
    """Places i whose swaps with i + 1, in turn, lead once through every order of n things."""
    if n < 2:
        return
    down = True
    for other in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if other is not None:
            yield other + down
        down = not down


class Cells:
    """The documents of a part, good and toxic ones besides, by the filters that they fail."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts  # all, good, toxic by mask
        self.masks = np.arange(counts.shape[1])

    def step(self, f: int, before: int) -> tuple[int, ...]:
        """(kept, removed, redundant, unique_fails, good_lost, toxic_lost) of filter ``f`` after the filters in ``before``."""
        fails, reached = self.masks >> f & 1 > 0, self.masks & before == 0
        all_, good, toxic = self.counts
        here = fails & reached
        return int(all_[reached & ~fails].sum()), int(all_[here].sum()), int(all_[fails & ~reached].sum()), int(all_[1 << f]), int(good[here].sum()), int(toxic[here].sum())

    def walk(self, n: int) -> Iterator[tuple[tuple[int, ...], list[tuple[int, ...]]]]:
        """Every order of n filters with its steps' figures; both lists change in place from order to order."""
        order, steps = list(range(n)), []
        for i in order:
            steps.append(self.step(i, (1 << i) - 1))
        yield order, steps
        for i in plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            before = sum(1 << f for f in order[:i])
            steps[i] = self.step(order[i], before)
            steps[i + 1] = self.step(order[i + 1], before | 1 << order[i])
            yield order, steps


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(failures: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """A row for each part, order of ``filters`` and step: the columns of ``OUT``.

    ``failures`` has (part, mask, good, toxic), a row a document; it is counted
    before rows move, so a part's group has as many rows as cells at most,
    however many documents stand behind them. An empty table gives no rows.
    """
    n = len(filters)
    if n > 7:
        raise ValueError(f"{n} filters have more orders than are worth reading")
    cells = failures.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros((3, 1 << n), np.int64)
        for row in table.to_pylist():
            for k, counted in enumerate((True, row["good"], row["toxic"])):
                counts[k, row["mask"]] += row["n"] * counted
        shapley, rows = [0] * n, []
        for order, steps in Cells(counts).walk(n):
            name = "".join(filters[f] for f in order)
            for k, (f, figures) in enumerate(zip(order, steps, strict=True)):
                shapley[f] += figures[1]
                rows.append((name, k + 1, *figures, f))
        columns = [*zip(*rows, strict=True)]
        columns[-1] = [shapley[f] for f in columns[-1]]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
        part = pa.array([table["part"][0].as_py()] * len(rows), pa.string())
        return pa.Table.from_arrays([part, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [c.split()[0] for c in OUT.split(", ")])

    return cells.groupBy("part").applyInArrow(run, OUT)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """:func:`audit` of :func:`document_failures`, with the odd cases that the latter states."""
    return audit(document_failures(docs, labels, id_col, text_col, part_col, limits))


def shapley_values(audited: DataFrame) -> DataFrame:
    """(part, filter, value): the mean of what a filter removes over all orders, from the rows of :func:`audit`."""
    own = F.substring("filter_order", 1, 1).alias("filter")
    first = audited.filter("step = 1").groupBy("part", own).agg(F.max("shapley").alias("total"), F.count("*").alias("n"))
    orders = F.sum("n").over(Window.partitionBy("part"))  # each order has one first filter
    return first.select("part", "filter", (F.col("total") / orders).alias("value"))
