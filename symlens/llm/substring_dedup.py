"""Substring dedup by level-wise doubling of repeated windows.

The aim are windows of ``width`` words that also start earlier in the corpus.
The first level looks at windows of half that length. Each full window has one
least half window by hash, so only those need looking at (about a sixth of all),
and a full window can repeat only if its least half window does. Half windows
that occur once alone are dropped there; the survivors are extended to twice the
length, and the earliest occurrence of each is found.

Rows are dealt to buckets of a few megabytes of text by one exchange that all
levels read again. A bucket sends each hash once, with its own first place, so
that a passage in a third of all documents sends a row a bucket and not a row a
document; hashes travel packed in binary columns, some 20 bytes a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import id_value, rows_of

U64 = np.uint64
#: Odd multipliers of the two window hashes.
MULTIPLIERS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """Word to 64-bit hash, for one bucket."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _window_hashes(words: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """A hash of the ``width`` words from each place on."""
    n = max(0, len(words) - width + 1)
    acc = np.full(n, width, U64)
    for j in range(width):
        acc ^= words[j : j + n]
        acc *= multiplier
        acc ^= acc >> U64(31)
    return acc


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` values from each place on, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = pick(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Bucket:
    """The documents of one bucket in order, as one array of word hashes."""

    def __init__(self, table: pa.Table, width: int):
        keys, prints = table["key"].to_numpy(), table["fp"].to_numpy()
        self.order, self.width, self.half = np.lexsort((prints, keys)), width, max(1, width // 2)
        self.keys, self.prints, bodies, memo, parts = keys[self.order], prints[self.order], table["body"], _Hashes(), []
        for i in self.order:
            words = bodies[int(i)].as_py().split()
            parts.append(np.fromiter(map(memo.__getitem__, words), U64, len(words)))
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(self.lengths)
        self.words = np.concatenate([*parts, np.zeros(0, U64)])
        self.doc = np.repeat(np.arange(len(parts)), self.lengths)
        n = max(0, len(self.words) - width + 1)
        self.valid = np.arange(n) + width <= self.ends[self.doc[:n]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The least half-window hash of each window, and those hashes once for each place they are taken from."""
        halves, reach = _window_hashes(self.words, self.half, MULTIPLIERS[0]), self.width - self.half + 1
        if not len(self.valid):
            return np.zeros(0, U64), np.zeros(0, U64)
        least = _sliding(halves, reach, np.minimum)
        shown = np.where(self.valid, least, U64(0))
        pad = np.zeros(reach - 1, U64)
        most = _sliding(np.concatenate([pad, shown, pad]), reach, np.maximum)
        return least, halves[most == halves]

    def windows(self, k: int = 0) -> np.ndarray:
        return _window_hashes(self.words, self.width, MULTIPLIERS[k])

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows whose least half window is in ``repeated`` or occurs twice here."""
        least, taken = self.anchors()
        taken = np.sort(taken)
        twice = taken[1:][taken[1:] == taken[:-1]]
        known = np.unique(np.concatenate([repeated, twice]))
        return np.flatnonzero(self.valid & np.isin(least, known))


def _pack(hashed: np.ndarray, n_parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Columns cut by the part of their hash, as bytes; rows keep their order within a part.

    Parts without a hash have no row, so that there are never more rows than hashes.
    """
    part = (hashed % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    held, starts = np.unique(part[order], return_index=True)
    for p, at in zip(held.tolist(), np.split(order, starts[1:]), strict=False):
        yield p, [c[at].tobytes() for c in columns]


def _unpack(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([*(np.frombuffer(x.as_py(), kind) for x in column), np.zeros(0, kind)])


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, bucket_bytes: int = 6 << 20, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_removed, spans, kept_text, kept_sha256).

    A word goes if it is covered by a window of ``width`` words whose sequence
    also starts earlier: in a document of smaller id, or earlier in the same
    one. Windows are judged on the input. ``spans`` are [start, end) in words.
    A null or empty text has no words. Null ids order first and stay null; rows
    of one id are documents of their own, in order of a hash of their text, and
    of equal rows one is the first. An empty table gives no rows. With ``texts``
    off, ``kept_text`` is null. Other columns are ignored.
    """
    rows = rows_of(docs, id_col, text_col).withColumn("fp", F.xxhash64("body"))
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    n_docs = max(1, -(-total // bucket_bytes))
    n_parts = max(1, n_docs // 4)
    # by id and text, so that many rows of one id, or of none, don't meet in one bucket
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "fp"), F.lit(n_docs)).cast("int"))

    def halves(table: pa.Table) -> pa.Table:
        taken = np.unique(Bucket(table, width).anchors()[1])
        got = list(_pack(taken, n_parts, taken))
        return pa.table({"part": pa.array([p for p, _ in got], pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(got), pa.int32()), "hashes": pa.array([c[0] for _, c in got], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        """To each bucket the half windows that another bucket has too."""
        h = _unpack(table["hashes"], U64)
        ordered = np.sort(h)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        out = [np.frombuffer(x.as_py(), U64) for x in table["hashes"]]
        return pa.table({"bucket": table["bucket"], "hashes": pa.array([x[np.isin(x, twice)].tobytes() for x in out], pa.binary())})

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"part": [], "bucket": [], "h": [], "h2": [], "key": [], "fp": [], "pos": []}
        if left.num_rows:
            b = Bucket(left, width)
            at = b.candidates(_unpack(right["hashes"], U64))
            h = b.windows()[at]
            h, first = np.unique(h, return_index=True)
            at = at[first]
            order = np.argsort(at)
            at, h = at[order], h[order]
            doc = b.doc[at]
            pos = (at - (b.ends - b.lengths)[doc]).astype(np.int32)
            for p, c in _pack(h, n_parts, h, b.windows(1)[at], b.keys[doc], b.prints[doc], pos):
                for name, x in zip(empty, [p, left["bucket"][0].as_py(), *c], strict=True):
                    empty[name].append(x)
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table({n: pa.array(x, k) for (n, x), k in zip(empty.items(), kinds, strict=True)})

    def later(table: pa.Table) -> pa.Table:
        """To each bucket the windows that start earlier in another one."""
        sizes = np.array([len(x.as_py()) // 8 for x in table["h"]])
        h, h2, key, fp, pos = (_unpack(table[c], k) for c, k in (("h", U64), ("h2", U64), ("key", np.int64), ("fp", np.int64), ("pos", np.int32)))
        bucket = np.repeat(table["bucket"].to_numpy(), sizes)
        order = np.lexsort((pos, fp, key, h2, h))
        h, h2, bucket = h[order], h2[order], bucket[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (h2[1:] == h2[:-1])
        h, bucket = h[again], bucket[again]
        order = np.argsort(bucket, kind="stable")
        ids, starts = np.unique(bucket[order], return_index=True)
        return pa.table({"bucket": pa.array(ids, pa.int32()), "hashes": pa.array([x.tobytes() for x in np.split(h[order], starts[1:])] if len(ids) else [], pa.binary())})

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in _OUT]
        if left.num_rows:
            b = Bucket(left, width)
            h, gone = b.windows(), np.zeros(len(b.words) + 1, np.int64)
            at = np.flatnonzero(b.valid)
            order = at[np.argsort(h[at], kind="stable")]
            again = order[1:][h[order[1:]] == h[order[:-1]]]
            known = _unpack(right["hashes"], U64)
            marks = np.union1d(again, at[np.isin(h[at], known)]) if len(known) else again
            np.add.at(gone, marks, 1)
            np.add.at(gone, marks + width, -1)
            flags = np.cumsum(gone)[:-1] > 0
            for i, row in enumerate(b.order):
                words, f = left["body"][int(row)].as_py().split(), flags[b.ends[i] - b.lengths[i] : b.ends[i]]
                n = int(f.sum())
                kept = b" ".join(compress(words, (~f).tolist()) if n else words)
                values = (int(b.keys[i]), len(words), n, _spans(f) if n else [], kept.decode("utf-8", "replace") if texts else None, hashlib.sha256(kept).hexdigest())
                for column, x in zip(out, values, strict=True):
                    column.append(x)
        return pa.table([pa.array(c, k.type) for c, k in zip(out, _OUT, strict=True)], schema=_OUT)

    groups = dealt.groupBy("bucket")
    asked = groups.applyInArrow(halves, "part int, bucket int, hashes binary")
    known = asked.groupBy("part").applyInArrow(shared, "bucket int, hashes binary")
    wide = groups.cogroup(known.groupBy("bucket")).applyInArrow(extended, "part int, bucket int, h binary, h2 binary, key binary, fp binary, pos binary")
    again = wide.groupBy("part").applyInArrow(later, "bucket int, hashes binary")
    out = groups.cogroup(again.groupBy("bucket")).applyInArrow(removed, "key long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string, kept_sha256 string")
    return out.select(id_value(F.col("key")).alias("doc_id"), "n_words", "n_removed", "spans", "kept_text", "kept_sha256")


_OUT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
