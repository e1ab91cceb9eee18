"""Ranked lexical search: document-at-a-time over compressed postings of shards.

Each task cuts its documents into shards of bounded size and writes, without a
shuffle, one row for each term of a shard: the documents that hold it, in order
of their ids, as gaps and counts in variable-length bytes. A search joins the
queries' terms with these rows, so that only postings that are asked for move,
and meets the terms of a shard and of a block of queries in one task. There a
heap of one cursor a term yields the documents in order; each is scored as a whole
and offered to a heap of the k best, ordered by score and then id. Terms that
together can't lift a document into that heap give up their cursors, and are
looked up only for documents that the others yield. The k best of each shard are
merged by one ranking.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symlens.llm.work import id_key, id_value, materialize, rows_of, text_bytes

#: Bytes of text of a shard, at least one document; bounds what a task holds.
SHARD_BYTES = 1 << 24
#: Queries that meet a shard together, on average.
BLOCK_QUERIES = 512
#: Rows of the index in one Arrow batch.
OUT_ROWS = 1 << 15
#: Tasks that shards and blocks are dealt to at most; more of them share tasks.
MAX_TASKS = 20_000
INDEX = "shard long, term binary, n long, total long, body binary"
#: A-Z become small, what stands between terms becomes a space.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(body: bytes) -> list[bytes]:
    """The terms of a text in their order: runs of ASCII letters, digits and characters beyond ASCII."""
    return body.translate(FOLD).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned integers in bytes of seven bits, the lowest first; the bytes, and how many each value takes."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at, out = np.cumsum(size) - size, np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        left = values[more] >> np.uint64(7 * k)
        out[at[more] + k] = (left & np.uint64(0x7F)) | np.where(size[more] > k + 1, 0x80, 0).astype(np.uint64)
    return out, size


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    """The inverse of :func:`packed`."""
    data = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(data < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        at = starts + k
        more = at <= ends
        out[more] |= (data[at[more]] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shard_rows(shard: int, keys: list[int], bodies: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents under an empty term, then a row for each term in order.

    ``n`` is how many documents have a term, ``total`` how many terms they have.
    ``body`` holds the documents' keys and lengths, or a term's gaps between
    documents (by their place in the shard) and its counts in them.
    """
    names = [c.split()[0] for c in INDEX.split(", ")]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    folded = [bodies[i].translate(FOLD).strip() for i in order]
    held = [k for k, body in enumerate(folded) if body]
    lists = pc.ascii_split_whitespace(pa.array([folded[k] for k in held], pa.binary()).cast(pa.large_string()))
    del folded
    lengths = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    terms, n_docs = words.dictionary, len(held)
    by_name = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(terms), np.int64)
    place[by_name] = np.arange(len(terms))
    pairs, counts = np.unique(place[words.indices.to_numpy()] * max(1, n_docs) + np.repeat(np.arange(n_docs), lengths), return_counts=True)
    del words, lists
    term, doc = np.divmod(pairs, max(1, n_docs))
    n = np.bincount(term, minlength=len(terms))
    first = np.cumsum(n) - n
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    slots = np.arange(len(pairs)) + np.repeat(first, n)  # a term's gaps stand before its counts
    values = np.empty(2 * len(pairs), np.int64)
    values[slots], values[slots + np.repeat(n, n)] = gaps, counts
    data, size = packed(values)
    ends = np.cumsum(size)[np.cumsum(2 * n) - 1] if len(n) else np.zeros(0, np.int64)
    sorted_keys = np.array(keys, np.int64)[order][held].view(np.uint64)
    docs = packed(np.concatenate([np.diff(sorted_keys, prepend=np.uint64(0)), lengths.astype(np.uint64)]))[0].tobytes()
    meta = [[shard], [b""], [n_docs], [int(lengths.sum())], [docs]]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(meta, kinds, strict=True)], names)
    totals = np.add.reduceat(counts, first) if len(n) else n
    terms = terms.take(pa.array(by_name))
    for at in range(0, len(n), OUT_ROWS):
        to = min(at + OUT_ROWS, len(n))
        begin = int(ends[at - 1]) if at else 0
        body = _binaries(data[begin : ends[to - 1]], ends[at:to] - begin)
        yield pa.RecordBatch.from_arrays([pa.array([shard] * (to - at), pa.int64()), terms.slice(at, to - at).cast(pa.large_binary()).cast(pa.binary()), pa.array(n[at:to]), pa.array(totals[at:to]), body], names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of ``docs`` as a written table, to be searched any number of times: the columns of ``INDEX``.

    A null text has no terms, and a document without terms isn't in the index.
    Rows that share an id are documents of their own; a null id is kept. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    A shard is one task's and has at least one document; a text longer than a
    shard is a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, keys, bodies, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                body = text.as_py()
                if keys and size + len(body) > shard_bytes:
                    yield from shard_rows(shard, keys, bodies)
                    shard, keys, bodies, size = shard + 1, [], [], 0
                keys.append(key)
                bodies.append(body)
                size += len(body)
        if keys:
            yield from shard_rows(shard, keys, bodies)

    return materialize(rows_of(docs, id_col, text_col).mapInArrow(run, INDEX), "search-index")


class Cursor:
    """A term's documents and what it adds to the score of each; ``most`` is the greatest."""

    __slots__ = ("docs", "scores", "most", "at")

    def __init__(self, docs: list[int], scores: list[int]):
        self.docs, self.scores, self.most, self.at = docs, scores, max(scores, default=0), 0

    def score(self, doc: int) -> int:
        """For documents in ascending order."""
        self.at = at = bisect_left(self.docs, doc, self.at)
        return self.scores[at] if at < len(self.docs) and self.docs[at] == doc else 0


def best(terms: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k documents of the highest sums above 0, as (sum, document), best first; of equal sums the smaller document."""
    cursors = sorted((Cursor(*t) for t in terms), key=lambda c: c.most)
    limits, n = [0], len(cursors)  # what the first j terms can add
    for c in cursors:
        limits.append(limits[-1] + c.most)
    found: list[tuple[int, int]] = []  # the worst first: (sum, minus document)
    needed, passive = 0, 0  # a document must pass ``needed``; terms below ``passive`` have no cursor in the heap
    heap = [c.docs[0] * n + j for j, c in enumerate(cursors) if c.docs]
    heapq.heapify(heap)
    while heap:
        doc, total = heap[0] // n, 0
        while heap and heap[0] // n == doc:
            j = heap[0] % n
            c = cursors[j]
            total += c.scores[c.at]
            c.at += 1
            if c.at < len(c.docs):
                heapq.heapreplace(heap, c.docs[c.at] * n + j)
            else:
                heapq.heappop(heap)
        for j in range(passive - 1, -1, -1):
            if total + limits[j + 1] <= needed:
                break
            total += cursors[j].score(doc)
        if total <= needed:
            continue
        heapq.heappush(found, (total, -doc))
        if len(found) > k:
            heapq.heappop(found)
        if len(found) == k and found[0][0] > needed:
            needed, before = found[0][0], passive
            while passive < n and limits[passive + 1] <= needed:
                passive += 1
            if passive > before:
                heap = [e for e in heap if e % n >= passive]
                heapq.heapify(heap)
    return [(total, -doc) for total, doc in sorted(found, reverse=True)]


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A hundred times the share of a document's length in the score, in whole numbers."""
    if 90 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * lengths * n_docs // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in lengths], np.int64)


def _searched(n_docs: int, n_terms: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("term").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        head, rows = rows[0], rows[1:]
        if rows:
            meta = unpacked(head["body"])
            keys, lengths = np.cumsum(meta[: head["n"]], dtype=np.uint64).view(np.int64), meta[head["n"] :].astype(np.int64)
            factors = length_factors(lengths, n_docs, n_terms)
            asked: dict[tuple[int, int], list[int]] = {}
            terms = []
            for i, row in enumerate(rows):
                values = unpacked(row["body"]).astype(np.int64)
                docs, tf = np.cumsum(values[: row["n"]]), values[row["n"] :]
                terms.append((docs.tolist(), (row["weight"] * (1_000_000_000 * tf // (1000 * tf + 8 * factors[docs]))).tolist()))
                for q in row["items"]:
                    asked.setdefault((q["query_no"], q["item"]), []).append(i)
            for (no, item), at in asked.items():
                out += [(no, item, int(keys[doc]), total) for total, doc in best([terms[i] for i in at], k)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["query_no", "item", "key", "score"])

    return run


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_no, item, term): the distinct terms of each row of ``queries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(no, item, t) for no, item, body in zip(*map(pa.Array.to_pylist, b.columns), strict=True) for t in sorted(set(terms_of(body)))]
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, kinds, strict=True)], ["query_no", "item", "term"])

    picked = queries.select(F.monotonically_increasing_id().alias("query_no"), id_key(id_col).alias("item"), text_bytes(text_col).alias("body"))
    return picked.mapInArrow(run, "query_no long, item long, term binary")


def ranked_search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0.

    ``index`` is the table of :func:`build_index`, or a copy of it. Equal scores are
    ranked by ascending id, a null id first; rows that share an id and a text
    are ranked one after another. Each row of ``queries`` is a query of its own;
    one without terms, or null, gives no rows. Neither queries nor postings are
    broadcast by the operator: queries are dealt to blocks, and a task meets the
    asked terms of one shard and one block.
    """
    sums = index.filter(F.length("term") == 0).agg(F.sum("n"), F.sum("total"), F.count("*")).first()
    n_docs, n_terms = int(sums[0] or 0), int(sums[1] or 0)
    asked = materialize(query_terms(queries, id_col, text_col), "search-terms")
    n_blocks = max(1, -(-(asked.agg(F.count_distinct("query_no")).first()[0]) // block_queries))
    postings = index.filter(F.length("term") > 0)
    named = asked.select("term").distinct()
    held = postings.join(materialize(named, "search-named"), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weighed = materialize(held.select("term", weight.alias("weight")), "search-weights")
    block = F.pmod(F.xxhash64("query_no"), F.lit(n_blocks)).alias("block")
    lists = asked.groupBy("term", block).agg(F.collect_list(F.struct("query_no", "item")).alias("items"))
    wanted = materialize(lists.join(weighed, "term"), "search-wanted")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")
    nothing = F.lit(None).cast("array<struct<query_no:bigint,item:bigint>>").alias("items")
    heads = index.filter(F.length("term") == 0).select("shard", blocks, "term", "n", "body", F.lit(0).cast("long").alias("weight"), nothing)
    met = postings.join(wanted, "term").select("shard", "block", "term", "n", "body", "weight", "items")
    # scoring is work beyond the size of postings, by which tasks would be made larger
    dealt = met.unionByName(heads).repartition(max(1, min(sums[2] * n_blocks, MAX_TASKS)), "shard", "block")
    local = dealt.groupBy("shard", "block").applyInArrow(_searched(n_docs, n_terms, k), "query_no long, item long, key long, score long")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "key")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(id_value(F.col("item")).alias("item_id"), "rank", id_value(F.col("key")).alias("doc_id"), "score")
