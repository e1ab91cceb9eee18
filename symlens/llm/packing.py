"""Cost-balanced packing of documents into sequences of bounded length.

A piece costs ``linear`` a token and, as attention does, the square of its length
besides. Documents are encoded once into a written table and dealt at random to
groups of a bounded number of tokens, so that each group has the mix of the
whole and fits a task. In a group, pieces in descending order of cost each go to
the sequence of lowest cost that still has room for the whole piece. Only where
none has, the piece is cut to fill the cheapest one. The sequences of a group
hold exactly its tokens: as many full ones as there are, and the rest as powers
of two, so that nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlens.llm.bpe import USUAL, byte_table
from symlens.llm.work import id_value, materialize, rows_of

#: Tokens of a group of sequences, on average; bounds a task's memory.
GROUP_TOKENS = 1 << 19
#: Cost of a token beside that of attention: six times the width of a model with 1024 channels.
LINEAR = 6 * 1024
#: Documents encoded at a time; bounds a worker's memory.
BATCH_ROWS = 256


class FileBPE:
    """Encoder for a byte-level BPE in the tokenizers library's own file; special tokens in a text are ordinary text.

    A vocabulary determines its merges if its ids follow their order and the
    library gives every token for its own bytes: two tokens that make up a third
    then never meet, but by the listed merge. The byte-pair code of rank files
    then gives the library's ids in a quarter of the time, and is used where a file
    passes that test. Others are encoded by the library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        self.n_ids = own.get_vocab_size()
        self.library = self.encode = lambda text: own.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True):
            vocab, merges = model["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
            made = [vocab["".join(m)] for m in merges]
            if made == sorted(made) and all([t.id for t in own.model.tokenize(shown)] == [i] for shown, i in vocab.items()):
                back = {c: b for b, c in enumerate(byte_table())}
                ranks = {bytes(map(back.__getitem__, shown)): i for shown, i in vocab.items()}
                self.encode = tiktoken.Encoding("file", pat_str=USUAL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def encoder(path: str) -> FileBPE:
    """One encoder a worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return FileBPE(path)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, width, ids): each document's ids and ``end_id`` as little-endian integers of ``width`` bytes, two where all ids fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        width = 2 if max(e.n_ids, end_id) < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        for b in batches:
            for at in range(0, len(b), BATCH_ROWS):
                part = b.slice(at, BATCH_ROWS)
                ids = [array("i", e.encode(t.as_py().decode("utf-8", "replace"))) for t in part.column(1)]
                body = [np.frombuffer(x, np.int32).astype(f"<u{width}").tobytes() + end for x in ids]
                n = pa.array([len(x) + 1 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array([width] * len(ids), pa.int32()), pa.array(body, pa.binary())], ["key", "n", "width", "ids"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "key long, n long, width int, ids binary")


def sequence_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly ``tokens``: full ones, and powers of two."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: Sequence[int], capacity: int, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths.

    Documents of more than ``capacity`` give whole sequences first. Of equal
    costs the earlier document, piece and sequence come first.
    """
    out: list[tuple[int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # longest, so costliest, first
    used = 0
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        for start in range(0, whole, capacity):
            out.append((d, start, capacity, used, 0))
            used += 1
        if n > whole:
            waiting.append((whole - n, d, whole))
    heapq.heapify(waiting)
    sizes = sequence_lengths(-sum(w[0] for w in waiting), capacity)
    room, cost = list(sizes), [0] * len(sizes)
    able = [(0, s) for s in range(len(sizes))]  # may have room for the piece at hand
    narrow: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room, less than the piece at hand
    cheap: list[tuple[int, int]] = []  # the narrow ones by cost, with entries that no longer hold
    level = capacity
    while waiting:
        minus, d, start = heapq.heappop(waiting)
        n = -minus
        for r in range(min(level, capacity), n - 1, -1):  # pieces get shorter: what was too narrow may do now
            for s in narrow[r]:
                heapq.heappush(able, (cost[s], s))
            narrow[r] = []
        level = n - 1
        while able and room[able[0][1]] < n:
            _, s = heapq.heappop(able)
            if room[s]:
                narrow[room[s]].append(s)
                heapq.heappush(cheap, (cost[s], s))
        if able:
            s, take = able[0][1], n
        else:
            while (c := cheap[0])[0] != cost[c[1]] or not 0 < room[c[1]] < n:
                heapq.heappop(cheap)
            s = heapq.heappop(cheap)[1]
            narrow[room[s]].remove(s)
            take = room[s]
            heapq.heappush(waiting, (take - n, d, start + take))
        out.append((d, start, take, used + s, sizes[s] - room[s]))
        room[s] -= take
        cost[s] += linear * take + take * take
        if able and able[0][1] == s:
            heapq.heapreplace(able, (cost[s], s))
    return out


PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, linear: int = LINEAR, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids (array, null with ``ids`` off).

    ``tokenizer`` is a file of the tokenizers library that every executor can
    read. Each document's tokens end with ``end_id``, so a null or empty text is
    one token. Rows that share an id are documents of their own; a null id stays
    null. An empty table gives no rows. Other columns are ignored, whatever
    their names. A document longer than a group makes its group that much
    longer. ``ids_crc32`` is taken of little-endian unsigned 32-bit ids.
    """
    table = materialize(token_table(docs, tokenizer, end_id, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id()), "packing-tokens")
    tokens = table.agg(F.sum("n")).first()[0] or 0
    n_groups = max(1, round(tokens / group_tokens))
    dealt = table.withColumn("grp", F.pmod(F.xxhash64("row_no"), F.lit(n_groups)))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("key", "ascending"), ("row_no", "ascending")])
        widths, rows = group["width"].to_pylist(), group["ids"].to_pylist()
        pieces = sorted(pack(group["n"].to_pylist(), capacity, linear))
        first = group["grp"][0].as_py() << 32
        own, crc, body = -1, [], []
        for d, start, n, _, _ in pieces:
            if d != own:
                own, data = d, memoryview(np.frombuffer(rows[d], f"<u{widths[d]}").astype("<u4")).cast("B")
                rows[d] = None
            cut = data[4 * start : 4 * (start + n)]
            crc.append(zlib.crc32(cut))
            body.append(bytes(cut) if ids else None)
        d, start, length, seq, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        columns = [group["key"].combine_chunks().take(pa.array(d)), start, length, pa.array(crc, pa.int64()), group["n"].combine_chunks().take(pa.array(d)), first + seq, offset, pa.array(body, pa.binary())]
        return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    out = dealt.groupBy("grp").applyInArrow(run, PIECES)
    return out.select(id_value(F.col("key")).alias("doc_id"), *[c.split()[0] for c in PIECES.split(", ")[1:]])


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids, lengths): whole sequences, their pieces in order.

    A group is one sequence, bounded by the capacity. A null id stands in
    ``doc_ids`` as null.
    """
    part = F.struct("offset", "length", "doc_id", "ids")
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(part)).alias("parts"))
    bodies = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return held.select("sequence_id", "length", bodies.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
