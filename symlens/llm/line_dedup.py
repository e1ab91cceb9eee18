"""Line dedup by pairwise alignment of overlapping documents.

Documents are paired that share a key few of them hold, each with every earlier
holder. Pairs are aligned by patience diff on line hashes, and aligned common
blocks of enough words are deleted from the later document. Keys are lines, or with
``runs`` the least runs of consecutive lines that reach ``min_words``, from each
line on and up to each line.

An alignment rises on both sides, so it leaves one of two blocks that cross; and a
frequent key would make too many pairs. With ``runs`` a run that an earlier
document holds therefore goes from each later holder by itself, in linear work and
however many hold it. Each line of a block of enough words lies in such a run
inside the block, so that every block of consecutive lines that an earlier document
has is deleted, and nothing else; which pairs were aligned changes nothing. With
lines alone, holders of a frequent line are aligned with its first holder. Texts
themselves are moved once, when the deletions meet them.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.llm.work import free_name, id_key, materialize, without

WHITE = r"[\x20\x09-\x0D]+"


def _unique(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the items that stand once in both lists, in the order of ``b``."""
    in_a, in_b = Counter(a), Counter(b)
    place = {x: i for i, x in enumerate(a) if in_a[x] == 1 and in_b.get(x) == 1}
    return [(place[x], j) for j, x in enumerate(b) if x in place]


def _numbered(a: list[int]) -> list[tuple[int, int]]:
    seen: Counter = Counter()
    out = []
    for x in a:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def _between(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Matches at the ends of two ranges and at anchors; the ranges still open between those.

    Anchors are lines unique in both ranges, else neighbouring lines that are so as a pair, else lines of the same
    number among those alike: while a range has a common line, it gets a match.
    """
    found, rest = [], []
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        found.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        found.append((a1, b1))
    if a0 == a1 or b0 == b1:
        return found, rest
    pairs = _unique(a[a0:a1], b[b0:b1]) or _unique(list(pairwise(a[a0:a1])), list(pairwise(b[b0:b1]))) or _unique(_numbered(a[a0:a1]), _numbered(b[b0:b1]))
    pairs = [(a0 + i, b0 + j) for i, j in pairs]
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):  # longest run that rises on both sides
        t = bisect_left(tails, i)
        back.append(tops[t - 1] if t else -1)
        tails[t : t + 1], tops[t : t + 1] = [i], [k]
    chain, k = [], tops[-1] if tops else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    if chain:
        stops = [*reversed(chain), (a1, b1)]
        i0, j0 = a0, b0
        for i, j in stops:
            rest.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        found += chain
    return found, rest


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places, rising on both sides, at which ``a`` and ``b`` agree."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        got, rest = _between(a, b, *open_.pop())
        found += got
        open_ += rest
    return sorted(found)


def common_blocks(a: list[int], b: list[int], weights: list[int], min_words: int) -> list[int]:
    """Places in ``b`` of aligned blocks, without a gap on either side, that hold ``min_words`` words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(weights[k] for k in block) >= min_words:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, gone = [], [], []
            for key, fp, a, b, w in zip(*(batch.column(c).to_pylist() for c in ("key", "fp", "before", "hashes", "words")), strict=True):
                if got := common_blocks(a, b, w, min_words):
                    keys.append(key)
                    prints.append(fp)
                    gone.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(prints, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "fp", "gone"])

    return run


def runs_of(hashes: list[int], words: list[int], min_words: int) -> dict[int, list[tuple[int, int]]]:
    """Keys of the least runs of ``min_words`` words that start or end at each line, with the places [start, end) of each; a run of one line has the line's hash."""
    packed, n = array("q", hashes).tobytes(), len(hashes)
    spans: set[tuple[int, int]] = set()
    need, held, first = max(min_words, 1), 0, 0
    for end in range(n):  # the shortest up to each line
        held += words[end]
        while held - words[first] >= need:
            held -= words[first]
            first += 1
        if held >= need:
            spans.add((first, end + 1))
    held, last = 0, n
    for start in range(n - 1, -1, -1):  # and from each line on
        held += words[start]
        while held - words[last - 1] >= need:
            last -= 1
            held -= words[last]
        if held >= need:
            spans.add((start, last))
    out: dict[int, list[tuple[int, int]]] = {}
    for i, j in spans:
        out.setdefault(hashes[i] if j == i + 1 else xxhash.xxh64_intdigest(packed[8 * i : 8 * j]) - (1 << 63), []).append((i, j))
    return out


def run_keys(hashes: list[int], words: list[int], min_words: int) -> set[int]:
    """The keys of :func:`runs_of`."""
    return set(runs_of(hashes, words, min_words))


def _run_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(h, w, min_words) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            h = pa.array([k for x in found for k in x], pa.int64())
            ends = [pa.array([[p[side] for p in places] for x in found for places in x.values()], pa.list_(pa.int32())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), h, *ends], ["key", "fp", "h", "starts", "stops"])

    return run


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 10, min_words: int = 8, runs: bool = False) -> DataFrame:
    """(key, fp, gone): places of deleted lines for each document that loses any.

    ``key`` is the id (null: the least long) and ``fp`` the hash of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.transform(_lines(text), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    rows = docs.select(id_key(id_col).alias("key"), F.xxhash64(text).alias("fp"), trimmed.alias("lines"))
    rows = rows.select("key", "fp", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, WHITE)))).alias("words"))
    nodes = materialize(rows.dropDuplicates(["key", "fp"]), "line-nodes")
    if runs:
        held = nodes.select("key", "fp", "hashes", "words").mapInArrow(_run_rows(min_words), "key long, fp long, h long, starts array<int>, stops array<int>")
    else:
        held = nodes.select("key", "fp", F.explode(F.array_distinct(F.filter(F.transform("hashes", lambda h, i: F.when(F.col("words")[i] >= 3, h)), lambda h: h.isNotNull()))).alias("h"))
    # a table of its own, so that the join starts from two exchanges and the rows of a frequent line can be split
    lines = materialize(held.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("key", "fp")).alias("first")).filter("n > 1"), "line-counts")
    shared = materialize(held.join(lines, "h"), "line-shared")
    few = shared.filter(F.col("n") <= rare).select("h", "key", "fp")
    before = few.select("h", F.col("key").alias("key0"), F.col("fp").alias("fp0"))
    later = (F.col("key0") < F.col("key")) | ((F.col("key0") == F.col("key")) & (F.col("fp0") < F.col("fp")))
    pairs = few.join(before, "h").filter(later).select("key", "fp", "key0", "fp0")
    of_first = shared.select("*", F.col("first.key").alias("key0"), F.col("first.fp").alias("fp0")).filter(later)
    if not runs:
        pairs = pairs.union(of_first.filter(F.col("n") > rare).select("key", "fp", "key0", "fp0"))
    pairs = pairs.distinct()
    left = nodes.select(F.col("key").alias("key0"), F.col("fp").alias("fp0"), F.col("hashes").alias("before"))
    aligned = pairs.join(left, ["key0", "fp0"]).join(nodes, ["key", "fp"]).select("key", "fp", "before", "hashes", "words")
    gone = aligned.mapInArrow(_align(min_words), "key long, fp long, gone array<int>")
    places = gone.select("key", "fp", F.explode("gone").alias("i"))
    if runs:
        span = F.transform(F.arrays_zip("starts", "stops"), lambda p: F.sequence(p["starts"], p["stops"] - 1))
        places = places.union(of_first.select("key", "fp", F.explode(F.flatten(span)).alias("i")))
    return places.groupBy("key", "fp").agg(F.collect_set("i").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 10, min_words: int = 8, runs: bool = False) -> DataFrame:
    """``docs`` with its columns and three more: __kept_text, __n_lines, __n_deleted.

    Documents are ordered by id, null first, rows of one id by the hash of their
    text; rows equal in id and text are one document and stay alike. Lines are
    compared without white space at their ends. A line is deleted if an aligned
    block of at least ``min_words`` words holds it; blocks are judged on the
    input. With ``runs`` every block of consecutive lines that an earlier document
    has goes, whatever ``rare`` is; without, documents are paired by lines of three
    words and more, and a block of several frequent lines may be missed. A null text counts as empty and stays null. An
    empty table gives no rows. Columns of ``docs`` called like the three new ones
    give way to them.
    """
    key, fp, lost = (free_name(docs.columns, c) for c in ("__key", "__fp", "__gone"))
    gone = line_deletions(docs, id_col, text_col, rare, min_words, runs).withColumnsRenamed({"key": key, "fp": fp, "gone": lost})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({key: id_key(id_col), fp: F.xxhash64(text)})
    out = keyed.join(gone, [key, fp], "left")
    kept = F.transform(F.array(_lines(text)), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: x[i]), "\n"))[0]
    n = F.coalesce(F.size(lost), F.lit(0)).cast("long")
    return out.select(
        *[F.col(f"`{c}`") for c in without(docs, "__kept_text", "__n_lines", "__n_deleted")],
        F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(kept).alias("__kept_text"),
        F.size(_lines(text)).cast("long").alias("__n_lines"),
        F.when(F.col(lost).isNull(), F.lit(0)).otherwise(n).cast("long").alias("__n_deleted"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 10, min_words: int = 8, runs: bool = False) -> DataFrame:
    """``docs`` with the columns it has, texts without their deleted lines.

    A document whose lines with words were all deleted holds nothing of its own
    and goes; one that had no words before stays. Nulls, repeated rows and
    clashing names as in :func:`line_dedup`; an empty table gives no rows.
    """
    out = line_dedup(docs, id_col, text_col, rare, min_words, runs)
    out = out.filter((F.col("__n_deleted") == 0) | F.col("__kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("__kept_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in without(docs, "__kept_text", "__n_lines", "__n_deleted")])
