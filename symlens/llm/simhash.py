"""SimHash near-dedup with pigeonhole blocks.

A fingerprint takes one pass over the whole text (Arrow batches). Equal
fingerprints collapse first, so that later steps see each once. Fingerprints
are cut into blocks; two that differ in at most ``radius`` bits agree in all
but ``radius`` of them, so each combination of the remaining blocks is a key to
join on, and pairs are verified by their Hamming distance.

A bucket with more than ``pair_bucket`` fingerprints isn't paired: each member
yields itself and its flips of up to half the radius (rounded down on one side,
up on the other) among the bits outside the key. Two members share such a value
exactly if they are within the radius, so each is linked to the least member
at a value: the work stays linear and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symlens.llm.graph import components
from symlens.llm.work import free_name, id_key, id_value, materialize, rows_of, text_bytes

#: Shingle hashes counted at a time; bounds memory for very long texts.
CHUNK = 1 << 16
#: Bands of least values, and values in a band: two sets of Jaccard similarity 0.8 share a band in 99.98 % of cases.
BANDS, BAND_ROWS = 16, 4
#: One bit each of so many least values: two sets of similarity 0.8 differ in a tenth of them on average.
SKETCH_BITS = 1024
#: Hashes permuted at a time, times the number of permutations.
MIN_CHUNK = 1 << 17
_XOR = np.array([xxhash.xxh64_intdigest(b"xor", i) for i in range(SKETCH_BITS)], np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(b"odd", i) | 1 for i in range(SKETCH_BITS)], np.uint64)


def shingle_hashes(text: bytes, shingle_words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, some at a time. Only A-Z are lower-cased; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle_words:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle_words])).tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    for i in range(0, n - shingle_words + 1, CHUNK):
        part = zip(starts[i : i + CHUNK], stops[i : i + CHUNK], strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in part], np.uint64)


def _majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have, as a signed long."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """64-bit SimHash as a signed long. Only A-Z are lower-cased; no words: 0."""
    return _majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(key, fp) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    return rows_of(docs, id_col, text_col).mapInArrow(run, "key long, fp long")


def block_masks(radius: int, n_blocks: int) -> list[int]:
    """Masks of the bits two fingerprints within ``radius`` share in at least one case."""
    edges = [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hamming_links(nodes: DataFrame, radius: int = 2, n_blocks: int = 4, pair_bucket: int = 32) -> DataFrame:
    """(src, dst), src < dst: links of the distinct fingerprints in ``nodes`` (column fp).

    Every two fingerprints within ``radius`` bits are joined by a path of these
    links, and each link is within ``radius`` bits.
    """
    masks = [_signed(m) for m in block_masks(radius, n_blocks)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.bits")
    sizes = materialize(keyed.groupBy("t", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    live = materialize(keyed.join(sizes, ["t", "bits"]), "simhash-live")
    small = live.filter(F.col("n") <= pair_bucket).select("t", "bits", "fp")
    other = small.withColumnRenamed("fp", "fp2")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius
    pairs = small.join(other, ["t", "bits"]).filter((F.col("fp") < F.col("fp2")) & near).select(F.col("fp").alias("src"), F.col("fp2").alias("dst"))
    return pairs.union(_flip_links(live.filter(F.col("n") > pair_bucket), masks, radius)).distinct()


def _flips(mask: Column, most: int) -> Column:
    """All values of up to ``most`` bits outside ``mask``, as structs of the value and its number of bits."""
    free = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 0)
    bits = F.transform(free, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    value = lambda v, n, last: F.struct(v.alias("bits"), F.lit(n).alias("n"), last.alias("last"))
    level = F.array(value(F.lit(0).cast("long"), 0, F.lit(-1)))
    out = [level]
    indexed = F.transform(bits, lambda b, i: F.struct(b.alias("b"), i.alias("i")))

    def longer(n: int):
        return lambda x: F.transform(F.slice(indexed, x["last"] + 2, 64), lambda y: value(x["bits"].bitwiseOR(y["b"]), n, y["i"]))

    for n in range(1, most + 1):
        level = F.flatten(F.transform(level, longer(n)))
        out.append(level)
    return F.concat(*out)


def _flip_links(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links inside large buckets, without pairing their members."""
    near, far = radius // 2, radius - radius // 2
    mask = F.array(*[F.lit(m) for m in masks])[F.col("t")]
    met = rows.withColumn("mask", mask).select("t", "fp", F.explode(_flips(F.col("mask"), far)).alias("f")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("f.bits")).alias("at"), F.col("f.n").alias("d"))
    hubs = met.groupBy("t", "at").agg(F.min("fp").alias("hub"), F.min(F.when(F.col("d") <= near, F.col("fp"))).alias("near_hub"), F.count("*").alias("n"))
    links = met.join(hubs.filter("n > 1").select("t", "at", "hub", "near_hub"), ["t", "at"])
    ends = F.explode(F.array("near_hub", F.when(F.col("d") <= near, F.col("hub"))))
    return links.select(ends.alias("src"), F.col("fp").alias("dst")).filter("src <> dst")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2, n_blocks: int = 4, pair_bucket: int = 32) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fingerprint, component_id).

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest id
    reachable over links of at most ``radius`` bits. A null or empty text has
    fingerprint zero and is linked like any other. Null ids order first and stay
    null. Rows with one id and differing texts each have their own fingerprint.
    An empty table gives no rows. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "simhash-nodes")
    roots = components(hamming_links(nodes, radius, n_blocks, pair_bucket))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    # both tables of their own, so that the joins below start from two exchanges and the rows of a hot root or fingerprint can be split
    label = materialize(linked.groupBy("root").agg(F.min("least").alias("label")), "simhash-labels")
    classes = linked.join(label, "root").select("fp", "label")
    named = materialize(nodes.join(classes, "fp", "left").select("fp", F.coalesce("label", "least").alias("label")), "simhash-named")
    return prints.join(named, "fp").select(
        id_value(F.col("key")).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_value(F.col("label")).alias("component_id"),
    )


def _sketches(rows: DataFrame, shingle_words: int, similar: bool) -> DataFrame:
    """(key, h, fp, m, bands) for each of ``rows`` (key, h, body); ``m`` and ``bands`` are empty unless ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, bands = [], [], []
            for t in b.column(2):
                parts = list(shingle_hashes(t.as_py(), shingle_words))
                fps.append(_majority(parts))
                m, found = band_keys(np.unique(np.concatenate(parts))) if similar and parts else (0, [])
                sizes.append(m)
                bands.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "h", "fp", "m", "bands"])

    return rows.select("key", "h", "body").mapInArrow(run, "key long, h long, fp long, m long, bands array<long>")


def _least(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of the first ``n`` permutations of the hashes."""
    least, step = np.full(n, 2**64 - 1, np.uint64), max(1, MIN_CHUNK // n)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step, None]
        np.minimum(least, ((part ^ _XOR[:n]) * _ODD[:n]).min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> tuple[int, list[int]]:
    """Number of the distinct shingle hashes and a key for each band of their least permuted values."""
    least = _least(hashes, BANDS * BAND_ROWS)
    return len(hashes), (least.reshape(BANDS, BAND_ROWS) * _ODD[:BAND_ROWS]).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def sketch_bits(hashes: np.ndarray) -> list[int]:
    """One bit of each least permuted value, 64 to a long."""
    bits = (_least(hashes, SKETCH_BITS) >> np.uint64(20)).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def most_differing(similarity: float) -> int:
    """Sketch bits in which two sets of the similarity differ at most, but for three cases in 100,000 (four deviations)."""
    p = (1 - similarity) / 2
    return int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _similar(pairs: DataFrame, rows: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(src, dst): fingerprints of the ``pairs`` (h, fp, h2, fp2) whose shingle sets have the Jaccard ``similarity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(np.concatenate(list(shingle_hashes(t.as_py(), shingle_words)))).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["h", "set"])

    pairs = materialize(pairs.distinct(), "similar-pairs")
    asked = pairs.select("h").union(pairs.select("h2")).distinct()
    bodies = rows.join(asked, "h", "left_semi").select("h", "body").dropDuplicates(["h"])
    sets = materialize(bodies.mapInArrow(run, "h long, set array<long>"), "similar-sets")
    both = pairs.join(sets, "h").join(sets.select(F.col("h").alias("h2"), F.col("set").alias("set2")), "h2")
    common = F.size(F.array_intersect("set", "set2"))
    return both.filter(common / (F.size("set") + F.size("set2") - common) >= similarity).select(F.col("fp").alias("src"), F.col("fp2").alias("dst"))


def _sketched(texts: DataFrame, rows: DataFrame, shingle_words: int) -> DataFrame:
    """(h, b0_, b1_, ...): sketch bits of the ``texts`` (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [sketch_bits(np.unique(np.concatenate(list(shingle_hashes(t.as_py(), shingle_words))))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in bits], pa.int64()) for i in range(SKETCH_BITS // 64)]], ["h", *_BITS])

    bodies = rows.join(texts.select("h").distinct(), "h", "left_semi").select("h", "body").dropDuplicates(["h"])
    return materialize(bodies.mapInArrow(run, ", ".join(["h long", *[f"{c} long" for c in _BITS]])), "similar-bits")


_BITS = [f"b{i}_" for i in range(SKETCH_BITS // 64)]


def _rooted(texts: DataFrame, roots: DataFrame) -> DataFrame:
    return texts.drop("root").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def similar_roots(prints: DataFrame, rows: DataFrame, roots: DataFrame, similarity: float, shingle_words: int, pair_bucket: int = 32) -> DataFrame:
    """``roots`` (node, root) with the components of fingerprints joined whose texts have the Jaccard ``similarity``.

    Texts that agree in a band meet, are compared exactly and linked. In a bucket of more than
    ``pair_bucket`` texts each first meets one alone; the texts still in
    different components then meet by their sketches, and those are compared
    exactly whose sketches are as near as the similarity makes them.
    """
    texts = prints.filter("m > 0").dropDuplicates(["h"]).select("h", "fp", "m", "bands")
    keyed = _rooted(texts, roots).select("h", "fp", "m", "root", F.posexplode("bands").alias("t", "v"))
    keyed = materialize(keyed, "similar-keyed")

    def mixed(table: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component, with the size and one member of each."""
        size = table.groupBy("t", "v").agg(F.count("*").alias("n"), F.min(F.struct("h", "fp", "m", "root")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        size = materialize(size.filter("lo <> hi").drop("lo", "hi"), "similar-sizes")
        return materialize(table.join(size, ["t", "v"]), "similar-live")

    near = F.least("m", "m2") / F.greatest("m", "m2") >= similarity

    def paired(live: DataFrame, *bits: str) -> DataFrame:
        live = live.select("t", "v", "h", "fp", "m", "root", *bits)
        other = live.select("t", "v", *[F.col(c).alias(c + "2") for c in live.columns[2:]])
        wanted = (F.col("h") < F.col("h2")) & (F.col("root") != F.col("root2")) & near
        if bits:
            differing = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(c + "2"))) for c in bits])
            wanted &= differing <= most_differing(similarity)
        return live.join(other, ["t", "v"]).filter(wanted).select("h", "fp", "h2", "fp2")

    live = mixed(keyed)
    large = live.filter(F.col("n") > pair_bucket)
    first = large.select("hub.h", "hub.fp", "hub.m", "hub.root", *[F.col(c).alias(c + "2") for c in ("h", "fp", "m", "root")])
    first = first.filter((F.col("root") != F.col("root2")) & near).select("h", "fp", "h2", "fp2")
    pairs = paired(live.filter(F.col("n") <= pair_bucket)).union(first)
    star = roots.select(F.col("root").alias("src"), F.col("node").alias("dst"))
    roots = materialize(components(star.union(_similar(pairs, rows, similarity, shingle_words))), "similar-roots")
    if large.isEmpty():
        return roots
    rest = mixed(_rooted(large.select("t", "v", "h", "fp", "m"), roots))
    star = roots.select(F.col("root").alias("src"), F.col("node").alias("dst"))
    rest = rest.join(_sketched(rest, rows, shingle_words), "h")
    return components(star.union(_similar(paired(rest, *_BITS), rows, similarity, shingle_words)))


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle_words: int = 3, radius: int = 2, n_blocks: int = 4, pair_bucket: int = 32) -> DataFrame:
    """``docs`` with the columns it has: of each component one row.

    It is the row of smallest id, null first, then of smallest hash of its text;
    rows equal in both are one. Rows of one id, or without any, whose texts are
    in different components all stay. With ``similarity``, texts whose sets of
    shingles have at least that Jaccard similarity are linked besides those
    within ``radius`` bits. Other parameters are those of :func:`simhash_dedup`.
    """
    text = F.xxhash64(text_bytes(text_col))
    rows = docs.select(id_key(id_col).alias("key"), text.alias("h"), text_bytes(text_col).alias("body"))
    prints = materialize(_sketches(rows, shingle_words, similarity is not None), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.struct("key", "h")).alias("least")), "simhash-nodes")
    roots = materialize(components(hamming_links(nodes.select("fp"), radius, n_blocks, pair_bucket)), "simhash-roots")
    if similarity is not None:
        roots = similar_roots(prints, rows, roots, similarity, shingle_words, pair_bucket)
    stay = _rooted(nodes, roots).groupBy("root").agg(F.min("least").alias("least"))
    key, h = free_name(docs.columns, "__key"), free_name(docs.columns, "__h")
    stay = stay.select(F.col("least.key").alias(key), F.col("least.h").alias(h))
    keyed = docs.withColumns({key: id_key(id_col), h: text}).join(stay, [key, h], "left_semi")
    return keyed.dropDuplicates([key, h]).select(*[F.col(f"`{c}`") for c in docs.columns])
