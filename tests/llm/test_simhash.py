import random

import numpy as np
import pytest
import xxhash

from symlens.llm.graph import components
from symlens.llm.simhash import block_masks, fingerprint, hamming_links, most_differing, near_duplicates_removed, simhash_dedup, sketch_bits
from tests.llm.helpers import frame, prose

SMALL = 1 << 64


def slow(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    """Least id of each id's component, by all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_classes_equal_brute_force(spark):
    rows = prose(5)
    want = {i: slow(t) for i, t in rows}
    label = classes(want, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(frame(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in want.items()}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: slow(r.text) for r in docs.collect()}
    label = classes(want, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in want.items()}


@pytest.mark.parametrize(("radius", "blocks", "bucket"), [(2, 4, 32), (2, 4, 1), (3, 5, 2), (4, 7, 3), (1, 3, 1)])
def test_links_join_all_within_the_radius(spark, radius, blocks, bucket):
    r = random.Random(radius * 10 + bucket)
    prints = {r.getrandbits(64) for _ in range(12)}
    for p in list(prints):
        prints |= {p ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, radius + 3))) for _ in range(8)}
    signed = {p - SMALL if p >> 63 else p: p for p in prints}
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = hamming_links(nodes, radius, blocks, bucket)
    assert all((signed[x.src] ^ signed[x.dst]).bit_count() <= radius for x in links.collect())
    label = classes(signed, radius)
    roots = {x.node: x.root for x in components(links).collect()}
    assert {p: roots.get(p, p) for p in signed} == label


def test_masks_keep_every_close_pair():
    masks = block_masks(2, 4)
    assert len(masks) == 6 and all(any(not (m >> i & 1 or m >> j & 1) for m in masks) for i in range(64) for j in range(64))


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000)], "src long, dst long")
    assert {x.root for x in components(edges).collect()} == {0} and components(edges).count() == n + 1


def test_edges(spark):
    clash = spark.createDataFrame([(None, "x y z w", 1, 2), (4, "x y z w", 2, 2), (4, "x y z w", 2, 2), (9, None, 3, 3), (8, "", 4, 4)], "doc_id long, text string, fp int, least int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_dedup(clash).collect())
    assert got == [(-1, None), (4, None), (4, None), (8, 8), (9, 8)]
    assert simhash_dedup(clash.limit(0)).count() == 0
    kept = near_duplicates_removed(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 8]
    assert sorted(r.doc_id for r in near_duplicates_removed(clash.filter("doc_id = 4")).collect()) == [4]


def test_long_text():
    words = [str(i) for i in range(200_000)]
    assert fingerprint(" ".join(words[:70_000]).encode()) == fingerprint("  ".join(words[:70_000]).upper().encode())


def jaccard(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def spoiled(r, words, share):
    """``words`` with a word replaced here and there, about ``share`` of the shingles of five changed."""
    out = list(words)
    for i in r.sample(range(0, len(out), 5), max(1, round(len(out) * share / 5))):
        out[i] = f"x{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("bucket", [32, 2])
def test_recall_at_jaccard_0_8(spark, bucket):
    r = random.Random(8)
    rows = []
    for g in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        rows.append((10 * g, " ".join(words)))
        rows += [(10 * g + k, " ".join(spoiled(r, words, share))) for k, share in enumerate((0.05, 0.09, 0.11, 0.3), 1)]
    label = {i: i for i, _ in rows}
    prints = {i: slow(t, 5) for i, t in rows}
    linked = [(i, j) for i, t in rows for j, u in rows if i < j and i // 10 == j // 10 and jaccard(t, u) >= 0.8]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in linked) > 40
    for _ in range(5):
        for i, j in linked + [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]:
            label[i] = label[j] = min(label[i], label[j])
    kept = near_duplicates_removed(frame(spark, rows), similarity=0.8, shingle_words=5, radius=4, n_blocks=7, pair_bucket=bucket)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, c in label.items() if i == c)


def test_one_row_for_each_component_whatever_the_ids(spark):
    texts = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[0]), (7, texts[4]), (8, texts[4])]
    for similarity in (None, 0.8):
        kept = near_duplicates_removed(frame(spark, rows), similarity=similarity)
        assert sorted((x.doc_id or -1, x.text) for x in kept.collect()) == sorted([(-1, texts[0]), (-1, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4])])


def test_sketches_leave_similar_texts_within_reach():
    r = np.random.default_rng(3)
    for similarity in (0.8, 0.9):
        for n in (60, 500):
            own = round(n * (1 - similarity) / (1 + similarity) - 1e-9)
            for _ in range(20):
                x = r.integers(0, 2**63, n + own, dtype=np.uint64)
                a, b = sketch_bits(x[:n]), sketch_bits(x[own:])
                assert sum(((i ^ j) & (2**64 - 1)).bit_count() for i, j in zip(a, b, strict=True)) <= most_differing(similarity)
    far = [((i ^ j) & (2**64 - 1)).bit_count() for i, j in zip(sketch_bits(x[:200]), sketch_bits(x[200:400]), strict=True)]
    assert 400 < sum(far) < 624


def test_stars_of_partitions_keep_components(spark, monkeypatch):
    monkeypatch.setattr("symlens.llm.graph.FOREST_NODES", 3)
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    label = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "src long, dst long").repartition(5)).collect()}
    assert {i: got.get(i, i) for i in range(200)} == dict(enumerate(label))
