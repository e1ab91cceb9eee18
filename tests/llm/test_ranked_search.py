import math
import random
import re
from collections import Counter

import numpy as np

from symlens.llm.ranked_search import best, build_index, length_factors, packed, ranked_search, shard_rows, terms_of, unpacked
from tests.llm.helpers import frame, prose

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + 90 * sum(c.values()) * len(held) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (x[0], -math.inf if x[1] is None else x[1]))[:k])]
    return sorted(out, key=str)


def test_equals_scores_of_all_documents(spark):
    docs = [*prose(1, 300), (7, "the ring"), (7, "the ring"), (None, "the Ring, ÉA"), (400, "It's ring-ring 2x"), (401, "\x00ring\x7fof"), (-5, "of the ring in")]
    items = [(0, "The ring of the line"), (1, docs[40][1]), (2, docs[19][1]), (3, ""), (4, None), (5, "nowhere"), (None, "ÉA éa ring"), (6, "the"), (6, "in"), (8, " ".join(t or "" for _, t in docs[:60]))]
    table = frame(spark, docs).selectExpr("*", "1 as term", "2 as shard", "3 as key")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "5 as score", "6 as doc_id")
    for shard_bytes, block in ((1 << 24, 512), (3000, 4), (1, 100)):
        index = build_index(table.repartition(3), shard_bytes=shard_bytes)
        for k in (10,) if block < 512 else (1, 10):
            got = sorted(map(tuple, ranked_search(index, asked, k=k, block_queries=block).collect()), key=str)
            assert got == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([(1, "a b")], ITEMS)
    assert ranked_search(build_index(docs.limit(0)), items).count() == 0
    assert ranked_search(build_index(docs), items.limit(0)).count() == 0
    assert ranked_search(build_index(docs.filter("text is null")), items).count() == 0
    assert [tuple(r) for r in ranked_search(build_index(docs), items).collect()] == brute([(1, "a"), (2, None)], [(1, "a b")], 10)


def test_terms():
    for t in ["", "It's A-Z ÉÀ b_c 1²", "\x00a\x7fb`c@d[e{f/g:h", "漢字 🙂x", " 　x\x85y "]:
        assert [w.decode() for w in terms_of(t.encode())] == words(t)


def test_packed_integers():
    r = random.Random(0)
    values = np.array([0, 1, 127, 128, 2**63, 2**64 - 1] + [r.randrange(1 << r.randrange(1, 65)) for _ in range(500)], np.uint64)
    data, size = packed(values)
    assert (unpacked(data.tobytes()) == values).all() and size.sum() == len(data)
    assert len(unpacked(b"")) == 0


def test_best_equals_sorting():
    r = random.Random(5)
    for _ in range(300):
        terms, sums = [], Counter()
        for _ in range(r.randrange(9)):
            docs = sorted(r.sample(range(60), r.randrange(1, 50)))
            scores = [r.randrange(r.choice([1, 3, 50])) for _ in docs]
            terms.append((docs, scores))
            for d, s in zip(docs, scores):
                sums[d] += s
        k = r.choice([1, 3, 10])
        want = sorted(((s, d) for d, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
        assert best(terms, k) == want


def test_long_text_and_factors():
    body = b"Ab cd-" * 300_000 + b"zz"
    head, rows = shard_rows(3, [9, -4], [body, b""])
    meta = unpacked(head.column(4)[0].as_py())
    assert head.to_pylist()[0]["n"] == 1 and meta.tolist() == [9, 600_001]
    assert [(r["term"], r["n"], r["total"], unpacked(r["body"]).tolist()) for r in rows.to_pylist()] == [(b"ab", 1, 300_000, [0, 300_000]), (b"cd", 1, 300_000, [0, 300_000]), (b"zz", 1, 1, [0, 1])]
    assert length_factors(np.array([10, 1 << 40]), 1 << 30, 1 << 41).tolist() == [10 + 90 * n * (1 << 30) // (1 << 41) for n in (10, 1 << 40)]
