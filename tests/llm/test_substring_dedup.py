import hashlib

import numpy as np
import pytest

from symlens.llm.substring_dedup import _pack, substring_dedup
from tests.llm.helpers import frame, prose


def brute(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            if w in seen:
                gone.update(range(p, p + width))
            seen.add(w)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("width", "size"), [(20, 6 << 20), (20, 700), (8, 900), (5, 400), (1, 500)])
def test_equals_brute_force(spark, width, size):
    rows = prose(1)
    got = substring_dedup(frame(spark, rows), width=width, bucket_bytes=size).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in got} == brute(rows, width)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    clash = spark.createDataFrame([(None, text, "k"), (5, text, "k"), (5, text, "k"), (7, None, None)], "doc_id long, text string, key string")
    got = sorted(substring_dedup(clash).select("doc_id", "n_removed").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [(r.doc_id, r.n_removed) for r in got] == [(None, 0), (5, 25), (5, 25), (7, 0)]
    assert substring_dedup(clash.limit(0)).count() == 0


def test_very_long_text(spark):
    words = [f"x{i % 5000}" for i in range(60000)]
    rows = [(1, " ".join(words)), (2, "start " + " ".join(words[:30]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows), bucket_bytes=1000).collect()}
    assert got == {1: 55000, 2: 30}


def test_rows_of_the_exchange_are_linear():
    hashed = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    for n_parts in (1, 7, 10**9):
        got = list(_pack(hashed, n_parts, hashed))
        assert len(got) <= min(n_parts, len(hashed))
        back = np.concatenate([np.frombuffer(c[0], np.uint64) for _, c in got])
        assert sorted(back) == sorted(hashed) and all((np.frombuffer(c[0], np.uint64) % np.uint64(n_parts) == p).all() for p, c in got)
    assert list(_pack(hashed[:0], 3, hashed[:0])) == []


def test_rows_of_one_id_are_dealt_to_many_buckets(spark):
    rows = [(5, f"{' '.join(f'p{k}' for k in range(25))} own{i}") for i in range(60)]
    got = substring_dedup(frame(spark, rows), bucket_bytes=500).collect()
    assert sorted(r.n_removed for r in got) == [0, *[25] * 59]
