import random

import pytest

from symlens.llm.line_dedup import common_blocks, deduplicated, line_dedup, patience, run_keys
from tests.llm.helpers import frame


def lines_of(text):
    return [x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")]


def brute(rows, rare, min_words):
    """Every document against the earlier holders that the rule names, without any join."""
    docs = sorted({(i, t or "") for i, t in rows})
    holders = {}
    for k, (_, t) in enumerate(docs):
        for x in set(lines_of(t)):
            if len(x.split()) >= 3:
                holders.setdefault(x, []).append(k)
    out = {}
    for k, (i, t) in enumerate(docs):
        b, gone, partners = lines_of(t), set(), set()
        for x in set(b):
            h = holders.get(x, [])
            if len(h) > 1:
                partners |= {p for p in (h if len(h) <= rare else h[:1]) if p < k}
        for p in partners:
            gone |= set(common_blocks(lines_of(docs[p][1]), b, [len(x.split()) for x in b], min_words))
        out[i] = (len(gone), "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone))
    return out


def brute_runs(rows, min_words):
    """Every document against all earlier ones: lines of each stretch that both have, without any alignment."""
    docs = sorted({(i, t or "") for i, t in rows})
    out = {}
    for k, (i, t) in enumerate(docs):
        b, gone = lines_of(t), set()
        for _, u in docs[:k]:
            a = lines_of(u)
            places = {}
            for m, x in enumerate(a):
                places.setdefault(x, []).append(m)
            for j, x in enumerate(b):
                for m in places.get(x, []):
                    if m and j and a[m - 1] == b[j - 1]:
                        continue  # not where the stretch begins
                    n = 0
                    while m + n < len(a) and j + n < len(b) and a[m + n] == b[j + n]:
                        n += 1
                    if sum(len(y.split()) for y in b[j : j + n]) >= min_words:
                        gone |= set(range(j, j + n))
        out[i] = (len(gone), "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    blocks = [[r.choice(pool) for _ in range(r.randrange(2, 6))] for _ in range(6)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(1, 5)):
            out += r.choice(blocks) if r.random() < 0.5 else [" ".join(f"u{i}_{r.randrange(999)}" for _ in range(6)), r.choice(["", " ", r.choice(pool)])]
        rows.append((i, "\n".join(out)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1])]


@pytest.mark.parametrize(("seed", "rare", "least"), [(1, 10, 8), (2, 2, 8), (3, 3, 1), (4, 50, 4)])
def test_equals_brute_force(spark, seed, rare, least):
    rows = corpus(seed)
    got = {r.doc_id: (r["__n_deleted"], r["__kept_text"] or "") for r in line_dedup(frame(spark, rows), rare=rare, min_words=least).collect()}
    assert got == brute(rows, rare, least)


@pytest.mark.parametrize(("seed", "least"), [(1, 8), (5, 8), (6, 1), (7, 5), (8, 14)])
def test_runs_equal_brute_force_whatever_is_rare(spark, seed, least):
    rows = corpus(seed, 30)
    r = random.Random(seed)
    blocks = [t.split("\n")[:4] for _, t in rows[:6]]
    rows += [(100 + i, "\n".join(x for b in r.sample(blocks, 3) for x in b)) for i in range(14)]  # crossing blocks, held by many
    want = brute_runs(rows, least)
    for rare in (1, 3, 100):
        got = {x.doc_id: (x["__n_deleted"], x["__kept_text"] or "") for x in line_dedup(frame(spark, rows), rare=rare, min_words=least, runs=True).collect()}
        assert got == want


@pytest.mark.parametrize("later", [8, 10, 20])
def test_crossing_blocks_go_whoever_holds_them(spark, later):
    block, line = "\n".join(f"block line {k} of the corpus" for k in range(3)), "a line r of nine words in many a text"
    rows = [(1, f"{block}\n{line}"), (2, line)] + [(3 + i, f"own {i}\n{line}\n{block}\nend {i}") for i in range(later)]
    got = {r.doc_id: r["__n_deleted"] for r in line_dedup(frame(spark, rows), runs=True).collect()}
    assert got == {1: 0, 2: 1} | {3 + i: 4 for i in range(later)}


def test_one_very_long_line(spark):
    long = "word " * 300_000
    rows = [(1, long), (2, f"own words\n{long}\nmore"), (3, "x" * 2_000_000)]
    assert {r.doc_id: r["__n_deleted"] for r in line_dedup(frame(spark, rows), runs=True).collect()} == {1: 0, 2: 1, 3: 0}


def test_patience_rises_on_both_sides_and_matches():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in "ab")
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_shared_passage_goes_from_later_document_only(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(12)) for k in range(5))
    rows = [(i, f"own line of document {i} with words\n{passage}\nlast line of {i} with more words") for i in range(15)] + [(99, "a clean text of its own\nwith two lines that nobody shares")]
    out = deduplicated(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert passage in texts[0] and texts[99] == rows[-1][1]
    assert all("p0w0" not in texts[i] and f"document {i} " in texts[i] and f"of {i} " in texts[i] for i in range(1, 15))


def test_edges(spark):
    t = "one two three four five six seven eight nine\nten eleven twelve"
    clash = spark.createDataFrame([(None, t, 1, 1), (4, t, 2, 2), (4, t, 2, 2), (5, None, 3, 3)], "doc_id long, text string, key int, gone int")
    got = sorted((r.doc_id or -1, r["__n_deleted"]) for r in line_dedup(clash).collect())
    assert got == [(-1, 0), (4, 2), (4, 2), (5, 0)]
    assert line_dedup(clash.limit(0)).count() == 0


def test_long_text(spark):
    body = [f"line number {i} of a long text with words" for i in range(5000)]
    rows = [(1, "\n".join(body)), (2, "\n".join(["start of two with other words", *body[100:4900]]))]
    assert {r.doc_id: r["__n_deleted"] for r in line_dedup(frame(spark, rows)).collect()} == {1: 0, 2: 4800}


def test_lines_that_stand_twice_are_aligned(spark):
    assert patience([1, 5, 1], [6, 1, 7]) == [(0, 1)]
    assert patience([1, 5, 1, 2, 6, 2], [7, 1, 2, 8]) == [(2, 1), (3, 2)]
    x = " ".join(f"long{i}" for i in range(50))
    rows = [(0, f"{x}\njunk between\n{x}")] + [(i, f"first of {i}\n{x}\nlast of {i}") for i in range(1, 15)]
    assert {r.doc_id: r["__n_deleted"] for r in line_dedup(frame(spark, rows)).collect()} == {i: int(i > 0) for i in range(15)}


def test_matches_leave_no_common_line_between():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in "ab")
        got = [(-1, -1), *patience(a, b), (len(a), len(b))]
        assert all(not set(a[i + 1 : k]) & set(b[j + 1 : m]) for (i, j), (k, m) in zip(got, got[1:]))


def test_blocks_of_frequent_or_short_lines_meet_an_earlier_holder(spark):
    a, b = "five words in line a", "five words in line b"
    short = "\n".join(f"short {k}" for k in range(4))
    rows = [(1, a), (2, b)] + [(i, f"own {i}\n{a}\n{b}\nlast {i}") for i in range(3, 21)] + [(i, f"top {i}\n{short}\nend {i}") for i in range(30, 45)]
    got = {r.doc_id: r["__n_deleted"] for r in line_dedup(frame(spark, rows), runs=True).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 30: 0} | {i: 2 for i in range(4, 21)} | {i: 4 for i in range(31, 45)}


def test_runs_cover_each_line_of_a_block():
    r = random.Random(3)
    for _ in range(200):
        words = [r.randrange(6) for _ in range(r.randrange(1, 10))]
        hashes = [r.getrandbits(62) for _ in words]
        keys = run_keys(hashes, words, 8)
        assert bool(keys) == (sum(words) >= 8)
        around = run_keys([1, *hashes, 2], [3, *words, 3], 8)
        assert all(run_keys(hashes[:k], words[:k], 8) <= keys for k in range(len(words))) and keys <= around
