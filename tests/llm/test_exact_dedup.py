import hashlib
import re

from symlens.llm.exact_dedup import exact_dedup
from tests.llm.helpers import frame, prose


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    rows = prose(2) + [(100, "a b"), (101, "ab"), (102, " a\tb "), (103, "a b"), (104, "ééé"), (105, "é éé")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    clash = spark.createDataFrame([(None, "x y", 1), (4, "x y", 2), (4, "xy", 3), (4, "xy", 3), (5, "z", 4)], "doc_id long, text string, len int")
    rows = exact_dedup(clash).collect()
    group = [r for r in rows if r.doc_id != 5]
    assert len(group) == 4 and all(r.keep_id is None and r.group_size == 4 for r in group)
    assert [r.doc_id for r in group if r.kept] == [None]
    twice = exact_dedup(spark.createDataFrame([(4, "xy"), (4, "xy")], "doc_id long, text string")).collect()
    assert sorted(r.kept for r in twice) == [False, True]
    assert exact_dedup(clash.limit(0)).count() == 0


def test_long_text(spark):
    rows = [(1, "ab " * 200_000), (2, "ab" * 200_000), (3, "ab" * 199_999 + "ac")]
    got = {r.doc_id: r.keep_id for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
