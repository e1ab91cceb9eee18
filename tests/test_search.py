"""Search against a plain Python version and the cases of the fixture list."""

import math
import random

import pytest

from symlens.functions.schema import QUERIES, SYMBOLS
from symlens.operators.search import intersect, postings, search, search_batch
from symlens.operators.store import SymbolStore, recomputed


def rows(spark, items, hot=None):
    """Symbols from (name, kind, container, uri[, cc])."""
    full = [("", n, k, c, u, 0, 0, 0, 10, None, cc[0] if cc else None, None, None, u, i) for i, (n, k, c, u, *cc) in enumerate(items)]
    return recomputed(spark.createDataFrame(full, SYMBOLS))


BASE = [("formatDate", 12, "Utils", "file:///src/utils.ts"), ("parseDate", 12, "Utils", "file:///src/utils.ts"), ("DateHelper", 5, None, "file:///src/utils.ts"), ("fetchUser", 12, "Api", "file:///src/api.ts"), ("UserClient", 5, None, "file:///src/api.ts")]


def naive(items, q, limit, kinds=None, hot=None):
    """Names and scores, by plain loops."""
    tokens = q.lower().split()
    texts = [(n.lower(), (c or "").lower()) for n, _, c, *_ in items]

    def grams(t, n):
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    chosen = set(range(len(items))) if not tokens else set()
    for t in tokens:
        n = min(3, len(t))
        for d in (0, 1):
            hit = {i for i, x in enumerate(texts) if grams(t, n) <= grams(x[d], n)}
            if not hit and len(t) > 1:
                hit = {i for i, x in enumerate(texts) if set(t) <= set(x[d])}
            chosen |= hit

    def grade(text, t, g):
        if not text:
            return 0
        it = iter(text)
        return g[0] if text == t else g[1] if text.startswith(t) else g[2] if t in text else g[3] if all(c in it for c in t) else 0

    out = []
    for i in chosen:
        name, kind, _, uri, *cc = items[i]
        if kinds is not None and kind not in kinds:
            continue
        a = sum(grade(texts[i][0], t, (100, 80, 60, 40)) for t in tokens)
        b = sum(grade(texts[i][1], t, (24, 16, 10, 6)) for t in tokens)
        score = a + min(b, max(a, 40) * 0.35) if tokens else 1.0
        score *= 1.15 if kind in (6, 9, 12) else 1.08 if kind in (5, 11, 23) else 1.03 if kind in (7, 8, 13, 14) else 1
        score *= 1 + min(max((hot or {}).get(uri, 0.0), 0), 1) * 0.15
        score *= 1 + math.log(max(cc[0], 1)) * 0.1 if cc and cc[0] is not None else 1
        if score > 0:
            out.append((-round(score, 9), name, uri))
    return [(n, -s) for s, n, u in sorted(out)[:limit]]


def got(df):
    return [(r.name, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize(("q", "want"), [("fd", {"formatDate"}), ("utils", {"formatDate", "parseDate"}), ("nonexistent", set()), ("format", {"formatDate"}), ("f", {"formatDate", "fetchUser"})])
def test_base_cases(spark, q, want):
    found = {r.name for r in search(rows(spark, BASE), q).collect()}
    assert want <= found and (want or not found)


def test_limits_kinds_and_empty_query(spark):
    s = rows(spark, BASE)
    assert search(s, "", limit=2).count() == 2 and search(s, "user", kinds=[]).count() == 0
    assert {r.name for r in search(s, "date", kinds=[5]).collect()} == {"DateHelper"}
    hot = spark.createDataFrame([("file:///src/api.ts", 10.0), ("file:///src/utils.ts", 0.1)], "uri string, score double")
    assert search(s, "", hotspots=hot).first().uri == "file:///src/api.ts"


def test_container_ranks_and_ties_follow_uri(spark):
    s = rows(spark, [("fetchItem", 12, "Utils", "file:///b.ts"), ("fetchItem", 12, "Api", "file:///a.ts")])
    assert search(s, "fetch api").first().uri == "file:///a.ts"
    t = rows(spark, [("target", 12, None, "file:///b.lua"), ("target", 12, None, "file:///a.lua"), ("target", 5, None, "file:///0.lua")])
    assert [r.uri for r in search(t, "target").collect()] == ["file:///a.lua", "file:///b.lua", "file:///0.lua"]


def test_debt_follows_the_cap(spark):
    s = rows(spark, [("complex_func", 12, None, "file:///a.ts", 25), ("plain_func", 12, None, "file:///a.ts")])
    hot = spark.createDataFrame([("file:///a.ts", 0.9)], "uri string, score double")
    debt = {cap: {r.name: r.tech_debt for r in search(s, "func", complexity_cap=cap, hotspots=hot).collect()} for cap in (20, 50, 100)}
    assert [round(debt[c]["complex_func"], 9) for c in (50, 100, 20)] == [0.45, 0.225, 0.9] and debt[50]["plain_func"] is None


def test_literal_characters_and_duplicates(spark):
    s = rows(spark, [("a%b_c.d", 12, None, "file:///a"), ("axbyczd", 12, None, "file:///b")])
    assert {r.name for r in search(s, "%b_").collect()} == {"a%b_c.d"}
    index = spark.createDataFrame([("name", 1, g, str(s)) for g, ids in (("a", [1, 1, 2, 3]), ("b", [2, 2, 1]), ("c", [4, 1, 2])) for s in ids], "domain string, n int, gram string, symbol_id string")
    wanted = spark.createDataFrame([(1, "name", 1, g, 3) for g in "abc"], "key int, domain string, n int, gram string, size int")
    assert {r.symbol_id for r in intersect(index, wanted).collect()} == {"1", "2"}


def test_random_searches_equal_the_plain_version(spark):
    r = random.Random(4)
    names = ["fetchData", "parseResponse", "handleError", "fetchUserList", "userService", "İstanbulΣ", "data_fetch", "x", "readFile", "writeFileSync"]
    items = list({(n + str(r.randrange(4)), k, c, u): 0 for n in names for k, c, u in [(r.choice([5, 6, 12, 13, 2]), r.choice([None, "Api", "UserData", ""]), f"file:///{r.randrange(3)}") for _ in range(3)]})
    items = [(*i, r.choice([None, 1, 30])) for i in items]
    scores = {"file:///0": 0.5, "file:///1": 7.0}
    s, hot = rows(spark, items).cache(), spark.createDataFrame(list(scores.items()), "uri string, score double")
    queries = [("fetch", None, 50), ("fetch data", None, 5), ("fd", [12, 6], 50), ("usr api", None, 50), ("zzq", None, 5), ("", None, 4), ("", [12, 5, 12], 6), ("", [], 3), (" ", [13], 1), ("σ", None, 9), ("e e", None, 9), ("api", [5], 9)]
    for q, kinds, limit in queries:
        assert got(search(s, q, limit, kinds=kinds, hotspots=hot)) == naive(items, q, limit, kinds, scores), q
    table = spark.createDataFrame([(i, q, n, 50, k) for i, (q, k, n) in enumerate(queries)], QUERIES)
    out = search_batch(s, table, hot, postings(s)).collect()
    for i, (q, kinds, limit) in enumerate(queries):
        assert [(x.name, round(x.score, 9)) for x in sorted(out, key=lambda x: x.rank) if x.qid == i] == naive(items, q, limit, kinds, scores), q


def test_store_search(spark):
    store = SymbolStore.empty(spark).upsert_symbols(rows(spark, BASE))
    assert store.search("format").first().name == "formatDate"
    assert store.search_batch(spark.createDataFrame([(1, "format", 5, 50, None)], QUERIES)).first().qid == 1
