"""The maintained index against one rebuilt from the same symbols, and its commit log."""

import random

import pytest
from pyspark.sql import functions as F

from symlens.functions import schema as S
from symlens.operators import postings, search, store
from symlens.sources.commits import CommitLog, StaleVersion

WORDS = ["get", "user", "fetch", "Data", "re", "x", "bolt", "ünï", "a%b", "_"]


def some(spark, r, uris, n=4):
    rows = []
    for u in uris:
        for i in range(r.randrange(n + 1)):
            name = "_".join(r.choice(WORDS) for _ in range(r.randrange(1, 4)))
            rows.append((name, r.choice([5, 6, 12, 13]), r.choice([None, "Api", "Cache"]), u, r.randrange(3), 0, 9, r.choice([None, r.randrange(1, 30)]), u, i))
    table = spark.createDataFrame(rows, "name string, kind long, container_name string, uri string, start_line long, start_char long, end_line long, cyclomatic_complexity long, request_uri string, ord long")
    missing = [f.split()[0] for f in S.SYMBOLS.split(", ") if f.split()[0] not in table.columns]
    kinds = dict(f.split() for f in S.SYMBOLS.split(", "))
    return table.select("*", *[F.lit(0 if c == "end_char" else None).cast(kinds[c]).alias(c) for c in missing]).select(*[f.split()[0] for f in S.SYMBOLS.split(", ")]).withColumn("symbol_id", F.lit(""))


def test_equals_a_rebuilt_index(spark, tmp_path):
    r = random.Random(3)
    index, now = postings.PostingIndex(spark, f"file://{tmp_path}/i", buckets=4, shelves=2), spark.createDataFrame([], S.SYMBOLS)
    uris = [f"file:///{i}.ts" for i in range(12)]
    for step in range(5):
        if step == 2:
            gone = r.sample(uris, 4)
            index.remove(gone, merge=False)
            now = store.remove_uris(now, spark.createDataFrame([(u,) for u in gone], "uri string"))
        else:
            own = r.sample(uris, 8 if step == 0 else 3)
            batch = some(spark, r, own)
            index.upsert(batch, own, merge=step == 3)
            now = store.replace_symbols(now, batch, spark.createDataFrame([(u,) for u in own], "uri string"))
        now = spark.createDataFrame(now.collect(), S.SYMBOLS)
    assert len(index.runs()) > 1
    assert sorted(map(str, index.symbols().select(*now.columns).collect())) == sorted(map(str, now.collect()))
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.postings(now).collect()))
    ask = ["user fetch", "gt", "usr", "x", "", "zz", "ünï", "re_x da"]
    hot = spark.createDataFrame([(uris[0], 0.7), (uris[1], 0.3)], S.HOTSPOTS)
    seen = lambda df: [(x.symbol_id, x.request_uri, round(x.score, 9)) for x in df.collect()]
    for q in ask:
        assert seen(index.search(q, 9, hotspots=hot, kinds=[6, 12, 13] if q == "x" else None)) == seen(search.search(now, q, 9, hotspots=hot, kinds=[6, 12, 13] if q == "x" else None)), q
    queries = spark.createDataFrame([(i, q, 7, 50, None) for i, q in enumerate(ask)], S.QUERIES)
    batch = lambda **k: sorted((x.qid, x["rank"], x.symbol_id) for x in search.search_batch(now, queries, hot, **k).collect())
    assert batch(index=index) == batch()
    merged = index.merge()
    before = {r["folder"] for r in index.runs()}
    assert sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.postings(now).collect()))
    assert merged == 0 or index.drop_unused() and {r["folder"] for r in index.runs()} == before
    assert index.compact() in (0, 2, 3) and len(index.runs()) == 1 and sorted(map(tuple, index.postings().collect())) == sorted(map(tuple, search.postings(now).collect()))
    for q in ("user fetch", "gt", "get"):
        assert seen(index.search(q, 9, hotspots=hot)) == seen(search.search(now, q, 9, hotspots=hot))


def test_an_upsert_writes_as_much_as_its_batch(spark, tmp_path):
    r = random.Random(5)
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", buckets=4, shelves=2)
    index.upsert(some(spark, r, [f"file:///{i}.ts" for i in range(400)], 6))
    base = index.runs()[0]
    for i in range(4):
        index.upsert(some(spark, r, [f"file:///{i}.ts"], 6), [f"file:///{i}.ts"])
        assert index.runs()[0] == base  # the large run stays as it is
    assert sum(x["rows"] for x in index.runs()[1:]) < 80 and len(index.runs()) <= 4


def test_a_search_reads_the_buckets_of_its_grams(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i", buckets=8, shelves=2)
    index.upsert(some(spark, random.Random(6), [f"file:///{i}.ts" for i in range(60)]))
    rows = index._of(index._table("postings", postings._POSTINGS, index.runs()), {("name", 3, "bol"), ("name", 3, "olt")})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    buckets = {index.bucket("name", g) for g in ("bol", "olt")}
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert {x.bucket for x in rows.select("bucket").distinct().collect()} == buckets
    lists = rows.groupBy("gram").count().collect()
    sizes = index._lengths({("name", 3, "bol"), ("name", 3, "olt"), ("name", 3, "qqq")}, index.runs())
    assert {("name", 3, x.gram): x["count"] for x in lists} == sizes
    assert index.search("qqqq").count() == 0


def test_an_empty_index(spark, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    assert index.search("a").count() == index.search("").count() == index.symbols().count() == index.merge() == 0
    index.remove(["file:///none"])
    assert index.search("a").count() == 0


def test_commits_are_whole_and_in_turn(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    assert log.latest() == (0, {}) and log.versions() == []
    assert log.commit(0, {"a": "ü"}) == 1
    with pytest.raises(StaleVersion):
        log.commit(0, {"a": "other"})
    assert log.latest() == (1, {"a": "ü"})
    assert log.commit(1, {"a": 2}) == 2 and log.read(1) == {"a": "ü"} and log.versions() == [1, 2]
    (tmp_path / "log" / "_log" / ".half").write_text('{"a"')  # a writer that died before its commit
    assert log.latest() == (2, {"a": 2})
