import pytest

from symlens.functions.schema import EDGES, SYMBOLS, kind_id, kind_name, symbol_id
from symlens.operators import graph
from symlens.operators.search import postings
from symlens.operators.store import SymbolStore, rooted, stats_by_root
from symlens.sources import snapshot
from symlens.sources.commits import CommitLog
from pyspark.sql import functions as F
from tests.test_search import rows


def store(spark, items):
    return SymbolStore.empty(spark).upsert_symbols(rows(spark, items))


def edge(spark, *items):
    return spark.createDataFrame([(a, b, k, "file:///e", line, 0, seq) for seq, (a, b, k, line) in enumerate(items)], EDGES)


def test_golden_id(spark):
    place = [F.lit(x) for x in (1, 2, 3, 4)]
    got = spark.range(1).select(symbol_id(F.lit("file:///a.lua"), F.lit("myFunc"), F.lit(12), *place)).first()[0]
    assert got == "e6dcfd67ab45e643c39441bbbaab6b9ea91fc959a4f47de587f73219aed91ab2"


def test_upsert_replaces_a_uri_and_first_duplicate_wins(spark):
    s = store(spark, [("foo", 12, None, "file:///a"), ("bar", 12, None, "file:///a"), ("foo", 12, "later", "file:///a")])
    assert s.symbols.count() == 2 and s.symbols.filter("name = 'foo'").first().container_name is None
    s = s.upsert_symbols(rows(spark, [("baz", 12, None, "file:///a")]))
    assert [r.name for r in s.symbols.collect()] == ["baz"]
    assert s.upsert_symbols(s.symbols.limit(0), ["file:///a"]).symbols.count() == 0


def test_remove_and_lookup(spark):
    s = store(spark, [("foo", 12, None, "file:///a"), ("bar", 12, None, "file:///b")])
    ids = [r.symbol_id for r in s.symbols.collect()]
    assert s.get_symbols([*ids, "missing"]).count() == 2 and s.get_symbols(spark.createDataFrame([(ids[0],)], "symbol_id string")).count() == 1
    assert s.remove_uris(["file:///absent"]).symbols.count() == 2 and s.remove_uris(["file:///a", "file:///b"]).stats().first().symbol_count == 0


def test_postings_follow_the_table(spark):
    grams = lambda s: {r.gram for r in postings(s.symbols).collect()}
    s = store(spark, [("formatDate", 12, "Utils", "file:///a")])
    assert {"for", "or", "f", "uti"} <= grams(s)
    s = s.upsert_symbols(rows(spark, [("parseUser", 12, "Api", "file:///a")]))
    assert not {"for", "or", "f", "uti"} & grams(s) and {"par", "pa", "p", "api"} <= grams(s)


def test_stats_by_prefix(spark):
    s = store(spark, [("funcA1", 12, None, "file:///repo_a/main"), ("funcA2", 12, None, "file:///repo_a/main"), ("utilA", 12, None, "file:///repo_a/util"), ("funcB", 12, None, "file:///repo_b/main")])
    s = s.set_hotspots(spark.createDataFrame([("file:///repo_a/main", 1.0), ("file:///repo_b/main", 1.0)], "uri string, score double"))
    roots = spark.createDataFrame([(x, f"file:///repo_{x}/") for x in "abc"], "name string, uri_prefix string")
    assert {tuple(r) for r in s.stats_by_root(roots).collect()} == {("a", 3, 2, 1), ("b", 1, 1, 1), ("c", 0, 0, 0)}
    assert {r.root for r in rooted(s.symbols, roots, F.col("uri")).collect()} == {"a", "b"}


def test_edges(spark):
    s = SymbolStore.empty(spark).upsert_edges(edge(spark, ("a", "b", "call", 10), ("a", "b", "call", 42), ("a", "c", "call", 1), ("b", "d", "reference", 1)))
    assert s.edges.count() == 3 and s.edges.filter("callee_symbol_id = 'b'").first().evidence_line == 42
    s = s.upsert_edges(edge(spark, ("a", "b", "call", 7)))
    assert s.outgoing(["a"]).count() == 2 and s.incoming(["b"]).first().evidence_line == 7 and s.outgoing(["d"]).count() == 0
    assert s.clear_edges().edges.count() == 0 and s.clear().edges.count() == 3


def test_affected_reaches_three_hops(spark):
    chain = edge(spark, *[(chr(98 + i), chr(97 + i), "call", 0) for i in range(5)], ("a", "c", "import", 0))
    seeds = spark.createDataFrame([("a",)], "symbol_id string")
    assert {tuple(r) for r in graph.affected(chain, seeds).collect()} == {("b", 1), ("c", 2), ("d", 3)}


def test_call_graph_sums_counts(spark):
    items = spark.createDataFrame([("center", "t", "target", 12, None, "file:///t", 10, 0, 1), ("incoming", "c", "caller", 12, None, "file:///c", 20, 3, 2), ("incoming", "c", "caller", 12, None, "file:///c", 20, 3, None), ("reference", "r", "ref", 0, None, "file:///r", 30, 1, 1)], "section string, symbol_id string, name string, kind long, container_name string, uri string, start_line long, start_char long, n int")
    view = graph.call_graph(items)
    assert [(r.section, r.edge_count) for r in view.collect()] == [("center", 1), ("incoming", 3), ("reference", 1)]
    assert {r.section: r.n for r in graph.section_counts(view).collect()} == {"center": 1, "incoming": 1, "reference": 1}
    assert [r.section for r in graph.filter_view(view, "CALLER").collect()] == ["center", "incoming"]
    h = graph.History()
    for x in "abc":
        h.push(x)
    assert (h.back(), h.back(), h.back(), h.current) == ("b", "a", None, "a")
    h.push("z")
    assert h.items == ["a", "z"]


def test_snapshots(spark, tmp_path):
    s = store(spark, [("foo", 12, None, "file:///repo_a/x"), ("bar", 5, None, "file:///repo_b/y")])
    ids = {r.name: r.symbol_id for r in s.symbols.collect()}
    s = s.upsert_edges(edge(spark, (ids["foo"], ids["bar"], "call", 1), ("x", "y", "call", 1))).set_hotspots(spark.createDataFrame([("file:///repo_a/x", 0.8), ("file:///repo_b/y", 0.3)], "uri string, score double"))
    path = f"file://{tmp_path}/all"
    assert not snapshot.exists(spark, path)
    for _ in range(2):
        s.save(path)
    loaded = SymbolStore.load(spark, path)
    assert tuple(loaded.stats().first()) == (2, 2, 2, 2)
    s.save(f"{path}-a", "file:///repo_a/")
    part = SymbolStore.load(spark, f"{path}-a")
    assert tuple(part.stats().first()) == (1, 1, 1, 1)
    merged = store(spark, [("old", 12, None, "file:///repo_a/x"), ("own", 12, None, "file:///repo_c/z")]).merge(f"{path}-a")
    assert {r.name for r in merged.symbols.collect()} == {"foo", "own"}
    assert snapshot.copy(spark, path, f"{path}-cache") and not snapshot.copy(spark, f"{path}-none", f"{path}-x")
    a, b = snapshot.scoped_path("/c", "/w/my proj", "/w/tree1"), snapshot.scoped_path("/c", "/w/my proj", "/w/tree2")
    assert a.split("/")[2] == b.split("/")[2] and a != b and "my_proj-" in a


def test_other_versions_are_refused(spark, tmp_path):
    CommitLog(spark, f"file://{tmp_path}/s").commit(0, {"version": 9, "tables": {}})
    with pytest.raises(ValueError, match="version"):
        SymbolStore.load(spark, f"file://{tmp_path}/s")
    with pytest.raises(FileNotFoundError):
        SymbolStore.load(spark, f"file://{tmp_path}/none")


def test_only_changed_parts_of_a_snapshot_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = spark.range(500).select(F.concat(F.lit("file:///f"), F.col("id").cast("string")).alias("uri"), (F.col("id") / 7).alias("score"))
    assert snapshot.write(spark, path, {"hotspots": rows}) == 16
    assert snapshot.write(spark, path, {"hotspots": rows.repartition(3).orderBy("score")}) == 0  # the order of rows is no change
    moved = rows.withColumn("score", F.when(F.col("uri") == "file:///f3", 9.0).otherwise(F.col("score")))
    assert snapshot.write(spark, path, {"hotspots": moved}) == 1
    assert sorted(snapshot.read(spark, path)["hotspots"].collect()) == sorted(moved.collect())
    assert snapshot.copy(spark, path, f"{path}-b") and snapshot.drop_unused(spark, path) == []
    assert snapshot.write(spark, path, {"hotspots": moved.filter("score < 0")}) == 0 and snapshot.read(spark, path)["hotspots"].count() == 0
    assert len(snapshot.drop_unused(spark, path)) == 2 and snapshot.read(spark, f"{path}-b")["hotspots"].count() == 500


def test_a_crash_before_the_commit_leaves_the_snapshot(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([("u", 1.0)], "uri string, score double")
    snapshot.write(spark, path, {"hotspots": rows})
    for step in ("_digests", "CommitLog.commit", "CommitLog._at"):
        with monkeypatch.context() as m:
            owner, name = (CommitLog, step.split(".")[1]) if "." in step else (snapshot, step)
            m.setattr(owner, name, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                snapshot.write(spark, path, {"hotspots": rows.withColumn("score", F.lit(2.0))})
        assert snapshot.read(spark, path)["hotspots"].first().score == 1.0
    snapshot.write(spark, path, {"hotspots": rows.withColumn("score", F.lit(2.0))})
    assert snapshot.read(spark, path)["hotspots"].first().score == 2.0


def test_roots_are_found_by_prefix(spark):
    """10^5 nested and neighbouring roots; no pair of a row and a root is tried."""
    n = 100_000
    roots = spark.range(n).select(F.concat(F.lit("r"), "id").alias("name"), F.concat(F.lit("file:///"), F.col("id") % 300, F.lit("/"), F.when(F.col("id") >= 300, F.concat("id", F.lit("/"))).otherwise("")).alias("uri_prefix"))
    files = spark.range(2000).select(F.concat(F.lit("file:///"), F.col("id") % 300, F.lit("/"), "id", F.lit("/x.ts")).alias("uri"))
    got = rooted(files, roots, F.col("uri"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for r in got.collect():
        a, b = r.uri.split("/")[3:5]
        assert r.root == ("r" + b if int(b) >= 300 else "r" + a)
    few = spark.createDataFrame([("all", ""), ("twin", "file:///1/"), ("two", "file:///1/"), ("none", "x"), ("null", None)], "name string, uri_prefix string")
    assert {r.root for r in rooted(files, few, F.col("uri")).collect()} == {"all", "two"}
    assert rooted(files, few.limit(0), F.col("uri")).filter("root IS NULL").count() == 2000
    counts = stats_by_root(files.select(F.col("uri").alias("request_uri")), spark.createDataFrame([("file:///1/a", 0.5)], "uri string, score double"), few)
    assert {tuple(r) for r in counts.collect()} == {("all", 2000, 2000, 1), ("twin", 7, 7, 1), ("two", 7, 7, 1), ("none", 0, 0, 0), ("null", 0, 0, 0)}


def test_kind_names(spark):
    got = spark.createDataFrame([(12,), (999,), (0,)], "k long").select(kind_name(F.col("k"))).collect()
    assert [r[0] for r in got] == ["Function", "Unknown", "Unknown"]
    back = spark.createDataFrame([("Function",), ("unknown",), ("7",)], "k string").select(kind_id(F.col("k"))).collect()
    assert [r[0] for r in back] == [12, 0, 7]
    assert len(SYMBOLS.split(", ")) == 15
