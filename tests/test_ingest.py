import json
import subprocess

import pytest
from pyspark.sql import functions as F

from symlens.functions import config, schema
from symlens.operators import graph, ingest, roots
from symlens.operators.store import SymbolStore
from symlens.sources import git, lsp, tree
from symlens.streaming.ingest import ProgressLog

SYMBOL = "uri string, name string, kind long, start_line long, start_char long, end_line long, end_char long, container_name string, ord long"


def symbols(spark, *names):
    return spark.createDataFrame([(u, n, 12, 0, 0, 1, 0, None, i) for i, (u, n) in enumerate(names)], SYMBOL)


def test_server_answers_come_before_trees(spark):
    files = [(f"file:///{x}.lua", True, "", "lua", True) for x in "abcde"] + [("file:///x.lua", True, "terminal", "lua", True), ("untitled:y", True, "", "lua", True)]
    manifest = spark.createDataFrame([*files, files[0]], "uri string, valid boolean, buftype string, filetype string, is_file boolean")
    answers = spark.createDataFrame([("file:///a.lua", True), ("file:///b.lua", True), ("file:///c.lua", False), ("file:///x.lua", True)], "uri string, ok boolean")
    server = symbols(spark, ("file:///a.lua", "from_server"), ("file:///c.lua", "lost"), ("file:///x.lua", "skipped"))
    trees = symbols(spark, *[(f"file:///{x}.lua", "from_tree") for x in "abcd"])
    got = ingest.index_files(manifest, answers, server, trees)
    status = {r.uri: (r.status, r.method, r.symbol_count) for r in got.status.collect()}
    assert status == {
        "file:///a.lua": ("indexed", "lsp", 1), "file:///b.lua": ("empty", "lsp", 0), "file:///c.lua": ("indexed", "treesitter", 1), "file:///d.lua": ("indexed", "treesitter", 1),
        "file:///e.lua": ("empty", "treesitter", 0), "file:///x.lua": ("skipped", None, 0), "untitled:y": ("skipped", None, 0),
    }
    assert tuple(got.summary.first()) == (5, 3, 2, 0, 2)
    old = ingest.upsert_files(SymbolStore.empty(spark), ingest.index_files(manifest, answers, symbols(spark, ("file:///b.lua", "gone")), symbols(spark, ("file:///old.lua", "old"))))
    old = old.upsert_symbols(symbols(spark, ("file:///old.lua", "old")).selectExpr("*", "uri AS request_uri", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (("symbol_id", "string"), ("detail", "string"), ("cyclomatic_complexity", "long"), ("lines_of_code", "long"), ("nesting_depth", "long"))]).select(*old.symbols.columns))
    names = lambda s: sorted((r.uri[8:-4], r.name) for r in s.symbols.collect())
    assert names(old) == [("b", "gone"), ("old", "old")]
    assert names(ingest.upsert_files(old, got)) == [("a", "from_server"), ("c", "from_tree"), ("d", "from_tree"), ("old", "old")]
    assert names(ingest.upsert_files(old, got, again=True)) == [("a", "from_server"), ("c", "from_tree"), ("d", "from_tree")]
    here = old.symbols.selectExpr("request_uri AS uri").limit(0)
    assert names(ingest.upsert_files(old, got, again=True, session=here)) == names(ingest.upsert_files(old, got))


def test_answers_of_any_depth(spark):
    point = lambda n: {"start": {"line": n, "character": 0}, "end": {"line": n, "character": 5}}
    node = {"name": "n20", "kind": 12, "range": point(20)}
    for n in reversed(range(20)):
        node = {"name": f"n{n}", "kind": 5, "range": point(n), "children": [node]}
    flat = [{"name": "f", "kind": 12, "containerName": "C", "location": {"uri": "file:///f", "range": point(1)}}, {"name": None, "location": {}}]
    rows = [("file:///d", json.dumps([node])), ("file:///e", json.dumps(flat)), ("file:///g", None), ("file:///h", "[]")]
    got = lsp.flatten_json(spark.createDataFrame(rows, "uri string, value string")).collect()
    assert [(r.name, len(r.path)) for r in got if r.uri == "file:///d"] == [(f"n{n}", n + 1) for n in range(21)]
    assert [(r.name, r.container_name) for r in got if r.uri != "file:///d"] == [("f", "C")]
    same = lsp.flatten_documents(spark.createDataFrame([("file:///d", [{"name": "n20", "kind": 12, "range": point(20)}])], lsp.document_schema(1))).first()
    assert same.symbol_id in {r.symbol_id for r in got}


@pytest.fixture
def repository(tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "old.lua").write_text("function a()\nend\n")
    (tmp_path / "b.lua").write_text("1\n2\n3\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "src" / "old.lua").unlink()
    (tmp_path / "b.lua").write_text("1\n")
    run("commit", "-qam", "two")
    return tmp_path


def test_base_files_and_their_symbols(spark, repository):
    asked = spark.createDataFrame([(str(repository), p) for p in ("src/old.lua", "never.lua", "src", "a\nb", None)] + [("/nowhere", "b.lua")], "root string, path string")
    got = git.base_files(asked, "HEAD~1").collect()
    assert [(r.path, r.value, r.uri) for r in got] == [("src/old.lua", "function a()\nend\n", f"file://{repository}/src/old.lua")]
    nodes = spark.createDataFrame([(got[0].uri, 1, "function_declaration", "a", 0, 1, 3), (got[0].uri, 2, "variable_declarator", "v", 0, 1, 3)], "file string, node_id long, type string, name string, start_line long, end_line long, end_char long")
    assert [r.name for r in tree.tree_symbols(nodes, for_diff=True).collect()] == ["a"]


def test_hotspots_of_each_root(spark, repository):
    options = config.DEFAULTS["hotspots"]
    for churn in (True, False):
        got = {r.uri.rsplit("/", 1)[1]: r.score for r in roots.root_hotspots(spark, [str(repository), "/nowhere"], {**options, "use_churn": churn}).collect()}
        assert set(got) == {"old.lua", "b.lua"} and max(got.values()) == 1.0
    assert roots.root_hotspots(spark, [], options).count() == 0


def test_logs_are_read_by_tasks(spark, repository, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    run = lambda *a: subprocess.run(["git", "-C", str(other), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(7):
        (other / f"f{i % 3}.lua").write_text("x\n" * (i + 1))
        run("add", ".")
        run("commit", "-qm", str(i))
    roots_ = [str(repository), str(other), "/nowhere", str(tmp_path_factory.mktemp("none"))]
    lines = git.log_lines(spark, roots_, ["--numstat", "--format=%ct"], commits=2)
    assert lines.rdd.getNumPartitions() == 1 + 4 + 2  # slices of two commits, and a row for each root that fails
    failed = lines.filter("line IS NULL").collect()
    assert {r.root for r in failed} == set(roots_[2:]) and all(r.error for r in failed)
    for root in roots_[:2]:
        whole = git.run_git(root, ["log", "--numstat", "--format=%ct"]).splitlines()
        read = [r.line for r in lines.filter(lines.root == root).orderBy("line_no").collect()]
        assert [x for x in read if x] == [x for x in whole if x]
    assert git.parse_numstat(lines).filter("commit_time IS NULL").count() == 0 and git.parse_numstat(lines).count() == 3 + 2 + 7 - 1
    assert git.numstat_log(spark, []).count() == 0


def test_a_bad_answer_leaves_the_others_alone(spark):
    rows = [("a", '[{"name": "f", "kind": 12, "range": {"start": {"line": 1}}}]'), ("b", '[{"name"'), ("c", '{"name": 1}'), ("d", None), ("e", " []"), ("f", '[1, {"name": "g", "range": {}, "children": [2]}]')]
    table = spark.createDataFrame(rows, "uri string, value string")
    assert {(r.uri, r.name) for r in lsp.flatten_json(table).collect()} == {("a", "f"), ("f", "g")}
    assert {r.uri for r in lsp.readable(table).filter("ok").collect()} == {"a", "e", "f"}
    manifest = table.selectExpr("'file:///' || uri AS uri", "true AS valid", "'' AS buftype", "'ts' AS filetype", "true AS is_file")
    at = lambda df: df.withColumn("uri", F.concat(F.lit("file:///"), "uri"))
    tree_rows = at(table.select("uri")).selectExpr("'t' AS name", "uri", "12L AS kind")
    run = ingest.index_files(manifest, at(lsp.readable(table)), at(lsp.flatten_json(table)).select("name", "uri", "kind"), tree_rows, parsed=spark.createDataFrame([("file:///c", False), ("file:///d", True), ("file:///a", False)], "uri string, ok boolean"))
    assert {(r.uri[-1], r.status, r.method) for r in run.status.collect()} == {("a", "indexed", "lsp"), ("b", "indexed", "treesitter"), ("c", "error", "treesitter"), ("d", "indexed", "treesitter"), ("e", "empty", "lsp"), ("f", "indexed", "lsp")}
    assert run.summary.first().failed_count == 1


def test_registry_and_snapshots_of_roots(spark, repository, tmp_path_factory):
    held = roots.Roots()
    assert held.register(f"file://{repository}/src/old.lua") == str(repository) and held.register(f"file://{repository}/b.lua") == str(repository)
    assert held.register("untitled:x") is None and held.listing() == [str(repository)]
    held.clear()
    assert held.listing() == []
    store = SymbolStore.empty(spark)
    manifest = spark.createDataFrame([(f"file:///{r}/x.lua", True, "", "lua", True) for r in "ab"], "uri string, valid boolean, buftype string, filetype string, is_file boolean")
    store = ingest.upsert_files(store, ingest.index_files(manifest, spark.createDataFrame([], "uri string, ok boolean"), symbols(spark), symbols(spark, ("file:///a/x.lua", "one"), ("file:///b/x.lua", "two"))))
    base = tmp_path_factory.mktemp("snapshots")
    place, remote = lambda root: f"{base}{root}/snap", lambda root: f"{base}/remote{root}"
    options = config.validate({"snapshot": {"remote_cache": {"enabled": True, "dir": str(base)}}})[0]["snapshot"]
    assert roots.save_roots(store, ["/a", "/b"], options, place, remote) == (True, None)
    again, done, error = roots.load_roots(SymbolStore.empty(spark), ["/a", "/missing"], options, place, remote)
    assert (done, error, [r.name for r in again.symbols.collect()]) == (True, None, ["one"])
    assert roots.load_roots(SymbolStore.empty(spark), ["/b"], options, lambda root: f"{base}/new{root}", remote)[0].symbols.first().name == "two"
    bad, done, error = roots.load_roots(store, ["/a"], options, lambda root: 1 / 0)
    assert not done and "division" in error
    assert roots.save_roots(store, ["/a"], {**options, "save_on_exit": False}) == (False, None)
    assert roots.default_path("/a/").startswith("/a/.cache/")
    again.close()


def test_search_parameters_graph_text_and_history(spark):
    options = config.validate({"search": {"limit": 7}})[0]
    assert config.search_params("q", options) == {"q": "q", "limit": 7, "complexity_cap": 50}
    assert config.search_params("q", options, [12])["kinds"] == [12]
    view = spark.createDataFrame([("center", "c", None, "no", "file:///x"), ("incoming", "a", None, "has Needle", "file:///x"), ("outgoing", "b", None, None, "file:///y")], "section string, name string, container_name string, detail string, uri string")
    assert [r.name for r in graph.filter_view(view, "NEEDLE").collect()] == ["c", "a"] and graph.filter_view(view, "").count() == 3
    h = graph.History()
    assert h.refresh(str) is None
    h.push(5)
    assert h.refresh(str) == "5"


def test_ids_are_made_where_missing(spark):
    rows = spark.createDataFrame([("x", "n", None, "file:///a", 1, None, 2, 3), (None, "n", 12, "file:///a", 1, 2, 3, 4)], "symbol_id string, name string, kind long, uri string, start_line long, start_char long, end_line long, end_char long")
    got = ingest.with_ids(rows).collect()
    assert got[0].symbol_id == "x" and got[0].kind == 0 and got[0].start_char == 0 and len(got[1].symbol_id) == 64


def test_progress_is_told(spark, tmp_path):
    told = []
    listener = ProgressLog(told.append)
    spark.streams.addListener(listener)
    spark.range(3).write.parquet(f"{tmp_path}/in")
    query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    assert any(x.startswith("started") for x in told) and any("3 rows" in x for x in told)
    assert schema.SYMBOLS
