"""Centred graphs from server answers, and diffs composed from git, answers and trees."""

import json
import subprocess

from pyspark.sql import functions as F

from symlens.functions import render
from symlens.functions.schema import symbol_id
from symlens.operators import diff, graph
from symlens.sources import git
from tests.test_search import rows


def span(a, b=0, c=None, d=0):
    return {"start": {"line": a, "character": b}, "end": {"line": a if c is None else c, "character": d}}


def test_graphs_of_answers(spark):
    centers = rows(spark, [("mid", 12, "Box", "file:///m"), ("alone", 12, None, "file:///z")])
    ids = {r.name: r.symbol_id for r in centers.collect()}
    caller = {"name": "up", "kind": 6, "detail": "D", "uri": "file:///a", "range": span(1, 0, 9), "selectionRange": span(2, 4)}
    incoming = [{"from": caller, "fromRanges": [span(5, 1), span(6, 2)]}, {"from": caller, "fromRanges": [span(7, 3)]}, {"from": {**caller, "uri": ""}}, {"from": None}, {"to": caller}]
    outgoing = {"to": {"uri": "file:///b", "range": span(3, 1, 8)}}  # one call instead of a list, without a name
    refs = [{"uri": "file:///r%20x", "range": span(4, 2)}, {"targetUri": "http://h/p", "targetSelectionRange": span(0, 0)}, {"uri": "file:///n"}, {"uri": "file:///r%20x", "range": span(4, 2)}]
    said = [(ids["mid"], "prepare", json.dumps([{"name": "mid"}])), (ids["mid"], "incoming", json.dumps(incoming)), (ids["mid"], "outgoing", json.dumps(outgoing)), (ids["mid"], "references", json.dumps(refs))]
    said += [(ids["alone"], "prepare", "null"), (ids["alone"], "incoming", json.dumps(incoming)), (ids["alone"], "references", '[{"uri'), ("unknown", "references", json.dumps(refs))]
    answers = spark.createDataFrame(said, "center_id string, method string, value string")
    graphs = graph.centred_graphs(centers, answers)
    mine = [r for r in graphs.view.collect() if r.center_id == ids["mid"]]
    assert [(r.section, r.name, r.container_name, r.edge_count, r.expandable) for r in mine] == [
        ("center", "mid", "Box", 0, True), ("incoming", "up", "D", 3, True), ("outgoing", "<anonymous>", None, 1, True), ("reference", "r x:5:3", "/r x", 2, False), ("reference", "p:1:1", "http://h/p", 1, False),
    ]
    up = spark.range(1).select(symbol_id(F.lit("file:///a"), F.lit("up"), F.lit(6), *map(F.lit, (2, 4, 2, 0)))).first()[0]
    assert mine[1].symbol_id == up and [r.section for r in graphs.view.collect() if r.center_id == ids["alone"]] == ["center"]
    edges = graphs.edges.filter(F.col("callee_symbol_id") == ids["mid"]).select("caller_symbol_id", "edge_kind", "evidence_uri", "evidence_line", "evidence_char")
    assert sorted(tuple(r) for r in edges.filter("edge_kind = 'call'").collect()) == [(up, "call", "file:///a", 5, 1), (up, "call", "file:///a", 6, 2), (up, "call", "file:///a", 7, 3)]
    assert sorted(tuple(r)[1:] for r in edges.filter("edge_kind = 'reference'").collect()) == [("reference", "file:///r%20x", 4, 2)] * 2 + [("reference", "http://h/p", 0, 0)]
    out = graphs.edges.filter(F.col("caller_symbol_id") == ids["mid"]).collect()
    assert [(r.edge_kind, r.evidence_uri, r.evidence_line, r.evidence_char) for r in out] == [("call", "file:///m", 3, 1)]
    index = spark.createDataFrame([("whole", "up", "file:///a", 1, 9), ("wide", "up", "file:///a", 0, 99), ("other", "down", "file:///a", 2, 2)], "symbol_id string, name string, uri string, start_line long, end_line long")
    assert {r.symbol_id for r in graph.centred_graphs(centers, answers, index).items.filter("section = 'incoming'").collect()} == {"whole"}
    none = graph.centred_graphs(centers, answers.limit(0))
    assert none.items.count() == 2 and none.edges.count() == 0


def test_an_item_that_is_a_symbol_is_not_a_smaller_one_around_its_start(spark):
    place = "start_line long, start_char long, end_line long, end_char long"
    spots = spark.createDataFrame([("f", 12, "file:///a", 2, 0, 9, 0), ("f", 12, "file:///a", 1, 0, 3, 0), ("main", 12, "file:///m", 0, 0, 9, 0)], f"name string, kind long, uri string, {place}")
    symbols = spots.withColumns({"symbol_id": symbol_id(F.col("uri"), F.col("name"), F.col("kind"), *map(F.col, place.replace(" long", "").split(", "))), "container_name": F.lit(None).cast("string")})
    ids = {r.start_line: r.symbol_id for r in symbols.collect()}
    item = lambda *place: {"name": "f", "kind": 12, "uri": "file:///a", "selectionRange": span(*place)}
    incoming = json.dumps([{"from": item(2, 0, 9), "fromRanges": [span(5, 1)]}, {"from": item(2, 4), "fromRanges": [span(6, 1)]}])
    answers = spark.createDataFrame([(ids[0], "prepare", json.dumps([{"name": "main"}])), (ids[0], "incoming", incoming)], "center_id string, method string, value string")
    twice = symbols.union(symbols)  # rows of one id are one centre
    for centers in (symbols, twice):
        edges = graph.centred_graphs(centers, answers, centers).edges
        assert sorted((r.caller_symbol_id, r.evidence_line) for r in edges.collect()) == sorted([(ids[2], 5), (ids[1], 6)])


def test_graph_text(spark):
    head = render.graph_head(["a", "b"], *[F.lit(n) for n in (1, 0, 3)]) + render.graph_head([], *[F.lit(0)] * 3)[:1] + [render.section_head(F.lit("incoming"), F.lit(2)), render.section_head(F.lit("odd"), F.lit(0))]
    assert list(spark.range(1).select(*[h.alias(str(i)) for i, h in enumerate(head)]).first()) == [" Path (2/2): a > b", " Callers: 1 | Callees: 0 | Refs: 3", " Call Graph", " Callers (2)", " odd (0)"]


def test_a_diff_from_git_answers_and_trees(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("a.ts", "b c.ts", "gone.ts"):
        (tmp_path / name).write_text("1\n2\n3\n4\n5\n6\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a.ts").write_text("1\n2\nX\n4\n5\n6\n")
    (tmp_path / "b c.ts").write_text("1\n2\n3\n4\n5\n6\n7\n")
    (tmp_path / "new.ts").write_text("n\n")
    (tmp_path / "gone.ts").unlink()
    run("add", "-A")
    (tmp_path / "a.ts").write_text("later\n")  # not staged
    uri = lambda name: f"file://{tmp_path}/{name}"
    range_ = lambda a, b: {"start": {"line": a, "character": 0}, "end": {"line": b, "character": 1}}
    symbols = [{"name": "hit", "kind": 12, "range": range_(1, 3)}, {"name": "miss", "kind": 12, "range": range_(4, 5)}]
    answers = spark.createDataFrame([(uri("a.ts"), json.dumps(symbols)), (uri("new.ts"), "{bad"), (uri("gone.ts"), json.dumps(symbols)), ("file:///other", json.dumps(symbols))], "uri string, value string")
    node = "file string, node_id long, type string, name string, start_line long, end_line long, end_char long"
    nodes = spark.createDataFrame([(uri("new.ts"), 1, "function_declaration", "fresh", 0, 1, 0), (uri("new.ts"), 2, "variable_declarator", "v", 0, 1, 0), (uri("b%20c.ts"), 3, "class_declaration", "Last", 6, 6, 0), (uri("a.ts"), 4, "class_declaration", "Tree", 0, 9, 0)], node)
    base = spark.createDataFrame([(uri("gone.ts"), 1, "function_declaration", "old", 0, 5, 0), (uri("a.ts"), 2, "function_declaration", "before", 0, 5, 0)], node)
    got = diff.analyze_roots(spark, [str(tmp_path), "/nowhere"], answers, nodes, base, staged=True)
    assert (got.base, got.head) == ("HEAD", "staged")
    assert {(r.name, r.change_type, tuple(r.changed_lines)) for r in got.symbols.collect()} == {("hit", "modified", (2,)), ("Last", "modified", (6,)), ("fresh", "added", ()), ("old", "deleted", ())}
    stats = got.stats.first()
    assert (stats.files_added, stats.files_modified, stats.files_deleted, stats.symbols_modified) == (1, 2, 1, 2)
    files, ranges = git.diff_of(spark, [str(tmp_path)], diff.diff_arguments())
    assert {(r.repo_path, r.first, r.last) for r in ranges.collect()} >= {("a.ts", 0, 0), ("b c.ts", 6, 6), ("new.ts", 0, 0)} and files.count() == 4
