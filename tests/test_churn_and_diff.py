import math

import pytest
from pyspark.sql import functions as F

from symlens.functions import config
from symlens.functions import exprs as E
from symlens.functions import render
from symlens.operators import diff, hotspots, metrics
from symlens.sources import git, lsp, tree
from tests.test_search import rows
from tests.test_store import edge

FIXTURE = "1730000000\n10\t2\tsrc/foo.lua\n-\t-\tbinary.dat\n1720000000\n2\t0\tsrc/bar.lua"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lines(spark, text, root="/repo"):
    return spark.createDataFrame([(root, i, x) for i, x in enumerate(text.split("\n"))], git.LINE)


def test_log_to_scores(spark, tmp_path):
    (tmp_path / "log").write_text(FIXTURE)
    parsed = git.parse_numstat(git.read_log(spark, {"/repo": f"file://{tmp_path}/log"}))
    scores = {r.path: r.score for r in hotspots.churn_scores(parsed, 1730000000).collect()}
    assert scores["src/foo.lua"] == 13.0 and scores["src/foo.lua"] > scores["src/bar.lua"] > 0 and scores["binary.dat"] == 0
    norm = {r.uri: r.score for r in hotspots.to_uris(hotspots.normalize(hotspots.churn_scores(parsed, 1730000000), 2)).collect()}
    assert norm == {"file:///repo/src/foo.lua": 1.0, "file:///repo/src/bar.lua": pytest.approx(scores["src/bar.lua"] / 13)}
    names = git.parse_names(lines(spark, "a\n\nb\na\n"))
    assert {r.path: r.score for r in hotspots.commit_scores(names).collect()} == {"a": 2.0, "b": 1.0}
    small = hotspots.normalize(spark.createDataFrame([("/r", "a", 0.4)], "root string, path string, score double"))
    assert small.first().score == 0.4 and git.read_log(spark, {}).count() == 0


def test_a_long_log_is_read_in_splits_and_dated_in_blocks(spark, tmp_path, monkeypatch):
    from pyspark.sql import Window

    monkeypatch.setattr(git, "BLOCK_LINES", 1000)
    text = "".join(f"{1700000000 + i}\n" if i % 40 == 0 else f"{i % 7}\t-\tsrc/f{i % 90}.ts\r\n" if i % 3 else "\n" for i in range(60_000))
    (tmp_path / "log").write_text("9\t1\tearly.ts\n" + text)
    keys = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        read = git.read_log(spark, {"/repo": f"file://{tmp_path}/log"})
        assert [(r.line_no, r.line.rstrip("\r")) for r in read.orderBy("line_no").collect()] == list(enumerate(("9\t1\tearly.ts\n" + text).replace("\r", "").split("\n")[:-1]))
        parsed = git.parse_numstat(read)
        assert parsed.select(F.spark_partition_id()).distinct().count() > 4  # one root, many tasks
        order = Window.partitionBy("root").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        plain = read.withColumn("t", F.last(F.when(F.col("line").rlike("^[0-9]+$"), F.col("line").cast("long")), ignorenulls=True).over(order)).filter("line LIKE '%src%' OR line LIKE '%early%'")
        assert sorted((r.line_no, r.commit_time) for r in parsed.collect()) == sorted((r.line_no, r.t) for r in plain.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_formulas(spark):
    now = 1_700_000_000
    assert one(spark, E.decay(F.lit(now), now)) == 1.0 and one(spark, E.decay(F.lit(now - 30 * 86400), now)) == pytest.approx(0.5)
    assert one(spark, E.churn(F.lit(10), F.lit(5))) == 17.5
    score = lambda kind, a, b, h: one(spark, E.impact_score(F.lit(kind), F.lit(a), F.lit(b), F.lit(h)))
    assert score("added", 10, 10, 1.0) == pytest.approx(2.2) and score("renamed", 0, 0, 0.0) == 0.5
    assert [round(score("added", n, 0, 0.0) - 1, 9) for n in (1, 5, 10, 100)] == [0.05, 0.25, 0.5, 0.5]
    assert one(spark, E.estimated_debt(F.lit(50))) is None and one(spark, E.estimated_debt(F.lit(51))) == 0.51
    assert one(spark, E.hotspot_factor(F.lit(float("nan")))) == 1.0 and one(spark, E.hotspot_factor(F.lit(9.0))) == pytest.approx(1.15)
    assert one(spark, E.uri_path(E.file_uri(F.lit("/a b/ü+.lua")))) == "/a b/ü+.lua"


def test_ngrams_and_subsequences(spark):
    assert one(spark, E.ngrams(F.lit("aaab🙂"), 2)) == ["aa", "ab", "b🙂"] and one(spark, E.ngrams(F.lit("ab"), 3)) == [] and one(spark, E.ngrams(F.lit(""), 1)) == []
    rows_ = spark.createDataFrame([("format", "fmt"), ("format", "tf"), ("a.b", "ab"), ("", "a"), ("aab", "aaa")], "t string, q string")
    assert [r[0] for r in rows_.select(E.is_subsequence(F.col("t"), F.col("q"))).collect()] == [True, False, True, False, False]
    assert E.token_grams("aaaa") == (3, ["aaa"]) and E.token_grams("x") == (1, ["x"])


def test_top_symbols(spark):
    s = rows(spark, [("MyClass", 5, None, "file:///a"), ("myVar", 13, None, "file:///a"), ("myFunc", 12, None, "file:///a"), ("high", 12, None, "file:///b", 20), ("low", 12, None, "file:///b", 1)])
    hot = spark.createDataFrame([("file:///a", 0.8)], "uri string, score double")
    out = hotspots.top_symbols(s, hot).collect()
    assert [r.name for r in sorted(out, key=lambda r: r["rank"]) if r.uri == "file:///a"] == ["myFunc", "MyClass", "myVar"]
    assert [r.name for r in sorted(out, key=lambda r: r["rank"]) if r.uri == "file:///b"] == ["high", "low"]
    assert hotspots.top_symbols(s, hot, 2, uri="file:///a").count() == 2


def test_diff_text(spark):
    files = git.parse_name_status(lines(spark, "A\ta.lua\nM\tb.lua\nD\tc.lua\nR100\told.lua\tnew.lua\nC90\tsrc.lua\tcopy.lua\nT\tx\n"))
    assert [(r.repo_path, r.change_type, r.old_repo_path) for r in files.collect()] == [("a.lua", "added", None), ("b.lua", "modified", None), ("c.lua", "deleted", None), ("new.lua", "renamed", "old.lua"), ("copy.lua", "added", None)]
    hunks = git.parse_hunks(lines(spark, "@@ -10,5 +10,7 @@\n@@ -1 +3 @@\n@@ -4,2 +3,0 @@"))
    assert [(r["first"], r["last"]) for r in hunks.collect()] == [(9, 15), (2, 2)]
    with pytest.raises(ValueError, match="--head requires --base"):
        diff.diff_arguments(head="x")
    assert diff.diff_arguments(base="main", head="x") == ["main...x"] and diff.diff_arguments(base="HEAD", head="x") == ["HEAD"] and diff.diff_arguments(staged=True) == ["--cached"]


def test_impact(spark):
    s = rows(spark, [("changed", 12, None, "file:///a"), ("callerA", 12, None, "file:///b"), ("callerB", 12, None, "file:///c"), ("gone", 12, None, "file:///d"), ("fresh", 12, None, "file:///e")])
    ids = {r.name: r.symbol_id for r in s.collect()}
    edges = edge(spark, (ids["callerA"], ids["changed"], "call", 0), (ids["callerB"], ids["callerA"], "call", 0), ("outside", ids["callerB"], "call", 0))
    hot = spark.createDataFrame([("file:///a", 0.8), ("file:///b", 0.4)], "uri string, score double")
    files = spark.createDataFrame([("file:///a", "modified"), ("file:///d", "deleted"), ("file:///e", "renamed")], "uri string, change_type string")
    ranges = spark.createDataFrame([("file:///a", 0, 3), ("file:///a", 50, 60)], "uri string, first long, last long")
    found = diff.analyze(files, ranges, s)
    assert {(r.name, r.change_type, tuple(r.changed_lines)) for r in found.symbols.collect()} == {("changed", "modified", (0,)), ("gone", "deleted", ()), ("fresh", "added", ())}
    assert tuple(found.stats.first()) == (0, 1, 1, 1, 1, 1, 1) and found.head == "working"
    ranked = {r.name: r for r in diff.risk_ranking(found.symbols, edges, s, hot).collect()}
    assert ranked["callerA"].impact_score == pytest.approx(0.2) and ranked["callerB"].impact_score == 0 and ranked["callerB"].change_type == "affected"
    assert ranked["changed"].impact_score == pytest.approx(0.8 * (1 + 0.05 + 0.32)) and len(ranked) == 5


def test_metrics_of_nested_sets(spark):
    node = lambda sid, kind, a, b, s=0, e=0, lang="lua", ops=(): (sid, lang, kind, list(ops), a, b, s, e)
    nodes = [node("simple", "function_declaration", 1, 4, 0, 2), node("simple", "return_statement", 2, 3)]
    nodes += [node("with_if", "function_declaration", 1, 4, 0, 5), node("with_if", "if_statement", 2, 3)]
    nodes += [node("nested", "function_declaration", 1, 12, 0, 9), node("nested", "if_statement", 2, 11), node("nested", "for_statement", 3, 8), node("nested", "if_statement", 4, 5), node("nested", "return_statement", 9, 10)]
    nodes += [node("logic", "function_item", 1, 10, 3, 3, "rust"), node("logic", "binary_expression", 2, 3, lang="rust", ops=["&&"]), node("logic", "binary_expression", 4, 5, lang="rust", ops=["+"]), node("logic", "match_arm", 6, 7, lang="rust")]
    frame = spark.createDataFrame(nodes, "symbol_id string, lang string, type string, operators array<string>, lft long, rgt long, start_line long, end_line long")
    got = {r.symbol_id: tuple(r)[1:] for r in metrics.symbol_metrics(frame).collect()}
    assert got == {"simple": (1, 3, 0), "with_if": (2, 6, 1), "nested": (4, 10, 3), "logic": (3, 1, 0)}


def test_ingest(spark):
    leaf = {"name": "f", "kind": 12, "detail": None, "range": {"start": {"line": 1, "character": 2}, "end": {"line": 3, "character": 4}}, "selectionRange": None}
    parent = {**leaf, "name": "C", "kind": 5, "range": None, "selectionRange": leaf["range"], "children": [{**leaf, "children": []}]}
    docs = spark.createDataFrame([("file:///a.lua", [parent])], lsp.document_schema(2))
    assert [(r.name, r.start_line, len(r.path)) for r in lsp.flatten_documents(docs).orderBy("path").collect()] == [("C", 1, 1), ("f", 1, 2)]
    info = spark.createDataFrame([("u", 0, "g", 12, "M", ("file:///b", (((1, 0)), ((2, 0))))), ("u", 1, None, 12, None, None)], lsp.SYMBOL_INFORMATION)
    assert [(r.name, r.container_name, r.uri) for r in lsp.flatten_information(info).collect()] == [("g", "M", "file:///b")]
    assert lsp.is_hierarchical(None) and lsp.is_hierarchical({"range": 1}) and not lsp.is_hierarchical({"location": 1})
    s = rows(spark, [("alpha_func", 12, None, "file:///a")]).withColumn("query", F.lit("a"))
    assert lsp.workspace_symbols(s.union(s.withColumn("query", F.lit("e")))).count() == 1
    nodes = spark.createDataFrame([("file:///a", 1, "interface_declaration", "I", 1, 2, 3), ("file:///a", 2, "class_definition", "C", 1, None, None), ("file:///a", 3, "comment", "x", 1, 2, 3)], "file string, node_id long, type string, name string, start_line long, end_line long, end_char long")
    assert {(r.name, r.kind) for r in tree.tree_symbols(nodes).collect()} == {("I", 23), ("C", 5)} and tree.tree_symbols(nodes, True).count() == 1
    files = spark.createDataFrame([("file:///a", True, "", "lua", True), ("http://x", True, "", "lua", True), ("file:///b", True, "help", "lua", True)], "uri string, valid boolean, buftype string, filetype string, is_file boolean")
    assert lsp.eligible(files).count() == 1


def test_formats(spark):
    line = one(spark, render.entry(F.lit(12), F.lit("setup"), F.lit("M"), F.lit("a.lua"), F.lit(41)))
    assert line == "Function: setup [M] - a.lua:42"
    assert "0.85" in one(spark, render.hotspot(F.lit("a"), F.lit(0.85))) and one(spark, render.bar(F.lit(0.85), 10)) == "█" * 8
    assert one(spark, render.truncate(F.lit("abcdefgh"), 6)) == "...fgh" and one(spark, render.truncate(F.lit("abcdef"), 2)) == "ab"
    assert one(spark, render.impact(F.lit("f"), F.lit("affected"), F.lit(1), F.lit(0.0), F.lit(0.2), F.lit("p"))).startswith("f" + " " * 30 + "affect")


def test_config():
    good, warnings = config.validate({"search": {"limit": 5}})
    assert good["search"] == {"limit": 5, "debounce_ms": 100} and not warnings
    bad, warnings = config.validate({"search": {"limit": 0, "nope": 1}, "hotspots": 3, "metrics": {"complexity_cap": 2.5, "enabled": "yes"}, "snapshot": {"remote_cache": {"dir": ""}}, "other": 1})
    assert bad == config.DEFAULTS and len(warnings) == 7 and "unknown config key: other" in warnings
    assert config.validate("x")[0] == config.DEFAULTS and math.isclose(1, 1)
