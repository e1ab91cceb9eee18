import json

import pytest
from pyspark.sql import functions as F

from symlens.operators import graph
from symlens.sources import git, lsp, rpc
from symlens.sources.tables import settle
from symlens.streaming import ingest
from symlens.functions.schema import SYMBOLS
from tests.test_search import rows


def test_requests(spark):
    lines = ['{"jsonrpc":"2.0","id":1,"method":"index/stats"}', "", "{bad", '{"jsonrpc":"1.0","id":2,"method":"index/stats"}', '{"jsonrpc":"2.0","id":3,"method":"nope","params":{"a":[1]}}', '{"jsonrpc":"2.0","method":"index/stats"}']
    lines.append(json.dumps({"jsonrpc": "2.0", "id": 4, "method": "index/upsertSymbols", "params": "x" * (rpc.MAX_UPSERT_BYTES + 9)}))
    got = rpc.requests(spark.createDataFrame([(x,) for x in lines], "value string")).select("id", "method", F.left("params", F.lit(9)).alias("params"), "error").collect()
    assert [tuple(r) for r in got] == [("1", "index/stats", "null", None), (None, None, "null", rpc.PARSE), ("2", "index/stats", "null", rpc.INVALID_REQUEST), ("3", "nope", '{"a":[1]}', rpc.UNKNOWN_METHOD), ("4", "index/upsertSymbols", "x" * 9, rpc.INVALID_PARAMS)]
    out = spark.range(1).select(rpc.response(F.lit(7), F.struct(F.lit(None).cast("string").alias("symbol"), F.lit(2).alias("n"))).alias("a"), rpc.error_response(F.lit(None), F.lit(-32601), F.lit("unknown")).alias("b")).first()
    assert json.loads(out.a) == {"jsonrpc": "2.0", "id": 7, "result": {"n": 2}} and json.loads(out.b)["error"] == {"code": -32601, "message": "unknown"}


def test_call_hierarchy_items_and_resolution(spark):
    point = "struct<line:bigint,character:bigint>"
    rng = f"struct<start:{point},`end`:{point}>"
    schema = f"`from` struct<name:string,kind:bigint,detail:string,uri:string,`range`:{rng},selectionRange:{rng}>, fromRanges array<{rng}>"
    whole, name = ((0, 0), (0, 10)), ((0, 4), (0, 9))
    calls = spark.createDataFrame([(("caller_fn", 12, None, "file:///b", whole, name), [whole, whole]), (("caller_fn", 12, None, "file:///b", whole, None), [])], schema)
    items = lsp.call_items(calls, "incoming", "from")
    assert sorted((r.start_char, r.n) for r in items.collect()) == [(0, 1), (4, 2)]
    s = rows(spark, [("caller_fn", 12, None, "file:///b")])
    assert [r.n for r in graph.resolve_items(items, s).collect()] == [1]
    assert {r.symbol_id for r in graph.resolve_items(items, s, "containment").collect()} == {s.first().symbol_id}
    with pytest.raises(ValueError, match="strict"):
        graph.resolve_items(items, s, "x")
    places = spark.createDataFrame([("file:///r", whole), ("http://x", whole)], f"uri string, `range` {rng}")
    named = {(r.name, r.kind, r.container_name, r.uri) for r in lsp.reference_items(places).collect()}
    assert named == {("r:1:1", 13, "/r", "file:///r"), ("x:1:1", 13, "http://x", "http://x")}
    assert [tuple(r) for r in lsp.reference_places(places).collect()] == [("/r", 1, 1)]


def test_git_commands(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.lua").write_text("x\ny\n")
    run("add", ".")
    run("commit", "-m", "one")
    parsed = git.parse_numstat(git.numstat_log(spark, [str(tmp_path), "/nowhere"])).collect()
    assert [(r.path, r.additions, r.commit_time is not None) for r in parsed] == [("a.lua", 2.0, True)]


def test_stream_keeps_the_latest_version(spark, tmp_path):
    initial = rows(spark, [("old", 12, None, "file:///a"), ("other", 12, None, "file:///z")])
    schema = f"{SYMBOLS}, seq long"
    row = lambda name, uri, seq, i: ("", name, 12, None, uri, i, 0, i, 0, None, None, None, None, uri, i, seq)
    batches = [[row("v1", "file:///a", 1, 0), row("v2", "file:///a", 2, 0), row("w2", "file:///a", 2, 1)], [row(None, "file:///b", 3, 0), row("b", "file:///c", 3, 0)], [row(None, "file:///c", 4, 0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.stream_upserts(spark, stream, f"file://{tmp_path}/t", f"{tmp_path}/c", initial).awaitTermination()
        names = {r.name for r in ingest.current(spark, f"file://{tmp_path}/t").collect()}
        assert names == [{"v2", "w2", "other"}, {"v2", "w2", "other", "b"}, {"v2", "w2", "other"}][i]


def test_settled_tables_keep_their_rows(spark):
    df = spark.range(3).withColumn("x", F.rand(1))
    kept = settle(df)
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(kept.collect()) and kept.count() == 3
