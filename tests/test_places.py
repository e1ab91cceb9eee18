"""Interval joins, segmented scans and figures by place, against plain loops."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from symlens.operators import diff, intervals, metrics, places, scan


def test_interval_joins_find_each_meeting_once(spark):
    r = random.Random(0)
    make = lambda n, top: [(i, r.choice("ab"), (lo := r.randrange(-top, top)), lo + r.choice([-1, 0, 0, 1, 3, r.randrange(top)])) for i in range(n)]
    for top in (4, 50, 10**12):
        a, b = make(120, top), make(120, top)
        left, right = spark.createDataFrame(a, "i long, k string, lo long, hi long"), spark.createDataFrame(b, "j long, k string, first long, last long")
        met = intervals.overlap_join(left, right, ["k"], ("lo", "hi"), ("first", "last"))
        assert sorted((x.i, x.j) for x in met.collect()) == sorted((i, j) for i, k, lo, hi in a for j, q, f, t in b if k == q and lo <= hi and f <= t and f <= hi and t >= lo)
        held = intervals.contains_join(left.select("i", "k", F.col("lo").alias("at")), right, ["k"], "at", "first", "last")
        assert sorted((x.i, x.j) for x in held.collect()) == sorted((i, j) for i, k, lo, _ in a for j, q, f, t in b if k == q and f <= lo <= t)
    odd = spark.createDataFrame([(1, None, 1, 2), (2, "a", None, 2), (3, "a", 1, None)], "i long, k string, lo long, hi long")
    assert intervals.overlap_join(odd, right, ["k"], ("lo", "hi"), ("first", "last")).count() == 0
    assert intervals.contains_join(left.select("i", "k", F.col("lo").alias("at")), right.limit(0), ["k"], "at", "first", "last").count() == 0


def test_blocks_are_few_and_apart(spark):
    rows = spark.createDataFrame([(r.randrange(1000), n) for r in [random.Random(1)] for n in range(1, 400)], "lo long, n long")
    cut = rows.select("lo", "n", intervals.blocks_of(F.col("lo"), F.col("lo") + F.col("n") - 1, 8).alias("b")).collect()
    for x in cut:
        lines = [y for b in x.b for y in range(b[1] << b[0], (b[1] + 1) << b[0])]
        assert sorted(lines) == list(range(x.lo, x.lo + x.n)) and len(x.b) <= 2 * x.n.bit_length()


def test_a_hot_file_is_joined_by_its_matches(spark):
    """10^5 symbols and 10^5 ranges of one file; each range meets at most two symbols."""
    n = 100_000
    zero = F.lit(0).cast("long")
    symbols = spark.range(n).select(F.col("id").cast("string").alias("symbol_id"), F.lit("f").alias("name"), F.lit(12).alias("kind"), F.lit("").alias("container_name"), F.lit("u").alias("uri"), (F.col("id") * 10).alias("start_line"), zero.alias("start_char"), (F.col("id") * 10 + 8).alias("end_line"), zero.alias("end_char"))
    ranges = spark.range(n).select(F.lit("u").alias("uri"), (F.col("id") * 10 + 5).alias("first"), (F.col("id") * 10 + 5 + F.col("id") % 9).alias("last"))
    met = diff.changed_ranges(symbols, ranges)
    want = n + sum(1 for i in range(n - 1) if 5 + i % 9 >= 10)
    assert met.count() == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    at = ranges.select("uri", F.col("first").alias("line"), F.lit(1).alias("char")).limit(1000)
    assert places.symbols_at(at, symbols).count() == 1000


def test_lines_are_made_only_when_asked_for(spark):
    symbols = spark.createDataFrame([("s", "f", 12, None, "u", 3, 0, 9, 0)], "symbol_id string, name string, kind long, container_name string, uri string, start_line long, start_char long, end_line long, end_char long")
    ranges = spark.createDataFrame([("u", 8, 12), ("u", 0, 4), ("u", 4, 4), ("u", 10, 11), ("v", 3, 9)], "uri string, first long, last long")
    got = diff.changed_lines(symbols, ranges)
    assert got.select("changed_lines").first()[0] == [3, 4, 4, 8, 9]
    changed = diff.changed_symbols(spark.createDataFrame([("u", "modified")], "uri string, change_type string"), ranges, symbols)
    assert changed.first().changed_ranges == [(3, 4), (4, 4), (8, 9)]
    assert "sequence(" not in changed.select("symbol_id", "change_type")._jdf.queryExecution().optimizedPlan().toString()


def test_scans_equal_windows(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(r.choice(["a", "b", None]), i, r.choice([None, r.randrange(-3, 9)])) for i in range(500)], "k string, at long, x int")
    order = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select("*", F.coalesce(F.sum("x").over(order), F.lit(0)).alias("total"), F.last("x", ignorenulls=True).over(order).alias("last"))
    for size in (1, 7, 10_000):
        block = F.floor(F.col("at") / size)
        got = scan.carried_forward(scan.running_sum(rows, ["k"], ["at"], block, "x", "total"), ["k"], ["at"], block, "x", "last")
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert scan.running_sum(rows.limit(0), ["k"], ["at"], F.col("at"), "x", "total").count() == 0


def _tree(r, file):
    """Random nested nodes of a file with their places, as (no, type, operators, lft, rgt, start, end, parent)."""
    kinds = ["function_declaration", "method_definition", "lambda", "if_statement", "for_statement", "boolean_operator", "block", "call"]
    nodes, clock = [], [0]

    def grow(parent, start, end, depth):
        at = start
        for _ in range(r.randrange(4) if depth else 6):
            a, b = sorted(r.sample(range(at, end + 1), 2)) if end - at >= 2 else (at, end)
            if b <= a:
                return
            clock[0] += 1
            me = [len(nodes), r.choice(kinds), r.choice([None, ["and"], ["+"]]), clock[0], 0, a, b, parent]
            nodes.append(me)
            if depth < 6:
                grow(me[0], a, b, depth + 1)
            clock[0] += 1
            me[4], at = clock[0], b

    grow(None, 0, 3000, 0)
    return nodes


def _figures(nodes, no):
    below, depth, points = [(c, 0) for c in nodes if c[7] == no], 0, 0
    while below:
        (_, kind, ops, *_), d = (node := below[0][0]), below[0][1]
        points += (kind in metrics.DECISIONS["python"]) + (kind == "boolean_operator" and "and" in (ops or []))
        d += kind in metrics.NESTING
        depth = max(depth, d)
        below = below[1:] + [(c, d) for c in nodes if c[7] == node[0]]
    me = nodes[no]
    return 1 + points, me[6] // 30 - me[5] // 30 + 1, depth


def test_figures_equal_a_walk_up_and_down_the_tree(spark, monkeypatch):
    """Positions are lines of thirty characters; ends are outside a node."""
    monkeypatch.setattr(places, "BLOCK_LINES", 7)
    r, rows, symbols, want = random.Random(4), [], [], {}
    for file in ("f", "g", "h"):
        nodes = _tree(r, file)
        rows += [(file, f"{file}{no}", "python", kind, ops, lft, rgt, a // 30, a % 30, b // 30, b % 30) for no, kind, ops, lft, rgt, a, b, _ in nodes]
        for i in range(150):
            at, kind = r.choice([r.randrange(3001), *[n[5] for n in nodes], *[n[6] for n in nodes]]), r.choice([5, 6, 9, 12])
            around = [n for n in nodes if n[5] <= at < n[6]]
            functions = [n for n in around if n[1] in ("function_declaration", "method_definition", "lambda")]
            inner = max(functions, key=lambda n: n[3])[0] if functions else None
            symbols.append((f"{file}-{i}", kind, file, at // 30, at % 30))
            want[symbols[-1][0]] = _figures(nodes, inner) if inner is not None and kind != 5 else (None,) * 3
    tree = spark.createDataFrame(rows, "file string, node_id string, lang string, type string, operators array<string>, lft long, rgt long, start_line long, start_char long, end_line long, end_char long")
    asked = spark.createDataFrame(symbols, "symbol_id string, kind long, uri string, start_line long, start_char long")
    got = {x.symbol_id: tuple(x[c] for c in places.FIGURES) for x in places.with_metrics(asked, tree).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 50
    own = asked.limit(3).withColumn("node_id", F.lit(rows[0][1])).withColumns({"uri": F.lit("f"), "kind": F.lit(12)})
    assert {tuple(x[c] for c in places.FIGURES) for x in places.with_metrics(own, tree).collect()} == {_figures(_tree(random.Random(4), "f"), 0)}
    assert places.with_metrics(asked, tree.limit(0)).filter("cyclomatic_complexity IS NULL").count() == len(symbols)


def test_the_symbol_at_each_place_equals_a_look_at_all_symbols(spark, tmp_path):
    rng = random.Random(5)
    some = lambda n: rng.choice([None, *range(n)]) if rng.random() < 0.1 else rng.randrange(n)
    symbols = [(rng.choice("ab"), f"s{i}", some(20), some(4), some(24), some(4)) for i in range(120)]
    points = [(i % 55, rng.choice("abc"), some(26), some(5)) for i in range(60)]
    points += points[:5]  # repeated rows are one

    def holds(s, p):
        (uri, _, a, b, c, d), (_, file, line, char) = s, p
        if uri != file or None in (a, c, line) or not a <= line <= c:
            return False
        return (a < line or None not in (b, char) and b <= char) and (c > line or None not in (d, char) and d >= char)

    want = {(*p, min((s[4] - s[2], s[1]) for s in symbols if holds(s, p))[1]) for p in points if any(holds(s, p) for s in symbols)}
    table = spark.createDataFrame(symbols, "uri string, symbol_id string, start_line long, start_char long, end_line long, end_char long")
    at = spark.createDataFrame(points, "id long, uri string, line long, char long")
    out = places.symbols_at(at, table)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and want
    # nothing that grows with the tables goes to the driver, and no pair of a place and a symbol around it is made
    path = f"file://{tmp_path}"
    table.write.parquet(f"{path}/s")
    at.write.parquet(f"{path}/p")
    plan = places.symbols_at(spark.read.parquet(f"{path}/p"), spark.read.parquet(f"{path}/s"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_repeated_ranges_are_counted_before_they_meet_symbols(spark):
    symbols = spark.createDataFrame([("s", "f", 12, None, "u", 2, 0, 4, 0), ("t", "g", 12, None, "u", 9, 0, 9, 0)], "symbol_id string, name string, kind long, container_name string, uri string, start_line long, start_char long, end_line long, end_char long")
    ranges = spark.createDataFrame([("u", 1, 3)] * 1000 + [("u", 3, 8), ("v", 2, 2)], "uri string, first long, last long")
    counted = diff.changed_counts(symbols, ranges)
    assert [(r.symbol_id, [tuple(c) for c in r.counted]) for r in counted.collect()] == [("s", [(2, 3, 1000), (3, 4, 1)])]
    text = counted.select(diff.lines_text(F.col("counted")).alias("x")).first().x
    assert text == ",".join(["2"] * 1000 + ["3"] * 1001 + ["4"])
    got = diff.changed_lines(symbols, ranges).first()
    assert got.changed_lines == [2] * 1000 + [3] * 1001 + [4] and len(got.changed_ranges) == 1001
