import hashlib
from collections import Counter

from pyspark.sql import functions as F

from symlens.llm.mixing import mix_sources, poisson_steps, rates
from tests.llm.helpers import frame


def drawn(seed, own, rate, parts):
    total = 0
    for k in range(parts):
        u = int(hashlib.md5(f"{seed}:{own}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        total += sum(c <= u for c in poisson_steps(rate / parts))
    return total


def table(spark, n=3000):
    rows = [(i, "x" * (10 + i % 7), "en", "hot" if i % 3 else ["a", "b", None][i // 3 % 3], 0) for i in range(n)]
    return rows, frame(spark, rows)


def test_counts_equal_brute_force_and_shares_near_targets(spark):
    rows, docs = table(spark)
    weights = {"hot": 0.2, "a": 0.3, "b": 0.5, "absent": 1.0}
    found = rates(docs, weights)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1])
    total = sum(sizes[s] for s in ("hot", "a", "b"))
    assert found == {s: (w / 2.0 * total / sizes[s] if sizes[s] else 0.0) for s, w in weights.items()}
    out = mix_sources(docs, weights, 3).collect()
    n = Counter(r.doc_id for r in out)
    assert n == Counter({r[0]: c for r in rows if (c := drawn(3, r[0], found.get(r[3], 1.0), 1))})
    size = Counter()
    for r in out:
        size[r.source] += len(r.text)
    assert abs(size["b"] / (size["a"] + size["b"] + size["hot"]) - 0.5) < 0.05
    assert sorted(r["__copy"] for r in out if r.doc_id == n.most_common(1)[0][0]) == list(range(1, n.most_common(1)[0][1] + 1))


def test_large_means_are_drawn_in_parts(spark):
    docs = frame(spark, [(i, "x", "en", "rare" if i == 7 else "big", 0) for i in range(400)])
    out = mix_sources(docs, {"rare": 0.5, "big": 0.5}, 1)
    rate = rates(docs, {"rare": 0.5, "big": 0.5})["rare"]
    assert rate == 200.0
    assert out.filter("source = 'rare'").count() == drawn(1, 7, rate, 13)


def test_order_is_global_and_stable(spark):
    _, docs = table(spark, 400)
    a = mix_sources(docs, {"hot": 1.0}, 5)
    b = mix_sources(docs.repartition(7), {"hot": 1.0}, 5)
    key = lambda df: sorted((r.doc_id, r["__copy"], r["__order"]) for r in df.collect())
    assert key(a) == key(b)
    for part in a.select("__order").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a", "s", 1), (1, None, "s", 1), (2, "", None, 1), (2, "", None, 1)], "doc_id long, text string, source string, size int")
    out = mix_sources(docs, {"s": 1.0}, 2)
    assert [c for c in out.columns if not c.startswith("__")] == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got[2] == 2 * drawn(2, 2, 1.0, 1) and got[1] == drawn(2, 1, 1.0, 1)
    assert got[None] == drawn(2, "null-" + hashlib.md5(b"a").hexdigest(), 1.0, 1)
    assert mix_sources(docs.limit(0), {"s": 1.0}).count() == 0
    assert mix_sources(docs, {}, other_rate=0.0).count() == 0
    assert mix_sources(docs.filter("source = 's'"), {"s": 0.0, "t": 0.0}).count() == 0
    clash = mix_sources(docs.withColumns({c: F.lit(5) for c in ("__N", "__at", "__own", "__parts", "__copy", "__order")}), {"s": 1.0}, 2)
    assert clash.columns[-3:] == ["__copy", "__rate", "__order"] and set(clash.columns[:-3]) == {*docs.columns, "__N", "__at", "__own", "__parts"}
    assert sorted(r["__order"] for r in clash.collect()) == sorted(r["__order"] for r in out.collect())
    long = frame(spark, [(1, "x y " * 500_000, "en", "s", 0), (2, "z", "en", "s", 0)])
    assert {len(r.text) for r in mix_sources(long, {"s": 1.0}, 3, other_rate=0.0).collect()} <= {2_000_000, 1}
