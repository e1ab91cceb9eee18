from itertools import permutations

from pyspark.sql import functions as F

from symlens.llm.filter_audit import PIECE, audit, document_failures, filter_audit, plain_changes, shapley_values, text_failures
from tests.llm.helpers import frame, prose

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Each order applied to each document, one filter after another."""
    fails = {}
    for row, (i, text, part) in enumerate(docs):
        t = text or ""
        words = t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        upper = sum("A" <= c <= "Z" for c in t)
        out = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * upper > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        out["E"] = any((u or "") == t and (-1 if j is None else j) < (-1 if i is None else i) for j, u, _ in docs)
        fails[row] = {f for f in out if out[f]}
    flags = {}
    for i, good, toxic in labels:
        if i is not None:
            flags.setdefault(i, set()).update({"good"} if good == 1 else (), {"toxic"} if toxic == 1 else ())
    rows = []
    for part in {p or "" for *_, p in docs}:
        own = [r for r, (*_, p) in enumerate(docs) if (p or "") == part]
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order):
                gone = [r for r in left if f in fails[r]]
                left = [r for r in left if f not in fails[r]]
                shapley[f] += len(gone)
                lost = [sum(k in flags.get(docs[r][0], ()) for r in gone) for k in ("good", "toxic")]
                redundant = sum(f in fails[r] for r in own) - len(gone)
                found.append((part, "".join(order), step + 1, len(left), len(gone), redundant, sum(fails[r] == {f} for r in own), *lost, f))
        rows += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(rows)


def test_equals_every_order_run_by_itself(spark):
    docs = [(i, t, "enfr"[2 * (i % 2) :][:2] if i % 7 else None) for i, t in prose(5, 60)]
    docs += [(100 + i, "WORD " * (30 * i) + "x# " * i + " ".join(map(str, range(90))), "de") for i in range(6)] + [(100, docs[30][1], "fr"), (100, docs[30][1], "fr"), (None, "", "en"), (None, docs[31][1], "")]
    labels = [(i, i % 3 == 0, i % 4 == 1) for i in range(0, 60, 2)] + [(2, None, 1), (2, 1, None), (100, 1, 1), (None, 1, 1)]
    table = frame(spark, [(i, t, p, "s", 0) for i, t, p in docs]).withColumn("mask", F.lit("clash"))
    marks = spark.createDataFrame([(i, None if a is None else int(a), None if b is None else int(b)) for i, a, b in labels], LABELS)
    got = filter_audit(table, marks)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)
    values = {(r.part, r["filter"]): r.value for r in shapley_values(got).collect()}
    removed = {r.part: r.n for r in document_failures(table, marks).filter("mask > 0").groupBy("part").agg(F.count("*").alias("n")).collect()}
    for part, n in removed.items():  # what the filters remove is shared out among them
        assert abs(sum(v for (p, _), v in values.items() if p == part) - n) < 1e-9


def test_plain_changes_meet_every_order_once():
    for n in range(6):
        order = list(range(n))
        seen = [tuple(order)]
        for i in plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_long_and_empty_texts(spark):
    words = [f"w{i % 200_000}".encode() for i in range(400_000)]
    body = b" ".join(words)
    assert len(body) > 2 * PIECE and text_failures(body) == 2
    assert text_failures(b"x" * (3 * PIECE)) == 1 and text_failures(b"") == 1
    empty = frame(spark, [(1, "a")]).limit(0)
    assert filter_audit(empty, spark.createDataFrame([], LABELS)).count() == 0
    other = spark.createDataFrame([("p", 3, True, False), ("p", 0, False, False)], "part string, mask int, good boolean, toxic boolean")
    assert audit(other, "XY").select("filter_order", "removed").orderBy("filter_order", "step").collect() == [("XY", 1), ("XY", 0), ("YX", 1), ("YX", 0)]
