import zlib

from symlens.llm.compression import fit, quality_scores, train
from tests.llm.helpers import frame


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), train(docs, labels))
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.9 * len(bad)


def test_held_out_rows_never_teach(spark):
    ids = [i for i in range(400)]
    rows = [(i, ("good text of many plain words " if i % 2 else "### bad $$$ ") * 20 + str(i)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in ids], "doc_id long, quality int")
    docs = frame(spark, rows)
    right = train(docs, labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    assert train(docs, labels) == right
    got = {r.doc_id: r for r in quality_scores(docs, right).collect()}
    assert all(r.predicted == i % 2 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_edges(spark):
    rows = [(None, "a"), (1, None), (2, ""), (2, ""), (3, "word " * 100_000)]
    model = fit([b"good words here"] * 3, [b"### $$$"] * 3)
    got = quality_scores(frame(spark, rows).withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    empty = fit([], [b"x"])
    assert {r.score for r in quality_scores(frame(spark, rows), empty).collect()} == {0.5}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_scores(frame(spark, rows).limit(0), train(frame(spark, rows), none)).count() == 0
