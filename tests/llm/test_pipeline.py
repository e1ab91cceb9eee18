import hashlib

import pytest

import corpus_pipeline
from symlens.llm.bpe import read_ranks
from symlens.llm.line_dedup import deduplicated
from symlens.llm.mixing import poisson_steps, rates
from symlens.llm.quality_rules import judge
from symlens.llm.queries import SEED, WEIGHTS, vocabulary
from tests.llm.test_line_dedup import brute_runs as brute_lines
from tests.llm.test_mixing import drawn
from tests.llm.test_simhash import classes, slow

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    table, steps = docs, []
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, SF).cache()
        steps.append(table)
    rows = [{r.doc_id: r.text for r in t.collect()} for t in steps[:3]]
    assert all(t.columns == columns for t in steps[:4])
    judged = {i: judge(t.encode()) for i, (t, _) in texts.items()}
    assert rows[0] == {i: j[7] for i, j in judged.items() if j[6]}
    assert rows[1] == {i: t for i, (n, t) in brute_lines(list(rows[0].items()), 8).items() if not n or t.split()}
    prints = {i: slow(t, 5) for i, t in rows[1].items()}
    assert set(rows[2]) == {i for i, c in classes(prints, 4).items() if i == c}
    found = rates(steps[2], WEIGHTS)
    want = {i: n for i in rows[2] if (n := drawn(SEED, i, found[texts[i][1]], 1))}
    mixed = [r.doc_id for r in steps[3].collect()]
    assert {i: mixed.count(i) for i in set(mixed)} == want and max(found.values()) < 16
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(vocabulary()), special_tokens={})
    last = steps[4].collect()
    assert len(last) == len(mixed)
    for r in last:
        ids = exact.encode_ordinary(rows[2][r.doc_id])
        assert r.ids == ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[2][r.doc_id].encode()).hexdigest())


def test_odd_tables_pass_every_stage(spark):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (1, "", "en", "src1", 0, 1), (2, " ".join(f"w{i}" for i in range(90)), None, None, 5, 2), (2, " ".join(f"w{i}" for i in range(90)), None, None, 5, 2)], "doc_id long, text string, lang string, source string, n_chars long, gone int")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF)
        if table.count():  # of the two equal rows one stays, once or more often; texts without words go
            assert {r.doc_id for r in table.collect()} <= {2} and all(r.n_tokens == len(r.ids) > 90 for r in table.collect())


def test_line_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id: r.text for r in deduplicated(docs).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert all(first[t] == i or len(t.split()) < 8 or i not in left for i, t in texts.items())
    alone = {i for i, t in texts.items() if not any(set(x.strip() for x in t.split("\n") if len(x.split()) >= 3) & set(x.strip() for x in u.split("\n")) for j, u in texts.items() if j < i)}
    assert alone and all(left[i] == texts[i] for i in alone) and poisson_steps(1.0)[-1] <= 1.0000001
