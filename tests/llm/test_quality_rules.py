from collections import Counter

import pytest

from symlens.llm.quality_rules import Rules, clean_documents, judge, line_failure, quality_rules, repeated_words
from tests.llm.helpers import frame, prose


def slow(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def test_base_figures_equal_brute_force(spark):
    rows = prose(11) + [(100, "a|b # c\na|b # c\n \n \nx"), (None, "w " * 80)]
    got = quality_rules(frame(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in got} == {i: slow(t) for i, t in rows}
    assert all(not r.kept for r in got if r.base_failed)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(docs, texts=False).collect()}
    assert got == {r.doc_id: slow(r.text) for r in docs.collect()}


def test_labels_agree(spark):
    d = "/root/testdata/sf0.01"
    judged = quality_rules(spark.read.parquet(f"{d}/documents.parquet"), texts=False).filter("NOT base_failed")
    rows = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * sum(v for (q, _), v in n.items() if q == 0)


@pytest.mark.parametrize(("line", "rule"), [("home | news | sport | about", "navigation"), ("th*** er$$$ of%%%", "punctuation"), ("THE!! ER!! ORES!!", "punctuation"), ("All rights reserved.", "boilerplate"), ("no no no no no no no no", "boilerplate"), ("A plain sentence, with a comma.", None), ("", None),
    ("Alle Rechte vorbehalten.", "boilerplate"), ("IMPRESSUM", "boilerplate"), ("Die Rechte der Menschen gelten überall.", None),
    ("Tous droits réservés", "boilerplate"), ("Lire la suite", "boilerplate"), ("Elle veut lire un livre.", None),
    ("Todos los derechos reservados.", "boilerplate"), ("Síguenos en las redes", "boilerplate"), ("Quiere leer un libro.", None),
    ("and then they went", None), ("and then they went ...", "boilerplate"), ("w " * 30 + "...", "boilerplate"), (" ".join(f"w{i}" for i in range(30)) + " …", None)])
def test_line_rules(line, rule):
    assert line_failure(line) == rule


def test_cleaning_keeps_columns_and_drops_lines(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    more = " ".join(f"other{i}" for i in range(80)) + "."
    rows = [(1, good + "\nAll rights reserved.\n" + more), (2, "x | y | z | w\n" * 60), (3, None), (4, good)]
    out = clean_documents(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: good + "\n" + more, 4: good}
    assert clean_documents(frame(spark, rows).limit(0)).count() == 0


def test_many_distinct_words_do_not_overflow():
    words = [str(i).encode() for i in range(3_000_000 // 10)] * 2
    assert repeated_words(words, 4) == len(words)
    assert judge(b" ".join(words), Rules())[4] == len(words)
