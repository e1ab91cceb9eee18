import re

from symlens.llm.license_rules import BASE, CONFIDENCE, rules
from symlens.llm.licenses import license_scan
from tests.llm.helpers import frame, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = [w.decode("utf-8", "replace") for w in WORD.findall((text or "").encode().lower())]
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in BASE}
    norm = " " + "  ".join(words) + " "
    hits = [(m.start(), m.end(), r) for r in rules() if r.keyword in words for m in re.finditer(r.regex, norm)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[2].priority, rules().index(h[2])))
    kept = []
    for i, (a, b, r) in enumerate(hits):
        around = any(e >= b and q.priority >= r.priority for _, e, q in hits[:i])
        inside = any(e <= b and q.priority > r.priority for _, e, q in hits[i + 1 :])
        if not (around or inside):
            kept.append(r)
    at = [i for p in places.values() for i in p]
    base = sorted(k for k, p in places.items() if p)
    score = 1.0 if base else max((CONFIDENCE[r.priority] for r in kept), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(r.label for r in kept)})), score


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "UNDER\nTHE MIT--LICENSE under the mit license", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3 or any later version.", "GPLv2 and lgpl 2.1, then BSD 3-clause; all rights reserved", "under the mit licenses",
    "cc by nc sa 4.0 cc by nc", "ünder the mit license über under the mit license", "Copyright (c) 2020 Someone. Apache", "see the license file; unlicense; CC0", "K mit license ccé by nc",
    "creative commons attribution noncommercial 4 creative commons attribution share alike 3", "apache license version 2 apache license version 2 mit license apache license version 2",
]


def test_equals_brute_force(spark):
    rows = prose(3, 30) + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(200 + i, f"some words {t} and more {TEXTS[-1 - i]}") for i, t in enumerate(TEXTS)]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(frame(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in license_scan(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_edges(spark):
    clash = spark.createDataFrame([(None, "mit license", 1, 2), (5, "mit license", 1, 2), (5, "mit license", 1, 2), (7, None, 1, 2)], "doc_id long, text string, n_words long, key long")
    got = license_scan(clash)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.labels) for r in got.collect()) == [(False, 5, "mit"), (False, 5, "mit"), (False, 7, ""), (True, 0, "mit")]
    assert license_scan(clash.limit(0)).count() == 0
    assert len(rules()) > 200


def test_long_text_with_many_hits(spark):
    text = "gpl v3 filler words " * 20000
    (row,) = license_scan(frame(spark, [(1, text)])).collect()
    assert (row.n_words, row.labels) == (80000, "gpl-3")
