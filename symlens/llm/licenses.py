"""Licence scan: ordered signature rules behind a keyword prefilter.

Built-in expressions only. A text without any keyword is only counted. For the
others the words are joined so that each has its own spaces, and the rules whose
keyword is among the words are matched. A match is suppressed if a match of at
least its priority contains it, or if one of higher priority stands inside it;
that is decided by running extremes over the matches in order, without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlens.llm.license_rules import BASE, CONFIDENCE, rules
from symlens.llm.work import id_key, id_value, materialize

#: What stands between words of a text in any case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` taken once, also where it stands in a lambda."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """The words in order; cutting between them is several times faster than extracting each."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _places(words: Column, phrase: str) -> Column:
    """Starts, in words, of all places where the phrase's words stand one after another."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            found &= F.get(words, i + j) == p
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row a text: its words counted, base places by phrase, and lengths of gaps and matches by rule."""
    table = rules()
    keywords = sorted({r.keyword for r in table})
    literal = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex")) for i, r in enumerate(table)])
    raw = docs.select(id_key(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"), F.monotonically_increasing_id().alias("row_no"))
    wanted = F.array(*map(F.lit, keywords))

    def matched(s: Column) -> Column:
        norm, own = s["norm"], F.filter(literal, lambda r: F.array_contains(s["held"], r["keyword"]))
        found = F.transform(own, lambda r: F.struct(r["rule"].alias("rule"), F.transform(F.regexp_extract_all(norm, r["regex"], F.lit(0)), F.length).alias("lens"), F.transform(F.split(norm, r["regex"]), F.length).alias("gaps")))
        return F.filter(found, lambda x: F.size(x["lens"]) > 0)

    def facts(w: Column) -> Column:
        norm = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("norm")
        held = F.array_intersect(w, wanted).alias("held")
        return F.struct(F.array(*[_places(w, phrase) for phrase, _ in BASE]).alias("places"), _let(F.struct(norm, held), matched).alias("found"))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(F.arrays_overlap(w, wanted), facts(w)).alias("facts"))

    return raw.select("key", "row_no", _let(_words(F.translate("raw", UPPER, LOWER)), counted).alias("of")).select("key", "row_no", "of.n_words", "of.facts")


def _kept(scan: DataFrame) -> DataFrame:
    """(row_no, rule, start, stop): matches that no other suppresses, in characters of the joined words."""
    one = scan.select("row_no", F.explode("facts.found").alias("f")).select("row_no", "f.rule", F.posexplode(F.arrays_zip("f.lens", "f.gaps")).alias("at", "x"))
    one = one.filter("x.lens IS NOT NULL")
    before = Window.partitionBy("row_no", "rule").orderBy("at")
    stop = F.sum(F.col("x.lens") + F.col("x.gaps")).over(before)
    table = rules()
    priority = F.array(*[F.lit(r.priority) for r in table])
    spans = one.select("row_no", "rule", (stop - F.col("x.lens")).alias("start"), stop.alias("stop"), priority[F.col("rule")].alias("priority"))
    # later matches are the earlier ones of the opposite order: a frame that runs on to the end would be summed up anew for each row
    order = [F.asc("start"), F.desc("stop"), F.desc("priority"), F.asc("rule")]
    opposite = [F.desc("start"), F.asc("stop"), F.asc("priority"), F.desc("rule")]
    earlier, later = (Window.partitionBy("row_no").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, opposite))
    around, inside = F.lit(False), F.lit(False)
    for p in sorted(CONFIDENCE):
        own = F.col("priority") == p
        around |= own & F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("stop"))).over(earlier) >= F.col("stop"), F.lit(False))
        inside |= own & F.coalesce(F.min(F.when(F.col("priority") > p, F.col("stop"))).over(later) <= F.col("stop"), F.lit(False))
    return spans.withColumn("gone", around | inside).filter("NOT gone").drop("gone")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are their least and greatest start in words from 0, null where
    there is none. ``labels`` joins the base labels and those of the matches
    that remain, distinct and sorted; ``score`` is the greatest confidence of a
    remaining match, 1 where a base phrase stands, 0 without either. A null text
    counts as empty. Null ids stay null, repeated rows give equal rows, an empty
    table none. Whole texts are read. Other columns are ignored.
    """
    scan = materialize(_scan(docs, id_col, text_col), "license-scan")
    table = rules()
    label, sure = F.array(*[F.lit(r.label) for r in table]), F.array(*[F.lit(CONFIDENCE[r.priority]) for r in table])
    found = _kept(scan).groupBy("row_no").agg(F.collect_set(label[F.col("rule")]).alias("more"), F.max(sure[F.col("rule")]).alias("sure"))
    places = F.flatten(F.coalesce("facts.places", F.array().cast("array<array<int>>")))
    base = F.array_compact(F.array(*[F.when(F.size(F.col("facts.places")[i]) > 0, F.lit(name)) for i, (_, name) in enumerate(BASE)]))
    rows = scan.select("key", "row_no", "n_words", places.alias("at"), F.array_sort(base).alias("base"))
    out = rows.join(found, "row_no", "left")
    none = F.array().cast("array<string>")
    return out.select(
        id_value(F.col("key")).alias("doc_id"),
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("sure", F.lit(0.0))).alias("score"),
    )
