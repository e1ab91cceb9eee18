"""Ranked fuzzy search over symbols.

A token's candidates are the symbols whose name or container holds all its
grams (of up to three characters). Only if a token has none at all in a column
do symbols that hold its single characters count: that decision is made over
all symbols, before any filter.

:func:`search` answers one query: one aggregate of a row for those decisions,
then a single scan with filters and a top-k. :func:`search_batch` answers a table
of queries in one plan over postings.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symlens.functions import exprs as E
from symlens.sources.tables import settle

if TYPE_CHECKING:
    from symlens.operators.postings import PostingIndex

DOMAINS = (("name", "name"), ("container", "container_name"))


def texts(symbols: DataFrame) -> DataFrame:
    """``symbols`` with what tokens are looked for in: names and containers in lower case."""
    return symbols.withColumns({"__name": F.lower("name"), "__container": F.lower(F.coalesce("container_name", F.lit("")))})


def _holds(text: Column, parts: list[str]) -> Column:
    out = F.lit(True)
    for p in parts:
        out &= text.contains(p)
    return out


def _candidate(symbols: DataFrame, tokens: list[str]) -> Column:
    """Whether a symbol is a candidate for any token; asks once which tokens need their characters instead of grams."""
    tests = {(t, d): (_holds(F.col(f"__{d}"), E.token_grams(t)[1]), _holds(F.col(f"__{d}"), list(dict.fromkeys(t)))) for t in tokens for d, _ in DOMAINS}
    asked = [k for k in tests if len(k[0]) > 1]
    found = symbols.agg(*[F.max(tests[k][0]).alias(str(i)) for i, k in enumerate(asked)]).first() if asked else []
    out = F.lit(False)
    for k, (grams, letters) in tests.items():
        out |= grams if k not in asked or found[asked.index(k)] else letters
    return out


def _with_hotspots(symbols: DataFrame, hotspots: DataFrame | None) -> DataFrame:
    if hotspots is None:
        return symbols.withColumn("hotspot", F.lit(0.0))
    scores = hotspots.select("uri", F.col("score").alias("hotspot"))
    return symbols.join(scores, "uri", "left").withColumn("hotspot", F.coalesce("hotspot", F.lit(0.0)))


def rank_order() -> list[Column]:
    """The total order of results."""
    return [F.round("score", 9).desc(), F.asc("name"), F.asc("uri"), F.asc("start_line"), F.asc("start_char"), F.asc("symbol_id")]


def search(symbols: DataFrame, q: str, limit: int = 50, complexity_cap: int = 50, kinds: list[int] | None = None, hotspots: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` symbols for ``q``, ranked, with ``score``, ``hotspot`` and ``tech_debt``.

    ``kinds`` of none keeps all kinds, an empty list none. An empty query
    returns all symbols by their factors.
    """
    tokens = q.lower().split()
    rows = texts(symbols)
    if tokens:
        rows = rows.filter(_candidate(rows, list(dict.fromkeys(tokens))))
    return ranked(rows.drop("__name", "__container"), q, limit, complexity_cap, kinds, hotspots)


def ranked(candidates: DataFrame, q: str, limit: int = 50, complexity_cap: int = 50, kinds: list[int] | None = None, hotspots: DataFrame | None = None) -> DataFrame:
    """The best of a query's candidates, as :func:`search` gives them."""
    tokens = q.lower().split()
    rows = texts(candidates)
    if kinds is not None:
        rows = rows.filter(F.col("kind").isin(*kinds) if kinds else F.lit(False))
    raw = F.lit(1.0)
    if tokens:
        names, containers = F.lit(0.0), F.lit(0.0)
        for t in tokens:
            names += E.grade(F.col("__name"), t, E.NAME_GRADES)
            containers += E.grade(F.col("__container"), t, E.CONTAINER_GRADES)
        raw = E.raw_score(names, containers)
    cc = F.col("cyclomatic_complexity")
    scored = _with_hotspots(rows, hotspots).withColumn("score", E.final_score(raw, F.col("kind"), F.col("hotspot"), cc)).filter("score > 0")
    out = scored.withColumn("tech_debt", E.tech_debt(F.col("hotspot"), cc, complexity_cap)).drop("__name", "__container")
    return out.orderBy(*rank_order()).limit(limit)


def postings(symbols: DataFrame, *others: str) -> DataFrame:
    """(domain, n, gram, symbol_id, others): the distinct grams of one to three characters of names and containers."""
    lists = [_grams(domain, column, n) for domain, column in DOMAINS for n in (1, 2, 3)]
    return symbols.select("symbol_id", *others, F.explode(F.concat(*lists)).alias("p")).select("p.domain", "p.n", "p.gram", "symbol_id", *others)


def distinct_postings(symbols: DataFrame) -> DataFrame:
    """(domain, n, gram, symbol_id), each once, also where several rows of ``symbols`` hold one id.

    Rows of an id are brought together before they become grams, which are many more.
    """
    held = [F.collect_set(F.lower(F.coalesce(F.col(column), F.lit("")))).alias(domain) for domain, column in DOMAINS]

    def grams(domain: str, n: int) -> Column:
        found = F.array_distinct(F.flatten(F.transform(domain, lambda t: E.ngrams(t, n))))
        return F.transform(found, lambda g: F.struct(F.lit(domain).alias("domain"), F.lit(n).alias("n"), g.alias("gram")))

    lists = F.concat(*[grams(domain, n) for domain, _ in DOMAINS for n in (1, 2, 3)])
    return symbols.groupBy("symbol_id").agg(*held).select("symbol_id", F.explode(lists).alias("p")).select("p.domain", "p.n", "p.gram", "symbol_id")


def _grams(domain: str, column: str, n: int) -> Column:
    return F.transform(E.ngrams(F.lower(F.coalesce(F.col(column), F.lit(""))), n), lambda g: F.struct(F.lit(domain).alias("domain"), F.lit(n).alias("n"), g.alias("gram")))


def intersect(index: DataFrame | PostingIndex, wanted: DataFrame) -> DataFrame:
    """Of each group in ``wanted`` (key, domain, n, gram, size), the symbols whose postings hold all its grams.

    Mark a small ``wanted`` by ``F.broadcast``: one made in the driver has no
    known size, and Spark may then broadcast the postings instead.
    """
    rows = index if isinstance(index, DataFrame) else index.among(wanted)
    met = wanted.join(rows, ["domain", "n", "gram"]).groupBy("key", "size", "symbol_id").agg(F.count_distinct("gram").alias("found"))
    return met.filter("found = size").select("key", "symbol_id")


def _best_of_kinds(symbols: DataFrame, limit: int) -> DataFrame:
    """(best_kind, symbol_id): the best ``limit`` symbols of each kind without a query, and under null those of all kinds."""
    factors = E.final_score(F.lit(1.0), F.col("kind"), F.col("hotspot"), F.col("cyclomatic_complexity"))
    scored = symbols.withColumn("score", factors).filter("score > 0")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(*rank_order()))
    each = scored.filter("kind IS NOT NULL").withColumn("place", place).filter(F.col("place") <= F.lit(limit)).select(F.col("kind").alias("best_kind"), "symbol_id")
    every = scored.orderBy(*rank_order()).limit(limit).select(F.lit(None).cast("int").alias("best_kind"), "symbol_id")
    return each.union(every)


def search_batch(symbols: DataFrame, queries: DataFrame, hotspots: DataFrame | None = None, index: DataFrame | PostingIndex | None = None) -> DataFrame:
    """The best ``lim`` symbols for each row of ``queries`` (qid, q, lim, complexity_cap, kinds), with ``rank``.

    ``index`` are the postings of ``symbols``, written here if none are given; give
    a stored table or :class:`~symlens.operators.postings.PostingIndex` for repeated batches. The hits by whole grams are written too,
    as they also say which tokens need their characters. The greatest ``lim`` is
    asked for once. Results equal those of :func:`search`.
    """
    index = settle(postings(symbols)) if index is None else index
    tokens = F.filter(F.split(F.lower("q"), r"\s+"), lambda t: t != "")
    asked = queries.select("qid", "lim", "complexity_cap", "kinds", tokens.alias("tokens"))
    one = asked.select("qid", F.explode(F.array_distinct("tokens")).alias("token"))
    wide = one.select("qid", "token", F.explode(F.array(*[F.lit(d) for d, _ in DOMAINS])).alias("domain"))
    size = F.least(F.char_length("token"), F.lit(3))
    by_size = F.when(size == 1, E.ngrams(F.col("token"), 1)).when(size == 2, E.ngrams(F.col("token"), 2)).otherwise(E.ngrams(F.col("token"), 3))
    keyed = wide.withColumn("key", F.struct("qid", "token", "domain"))
    grams = keyed.select("key", "domain", size.alias("n"), by_size.alias("grams"))
    spread = lambda df: df.select("key", "domain", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    direct = settle(intersect(index, spread(grams)))
    missed = keyed.filter(F.char_length("token") > 1).join(direct.select("key").distinct(), "key", "left_anti")
    letters = missed.select("key", "domain", F.lit(1).alias("n"), E.ngrams(F.col("token"), 1).alias("grams"))
    pairs = direct.union(intersect(index, spread(letters))).select("key.qid", "symbol_id").distinct()
    most = asked.agg(F.max("lim"), F.max(F.when(F.size("tokens") == 0, F.col("lim")))).first()
    if most[1]:
        best = _best_of_kinds(_with_hotspots(symbols, hotspots), most[1])
        kinds = F.array_compact(F.array_distinct("kinds"))
        free = asked.filter((F.size("tokens") == 0) & (F.col("kinds").isNull() | (F.size(kinds) > 0)))
        free = free.select("qid", F.explode_outer(kinds).alias("asked_kind"))
        pairs = pairs.union(free.join(best, F.col("asked_kind").eqNullSafe(F.col("best_kind"))).select("qid", "symbol_id"))
    rows = pairs.join(asked, "qid").join(_with_hotspots(texts(symbols), hotspots), "symbol_id")
    rows = rows.filter(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    total = lambda text, grades: F.aggregate("tokens", F.lit(0.0), lambda s, t: s + E.grade(F.col(text), t, grades))
    raw = F.when(F.size("tokens") == 0, 1.0).otherwise(E.raw_score(total("__name", E.NAME_GRADES), total("__container", E.CONTAINER_GRADES)))
    cc = F.col("cyclomatic_complexity")
    scored = rows.withColumn("score", E.final_score(raw, F.col("kind"), F.col("hotspot"), cc)).filter("score > 0")
    # the greatest limit as a literal cuts each query's rows before they are moved
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*rank_order()))).filter(F.col("rank") <= F.lit(most[0] or 0)).filter("rank <= lim")
    return ranked.withColumn("tech_debt", E.tech_debt(F.col("hotspot"), cc, F.col("complexity_cap"))).drop("__name", "__container", "tokens", "kinds", "lim", "complexity_cap")
