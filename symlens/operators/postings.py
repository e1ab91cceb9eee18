"""A stored, maintained index of grams: immutable runs, tombstones, a table of list lengths.

A run holds the symbols of one upsert, their postings, how many each gram has,
and what the upsert put an end to: URIs and symbol ids whose rows in earlier runs
no longer count. Postings and lengths lie in folders by a hash of the gram, symbols
by a hash of their id, so that a search reads the folders of its grams. A commit
log names the runs. Neighbouring runs of like sizes are merged, so that there are
few, and a row is rewritten a number of times that grows with the logarithm of the
index: an upsert writes in proportion to its batch.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.functions import exprs as E
from symlens.functions import schema as S
from symlens.operators import search as scan
from symlens.operators.store import recomputed
from symlens.sources.commits import CommitLog
from symlens.sources.tables import settle

_SYMBOLS = S.SYMBOLS + ", shelf int"
_POSTINGS = "domain string, n int, gram string, symbol_id string, request_uri string, bucket int"
_LENGTHS = "domain string, n int, gram string, length long, bucket int"
_GONE = "what string, key string"
#: A run is merged with the one before it unless that one is this many times its size.
RATIO = 2


class PostingIndex:
    """The index under ``path``; methods that change it commit a version and fail if another writer was faster."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, shelves: int = 16):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)
        _, state = self.log.latest()
        self.buckets, self.shelves = state.get("buckets", buckets), state.get("shelves", shelves)
        self._read: dict[tuple[str, str], DataFrame] = {}  # a run never changes, so its files are listed once

    def runs(self) -> list[dict]:
        """The runs that make up the index, oldest first."""
        return self.log.latest()[1].get("runs", [])

    def bucket(self, domain: str, gram: str) -> int:
        return zlib.crc32(f"{domain}:{gram}".encode()) % self.buckets

    def _bucket(self):
        return (F.crc32(F.concat_ws(":", "domain", "gram")) % self.buckets).cast("int").alias("bucket")

    def _shelf(self):
        return (F.crc32("symbol_id") % self.shelves).cast("int").alias("shelf")

    def _table(self, name: str, schema: str, runs: list[dict]) -> DataFrame:
        """Rows of a table of these runs, with the ``run`` that they are of."""
        parts = []
        for r in runs:
            key = (r["folder"], name)
            if key not in self._read:
                self._read[key] = self.spark.read.schema(schema).parquet(f"{self.path}/{r['folder']}/{name}")
            parts.append(self._read[key].withColumn("run", F.lit(r["version"])))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, run int")

    def _live(self, rows: DataFrame, runs: list[dict]) -> DataFrame:
        """``rows`` (run, request_uri, symbol_id, ...) that no later one of the runs has put an end to."""
        if len(runs) < 2:
            return rows
        gone = self._table("gone", _GONE, runs[1:]).withColumnRenamed("run", "__later")
        for what, column in (("uri", "request_uri"), ("id", "symbol_id")):
            ended = gone.filter(F.col("what") == what).select(F.col("key").alias("__key"), "__later")
            rows = rows.join(ended, (F.col(column) == F.col("__key")) & (F.col("__later") > F.col("run")), "left_anti")
        return rows

    def symbols(self) -> DataFrame:
        """The symbols that the index holds now."""
        runs = self.runs()
        return self._live(self._table("symbols", _SYMBOLS, runs), runs).drop("run", "shelf")

    def postings(self) -> DataFrame:
        """(domain, n, gram, symbol_id) as :func:`symlens.operators.search.postings` gives them."""
        runs = self.runs()
        return self._live(self._table("postings", _POSTINGS, runs), runs).select("domain", "n", "gram", "symbol_id")

    def among(self, wanted: DataFrame) -> DataFrame:
        """Postings of the grams in ``wanted`` (domain, n, gram) only: other rows are dropped before any tombstone is asked for."""
        runs = self.runs()
        grams = wanted.select("domain", "n", "gram").distinct().select("*", self._bucket())
        held = self._table("postings", _POSTINGS, runs).join(grams, ["bucket", "domain", "n", "gram"], "left_semi")
        return self._live(held, runs).select("domain", "n", "gram", "symbol_id")

    def _write(self, symbols: DataFrame, postings: DataFrame, gone: DataFrame) -> dict:
        """A run's tables in a folder of its own, not yet part of the index."""
        folder = f"run-{uuid.uuid4().hex}"
        at = f"{self.path}/{folder}"
        columns = [c.split()[0] for c in S.SYMBOLS.split(", ")]
        rows = symbols.select(*columns, self._shelf())
        rows.repartition("shelf").write.partitionBy("shelf").parquet(f"{at}/symbols")
        placed = postings.select("domain", "n", "gram", "symbol_id", "request_uri", self._bucket())
        placed.repartition("bucket").sortWithinPartitions("bucket", "domain", "gram").write.partitionBy("bucket").parquet(f"{at}/postings")
        held = self.spark.read.schema(_POSTINGS).parquet(f"{at}/postings")
        lengths = held.groupBy("bucket", "domain", "n", "gram").agg(F.count("*").alias("length"))
        lengths.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{at}/lengths")
        gone.select("what", "key").write.parquet(f"{at}/gone")
        return {"folder": folder, "rows": self.spark.read.schema(_SYMBOLS).parquet(f"{at}/symbols").count() + self.spark.read.schema(_GONE).parquet(f"{at}/gone").count()}

    def _commit(self, read: int, runs: list[dict]) -> None:
        self.log.commit(read, {"buckets": self.buckets, "shelves": self.shelves, "runs": runs})

    def upsert(self, batch: DataFrame, uris: Iterable[str] | DataFrame | None = None, merge: bool = True) -> dict:
        """Replace all symbols of the batch's URIs, and of ``uris``, which may have none; returns the new run.

        As for :func:`symlens.operators.store.replace_symbols`: of equal ids of a
        URI the first counts, and an id that another URI holds goes to the batch.
        """
        read, state = self.log.latest()
        new = settle(recomputed(batch))
        given = [(u,) for u in uris] if uris is not None and not isinstance(uris, DataFrame) else []
        more = uris.select(F.col("uri").alias("key")) if isinstance(uris, DataFrame) else self.spark.createDataFrame(given, "key string")
        ended = new.select(F.col("request_uri").alias("key")).union(more).distinct().select(F.lit("uri").alias("what"), "key")
        gone = ended.union(new.select(F.lit("id"), "symbol_id").distinct())
        postings = scan.postings(new, "request_uri")
        run = self._write(new, postings, gone) | {"version": read + 1}
        self._commit(read, [*state.get("runs", []), run])
        if merge:
            self.merge()
        return run

    def remove(self, uris: Iterable[str] | DataFrame, merge: bool = True) -> dict:
        """Take the symbols of ``uris`` out of the index."""
        return self.upsert(self.spark.createDataFrame([], S.SYMBOLS), uris, merge)

    def merge(self) -> int:
        """Merge the last runs into one where their sizes ask for it; returns how many were."""
        runs = self.runs()
        at, size = len(runs) - 1, runs[-1]["rows"] if runs else 0
        while at > 0 and runs[at - 1]["rows"] <= RATIO * size:
            at -= 1
            size += runs[at]["rows"]
        return self._merge(max(0, at))

    def compact(self) -> int:
        """Merge all runs into one, without tombstones; returns how many there were. Rewrites the whole index."""
        return self._merge(0)

    def _merge(self, at: int) -> int:
        read, state = self.log.latest()
        runs = state.get("runs", [])
        some = runs[at:]
        if len(some) < 2:
            return 0
        symbols = self._live(self._table("symbols", _SYMBOLS, some), some)
        postings = self._live(self._table("postings", _POSTINGS, some), some)
        gone = self._table("gone", _GONE, some if at else []).select("what", "key").distinct()
        run = self._write(symbols, postings, gone) | {"version": some[-1]["version"]}
        self._commit(read, [*runs[:at], run])
        return len(some)

    def drop_unused(self) -> list[str]:
        """Delete runs that the last version doesn't name. Readers of earlier versions must be done."""
        self._read.clear()
        return self.log.drop_unnamed({r["folder"] for r in self.runs()}, "run-")

    def _lengths(self, grams: set[tuple[str, int, str]], runs: list[dict]) -> dict[tuple[str, int, str], int]:
        """How many postings each gram has at most; absent ones have none. The driver gets a row for each gram and run asked for."""
        rows = self._of(self._table("lengths", _LENGTHS, runs), grams).groupBy("domain", "n", "gram").agg(F.sum("length").alias("length"))
        return {(r.domain, r.n, r.gram): r.length for r in rows.collect()}

    def _of(self, rows: DataFrame, grams: set[tuple[str, int, str]]) -> DataFrame:
        """Rows of these grams; reads their buckets alone."""
        some = F.lit(False)
        for domain, n in sorted({(d, n) for d, n, _ in grams}):
            some |= (F.col("domain") == domain) & (F.col("n") == n) & F.col("gram").isin(*sorted(g for d, k, g in grams if (d, k) == (domain, n)))
        return rows.filter(F.col("bucket").isin(*sorted({self.bucket(d, g) for d, _, g in grams})) & some)

    def _holders(self, grams: set[tuple[str, int, str]], runs: list[dict]) -> DataFrame:
        """The live symbols in the lists of any of these grams."""
        key = ["run", "request_uri", "symbol_id"]
        ids = self._live(self._of(self._table("postings", _POSTINGS, runs), grams).select(*key), runs)
        return self._table("symbols", _SYMBOLS, runs).join(ids.select("*", self._shelf()), [*key, "shelf"], "left_semi").drop("run", "shelf")

    def search(self, q: str, limit: int = 50, complexity_cap: int = 50, kinds: list[int] | None = None, hotspots: DataFrame | None = None) -> DataFrame:
        """What :func:`symlens.operators.search.search` gives for the symbols of the index, from the lists of the query's grams.

        Of each token and column only the shortest list is read; the texts of its
        symbols are then asked for the other grams. Lengths alone say that a token
        has no symbol where a gram has no list; only where all have one, its
        symbols are asked, once, whether one holds them all.
        """
        tokens = list(dict.fromkeys(q.lower().split()))
        runs = self.runs()
        if not tokens:
            return scan.ranked(self.symbols(), q, limit, complexity_cap, kinds, hotspots)
        if not runs:
            return scan.ranked(self.symbols().limit(0), q, limit, complexity_cap, kinds, hotspots)
        keys = [(t, d) for t in tokens for d, _ in scan.DOMAINS]
        whole = {(t, d): [(d, *x) for x in _sized(*E.token_grams(t))] for t, d in keys}
        letters = {(t, d): [(d, 1, c) for c in dict.fromkeys(t)] for t, d in keys}
        length = self._lengths({g for lists in (whole, letters) for grams in lists.values() for g in grams}, runs)
        shortest = lambda grams: min(grams, key=lambda g: (length.get(g, 0), g))
        direct = [k for k in keys if all(g in length for g in whole[k])]
        # a single run has no dead postings, so that the one list of a short token answers for itself
        asked = [k for k in direct if len(k[0]) > 1 and (len(whole[k]) > 1 or len(runs) > 1)]
        if asked:
            rows = scan.texts(self._holders({shortest(whole[k]) for k in asked}, runs))
            found = rows.agg(*[F.max(_holds(whole[k])).alias(str(i)) for i, k in enumerate(asked)]).first()
            direct = [k for k in direct if k not in asked or found[asked.index(k)]]
        used = [whole[k] for k in direct] + [letters[k] for k in keys if k not in direct and len(k[0]) > 1]
        used = [grams for grams in used if all(g in length for g in grams)]
        any_of = F.lit(False)
        for grams in used:
            any_of |= _holds(grams)
        rows = scan.texts(self._holders({shortest(grams) for grams in used}, runs)).filter(any_of) if used else self.symbols().limit(0)
        return scan.ranked(rows.drop("__name", "__container"), q, limit, complexity_cap, kinds, hotspots)


def _sized(n: int, grams: list[str]) -> list[tuple[int, str]]:
    return [(n, g) for g in grams]


def _holds(grams: list[tuple[str, int, str]]):
    out = F.lit(True)
    for domain, _, gram in grams:
        out &= F.col(f"__{domain}").contains(gram)
    return out
