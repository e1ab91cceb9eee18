"""Project roots: registry, and snapshots and hotspots of each root."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable, Iterable, Mapping
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symlens.functions.exprs import file_uri
from symlens.operators import hotspots
from symlens.operators.store import SymbolStore
from symlens.sources import git, snapshot

log = logging.getLogger("symlens")


def local_path(uri: str) -> str | None:
    """The path of a file URI; None for others."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme == "file" else None


def find_root(path: str) -> str | None:
    """The nearest folder at or above ``path`` that holds a ``.git``."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        at, before = os.path.dirname(at), at
        if at == before:
            return None
    return at


class Roots:
    """The roots in use, on the driver: a handful of folders."""

    def __init__(self, find: Callable[[str], str | None] = find_root):
        self._find, self._held = find, set()

    def of(self, uri: str) -> str | None:
        path = local_path(uri)
        return None if path is None else self._find(os.path.dirname(path))

    def register(self, uri: str) -> str | None:
        if root := self.of(uri):
            self._held.add(root)
        return root

    def listing(self) -> list[str]:
        """Distinct roots in order."""
        return sorted(self._held)

    def clear(self) -> None:
        self._held.clear()


def roots_of(uris: DataFrame, roots: Iterable[str]) -> DataFrame:
    """(root): those of ``roots`` under which any of ``uris`` (uri) lies, distinct and in order."""
    names = list(roots)
    hit = F.array_compact(F.array(*[F.when(F.col("uri").startswith("file://" + r.rstrip("/") + "/"), F.lit(r)) for r in names])) if names else F.array().cast("array<string>")
    return uris.select(F.explode(hit).alias("root")).distinct().orderBy("root")


def default_path(root: str) -> str:
    """Where a root's snapshot lies unless a path is given."""
    return f"{root.rstrip('/')}/.cache/symlens/index"


def _each(roots: Iterable[str], step: Callable[[str], bool]) -> tuple[bool, str | None]:
    """Whether a step did anything, and the first error; an error stops no other root."""
    any_done, first = False, None
    for root in roots:
        try:
            any_done |= bool(step(root))
        except Exception as e:  # a root that fails leaves the others alone
            log.warning("snapshot of %s: %s", root, e)
            first = first or str(e)
    return any_done, first


def load_roots(store: SymbolStore, roots: Iterable[str], options: Mapping[str, Any], path_of: Callable[[str], str] = default_path, remote_of: Callable[[str], str] | None = None) -> tuple[SymbolStore, bool, str | None]:
    """The store with each root's snapshot merged, whether any was, and the first error. Roots without a snapshot are passed over."""
    held = [store]

    def step(root: str) -> bool:
        path = path_of(root)
        if remote_of and options["remote_cache"]["enabled"] and options["remote_cache"]["load_on_start"]:
            snapshot.copy(store.spark, remote_of(root), path)
        if not snapshot.exists(store.spark, path):
            return False
        held[0] = held[0].merge(path)
        return True

    done, error = _each(roots if options["enabled"] and options["load_on_start"] else [], step)
    return held[0], done, error


def save_roots(store: SymbolStore, roots: Iterable[str], options: Mapping[str, Any], path_of: Callable[[str], str] = default_path, remote_of: Callable[[str], str] | None = None) -> tuple[bool, str | None]:
    """Write a snapshot of each root's part of the store; whether any was written, and the first error."""

    def step(root: str) -> bool:
        path = path_of(root)
        store.save(path, "file://" + root.rstrip("/") + "/")
        if remote_of and options["remote_cache"]["enabled"] and options["remote_cache"]["save_on_exit"]:
            snapshot.copy(store.spark, path, remote_of(root))
        return True

    return _each(roots if options["enabled"] and options["save_on_exit"] else [], step)


def root_hotspots(spark: SparkSession, roots: Iterable[str], options: Mapping[str, Any], now: int | None = None, lines: Callable[..., DataFrame] = git.log_lines) -> DataFrame:
    """(uri, score) of all roots, by churn or by commits; each root is normalised by itself, and one whose log fails has none.

    ``options`` are those of the hotspots; ``lines`` gives (root, line_no, line)
    of all roots at once.
    """
    churn, known = options["use_churn"], list(roots)
    arguments = ["--numstat", "--format=%ct"] if churn else ["--name-only", "--pretty=format:"]
    text = lines(spark, known, [*arguments, f"--since={options['since']}"]).filter("line IS NOT NULL")
    raw = hotspots.churn_scores(git.parse_numstat(text), int(time.time()) if now is None else now, options["half_life_days"]) if churn else hotspots.commit_scores(git.parse_names(text))
    scored = hotspots.normalize(raw, options["max_files"])
    return scored.select(file_uri(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), F.col("path"))).alias("uri"), "score")
