"""Formulas of ranking, churn and impact as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades exact, prefix, substring, subsequence for names and containers.
NAME_GRADES = (100.0, 80.0, 60.0, 40.0)
CONTAINER_GRADES = (24.0, 16.0, 10.0, 6.0)
CONTAINER_SHARE, CONTAINER_FLOOR = 0.35, 40.0
HOTSPOT_WEIGHT, COMPLEXITY_WEIGHT = 0.15, 0.10
#: Factor by kind in searches, and base by kind for the top symbols of a file.
SEARCH_KINDS = (((6, 9, 12), 1.15), ((5, 11, 23), 1.08), ((7, 8, 13, 14), 1.03))
TOP_KINDS = (((12, 6), 3.0), ((5, 23), 2.5), ((9,), 2.0), ((14, 15), 1.5), ((13,), 1.0))
#: Weight of a change by its type.
CHANGE_WEIGHTS = {"added": 1.0, "modified": 0.8, "deleted": 1.0, "renamed": 0.5}


def ngrams(text: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters in order of appearance; none if the text is shorter."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def runs(c: Column) -> Column:
        # parts of an array, since a substring would be counted off from the start each time
        starts = F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(c, i + j) for j in range(n)])))
        return F.when(F.size(c) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(letters), runs)[0]


def token_grams(token: str) -> tuple[int, list[str]]:
    """Gram size and distinct grams that candidates for a token must hold."""
    n = min(len(token), 3)
    return n, list(dict.fromkeys(token[i : i + n] for i in range(len(token) - n + 1)))


def _subsequence_pattern(token: str) -> str:
    return "(?s)" + ".*".join(r"\Q" + c + r"\E" for c in token)


def is_subsequence(text: Column, token: Column) -> Column:
    """Whether the token's characters stand in the text in order, for a token that is a column."""
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    end = F.aggregate(letters, F.lit(0), lambda at, c: F.when(at < 0, at).otherwise(_next(c, text, at)))
    return end >= 0


def _next(c: Column, text: Column, at: Column) -> Column:
    found = F.call_function("locate", c, text, at + 1)
    return F.when(found > 0, found).otherwise(F.lit(-1))


def grade(text: Column, token: str | Column, grades: Iterable[float]) -> Column:
    """Grade of a token in a lower-cased text: equal, prefix, substring, subsequence or 0."""
    exact, prefix, inside, scattered = map(F.lit, grades)
    if isinstance(token, str):
        scatter, t = text.rlike(_subsequence_pattern(token)), F.lit(token)
    else:
        scatter, t = is_subsequence(text, token), token
    hit = F.when(text == t, exact).when(text.startswith(t), prefix).when(text.contains(t), inside).when(scatter, scattered).otherwise(0.0)
    return F.when((F.coalesce(text, F.lit("")) == "") | (t == ""), 0.0).otherwise(hit)


def _by_kind(kind: Column, table, other: float) -> Column:
    out = F.when(kind.isin(*table[0][0]), table[0][1])
    for kinds, value in table[1:]:
        out = out.when(kind.isin(*kinds), value)
    return out.otherwise(other)


def kind_factor(kind: Column) -> Column:
    return _by_kind(kind, SEARCH_KINDS, 1.0)


def finite(x: Column) -> Column:
    """The number, or 0 where it is null, NaN or infinite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def hotspot_factor(h: Column) -> Column:
    return 1 + F.least(F.greatest(finite(h), F.lit(0.0)), F.lit(1.0)) * HOTSPOT_WEIGHT


def complexity_factor(cc: Column) -> Column:
    """1 without metrics; else it rises with the logarithm of the complexity."""
    return F.coalesce(1 + F.log(F.greatest(cc, F.lit(1)).cast("double")) * COMPLEXITY_WEIGHT, F.lit(1.0))


def raw_score(name_sum: Column, container_sum: Column) -> Column:
    """Name grades plus container bonus, which is capped by the names."""
    return name_sum + F.least(container_sum, F.greatest(name_sum, F.lit(CONTAINER_FLOOR)) * CONTAINER_SHARE)


def final_score(raw: Column, kind: Column, h: Column, cc: Column) -> Column:
    return F.when(raw <= 0, 0.0).otherwise(raw * kind_factor(kind) * hotspot_factor(h) * complexity_factor(cc))


def tech_debt(h: Column, cc: Column, cap: int | Column) -> Column:
    """Hotspot times capped share of complexity; null without metrics."""
    top = F.greatest(cap if isinstance(cap, Column) else F.lit(cap), F.lit(1))
    return F.when(cc.isNotNull(), h * (F.least(cc, top) / top))


def top_symbol_score(kind: Column, h: Column, cc: Column) -> Column:
    return _by_kind(kind, TOP_KINDS, 0.5) * (1 + h * 0.5) * complexity_factor(cc)


def decay(commit_time: Column, now: float, half_life_days: float = 30.0) -> Column:
    """Weight that halves every ``half_life_days``; above 1 for times after ``now``."""
    return F.exp(-F.lit(math.log(2.0) / half_life_days) * ((F.lit(now) - commit_time) / 86400.0))


def churn(additions: Column, deletions: Column) -> Column:
    return additions + 1.5 * deletions


def impact_score(change_type: Column, callers: Column, callees: Column, h: Column) -> Column:
    weight = F.lit(0.5)
    for name, w in CHANGE_WEIGHTS.items():
        weight = F.when(change_type == name, w).otherwise(weight)
    return weight * (1 + F.least(callers, F.lit(10)) / 10 * 0.5 + F.least(callees, F.lit(10)) / 10 * 0.3 + h * 0.4)


def estimated_debt(lines: Column) -> Column:
    return F.when(lines > 50, F.least(lines / 100, F.lit(1.0)))


def file_uri(path: Column) -> Column:
    """``file://`` and the path, each part percent-encoded."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://"), F.array_join(parts, "/"))


def uri_path(uri: Column) -> Column:
    """The path of a file URI, null for any other."""
    path = F.replace(F.substring(uri, F.lit(8), F.length(uri)), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file://"), F.url_decode(path))


def shorten(path: Column, root: Column | str) -> Column:
    """The path without ``root/`` before it."""
    prefix = F.concat(root if isinstance(root, Column) else F.lit(root), F.lit("/"))
    return F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: str, fallback: str) -> str:
    """A name fit for a folder."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name) or fallback
