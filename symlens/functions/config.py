"""Options of searches, hotspots, metrics and snapshots. A bad value gives way to its default and a warning."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

#: Names and defaults of the options.
DEFAULTS: dict[str, dict[str, Any]] = {
    "search": {"limit": 50, "debounce_ms": 100},
    "hotspots": {"enabled": True, "since": "3 months ago", "max_files": 1000, "half_life_days": 30, "use_churn": True},
    "metrics": {"enabled": True, "complexity_cap": 50},
    "snapshot": {"enabled": True, "load_on_start": True, "save_on_exit": True, "remote_cache": {"enabled": False, "dir": None, "load_on_start": True, "save_on_exit": True}},
}


def _whole(least: int) -> Callable[[Any], bool]:
    return lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) and x >= least


def _text(x: Any) -> bool:
    return isinstance(x, str) and x != ""


def _rule(path: str, default: Any) -> tuple[Callable[[Any], bool], str]:
    if isinstance(default, bool):
        return lambda x: isinstance(x, bool), "a boolean"
    if path == "search.debounce_ms":
        return _whole(0), "a non-negative integer"
    if isinstance(default, int):
        return _whole(1), "a positive integer"
    if default is None:
        return lambda x: x is None or _text(x), "a non-empty string or none"
    return _text, "a non-empty string"


def validate(options: Mapping[str, Any] | None = None) -> tuple[dict[str, Any], list[str]]:
    """The options merged over the defaults, and the warnings. Never raises."""
    warnings: list[str] = []
    if options is not None and not isinstance(options, Mapping):
        warnings.append(f"options must be a mapping, got {type(options).__name__}")
        options = {}

    def merge(given: Mapping[str, Any], known: Mapping[str, Any], path: str) -> dict[str, Any]:
        warnings.extend(f"unknown config key: {path}{key}" for key in given if key not in known)
        out = {}
        for key, default in known.items():
            value, full = given.get(key, default), f"{path}{key}"
            if isinstance(default, Mapping):
                if not isinstance(value, Mapping):
                    warnings.append(f"{full} must be a mapping")
                    value = {}
                out[key] = merge(value, default, f"{full}.")
                continue
            good, wanted = _rule(full, default)
            if not good(value):
                warnings.append(f"{full} must be {wanted}, got {value!r}")
                value = default
            out[key] = value
        return out

    return merge(options or {}, DEFAULTS, ""), warnings


def search_params(q: str, options: Mapping[str, Any], kinds: list[int] | None = None) -> dict[str, Any]:
    """Arguments of a search from validated ``options``; ``kinds`` only where given."""
    out = {"q": q, "limit": options["search"]["limit"], "complexity_cap": options["metrics"]["complexity_cap"]}
    return out if kinds is None else out | {"kinds": kinds}
