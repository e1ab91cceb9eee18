"""Parameters of the registered queries, shared by their plans and their SQL."""

#: Query text and options by name.
SEARCHES = {
    "search_exact": ("bolt", {}),
    "search_prefix": ("red", {"hot": True}),
    "search_substring": ("widget", {}),
    "search_subsequence_fallback": ("rwd", {}),
    "search_fallback_suppressed": ("bt", {}),
    "search_container_only": ("brand#1", {}),
    "search_multi_token": ("small ring", {}),
    "search_kind_filter": ("b", {"kinds": [6, 9, 12]}),
    "search_empty_query": ("", {"hot": True}),
    "search_no_match": ("zzz", {}),
    "search_hotspot_boost": ("gear", {"hot": True, "limit": 100}),
    "search_tech_debt": ("hot", {"hot": True, "cap": 20, "kinds": [6, 9, 12]}),
    "search_two_partial": ("gr b", {"hot": True}),
}
BATCH = [("bolt", {"limit": 10}), ("rwd", {"limit": 20}), ("small ring", {}), ("brand#1", {"limit": 30}), ("b", {"kinds": [6, 9, 12]}), ("", {"limit": 5}), ("zzz", {}), ("gr b", {"cap": 10})]
GRADE_TOKENS = ["bolt", "red", "ring", "rwd", "sg", "zz"]
