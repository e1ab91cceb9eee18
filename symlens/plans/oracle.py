"""DuckDB SQL for every registered query, written apart from the plans."""

from __future__ import annotations

from symlens.functions.schema import KIND_NAMES
from symlens.plans.specs import BATCH, GRADE_TOKENS, SEARCHES

VIEWS = """WITH RECURSIVE s AS (
  SELECT sha256(concat_ws(':', uri, name, kind, start_line, start_char, end_line, end_char)) AS symbol_id, *
  FROM (SELECT 'file:///repo_' || (p_partkey % 3) || '/src/' || lower(p_type) || '_' || (p_partkey % 40) || '.ts' AS uri, replace(p_name, ' ', '_') AS name, p_partkey % 26 + 1 AS kind,
      CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS container_name, p_partkey % 97 AS start_line, p_partkey % 7 AS start_char, p_partkey % 97 + p_size AS end_line, 0 AS end_char,
      CASE WHEN p_partkey % 26 + 1 IN (6, 9, 12) THEN p_size END AS cc, p_partkey AS part FROM part)
), num AS (
  SELECT uri, epoch(l_shipdate)::BIGINT AS ct, l_quantity AS adds, l_linenumber AS dels FROM lineitem JOIN s ON l_partkey = part WHERE epoch(l_shipdate) >= 1009843200 - 90 * 86400
), raw_hot AS (
  SELECT uri, sum((adds + 1.5 * dels) * exp(-(ln(2.0) / 30) * ((1009843200 - ct) / 86400.0))) AS score FROM num GROUP BY uri
), hot AS (
  SELECT uri, score / greatest(1.0, (SELECT max(score) FROM raw_hot)) AS score FROM raw_hot QUALIFY row_number() OVER (ORDER BY raw_hot.score DESC, uri) <= 1000
), e AS (
  SELECT a.symbol_id AS caller_symbol_id, b.symbol_id AS callee_symbol_id, CASE l_linenumber % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'reference' ELSE 'import' END AS edge_kind, l_orderkey AS evidence_line, l_linenumber::BIGINT AS evidence_char
  FROM lineitem JOIN s a ON l_partkey = a.part JOIN s b ON (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) = b.part
  QUALIFY row_number() OVER (PARTITION BY a.symbol_id, b.symbol_id, l_linenumber % 3 ORDER BY l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1
), rng AS (
  SELECT 'file:///repo_' || (user_id % 3) || '/src/economy_' || (user_id % 40) || '.ts' AS uri, event_id % 90 AS f, event_id % 90 + event_id % 5 AS l, event_id, event_type FROM events
), fil AS (
  SELECT uri, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'renamed' ELSE 'modified' END AS change_type FROM rng GROUP BY uri
), chg AS (
  SELECT s.*, CASE WHEN change_type = 'renamed' THEN 'added' ELSE change_type END AS change_type FROM s JOIN fil USING (uri)
  WHERE change_type <> 'modified' OR EXISTS (SELECT 1 FROM rng WHERE rng.uri = s.uri AND f <= end_line AND l >= start_line)
), deg AS (
  SELECT symbol_id, sum(i) AS caller_count, sum(o) AS callee_count FROM (SELECT callee_symbol_id AS symbol_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT caller_symbol_id, 0, 1 FROM e) GROUP BY symbol_id
), bfs AS (
  SELECT symbol_id, 0 AS depth FROM chg UNION SELECT caller_symbol_id, depth + 1 FROM bfs JOIN e ON callee_symbol_id = bfs.symbol_id WHERE depth < 3
), aff AS (
  SELECT symbol_id, min(depth) AS depth FROM bfs GROUP BY symbol_id HAVING min(depth) > 0
), imp AS (
  SELECT chg.*, coalesce(caller_count, 0)::BIGINT AS caller_count, coalesce(callee_count, 0)::BIGINT AS callee_count, coalesce(score, 0.0) AS hotspot,
    CASE WHEN end_line - start_line + 1 > 50 THEN least((end_line - start_line + 1) / 100.0, 1.0) END AS tech_debt,
    CASE change_type WHEN 'modified' THEN 0.8 ELSE 1.0 END * (1 + least(coalesce(caller_count, 0), 10) / 10.0 * 0.5 + least(coalesce(callee_count, 0), 10) / 10.0 * 0.3 + coalesce(score, 0.0) * 0.4) AS impact_score
  FROM chg LEFT JOIN deg USING (symbol_id) LEFT JOIN hot USING (uri)
), risk AS (
  SELECT symbol_id, name, uri, change_type, caller_count, callee_count, hotspot, impact_score FROM imp
  UNION ALL SELECT symbol_id, name, uri, 'affected', 0, 0, coalesce(score, 0.0), coalesce(score, 0.0) * 0.5 FROM aff JOIN s USING (symbol_id) LEFT JOIN hot USING (uri)
), center AS (
  SELECT symbol_id FROM deg ORDER BY caller_count + callee_count DESC, symbol_id LIMIT 1
), items AS (
  SELECT 'center' AS section, symbol_id FROM center
  UNION ALL SELECT 'incoming', caller_symbol_id FROM e JOIN center ON callee_symbol_id = symbol_id WHERE edge_kind = 'call'
  UNION ALL SELECT 'outgoing', callee_symbol_id FROM e JOIN center ON caller_symbol_id = symbol_id WHERE edge_kind = 'call'
  UNION ALL SELECT 'reference', caller_symbol_id FROM e JOIN center ON callee_symbol_id = symbol_id WHERE edge_kind = 'reference'
), vw AS (
  SELECT section, symbol_id, name, kind, container_name, uri, start_line, start_char, count(*) AS edge_count, section <> 'center' AS expandable FROM items JOIN s USING (symbol_id) GROUP BY ALL
), top AS (
  SELECT s.*, coalesce(score, 0.0) AS h,
    CASE WHEN kind IN (12, 6) THEN 3.0 WHEN kind IN (5, 23) THEN 2.5 WHEN kind = 9 THEN 2.0 WHEN kind IN (14, 15) THEN 1.5 WHEN kind = 13 THEN 1.0 ELSE 0.5 END * (1 + coalesce(score, 0.0) * 0.5) * coalesce(1 + ln(greatest(cc, 1)) * 0.10, 1.0) AS sc
  FROM s LEFT JOIN hot USING (uri)
), rk AS (
  SELECT *, row_number() OVER (PARTITION BY uri ORDER BY round(sc, 9) DESC, part, symbol_id) AS rank FROM top
)
"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _grade(c: str, t: str, g: tuple) -> str:
    pattern = ".*".join("\\" + x if not x.isalnum() and x != "_" else x for x in t)
    return f"CASE WHEN {c} = '' THEN 0.0 WHEN {c} = {lit(t)} THEN {g[0]} WHEN starts_with({c}, {lit(t)}) THEN {g[1]} WHEN contains({c}, {lit(t)}) THEN {g[2]} WHEN regexp_matches({c}, {lit(pattern)}, 's') THEN {g[3]} ELSE 0.0 END"


def search_sql(q: str, limit: int = 50, cap: int = 50, kinds: list | None = None, hot: bool = False) -> str:
    """One search as a query over the views, ordered, with ``pos`` as the rank."""
    tokens = q.lower().split()
    both = lambda c, parts: "(" + " AND ".join(f"contains({c}, {lit(p)})" for p in parts) + ")"
    admit = []
    for t in dict.fromkeys(tokens):
        n = min(3, len(t))
        for c in ("ln", "lc"):
            grams = both(c, [t[i : i + n] for i in range(len(t) - n + 1)])
            admit.append(grams if len(t) == 1 else f"CASE WHEN bool_or({grams}) OVER () THEN {grams} ELSE {both(c, t)} END")
    names = " + ".join(_grade("ln", t, (100.0, 80.0, 60.0, 40.0)) for t in tokens)
    boxes = " + ".join(_grade("lc", t, (24.0, 16.0, 10.0, 6.0)) for t in tokens)
    raw = f"({names}) + least(({boxes}), greatest(({names}), 40.0) * 0.35)" if tokens else "1.0"
    kept = "true" if kinds is None else f"kind IN ({', '.join(map(str, kinds))})" if kinds else "false"
    h = "coalesce(score, 0.0)" if hot else "0.0"
    return f"""
SELECT symbol_id, name, kind, container_name, uri, start_line, round(sc, 6) AS score, CASE WHEN cc IS NOT NULL THEN round(h * (least(cc, {max(cap, 1)}) / {max(cap, 1)}.0), 6) END AS tech_debt, row_number() OVER (ORDER BY round(sc, 9) DESC, name, uri, start_line, start_char, symbol_id) AS pos
FROM (
  SELECT *, ({raw}) * CASE WHEN kind IN (6, 9, 12) THEN 1.15 WHEN kind IN (5, 11, 23) THEN 1.08 WHEN kind IN (7, 8, 13, 14) THEN 1.03 ELSE 1.0 END * (1 + least(greatest(h, 0.0), 1.0) * 0.15) * coalesce(1 + ln(greatest(cc, 1)) * 0.10, 1.0) AS sc
  FROM (SELECT *, {' OR '.join(admit) or 'true'} AS admitted FROM (SELECT s.*, {h} AS h, lower(name) AS ln, lower(coalesce(container_name, '')) AS lc FROM s {'LEFT JOIN hot USING (uri)' if hot else ''}))
  WHERE admitted AND {kept}
) WHERE sc > 0 QUALIFY pos <= {limit}"""


def _views(sql: str) -> str:
    return VIEWS + sql


DECISION = {
    "lua": "if_statement for_statement while_statement",
    "typescript": "if_statement for_statement while_statement switch_case",
    "go": "if_statement for_statement",
    "ruby": "if_statement for_statement while_statement switch_case elif_clause",
    "python": "if_statement for_statement while_statement elif_clause",
}
_DECIDES = " OR ".join(f"(n.lang = '{k}' AND n.type IN ({', '.join(map(lit, v.split()))}))" for k, v in DECISION.items())
AST = f"""WITH one AS (
  SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL
), n AS (
  SELECT o, (['lua', 'typescript', 'go', 'ruby', 'python'])[(o // 10) % 5 + 1] AS lang,
    (['if_statement', 'for_statement', 'while_statement', 'binary_expression', 'boolean_operator', 'call_expression', 'switch_case', 'elif_clause'])[p % 8 + 1] AS type, (['&&', '||', 'and', '+'])[s % 4 + 1] AS op,
    CASE WHEN n < 5 THEN n ELSE n * 10 + 50 END AS lft, CASE WHEN n < 5 THEN 40 - n ELSE n * 10 + 51 END AS rgt FROM one
), pts AS (
  SELECT o, sum(({_DECIDES})::INT + ((n.lang = 'lua' AND type = 'binary_expression' AND op = 'and') OR (n.lang = 'typescript' AND type = 'binary_expression' AND op IN ('&&', '||')) OR (n.lang = 'python' AND type = 'boolean_operator' AND op = 'and'))::INT) AS points FROM n GROUP BY o
), nest AS (SELECT * FROM n WHERE type IN ('if_statement', 'for_statement', 'while_statement', 'elif_clause')
), dep AS (
  SELECT o, max(k) AS depth FROM (SELECT a.o, a.lft, count(*) AS k FROM nest a JOIN nest b ON a.o = b.o AND b.lft <= a.lft AND b.rgt >= a.rgt GROUP BY ALL) GROUP BY o
)
SELECT o::VARCHAR AS symbol_id, (1 + points)::BIGINT AS cyclomatic_complexity, o % 60 + 1 AS lines_of_code, coalesce(depth, 0) AS nesting_depth FROM pts LEFT JOIN dep USING (o)"""

_RESULT = "symbol_id, name, kind, container_name, uri, start_line, score, tech_debt"
_PATH = "substr(uri, 8)"
_KINDS = "[" + ", ".join(map(lit, KIND_NAMES)) + "]"
_ROOTS = "(SELECT 'repo_' || i AS name, 'file:///repo_' || i || '/' AS prefix FROM range(4) t(i))"
_BY_ROOT = f"SELECT r.name, (SELECT count(*) FROM s WHERE starts_with(uri, prefix)) AS symbol_count, (SELECT count(DISTINCT uri) FROM s WHERE starts_with(uri, prefix)) AS uri_count, (SELECT count(*) FROM hot WHERE starts_with(uri, prefix)) AS hotspot_count FROM {_ROOTS} r"
_GRAM = "SELECT DISTINCT symbol_id, domain, n, substr(t, i, n) AS gram FROM (SELECT symbol_id, domain, n, t, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT symbol_id, 'name' AS domain, lower(name) AS t FROM s UNION ALL SELECT symbol_id, 'container', lower(coalesce(container_name, '')) FROM s), range(1, 4) x(n) WHERE length(t) >= n)"


#: The nodes of the syntax trees, one SELECT a place in a part's tree: number, type, bound, first and last line, condition, operator.
_WORD = lambda *xs: f"([{', '.join(map(lit, xs))}])[k % {len(xs)} + 1]"
_NODES = " UNION ALL ".join(
    f"SELECT k, file, lang, k * 20 + {no} AS lft, k * 20 + {rgt} AS rgt, {kind} AS type, {op} AS op, k * 20 + {first} AS sl, k * 20 + {last} AS el FROM p WHERE {when}"
    for no, kind, rgt, first, last, when, op in (
        (0, lit("function_declaration"), 19, 0, 17, "true", "NULL"),
        (1, _WORD("if_statement", "if_expression", "switch_statement"), 4, 1, 8, "true", "NULL"),
        (2, lit("for_statement"), 3, 2, 5, "k % 2 = 0", "NULL"),
        (5, _WORD("arrow_function", "lambda", "method_definition"), 12, 9, 15, "k % 3 <> 0", "NULL"),
        (6, _WORD("binary_expression", "boolean_operator"), 7, 10, 10, "k % 3 <> 0", _WORD("&&", "and", "or", "+", "||")),
        (8, _WORD("while_statement", "while_expression"), 11, 11, 14, "k % 3 <> 0", "NULL"),
        (9, lit("catch_clause"), 10, 12, 13, "k % 3 <> 0 AND p_size % 2 = 0", "NULL"),
    )
)
_TREE_DECISIONS = {
    "typescript": "if_statement for_statement while_statement catch_clause",
    "lua": "if_statement for_statement while_statement",
    "python": "if_statement for_statement while_statement",
    "rust": "if_expression while_expression",
    "ruby": "if_statement if_expression for_statement while_statement while_expression catch_clause",
}
_TREE_DECIDES = " OR ".join(f"(b.lang = '{k}' AND b.type IN ({', '.join(map(lit, v.split()))}))" for k, v in _TREE_DECISIONS.items())
_TREE_LOGIC = "(b.lang IN ('typescript', 'rust') AND b.type = 'binary_expression' AND b.op IN ('&&', '||')) OR (b.lang = 'lua' AND b.type = 'binary_expression' AND b.op IN ('and', 'or')) OR (b.lang = 'python' AND b.type = 'boolean_operator' AND b.op IN ('and', 'or'))"
_TREE_NESTS = "IN ('if_statement', 'if_expression', 'switch_statement', 'for_statement', 'while_statement', 'while_expression', 'catch_clause')"
#: Each symbol of a server walks up from its place to the first function; a tree's symbol has its own node.
MEASURED = f"""WITH p AS (
  SELECT p_partkey AS k, p_size, p_name, 'file:///repo_' || (p_partkey % 3) || '/tree/' || p_brand || '_' || (p_partkey % 5) || '.ts' AS file, {_WORD('typescript', 'lua', 'python', 'rust', 'ruby').replace('k %', 'p_partkey %')} AS lang FROM part
), n AS ({_NODES}
), fn AS (
  SELECT * FROM n WHERE type LIKE '%function%' OR type LIKE '%method%' OR type = 'lambda'
), fig AS (
  SELECT f.lft, any_value(f.file) AS file, any_value(f.el - f.sl + 1) AS loc, 1 + coalesce(sum((coalesce({_TREE_DECIDES}, false))::INT + (coalesce({_TREE_LOGIC}, false))::INT) FILTER (b.lft > f.lft), 0) AS cc,
    coalesce(max((SELECT count(*) FROM n c WHERE c.k = b.k AND c.lft > f.lft AND c.lft <= b.lft AND c.rgt >= b.rgt AND c.type {_TREE_NESTS})) FILTER (b.type {_TREE_NESTS}), 0) AS depth
  FROM fn f JOIN n b ON b.k = f.k AND b.lft >= f.lft AND b.lft <= f.rgt GROUP BY f.lft
), u AS (
  SELECT DISTINCT file, regexp_extract(file, '#(\\d+)_(\\d)', 1)::INT * 5 + regexp_extract(file, '#(\\d+)_(\\d)', 2)::INT AS i FROM p
), st AS (
  SELECT file, i, CASE WHEN i % 17 = 0 THEN NULL WHEN i % 5 > 1 THEN 'lsp' ELSE 'treesitter' END AS method, i % 17 <> 0 AND i % 5 <= 1 AND i % 7 = 0 AS failed FROM u
), server AS (
  SELECT file AS uri, p_name AS name, k % 26 + 1 AS kind, k * 20 + k % 20 AS sl, k % 4 AS sc, k * 20 + k % 20 + 1 AS el, 0 AS ec,
    CASE WHEN k % 26 + 1 IN (6, 9, 12) THEN (SELECT max(lft) FROM fn WHERE fn.file = p.file AND (fn.sl, fn.sl % 3) <= (p.k * 20 + p.k % 20, p.k % 4) AND (fn.el, 40) > (p.k * 20 + p.k % 20, p.k % 4)) END AS node FROM p
), trees AS (
  SELECT file AS uri, 'f' || lft AS name, 12 AS kind, sl, 0 AS sc, el, 40 AS ec, lft AS node FROM fn WHERE type IN ('function_declaration', 'method_definition')
), got AS (
  SELECT x.*, method FROM server x JOIN st ON uri = file AND method = 'lsp' UNION ALL SELECT x.*, method FROM trees x JOIN st ON uri = file AND method = 'treesitter' AND NOT failed
)
"""

#: What a language server says of every symbol: calls of those that could be prepared, and references.
_ANSWERS = """, li AS (
  SELECT a.symbol_id AS center_id, a.uri AS center_uri, a.part % 5 <> 0 AS ready, b.*, l_orderkey % 500 AS ln, l_linenumber::BIGINT AS ch
  FROM lineitem JOIN s a ON l_partkey = a.part JOIN s b ON (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) = b.part
), ans AS (
  SELECT center_id, center_uri, CASE WHEN ch % 4 = 2 THEN 'outgoing' ELSE 'incoming' END AS section, symbol_id, name, container_name, uri, start_line, start_char, ln, ch, ch % 3 AS n FROM li WHERE ready AND ch % 4 < 3
), refs AS (
  SELECT center_id, center_uri, 'reference' AS section, sha256(concat_ws(':', uri, place, 13, ln, ch, ln, ch + 3)) AS symbol_id, place AS name, substr(uri, 8) AS container_name, uri, ln AS start_line, ch AS start_char, ln, ch, 1 AS n
  FROM (SELECT *, regexp_extract(uri, '[^/]*$') || ':' || (ln + 1) || ':' || (ch + 1) AS place FROM li WHERE ch % 4 = 3)
)
"""

#: Files by their number: which symbols, the server's or the tree's, a file takes.
_FILES = """, num_of AS (
  SELECT DISTINCT uri, regexp_extract(uri, '_([0-9]+)[.]ts$', 1)::INT AS k FROM s
), file AS (
  SELECT uri, k, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 1 THEN 'lsp' ELSE 'treesitter' END AS method FROM num_of
), got AS (
  SELECT symbol_id, uri, method FROM s JOIN file USING (uri) WHERE (method = 'lsp' AND k % 4 > 0 AND part % 2 = 0) OR (method = 'treesitter' AND k % 5 > 0)
)
"""


def oracle_sql() -> dict[str, str]:
    out = {name: _views(f"SELECT {_RESULT} FROM ({search_sql(q, **{k: v for k, v in o.items()})})") for name, (q, o) in SEARCHES.items()}
    parts = [f"SELECT {i} AS qid, pos AS rank, {_RESULT} FROM ({search_sql(q, hot=True, **o)})" for i, (q, o) in enumerate(BATCH)]
    moved = "SELECT part, sha256(concat_ws(':', uri, name, kind, start_line + 1, start_char, end_line + 1, end_char)) AS symbol_id, uri, start_line + 1 AS start_line FROM s WHERE part % 40 < 13 AND part % 2 = 0"
    out |= {
        "search_no_kinds": _views(f"SELECT {_RESULT} FROM ({search_sql('b', kinds=[])}) UNION ALL SELECT {_RESULT} FROM ({search_sql('b', kinds=[5, 11, 23])})"),
        "search_scan": _views(f"SELECT {_RESULT} FROM ({search_sql('small ring', hot=True)})"),
        "search_batch_topk": _views(" UNION ALL ".join(parts)),
        "ngrams_distinct": "SELECT doc_id, " + ", ".join(f"CASE WHEN len(l) < {n} THEN 0 ELSE len(list_distinct(list_transform(range(1, len(l) - {n - 2}), lambda i: {' || '.join(f'l[i + {j}]' for j in range(n))}))) END AS n{n}" for n in (1, 2, 3)) + " FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), '') AS l FROM documents)",
        "postings_build": _views(f"SELECT domain, n, gram, count(*) AS symbols FROM ({_GRAM}) GROUP BY ALL"),
        "postings_intersect": _views("SELECT 1 AS key, symbol_id FROM s WHERE contains(lower(name), 'red') AND contains(lower(name), 'wid') AND contains(lower(name), 'get') UNION ALL SELECT 2, symbol_id FROM s WHERE contains(lower(name), 'bo') AND contains(lower(name), 'lt')"),
        "match_grade": _views("SELECT symbol_id, " + ", ".join(f"{_grade('lower(name)', t, (100.0, 80.0, 60.0, 40.0))} AS g{i}" for i, t in enumerate(GRADE_TOKENS)) + " FROM s"),
        "symbol_ids": _views("SELECT part, symbol_id FROM s"),
        "upsert_replace": _views(f"SELECT * FROM ({moved}) UNION ALL SELECT part, symbol_id, uri, start_line FROM s WHERE uri NOT IN (SELECT uri FROM s WHERE part % 40 < 13 AND part % 2 = 0)"),
        "remove_uris": _views("SELECT part, symbol_id FROM s WHERE uri NOT IN (SELECT uri FROM s WHERE part % 7 = 0)"),
        "get_symbols": _views("SELECT symbol_id, name, kind, uri FROM s WHERE part % 11 = 0"),
        "stats_total": _views("SELECT (SELECT count(*) FROM s) AS symbol_count, (SELECT count(DISTINCT uri) FROM s) AS uri_count, (SELECT count(*) FROM hot) AS hotspot_count, (SELECT count(*) FROM e) AS edge_count"),
        "stats_by_root": _views(_BY_ROOT),
        "status_lines": _views(f"SELECT name, '[' || name || '] ' || symbol_count || ' symbols, ' || uri_count || ' files, ' || hotspot_count || ' hotspots' AS line FROM ({_BY_ROOT})"),
        "root_of_uri": _views("SELECT CASE WHEN starts_with(uri, 'file:///repo_1/src/promo') THEN 'promo' WHEN starts_with(uri, 'file:///repo_1/') THEN 'one' ELSE 'all' END AS root, count(*) AS n FROM s GROUP BY 1"),
        "snapshot_root_filter": _views("SELECT 'symbol' AS what, symbol_id AS key FROM s WHERE starts_with(uri, 'file:///repo_1/') UNION ALL SELECT 'hotspot', uri FROM hot WHERE starts_with(uri, 'file:///repo_1/') UNION ALL SELECT 'edge', concat_ws('>', caller_symbol_id, edge_kind, callee_symbol_id) FROM e WHERE EXISTS (SELECT 1 FROM s WHERE starts_with(uri, 'file:///repo_1/') AND symbol_id IN (caller_symbol_id, callee_symbol_id))"),
        "snapshot_merge": _views("SELECT part, symbol_id, uri FROM s"),
        "hotspot_overlay": _views("SELECT uri, round(CASE WHEN contains(uri, 'repo_1') THEN score / 2 ELSE score END, 6) AS score FROM hot"),
        "hotspot_churn": _views("SELECT uri, round(score, 6) AS score FROM hot"),
        "hotspot_count_mode": _views("SELECT uri, round(n / greatest(1.0, max(n) OVER ()), 6) AS score FROM (SELECT uri, count(*) AS n FROM num GROUP BY uri) QUALIFY row_number() OVER (ORDER BY n DESC, uri) <= 100"),
        "hotspot_top": _views("SELECT uri, round(score, 6) AS score FROM hot ORDER BY hot.score DESC, uri LIMIT 20"),
        "hotspot_decay_weights": _views("SELECT DISTINCT ct AS commit_time, round(pow(0.5, (1009843200 - ct) / 86400.0 / 30), 6) AS weight FROM num"),
        "hotspot_lines": _views(f"SELECT uri, printf('%-60s %s (%.2f)', {_PATH}, repeat('█', floor(round(score, 9) * 10)::INT), round(score, 9)) AS line FROM hot ORDER BY hot.score DESC, uri LIMIT 50"),
        "top_symbols_per_file": _views("SELECT uri, rank, symbol_id, round(sc, 6) AS score, CASE WHEN cc IS NOT NULL THEN round(h * (least(cc, 50) / 50.0), 6) END AS tech_debt FROM rk WHERE rank <= 5"),
        "drill_down": _views("SELECT symbol_id, printf('%3d. %-12s %3d  %3d    %3d   %s %.2f', rank, CASE WHEN length(name) > 12 THEN '...' || right(name, 9) ELSE name END, coalesce(cc, 0), coalesce(cc + 1, 0), CASE WHEN cc IS NULL THEN 0 ELSE part % 5 END, repeat('█', floor(least(d, 1.0) * 10)::INT), d) AS line FROM (SELECT *, CASE WHEN cc IS NULL THEN 0.0 ELSE round(h * (least(cc, 50) / 50.0), 9) END AS d FROM rk) WHERE rank <= 3"),
        "tech_debt": _views("SELECT symbol_id, " + ", ".join(f"CASE WHEN cc IS NOT NULL THEN round(h * (least(cc, {max(c, 1)}) / {max(c, 1)}.0), 6) END AS debt_{c}" for c in (0, 20, 50)) + " FROM top"),
        "edges_upsert_latest": _views("SELECT caller_symbol_id, callee_symbol_id, edge_kind, evidence_line, evidence_char FROM e"),
        "edges_outgoing": _views("SELECT caller_symbol_id, callee_symbol_id, edge_kind FROM e WHERE caller_symbol_id IN (SELECT symbol_id FROM s WHERE part % 5 = 0)"),
        "edges_incoming": _views("SELECT caller_symbol_id, callee_symbol_id, edge_kind FROM e WHERE callee_symbol_id IN (SELECT symbol_id FROM s WHERE part % 5 = 0)"),
        "edge_degrees": _views("SELECT symbol_id, caller_count::BIGINT AS caller_count, callee_count::BIGINT AS callee_count FROM deg"),
        "call_graph_view": _views("SELECT section, symbol_id, name, uri, edge_count, expandable FROM vw"),
        "call_graph_rows": _views(f"SELECT section, symbol_id, CASE WHEN section = 'reference' THEN '↳ Ref: ' || {_PATH} || ':' || (start_line + 1) || ':' || (start_char + 1) ELSE CASE section WHEN 'center' THEN '●' WHEN 'incoming' THEN '←' ELSE '→' END || ' ' || ({_KINDS})[kind] || ': ' || name || coalesce(' [' || container_name || ']', '') || ' - ' || {_PATH} END || CASE WHEN edge_count > 1 THEN ' x' || edge_count ELSE '' END AS line FROM vw"),
        "call_graph_filter": _views("SELECT section, symbol_id FROM vw WHERE section = 'center' OR contains(lower(name), 'repo_1') OR contains(lower(coalesce(container_name, '')), 'repo_1') OR contains(lower(uri), 'repo_1')"),
        "section_counts": _views("SELECT section, count(*) AS n FROM vw GROUP BY section"),
        "affected_bfs": _views("SELECT symbol_id, depth FROM aff"),
        "changed_symbols": _views("SELECT symbol_id, uri, change_type FROM chg"),
        "changed_lines": _views("SELECT symbol_id, string_agg(x, ',' ORDER BY x) AS lines FROM (SELECT symbol_id, unnest(range(greatest(f, start_line), least(l, end_line) + 1)) AS x FROM s JOIN rng USING (uri) WHERE f <= end_line AND l >= start_line) GROUP BY symbol_id"),
        "diff_stats": _views("SELECT " + ", ".join(f"(SELECT count(*) FROM fil WHERE change_type = '{k}') AS files_{k}" for k in ("added", "modified", "deleted", "renamed")) + ", " + ", ".join(f"(SELECT count(*) FROM chg WHERE change_type = '{k}') AS symbols_{k}" for k in ("added", "modified", "deleted"))),
        "impact_scores": _views("SELECT symbol_id, change_type, caller_count, callee_count, round(hotspot, 6) AS hotspot, round(tech_debt, 6) AS tech_debt, round(impact_score, 6) AS impact_score FROM imp"),
        "risk_ranking": _views("SELECT symbol_id, name, change_type, caller_count, callee_count, round(hotspot, 6) AS hotspot, round(impact_score, 6) AS impact_score FROM risk"),
        "ast_metrics": AST,
        "enclosing_function": _views("SELECT DISTINCT p.uri AS file, p.f * 1000 + 500 AS at, (SELECT symbol_id FROM s WHERE s.uri = p.uri AND kind IN (6, 12) AND start_line * 1000 + part % 1000 <= p.f * 1000 + 500 AND p.f * 1000 + 500 <= end_line * 1000 + 999 - part % 1000 ORDER BY (end_line - start_line) * 1000 + 999 - 2 * (part % 1000), symbol_id LIMIT 1) AS node_id FROM rng p"),
        "kind_histogram": _views(f"SELECT ({_KINDS})[kind] AS kind_name, count(*) AS n FROM s GROUP BY 1"),
        "computable_kinds": _views("SELECT symbol_id, kind FROM s WHERE kind IN (6, 9, 12)"),
        "parse_numstat": """SELECT '/repo_' || (l_orderkey % 16) AS root, l_orderkey * 100 + l_linenumber AS line_no, epoch(o_orderdate)::BIGINT AS commit_time, 'src/f' || p || '.ts' AS path,
  CASE WHEN p % 7 = 0 THEN 0.0 ELSE q END::DOUBLE AS additions, CASE WHEN p % 7 = 0 THEN 0.0 ELSE l_linenumber END::DOUBLE AS deletions
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, trunc(min(l_quantity)) AS q FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey""",
        "parse_hunks": "SELECT event_id AS line_no, event_id % 900 AS first, event_id % 900 + n - 1 AS last FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 1 ELSE event_id % 4 END AS n FROM events) WHERE n > 0 AND event_type <> 'error'",
        "parse_name_status": "SELECT 'file:///repo/' || replace(f, ' ', '%20') AS uri, f AS repo_path, CASE k WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN 'renamed' ELSE 'added' END AS change_type, CASE WHEN k = 3 THEN 'old/' || p_partkey END AS old_repo_path FROM (SELECT p_partkey, 'src/' || p_name || '_' || p_partkey || '.ts' AS f, p_partkey % 6 AS k FROM part) WHERE k < 5",
        "format_entries": _views(f"SELECT symbol_id, ({_KINDS})[kind] || ': ' || name || coalesce(' [' || container_name || ']', '') || ' - ' || replace({_PATH}, '/repo_1/', '') || ':' || (start_line + 1) AS line FROM s"),
        "format_impacts": _views(f"SELECT symbol_id, printf('%-30s %-8s callers:%-3d hotspot:%.2f score:%.2f %s %s', name, CASE change_type WHEN 'affected' THEN 'affect' ELSE substr(change_type, 1, 5) END, caller_count, round(hotspot, 9), round(impact_score, 9), repeat('█', floor(round(impact_score, 9) * 5)::INT), {_PATH}) AS line FROM risk"),
        "workspace_dedup": _views("SELECT symbol_id, uri FROM s WHERE part % 3 = 0 OR part % 2 = 0"),
        "cursor_in_range": _views("SELECT event_id, arg_min(symbol_id, (end_line - start_line, symbol_id)) AS symbol_id FROM rng JOIN s USING (uri) WHERE (start_line, start_char) <= (f, 3) AND (end_line, end_char) >= (f, 3) GROUP BY event_id"),
        "lsp_flatten": _views("SELECT symbol_id, name, kind, uri, start_line, CASE WHEN part = min(part) OVER (PARTITION BY uri) THEN 1 ELSE 2 END AS depth FROM s"),
        "index_files": _views(_FILES + "SELECT symbol_id, uri, method FROM got"),
        "index_files_status": _views(_FILES + "SELECT uri, CASE WHEN method IS NULL THEN 'skipped' WHEN count(symbol_id) > 0 THEN 'indexed' ELSE 'empty' END AS status, method, count(symbol_id) AS symbol_count FROM file LEFT JOIN got USING (uri, method) GROUP BY uri, method"),
        "index_files_metrics": MEASURED + "SELECT sha256(concat_ws(':', uri, name, kind, sl, sc, el, ec)) AS symbol_id, uri, method, kind, sl AS start_line, cc::BIGINT AS cyclomatic_complexity, loc AS lines_of_code, depth AS nesting_depth FROM got LEFT JOIN fig ON fig.lft = node AND fig.file = uri",
        "index_files_errors": MEASURED + "SELECT count(*) FILTER (method IS NOT NULL) AS target_count, count(*) FILTER (method IS NOT NULL AND NOT failed AND n > 0) AS indexed_count, count(*) FILTER (method IS NOT NULL AND NOT failed AND n = 0) AS empty_count, count(*) FILTER (failed) AS failed_count, count(*) FILTER (method IS NULL) AS skipped_count FROM (SELECT *, (SELECT count(*) FROM got WHERE uri = file) AS n FROM st)",
        "graph_from_answers": _views(_ANSWERS + " SELECT symbol_id AS center_id, 'center' AS section, symbol_id, name, container_name, 0 AS edge_count, true AS expandable FROM s UNION ALL SELECT center_id, section, symbol_id, name, any_value(container_name), sum(greatest(n, 1))::BIGINT, section <> 'reference' FROM (SELECT * FROM ans UNION ALL SELECT * FROM refs) GROUP BY ALL"),
        "graph_answer_edges": _views(_ANSWERS + " SELECT caller_symbol_id, callee_symbol_id, edge_kind, count(*) AS n, min(uri) AS uri, sum(l)::BIGINT AS lines, sum(c)::BIGINT AS chars FROM (SELECT CASE WHEN section = 'outgoing' THEN center_id ELSE symbol_id END AS caller_symbol_id, CASE WHEN section = 'outgoing' THEN symbol_id ELSE center_id END AS callee_symbol_id, CASE WHEN section = 'reference' THEN 'reference' ELSE 'call' END AS edge_kind, CASE WHEN section = 'outgoing' THEN center_uri ELSE uri END AS uri, CASE WHEN n = 0 THEN start_line ELSE ln + j END AS l, CASE WHEN n = 0 THEN start_char ELSE ch END AS c FROM (SELECT *, unnest(range(greatest(n, 1))) AS j FROM (SELECT * FROM ans UNION ALL SELECT * FROM refs))) GROUP BY ALL"),
        "reference_places": _views(_ANSWERS + " SELECT center_id, substr(uri, 8) AS filename, ln + 1 AS lnum, ch + 1 AS col FROM refs"),
        "parse_diff": "WITH f AS (SELECT event_id % 4 AS r, event_id * 3 AS no, CASE WHEN event_id % 70 = 0 THEN NULL ELSE 'src/f' || (event_id % 1000) || '.ts' END AS path FROM events WHERE event_id % 10 < 4), h AS (SELECT event_id % 4 AS r, event_id * 3 + 1 AS no, event_id % 300 AS first, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 3 END AS n FROM events) SELECT '/repo_' || h.r AS root, 'file:///repo_' || h.r || '/' || path AS uri, first, first + n - 1 AS last FROM h ASOF JOIN f ON h.r = f.r AND h.no >= f.no WHERE path IS NOT NULL",
        "parse_names": "SELECT '/repo_' || (l_orderkey % 16) AS root, 'src/f' || p || '.ts' AS path, count(*)::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL) GROUP BY ALL",
        "lsp_flatten_json": _views("SELECT sha256(concat_ws(':', uri, name, kind, start_line, start_char, end_line, end_char)) AS symbol_id, name, kind, container_name, uri, depth FROM (SELECT CASE WHEN depth = 2 THEN 'in_' || name ELSE name END AS name, CASE WHEN depth = 2 THEN 13 ELSE kind END AS kind, CASE WHEN k % 4 = 0 THEN NULL ELSE container_name END AS container_name, uri, start_line, start_char, end_line, end_char, depth FROM (SELECT *, regexp_extract(uri, '_([0-9]+)[.]ts$', 1)::INT AS k FROM s), range(1, 3) t(depth) WHERE k % 7 <> 3 AND (depth = 1 OR k % 4 = 0))"),
        "snapshot_round_trip": _views("SELECT symbol_id, uri, kind, round(CASE WHEN uri LIKE 'file:///repo_1/%' THEN score / 2 ELSE score END, 6) AS score FROM s LEFT JOIN hot USING (uri) WHERE uri LIKE 'file:///repo_0/%' OR uri LIKE 'file:///repo_1/%'"),
        "index_files_summary": _views(_FILES + "SELECT count(method) AS target_count, count(*) FILTER (method IS NOT NULL AND n > 0) AS indexed_count, count(*) FILTER (method IS NOT NULL AND n = 0) AS empty_count, 0 AS failed_count, count(*) FILTER (method IS NULL) AS skipped_count FROM (SELECT uri, method, (SELECT count(*) FROM got WHERE got.uri = file.uri) AS n FROM file)"),
        "roots_listing": _views("SELECT DISTINCT '/repo_' || (part % 3) AS root FROM s"),
        "ensure_ids": _views("SELECT part, symbol_id, 0 AS end_char FROM s"),
        "tree_symbols": "SELECT node_id, kind, sha256(concat_ws(':', file, name, kind, node_id % 50, 0, node_id % 50 + 3, 1)) AS symbol_id FROM (SELECT p_partkey AS node_id, 'file:///t/' || p_brand AS file, p_name AS name, CASE WHEN p_partkey % 10 < 4 THEN 12 WHEN p_partkey % 10 < 6 THEN 5 WHEN p_partkey % 10 = 6 THEN 23 ELSE 13 END AS kind FROM part WHERE p_partkey % 10 < 9)",
        "index_status": "SELECT count(*) FILTER (event_type NOT IN ('error', 'view')) || '/' || count(*) || ' buffers (empty: ' || count(*) FILTER (event_type = 'view') || ', failed: ' || count(*) FILTER (event_type = 'error') || ')' AS line FROM events",
        "preview_window": "SELECT doc_id, i - 1 AS line_no, length(regexp_replace(x, '\\r$', '')) AS n FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE i - 1 BETWEEN 2 AND 6",
        "stream_upsert": "SELECT uri AS request_uri, name, sha256(concat_ws(':', uri, name, 12, event_id, 0, event_id, 0)) AS symbol_id FROM (SELECT 'file:///stream/' || user_id || '.ts' AS uri, event_type || '_' || event_id AS name, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'",
    }
    return out
