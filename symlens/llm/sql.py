"""DuckDB SQL for the results of those operators that SQL can express."""

from __future__ import annotations

from symlens.llm.quality_rules import BOILERPLATE

#: Texts are equal without ASCII white space; of equal ones the longest, then the smallest doc_id stays.
EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

#: Windows of 20 words whose sequence also starts earlier are removed.
SUBSTRING = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20
), g AS (
  SELECT s.doc_id, s.p, sha256(array_to_string(d.w[s.p : s.p + 19], ' ')) AS h FROM s JOIN d USING (doc_id)
), m AS (
  SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM m
), r AS (
  SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Counts are drawn from the MD5 of seed, id and part by the weights of the query.
MIXING = """
WITH w AS (
  SELECT 'src' || i AS source, CASE WHEN i = 0 THEN 0.1 ELSE 0.9 / 19 END::DOUBLE AS weight FROM range(20) t(i)
), z AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents WHERE source IN (SELECT source FROM w) GROUP BY source
), r AS (
  SELECT z.source, weight * (SELECT sum(size) FROM z)::DOUBLE / size AS rate FROM z JOIN w USING (source)
), d AS (
  SELECT doc_id, documents.source, text, coalesce(rate, 1.0) AS rate, ('0x' || substr(md5('7:' || doc_id || ':0'), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM documents LEFT JOIN r ON documents.source = r.source
), p AS (
  SELECT source, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, k, exp(-rate) * rate ** k / factorial(k::INTEGER) AS term FROM (SELECT DISTINCT source, rate FROM d), range(32) t(k))
), n AS (
  SELECT d.doc_id, d.source, d.text, count(*) AS copies FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.cdf <= d.u GROUP BY ALL
)
SELECT doc_id, source, text, copy, md5('order:7:' || doc_id || ':' || copy) AS order_key
FROM (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM n)
"""

#: Figures of the words, and lines judged as the rules say.
QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, p, w[p : p + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1) GROUP BY doc_id
), x AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d
), y AS (
  SELECT doc_id, l, len(v) AS n, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars, length(regexp_replace(l, '[^|»]', '', 'g')) + len(string_split(l, ' > ')) - 1 AS bars,
    length(regexp_replace(l, '[^#*$%&<>|]', '', 'g')) AS marks, len(regexp_extract_all(l, '!!')) + len(regexp_extract_all(l, '[?][?]')) AS shouts,
    len(list_filter(range(1, len(v)), lambda i: v[i] = v[i + 1])) AS stutters
  FROM (SELECT *, list_filter(regexp_split_to_array(l, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'), lambda q: q <> '') AS v FROM x)
), z AS (
  SELECT doc_id, sum(chars) AS word_chars, count(*) FILTER (chars > 0) - count(DISTINCT l) FILTER (chars > 0) AS n_dup_lines,
    coalesce(sum(chars) FILTER (n > 0 AND ((bars >= 2 AND bars > 0.25 * n) OR (marks >= 3 AND marks > 0.5 * n) OR (shouts >= 2 AND shouts > 0.33 * n) OR (n <= 12 AND regexp_matches(l, '{BOILERPLATE}', 'i')) OR (n >= 6 AND stutters > 0.5 * n))), 0) AS lost
  FROM y GROUP BY doc_id
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost
  FROM d JOIN z USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT * EXCLUDE (lost), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3 * word_chars AS kept FROM f
""".replace("{BOILERPLATE}", BOILERPLATE.pattern.replace("'", "''"))

#: Cells of failure masks under every order of the five filters.
AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), m AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f
  FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL
), k AS (
  SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT o, i AS step, o[i] AS own, list_slice(o, 1, i - 1) AS before FROM o, k
), x AS (
  SELECT *, f[own] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda y: y)) AS fails_of FROM c, s
), r AS (
  SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND fails_of = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda j: chr((64 + j)::INTEGER)), '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

#: Every document scored for every item, and ranked.
SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents
), g AS (
  SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), t AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term, docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), s AS (
  SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN w USING (term) JOIN t USING (term), g GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
""".replace("{TERM}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

ORACLES: dict[str, str] = {"op1_exact_dedup": EXACT, "op5_mix_sources": MIXING, "op6_substring_dedup": SUBSTRING, "op9_quality_rules": QUALITY, "op11_filter_audit": AUDIT, "op13_ranked_search": SEARCH}
