"""SQL for the corpus queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

_RULES = """(VALUES ('allow', 'org', '/', 'org/'),
  ('block', 'example.org', '/es/', 'example.org/es/'),
  ('block', 'example.org', '/en/1', 'example.org/en/1'),
  ('allow', 'com', '/fr/', 'com/fr/'),
  ('block', 'com', '/de/', 'com/de/')) AS r(verdict, rule_host, rule_path, rule)"""


def _lower(text: str) -> str:
    return (f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _after(url: str) -> str:
    return (f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) "
            "ELSE '' END")


def _host(url: str) -> str:
    return _lower(f"regexp_extract({_after(url)}, '^[^/?#]*')")


def _path(url: str) -> str:
    return f"regexp_extract({_after(url)}, '^[^/?#]*([^?#]*)', 1)"


def _node(url: str) -> str:
    return (f"CASE WHEN contains({url}, '://') THEN {_host(url)} || "
            f"regexp_extract({_after(url)}, '^[^/?#]*([^#]*)', 1) END")


_ALIASES = rf"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM pages
), targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
      THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')
      THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1)
    ELSE '' END, '&amp;', '&') AS target FROM tags WHERE url IS NOT NULL
), absolute AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '^(.*?://)', 1) || {_host('url')} || target
    ELSE regexp_extract(url, '^(.*?://)', 1) || {_host('url')} ||
      coalesce(nullif(regexp_extract({_path('url')}, '^(.*/)?'), ''), '/') || target END AS target
  FROM targets WHERE target <> ''
), links AS (
  SELECT DISTINCT {_node('url')} AS a, {_node('target')} AS b FROM absolute
), edges AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a AS node, b AS other FROM edges UNION SELECT a, a FROM edges
  UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a
), judged AS (
  SELECT other, arg_max(r.verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT other FROM reach), {_RULES}
  WHERE ({_host("('http://' || other)")} = rule_host
         OR ends_with({_host("('http://' || other)")}, '.' || rule_host))
    AND starts_with({_path("('http://' || other)")}, rule_path)
  GROUP BY other
), heirs AS (
  SELECT node FROM reach JOIN judged USING (other) GROUP BY node
  HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
), own AS (
  SELECT page_id, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path,
    {_node('url')} AS node, row_number() OVER () AS row FROM pages
), fit AS (
  SELECT row, arg_max(r.rule, length(rule)) AS rule, arg_max(r.verdict, length(rule)) AS verdict
  FROM own, {_RULES}
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row
)
SELECT page_id, host, path, fit.rule,
  coalesce(fit.verdict, CASE WHEN heirs.node IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  heirs.node IS NOT NULL AND fit.rule IS NULL AS inherited
FROM own LEFT JOIN fit USING (row) LEFT JOIN heirs ON own.node = heirs.node
"""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS shown,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10),
      '&#10;') AS shown_role
  FROM rows
), learned AS (
  SELECT conv_id, string_agg(text, '' ORDER BY pos) AS loss FROM turns WHERE role = 'assistant'
  GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS listed,
    sum(length('<|im_start|>') + length(shown_role) + 1 + length(shown) + length('<|im_end|>') + 1)
      AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256,
  coalesce(length(loss), 0)::BIGINT AS loss_chars, sha256(coalesce(loss, '')) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM whole LEFT JOIN learned USING (conv_id)
"""

_LEDGER = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT row, doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM texts
), grams AS (
  SELECT row, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT row, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
), again AS (
  SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1
), covered AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again)
  GROUP BY row
), measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM split LEFT JOIN covered USING (row)
), marked AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_shouts > 30 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept,
  failures, '2' AS policy FROM marked
"""

_AUDIT = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '{_WORD}') AS ws,
    min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), masks AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask FROM cut
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
    max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), combos AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN told USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(f, bit)
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, f, bit,
    (SELECT coalesce(sum(p.bit), 0) FROM letters p
     WHERE contains(substr(filter_order, 1, step - 1), p.f))::INTEGER AS before
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step) JOIN letters
    ON f = substr(filter_order, step, 1)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM combos, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""

SQL: dict[str, str] = {
    "op1_redirect_filter": _ALIASES,
    "op5_event_log_chat": _CHAT,
    "op6_quality_ledger": _LEDGER,
    "op12_filter_audit": _AUDIT,
}
