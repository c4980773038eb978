"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Written independently of the Spark expressions where that is possible: scripts are counted
by joining code points with the ranges, email lines by list functions, and so on.
"""

from __future__ import annotations

from askframe.functions import fixed
from askframe.functions.detect import ALL_WORDS, LANGUAGES, WORD_SETS
from askframe.plans import doubles, inputs
from askframe.plans.inputs import ARMENIAN, CYRILLIC, HAN, HEBREW, KANA, LOWER, PRESET_ORDER

SQL: dict[str, str] = {}


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def among(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def pick(key: str, *values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"(CASE ({key}) % {len(values)} {whens} ELSE {values[-1]} END)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n"


def round4(x: str) -> str:
    return f"printf('%.4f', {x})::DOUBLE"


# --- inputs -----------------------------------------------------------------------------------

MIXED = "src AS (SELECT doc_id AS id, " + pick(
    "doc_id",
    f"translate(text, '{LOWER}', '{CYRILLIC}')",
    "translate(text, 'aeiou', 'αειου')",
    f"translate(text, 'etaoin', '{HEBREW}')",
    f"translate(text, '{LOWER}', '{HAN}')",
    f"translate(text, '{LOWER[:15]}', '{KANA}')",
    r"regexp_replace(text, '\p{L}', '7', 'g')",
    f"translate(text, 'aeiou', '{ARMENIAN}')",
    "text",
) + " AS t FROM documents)"

HINTED = "hinted AS (SELECT doc_id, text, lang, " + ", ".join([
    pick("doc_id", "' ML '", "'Typed'", "'nope'", "''", *["NULL"] * 8, "'typed-decisions'")
    + " AS model_hint",
    pick("doc_id", "lang", "NULL", "NULL", "NULL", "'Typed-Decisions'", "'decisions'",
         "'what''s this'", "''", *["NULL"] * 5) + " AS task_hint",
    pick("doc_id", *["NULL"] * 7, "lang || '-AT'", "'EN-us'", "'en_US'", "'l''' || lang", "''",
         "NULL") + " AS lang_hint",
]) + " FROM documents)"


# --- detection --------------------------------------------------------------------------------

_RANGES = [("latin", lo, hi, 99) for lo, hi in fixed.LATIN_RANGES] + [
    (name, lo, hi, i) for i, (name, rs) in enumerate(fixed.SCRIPT_RANGES) for lo, hi in rs
]
RANGES = "ranges(script, lo, hi, prio) AS (VALUES " + ", ".join(
    f"('{n}', {lo}, {hi}, {p})" for n, lo, hi, p in _RANGES
) + ")"

# From src(id, t): one row per letter and script, counted and ordered by first position.
COUNTS = rf"""w AS (SELECT id, substr(t, 1, 4000) AS w FROM src),
letters AS (
  SELECT id, ch, min(pos) AS pos, count(*) AS n FROM (
    SELECT id, unnest(string_split(w, '')) AS ch, unnest(range(length(w))) AS pos FROM w)
  WHERE regexp_matches(ch, '\p{{L}}') GROUP BY id, ch),
{RANGES},
counts AS (
  SELECT id, script, sum(n)::BIGINT AS n, min(pos) AS pos
  FROM letters JOIN ranges ON unicode(ch) BETWEEN lo AND hi GROUP BY id, script)"""

DOMINANT = """dominant AS (
  SELECT w.id, w, coalesce(first(script ORDER BY n DESC, (script = 'latin'), pos), 'unknown') AS script,
    1 - coalesce(sum(n) FILTER (script = 'latin'), 0)::DOUBLE / sum(n)::DOUBLE AS outside
  FROM w LEFT JOIN counts ON w.id = counts.id GROUP BY ALL)"""


def _scores(words: str) -> str:
    return ", ".join(
        f"len(list_filter({words}, lambda x: x IN {among(WORD_SETS[lang])})) AS s_{lang}"
        for lang in LANGUAGES
    )


def language(source: str, where: str = "true") -> str:
    """guess(id, language) from source(id, w)."""
    others = LANGUAGES[1:]
    best = "greatest(" + ", ".join(f"s_{x}" for x in others) + ")"
    best_lang = "CASE " + " ".join(f"WHEN s_{x} = best THEN '{x}'" for x in others) + " END"
    return rf"""words AS (
  SELECT id, list_transform(regexp_extract_all(w, '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda x: lower(x)) AS ws,
    len(list_filter(string_split(lower(w), ''), lambda c: c <> '' AND contains('{fixed.DIACRITICS}', c)))::DOUBLE
      / greatest(1, length(lower(w)))::DOUBLE AS rate
  FROM {source} WHERE {where}),
scores AS (SELECT id, len(ws) AS n, rate, {_scores("ws")} FROM words),
bests AS (SELECT *, {best} AS best FROM scores),
guess AS (
  SELECT id, CASE
    WHEN n < 4 THEN NULL
    WHEN best = 0 AND rate < 0.02::DOUBLE THEN CASE WHEN s_en > 0 THEN 'en' END
    WHEN best >= greatest(2, s_en + 2) THEN {best_lang}
    WHEN rate >= 0.04::DOUBLE AND best >= s_en THEN {best_lang}
    WHEN s_en > 0 THEN 'en' END AS language
  FROM bests)"""


DETECTED = ",\n".join([
    COUNTS,
    DOMINANT,
    language("dominant", "script = 'latin'"),
    f"""detected AS (
  SELECT d.id, script, g.language,
    CASE script WHEN 'unknown' THEN true WHEN 'latin' THEN coalesce(g.language, 'en') = 'en'
      ELSE false END AS is_english,
    CASE WHEN script = 'unknown' THEN 0.0::DOUBLE ELSE {round4("outside")} END AS non_latin_fraction
  FROM dominant d LEFT JOIN guess g USING (id))""",
])


def routed(default: str = "english") -> str:
    return f"""routed AS (
  SELECT *, CASE WHEN script = 'unknown' THEN '{default}'
      WHEN script <> 'latin' OR NOT is_english THEN 'multilingual' ELSE 'english' END AS model,
    CASE WHEN script = 'unknown' THEN 'no letters detected in state; using default ({default})'
      WHEN script <> 'latin' THEN 'non-Latin script (' || script || ', '
        || printf('%.0f', 100 * non_latin_fraction) || '% of letters); the English checkpoint cannot read it'
      WHEN NOT is_english THEN 'Latin script but language looks like ''' || language || ''', not English'
      ELSE 'English Latin text' END AS reason
  FROM detected)"""


FLAT_DOCUMENTS = "src AS (SELECT doc_id AS id, source || ' ' || text AS t FROM documents)"

SQL["route_documents"] = ctes(FLAT_DOCUMENTS, DETECTED, routed()) + (
    "SELECT id AS doc_id, model, reason, script, language, is_english, non_latin_fraction FROM routed"
)
SQL["route_mix_documents"] = ctes(
    FLAT_DOCUMENTS, DETECTED, routed(),
    "mix AS (SELECT lang, model, script, language, count(*) AS n FROM routed "
    "JOIN documents ON id = doc_id GROUP BY ALL)",
) + f"""SELECT *, {round4("n::DOUBLE / (SELECT sum(n) FROM mix)::DOUBLE")} AS share FROM mix"""
SQL["route_mix_subtotals"] = ctes(FLAT_DOCUMENTS, DETECTED, routed()) + (
    "SELECT source, lang, model, count(*) AS n, "
    "(grouping(source) + grouping(lang) + grouping(model))::BIGINT AS level "
    "FROM routed JOIN documents ON id = doc_id GROUP BY ROLLUP (source, lang, model)"
)
SQL["route_mixed_scripts"] = ctes(MIXED, DETECTED, routed("multilingual")) + (
    "SELECT id AS doc_id, model, reason, script, language, is_english, non_latin_fraction FROM routed"
)

_FAMILY = {"family": "english", "family-multilingual": "multilingual",
           "family-typed-decisions": "typed-decisions"}
_KNOWN = {**fixed.ALIASES, **_FAMILY, **{n: n for n in fixed.MODEL_NAMES}}
KNOWN = "known(key, canonical) AS (VALUES " + ", ".join(
    f"({q(k)}, {q(v)})" for k, v in _KNOWN.items()
) + ")"
REPO = "CASE {m} WHEN 'english' THEN 'owner/family' ELSE 'owner/family/' || {m} END"
_ALIAS_LIST = " ".join(sorted({**fixed.ALIASES, **_FAMILY}))


def _repr(x: str) -> str:
    return (
        f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {x} || '"' """
        f"""ELSE '''' || replace({x}, '''', '\\''') || '''' END"""
    )


SQL["route_with_hints"] = ctes(
    "src AS (SELECT doc_id AS id, text AS t FROM documents)", DETECTED, routed(), HINTED, KNOWN,
    """h AS (SELECT doc_id, nullif(model_hint, '') AS m, nullif(task_hint, '') AS t0,
      nullif(lang_hint, '') AS l FROM hinted)""",
    """h2 AS (SELECT *, CASE WHEN replace(lower(t0), '-', '_') = 'typed_decisions'
      THEN 'typed-decisions' ELSE t0 END AS t FROM h)""",
    """j AS (SELECT h2.*, coalesce(m, t) AS asked, canonical FROM h2
      LEFT JOIN known ON key = lower(trim(coalesce(m, t))))""",
    f"""r AS (SELECT j.doc_id, CASE
        WHEN asked IS NOT NULL THEN canonical
        WHEN l IS NOT NULL THEN CASE WHEN lower(split_part(l, '-', 1)) IN ('en', 'eng', 'english')
          THEN 'english' ELSE 'multilingual' END
        ELSE routed.model END AS model,
      CASE WHEN m IS NOT NULL THEN 'explicit model=' || {_repr("m")}
        WHEN t0 IS NOT NULL THEN 'explicit task=' || {_repr("t0")}
        WHEN l IS NOT NULL THEN 'explicit lang=' || {_repr("l")}
        ELSE routed.reason END AS reason,
      asked IS NOT NULL OR l IS NOT NULL AS undetected, asked
      FROM j JOIN routed ON j.doc_id = routed.id)""",
) + f"""SELECT doc_id, model, {REPO.format(m="model")} AS repo,
  CASE WHEN model IS NOT NULL THEN reason END AS reason, undetected,
  CASE WHEN model IS NULL THEN 'unknown model "' || asked ||
    '"; choose one of [{" ".join(fixed.MODEL_NAMES)}] (or an alias: [{_ALIAS_LIST}])' END AS error
FROM r"""

SQL["script_counts"] = ctes(MIXED, COUNTS) + "SELECT id AS doc_id, script, n FROM counts"
SQL["script_block_join"] = SQL["script_counts"]
SQL["script_profile_long"] = ctes(MIXED, COUNTS) + (
    f"SELECT id AS doc_id, script, "
    f"{round4('n::DOUBLE / (sum(n) OVER (PARTITION BY id))::DOUBLE')} AS share FROM counts"
)
SQL["dominant_script_mixed"] = ctes(MIXED, COUNTS, DOMINANT) + (
    "SELECT id AS doc_id, script FROM dominant"
)

WINDOWED = "w AS (SELECT doc_id AS id, substr(text, 1, 4000) AS w FROM documents)"
_WORD_ROWS = ", ".join(f"({q(lang)}, {q(w)})" for lang in LANGUAGES for w in WORD_SETS[lang])
SQL["stopword_join"] = ctes(
    WINDOWED,
    r"ws AS (SELECT id, lower(unnest(regexp_extract_all(w, '[\p{L}\p{Nl}\p{No}]+'))) AS word FROM w)",
    f"sw(language, word) AS (VALUES {_WORD_ROWS})",
) + ("SELECT id AS doc_id, language, count(*) AS hits FROM ws JOIN sw USING (word) "
     "GROUP BY id, language")
SQL["latin_language_guess"] = ctes(WINDOWED, language("w")) + (
    "SELECT doc_id, lang, language AS guess FROM documents LEFT JOIN guess ON id = doc_id"
)
SQL["language_agreement"] = ctes(WINDOWED, language("w")) + (
    "SELECT lang, language AS guess, count(*) AS n FROM documents JOIN guess ON id = doc_id "
    "GROUP BY ALL"
)
SQL["diacritic_counts"] = ctes(WINDOWED) + (
    f"SELECT id AS doc_id, length(regexp_replace(lower(w), '[^{fixed.DIACRITICS}]', '', 'g'))::BIGINT"
    " AS n FROM w"
)

_NAMES = list(fixed.ALIASES) + fixed.MODEL_NAMES + ["family", "family-multilingual", "nope", ""]
ALIASED = ",\n".join([
    f"n AS (SELECT c_custkey, c_mktsegment, {pick('c_custkey', *map(q, _NAMES))} AS name FROM customer)",
    "aliased AS (SELECT c_custkey, " + pick(
        "c_custkey // 7", "name", "'  ' || upper(name) || chr(9) || ' '", "name || chr(10)",
        "name || '-' || c_mktsegment") + " AS name FROM n)",
    KNOWN,
    "resolved AS (SELECT c_custkey, name, canonical AS model FROM aliased "
    "LEFT JOIN known ON key = lower(trim(name, ' ' || chr(9) || chr(10))))",
])
SQL["alias_resolution"] = ctes(ALIASED) + (
    "SELECT c_custkey, name, model, " + REPO.format(m="model").replace("family", "Family")
    + " AS repo FROM resolved"
)
SQL["alias_join"] = ctes(ALIASED) + "SELECT model, count(*) AS n FROM resolved GROUP BY model"

_SETS = [texts(fixed.WORKFLOWS[n]) for n in sorted(fixed.WORKFLOWS)]
ORDER_SPECS = "s AS (SELECT o_orderkey, " + pick(
    "o_orderkey", *_SETS, f"list_reverse({_SETS[1]})", f"{_SETS[0]} || ['urgency']",
    f"{_SETS[2]}[1:4]", f"{_SETS[3]} || [o_orderpriority]", "[o_orderstatus]",
) + " AS qids FROM orders)"
_MATCH = "CASE list_sort(list_distinct(qids)) " + " ".join(
    f"WHEN {texts(sorted(fixed.WORKFLOWS[n]))} THEN {q(n)}" for n in sorted(fixed.WORKFLOWS)
) + " END"
SQL["workflow_match"] = ctes(ORDER_SPECS) + f"SELECT o_orderkey, {_MATCH} AS workflow FROM s"
SQL["workflow_route"] = ctes(
    ORDER_SPECS,
    f"m AS (SELECT o_orderkey, {_MATCH} AS workflow FROM s)",
    "src AS (SELECT o_orderkey AS id, o_orderpriority AS t FROM orders)", DETECTED, routed(),
) + """SELECT workflow, CASE WHEN workflow IS NULL THEN model ELSE 'typed-decisions' END AS model,
  CASE WHEN workflow IS NULL THEN reason
    ELSE 'question ids match the ''' || workflow || ''' typed-decisions workflow' END AS reason,
  count(*) AS n FROM m JOIN routed ON id = o_orderkey GROUP BY ALL"""

SQL["reason_parts"] = f"""WITH r AS (SELECT {pick("l_orderkey", "l_returnflag",
    "'it''s ' || l_returnflag", """'say "' || l_returnflag || '" isn''t'""")} AS name,
  {round4("(l_linenumber * 0.125::DOUBLE + l_discount * 0.5::DOUBLE) / 2::DOUBLE")} AS share FROM lineitem)
SELECT {_repr("name")} AS quoted, share, printf('%.0f', 100 * share) AS percent, count(*) AS n
FROM r GROUP BY name, share"""

SQL["round4_fractions"] = f"""SELECT
  {round4("1::DOUBLE - l_suppkey::DOUBLE / (l_partkey + 3200)::DOUBLE")} AS share,
  {round4("(l_partkey % 4000 * 2 + 1)::DOUBLE / 32::DOUBLE")} AS tie, count(*) AS n
FROM lineitem GROUP BY ALL"""

# --- email ------------------------------------------------------------------------------------

_SPACES = q(fixed.SPACE_CHARS)
_WS = r"[\t\n\f\r \p{Z}\x{85}\x{1c}-\x{1f}]"


def _any(x: str, patterns) -> str:
    """Match of any fixed pattern in the dialect of the SQL engine."""
    return "(" + " OR ".join(
        f"regexp_matches({x}, {q('(?i)' + p.replace('~', _WS))})" for p in patterns
    ) + ")"


def cleaned(max_chars: int = fixed.EMAIL_CHARS) -> str:
    """clean(id, body) from mails(id, body)."""
    return rf"""l1 AS (
  SELECT id, list_filter(string_split(regexp_replace(body, '\r\n|\r|\\n', chr(10), 'g'), chr(10)),
    lambda x: NOT starts_with(ltrim(x, {_SPACES}), '>')) AS ls FROM mails),
l2 AS (SELECT id, ls, list_position(list_transform(ls, lambda x, i: i > 1 AND {_any("x", fixed.QUOTE_HEADERS)}),
    true) AS h FROM l1),
l3 AS (SELECT id, list_transform(CASE WHEN h > 0 THEN ls[1:h - 1] ELSE ls END,
    lambda x: rtrim(x, {_SPACES})) AS ls FROM l2),
l4 AS (SELECT id, ls, greatest(1, least((trunc(len(ls)::DOUBLE * 0.6::DOUBLE))::BIGINT, len(ls) - 8)) AS st FROM l3),
l5 AS (SELECT id, ls, list_position(list_transform(ls, lambda x, i: i > st
    AND strlen(trim(x, {_SPACES})) <= 40 AND {_any("x", fixed.SIGNATURE_MARKERS)}), true) AS h FROM l4),
l6 AS (SELECT id, regexp_split_to_array(array_to_string(
    CASE WHEN h > 0 THEN ls[1:h - 1] ELSE ls END, chr(10)), {q(chr(92) + "n" + _WS + "*" + chr(92) + "n")}) AS ps FROM l5),
clean AS (SELECT id, substr(regexp_replace(coalesce(array_to_string(list_filter(list_transform(
    list_filter(ps, lambda p: NOT {_any("p", fixed.DISCLAIMERS)}), lambda p: trim(p, {_SPACES})),
    lambda p: p <> ''), chr(10) || chr(10)), ''), '[ \t]+', ' ', 'g'), 1, {max_chars}) AS body FROM l6)"""


def _lines(prefix: str, newline: str = "chr(10)") -> str:
    return f"replace(text, chr(10), {newline} || {q(prefix)})"


_NL = "chr(13) || chr(10)"
THREADS = "mails AS (SELECT doc_id AS id, source, lang, " + pick(
    "doc_id",
    f"text || {_NL} || {_NL} || 'Thanks,' || {_NL} || source || {_NL} || {_NL} || 'On Mon, ' || lang "
    f"|| ' wrote:' || {_NL} || '> ' || {_lines('> ', '(' + _NL + ')')} || {_NL} || {_NL} "
    "|| 'This email is confidential.'",
    rf"""{_lines('', "'\\n'").replace("'\\\\n'", "'\\n'")} || '\n \n--\n' || source || '\nSent from my iPhone'""",
    """'From: ' || source || chr(10) || text || chr(9) || chr(9) || ' end  ' || chr(10) || chr(10)
      || '-- Original Message ---' || chr(10) || text""",
    """'  > ' || source || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(9) || chr(10)
      || 'If you have received this MESSAGE in error, ' || lang || chr(10) || chr(10) || '  tail' || chr(9)
      || source || chr(10) || text || chr(10) || '__________' || chr(10) || text""",
    """text || chr(10) || chr(10) || 'Best regards, ' || source || chr(10) || chr(10) || ' ' || chr(10)
      || 'FROM: ' || lang || chr(10) || 'x'""",
    """chr(10) || chr(10) || text || chr(10) || chr(10)
      || 'intended solely for the use of the named recipient ' || source || chr(10) || chr(10) || text
      || chr(13) || 'Kind words to all of you from me and from everybody else, ok?' || chr(13) || lang""",
    "text",
) + " AS body FROM documents)"

SQL["email_clean_documents"] = ctes(
    "mails AS (SELECT doc_id AS id, text AS body FROM documents)", cleaned()
) + "SELECT id AS doc_id, body AS clean_body FROM clean"
SQL["email_clean_threads"] = ctes(THREADS, cleaned()) + (
    "SELECT id AS doc_id, body AS clean_body FROM clean"
)
SQL["email_clean_short"] = ctes(THREADS, cleaned(120)) + (
    "SELECT id AS doc_id, body AS clean_body FROM clean"
)
SQL["email_clean_conversations"] = ctes(
    "mails AS (SELECT {'c': conv_id, 't': turn} AS id, text AS body FROM conversations)", cleaned()
) + "SELECT id.c AS conv_id, id.t AS turn, body AS clean_body FROM clean"
SQL["email_kept_lines"] = ctes(
    THREADS,
    r"l0 AS (SELECT id, string_split(regexp_replace(body, '\r\n|\r|\\n', chr(10), 'g'), chr(10)) AS a FROM mails)",
    f"""l1 AS (SELECT id, list_transform(a, lambda x: starts_with(ltrim(x, {_SPACES}), '>')) AS qs,
      list_transform(a, lambda x: {_any("x", fixed.QUOTE_HEADERS)}) AS hs FROM l0)""",
    """l2 AS (SELECT id, qs, hs, list_position(qs, false) AS f FROM l1)""",
    """l3 AS (SELECT id, qs, hs, list_position(list_transform(hs, lambda h, i: h AND f > 0 AND i > f), true) AS stop FROM l2)""",
) + """SELECT id AS doc_id,
  len(list_filter(CASE WHEN stop > 0 THEN qs[1:stop - 1] ELSE qs END, lambda x: NOT x))::BIGINT AS kept,
  len(list_filter(qs, lambda x: x))::BIGINT AS quoted, len(list_filter(hs, lambda x: x))::BIGINT AS headers
FROM l3"""


def quoted(x: str) -> str:
    """JSON string of a text that may hold quotes, backslashes, line ends, tabs and U+0001."""
    for ch, escape in (("\\", "\\\\"), ('"', '\\"')):
        x = f"replace({x}, {q(ch)}, {q(escape)})"
    for code, escape in ((10, "\\n"), (13, "\\r"), (9, "\\t"), (1, "\\u0001")):
        x = f"replace({x}, chr({code}), {q(escape)})"
    return f"""'"' || {x} || '"'"""


SQL["email_state_json"] = ctes(THREADS, cleaned(200)) + f"""SELECT m.id AS doc_id,
  '{{"subject": ' || {quoted("source || ' \"re\"\\'")} || ', "body": ' || {quoted("c.body")}
  || coalesce(', "from": ' || {quoted(pick("m.id", "source", "NULL", "NULL"))}, '')
  || coalesce(', "lang": ' || {quoted(pick("m.id", "lang", "NULL"))}, '') || '}}' AS state
FROM mails m JOIN clean c USING (id)"""

# --- specs ------------------------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else q(v) for v in values) + "]::VARCHAR[]"


def _question(spec: str, pos: int, qid: str, qtype: str, text: str, criteria) -> str:
    keys = list(criteria) if qtype == "choice" else []
    descs = list(criteria.values()) if qtype == "choice" else []
    levels = criteria if qtype == "score" else []
    sides = criteria if qtype == "noul" and criteria else {}
    no, yes = (q(sides[s]) if s in sides else "NULL" for s in ("false", "true"))
    return (f"({q(spec)}, {pos}, {q(qid)}, {q(qtype)}, {q(text)}, {_list(keys)}, {_list(descs)}, "
            f"{_list(levels)}, {no}, {yes})")


QUESTIONS = (
    "questions(spec_id, q_pos, qid, qtype, instructions, keys, descs, levels, noul_false, noul_true) "
    "AS (VALUES " + ",\n".join(
        _question(name, i, qid, *definition)
        for name, spec in fixed.PRESETS.items()
        for i, (qid, definition) in enumerate(spec.items())
    ) + ")"
)
OPTIONS = f"""CASE qtype
  WHEN 'choice' THEN list_transform(list_zip(keys, descs),
    lambda z: CASE WHEN coalesce(z[2], '') = '' THEN z[1] ELSE z[1] || ': ' || z[2] END)
  WHEN 'score' THEN list_transform(levels, lambda x, i: 'level ' || (i - 1) || ': ' || x)
  ELSE ['false: ' || coalesce(nullif(noul_false, ''), {q(fixed.NOUL_FALSE)}),
        'true: ' || coalesce(nullif(noul_true, ''), {q(fixed.NOUL_TRUE)})] END"""
ASKED = (
    "ctx AS (SELECT *, " + pick("conv_id + turn", *map(q, PRESET_ORDER))
    + " AS spec_id FROM conversations)"
)

_LISTING = ", ".join(
    f"({q(n)}, {q(t)}, {q('/v1/presets/' + n)})" for n, t in fixed.PRESET_DESCRIPTIONS.items()
)
SQL["preset_catalog"] = ctes(
    ASKED, QUESTIONS, f"listing(spec_id, description, endpoint) AS (VALUES {_LISTING})"
) + """SELECT spec_id, (SELECT count(*) FROM ctx c WHERE c.spec_id = l.spec_id) AS n, description, endpoint,
  (SELECT count(*) FROM questions x WHERE x.spec_id = l.spec_id) AS n_questions FROM listing l
WHERE spec_id IN (SELECT spec_id FROM ctx)"""
SQL["preset_options"] = ctes(
    ASKED, QUESTIONS,
    f"o AS (SELECT spec_id, qid, {OPTIONS} AS os FROM questions)",
    "u AS (SELECT spec_id, qid, len(os)::BIGINT AS k, unnest(os) AS option, "
    "unnest(range(len(os))) AS pos FROM o)",
) + """SELECT spec_id, qid, count(*) AS n, k, pos, option FROM u JOIN ctx USING (spec_id)
GROUP BY spec_id, qid, k, pos, option"""
_DEFINITION = f"""'"' || qid || '": {{"type": "' || qtype || '", "instructions": "' || instructions || '"' || CASE
  WHEN qtype = 'choice' THEN ', "criteria": {{' || array_to_string(list_transform(list_zip(keys, descs),
    lambda z: '"' || z[1] || '": ' || coalesce('"' || z[2] || '"', 'null')), ', ') || '}}'
  WHEN qtype = 'score' THEN ', "criteria": ["' || array_to_string(levels, '", "') || '"]'
  WHEN noul_true IS NOT NULL THEN ', "criteria": {{"true": "' || noul_true || '", "false": "' || noul_false || '"}}'
  ELSE '' END || '}}'"""
SQL["preset_spec_json"] = ctes(
    ASKED, QUESTIONS, f"j AS (SELECT spec_id, '{{' || string_agg({_DEFINITION}, ', ' ORDER BY q_pos) || '}}' AS spec "
    "FROM questions GROUP BY spec_id)",
) + "SELECT spec_id, count(*) AS n, spec FROM ctx JOIN j USING (spec_id) GROUP BY spec_id, spec"
_CODE = "CASE qtype WHEN 'choice' THEN 0 WHEN 'score' THEN 1 ELSE 2 END"
SQL["question_heads"] = ctes(ASKED, QUESTIONS) + f"""SELECT conv_id, turn, q_pos::BIGINT AS q_pos, qid,
  ({_CODE})::BIGINT AS qcode,
  qtype || ' question: ' || instructions || '   ' || role AS head,
  md5('  ' || replace(text, '[MASK]', ' ') || '  !') AS state_md5
FROM ctx JOIN questions USING (spec_id)""".replace("md5('  '", "md5(' '")
SQL["custom_categories"] = ctes(
    QUESTIONS,
    "d AS (SELECT doc_id, source, lang, " + pick("doc_id", "'email'", "'email'", "'email'", "'triage'")
    + " AS spec_id FROM documents)",
    """c AS (SELECT doc_id, spec_id, q_pos, qid, qtype, levels, noul_false, noul_true,
      CASE WHEN custom THEN [source, 'other'] ELSE keys END AS keys,
      CASE WHEN custom THEN [lang, NULL] ELSE descs END AS descs
      FROM (SELECT *, spec_id = 'email' AND doc_id % 3 = 2 AND qid = 'category' AS custom
        FROM d JOIN questions USING (spec_id)))""",
    f"o AS (SELECT *, {OPTIONS} AS texts FROM c)",
) + """SELECT doc_id, spec_id, q_pos::BIGINT AS q_pos, qid, array_to_string(texts, '|') AS options,
  len(texts)::BIGINT AS k FROM o"""
SQL["interned_specs"] = """SELECT 'a|' || source || ': ' || lang AS options, count(*) AS n
FROM documents GROUP BY source, lang"""

# --- JSON -------------------------------------------------------------------------------------

_STATE = (
    """'{"role": ' || """ + quoted("role")
    + """ || ', "text": ' || """
    + quoted("""'say "hi"\\' || chr(9) || chr(1) || ' ' || text || ' 😀' || chr(127)""")
    + """ || ', "at": {"n": ' || turn || ', "gone": null}, "flags": [' || (turn > 2)::VARCHAR
      || ', null], "tags": {"a": "x", "z": ' || """ + quoted("role") + """ || '}}'"""
)
_ESCAPED = """array_to_string(list_transform(string_split(state, ''), lambda c: CASE
    WHEN c = '' THEN ''
    WHEN unicode(c) < 127 THEN c
    WHEN unicode(c) < 65536 THEN '\\u' || printf('%04x', unicode(c))
    ELSE '\\u' || printf('%04x', 55296 + ((unicode(c) - 65536) >> 10))
      || '\\u' || printf('%04x', 56320 + ((unicode(c) - 65536) & 1023)) END), '')"""
SQL["json_conversations"] = f"""WITH s AS (SELECT conv_id, turn, {_STATE} AS state FROM conversations)
SELECT conv_id, turn, state, {_ESCAPED} AS ascii FROM s"""


def _number(x: str) -> str:
    return f"({x})::DOUBLE::VARCHAR"


SQL["json_numbers"] = f"""SELECT c_custkey, '{{"key": ' || c_custkey || ', "balance": ' || {_number("c_acctbal")}
  || ', "scaled": [' || {_number("c_acctbal / 3::DOUBLE")} || ', ' || {_number("c_acctbal * 1e20::DOUBLE")}
  || ', ' || {_number("c_acctbal / 1e9::DOUBLE")} || ', null], "more": {{"zero": '
  || {_number("c_acctbal * 0::DOUBLE")} || ', "minus": ' || {_number("-c_acctbal")} || '}}}}' AS state
FROM customer"""
SQL["typed_request_rows"] = ctes(
    "src AS (SELECT {'c': conv_id, 't': turn} AS id, role || ' ' || text || ' ok' AS t FROM conversations)",
    DETECTED, routed(),
) + f"""SELECT conv_id, turn, '{{"role": ' || {quoted("role")} || ', "parts": [' || {quoted("text")}
  || ', "ok"], "turn": ' || turn || '}}' AS state_text, model, language
FROM conversations JOIN routed ON id.c = conv_id AND id.t = turn"""
SQL["context_text_flatten"] = """SELECT conv_id, turn, substr(replace(text, chr(10), ' ') || ' ' || turn || ' '
  || role || ' ' || role || ' five five', 1, 4000) AS flat FROM conversations"""
SQL["map_context_sorted"] = """SELECT p_partkey, '{' || array_to_string(list_transform(list_sort(
    [{'k': p_type, 'v': p_brand}, {'k': 'B', 'v': p_type}, {'k': 'a', 'v': p_size::VARCHAR}]),
    lambda e: '"' || e.k || '": "' || e.v || '"'), ', ') || '}' AS state FROM part"""

_V = "value::DECIMAL(18,2)::VARCHAR"
_PROPS = """'{"k": ' || json_extract(props, '$.k') || '}'"""
SQL["raw_json_documents"] = f"""SELECT event_id, event_id % 7 IN (4, 6) AS broken,
  {pick("event_id", "'object'", "'object'", "'string'", "'array'", "NULL", "'object'", "NULL")} AS kind,
  {pick("event_id", _PROPS,
        f'''{chr(39)}{{"b": {{"x": "{chr(39)} || event_type || {chr(39)}"}}, "a": [1, {chr(39)} || ({_V})::DOUBLE::VARCHAR
          || {chr(39)}, null, true, "{chr(39)} || user_id || {chr(39)}"], "p": {chr(39)} || {_PROPS} || {chr(39)}}}{chr(39)}''',
        """'"' || event_type || '"'""",
        """'[[[[[[["seven", "' || event_type || '"], "six"]]], "' || user_id || '"]], ' || user_id || ']'""",
        "NULL",
        f"""'{{"n": ' || (({_V}) || 'e3')::DOUBLE::VARCHAR || ', "m": 0, "k": "' || event_type || '"}}'""",
        "NULL")} AS canonical,
  {pick("event_id", "''", "event_type || ' ' || user_id", "event_type", "'six ' || user_id",
        "NULL", "event_type", "NULL")} AS flat,
  CASE event_id % 7 WHEN 1 THEN 'object' END AS kind_of_b
FROM events"""
SQL["raw_json_leaves"] = f"""WITH l AS (
  SELECT 'number' AS kind, 'k' AS key, 1 AS depth, json_extract(props, '$.k')::VARCHAR AS text FROM events WHERE event_id % 7 = 0
  UNION ALL SELECT 'string', 'x', 2, event_type FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'number', NULL, 2, unnest(['1', {_V}]) FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'null', NULL, 2, NULL FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'bool', NULL, 2, 'true' FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'string', NULL, 2, user_id::VARCHAR FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'number', 'k', 2, json_extract(props, '$.k')::VARCHAR FROM events WHERE event_id % 7 = 1
  UNION ALL SELECT 'string', NULL, 0, event_type FROM events WHERE event_id % 7 = 2
  UNION ALL SELECT 'string', NULL, 7, unnest(['seven', event_type]) FROM events WHERE event_id % 7 = 3
  UNION ALL SELECT 'string', NULL, 6, 'six' FROM events WHERE event_id % 7 = 3
  UNION ALL SELECT 'string', NULL, 3, user_id::VARCHAR FROM events WHERE event_id % 7 = 3
  UNION ALL SELECT 'number', NULL, 1, user_id::VARCHAR FROM events WHERE event_id % 7 = 3
  UNION ALL SELECT 'number', 'n', 1, {_V} || 'e3' FROM events WHERE event_id % 7 = 5
  UNION ALL SELECT 'number', 'm', 1, '-0' FROM events WHERE event_id % 7 = 5
  UNION ALL SELECT 'string', 'k', 1, event_type FROM events WHERE event_id % 7 = 5)
SELECT kind, key, depth::BIGINT AS depth, count(*) AS n, count(DISTINCT text) AS texts FROM l GROUP BY kind, key, depth"""

# --- sequences --------------------------------------------------------------------------------


def word_ids(text: str, var: str = "w") -> str:
    return f"list_transform(string_split({text}, ' '), lambda {var}: (length({var}) + 100)::INTEGER)"


def _sizes(rows: str) -> str:
    return f"list_transform({rows}, lambda r: len(r))"


def budget(source: str, head_max_len: str = "hml") -> str:
    """cut(.., head, opts, st) from source(.., head_ids, options, st, hml): options and head in budget."""
    return f"""b1 AS (SELECT *, list_transform(options, lambda o: [3] || o[1:48]) AS rws FROM {source}),
b2 AS (SELECT *, {head_max_len} - list_sum({_sizes("rws")}) < 16 AS tight,
  greatest(4, ({head_max_len} - 16) // greatest(1, len(rws))) AS per FROM b1),
b3 AS (SELECT *, CASE WHEN tight THEN list_transform(rws, lambda r: r[1:per]) ELSE rws END AS opts FROM b2),
b4 AS (SELECT *, greatest(8, {head_max_len} - list_sum({_sizes("opts")}))::BIGINT AS hb FROM b3),
cut AS (SELECT *, head_ids[1:hb] AS head FROM b4),
prefixed AS (SELECT *, [1] || head || [2] || flatten(opts) || [2] AS prefix,
  list_transform(opts, lambda r, i: (len(head) + 2 + coalesce(list_sum({_sizes("opts[1:i-1]")}), 0))::INTEGER)
    AS markers FROM cut)"""


TURNS = f"""turns AS (SELECT conv_id, turn, {word_ids("string_split(text, chr(10))[1]")} AS head_ids,
  list_transform(string_split(text, chr(10)), lambda t: {word_ids("t")}) AS options,
  {word_ids("text")} AS st, (conv_id % 9)::INTEGER * 16 + 24 AS hml FROM conversations)"""
SQL["option_budget"] = ctes(TURNS, budget("turns")) + f"""SELECT conv_id, turn,
  list_sum({_sizes("opts")})::BIGINT AS option_tokens, list_max({_sizes("opts")})::BIGINT AS longest,
  hb AS head_budget FROM prefixed"""
SQL["sequence_assemble"] = ctes(
    TURNS, budget("turns"),
    "a AS (SELECT *, hml + 16 + (turn % 4)::INTEGER * 40 AS ml FROM prefixed)",
) + """SELECT conv_id, turn,
  array_to_string((prefix || st[1:greatest(0, ml - len(prefix) - 1)] || [2])[1:ml], ' ') AS ids,
  array_to_string(list_filter(markers, lambda m: m < ml), ' ') AS markers,
  len(list_filter(markers, lambda m: m < ml)) <> len(markers) AS failed FROM a"""

PRESET_SEQUENCES = ",\n".join([
    ASKED,
    QUESTIONS,
    f"qs AS (SELECT spec_id, q_pos, qid, {_CODE} AS qcode, {word_ids(chr(39) + chr(39) + ' || qtype || ' + q(' question: ') + ' || instructions')} "
    f"AS head_ids, list_transform({OPTIONS}, lambda t: {word_ids('t')}) AS options, 60 AS hml FROM questions)",
    budget("qs"),
    f"""seqs AS (SELECT conv_id, turn, c.spec_id, q_pos, qid, qcode,
      (prefix || ({word_ids("text")})[1:greatest(0, ml - len(prefix) - 1)] || [2])[1:ml] AS ids,
      list_filter(markers, lambda m: m < ml) AS markers
      FROM (SELECT *, (turn % 3)::INTEGER * 60 + 80 AS ml FROM ctx) c JOIN prefixed USING (spec_id))""",
])
SQL["collate_padded"] = ctes(
    PRESET_SEQUENCES,
    """dims AS (SELECT conv_id, turn, count(*) AS n_rows, max(len(ids))::BIGINT AS max_ids,
      max(len(markers))::BIGINT AS max_options FROM seqs GROUP BY conv_id, turn)""",
) + """SELECT conv_id, turn, n_rows, max_ids, max_options, qid, qcode::BIGINT AS qcode,
  array_to_string(list_resize(ids, max_ids, 0), ' ') AS input_ids,
  rpad(repeat('1', len(ids)), max_ids::INTEGER, '0') AS attention_mask,
  array_to_string(list_resize(markers, max_options, 0), ' ') AS marker_pos,
  rpad(repeat('1', len(markers)), max_options::INTEGER, '0') AS marker_mask
FROM seqs JOIN dims USING (conv_id, turn)"""
SQL["token_usage"] = ctes(PRESET_SEQUENCES) + """SELECT conv_id, turn, sum(len(ids))::BIGINT AS input_tokens,
  0::BIGINT AS output_tokens FROM seqs GROUP BY conv_id, turn"""
SQL["batch_dimensions"] = ctes(PRESET_SEQUENCES) + """SELECT spec_id, count(*) AS n,
  max(len(ids))::BIGINT AS max_ids, max(len(markers))::BIGINT AS max_options FROM seqs GROUP BY spec_id"""
SQL["truncation_documents"] = f"""WITH d AS (SELECT lang,
  greatest(0, len(string_split(text, ' ')) - (512 - 60 - 1))::BIGINT AS dropped FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (dropped > 0) AS n_cut, sum(dropped)::BIGINT AS tokens_dropped,
  max(dropped) AS max_dropped,
  {round4("(count(*) FILTER (dropped > 0))::DOUBLE / count(*)::DOUBLE")} AS share_cut FROM d GROUP BY lang"""
SQL["maxlen_check"] = f"""WITH a AS (SELECT doc_id,
  {pick("doc_id", "n_chars", "0", "-n_chars", "NULL", "n_chars * 100")} AS asked,
  {pick("doc_id", "0", "2048")} AS override, {pick("doc_id", "512", "1024", "1024")} AS configured,
  {pick("doc_id", "192", "256")} AS hml FROM documents)
SELECT doc_id, asked, CASE WHEN coalesce(asked, 0) = 0 THEN NULL
  WHEN asked < 0 THEN 'max_len must be positive, got ' || asked
  WHEN asked > 8192 THEN 'max_len ' || asked || ' exceeds the encoder limit of 8192 tokens'
  WHEN asked < hml + 16 THEN 'max_len ' || asked || ' is too small for head_max_len=' || hml
    || ' (need at least ' || (hml + 16) || ')' END AS error,
  coalesce(nullif(asked, 0), nullif(override, 0), configured)::BIGINT AS window FROM a"""

# --- calibration ------------------------------------------------------------------------------


def softmax(source: str, logits: str = "z", temperature: str = "t", out: str = "p") -> str:
    """soft_<out>: source with column <out>, in float32 steps."""
    s = f"soft_{out}"
    return f"""{s}1 AS (SELECT *, list_transform({logits}, lambda x: (x / greatest(0.001::DOUBLE, {temperature})::FLOAT)::FLOAT) AS {out}1 FROM {source}),
{s}2 AS (SELECT *, list_max({out}1) AS {out}m FROM {s}1),
{s}3 AS (SELECT *, list_transform({out}1, lambda x: exp((x - {out}m)::FLOAT::DOUBLE)::FLOAT) AS {out}e FROM {s}2),
{s}4 AS (SELECT *, list_reduce({out}e, lambda a, b: (a + b)::FLOAT) AS {out}s FROM {s}3),
{s} AS (SELECT *, list_transform({out}e, lambda x: (x / {out}s)::FLOAT) AS {out} FROM {s}4)"""


_BY_OPTIONS = {"choice:2": 1.3, "choice:3-5": 0.8, "choice:11+": 1.75, "score:6-10": 0.55}


def temperatures(by_type, by_options) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in by_options.items())
    fallback = f"[{', '.join(f'{t!r}::DOUBLE' for t in by_type)}][{_CODE} + 1]"
    return f"CASE bucket {whens} ELSE {fallback} END" if whens else fallback


BUCKET = """qtype || ':' || CASE WHEN k <= 2 THEN '2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END"""
LOGITS = f"""v1 AS (SELECT vec_id, label, embedding, {pick("vec_id", "'choice'", "'score'", "'noul'")} AS form FROM embeddings),
v2 AS (SELECT *, CASE WHEN form = 'noul' THEN 2 WHEN form = 'score' THEN greatest(2, vec_id % 13 + 1)
  ELSE vec_id % 13 + 1 END AS width FROM v1),
v3 AS (SELECT *, unnest(range((len(embedding) + width - 1) // width)) AS part FROM v2),
v4 AS (SELECT *, least(width, len(embedding) - part * width) AS k FROM v3),
v5 AS (SELECT vec_id * 64 + part AS vec_id, label, CASE WHEN k < 2 THEN 'choice' ELSE form END AS qtype, k,
  list_transform(embedding[part * width + 1:part * width + width], lambda x: (x * 8::FLOAT)::FLOAT) AS z,
  [embedding[part + 1], embedding[len(embedding) - part]] AS az FROM v4),
logits AS (SELECT *, {BUCKET} AS bucket FROM v5)"""
TEMPERED = LOGITS + f""",
tempered AS (SELECT *, {temperatures([1.1, 0.9, 0.0001], _BY_OPTIONS)} AS t FROM logits)"""
PROBS = TEMPERED + ",\n" + softmax("tempered")

CONFIDENCE = f"""CASE WHEN k < 2 THEN 1.0::DOUBLE
  WHEN qtype = 'noul' AND noul_rule THEN {round4("greatest(p[2]::DOUBLE, 1::DOUBLE - p[2]::DOUBLE)")}
  ELSE {round4('''greatest(0, least(1, (1::FLOAT - (list_reduce([0::FLOAT] || list_transform(p,
    lambda v: (v * ln(least(1, greatest(v, 1e-12::FLOAT))::DOUBLE)::FLOAT)::FLOAT),
    lambda a, b: (a - b)::FLOAT) / ln(k::DOUBLE)::FLOAT)::FLOAT)::FLOAT))::DOUBLE''')} END"""
SCORE = round4(
    "list_reduce([0::DOUBLE] || list_transform(p, lambda v, i: (i - 1)::DOUBLE * v::DOUBLE), "
    "lambda a, b: a + b)"
)
CHOICE = "'o' || (list_position(p, list_max(p)) - 1)"

SQL["temperature_lookup"] = ctes(TEMPERED) + (
    "SELECT vec_id, qtype, k::BIGINT AS k, bucket, t AS temperature FROM tempered"
)
SQL["softmax_probabilities"] = ctes(
    PROBS, "u AS (SELECT vec_id, unnest(p) AS p, unnest(range(len(p))) AS pos FROM soft_p)"
) + f"SELECT vec_id, pos, {round4('p::DOUBLE')} AS p FROM u"
SQL["choice_argmax"] = ctes(PROBS) + (
    f"SELECT vec_id, {CHOICE} AS choice FROM soft_p WHERE qtype = 'choice'"
)
SQL["expected_score"] = ctes(PROBS) + (
    f"SELECT vec_id, {SCORE} AS score FROM soft_p WHERE qtype = 'score'"
)
SQL["noul_answer"] = ctes(PROBS) + f"""SELECT vec_id, {round4("p[2]::DOUBLE")} AS noul,
  {CONFIDENCE.replace("noul_rule", "true")} AS confidence FROM soft_p WHERE qtype = 'noul'"""
SQL["entropy_confidence"] = ctes(PROBS) + (
    f"SELECT vec_id, {CONFIDENCE.replace('noul_rule', 'false')} AS confidence FROM soft_p"
)
SQL["uncertainty_features"] = ctes(
    LOGITS, softmax("logits", temperature="1.0::DOUBLE"),
    "u AS (SELECT *, list_reverse_sort(p) AS down, greatest(len(p), 2) AS kk FROM soft_p)",
) + f"""SELECT vec_id, {round4("down[1]::DOUBLE")} AS top1,
  {round4("(down[1] - coalesce(down[2], 0::FLOAT))::FLOAT::DOUBLE")} AS margin,
  {round4('''(list_reduce([0::FLOAT] || list_transform(p, lambda v: (v * ln(greatest(v, 1e-9::FLOAT)::DOUBLE)::FLOAT)::FLOAT),
    lambda a, b: (a - b)::FLOAT) / ln(kk::DOUBLE)::FLOAT)::FLOAT::DOUBLE''')} AS entropy,
  {round4("(kk::DOUBLE / 255::DOUBLE)::FLOAT::DOUBLE")} AS k_share FROM u"""
SQL["act_probability"] = ctes(LOGITS, softmax("logits", "az", "1.0::DOUBLE", "ap")) + (
    f"SELECT vec_id, {round4('ap[1]::DOUBLE')} AS act_probability FROM soft_ap"
)

ANSWERS = PROBS + ",\n" + softmax("soft_p", "az", "1.0::DOUBLE", "ap") + f""",
ans AS (SELECT vec_id // 4 AS request_id, label, vec_id % 4 AS q_pos, 'q' || (vec_id % 4) AS qid, qtype, k, p,
  CASE WHEN qtype = 'choice' THEN {CHOICE} END AS choice,
  CASE WHEN qtype = 'score' THEN {SCORE} END AS score,
  CASE WHEN qtype = 'noul' THEN {round4("p[2]::DOUBLE")} END AS noul,
  {CONFIDENCE.replace("noul_rule", "true")} AS confidence,
  {round4("ap[1]::DOUBLE")} AS act_probability FROM soft_ap)"""
_KEYS = "list_transform(range(k), lambda i: 'o' || i)"
_LEGEND = """list_transform(range(k), lambda i: '"level o' || i || '"')"""
_PROB_KEYS = f"CASE qtype WHEN 'choice' THEN {_KEYS} WHEN 'score' THEN list_transform(range(k), lambda i: i::VARCHAR) END"
SQL["decision_rows"] = ctes(ANSWERS) + f"""SELECT request_id, q_pos, qid, qtype, choice, score, noul,
  CASE WHEN qtype = 'score' THEN array_to_string({_LEGEND}, '|') END AS legend,
  array_to_string({_PROB_KEYS}, '|') AS prob_keys, confidence, act_probability FROM ans"""
SQL["regroup_answers"] = ctes(ANSWERS) + """SELECT request_id, count(*) AS n,
  string_agg(qid, '|' ORDER BY q_pos) AS qids,
  coalesce(string_agg(choice, '|' ORDER BY q_pos), '') AS choices FROM ans GROUP BY request_id"""


def _num(x: str) -> str:
    return f"regexp_replace(printf('%.4f', {x}), '0{{1,3}}$', '')"


def _share_list() -> str:
    return (f"""'{{' || array_to_string(list_transform(list_zip({_PROB_KEYS}, p), lambda z: '"' || z[1] || '": ' || """
            f"""{_num("z[2]::DOUBLE")}), ', ') || '}}'""")


SQL["answer_json_text"] = ctes(ANSWERS, f"""j AS (SELECT request_id, q_pos, '"' || qid || '": {{"type": "' || qtype || '", ' || CASE qtype
  WHEN 'choice' THEN '"choice": "' || choice || '", "probabilities": ' || {_share_list()}
  WHEN 'score' THEN '"score": ' || {_num("score")} || ', "legend": {{' || array_to_string(list_transform(range(k),
    lambda i: '"' || i || '": "level o' || i || '"'), ', ') || '}}, "probabilities": ' || {_share_list()}
  ELSE '"noul": ' || {_num("noul")} END
  || ', "confidence": ' || {_num("confidence")} || ', "action": {{"act_probability": ' || {_num("act_probability")} || '}}}}' AS a
  FROM ans)""") + """SELECT request_id, '{' || string_agg(a, ', ' ORDER BY q_pos) || '}' AS answers
FROM j GROUP BY request_id"""
SQL["decision_summary"] = ctes(ANSWERS) + """SELECT label::BIGINT AS label, qid, choice, count(*) AS n,
  round(avg(score), 6) AS mean_score, round(avg(noul), 6) AS mean_noul, round(avg(confidence), 6) AS mean_confidence
FROM ans GROUP BY label, qid, choice"""
SQL["labelled_decisions"] = ctes(FLAT_DOCUMENTS, DETECTED, routed()) + (
    "SELECT model, language, toxic::BIGINT AS toxic, count(*) AS n FROM routed "
    "JOIN labels ON id = doc_id GROUP BY ALL"
)
SQL["logit_drift"] = ctes(LOGITS) + """SELECT count(*) AS n,
  round(max(list_max(list_transform(z, lambda x: abs(x::DOUBLE - (x + 0.003::FLOAT)::FLOAT::DOUBLE)))), 6) AS max_logit_diff,
  0.0::DOUBLE AS max_act_diff, true AS within_gate FROM logits"""
SQL["answer_parity"] = ctes(ANSWERS, """s AS (SELECT *, choice IS NULL OR choice <> 'o1' AS in_got,
  noul IS NULL OR noul > 0.2::DOUBLE AS in_want FROM ans)""", f"""f AS (SELECT in_got, in_want, score, unnest(
  ['type', 'confidence', 'act_probability']
  || CASE qtype WHEN 'choice' THEN ['choice'] WHEN 'score' THEN ['score'] ELSE ['noul'] END
  || coalesce(list_transform({_PROB_KEYS}, lambda x: 'probabilities.' || x), [])
  || CASE WHEN qtype = 'score' THEN list_transform(range(k), lambda i: 'legend.' || i) ELSE [] END) AS field
  FROM s WHERE in_got OR in_want)""") + """SELECT field, CASE WHEN NOT in_got THEN 'missing' WHEN NOT in_want THEN 'extra'
  WHEN field = 'confidence' AND coalesce(score, 0) > 2 THEN 'differs' ELSE 'ok' END AS verdict, count(*) AS n
FROM f GROUP BY ALL"""

# --- requests ---------------------------------------------------------------------------------

_LIMITS = ('field "max_len" must be an integer between 1 and 8192 (tokens), e.g. 2048 or 4096')
_MISSING_CONTEXT = 'missing "context" (a string, object or array describing the state)'
_ERRORS = {
    1: 'empty request body; send JSON with "context" and "spec"',
    2: "invalid JSON",
    3: "request body must be a JSON object",
    4: 'field "model" must be a string',
    5: _LIMITS, 6: _LIMITS, 7: _LIMITS,
    9: 'unknown field "bogus" (expected context, spec, model, lang, task, max_len; '
       'state/questions/categories are also accepted)',
    10: _MISSING_CONTEXT,
    11: 'missing "spec" (object of typed questions)',
    12: "spec must be a JSON object mapping question ids to definitions, got array",
    13: "spec has no questions",
    14: 'question "q": definition must be an object',
    15: 'question "q": missing string field "type" (choice|score|noul)',
    16: 'question "q": unknown type "rank" (choice|score|noul)',
    17: 'question "q": missing field "instructions"',
    18: 'question "q": choice questions need "criteria" (object or array of labels)',
    19: 'question "q": criteria list items must be strings',
    20: 'question "q": criteria must be an object or array, got string',
    21: 'question "q": choice questions need at least one option',
    22: 'question "q": score questions need "criteria" as an array of rubric levels',
    23: 'question "q": score questions need at least two rubric levels',
}
_BODY = "event_id % 25"
_ERROR = f"CASE {_BODY} " + " ".join(f"WHEN {i} THEN {q(m)}" for i, m in _ERRORS.items()) + " END"
SQL["request_validation"] = f"""SELECT event_id, {_ERROR} AS error,
  CASE WHEN {_BODY} NOT IN (0, 8, 24) THEN 'bad_request' END AS error_class, NULL::VARCHAR AS lang,
  CASE WHEN {_BODY} = 8 THEN event_type END AS task,
  CASE {_BODY} WHEN 7 THEN 16384 WHEN 8 THEN 4096 END::BIGINT AS max_len,
  CASE {_BODY} WHEN 0 THEN '' WHEN 8 THEN event_type WHEN 24 THEN event_type END AS context_text,
  CASE {_BODY} WHEN 0 THEN {_PROPS} WHEN 8 THEN event_type WHEN 24 THEN event_type END AS state_text
FROM events"""
SQL["request_quarantine"] = f"""SELECT 'bad_request' AS error_class, count(*) AS n FROM events
WHERE {_BODY} NOT IN (0, 8, 24)"""
_PLAIN_NOUL = f"'false: {fixed.NOUL_FALSE}|true: {fixed.NOUL_TRUE}'"
SQL["request_questions"] = f"""SELECT event_id, 0::BIGINT AS q_pos, 'q' AS qid, 'noul' AS qtype, '?' AS instructions,
  {_PLAIN_NOUL} AS options, '' AS legend FROM events WHERE {_BODY} IN (0, 8)
UNION ALL SELECT event_id, 0, 'c', 'choice', '{{"\\u00e9": "' || event_type || '", "n": 1.5}}',
  CASE WHEN event_type = 'x' THEN 'x' ELSE 'x|' || event_type END, '' FROM events WHERE {_BODY} = 24
UNION ALL SELECT event_id, 1, 'n', 'noul', '?', 'false: {fixed.NOUL_FALSE}|true: ["y", ' || user_id || ']', ''
  FROM events WHERE {_BODY} = 24
UNION ALL SELECT event_id, 2, 's', 'score', 'how?', 'level 0: null|level 1: {{"a": 2.5}}|level 2: top',
  'null|{{"a": 2.5}}|"top"' FROM events WHERE {_BODY} = 24
UNION ALL SELECT event_id, 3, 'o', 'choice', '?', 'a|b: 0|c|d: ' || {_PROPS}, '' FROM events WHERE {_BODY} = 24"""


def _option_texts(question: tuple, categories: str | None = None) -> str:
    """SQL of the rendered options of a preset question, or of given categories in their place."""
    kind, _, criteria = question
    if categories is not None:
        return categories
    if kind == "choice":
        return q("|".join(f"{k}: {v}" if v else k for k, v in criteria.items()))
    if kind == "score":
        return q("|".join(f"level {i}: {text}" for i, text in enumerate(criteria)))
    texts = criteria or {"false": fixed.NOUL_FALSE, "true": fixed.NOUL_TRUE}
    return q(f"false: {texts['false']}|true: {texts['true']}")


def _spec_options(preset: str, categories: str | None = None) -> str:
    return " || '; ' || ".join(
        f"'{qid}=' || " + _option_texts(question, categories if qid == "category" else None)
        for qid, question in fixed.PRESETS[preset].items())


SQL["preset_requests"] = f"""WITH r AS (SELECT event_id, event_type, event_id % 4 AS p, event_id % 5 AS b FROM events),
e AS (SELECT *, CASE WHEN b = 4 THEN 'unknown field "contex" (expected context, spec, model, lang, task, max_len; '
    || 'state/questions/categories are also accepted)'
  WHEN b = 1 THEN 'presets define their own spec; use /v1/predict to pass one'
  WHEN p = 2 THEN 'unknown preset "nope"; available: [{" ".join(PRESET_ORDER)}]' END AS error FROM r)
SELECT event_id, error, CASE WHEN b IN (1, 4) THEN 'bad_request' WHEN p = 2 THEN 'not_found' END AS error_class,
  CASE WHEN error IS NOT NULL THEN NULL
    WHEN p = 1 THEN {_spec_options("guard")}
    WHEN b = 0 THEN {_spec_options("email", "event_type || ': x|b'")}
    ELSE {_spec_options("email")} END AS options FROM e"""
SQL["failure_classes"] = f"""WITH m AS (SELECT {pick("doc_id",
    "'unknown model \"' || lang || '\"'", "'load ' || lang || ': no checkpoint'",
    "'question \"q\" options exceed head_max_len=192'", "'max_len must be positive, got -1'",
    "'graph failed on ' || lang", "NULL")} AS message, doc_id % 6 AS i FROM documents)
SELECT message, CASE WHEN i IN (0, 2, 3) THEN 'bad_request' WHEN i = 1 THEN 'unavailable'
  WHEN i = 4 THEN 'internal' END AS class, count(*) AS n FROM m GROUP BY message, i"""
SQL["checkpoint_availability"] = ctes(FLAT_DOCUMENTS, DETECTED, routed()) + """SELECT model, count(*) AS n,
  CASE model WHEN 'english' THEN 'hub/en' ELSE 'owner/family/' || model END AS repo,
  CASE WHEN model = 'multilingual' THEN count(*) ELSE 0 END AS unavailable FROM routed GROUP BY model"""

# --- tokenisation, scoring, end to end --------------------------------------------------------

_VOCABULARY = "vocabulary(word, id) AS (VALUES " + ", ".join(
    f"({q(w)}, {doubles.FIRST_WORD_ID + i})" for i, w in enumerate(ALL_WORDS)
) + ")"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
SQL["tokenize_documents"] = ctes(
    _VOCABULARY, f"ws AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents)",
    f"ids AS (SELECT doc_id, coalesce(id, {doubles.UNKNOWN_ID}) AS id FROM ws LEFT JOIN vocabulary USING (word))",
) + f"""SELECT doc_id, count(id) AS n, count(*) FILTER (id = {doubles.UNKNOWN_ID}) AS unknown,
  coalesce(sum(id), 0)::BIGINT AS total FROM documents LEFT JOIN ids USING (doc_id) GROUP BY doc_id"""
SQL["score_sequences"] = ctes(PRESET_SEQUENCES) + f"""SELECT conv_id, turn, q_pos::BIGINT AS q_pos, len(markers)::BIGINT AS k,
  round(list_sum(list_transform(markers, lambda m: m * {doubles.LOGIT_STEP}::DOUBLE)), 4) AS logit_sum,
  round(len(ids) * {doubles.LENGTH_STEP}::DOUBLE, 4) AS act0, qcode::DOUBLE AS act1 FROM seqs"""

# Settings of the stand-in checkpoints: window, head window, temperatures.
_CHECKPOINTS = """checkpoints(model, max_len, hml) AS (VALUES
  ('english', 512, 192), ('multilingual', 1024, 64), ('typed-decisions', 256, 100))"""
_PREDICTED = ",\n".join([
    ASKED,
    "src AS (SELECT {'c': conv_id, 't': turn} AS id, text AS t FROM ctx)", DETECTED, routed(),
    f"""asked AS (SELECT conv_id || '-' || turn AS request_id, c.spec_id, len({_WORDS}) AS n_state,
      CASE conv_id % 3 WHEN 0 THEN r.model WHEN 1 THEN 'typed-decisions' END AS model,
      {pick("turn", "NULL", "300", "100", "9000")} AS asked
      FROM ctx c JOIN routed r ON r.id.c = conv_id AND r.id.t = turn)""",
    _CHECKPOINTS,
    """checked AS (SELECT a.*, hml, coalesce(asked, max_len) AS ml,
      k.model IS NULL OR coalesce(asked > 8192 OR asked < hml + 16, false) AS bad
      FROM asked a LEFT JOIN checkpoints k USING (model))""",
    QUESTIONS,
    # A token is a blank-separated word here, so a list of n zeros stands for n ids.
    f"""qs AS (SELECT spec_id, q_pos, qid, qtype, hml, model,
      list_resize([]::INTEGER[], len(string_split(qtype || ' question: ' || instructions, ' ')), 0) AS head_ids,
      list_transform({OPTIONS}, lambda t: list_resize([]::INTEGER[], len(string_split(t, ' ')), 0)) AS options
      FROM questions, checkpoints)""",
    budget("qs"),
    f"""pred AS (SELECT request_id, c.model, c.spec_id, q_pos, qid, qtype, markers, len(markers) AS k,
      least(ml, len(prefix) + least(n_state, greatest(0, ml - len(prefix) - 1)) + 1) AS n_ids,
      list_transform(markers, lambda m: (m::FLOAT * {doubles.LOGIT_STEP}::FLOAT)::FLOAT) AS z
      FROM checked c JOIN prefixed p ON p.spec_id = c.spec_id AND p.model = c.model WHERE NOT bad)""",
])
SQL["predict_turns"] = ctes(_PREDICTED) + """SELECT request_id, CASE WHEN NOT bad THEN c.model END AS model,
  CASE WHEN bad THEN 'bad_request' END AS error_class, sum(n_ids)::BIGINT AS input_tokens,
  CASE WHEN NOT bad THEN count(n_ids) END AS n_answers
FROM checked c LEFT JOIN pred USING (request_id) GROUP BY request_id, c.model, bad"""
SQL["result_json_text"] = ctes(_PREDICTED) + """SELECT request_id, p.model, sum(n_ids)::BIGINT AS input_tokens,
  CASE WHEN hint THEN NULL ELSE script END AS script,
  CASE WHEN hint THEN 'explicit model=''typed''' ELSE reason END AS reason, count(*) AS n_answers
FROM pred p JOIN (SELECT id.c || '-' || id.t AS request_id, id.c % 3 = 1 AS hint, script, reason FROM routed)
  USING (request_id) GROUP BY ALL"""
SQL["write_and_read_results"] = ctes(_PREDICTED) + """SELECT model, count(DISTINCT request_id) AS n,
  sum(n_ids)::BIGINT AS input_tokens FROM pred GROUP BY model"""
_PREDICT_T = " ".join(
    f"WHEN {q(m)} THEN {temperatures(by_type, by_options)}"
    for m, by_type, by_options in (
        ("english", [1.0, 1.0, 1.0], {"choice:6-10": 0.5}),
        ("multilingual", [0.5, 2.0, 1.5], {}),
        ("typed-decisions", [1.0, 1.0, 0.25], {"score:3-5": 0.125}),
    )
)
SQL["predict_decisions"] = ctes(
    _PREDICTED,
    f"pb AS (SELECT *, {BUCKET} AS bucket FROM pred)",
    f"pt AS (SELECT *, CASE model {_PREDICT_T} END AS t FROM pb)",
    softmax("pt"),
    "pk AS (SELECT s.*, x.keys FROM soft_p s JOIN questions x USING (spec_id, q_pos))",
) + f"""SELECT request_id, q_pos::BIGINT AS q_pos, qid, qtype,
  CASE WHEN qtype = 'choice' THEN keys[list_position(p, list_max(p))] END AS choice,
  CASE WHEN qtype = 'score' THEN {SCORE} END AS score,
  CASE WHEN qtype = 'noul' THEN {round4("p[2]::DOUBLE")} END AS noul,
  {CONFIDENCE.replace("noul_rule", "true")} AS confidence, model FROM pk"""
SQL["stream_requests"] = ctes(
    "src AS (SELECT doc_id AS id, text AS t FROM documents)", DETECTED, routed()
) + """SELECT CASE id % 3 WHEN 0 THEN model WHEN 2 THEN 'english' END AS model,
  CASE id % 3 WHEN 0 THEN reason WHEN 2 THEN 'explicit model=''en''' END AS reason,
  id % 3 = 1 AS dead, count(*) AS n FROM routed GROUP BY ALL"""

# --- raw bodies to their end ------------------------------------------------------------------

_ALIASES = " ".join(sorted(fixed.ALIASES))
_UNKNOWN = (f"unknown model \"a\\\"b\"; choose one of [{' '.join(fixed.MODEL_NAMES)}] "
            f"(or an alias: [{_ALIASES}])")
_BOTH = {5: _LIMITS, 6: _LIMITS, 7: _LIMITS, 8: 'field "lang" must be a string', 9: _ERRORS[9],
         2: _UNKNOWN}
_PREDICT = _BOTH | {
    1: "load multilingual: no checkpoint", 11: "load multilingual: no checkpoint",
    3: "max_len 100 is too small for head_max_len=192 "
       "(need at least 208)",
    10: 'missing "spec" (object of typed questions)',
}


def _outcomes(errors: dict[int, str]) -> str:
    listed = " ".join(f"WHEN {i} THEN {q(m)}" for i, m in sorted(errors.items()))
    return f"CASE event_id % 12 {listed} END"


# Event types are single English words, which go to the default checkpoint.
_ROUTED = ("CASE WHEN event_id % 12 IN (1, 11) THEN 'multilingual' "
           "WHEN event_id % 12 = 4 THEN 'typed-decisions' ELSE 'english' END")
SQL["request_predict"] = f"""WITH r AS (SELECT event_id, event_id % 12 AS i, {_outcomes(_PREDICT)} AS error,
  {_ROUTED} AS model FROM events)
SELECT event_id, error, CASE WHEN i IN (1, 11) THEN 'unavailable' WHEN error IS NOT NULL THEN 'bad_request' END
  AS error_class, CASE WHEN error IS NULL THEN model END AS model,
  CASE WHEN i = 4 THEN 8192 WHEN error IS NULL THEN 512 END::BIGINT AS "window" FROM r"""
SQL["request_route"] = f"""SELECT event_id, {_outcomes(_BOTH)} AS error,
  CASE WHEN {_outcomes(_BOTH)} IS NOT NULL THEN 'bad_request' END AS error_class,
  CASE WHEN {_outcomes(_BOTH)} IS NULL THEN {_ROUTED} END AS model FROM events"""
SQL["stream_bodies"] = f"""SELECT model, error_class, count(*) AS n FROM ({SQL["request_route"]}) GROUP BY ALL"""
_ADMITTED = f"""SELECT event_id % 4 AS i, event_type, CASE event_id % 4 WHEN 1 THEN {q(_PREDICT[1])}
  WHEN 2 THEN {q(_PREDICT[3])} WHEN 3 THEN {q(_ERRORS[9])} END AS error FROM events"""
SQL["stream_admitted"] = f"""SELECT error, CASE i WHEN 1 THEN 'unavailable' WHEN 0 THEN NULL ELSE 'bad_request' END
  AS error_class, CASE WHEN i = 0 THEN 'english' END AS model, CASE WHEN i = 0 THEN 512 END::BIGINT AS "window",
  count(*) AS n FROM ({_ADMITTED}) GROUP BY ALL"""
SQL["stream_specs"] = f"""WITH r AS ({_ADMITTED})
SELECT DISTINCT 'is it ' || event_type || '?' AS what, 1::BIGINT AS n FROM r
UNION ALL SELECT 'rows', count(*) FROM r UNION ALL SELECT 'dead', count(error) FROM r
UNION ALL SELECT 'new_specs', count(DISTINCT event_type) FROM r"""
SQL["raw_json_deep"] = """SELECT conv_id, turn, NULL::VARCHAR AS invalid, 'array' AS kind,
  1500 + turn * 500 + 1 AS n_nodes, 1500 + turn * 500 AS depth, true AS same_text FROM conversations"""
SQL["order_contexts"] = """SELECT l_orderkey, '{"order": ' || l_orderkey || ', "items": [' || string_agg(
  '{"l_linenumber": ' || l_linenumber || ', "price": ' || l_extendedprice || ', "more": {"rates": {"tax": ' || l_tax
  || '}}}', ', ' ORDER BY l_linenumber, l_extendedprice, l_tax) || ']}' AS state FROM lineitem GROUP BY l_orderkey"""
SQL["catalog_files"] = f"""SELECT 'english' AS model, 'en' AS name, 'hub/en' AS repo, count(*) AS max_len,
  {fixed.DEFAULT_HEAD_MAX_LEN}::BIGINT AS head_max_len, count(*) AS listed_len, '1.5|2.0|0.5' AS temperature,
  {q(fixed.DEFAULT_GRAPH_FILE)} AS graph_file FROM documents WHERE lang = 'en'
UNION ALL SELECT 'typed-decisions', 'td', NULL, {fixed.DEFAULT_MAX_LEN}, {fixed.DEFAULT_HEAD_MAX_LEN},
  {fixed.DEFAULT_MAX_LEN}, '1.0|1.0|1.0', {q(fixed.DEFAULT_GRAPH_FILE)}"""


# --- documents as wholes ----------------------------------------------------------------------

_DAY = "strftime(o_orderdate::DATE, '%Y-%m-%d')"
_FLAT = f"""'"day": "' || {_DAY} || '", "at": "' || {_DAY} || 'T' || printf('%02d', o_orderkey % 24) || ':00:00'
  || CASE WHEN o_orderkey % 2 = 0 THEN '.250000' ELSE '' END || '", "raw": "' || base64(o_orderstatus::BLOB) || '"'"""
_PRICED = f"'{{' || {_FLAT} || ', \"price\": ' || o_totalprice::DOUBLE::VARCHAR || '}}'"
_VARIANT = f"""'{{"day": "' || {_DAY} || '", "key": ' || o_orderkey || ', "tags": ["a", null, 2.5]}}'"""
SQL["typed_leaf_texts"] = f"""SELECT o_orderkey, '{{' || {_FLAT} || '}}' AS flat,
  '[{{' || {_FLAT} || '}}, null]' AS list, '[' || {_PRICED} || ']' AS prices,
  '{{"k": [' || {_PRICED} || ']}}' AS map,
  '{{"v": ' || {_VARIANT} || ', "vs": [' || {_VARIANT} || ']}}' AS variants FROM orders"""


def _document(value: str, props: str, kind: str, pair: str, none: str, more: str) -> str:
    return f"""('{{"id": ' || event_id || ', "v": ' || {value} || ', "p": ' || {props}
  || ', "m": {{"type": "' || {kind} || '", "deep": {{"n": [' || {pair} || ']}}}}, "z": ' || {none} || {more} || '}}')"""


_GOT = _document("value::VARCHAR", "props", "event_type", "user_id || ', 1.0'", "'null'", "''")
_WANT = _document(
    "(value + CASE event_id % 8 WHEN 1 THEN 0.0015 WHEN 2 THEN 0.01 ELSE 0 END)::VARCHAR",
    """CASE event_id % 8 WHEN 3 THEN '{}' WHEN 4 THEN '{"x": [], ' || substr(props, 2) ELSE props END""",
    "CASE event_id % 8 WHEN 5 THEN 'other' ELSE event_type END",
    "CASE event_id % 8 WHEN 6 THEN '1, ' || user_id ELSE user_id || ', 1.0' END",
    "CASE event_id % 8 WHEN 7 THEN '0.001' ELSE 'null' END",
    """CASE event_id % 8 WHEN 0 THEN ', "more": {"a": {"b": true}}' ELSE '' END""")


def _tree(document: str) -> str:
    return f"""SELECT event_id, replace(substr(fullkey, 2), '.', '/') AS path, type,
  coalesce(try_cast(t.value AS DOUBLE[])::VARCHAR, t.value::VARCHAR) AS text,
  CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN t.value::VARCHAR::DOUBLE
    WHEN type = 'NULL' THEN 0.0 END AS number,
  CASE WHEN type = 'OBJECT' THEN len(json_keys(t.value)) END AS size
  FROM events, json_tree({document}::JSON) AS t WHERE NOT contains(fullkey, '[')"""


_PARITY = f"""g AS ({_tree(_GOT)}), w AS ({_tree(_WANT)}),
parity AS (SELECT event_id, path, CASE WHEN g.type IS NULL THEN 'missing' WHEN w.type IS NULL THEN 'extra'
    WHEN g.number IS NOT NULL AND w.number IS NOT NULL THEN
      CASE WHEN abs(g.number - w.number) <= 0.002 THEN 'ok' ELSE 'differs' END
    WHEN g.type = w.type AND CASE WHEN g.size IS NULL THEN g.text = w.text ELSE g.size = w.size END THEN 'ok'
    ELSE 'differs' END AS verdict
  FROM g FULL JOIN w USING (event_id, path))"""
SQL["document_parity"] = ctes(_PARITY) + "SELECT * FROM parity"
SQL["equal_documents"] = ctes(_PARITY) + """SELECT event_id, count(*) AS n_values,
  sum(CASE WHEN verdict <> 'ok' THEN 1 ELSE 0 END)::BIGINT AS n_bad,
  sum(CASE WHEN verdict <> 'ok' THEN 1 ELSE 0 END) = 0 AS equal FROM parity GROUP BY event_id"""


# --- batches and variants ---------------------------------------------------------------------

_BATCHES = PRESET_SEQUENCES + """,
classed AS (SELECT conv_id, turn, qid, len(ids)::BIGINT AS n_ids, len(markers)::BIGINT AS n_options,
  (greatest(len(ids), 1) - 1) // 32 AS class FROM seqs),
placed AS (SELECT *, greatest(1, 4096 // ((class + 1) * 32)) AS a_batch,
  row_number() OVER (PARTITION BY class ORDER BY n_ids, conv_id, turn, qid) - 1 AS place FROM classed),
starts AS (SELECT class, coalesce(sum(max(place // a_batch) + 1) OVER (
    ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed GROUP BY class),
batches AS (SELECT *, (start + place // a_batch)::BIGINT AS batch_id FROM placed JOIN starts USING (class))"""
SQL["length_batches"] = ctes(_BATCHES) + "SELECT conv_id, turn, qid, n_ids, batch_id FROM batches"
SQL["length_batch_report"] = ctes(_BATCHES) + """SELECT batch_id, count(*) AS n_rows, max(n_ids) AS max_ids,
  max(n_options) AS max_options, sum(n_ids)::BIGINT AS ids, (count(*) * max(n_ids))::BIGINT AS padded_ids
FROM batches GROUP BY batch_id"""
SQL["probability_movement"] = ctes(
    PROBS + ",\n" + """coarse AS (SELECT *, list_transform(z, lambda x: (floor(x::DOUBLE * 4 + 0.5) / 4)::FLOAT) AS cz
  FROM soft_p)""", softmax("coarse", "cz", "t", "cp"),
    """moved AS (SELECT vec_id, qtype, list_max(list_transform(list_zip(p, cp),
    lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS "by",
  list_position(p, list_max(p)) <> list_position(cp, list_max(cp)) AS flips FROM soft_cp)""",
) + """SELECT qtype, count(*) AS n, round(max("by"), 4) AS max_movement, round(avg("by"), 4) AS mean_movement,
  arg_min(vec_id, {'by': -"by", 'v': vec_id}) AS vec_id, sum(CASE WHEN flips THEN 1 ELSE 0 END)::BIGINT AS n_flips
FROM moved GROUP BY qtype"""

SQL["email_extras_json"] = ctes(THREADS, cleaned(200)) + f"""SELECT m.id AS doc_id,
  '{{"subject": "s", "body": ' || {quoted("c.body")}
  || CASE WHEN m.id % 2 = 0 THEN ', "id": ' || m.id || ', "flag": true' ELSE ', "flag": false' END
  || CASE WHEN m.id % 3 > 0 THEN ', "list": [{{"s": ' || {quoted("source")} || ', "x": '
     || (m.id / 4)::DOUBLE::VARCHAR || '}}, null]' ELSE '' END
  || coalesce(', "lang": ' || {quoted("lang")}, '') || '}}' AS state,
  concat_ws(' ', 's', nullif(c.body, ''), CASE WHEN m.id % 3 > 0 THEN source END, lang)[1:4000] AS read
FROM mails m JOIN clean c USING (id)"""

_HTML = ("replace(replace(replace(replace(replace(%s, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026'), "
         "chr(8232), '\\u2028'), chr(8233), '\\u2029')")
SQL["compact_json"] = f"""SELECT doc_id, '{{"z":' || {_HTML % quoted("text")} || ',"a":[],"n":[1.50,-0,1e5,' || n_chars
  || ',null,true],"\\u003ck\\u003e":{{"b":{{}},"s":"\\u003ca href=''\\u0026''\\u003e\\u2028\\u2029 \\\\ \\u0007 '
  || chr(127) || ' é","l":' || coalesce({quoted("lang")}, 'null') || '}}}}' AS compact, true AS same FROM documents"""

SQL["truncation_percentiles"] = """WITH d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  greatest(0, len(string_split(text, ' ')) - (512 - 60 - 1))::BIGINT AS dropped FROM documents),
s AS (SELECT source, lang, count(*) AS n, list_sort(list(dropped)) AS l FROM d GROUP BY ROLLUP (source, lang))
SELECT source, lang, n, l[ceil(n * 0.5)::BIGINT] AS p50, l[ceil(n * 0.9)::BIGINT] AS p90,
  l[ceil(n * 0.99)::BIGINT] AS p99 FROM s"""

SQL["golden_parity"] = ctes(ANSWERS, f"""f AS (SELECT request_id, qid, q_pos, unnest(
  ['type', 'confidence', 'act_probability']
  || CASE qtype WHEN 'choice' THEN ['choice'] WHEN 'score' THEN ['score'] ELSE ['noul'] END
  || coalesce(list_transform({_PROB_KEYS}, lambda x: 'probabilities'), [])
  || CASE WHEN qtype = 'score' THEN list_transform(range(k), lambda i: 'legend') ELSE [] END) AS field FROM ans),
places AS (SELECT DISTINCT request_id, qid, q_pos FROM ans),
last AS (SELECT request_id, count(*) AS n FROM ans GROUP BY request_id),
verdicts AS (
  SELECT request_id, 'answers.' || qid || '.' || field AS field, CASE
    WHEN request_id % 5 = 0 AND qid = 'q1' THEN 'missing'
    WHEN request_id % 5 = 0 AND field = 'confidence' THEN 'differs' ELSE 'ok' END AS verdict FROM f
  UNION ALL SELECT request_id, 'sequences.' || qid, CASE
    WHEN request_id % 5 = 0 AND q_pos = 3 THEN 'missing' ELSE 'ok' END FROM places
  UNION ALL SELECT request_id, 'usage.input_tokens', CASE WHEN request_id % 5 = 0 THEN 'differs' ELSE 'ok' END FROM last
)""") + f"""SELECT {texts(fixed.MODEL_NAMES)}[request_id % 3 + 1] AS model, field, verdict, count(*) AS n
FROM verdicts GROUP BY ALL"""

SQL["isolated_failures"] = """SELECT event_id,
  CASE WHEN event_id % 97 <> 5 THEN 2 * (props::JSON->>'k')::BIGINT END AS doubled,
  event_id % 97 = 5 AS failed, CASE WHEN event_id % 97 = 5 THEN 'internal' END AS error_class FROM events"""
