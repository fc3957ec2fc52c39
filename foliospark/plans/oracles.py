"""DuckDB SQL with the results of the queries."""

from __future__ import annotations

from foliospark.operators.titles import HEADING_WORDS
from foliospark.operators.translate import Templates
from foliospark.plans.bindings import HAN, LETTERS, REPEATED, SPANS, TYPES

_T = Templates()
_LINES = "SELECT doc_id, i - 1 AS seq, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) t, unnest(range(1, len(l) + 1)) u(i)"
_KIND = f"([{', '.join(repr(t) for t in TYPES)}])[CAST((doc_id + seq) % {len(TYPES)} AS INTEGER) + 1]"
_SENT = r"""SELECT doc_id, i - 1 AS pos, l[i] AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents) t, unnest(range(1, len(l) + 1)) u(i)"""
_SLICES = "SELECT doc_id, i AS seq, substr(text, CAST(i * 300 + 1 AS BIGINT), 300) AS text FROM documents, unnest(range(0, CAST(ceil(length(text) / 300.0) AS BIGINT))) u(i)"
_ROWS = f"SELECT doc_id, CAST(seq // 2 + 1 AS INTEGER) AS page, seq, text AS en FROM ({_SLICES})"
_ENDS = r"'(\.|\?|!|\.\"|\.\))\s*$'"
_PAIRS = rf"""SELECT a.doc_id, a.page AS page_a, a.s AS seq_a, b.page AS page_b, b.f AS seq_b FROM
  (SELECT doc_id, page, max(seq) AS s, arg_max(en, seq) AS en FROM rws GROUP BY 1, 2) a JOIN
  (SELECT doc_id, page, min(seq) AS f, arg_min(en, seq) AS en FROM rws GROUP BY 1, 2) b ON a.doc_id = b.doc_id AND b.page = a.page + 1
  WHERE regexp_matches(a.en, '\S') AND regexp_matches(b.en, '\S') AND NOT regexp_matches(a.en, {_ENDS}) AND NOT regexp_matches(b.en, '^\s*\p{{Lu}}')
    AND NOT regexp_matches(lower(a.en), '\[non[- ]text\]') AND NOT regexp_matches(lower(b.en), '\[non[- ]text\]')"""
_TURNS = "SELECT conv_id, turn, role, text AS t0, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2, lead(text, 3) OVER w AS t3 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
_PARSED = f"""SELECT doc_id, CAST(seq // 4 + 1 AS INTEGER) AS page, seq % 4 AS pos, {_KIND} AS type, CAST(seq * 37 % 500 AS INTEGER) AS x1, CAST(seq % 4 * 50 AS INTEGER) AS y1,
  CAST(seq * 37 % 500 + 300 AS INTEGER) AS x2, CAST(seq % 4 * 50 + 20 AS INTEGER) AS y2, trim(line) AS text FROM ({_LINES})"""


def _sim(a: str, b: str) -> str:
    w = lambda x: f"list_distinct(list_filter(string_split_regex(lower(trim({x})), '\\s+'), lambda y: y <> ''))"
    p = lambda x: f"('  ' || replace(lower(trim({x})), '-', ' ') || '  ')"
    g = lambda x: f"list_distinct(list_transform(range(1, length({p(x)}) - 1), lambda i: substr({p(x)}, i, 3)))"
    part = lambda f: f"len(list_intersect({f(a)}, {f(b)}))::DOUBLE / greatest(len({f(a)}), len({f(b)}))"
    return f"(CASE WHEN trim({a}) = '' OR trim({b}) = '' THEN 0.0 ELSE {part(w)} * 0.6 + {part(g)} * 0.4 END)"


def _threshold(x: str) -> str:
    return f"(CASE WHEN length({x}) < 100 THEN 0.50 WHEN length({x}) < 300 THEN 0.45 WHEN length({x}) < 600 THEN 0.40 ELSE 0.35 END)::DOUBLE"


def _passes(a: str, b: str) -> str:
    return f"coalesce({b} <> '' AND {_sim(a, b)} >= {_threshold(a)}, false)"


def _gate(en: str, zh: str) -> str:
    """Without the rules on repetition and protected spans, which texts without Chinese never reach."""
    e, z = f"trim({en}, chr(32) || chr(10))", f"trim({zh}, chr(32) || chr(10))"
    c = lambda x: f"length(regexp_replace({x}, '\\s+', '', 'g'))"
    return f"""(CASE WHEN {z} = '' OR starts_with({z}, '[ERROR') THEN 'empty_or_error' WHEN regexp_matches({z}, '(?i)^(english|chinese|translation|analysis)\\s*[:：]') THEN 'label_leak'
      WHEN length({e}) < 80 THEN 'short_source' WHEN NOT {c(z)}::DOUBLE / greatest({c(e)}, 1) BETWEEN 0.20 AND 1.25 THEN 'length_ratio' ELSE 'insufficient_chinese' END)"""


def _spans(text: str) -> str:
    """Protected spans of a text, as in protected_spans."""
    return rf"""list_filter(list_transform(
    regexp_extract_all({text}, '(?s)\$\$.*?\$\$') || regexp_extract_all({text}, '\$[^$\n]+\$') || regexp_extract_all({text}, '(?s)\\\(.*?\\\)') || regexp_extract_all({text}, '(?s)\\\[.*?\\\]')
    || regexp_extract_all({text}, '\[[^\]\n]{{1,80}}\]') || regexp_extract_all({text}, 'https?://\S+')
    || regexp_extract_all(regexp_replace({text}, '[^\x00-\x7F]', 'x', 'g'), '\b[A-Z]{{2,}}(?:[-_][A-Z0-9]+)*\b')
    || regexp_extract_all(replace({text}, '%', '% '), '(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)?(?:e[+-]?\d+)?%?)', 1), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '')"""


def _full_gate(en: str, zh: str) -> str:
    """All rules; `again` says whether the text repeats itself."""
    e, z, tight = f"trim({en}, chr(32) || chr(10))", f"trim({zh}, chr(32) || chr(10))", f"regexp_replace({zh}, '\\s+', '', 'g')"
    c = lambda x: f"length(regexp_replace({x}, '\\s+', '', 'g'))"
    han = f"len(regexp_extract_all({z}, '[\\x{{3400}}-\\x{{9fff}}]'))"
    return f"""(CASE WHEN {z} = '' OR starts_with({z}, '[ERROR') THEN 'empty_or_error' WHEN regexp_matches({z}, '(?i)^(english|chinese|translation|analysis)\\s*[:：]') THEN 'label_leak'
      WHEN length({e}) < 80 THEN 'short_source' WHEN NOT {c(z)}::DOUBLE / greatest({c(e)}, 1) BETWEEN 0.20 AND 1.25 THEN 'length_ratio'
      WHEN {han} < 12 OR {han}::DOUBLE / greatest({c(z)}, 1) < 0.25 THEN 'insufficient_chinese' WHEN again THEN 'repetition'
      WHEN NOT coalesce(list_bool_and(list_transform({_spans(e)}, lambda s: contains({tight}, s))), true) THEN 'protected_span_missing' ELSE 'accepted' END)"""


def _fill(template: str, **values: str) -> str:
    out, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        out += [f"'{before}'", values[name]]
    return "(" + " || ".join([*out, f"'{rest}'"]).replace("\n", "' || chr(10) || '") + ")"


_STYLE = "'" + _T.style + "'"
_WORDS = ", ".join(repr(w) for w in HEADING_WORDS)
_TITLE = rf"""(length(c) < 40 OR regexp_replace(lower(c), '\.+$', '') IN ({_WORDS}) OR (regexp_matches(c, '^\d+(\.\d+)*\.?\s+\w') AND length(c) < 100)
  OR (length(c) < 100 AND len(w) <= 8 AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{L}}'))) > 0
      AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{{L}}') AND NOT regexp_matches(x, '^\p{{Lu}}'))) = 0 AND NOT regexp_matches(c, {_ENDS})))"""

ORACLES: dict[str, str] = {
    "sentence_split": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, sentence FROM ({_SENT})",
    "chunk_documents": f"""WITH RECURSIVE s AS ({_SENT}),
f AS (SELECT doc_id, pos, sentence, length(sentence) AS n, 0 AS chunk_no FROM s WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, s.sentence, CASE WHEN f.n + length(s.sentence) > 500 THEN length(s.sentence) ELSE f.n + length(s.sentence) END,
    CASE WHEN f.n + length(s.sentence) > 500 THEN f.chunk_no + 1 ELSE f.chunk_no END FROM f JOIN s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, string_agg(sentence, ' ' ORDER BY pos) AS chunk FROM f GROUP BY 1, 2""",
    "adjacent_dedup": f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INTEGER) AS pos, line FROM (
  SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM ({_LINES})) WHERE p IS NULL OR p <> trim(line)""",
    "fragment_filter": f"""WITH RECURSIVE l AS (SELECT doc_id, seq * 2 AS k, line FROM ({_LINES}) UNION ALL SELECT doc_id, seq * 2 + 1, right(line, 30) FROM ({_LINES})),
f AS (SELECT doc_id, k, line, line AS kept, true AS own FROM l WHERE k = 0
  UNION ALL SELECT l.doc_id, l.k, l.line, CASE WHEN length(trim(l.line)) < 80 AND contains(f.kept, trim(l.line)) THEN f.kept ELSE l.line END,
    NOT (length(trim(l.line)) < 80 AND contains(f.kept, trim(l.line))) FROM f JOIN l ON l.doc_id = f.doc_id AND l.k = f.k + 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, line FROM f WHERE own""",
    "invalid_marker": rf"""WITH l AS (SELECT doc_id, CAST(seq AS INTEGER) AS seq, CASE (doc_id + seq) % 6 WHEN 0 THEN ' [Non-Text] ' WHEN 1 THEN '[non text][NON-TEXT] ' || line
  WHEN 2 THEN '[non-text] ' || line WHEN 3 THEN '[BLANK]' ELSE line END AS line FROM ({_LINES})), m AS (SELECT *, lower(trim(line)) AS low FROM l)
SELECT doc_id, seq, line FROM m WHERE low NOT IN ('[non-text]', '[non text]', '[none]', '[blank]') AND NOT len(regexp_extract_all(low, '\[non[- ]text\]')) * 10.0 / greatest(length(low), 1) > 0.5""",
    "merge_split": rf"""WITH RECURSIVE s AS (SELECT doc_id, seq, text, seq * 40 + seq // 7 * 200 AS y FROM ({_SLICES})),
f AS (SELECT doc_id, seq, text, y AS y1, y + 20 AS y2, 0 AS pos FROM s WHERE seq = 0
  UNION ALL SELECT s.doc_id, s.seq, s.text, CASE WHEN c THEN f.y1 ELSE s.y END, CASE WHEN c THEN greatest(f.y2, s.y + 20) ELSE s.y + 20 END, CASE WHEN c THEN f.pos ELSE f.pos + 1 END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq = f.seq + 1,
  LATERAL (SELECT regexp_matches(f.text, '\S') AND regexp_matches(s.text, '\S') AND NOT regexp_matches(f.text, {_ENDS}) AND NOT regexp_matches(s.text, '^\s*\p{{Lu}}')
    AND s.y - f.y2 <= 2.5 * greatest(f.y2 - f.y1, 10) AS c) g),
r AS (SELECT *, first_value(seq) OVER w AS a, last_value(seq) OVER (PARTITION BY doc_id, pos ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM f WINDOW w AS (PARTITION BY doc_id, pos ORDER BY seq))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(min(y1) AS INTEGER) AS y1, CAST(max(y2) AS INTEGER) AS y2,
  string_agg(regexp_replace(CASE WHEN seq < z THEN regexp_replace(text, '\s+$', '') ELSE text END, CASE WHEN seq > a THEN '^\s+' ELSE '^$' END, ''), ' ' ORDER BY seq) AS merged FROM r GROUP BY 1, 2""",
    "parse_ocr": f"SELECT doc_id, page, CAST(pos AS INTEGER) AS pos, type, x1, y1, x2, y2, text FROM ({_PARSED})",
    "classify_blocks": f"""SELECT doc_id, page, CAST(pos AS INTEGER) AS idx, type, CASE WHEN type = 'image' THEN '' ELSE text END AS en,
  CASE WHEN type IN ('text', 'image_caption', 'image_footnote', 'image') THEN '' ELSE text END AS zh, type NOT IN ('text', 'image_caption', 'image_footnote') AS passthrough,
  type NOT IN ('text', 'image_caption', 'image_footnote', 'image') AS ui_passthrough,
  type IN ('text', 'title', 'aside_text', 'caption') AND length(CASE WHEN type = 'image' THEN '' ELSE text END) > 3 AS report_kept FROM ({_PARSED}) WHERE type <> 'page_number'""",
    "fix_latex": f"SELECT doc_id, CAST(seq AS INTEGER) AS seq, '$a$ ' || line || ' $$b$$' AS fixed FROM ({_LINES})",
    "crop_geometry": """SELECT l_orderkey, l_linenumber, CAST(trunc((l_partkey % 900) * 1224 / 1024.0) AS INTEGER) AS x1, CAST(trunc((l_suppkey % 900) * 1584 / 1024.0) AS INTEGER) AS y1,
  CAST(trunc((l_partkey % 900 + 100) * 1224 / 1024.0) AS INTEGER) AS x2, CAST(trunc((l_suppkey % 900 + 120) * 1584 / 1024.0) AS INTEGER) AS y2 FROM lineitem""",
    "figure_numbers": f"""SELECT doc_id, page, CAST(pos AS INTEGER) AS idx, 'p' || (page - 1) || '_f' || (row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1) || '.png' AS figure_id
FROM ({_PARSED}) WHERE type = 'image'""",
    "pseudo_title": f"""WITH l AS (SELECT doc_id, seq, {_KIND} AS kind, trim(line) AS c FROM ({_LINES})),
w AS (SELECT *, list_filter(string_split_regex(c, '\\s+'), lambda x: x <> '') AS w FROM l), p AS (SELECT *, {_TITLE} AS pseudo FROM w)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, pseudo, kind = 'title' OR (kind = 'text' AND pseudo) AS skipped FROM p""",
    "length_router": "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 500 THEN 'long' ELSE 'normal' END AS route, length(text) <= 40 AS unchecked FROM documents",
    "cross_page_pairs": f"WITH rws AS ({_ROWS}) SELECT doc_id, page_a, CAST(seq_a AS INTEGER) AS seq_a, page_b, CAST(seq_b AS INTEGER) AS seq_b FROM ({_PAIRS})",
    "consumed_blocks": f"WITH rws AS ({_ROWS}), p AS ({_PAIRS}) SELECT doc_id, page, CAST(seq AS INTEGER) AS seq FROM rws WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = rws.doc_id AND p.page_b = rws.page AND p.seq_b = rws.seq)",
    "page_chains": f"""WITH rws AS (SELECT doc_id, CAST(seq + 1 AS INTEGER) AS page, seq, text AS en FROM ({_SLICES})), p AS ({_PAIRS}),
g AS (SELECT doc_id, page_a, page_a - row_number() OVER (PARTITION BY doc_id ORDER BY page_a) AS grp FROM p)
SELECT doc_id, min(page_a) AS chain, count(*) AS links FROM g GROUP BY doc_id, grp""",
    "split_translation": r"""WITH d AS (SELECT doc_id, replace(text, '.', '。') AS z, doc_id % 7 AS a, doc_id % 3 AS b FROM documents),
s AS (SELECT *, list_filter(string_split(regexp_replace(z, '([。！？；\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\S')) AS p,
  CAST(floor(length(z) * (a / greatest(a + b, 1)::DOUBLE)) AS BIGINT) AS t FROM d),
c AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda k: length(array_to_string(p[1:k], '')) < t)) + 1 AS k FROM s)
SELECT doc_id, CASE WHEN a + b = 0 THEN z WHEN len(p) >= 2 AND k <= len(p) THEN array_to_string(p[1:k], '') ELSE substr(z, 1, t) END AS zh1,
  CASE WHEN a + b = 0 THEN '' WHEN len(p) >= 2 AND k <= len(p) THEN array_to_string(p[k + 1:], '') ELSE substr(z, t + 1) END AS zh2 FROM c""",
    "similarity_turns": f"SELECT conv_id, turn, round({_sim('t0', 't1')}, 6) AS similarity FROM ({_TURNS}) WHERE t1 IS NOT NULL",
    "adaptive_threshold": f"SELECT conv_id, turn, {_threshold('text')} AS threshold FROM conversations",
    "audit_sample": "SELECT doc_id, ('0x' || left(sha256(text), 8))::BIGINT % 10000 AS bucket, ('0x' || left(sha256(text), 8))::BIGINT % 10000 < 1000 AS audited FROM documents",
    # Without look-behind, a number takes the character before it along; a space after % keeps that character free.
    "protected_spans": r"""WITH f AS (SELECT doc_id, list_filter(list_transform(
    regexp_extract_all(text, '(?s)\$\$.*?\$\$') || regexp_extract_all(text, '\$[^$\n]+\$') || regexp_extract_all(text, '(?s)\\\(.*?\\\)') || regexp_extract_all(text, '(?s)\\\[.*?\\\]')
    || regexp_extract_all(text, '\[[^\]\n]{1,80}\]') || regexp_extract_all(text, 'https?://\S+')
    || regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), '\b[A-Z]{2,}(?:[-_][A-Z0-9]+)*\b')
    || regexp_extract_all(replace(text, '%', '% '), '(?:^|[^A-Za-z0-9])(\d+(?:\.\d+)?(?:e[+-]?\d+)?%?)', 1), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS span FROM f, unnest(range(1, len(s) + 1)) u(i)""",
    "merge_equations": rf"""WITH RECURSIVE b AS (SELECT doc_id, CAST(seq AS INTEGER) AS i, CASE WHEN (doc_id + seq) % 4 < 3 THEN 'equation' ELSE 'text' END AS type,
  CASE WHEN (doc_id + seq) % 4 = 0 THEN '$$' ELSE line END AS en FROM ({_LINES})),
o AS (SELECT *, type = 'equation' AND regexp_matches(en, '^\s*(\$\$)?\s*$') AS orphan FROM b),
n AS (SELECT *, orphan AND coalesce(lead(type = 'equation' AND NOT orphan) OVER w, false) AS joins, lead(en) OVER w AS following FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, type, CASE WHEN joins THEN '$$' || chr(10) || following ELSE en END AS en, joins FROM n),
f AS (SELECT doc_id, i, i AS idx, type, en, joins AS skip FROM r WHERE i = 0
  UNION ALL SELECT r.doc_id, r.i, CASE WHEN f.skip OR t.takes THEN f.idx ELSE r.i END, CASE WHEN f.skip OR t.takes THEN f.type ELSE r.type END,
    CASE WHEN f.skip THEN f.en WHEN t.takes THEN f.en || chr(10) || r.en ELSE r.en END, NOT f.skip AND r.joins
  FROM f JOIN r ON r.doc_id = f.doc_id AND r.i = f.i + 1, LATERAL (SELECT f.type = 'equation' AND r.type = 'equation' AND regexp_matches(f.en, '^\s*(\$\$)?\s*$') AS takes) t)
SELECT doc_id, idx, any_value(type) AS type, arg_max(en, i) AS en FROM f GROUP BY 1, 2""",
    "fast_gate_reason": f"""WITH t AS (SELECT *, CASE (conv_id + turn) % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'Translation: ' || t1 WHEN 2 THEN '[ERROR: ' || t1 ELSE t1 END AS z FROM ({_TURNS}) WHERE t1 IS NOT NULL)
SELECT conv_id, turn, {_gate('t0', 'z')} AS reason FROM t""",
    "verify_outcome": f"""WITH t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN t0 ELSE t2 END AS b1, CASE WHEN conv_id % 2 = 0 THEN t0 ELSE t3 END AS b2 FROM ({_TURNS}) WHERE t1 IS NOT NULL),
p AS (SELECT *, length(t0) <= 40 AS skip, {_passes('t0', 'b1')} AS p1, {_passes('t0', 'b2')} AS p2 FROM t),
o AS (SELECT *, CASE WHEN skip OR p1 THEN 'passed' WHEN p2 THEN 'retried' ELSE 'failed' END AS outcome FROM p)
SELECT conv_id, turn, outcome, md5(coalesce(CASE WHEN outcome = 'retried' THEN t2 ELSE t1 END, '')) AS final_md5, CASE WHEN skip THEN 0 WHEN p1 THEN 1 ELSE 2 END AS back_verified FROM o""",
    "verifier_counts": f"""WITH t AS (SELECT * FROM ({_TURNS}) WHERE t1 IS NOT NULL), p AS (SELECT *, length(t0) <= 40 AS skip, {_passes('t0', 't0')} AS p1, {_passes('t0', 't2')} AS p2 FROM t)
SELECT role, count(*) AS total, count(*) FILTER (skip OR p1) AS passed, count(*) FILTER (NOT skip AND NOT p1 AND p2) AS retried, count(*) FILTER (NOT skip AND NOT p1 AND NOT p2) AS failed,
  0::BIGINT AS fast_accepted, 0::BIGINT AS fast_audited, 0::BIGINT AS fast_rejected, sum(CASE WHEN skip THEN 0 WHEN p1 THEN 1 ELSE 2 END)::BIGINT AS back_verified FROM p GROUP BY role""",
    "han_share": r"SELECT doc_id, len(regexp_extract_all(z, '[\x{3400}-\x{9fff}]'))::BIGINT AS han, length(regexp_replace(z, '\s+', '', 'g')) AS size FROM (SELECT doc_id, translate(text, 'aeiou', '的一是在不') AS z FROM documents)",
    "clean_output": r"""WITH o AS (SELECT doc_id, string_split(chr(10) || '--- ' || chr(10) || 'Chinese: ' || replace(text, '.' || chr(10) || 'T', '.' || chr(10) || chr(10) || 'T') || chr(10) || 'English: x', chr(10)) AS l FROM documents),
r AS (SELECT doc_id, i, trim(l[i]) AS raw, CASE WHEN starts_with(trim(l[i]), 'Chinese:') THEN trim(substr(trim(l[i]), 9)) ELSE trim(l[i]) END AS line FROM o, unnest(range(1, len(l) + 1)) u(i)),
k AS (SELECT *, raw <> '' AND line <> '' AND NOT starts_with(line, '---') AND NOT starts_with(line, 'Summary:') AS content FROM r),
h AS (SELECT *, coalesce(sum(content::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS has FROM k),
d AS (SELECT *, sum((has AND (raw = '' OR starts_with(raw, 'English:')))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM h)
SELECT doc_id, coalesce(string_agg(line, ' ' ORDER BY i) FILTER (content AND stop = 0), '') AS cleaned FROM d GROUP BY doc_id""",
    "build_prompts": f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pe FROM conversations),
q AS (SELECT conv_id AS doc_id, turn AS seq, CASE WHEN length(text) < 200 THEN {_fill(_T.short, direction="'databases'", style=_STYLE, text="text")}
  WHEN length(pe) > 30 THEN {_fill(_T.context, direction="'databases'", style=_STYLE, text="text", prev_en="left(pe, 300)", prev_zh="left(reverse(pe), 300)")}
  ELSE {_fill(_T.normal, direction="'databases'", style=_STYLE, text="text")} END AS p FROM p)
SELECT doc_id, seq, md5(p) AS prompt_md5, length(p) AS prompt_chars FROM q""",
    "context_window": """WITH c AS (SELECT *, CASE WHEN role = 'system' THEN NULL WHEN turn % 5 = 4 THEN '[ERROR: x]' ELSE reverse(text) END AS zh FROM conversations),
g AS (SELECT *, zh IS NOT NULL AND zh <> '' AND NOT starts_with(zh, '[ERROR') AS good FROM c)
SELECT conv_id AS doc_id, turn AS seq, left(last_value(CASE WHEN good THEN text END IGNORE NULLS) OVER w, 300) AS prev_en, left(last_value(CASE WHEN good THEN zh END IGNORE NULLS) OVER w, 300) AS prev_zh,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS remembered FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "abstract_pick": f"""WITH l AS (SELECT doc_id, seq, line, trim(line) AS c FROM ({_LINES}) WHERE seq < 4), w AS (SELECT *, list_filter(string_split_regex(c, '\\s+'), lambda x: x <> '') AS w FROM l)
SELECT doc_id, left(line, 1500) AS abstract FROM w WHERE NOT {_TITLE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, seq) = 1""",
    "type_census": "SELECT CAST(user_id AS VARCHAR) AS doc, event_type AS type, count(*) AS n, grouping_id(user_id, event_type) AS level FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id), (event_type), ())",
    "common_types": """WITH c AS (SELECT event_type AS type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY 1) SELECT type, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c""",
    "cumulative_census": """WITH c AS (SELECT user_id AS doc, CAST(dayofyear(ts) AS INTEGER) AS page, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2, 3),
f AS (SELECT p.doc, p.page, k.type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT doc, page FROM c) p JOIN (SELECT DISTINCT doc, type FROM c) k ON p.doc = k.doc LEFT JOIN c ON c.doc = p.doc AND c.page = p.page AND c.type = k.type),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc, type ORDER BY page) AS BIGINT) AS total FROM f) SELECT * FROM t WHERE total > 0""",
    "run_summary": """WITH p AS (SELECT source, count(*) AS b, sum(quality) AS v, sum(toxic) AS r, sum(n_chars)::DOUBLE AS o, count(*)::DOUBLE AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT count(*) AS pages, CAST(sum(b) AS BIGINT) AS total_blocks, CAST(sum(v) AS BIGINT) AS verified, CAST(sum(r) AS BIGINT) AS retried, sum(o) AS ocr_time, sum(t) AS trans_time FROM p)
SELECT *, verified || '/' || total_blocks || ' (' || CAST(round_even(verified * 100.0 / greatest(total_blocks, 1), 0) AS BIGINT) || '%)' AS pass_rate, ocr_time + trans_time AS total_time FROM s""",
    "page_break_markdown": """WITH b AS (SELECT *, turn // 2 AS page, CASE WHEN turn % 4 = 3 THEN '[ERROR: x]' ELSE reverse(text) END AS zh, lag(turn // 2) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, '# c' || conv_id || chr(10) || chr(10) || '> done' || chr(10) || chr(10) || string_agg(CASE WHEN p IS NULL OR p <> page THEN '## Page ' || page || chr(10) || chr(10) ELSE '' END || '**[' || role || ']**' || chr(10) || chr(10) || '> ' || text || chr(10) || chr(10)
  || CASE WHEN starts_with(zh, '[ERROR') THEN '*' || zh || '*' ELSE zh END || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS markdown FROM b GROUP BY conv_id""",
    "progress_state": """SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'translate' AS phase, CAST(max(turn // 2 + 1) AS INTEGER) AS total_pages, CAST(max(turn // 2 + 1) AS INTEGER) AS current_page,
  CAST(count(*) AS INTEGER) AS done, CAST(count(*) AS INTEGER) AS total, count(*) AS blocks, true AS over, 100::BIGINT AS percent FROM conversations GROUP BY conv_id""",
    "latest_events": """SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n, CAST(floor(100.0 * count(*) FILTER (event_type = 'purchase') / count(*) + 0.5) AS BIGINT) AS percent FROM events GROUP BY 1""",
    "ordered_state": """WITH c AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, CASE WHEN role = 'system' THEN NULL WHEN turn % 5 = 4 THEN '[ERROR: x]' ELSE reverse(text) END AS zh, (conv_id + turn) % 4 AS o FROM conversations),
g AS (SELECT *, zh IS NOT NULL AND zh <> '' AND NOT starts_with(zh, '[ERROR') AS good FROM c),
n AS (SELECT conv_id AS doc_id, 'block' AS kind, seq, text, zh, good, o FROM g UNION ALL SELECT conv_id, 'complete', count(*)::INTEGER, NULL, NULL, NULL, NULL FROM g GROUP BY 1)
SELECT doc_id, kind, seq, left(last_value(CASE WHEN good THEN text END IGNORE NULLS) OVER w, 300) AS prev_en, left(last_value(CASE WHEN good THEN zh END IGNORE NULLS) OVER w, 300) AS prev_zh,
  CAST(least(count(*) FILTER (good) OVER w, 10) AS INTEGER) AS remembered, CAST(count(*) FILTER (o < 2) OVER w AS INTEGER) AS passed, CAST(count(*) FILTER (o = 2) OVER w AS INTEGER) AS retried, CAST(count(*) FILTER (o = 3) OVER w AS INTEGER) AS failed
FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}
ORACLES["arriving_pairs"] = ORACLES["cross_page_pairs"]

#: Targets as plans.queries makes them: Han characters for letters, and a fault in most.
_TARGETS = f"""SELECT *, CASE (conv_id + turn) % 8 WHEN 2 THEN translate(z, '0123456789', '') WHEN 3 THEN z || repeat('{REPEATED}', 3) WHEN 4 THEN 'Translation: ' || z WHEN 5 THEN left(z, 10) WHEN 6 THEN text WHEN 7 THEN ' ' ELSE z END AS zh
FROM (SELECT *, translate(text, '{LETTERS}', '{HAN}') AS z FROM (SELECT * REPLACE (text || '{SPANS}' AS text) FROM conversations))"""
#: The same with `again`: 2 p characters are those p places on, for a p from 8 to 30, on one line. Candidates are equal runs of 8 characters.
_GRAMS = f"""g AS MATERIALIZED (SELECT conv_id, turn, s, i, substr(s, i, 8) AS w FROM (SELECT conv_id, turn, trim(zh, chr(32) || chr(10)) AS s FROM ({_TARGETS})), unnest(range(1, length(s) - 6)) u(i))"""
_REPEATS = f"""SELECT t.*, k.conv_id IS NOT NULL AS again FROM ({_TARGETS}) t LEFT JOIN (
  SELECT DISTINCT a.conv_id, a.turn FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w = b.w
  WHERE b.i - a.i BETWEEN 8 AND 30 AND a.i + 3 * (b.i - a.i) - 1 <= length(a.s) AND substr(a.s, a.i, 2 * (b.i - a.i)) = substr(a.s, b.i, 2 * (b.i - a.i)) AND NOT contains(substr(a.s, a.i, 3 * (b.i - a.i)), chr(10))) k USING (conv_id, turn)"""
ORACLES["gate_reasons"] = f"WITH {_GRAMS} SELECT conv_id, turn, {_full_gate('text', 'zh')} AS reason FROM ({_REPEATS})"
ORACLES["adaptive_counts"] = f"""WITH {_GRAMS}, t AS (SELECT *, {_full_gate('text', 'zh')} AS reason, CASE WHEN turn % 3 = 0 THEN 'x' ELSE text END AS b1, CASE WHEN conv_id % 2 = 0 THEN 'x' ELSE text END AS b2 FROM ({_REPEATS})),
p AS (SELECT role, length(text) <= 40 AS skip, reason = 'accepted' AS fine, ('0x' || left(sha256(text), 8))::BIGINT % 10000 < 1000 AS audited, {_passes('text', 'b1')} AS p1, {_passes('text', 'b2')} AS p2 FROM t),
o AS (SELECT *, NOT skip AND fine AND NOT audited AS fast FROM p)
SELECT role, count(*) AS total, count(*) FILTER (skip OR fast OR p1) AS passed, count(*) FILTER (NOT (skip OR fast OR p1) AND p2) AS retried, count(*) FILTER (NOT (skip OR fast OR p1 OR p2)) AS failed,
  count(*) FILTER (fast) AS fast_accepted, count(*) FILTER (NOT skip AND fine AND audited) AS fast_audited, count(*) FILTER (NOT skip AND NOT fine) AS fast_rejected,
  sum(CASE WHEN skip OR fast THEN 0 WHEN p1 THEN 1 ELSE 2 END)::BIGINT AS back_verified FROM o GROUP BY role"""
