"""SQL for DuckDB that must give the rows of the queries, written apart from the Spark code."""

from __future__ import annotations

from quire import lexicon as L


def words(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


def norm(t: str) -> str:
    return rf"trim(regexp_replace({t}, '[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+', ' ', 'g'))"


def n_words(t: str) -> str:
    return rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?'))"


def tokens(t: str) -> str:
    """ASCII tokens that no accented letter touches."""
    return rf"regexp_extract_all(regexp_replace({t}, '[A-Za-z0-9_]*[^\x00-\x7F\x{{2000}}-\x{{206F}}¿¡«»°·][\p{{L}}\p{{N}}_]*', '0', 'g'), '\b[A-Za-z](?:[A-Za-z.-]*[A-Za-z])?\b')"


def edge(t: str) -> str:
    return f"""trim({t}, '.,;:!?()[]{{}}"''')"""


def clamp(x: str) -> str:
    return f"round(greatest(least({x}, 1.0), 0.0), 3)"


TYPES = words(L.SCORED_TYPES)

BLOCKS = rf"""
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS source_text FROM l),
g AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(pos // 5 + 1 AS INTEGER) AS page_number, source_text, length(source_text) AS n,
        CASE WHEN pos = 0 THEN 16.0::DOUBLE ELSE 11.0::DOUBLE END AS size, pos = 0 AS bold FROM u),
h AS (SELECT *, 72.0::DOUBLE AS x0, 72.0::DOUBLE + least(451, 5 * n) AS x1,
        CAST(100 + coalesce(sum(12 + CASE WHEN n % 3 = 0 THEN 30 ELSE 2 END) OVER (PARTITION BY doc_id, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS y0,
        coalesce(avg(size) FILTER (trim(source_text) <> '') OVER (PARTITION BY doc_id, page_number), 0.0) AS page_avg FROM g),
k AS (SELECT *, y0 + 12 AS y1, CASE
    WHEN regexp_matches(source_text, '^\s*([-*•‣▪]|\d+[.)]|[A-Za-z][.)])\s+') OR regexp_matches(source_text, '(?i)^\s*(Q|A)\s*[:.-]\s+') THEN 'list_item'
    WHEN regexp_matches(source_text, '^\s*(\[\d+\]|\d+[.)]|\d+)\s+') AND (size <= page_avg - 1 OR y0 >= 0.65 * 842) THEN 'footnote'
    WHEN regexp_matches(source_text, '(?i)^\s*(fig\.?|figure|table)\s+\d+') OR (size <= page_avg - 1 AND (starts_with(lower(source_text), 'source:') OR starts_with(lower(source_text), 'caption:'))) THEN 'caption'
    WHEN n <= 120 AND len(regexp_extract_all(source_text, '[.,;:!?]')) / greatest(n, 1) <= 0.08
      AND (size >= greatest(14.0, page_avg + 1.5) OR (bold AND size >= page_avg) OR (y0 <= 0.35 * 842 AND size >= page_avg + 1)) THEN 'title'
    WHEN {norm('source_text')} <> '' AND len(string_split({norm('source_text')}, ' ')) >= 4 THEN 'paragraph' ELSE 'unknown' END AS kind FROM h),
blocks AS (SELECT * EXCLUDE (kind), CASE WHEN kind = 'title' THEN kind WHEN y0 <= 0.06 * 842 THEN 'header' WHEN y1 >= 0.92 * 842 THEN 'footer' ELSE kind END AS type FROM k)
"""


def phrase_cut(p: str) -> str:
    pat = rf"(?i)([\s,;:\-.]+){p}[\s.!,;:]*$"
    return rf"""CASE WHEN regexp_matches(c, '{pat}') THEN rtrim(CASE WHEN contains(regexp_extract(c, '{pat}', 1), '.') THEN regexp_replace(c, '{pat}', '. ')
        ELSE regexp_replace(c, '{pat}', '') END, ' ,;:-') ELSE c END"""


PHRASES = ",".join(f"\nm{k + 1} AS (SELECT * EXCLUDE (c), {phrase_cut(p)} AS c FROM m{k})" for k, p in enumerate(L.RESIDUAL_PHRASES))
MOCK = rf"""
m0 AS (SELECT *, trim('[FR MOCK] ' || source_text) AS c FROM blocks),{PHRASES},
m5 AS (SELECT *, list_filter(string_split({norm('c')}, ' '), lambda x: x <> '') AS cw FROM m4),
m6 AS (SELECT * EXCLUDE (c, cw), trim(CASE WHEN len(cw) > 1 AND lower({edge('cw[-1]')}) IN {words(L.RESIDUAL_WORDS)} THEN rtrim(array_to_string(cw[:-2], ' '), ' ,;:-') ELSE c END) AS mock FROM m5)
"""

TRANSLATED = (
    BLOCKS + "," + MOCK + """,
tr AS (SELECT *, CASE WHEN pos % 11 = 7 THEN '' WHEN pos % 3 = 1 THEN source_text ELSE mock END AS translated_text FROM m6)
"""
)

SECTIONS = rf"""
s1 AS (SELECT *, sum(CASE WHEN type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS opened FROM blocks WHERE type IN {words(L.SECTION_TYPES)}),
s2 AS (SELECT *, opened + max(CASE WHEN opened = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS section_no,
    max(CASE WHEN type = 'title' THEN {norm('source_text')} END) OVER (PARTITION BY doc_id, opened) AS st FROM s1),
sec AS (SELECT doc_id, pos, page_number, type, source_text, section_no, coalesce(nullif(st, ''), 'Untitled section') AS section_title FROM s2)
"""


def overlap(a: str, b: str) -> str:
    x, y = (f"list_distinct(regexp_extract_all(lower({t}), '[a-z]+'))" for t in (a, b))
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


ASCII = "regexp_extract_all({}, '[A-Za-z][A-Za-z''-]*')"
PLAUSIBLE = f"(len(aw) BETWEEN 2 AND 4 AND len(list_filter(aw, lambda w: NOT (regexp_matches(w, '^[A-Z]') OR lower(w) IN {words(L.SEMANTIC_STOPWORDS)}))) = 0)"
SHAPE = "(len(aw) >= 8 OR (len(aw) >= 4 AND regexp_matches(s, '[.!?:;]$')))"
GARBLED = r"(regexp_matches(t, '" + "|".join(f"{c}{{6,}}" for c in [*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 éèàç", *(r"\x{%X}" % ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")]) + r"') OR len(regexp_extract_all(t, '[#@$%^*_+=<>|~]')) >= 3)"

SCORED = (
    "WITH RECURSIVE " + TRANSLATED + "," + SECTIONS + rf""",
j AS (SELECT tr.*, coalesce(sec.section_title, '') AS section_title, {norm('tr.source_text')} AS s, {norm('tr.translated_text')} AS t,
        {ASCII.format(norm('tr.source_text'))} AS aw FROM tr LEFT JOIN sec USING (doc_id, pos)),
w AS (SELECT *, {n_words('s')} AS sw, {n_words('t')} AS tw, CASE WHEN s = '' THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, lower(s)) END AS occ,
        list_filter({tokens('t')}, lambda x: true) AS tk FROM j),
q AS (SELECT *, type IN {TYPES} AS ok, CAST(tw AS DOUBLE) / greatest(sw, 1) AS ratio,
    list_filter(tk, lambda x: NOT (x IN {words(L.SCORING_ACRONYMS)} OR starts_with(x, 'http') OR starts_with(x, 'www') OR (upper(x) = x AND lower(x) <> x AND length(x) > 1)
      OR (regexp_matches(x, '^[A-Z]') AND length(x) > 2))) AS free FROM w),
sc AS (SELECT *,
  CASE WHEN NOT ok OR s = '' OR t = '' THEN 0.0 ELSE {clamp(rf'''1.0::DOUBLE - CASE WHEN tw < 2 AND type NOT IN ('title', 'caption') THEN 0.35 ELSE 0 END
    - CASE WHEN ratio < 0.35 OR ratio > 2.4 THEN 0.25 ELSE 0 END - CASE WHEN {GARBLED} THEN 0.35 ELSE 0 END
    - CASE WHEN type IN ('paragraph', 'footnote') AND tw >= 6 AND NOT regexp_matches(t, '[.!?]$') THEN 0.1 ELSE 0 END
    - CASE WHEN length(replace(t, '[', '')) <> length(replace(t, ']', '')) THEN 0.1 ELSE 0 END''')} END AS tq,
  CASE WHEN NOT ok OR len(tk) = 0 THEN 0.0 ELSE {clamp(f'''least(0.85, CAST(len(list_filter(free, lambda x: lower({edge('x')}) IN {words(L.SCORING_RESIDUALS)})) AS DOUBLE) / len(tk) * 2.4)
    + least(0.25, len(list_filter(free, lambda x: lower({edge('x')}) IN {words(L.MINI_SPAN_WORDS)})) * 0.08)''')} END AS er,
  CASE WHEN NOT ok OR s = '' OR t = '' THEN 0.0 ELSE {clamp(rf'''0.82::DOUBLE + CASE WHEN ratio BETWEEN 0.55 AND 1.9 THEN 0.12 ELSE -0.18 END
    + CASE WHEN section_title <> '' AND type = 'title' AND {overlap('s', 'section_title')} >= 0.4 THEN 0.06 ELSE 0 END
    - CASE WHEN type = 'list_item' AND NOT regexp_matches(s, '^\s*([-*•]|\d+[.)]|[A-Za-z][.)])\s+') THEN 0.08 ELSE 0 END
    - CASE WHEN len(regexp_extract_all(lower(s), '[a-z]+')) BETWEEN 1 AND 2 THEN 0.45 ELSE 0 END''')} END AS cs,
  CASE WHEN NOT ok OR t = '' THEN 0.0 ELSE {clamp('''CASE WHEN x1 - x0 < greatest(80, size * 8) THEN 0.25 ELSE 0 END + CASE WHEN y1 - y0 < greatest(12, size * 1.25) THEN 0.2 ELSE 0 END
    + CASE WHEN CAST(length(t) AS DOUBLE) / greatest(length(s), 1) > 1.45 THEN least(0.35, (CAST(length(t) AS DOUBLE) / greatest(length(s), 1) - 1.45) * 0.22) ELSE 0 END
    + CASE WHEN (CASE WHEN x1 - x0 <= 0 THEN 999 ELSE greatest(1, ceil(CAST(length(t) AS DOUBLE) / greatest(floor((x1 - x0) / (size * 0.52)), 1))) END) * size * 1.2 > y1 - y0 THEN 0.25 ELSE 0 END''')} END AS risk,
  {overlap('s', 'section_title')} >= 0.15 AS signal FROM q),
cf AS (SELECT *, {clamp(rf'''0.52::DOUBLE + CASE WHEN len(aw) >= 6 THEN 0.22 WHEN len(aw) >= 4 THEN 0.12 ELSE 0 END + CASE WHEN {SHAPE} THEN 0.16 ELSE 0 END + CASE WHEN t <> '' THEN 0.05 ELSE 0 END
    + CASE WHEN type = 'title' THEN 0.08 + CASE WHEN size >= 13 THEN 0.18 ELSE 0 END + CASE WHEN sw BETWEEN 2 AND 8 AND {PLAUSIBLE} THEN 0.08 ELSE 0 END ELSE 0 END
    + CASE WHEN type = 'list_item' AND regexp_matches(s, '^\s*([-*•]|\d+[.)]|[A-Za-z][.)])\s+') THEN 0.08 ELSE 0 END - CASE WHEN contains(t, s) AND t <> s THEN 0.05 ELSE 0 END
    - CASE WHEN NOT (type = 'title' AND {PLAUSIBLE}) AND sw <= 3 AND NOT regexp_matches(s, '[.!?:;]$') THEN 0.18 ELSE 0 END + CASE WHEN signal THEN 0.08 ELSE 0 END''')} AS raw,
  CASE WHEN len(aw) = 0 THEN true WHEN type = 'title' AND {PLAUSIBLE} THEN false ELSE len(aw) <= 1 OR (len(aw) <= 3 AND NOT {SHAPE}) END AS mini,
  regexp_matches(s, '^[A-Z][A-Z0-9.-]+$') AS acr FROM sc),
cc AS (SELECT *, CASE WHEN NOT ok OR s = '' THEN 0.0 WHEN occ > 1 AND sw <= 4 THEN 0.2 WHEN acr AND signal THEN 0.5 WHEN acr THEN 0.2 WHEN mini THEN 0.25 ELSE raw END AS conf,
  CASE WHEN NOT ok OR s = '' THEN 'semantic_noise' WHEN occ > 1 AND sw <= 4 THEN 'semantic_noise' WHEN acr AND signal THEN 'contextual_acronym' WHEN acr OR mini THEN 'probable_fragment'
    WHEN raw >= 0.75 THEN 'strong_document_block' WHEN raw < 0.35 THEN 'semantic_noise' WHEN raw < 0.55 THEN 'probable_fragment' ELSE 'strong_document_block' END AS cat FROM cf),
scored AS (SELECT *, CASE WHEN ok THEN list_filter([CASE WHEN tq < 0.55 THEN 'low_translation_quality' END, CASE WHEN cs < 0.55 THEN 'low_semantic_consistency' END,
    CASE WHEN risk > 0.55 THEN 'high_overlay_risk' END, CASE WHEN er > 0.25 THEN 'english_residual_detected' END,
    CASE WHEN cat = 'semantic_noise' THEN 'semantic_noise' WHEN cat = 'probable_fragment' THEN 'probable_fragment' WHEN conf < 0.45 THEN 'low_semantic_confidence' END], lambda x: x IS NOT NULL) ELSE [] END AS warnings FROM cc)
"""
)


def mean_of(x: str, where: str = "true") -> str:
    v, f = f"CAST(round({x} * 1000) AS BIGINT)", f"FILTER ({where})"
    return f"coalesce((2 * sum({v}) {f} + count(*) {f}) // nullif(2 * count(*) {f}, 0) / 1000, 0.0)"


def listed(test: str) -> str:
    return f"CAST(coalesce(sum(len(list_filter(warnings, lambda x: {test}))), 0) AS BIGINT)"


REPORT = (
    SCORED + rf""",
tt AS (SELECT doc_id, count(*) AS blocks_count, count(*) FILTER (trim(translated_text) <> '') AS translated_blocks_count, count(DISTINCT page_number) AS pages_count,
    count(*) FILTER (type IN {words(L.REPORTED_TYPES)}) AS units, count(*) FILTER (type IN {words(L.REPORTED_TYPES)} AND trim(translated_text) = '') AS open,
    {listed('true')} AS warnings_count, {listed('x IN ' + words(L.CRITICAL_WARNINGS))} AS critical, {listed('x IN ' + words(L.REVIEW_WARNINGS))} AS review,
    {listed("contains(x, 'english_residual')")} AS rw, count(*) FILTER (er > 0.25) AS rb,
    {mean_of('tq', 'ok')} AS tqm, {mean_of('risk', 'ok')} AS riskm, {mean_of('cs', 'ok')} AS csm, {mean_of('conf')} AS confm FROM scored GROUP BY doc_id),
r1 AS (SELECT *, greatest(rw, rb) AS res, CASE WHEN tqm > 0 THEN tqm WHEN units > 0 THEN {clamp('1 - CAST(open AS DOUBLE) / units')} ELSE 0.75 END AS translation_score,
    {clamp('1 - riskm')} AS overlay_score, CASE WHEN csm > 0 THEN csm ELSE {clamp('confm')} END AS semantic_score, 1.0::DOUBLE AS table_score FROM tt),
r2 AS (SELECT *, list_sort(list_filter([CASE WHEN open > 0 THEN 'translation_incomplete' END, CASE WHEN res > 2 THEN 'english_residuals_detected' END,
      CASE WHEN critical > 0 THEN 'critical_warnings_present' END], lambda x: x IS NOT NULL)) AS major,
    list_sort(list_filter([CASE WHEN res BETWEEN 1 AND 2 THEN 'limited_english_residuals_detected' END, CASE WHEN warnings_count > 0 AND critical = 0 THEN 'non_critical_warnings_present' END,
      CASE WHEN review > 0 THEN 'manual_review_recommended' END], lambda x: x IS NOT NULL)) AS minor,
    {clamp('''translation_score * 0.35 + semantic_score * 0.25 + overlay_score * 0.25 + table_score * 0.15 - least(0.25, res * 0.03::DOUBLE) - least(0.2, critical * 0.04::DOUBLE)
      - least(0.35, CASE WHEN units > 0 THEN CAST(open AS DOUBLE) / units ELSE 0 END * 0.35::DOUBLE)''')} AS overall_score FROM r1),
report AS (SELECT doc_id, overall_score, translation_score, overlay_score, semantic_score, table_score, res AS english_residual_count, warnings_count, blocks_count, translated_blocks_count, pages_count,
    CASE WHEN overall_score < 0.55 OR list_contains(major, 'translation_incomplete') THEN 'document_not_ready'
      WHEN overall_score >= 0.9 AND res <= 2 AND critical = 0 AND len(major) = 0 AND warnings_count = 0 THEN 'document_ready'
      WHEN overall_score >= 0.75 AND critical = 0 AND len(major) = 0 THEN 'document_ready_with_minor_review' ELSE 'document_needs_review' END AS recommendation,
    array_to_string(major, ',') AS major_issues, array_to_string(minor, ',') AS minor_issues FROM r2)
"""
)

CONFIDENCE = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.ROLE_CONFIDENCE.items()) + " ELSE 0.5 END"

ORACLE_SQL: dict[str, str] = {
    "classify_blocks": "WITH " + BLOCKS + f"SELECT doc_id, pos, page_number, type, x1, y0, page_avg, {CONFIDENCE}::DOUBLE AS confidence FROM blocks",
    "mock_translate": SCORED + "SELECT doc_id, pos, mock AS translated_text FROM scored",
    "block_translation_score": SCORED + "SELECT doc_id, pos, tq AS score FROM scored",
    "english_residual_score": SCORED + "SELECT doc_id, pos, er AS score FROM scored",
    "overlay_risk": SCORED + "SELECT doc_id, pos, risk AS score FROM scored",
    "semantic_consistency": SCORED + "SELECT doc_id, pos, cs AS score FROM scored",
    "semantic_confidence": SCORED + "SELECT doc_id, pos, conf AS score, cat AS category FROM scored",
    "repeated_fragments": SCORED + "SELECT doc_id, pos, occ AS occurrences FROM scored WHERE occ > 1 AND sw <= 4",
    "document_quality": SCORED + f"""SELECT doc_id, {mean_of('tq', 'ok')} AS average_translation_quality, {mean_of('er', 'ok')} AS average_english_residual,
        {mean_of('cs', 'ok')} AS average_semantic_consistency, {mean_of('risk', 'ok')} AS average_overlay_risk,
        count(*) FILTER (ok AND len(warnings) > 0) AS blocks_needing_review, count(*) FILTER (ok) AS total_blocks_scored FROM scored GROUP BY doc_id""",
    "quality_report": REPORT + "SELECT * FROM report",
    "recommendation_histogram": REPORT + "SELECT recommendation, count(*) AS n, CAST(sum(warnings_count) AS BIGINT) AS warnings FROM report GROUP BY 1",
    "warning_histogram": SCORED + "SELECT warning, count(*) AS n FROM (SELECT unnest(warnings) AS warning FROM scored) GROUP BY 1",
    "suspicious_top20": SCORED + "SELECT doc_id, pos, type, left(source_text, 90) AS text, array_to_string(list_sort(warnings), ',') AS warnings FROM scored WHERE len(warnings) > 0 ORDER BY doc_id, pos LIMIT 20",
    "document_sections": "WITH " + BLOCKS + "," + SECTIONS + """SELECT doc_id, printf('section_%03d', section_no) AS section_id, section_title AS title, min(page_number) AS page_start, max(page_number) AS page_end,
        string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS block_ids, count(*) AS blocks_count FROM sec GROUP BY doc_id, section_no, section_title""",
    "section_lookup": "WITH " + BLOCKS + "," + SECTIONS + "SELECT doc_id, pos, coalesce(section_title, '') AS section_title FROM blocks LEFT JOIN sec USING (doc_id, pos)",
    "neighbor_context": "WITH " + BLOCKS + "," + SECTIONS + f"""SELECT doc_id, pos, coalesce(lag(source_text) OVER w, '') AS previous_text, coalesce(lead(source_text) OVER w, '') AS next_text
        FROM sec WHERE type IN {TYPES} AND trim(source_text) <> '' WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY pos)""",
}


def deco(t: str) -> str:
    return f"regexp_extract_all({t}, '[A-Za-z]+')"


NORM = norm("source_text")
ONLY_BLOCKS = "WITH " + BLOCKS
WORD4 = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"
STATE = rf"""CASE WHEN type = 'unknown' AND trim(source_text) <> '' THEN 'unsupported_text_fragment' WHEN type NOT IN {TYPES} THEN '' WHEN
  (length(s) < 3 OR len({deco('s')}) = 0 OR (len({deco('s')}) <= 3 AND len(list_filter({deco('lower(s)')}, lambda x: x NOT IN {words(L.QUESTION_WORDS)})) = 0)
   OR (type NOT IN ('title', 'caption', 'footnote', 'list_item') AND len({deco('s')}) <= 2 AND NOT regexp_matches(s, '[.!?:;]'))) THEN 'suspicious_fragment'
  WHEN trim(translated_text) = '' THEN 'suspicious_translation' ELSE '' END"""
STATED = (
    SCORED + rf""",
ss AS (SELECT *, {STATE} AS warning FROM scored),
st AS (SELECT *, CASE WHEN warning <> '' THEN 'needs_review' WHEN type NOT IN {TYPES} THEN 'pending' ELSE 'translated' END AS status, printf('batch_%03d', (page_number - 1) // 2 + 1) AS batch_id FROM ss),
pc AS (SELECT doc_id, max(page_number) AS page_count FROM blocks GROUP BY 1),
pb AS (SELECT doc_id, page_count, unnest(range(1, page_count + 1, 2)) AS page_start FROM pc),
plan AS (SELECT doc_id, printf('batch_%03d', (page_start - 1) // 2 + 1) AS batch_id, CAST(page_start AS INTEGER) AS page_start, CAST(least(page_start + 1, page_count) AS INTEGER) AS page_end FROM pb),
fw AS (SELECT doc_id, batch_id, string_agg(warning, ',' ORDER BY p) AS w FROM (SELECT doc_id, batch_id, warning, min(pos) AS p FROM st WHERE warning <> '' GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT doc_id, batch_id, count(*) AS blocks_count, count(*) FILTER (trim(translated_text) <> '') AS translated_blocks_count,
    CASE WHEN bool_or(status = 'needs_review') THEN 'needs_review' ELSE 'completed' END AS status FROM st GROUP BY ALL)
"""
)
GRID = r"""
tl AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE contains(text, ' | ')),
tu AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM tl),
tr0 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS row_index FROM tu WHERE contains(line, ' | ')),
tc AS (SELECT doc_id, row_index, string_split(line, ' | ') AS cs FROM tr0),
cells AS (SELECT doc_id, CAST(row_index AS INTEGER) AS row_index, CAST(unnest(range(len(cs))) AS INTEGER) AS column_index, unnest(cs) AS source_text FROM tc),
box AS (SELECT *, 72.0::DOUBLE + 60 * column_index AS x0, 72.0::DOUBLE + 60 * column_index + greatest(8.0, least(50.0, 5.0 * length(source_text)))::DOUBLE AS x1, 100.0::DOUBLE + 24 * row_index AS y0 FROM cells),
grid AS (SELECT r.doc_id, 1 AS table_no, r.row_index, c.column_index, coalesce(x.source_text, '') AS source_text, trim(coalesce(x.source_text, '')) = '' AS empty_cell
  FROM (SELECT DISTINCT doc_id, row_index FROM cells) r JOIN (SELECT DISTINCT doc_id, column_index FROM cells) c USING (doc_id) LEFT JOIN cells x ON x.doc_id = r.doc_id AND x.row_index = r.row_index AND x.column_index = c.column_index),
cols AS (SELECT doc_id, column_index, min(x0) AS x0, max(x1) AS x1, count(*) AS support, count(DISTINCT round_even(y0 / 8, 0)) AS vertical_repetition, (min(x0) + max(x1)) / 2 AS center FROM box GROUP BY ALL)
"""
#: Closed form of table regions for cells whose places follow from row and column: runs of neighbouring rows of equal width.
REGIONS = r""",
ck AS (SELECT doc_id, row_index, column_index, source_text FROM cells WHERE len(string_split(regexp_replace(trim(regexp_replace(source_text, '\s+', ' ', 'g')), '^$', ''), ' ')) <= 6 AND trim(regexp_replace(source_text, '\s+', ' ', 'g')) <> ''),
rw AS (SELECT doc_id, row_index, list(column_index ORDER BY column_index) AS cs FROM ck GROUP BY ALL HAVING count(*) >= 2),
rj AS (SELECT *, lag(row_index) OVER w AS pr, lag(cs) OVER w AS pcs FROM rw WINDOW w AS (PARTITION BY doc_id ORDER BY row_index)),
gr AS (SELECT doc_id, row_index, cs, sum(CASE WHEN pr = row_index - 1 AND len(pcs) = len(cs) AND len(list_filter(list_zip(pcs, cs), lambda z: z[1] = z[2])) >= greatest(2, len(cs) - 1) THEN 0 ELSE 1 END)
  OVER (PARTITION BY doc_id ORDER BY row_index) AS run FROM rj),
gk AS (SELECT g.doc_id, g.run, k.row_index, k.column_index, k.source_text FROM gr g JOIN ck k USING (doc_id, row_index)),
rk AS (SELECT doc_id, run, min(row_index) AS first_row, count(DISTINCT row_index) AS n_rows, count(DISTINCT column_index) AS n_columns, count(*) AS n_cells,
  1 - count(*) / (count(DISTINCT row_index) * count(DISTINCT column_index))::DOUBLE AS hole FROM gk GROUP BY ALL HAVING count(DISTINCT row_index) >= 2),
rg AS (SELECT *, round(0.25 + 0.22 * (1 - hole) + 0.23 + 0.3 * (1 - least(0.45, 0.8 * hole) - least(0.3, 0.5 * hole)), 3) AS confidence,
  round(greatest(0, least(1, 0.25 + 0.2 * (1 - hole) + 0.2 + 0.2 + 0.15 * greatest(0, 1 - least(0.3, 0.55 * hole) - least(0.25, 0.45 * hole)) - least(0.2, 0.35 * hole))), 3) AS quality FROM rk
  WHERE round(0.25 + 0.22 * (1 - hole) + 0.23 + 0.3 * (1 - least(0.45, 0.8 * hole) - least(0.3, 0.5 * hole)), 3) >= 0.6)
"""
EVENTS = "ev AS (SELECT user_id AS doc_id, event_id AS job_id, ts, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events)"
PLAIN = r"trim(regexp_replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"
OVERLAY = (
    SCORED + rf""",
ov AS (SELECT *, type IN {TYPES} AND trim(source_text) <> '' AND x1 - x0 >= 2 AS mask,
    type IN {TYPES} AND trim(translated_text) <> '' AND NOT list_contains(warnings, 'english_residual') AND tq >= 0.35 AND
      ((type = 'title' AND len(string_split(s, ' ')) <= 4 AND (size >= 12 OR false)) OR (cat NOT IN ('probable_fragment', 'semantic_noise') AND conf >= 0.45)) AS wr,
    round(greatest(x0 - 1.5, 0), 2) AS bx0, round(greatest(y0 - 1.5, 0), 2) AS by0, round(least(x1 + 1.5, 595), 2) AS bx1, round(least(y1 + 1.5, 842), 2) AS by1 FROM scored),
ops AS (SELECT doc_id, pos, size, 'mask' AS op, '' AS text, '' AS warning, bx0 AS x0, by0 AS y0, bx1 AS x1, by1 AS y1 FROM ov WHERE mask
  UNION ALL SELECT doc_id, pos, size, 'write', trim(translated_text), '', bx0, by0, bx1, by1 FROM ov WHERE wr
  UNION ALL SELECT doc_id, pos, size, 'fallback', CASE WHEN trim(translated_text) <> '' THEN trim(translated_text) ELSE '[review]' END,
    CASE WHEN trim(translated_text) <> '' THEN 'overlay_written_with_review' ELSE 'masked_without_translation' END, bx0, by0, bx1, by1 FROM ov WHERE mask AND NOT wr)
"""
)

ORACLE_SQL |= {
    "normalized_text": ONLY_BLOCKS + f"SELECT doc_id, pos, {NORM} AS normal, {edge('lower(' + NORM + ')')} AS noise, lower({NORM}) AS semantic FROM blocks",
    "word_counts": ONLY_BLOCKS + f"""SELECT doc_id, pos, {n_words('source_text')} AS words, len({ASCII.format('source_text')}) AS ascii_words,
        CAST(greatest(1, ceil(n / greatest(floor(120.0 / (size * 0.52)), 1))) AS BIGINT) AS lines FROM blocks""",
    "suspicious_fragments": STATED + "SELECT doc_id, pos, type FROM st WHERE " + STATE.split("WHEN\n  ")[1].split(" THEN 'suspicious_fragment'")[0],
    "decorative_noise": ONLY_BLOCKS + f"""SELECT doc_id, pos FROM (SELECT *, {NORM} AS s, {deco(NORM)} AS w FROM blocks) WHERE type = 'unknown' AND CASE WHEN s = '' THEN true WHEN len(w) = 0 THEN length(s) <= 3
        ELSE (len(w) <= 4 AND NOT regexp_matches(s, '[.!?;:]$') AND NOT regexp_matches(s, '\\d') AND len(list_filter(w, lambda x: length(x) > 6)) = 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.6 * len(w))
          OR (length(s) <= 2 AND NOT regexp_matches(s, '\\d')) END""".replace("\\\\", "\\"),
    "too_many_english": SCORED + f"""SELECT doc_id, pos FROM (SELECT *, regexp_extract_all(lower(translated_text), '[A-Za-z]+') AS w FROM scored)
        WHERE len(w) >= 6 AND len(list_filter(w, lambda x: x IN {words(L.COMMON_ENGLISH)})) >= 3 AND len(list_filter(w, lambda x: x IN {words(L.COMMON_ENGLISH)})) >= 0.25 * len(w)""",
    "translation_states": STATED + "SELECT doc_id, pos, status, warning FROM st",
    "candidate_dedup": ONLY_BLOCKS + f"""SELECT doc_id, pos, source_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, regexp_replace(regexp_replace(lower({NORM}), '\\bpage\\s+\\d+\\b', 'page <n>', 'g'), '\\b\\d+\\b', '<n>', 'g'),
        round_even(y0 / 3, 0) ORDER BY pos) AS rn FROM blocks) WHERE rn = 1 OR {NORM} = ''""".replace("\\\\", "\\"),
    "contained_fragments_anti": ONLY_BLOCKS + f""", nb AS (SELECT *, lower({NORM}) AS m, {WORD4} AS ws FROM blocks)
        SELECT doc_id, pos, source_text FROM nb a WHERE NOT (len(a.ws) BETWEEN 1 AND 3 AND length(a.m) <= 36 AND EXISTS (SELECT 1 FROM nb b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.pos <> a.pos
          AND contains(b.m, a.m) AND length(b.m) > length(a.m) + 5 AND greatest(b.y0 - a.y1, a.y0 - b.y1, 0) <= 12))""",
    "overlap_pairs": ONLY_BLOCKS + """, cp AS (SELECT *, 0 AS copy FROM blocks UNION ALL SELECT * REPLACE (x0 + 0.2 AS x0, y0 + 0.2 AS y0, x1 + 0.2 AS x1, y1 + 0.2 AS y1), 1 FROM blocks)
        SELECT a.doc_id, a.page_number, a.pos, a.copy, b.pos AS other_pos, b.copy AS other_copy FROM cp a JOIN cp b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND (a.pos, a.copy) < (b.pos, b.copy)
        WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0.95 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))""",
    "block_dedup": ONLY_BLOCKS + """, cp AS (SELECT *, 0 AS copy FROM blocks UNION ALL SELECT * REPLACE (x0 + 0.2 AS x0, y0 + 0.2 AS y0, x1 + 0.2 AS x1, y1 + 0.2 AS y1), 1 FROM blocks),
        pr AS (SELECT a.doc_id, b.pos, b.copy FROM cp a JOIN cp b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND a.type = b.type AND a.source_text = b.source_text AND (a.pos, a.copy) < (b.pos, b.copy)
        WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) > 0.95 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))
        SELECT doc_id, pos, copy FROM cp ANTI JOIN pr USING (doc_id, pos, copy)""",
    "contained_noise": ONLY_BLOCKS + f""", nb AS (SELECT *, lower({NORM}) AS m FROM blocks)
        SELECT doc_id, pos FROM nb a WHERE length(a.m) >= 4 AND EXISTS (SELECT 1 FROM nb b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.pos <> a.pos AND b.type IN ('paragraph', 'title') AND contains(b.m, a.m) AND length(b.m) > length(a.m) + 20 AND
          (greatest(b.y0 - a.y1, a.y0 - b.y1, 0) <= 8 OR coalesce(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / nullif(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 0), 0) > 0.2))""",
    "contained_in_section": "WITH " + BLOCKS + "," + SECTIONS + rf""", cs AS (SELECT *, lower({NORM}) AS m FROM sec), cw AS (SELECT *, {n_words('m')} AS w FROM cs)
        SELECT doc_id, pos FROM cw a WHERE a.m <> '' AND a.w <= 3 AND EXISTS (SELECT 1 FROM cw b WHERE b.doc_id = a.doc_id AND b.section_no = a.section_no AND b.pos <> a.pos AND b.w > a.w AND contains(b.m, a.m)
          AND len(list_filter(range(1, length(b.m) - length(a.m) + 2), lambda i: substr(b.m, i, length(a.m)) = a.m
            AND regexp_matches(substr(b.m, i - 1, 1) || ' ', '^[\p{{L}}\p{{N}}_]') <> regexp_matches(left(a.m, 1), '^[\p{{L}}\p{{N}}_]')
            AND regexp_matches(substr(b.m, i + length(a.m), 1) || ' ', '^[\p{{L}}\p{{N}}_]') <> regexp_matches(right(a.m, 1), '^[\p{{L}}\p{{N}}_]'))) > 0)""",
    "rebuilt_sections": "WITH " + BLOCKS + "," + SECTIONS + """, rn AS (SELECT doc_id, pos, printf('block_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y0, x0, pos)) AS block_id FROM blocks)
        SELECT doc_id, printf('section_%03d', section_no) AS section_id, section_title AS title, min(page_number) AS page_start, max(page_number) AS page_end, string_agg(block_id, ',' ORDER BY pos) AS block_ids
        FROM sec JOIN rn USING (doc_id, pos) GROUP BY doc_id, section_no, section_title""",
    "payload_warnings": STATED + "SELECT doc_id, string_agg(warning, ',' ORDER BY p) AS warnings FROM (SELECT doc_id, warning, min(pos) AS p FROM st WHERE warning <> '' GROUP BY ALL) GROUP BY 1",
    "mask_zones": OVERLAY + ", z AS (SELECT doc_id, (pos // 5) + 1 AS page_number, y0, y1 FROM ops WHERE op = 'mask') SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, count(*) AS n_zones, min(y0) AS top, max(y1) AS bottom FROM z GROUP BY ALL",
    "repeating_artifacts": ONLY_BLOCKS + """, pg AS (SELECT DISTINCT doc_id, page_number FROM blocks), n AS (SELECT doc_id, count(*) AS c FROM pg GROUP BY 1)
        SELECT doc_id, page_number, CASE WHEN c >= 2 THEN 'header' ELSE 'unknown' END AS type, CASE WHEN c >= 2 THEN 'repeating_header' END AS role, source AS source_text FROM pg JOIN n USING (doc_id) JOIN documents USING (doc_id)
        UNION ALL SELECT doc_id, page_number, CASE WHEN c >= 2 THEN 'footer' ELSE 'unknown' END, CASE WHEN c >= 2 THEN 'repeating_footer' END, 'Page ' || page_number FROM pg JOIN n USING (doc_id)""",
    "page_batches": STATED + "SELECT * FROM plan",
    "batch_range_join": STATED + "SELECT p.doc_id, p.batch_id, count(*) AS n, min(b.page_number) AS first_page, max(b.page_number) AS last_page FROM plan p JOIN blocks b ON b.doc_id = p.doc_id AND b.page_number BETWEEN p.page_start AND p.page_end GROUP BY ALL",
    "batch_status": STATED + "SELECT doc_id, batch_id, blocks_count, translated_blocks_count, status, coalesce(w, '') AS warnings FROM bs LEFT JOIN fw USING (doc_id, batch_id)",
    "batch_summary": STATED + "SELECT doc_id, count(*) AS total_batches, count(*) FILTER (status = 'completed') AS completed_batches, count(*) FILTER (status = 'failed') AS failed_batches FROM bs GROUP BY 1",
    "batch_progress": STATED + "SELECT doc_id, CAST(CASE WHEN count(*) FILTER (status = 'completed') = count(*) THEN 90 ELSE 20 + 60 * count(*) FILTER (status = 'completed') // count(*) END AS INTEGER) AS progress FROM bs GROUP BY 1",
    "resume_pending": STATED + "SELECT doc_id, batch_id, page_start, page_end FROM plan ANTI JOIN (SELECT * FROM bs WHERE status = 'completed') USING (doc_id, batch_id)",
    "merge_batches": ONLY_BLOCKS + """SELECT doc_id, pos, page_number, printf('block_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y0, x0, pos)) AS block_id,
        CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, pos) AS INTEGER) AS reading_order FROM blocks""",
    "job_latest_status": "WITH " + EVENTS + " SELECT doc_id, arg_max(status, (ts, job_id)) AS status, arg_max(job_id, (ts, job_id)) AS job_id, count(*) AS n_events FROM ev GROUP BY 1",
    "job_conflicts": "WITH " + EVENTS + """ SELECT doc_id, job_id, before, 'PROCESS_ALREADY_RUNNING' AS code FROM (SELECT *, lag(status) OVER (PARTITION BY doc_id ORDER BY ts, job_id) AS before FROM ev)
        WHERE status = 'queued' AND before IN ('queued', 'processing')""",
    "page_limits": ONLY_BLOCKS + "SELECT doc_id, max(page_number) AS page_count, CASE WHEN max(page_number) > 10 THEN 'TOO_MANY_PAGES' WHEN max(length(trim(source_text))) = 0 THEN 'NO_SELECTABLE_TEXT' ELSE '' END AS code FROM blocks GROUP BY 1",
    "translation_gates": STATED + f"""SELECT doc_id, count(*) FILTER (type IN {TYPES}) AS n, count(*) FILTER (type IN {TYPES} AND status = 'translated' AND trim(translated_text) <> '') AS done,
        CASE WHEN count(*) FILTER (type IN {TYPES} AND status = 'translated' AND trim(translated_text) <> '') = 0 THEN 'TRANSLATION_NOT_READY'
          WHEN count(*) FILTER (type IN {TYPES} AND trim(translated_text) = '' AND status <> 'needs_review') > 0.2 * count(*) FILTER (type IN {TYPES}) THEN 'TRANSLATION_INCOMPLETE' ELSE 'READY' END AS gate FROM st GROUP BY 1""",
    "overlay_ops": OVERLAY + "SELECT doc_id, pos, op, text, warning, x0, y0, x1, y1 FROM ops",
    "overlay_fit": OVERLAY + """SELECT doc_id, pos, op, CAST(coalesce(list_max(f), 7) AS INTEGER) AS font_size, len(f) = 0 AS overflow FROM (SELECT *, list_filter(range(7, CAST(trunc(greatest(least(size, 18), 7)) AS BIGINT) + 1),
        lambda z: (CASE WHEN x1 <= x0 THEN 999 ELSE greatest(1, ceil(CAST(length(text) AS DOUBLE) / greatest(floor((x1 - x0) / (z * 0.52)), 1))) END) * z * 1.2 <= y1 - y0) AS f FROM ops WHERE op <> 'mask')""",
    "table_regions": "WITH " + GRID + REGIONS + """SELECT doc_id, 1 AS page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS INTEGER) AS table_no, n_rows, n_columns, n_cells, confidence FROM rg""",
    "table_cells": "WITH " + GRID + REGIONS + """, tn AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS INTEGER) AS table_no FROM rg),
        gc AS (SELECT DISTINCT doc_id, run, column_index FROM gk), gl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY column_index) - 1 AS c FROM gc)
        SELECT t.doc_id, t.table_no, CAST(r.row_index - t.first_row AS INTEGER) AS row_index, CAST(l.c AS INTEGER) AS column_index, coalesce(k.source_text, '') AS source_text, k.source_text IS NULL AS empty_cell
        FROM tn t JOIN gr r ON r.doc_id = t.doc_id AND r.run = t.run JOIN gl l ON l.doc_id = t.doc_id AND l.run = t.run LEFT JOIN gk k ON k.doc_id = t.doc_id AND k.run = t.run AND k.row_index = r.row_index AND k.column_index = l.column_index""",
    "table_totals": "WITH " + GRID + REGIONS + """SELECT doc_id, CAST(count(*) AS BIGINT) AS tables, CAST(sum(n_cells) AS BIGINT) AS cells, CAST(sum(n_cells) AS BIGINT) AS open_cells, round(avg(quality), 3) AS table_score FROM rg GROUP BY 1""",
    "table_overlay": "WITH " + GRID + REGIONS + """, tn AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS INTEGER) AS table_no FROM rg),
        gc AS (SELECT DISTINCT doc_id, run, column_index FROM gk), gl AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, run ORDER BY column_index) - 1 AS INTEGER) AS c FROM gc)
        SELECT t.doc_id, t.table_no, CAST(k.row_index - t.first_row AS INTEGER) AS row_index, l.c AS column_index, CASE WHEN l.c % 2 = 0 THEN trim(k.source_text) ELSE '[review]' END AS text,
        CASE WHEN l.c % 2 = 0 THEN '' ELSE 'masked_without_translation' END AS warning FROM tn t JOIN gk k ON k.doc_id = t.doc_id AND k.run = t.run JOIN gl l ON l.doc_id = k.doc_id AND l.run = k.run AND l.column_index = k.column_index""",
    "table_rows": "WITH " + GRID + REGIONS + """, tn AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_row) AS INTEGER) AS table_no FROM rg), gc AS (SELECT DISTINCT doc_id, run, column_index FROM gk)
        SELECT t.doc_id, t.table_no, CAST(r.row_index - t.first_row AS INTEGER) AS row_index, string_agg(coalesce(k.source_text, ''), '|' ORDER BY c.column_index) AS texts
        FROM tn t JOIN gr r ON r.doc_id = t.doc_id AND r.run = t.run JOIN gc c ON c.doc_id = t.doc_id AND c.run = t.run
        LEFT JOIN gk k ON k.doc_id = t.doc_id AND k.run = t.run AND k.row_index = r.row_index AND k.column_index = c.column_index GROUP BY ALL""",
    "table_grid": "WITH " + GRID + "SELECT * FROM grid",
    "table_diagnostics": "WITH " + GRID + """SELECT doc_id, table_no, count(DISTINCT row_index) AS rows, count(DISTINCT column_index) AS columns, count(*) AS expected, count(*) FILTER (NOT empty_cell) AS mapped,
        coalesce(string_agg(row_index || ':' || column_index, ',' ORDER BY row_index, column_index) FILTER (empty_cell), '') AS missing FROM grid GROUP BY ALL""",
    "table_confidence": "WITH " + GRID + f""", wd AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, row_index, count(*) AS w FROM cells GROUP BY ALL) GROUP BY ALL),
        us AS (SELECT doc_id, max(k) AS usual, arg_max(w, (k, -w)) AS expected, min(w) AS narrowest, CAST(sum(k) AS BIGINT) AS n_rows FROM wd GROUP BY 1), gg AS (SELECT doc_id, count(*) AS n, count(*) FILTER (empty_cell) AS empty, count(DISTINCT column_index) AS n_columns FROM grid GROUP BY 1)
        SELECT doc_id, 1 AS table_no, n_rows, n_columns, CASE WHEN n_rows < 2 OR narrowest < 2 THEN 0.0 ELSE {clamp('0.25::DOUBLE * usual / n_rows + 0.22::DOUBLE * (1 - empty / n) + 0.23::DOUBLE * least(1.0, n_columns / expected) + 0.3::DOUBLE * (1 - least(0.45::DOUBLE, 0.8::DOUBLE * empty / n) - least(0.3::DOUBLE, 0.5::DOUBLE * empty / n))')} END AS confidence
        FROM gg JOIN us USING (doc_id)""",
    "column_boundaries": "WITH " + GRID + """SELECT doc_id, column_index, support, vertical_repetition, lb AS left_boundary, rb AS right_boundary, rb - lb AS logical_width FROM (SELECT *, CASE WHEN lag(x1) OVER w IS NULL THEN x0 - 4 ELSE greatest(lag(x1) OVER w + 2, least(x0 - 3, (lag(center) OVER w + center) / 2)) END AS lb,
        CASE WHEN lead(x0) OVER w IS NULL THEN x1 + 10 ELSE least(lead(x0) OVER w - 3, greatest(x1 + 3, (lead(center) OVER w + center) / 2)) END AS rb FROM cols WINDOW w AS (PARTITION BY doc_id ORDER BY x0, column_index))""",
    "web_blocks": f"""WITH p AS (SELECT page_id, list_concat(list_concat(list_concat([{{'type': 'header', 's': x}} FOR x IN regexp_extract_all(html, '(?s)<nav>(.*?)</nav>', 1)], [{{'type': 'title', 's': x}} FOR x IN regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)]), [{{'type': 'paragraph', 's': x}} FOR x IN regexp_extract_all(regexp_replace(regexp_replace(html, '<br[^>]*>', ' ', 'g'), '</?(?:a|b|i|u|em|strong|span|code|small|sub|sup)(?: [^>]*)?>', '', 'g'), '<p>([^<]*)', 1)]),
        list_concat([{{'type': 'list_item', 's': x}} FOR x IN regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)], [{{'type': 'footer', 's': x}} FOR x IN regexp_extract_all(html, '(?s)<footer>(.*?)</footer>', 1)])) AS b FROM pages)
        SELECT page_id, CAST(pos AS INTEGER) AS pos, b.type AS type, {PLAIN.format('b.s')} AS source_text FROM (SELECT page_id, unnest(range(len(b))) AS pos, unnest(b) AS b FROM p)""",
    "label_agreement": REPORT + "SELECT recommendation, quality, toxic, count(*) AS n FROM report JOIN labels USING (doc_id) GROUP BY ALL",
}

TITLE_CASE = "regexp_matches({}, '^[A-Z][.-]*[a-z][a-z.-]*$')"
BARE = r"regexp_replace({}, '[A-Za-z0-9_]*[^\x00-\x7F\x{{2000}}-\x{{206F}}¿¡«»°·][\p{{L}}\p{{N}}_]*', '0', 'g')"


def once(xs: str) -> str:
    """The list without repetitions, in the order of first occurrence."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


NAME_PATTERN = r"\b(?:[A-Z][A-Za-z0-9&.-]+)(?:\s+[A-Z][A-Za-z0-9&.-]+)*\b"
ORACLE_SQL |= {
    "repetition_keys": ONLY_BLOCKS + rf"SELECT doc_id, pos, regexp_replace(regexp_replace(lower({NORM}), '\bpage\s+\d+\b', 'page <n>', 'g'), '\b\d+\b', '<n>', 'g') AS key FROM blocks",
    "residual_detect": SCORED + rf"""SELECT doc_id, pos FROM (SELECT *, {tokens('translated_text')} AS z FROM scored) WHERE regexp_matches(lower(t), '\b({"|".join(L.RESIDUAL_PHRASES)})\b')
        OR len(list_filter(z, lambda x, i: lower({edge('x')}) IN {words(L.RESIDUAL_WORDS)} AND NOT (x IN {words(L.PROTECTED_ACRONYMS)} OR (upper(x) = x AND lower(x) <> x AND length(x) > 1)
          OR ({TITLE_CASE.format('x')} AND ((i > 1 AND {TITLE_CASE.format("coalesce(z[i - 1], '')")}) OR {TITLE_CASE.format("coalesce(z[i + 1], '')")}))))) > 0""",
    "noise_blocks": ONLY_BLOCKS + rf""", nz AS (SELECT *, {NORM} AS s, regexp_extract_all({NORM}, '[A-Za-z][A-Za-z-]*') AS w FROM blocks)
        SELECT doc_id, pos, type FROM nz WHERE CASE WHEN type IN ('image', 'header', 'footer', 'noise', 'list_item', 'caption', 'footnote') THEN false
          WHEN type = 'title' AND ((size >= 14 AND length(s) >= 4) OR (len(w) BETWEEN 1 AND 5 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.8 * len(w) AND length(s) >= 8)) THEN false
          WHEN s = '' OR {edge('lower(s)')} IN {words(L.NOISE_PHRASES)} THEN true
          WHEN {edge('lower(s)')} IN {words(L.SHORT_TERMS)} OR (len(w) >= 1 AND len(list_filter(w, lambda x: lower(x) NOT IN {words(L.SHORT_TERMS)})) = 0) OR (len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z][a-z]+$'))) = 0) THEN false
          ELSE len(w) BETWEEN 1 AND 3 AND NOT regexp_matches(s, '[.!?:;]') AND NOT regexp_matches({BARE.format('s')}, '(?i)\b({L.VERBS})\b') AND NOT regexp_matches({BARE.format('s')}, '\b[A-Za-z]+(?:{L.VERB_ENDINGS})\b') END""",
    "acronym_pairs": ONLY_BLOCKS + rf""", nx AS (SELECT doc_id, pos, {norm('source_text')} AS a, {norm('lead(source_text) OVER (PARTITION BY doc_id ORDER BY pos)')} AS b FROM blocks),
        ini AS (SELECT *, array_to_string([upper(left(w, 1)) FOR w IN string_split(a, ' ')], '') AS ai, array_to_string([upper(left(w, 1)) FOR w IN string_split(b, ' ')], '') AS bi FROM nx)
        SELECT doc_id, pos, CASE WHEN regexp_matches(a, '^[A-Z]{{2,}}$') THEN b || ' (' || a || ')' ELSE a || ' (' || b || ')' END AS text FROM ini
        WHERE (regexp_matches(a, '^[A-Z]{{2,}}$') AND len(string_split(b, ' ')) >= 2 AND starts_with(bi, a)) OR (regexp_matches(b, '^[A-Z]{{2,}}$') AND len(string_split(a, ' ')) >= 2 AND starts_with(ai, b))""",
    "marked_noise": ONLY_BLOCKS + rf""", nb AS (SELECT *, lower({NORM}) AS m, {NORM} AS s, regexp_extract_all({NORM}, '[A-Za-z][A-Za-z-]*') AS w FROM blocks),
        ct AS (SELECT doc_id, pos FROM nb a WHERE length(a.m) >= 4 AND EXISTS (SELECT 1 FROM nb b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.pos <> a.pos AND b.type IN ('paragraph', 'title') AND contains(b.m, a.m) AND length(b.m) > length(a.m) + 20 AND
          (greatest(b.y0 - a.y1, a.y0 - b.y1, 0) <= 8 OR coalesce(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / nullif(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 0), 0) > 0.2))),
        mn AS (SELECT nb.*, ct.pos IS NOT NULL AS inside FROM nb LEFT JOIN ct USING (doc_id, pos))
        SELECT doc_id, pos, 'needs_review' AS status, 'noise' AS role, 'noise_block' AS warnings FROM mn WHERE CASE WHEN type IN ('image', 'header', 'footer', 'noise', 'list_item', 'caption', 'footnote') THEN false
          WHEN type = 'title' AND ((size >= 14 AND length(s) >= 4) OR (len(w) BETWEEN 1 AND 5 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 0.8 * len(w) AND length(s) >= 8)) THEN false
          WHEN s = '' OR {edge('lower(s)')} IN {words(L.NOISE_PHRASES)} THEN true
          WHEN {edge('lower(s)')} IN {words(L.SHORT_TERMS)} OR (len(w) >= 1 AND len(list_filter(w, lambda x: lower(x) NOT IN {words(L.SHORT_TERMS)})) = 0) OR (len(w) BETWEEN 1 AND 3 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '^[A-Z][a-z]+$'))) = 0) THEN false
          ELSE inside OR (len(w) BETWEEN 1 AND 3 AND NOT regexp_matches(s, '[.!?:;]') AND NOT regexp_matches({BARE.format('s')}, '(?i)\b({L.VERBS})\b') AND NOT regexp_matches({BARE.format('s')}, '\b[A-Za-z]+(?:{L.VERB_ENDINGS})\b')) END""",
    "protected_tokens": ONLY_BLOCKS + rf""", pt AS (SELECT doc_id, pos, list_concat(list_concat(regexp_extract_all(source_text, 'https?://[^\s)]+'), regexp_extract_all(source_text, '\[[0-9A-Za-z]+\]')),
        list_concat(regexp_extract_all(source_text, '\([0-9]+\)'), regexp_extract_all({BARE.format('source_text')}, '\b[A-Z]{{2,}}\b'))) AS z FROM blocks)
        SELECT doc_id, pos, array_to_string({once('z')}, ' ') AS tokens FROM pt WHERE len(z) > 0""",
    "summaries": rf"""SELECT doc_id, CASE WHEN length(s) <= 360 THEN s ELSE regexp_replace(left(s, 360), ' [^ ]*$', '') || '...' END AS summary,
        CASE WHEN regexp_matches(lower(text), 'agreement|liability|clause') THEN 'juridique, precis et professionnel' WHEN regexp_matches(lower(text), 'api|system|configuration') THEN 'technique, clair et factuel'
          WHEN regexp_matches(lower(text), 'abstract|methodology|results') THEN 'academique et formel' ELSE 'professionnel, naturel et clair' END AS tone,
        'lecteurs professionnels francophones' AS audience FROM (SELECT *, {norm('text')} AS s FROM documents)""",
    "proper_nouns": rf"""SELECT doc_id, array_to_string({once('z')}[1:20], '; ') AS names FROM (SELECT doc_id, list_filter(regexp_extract_all({BARE.format('text').replace("'0'", "'_'")}, '{NAME_PATTERN}'),
        lambda x: x NOT IN ('The', 'This', 'These', 'A', 'An', 'In', 'On', 'For', 'Section', 'Article')) AS z FROM documents)""",
    "document_ops": SCORED + r""", dop AS (SELECT *, CASE type WHEN 'title' THEN 'heading' WHEN 'header' THEN 'discreet' WHEN 'footer' THEN 'discreet' WHEN 'list_item' THEN 'bullet' WHEN 'footnote' THEN 'footnote'
          WHEN 'paragraph' THEN 'paragraph' WHEN 'unknown' THEN 'paragraph' END AS op, coalesce(nullif(trim(translated_text), ''), trim(source_text)) AS tx FROM scored),
        dot AS (SELECT *, CASE WHEN type = 'list_item' THEN regexp_replace(tx, '^\s*([-*•‣▪]|\d+[.)]|[A-Za-z][.)])\s+', '') ELSE tx END AS text FROM dop WHERE op IS NOT NULL)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS seq, op, text, CASE WHEN op = 'heading' THEN CASE WHEN size >= 18 THEN 1 ELSE 2 END ELSE 0 END AS level FROM dot WHERE text <> ''""",
}
