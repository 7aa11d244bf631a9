"""The registered queries in DuckDB SQL, written from the definitions, not from the columns."""

from __future__ import annotations

from leafmark.functions.vocabulary import common_words
from leafmark.plans import inputs as I

WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
GARBAGE = r"[\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]"
MARKS = ".,;:!?\"'()-"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
#: The vocabulary is the only value that is taken from the code; tests pin its digest.
COMMON = ", ".join(map(_q, sorted(common_words())))
#: Code points and what becomes of them, written here once more.
SEVERAL = (
    (0xE000, "fi"), (0xE001, "fl"), (0xE002, "ff"), (0xE003, "ffi"), (0xE004, "ffl"), (0xE005, "ft"), (0xE006, "st"), (0xE007, "ct"), (0xE062, "Th"), (0xE0BB, "Th"), (0xE09D, "ft"), (0xE117, "ft"),
    (0xFB00, "ff"), (0xFB01, "fi"), (0xFB02, "fl"), (0xFB03, "ffi"), (0xFB04, "ffl"), (0xFB05, "st"), (0xFB06, "st"), (0x2026, "..."), (0x85, "..."),
)
ONE = ((0xA0, 32), (0x2028, 10), (0xF0B7, 0x2022), (0xF0A7, 0x2022), (0xF0D8, 0x2022), (0xF020, 32), (0x2018, 39), (0x2019, 39), (0x201C, 34), (0x201D, 34), (0x2013, 45), (0x91, 39), (0x92, 39), (0x93, 34), (0x94, 34), (0x96, 45), (0x97, 0x2014))


def norm(x: str) -> str:
    x = f"replace(replace(replace(coalesce({x}, ''), chr({0x2029}), chr(10) || chr(10)), chr({0xAD}), ''), chr({0xFEFF}), '')"
    for code, meant in SEVERAL:
        x = f"replace({x}, chr({code}), '{meant}')"
    for code, meant in ONE:
        x = f"replace({x}, chr({code}), chr({meant}))"
    return rf"regexp_replace({x}, '\(cid:[0-9]+\)', '', 'g')"


def no_garbage(x: str) -> str:
    return f"regexp_replace({x}, '{GARBAGE}', '', 'g')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def correct(x: str) -> str:
    """By the rule itself: the first confusion whose replacement in the bare word gives a common one."""
    clean = f"trim(lower(w), {_q(MARKS)})"
    tried = ", ".join(f"replace(c, '{a}', '{b}')" for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l")))
    meant = f"CASE WHEN c IN ({COMMON}) THEN NULL ELSE list_filter([{tried}], lambda f: f <> c AND f IN ({COMMON}))[1] END"
    cased = "CASE WHEN w = upper(w) AND w <> lower(w) THEN upper(m) WHEN w[1] = upper(w[1]) AND w[1] <> lower(w[1]) THEN upper(m[1]) || substr(m, 2) ELSE m END || substr(w, length(c) + 1)"
    fixed = f"list_transform([{clean}], lambda c: list_transform([{meant}], lambda m: CASE WHEN m IS NULL THEN w ELSE {cased} END)[1])[1]"
    return rf"array_to_string(list_transform(regexp_extract_all({x}, '[{WS}]+|[^{WS}]+'), lambda w: CASE WHEN regexp_matches(w, '^\p{{L}}') AND regexp_matches(lower(w), 'rn|cl|vv|0|1') THEN {fixed} ELSE w END), '')"


def quality(name: str, rel: str, x: str, p: str = "") -> str:
    """Expressions that end in `name`: rel with columns {p}score to {p}reason."""
    return f"""{name}_t AS (SELECT *, coalesce({x}, '') AS _x, {words(f"coalesce({x}, '')")} AS _tok FROM {rel}),
{name}_a AS (SELECT *, list_filter(list_transform(_tok, lambda t: lower(regexp_replace(t, '[^a-zA-Z]', '', 'g'))), lambda t: t <> '') AS _al FROM {name}_t),
{name}_m AS (SELECT *, len(_tok) AS _n, len(_al) AS _m, CASE WHEN len(_al) > 0 THEN len(list_filter(_al, lambda t: t IN ({COMMON})))::DOUBLE / len(_al) END AS _r,
  (length(_x) - length({no_garbage('_x')}))::DOUBLE / greatest(length(_x), 1) AS _g, CASE WHEN len(_al) > 0 THEN length(array_to_string(_al, ''))::DOUBLE / len(_al) END AS _l FROM {name}_a),
{name}_s AS (SELECT *, 60 * _r + 20 * (CASE WHEN _l < 2.5::DOUBLE OR _l > 9 THEN 0.3::DOUBLE WHEN _l < 3 OR _l > 7 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) - 100 * _g + least(20.0::DOUBLE, 5 * (_n::DOUBLE / 50)) AS _s FROM {name}_m),
{name} AS (SELECT * EXCLUDE (_x, _tok, _al, _n, _m, _r, _g, _l, _s),
  CASE WHEN _m = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN _r < 0.15::DOUBLE AND _l < 3 AND _n > 30 THEN _s * 0.1::DOUBLE ELSE _s END)) END AS {p}score,
  _n::INT AS {p}word_count, coalesce(_r, 0.0::DOUBLE) AS {p}common_word_ratio, CASE WHEN _m = 0 THEN 1.0::DOUBLE ELSE _g END AS {p}garbage_ratio, coalesce(_l, 0.0::DOUBLE) AS {p}avg_word_length,
  CASE WHEN _n = 0 THEN 'empty' WHEN _m = 0 THEN 'no alpha tokens' ELSE '' END AS {p}reason FROM {name}_s)"""


def grade(x: str) -> str:
    return f"CASE WHEN {x} >= 60 THEN '✅ GOOD' WHEN {x} >= 40 THEN '⚠️ REVIEW' ELSE '❌ POOR' END"


def whole(x: str) -> str:
    return f"round_even({x}, 0)::BIGINT::VARCHAR"


SCORED = quality("scored", "documents", "text")
DIRTY = f"{I.DIRTY_SQL}, pages_n AS (SELECT doc, page_num, doc_id, {norm('text_raw')} AS text FROM dirty)"


def running(rel: str) -> str:
    """running(doc, line, n_pages) over rel(doc, page_num, text)."""
    return f"""line AS (SELECT DISTINCT doc, page_num, {strip('x')} AS line FROM (SELECT doc, page_num, unnest(string_split(text, chr(10))) AS x FROM {rel})),
size AS (SELECT doc, count(*) AS n FROM {rel} GROUP BY doc),
running AS (SELECT doc, line, count(*) AS n_pages FROM line JOIN size USING (doc) WHERE length(line) BETWEEN 3 AND 80 AND n >= 20 GROUP BY doc, line, n HAVING count(*) >= greatest(5, n // 5)),
lists AS (SELECT doc, list(line) AS lines FROM running GROUP BY doc)"""


def dropped(x: str) -> str:
    return rf"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT (coalesce(list_contains(lines, {strip('l')}), false) OR regexp_matches({strip('l')}, '\A[0-9]{{1,4}}\z'))), chr(10))"


TEXT_SCORED = f"{I.CANDIDATES_SQL}, base AS (SELECT *, {norm('text_raw')} AS text_norm, CASE WHEN ocr_error IS NULL THEN {norm('ocr_raw')} ELSE '' END AS ocr_norm FROM candidates), {quality('ts', 'base', 'text_norm', 't_')}"
JUDGED = f"""{TEXT_SCORED}, {quality('os0', 'ts', 'ocr_norm', 'o_')},
os AS (SELECT * REPLACE (CASE WHEN ocr_error IS NOT NULL THEN 'ocr exception: ' || string_split(ocr_error, ':')[1] ELSE o_reason END AS o_reason) FROM os0),
br AS (SELECT *, CASE WHEN NOT t_score < 45 THEN 'gate' WHEN t_common_word_ratio < 0.10::DOUBLE AND o_common_word_ratio > 0.30::DOUBLE AND {strip('ocr_norm')} <> '' THEN 'broken_text'
  WHEN o_score > t_score + 5 THEN 'margin' WHEN t_score > 0 THEN 'text' WHEN o_score > 0 THEN 'ocr' ELSE 'none' END AS branch FROM os),
judged AS (SELECT doc, page_num, branch, CASE WHEN branch IN ('broken_text', 'margin', 'ocr') THEN 'ocr' WHEN branch = 'none' THEN 'none' ELSE 'text' END AS method,
  CASE WHEN branch IN ('broken_text', 'margin', 'ocr') THEN ocr_norm WHEN branch = 'none' THEN '' ELSE text_norm END AS text,
  CASE WHEN branch IN ('broken_text', 'margin', 'ocr') THEN o_score ELSE t_score END AS score,
  CASE WHEN branch IN ('broken_text', 'margin', 'ocr') THEN o_reason ELSE t_reason END AS reason,
  CASE WHEN t_score < 45 THEN ocr_error END AS ocr_error FROM br)"""
CHUNKS = f"""{JUDGED}, {running('judged')},
cleaned AS (SELECT judged.*, CASE WHEN method <> 'none' AND NOT score < 15 THEN {collapse(no_garbage(correct(dropped('text'))))} END AS clean FROM judged LEFT JOIN lists USING (doc)),
chunks AS (SELECT doc, page_num, method, score, ocr_error, CASE WHEN clean IS NULL THEN 'skipped' WHEN clean = '' THEN 'empty' ELSE 'extracted' END AS status,
  CASE WHEN clean IS NULL THEN '<!-- Page ' || page_num || ': skipped (' || CASE reason WHEN '' THEN 'low quality' ELSE reason END || ') -->'
       WHEN clean <> '' THEN '<!-- Page ' || page_num || ' (' || method || ', score=' || {whole('score')} || ') -->' || chr(10) || clean END AS chunk FROM cleaned)"""
DOCS = f"""{CHUNKS}, sums AS (SELECT doc, count(*) FILTER (status = 'extracted') AS pages_extracted, count(*) FILTER (status <> 'extracted') AS pages_skipped,
  count(*) FILTER (status = 'extracted' AND method = 'text') AS pages_via_text, count(*) FILTER (status = 'extracted' AND method = 'ocr') AS pages_via_ocr,
  coalesce(sum(CASE WHEN instr(substr(chunk, 1, 80), 'skipped') = 0 THEN len({words('chunk')}) ELSE 0 END), 0)::BIGINT AS word_count,
  list(score ORDER BY page_num) FILTER (status = 'extracted') AS scores, coalesce(string_agg(chunk, chr(10) || chr(10) ORDER BY page_num), '') AS markdown,
  coalesce(list('p' || page_num || ': ' || ocr_error ORDER BY page_num) FILTER (ocr_error <> ''), []) AS ocr_errors FROM chunks GROUP BY doc),
avgs AS (SELECT * EXCLUDE (scores), coalesce(list_reduce(list_prepend(0.0::DOUBLE, scores), lambda a, b: a + b) / len(scores), 0.0::DOUBLE) AS avg_score FROM sums),
docs AS (SELECT *, list_filter([CASE WHEN avg_score < 40 AND pages_extracted > 0 THEN 'Average page quality score ' || {whole('avg_score')} || '/100 — review output' END,
    CASE WHEN pages_skipped > pages_extracted THEN 'More pages skipped (' || pages_skipped || ') than extracted (' || pages_extracted || ')' END], lambda x: x IS NOT NULL) AS warnings,
  CASE WHEN len(ocr_errors) > 0 THEN 'OCR failed on ' || len(ocr_errors) || ' pages (' || coalesce(string_split(ocr_errors[1], ': ')[2], 'error') || ') — text layer used as fallback.'
    WHEN pages_extracted = 0 THEN 'No pages extracted — source may be empty, encrypted, or unreadable.' WHEN avg_score < 40 THEN 'Low-quality source — review recommended.'
    WHEN pages_via_ocr = 0 AND avg_score >= 60 THEN 'Clean embedded text — no OCR needed.' WHEN pages_via_text = 0 AND avg_score >= 60 THEN 'Scanned source — OCR used on every page.'
    WHEN pages_via_ocr > pages_via_text * 2 AND pages_via_ocr > 0 THEN 'Broken text layer — recovered via OCR on ' || pages_via_ocr || ' pages.'
    ELSE 'Mixed: ' || {whole('100 * pages_via_text::DOUBLE / (pages_via_text + pages_via_ocr)')} || '% text, ' || {whole('100 * pages_via_ocr::DOUBLE / (pages_via_text + pages_via_ocr)')} || '% OCR.' END AS reason FROM avgs)"""


def slug(x: str) -> str:
    s = rf"regexp_replace(lower(regexp_replace({x}, '(.)\.[^.]+\z', '\1')), '[^a-z0-9\-{WS}]', '', 'g')"
    return f"regexp_replace(regexp_replace({strip(s)}, '[{WS}]+', '-', 'g'), '-+', '-', 'g') || '.md'"


def package_slug(x: str) -> str:
    s = rf"regexp_replace({strip(f'lower({x})')}, '[^\p{{L}}\p{{N}}_\-{WS}]', '', 'g')"
    s = rf"regexp_replace(regexp_replace(regexp_replace({s}, '[{WS}_]+', '-', 'g'), '-+', '-', 'g'), '\A-+|-+\z', '', 'g')"
    return f"coalesce(nullif({s}, ''), 'skill')"


FILES = f"{DOCS}, results AS (SELECT doc || '.pdf' AS file, *, pages_extracted > 0 AS found FROM docs)"
HTML = rf"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g'), '&quot;?', '"', 'g')"""
for _n, _c in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    HTML = f"regexp_replace({HTML}, '&{_n};?', '{_c}', 'g')"
HTML = f"array_to_string(list_filter(list_transform(string_split({HTML}, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"
CHAPTERS = f"""{I.CHAPTERS_SQL}, items AS (SELECT doc, chapter_num, {norm('t')} AS text FROM (SELECT doc, chapter_num, {HTML} AS t FROM html_chapters)),
chap AS (SELECT doc, chapter_num, CASE WHEN len({words('text')}) >= 10 THEN '<!-- Chapter ' || chapter_num || ' -->' || chr(10) || {strip('text')} END AS chunk FROM items)"""
ETA = "CASE WHEN x IS NULL OR isnan(x) OR x < 0 THEN '…' WHEN x < 60 THEN trunc(x)::BIGINT || 's' WHEN x < 3600 THEN (trunc(x)::BIGINT // 60) || 'm ' || (trunc(x)::BIGINT % 60) || 's' ELSE (trunc(x)::BIGINT // 3600) || 'h ' || (trunc(x)::BIGINT % 3600 // 60) || 'm' END"
_TARGETS = "('claude-skill', 'skill-', 'references'), ('chatgpt-gpt', 'gpt-', 'knowledge'), ('cursor-rules', 'cursor-', 'docs'), ('gemini-cli', 'gemini-', 'references')"

SQL = {
    "quality_score": f"WITH {SCORED} SELECT doc_id, score, word_count, common_word_ratio, garbage_ratio, avg_word_length, reason FROM scored",
    "quality_grade_summary": f"WITH {SCORED} SELECT {grade('score')} AS grade, count(*) AS n_docs, sum(word_count)::BIGINT AS words, min(score) AS least, max(score) AS most FROM scored GROUP BY 1",
    "normalize_encoding": f"WITH {I.DIRTY_SQL} SELECT doc_id, md5({norm('text_raw')}) AS digest, length({norm('text_raw')}) AS n FROM dirty",
    "garbage_strip": f"WITH {I.DIRTY_SQL} SELECT doc_id, md5({no_garbage('text_raw')}) AS digest, length(text_raw) - length({no_garbage('text_raw')}) AS n_garbage FROM dirty",
    "ocr_correct": f"WITH {I.DIRTY_SQL} SELECT doc_id, md5({correct('text_raw')}) AS digest, {correct('text_raw')} <> text_raw AS changed FROM dirty",
    "boilerplate_lines": f"WITH {DIRTY}, {running('pages_n')} SELECT doc, line, n_pages FROM running",
    "strip_boilerplate": f"WITH {DIRTY}, {running('pages_n')} SELECT doc_id, md5({collapse(dropped('text'))}) AS digest FROM pages_n LEFT JOIN lists USING (doc)",
    "ocr_gate": f"WITH {quality('g', 'documents', norm('text'))} SELECT doc_id, score < 45 AS run_ocr FROM g",
    "page_arbitration": f"WITH {JUDGED} SELECT doc, page_num, branch, method, score, reason, ocr_error, md5(text) AS digest FROM judged",
    "page_chunks": f"WITH {CHUNKS} SELECT doc, page_num, status, chunk FROM chunks",
    "document_assembly": f"WITH {DOCS} SELECT doc, md5(markdown) AS digest, length(markdown) AS n_chars FROM docs",
    "document_stats": f"WITH {DOCS} SELECT doc, pages_extracted, pages_skipped, pages_via_text, pages_via_ocr, word_count, avg_score, array_to_string(warnings, '; ') AS warnings FROM docs",
    "document_reason": f"WITH {DOCS} SELECT doc, reason, {grade('avg_score')} AS grade, CASE WHEN pages_extracted = 0 THEN '❌ FAILED' ELSE {grade('avg_score')} END AS live_grade FROM docs",
    "markdown_documents": f"""WITH {FILES} SELECT file, {slug('file')} AS slug, md5('# ' || doc || chr(10) || chr(10) || '> Source: `' || file || '`' || chr(10) || '> Pages extracted: ' || pages_extracted || ' (text: ' || pages_via_text || ', OCR: ' || pages_via_ocr
      || ') | Pages skipped: ' || pages_skipped || chr(10) || '> Words: ' || format('{{:,}}', word_count) || ' | Avg page quality score: ' || {whole('avg_score')} || '/100' || chr(10) || '> Note: ' || reason
      || CASE WHEN len(warnings) > 0 THEN chr(10) || '> Warnings: ' || array_to_string(warnings, '; ') ELSE '' END || CASE WHEN len(ocr_errors) > 0 THEN chr(10) || '> OCR exceptions: ' || len(ocr_errors) || ' pages' ELSE '' END
      || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown) AS digest FROM results WHERE found""",
    "qc_report_rows": f"""WITH {FILES}, numbered AS (SELECT *, row_number() OVER (ORDER BY file) AS n FROM results)
      SELECT n::INT AS n, '| ' || n || ' | ' || substr(file, 1, 40) || CASE WHEN found THEN ' | ' || pages_extracted || ' | ' || pages_via_text || ' | ' || pages_via_ocr || ' | ' || pages_skipped || ' | ' || format('{{:,}}', word_count) || ' | ' || {whole('avg_score')}
        || ' | ' || {grade('avg_score')} || ' | ' || array_to_string(list_concat(warnings, [reason], CASE WHEN len(ocr_errors) > 0 THEN [len(ocr_errors) || ' OCR errors'] ELSE [] END), '; ') ELSE ' | 0 | 0 | 0 | 0 | 0 | 0 | ❌ POOR | —' END || ' |' AS row FROM numbered""",
    "ocr_error_appendix": f"""WITH {FILES}, l AS (SELECT file, list_concat(list_transform(ocr_errors[1:50], lambda x: '- ' || x), CASE WHEN len(ocr_errors) > 50 THEN ['- … and ' || (len(ocr_errors) - 50) || ' more'] ELSE [] END) AS lines FROM results WHERE found AND len(ocr_errors) > 0)
      SELECT file, (generate_subscripts(lines, 1) - 1)::INT AS pos, unnest(lines) AS line FROM l""",
    "run_summary": f"WITH {FILES} SELECT count(*) FILTER (found AND avg_score >= 60) AS good, count(*) FILTER (found AND avg_score >= 40 AND avg_score < 60) AS review, count(*) FILTER (NOT found OR avg_score < 40) AS poor, sum(CASE WHEN found THEN word_count ELSE 0 END)::BIGINT AS words FROM results",
    "html_to_text": f"SELECT page_id, {HTML} AS text FROM pages",
    "html_to_text_native": f"SELECT page_id, {HTML} AS text FROM pages",
    "chapter_assembly": f"""WITH {CHAPTERS} SELECT doc, count(chunk) AS pages_extracted, count(*) - count(chunk) AS pages_skipped, coalesce(sum(len({words('chunk')})), 0)::BIGINT AS word_count, md5(coalesce(string_agg(chunk, chr(10) || chr(10) ORDER BY chapter_num), '')) AS digest,
      CASE WHEN count(chunk) > 0 THEN 'EPUB — ' || count(chunk) || ' chapters extracted via HTML parsing.' ELSE 'EPUB had no extractable chapters.' END AS reason FROM chap GROUP BY doc""",
    "slugify_names": f"SELECT p_partkey, {slug('''p_name || ' (' || p_brand || ') [x].pdf' ''')} AS slug FROM part",
    "slugify_packages": f"SELECT page_id, {package_slug('''' __' || url || '! ' ''')} AS slug FROM pages",
    "dedupe_sources": "WITH i AS (SELECT doc_id % 7 AS source_ord, doc_id AS child, source || CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.EPUB' ELSE '.txt' END AS path FROM documents) SELECT path, source_ord, child FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source_ord, child) AS k FROM i WHERE regexp_matches(path, '(?i)\\.(pdf|epub)$')) WHERE k = 1",
    "skip_existing": f"WITH f AS (SELECT p_name || ' ' || p_partkey || '.pdf' AS file, p_size * 40 AS size FROM part), d AS (SELECT DISTINCT {slug('file')} AS slug FROM f WHERE size > 1000) SELECT file FROM f WHERE {slug('file')} NOT IN (SELECT slug FROM d)",
    "eta_ema": f"""WITH RECURSIVE {I.TICKS_SQL}, r AS (SELECT file, tick, total, CASE WHEN tick > 1 THEN tick / elapsed END AS rate FROM ticks),
      f AS (SELECT file, tick, total, rate AS s FROM r WHERE tick = 2 UNION ALL SELECT r.file, r.tick, r.total, 0.25::DOUBLE * r.rate + 0.75::DOUBLE * f.s FROM f JOIN r ON r.file = f.file AND r.tick = f.tick + 1),
      e AS (SELECT file, tick, s, CASE WHEN s > 0 THEN (total - tick) / s END AS x FROM f UNION ALL SELECT file, tick, NULL, NULL FROM r WHERE tick = 1)
      SELECT file, tick, round(s, 6) AS smoothed, round(x, 4) AS eta, {ETA} AS eta_text FROM e""",
    "export_prompts": f"""WITH t(target, prefix, sub) AS (VALUES {_TARGETS}), f AS (SELECT DISTINCT source || '.md' AS file FROM documents)
      SELECT target, prefix || 'my-corpus' AS package, md5(string_agg('- `out/' || prefix || 'my-corpus/' || sub || '/' || file || '`', chr(10) ORDER BY file)) AS digest, true AS filled FROM f, t GROUP BY target, prefix""",
    "qc_report_of_failures": """WITH f AS (SELECT p_name || ' ' || p_partkey || '.pdf' AS file, p_partkey % 2 = 1 AS odd, p_name FROM part)
      SELECT row_number() OVER (ORDER BY file)::INT AS n, '| ' || row_number() OVER (ORDER BY file) || ' | ' || substr(file, 1, 40) || ' | ' ||
        CASE WHEN odd THEN '0 | 0 | 0 | 0 | 0 | 0 | ❌ FAILED | ' || substr('Failed to open PDF: ' || p_name || '; no such page', 1, 60) ELSE '— | — | — | — | — | — | ⏭ exists | skipped' END || ' |' AS row FROM f""",
    "progress_percent": f"WITH {I.TICKS_SQL} SELECT file, tick, trunc(100 * tick::DOUBLE / total)::INT AS overall, trunc(1000 * tick::DOUBLE / total)::INT AS permille FROM ticks",
    "export_manifest": f"WITH t(target, prefix, sub) AS (VALUES {_TARGETS}), f AS (SELECT DISTINCT source || '.md' AS file FROM documents) SELECT target, prefix || 'my-corpus' AS package, file, 'out/' || prefix || 'my-corpus/' || sub || '/' || file AS path FROM f, t",
}
