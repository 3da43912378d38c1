"""SQL (DuckDB) that states what queries must return. White space and word ends are spelt out, as RE2 knows neither look-ahead nor Unicode classes."""

from __future__ import annotations

from lineweave.functions.paths import COMPRESSED, NON_CODE
from lineweave.functions.ranks import COMMENT_DENSITY, COMPLEXITY, FILES_IN_FOLDER, NESTING, ROUTINE_SIZE
from lineweave.plans import oracle_scan

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

_S = r"[\s\p{Z}]"

ORACLES: dict[str, str] = {}


def _rank(value: str, table: tuple) -> str:
    cases = " ".join(f"WHEN {value} <= {bound} THEN '{label}'" for bound, label in table[:-1])
    return f"CASE WHEN {value} IS NULL THEN '' {cases} ELSE '{table[-1][1]}' END"


_DOC_LINES = """
d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i, len(a) AS n FROM d),
lines AS (SELECT doc_id, i, x FROM e WHERE NOT (i = n AND x = ''))"""

_OPEN = r"(/\*|--\[\[|=(begin|head)|#\||\{-|<!--|<%--)"
_CLOSE = r"(\*/|\]\]|=(cut|end)|\|#|-\}|-->|--%>)"

_NBNC = f"""
WITH {_DOC_LINES},
c AS (SELECT doc_id, i, replace(left(x, 255), chr(0), '') AS c FROM lines),
k AS (SELECT *, regexp_replace(regexp_replace(c, '"[^"]+"|''[^'']+''', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS s FROM c WHERE NOT regexp_matches(c, '^{_WS}*$')),
f AS (SELECT *,
        regexp_matches(s, '(?i)^(//|;|rem|!|%)') OR (starts_with(s, '#') AND NOT regexp_matches(s, '(?i)^#(\\||def|inc|if|else|region)'))
          OR (starts_with(s, '--') AND NOT starts_with(s, '--[')) OR (starts_with(s, '''') AND NOT regexp_matches(s, '^''[^'']+''')) AS single,
        regexp_matches(s, '(?i){_OPEN}') AS opens, regexp_matches(s, '(?i){_OPEN}.*{_CLOSE}') AS again, regexp_matches(s, '(?i){_CLOSE}') AS closes,
        regexp_matches(c, '^(?:{_WS}|[\\\\+.,;=\\-/*''`"#!%{{}}()\\[\\]<>|])*$') AS blank
      FROM k),
o AS (SELECT *, (NOT single AND opens AND NOT again) AS o FROM f),
t AS (SELECT *, sum(CASE WHEN o AND closes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS flips FROM o),
b AS (SELECT *,
        coalesce(last_value(CASE WHEN o <> closes THEN CASE WHEN o THEN 1 ELSE 0 END END IGNORE NULLS) OVER w, 0) AS base,
        coalesce(last_value(CASE WHEN o <> closes THEN flips END IGNORE NULLS) OVER w, 0) AS base_flips,
        coalesce(lag(flips) OVER (PARTITION BY doc_id ORDER BY i), 0) AS flips_before
      FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT doc_id, blank, single OR opens OR ((base + flips_before - base_flips) % 2 = 1) AS comment FROM b),
per AS (SELECT doc_id, count(*) FILTER (NOT blank AND NOT comment) AS nbnc, count(*) FILTER (NOT blank AND comment) AS comment FROM m GROUP BY doc_id),
tot AS (SELECT doc_id, count(*) AS total FROM lines GROUP BY doc_id)
SELECT documents.doc_id, coalesce(total, 0) AS file_total, coalesce(nbnc, 0) AS file_nbnc, coalesce(comment, 0) AS file_comment
FROM documents LEFT JOIN tot USING (doc_id) LEFT JOIN per USING (doc_id)"""
ORACLES["nbnc_documents"] = _NBNC
ORACLES["stream_nbnc_documents"] = _NBNC

ORACLES["document_lines"] = f"""
WITH {_DOC_LINES}
SELECT documents.doc_id, count(x) AS file_total, count(*) FILTER (x IS NOT NULL AND regexp_matches(replace(x, chr(0), ''), '^{_WS}*$')) AS file_blank,
       count(*) FILTER (x IS NOT NULL AND NOT regexp_matches(replace(x, chr(0), ''), '^{_WS}*$')) AS file_content
FROM documents LEFT JOIN lines USING (doc_id) WHERE text IS NOT NULL GROUP BY documents.doc_id"""

ORACLES["file_crc_documents"] = """
WITH h AS (SELECT doc_id, hex(encode(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS i, h FROM h WHERE h <> ''),
v AS (SELECT doc_id, n, i, ('0x' || substr(h, 2 * i + 1, 2))::INT::HUGEINT AS v FROM b)
SELECT documents.doc_id, nullif((sum((n - i) * v) % 65521) * 65536 + sum(v) % 65521, 0)::BIGINT::VARCHAR AS file_crc
FROM documents LEFT JOIN v USING (doc_id) GROUP BY documents.doc_id"""

def _shown(line: str) -> str:
    """A line stripped and cut, tabs to the next even column, control characters as '_'."""
    cut = f"string_split(regexp_replace(left(regexp_replace({line}, '^{_WS}+|{_WS}+$', '', 'g'), 255), '{_WS}+$', ''), chr(9))"
    return f"left(regexp_replace(array_to_string([s || repeat(' ', 2 - length(s) % 2) FOR s IN {cut}[:-2]], '') || {cut}[-1], '[\\x00-\\x1e]', '_', 'g'), 255)"


_HITS = f"""
WITH {_DOC_LINES},
hit AS (SELECT doc_id, i, replace(x, chr(0), '') AS t FROM lines WHERE NOT regexp_matches(x, '(?i)cannot')),
one AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, '(?i)(?:throw{_S}+new|raise){_S}+([\\p{{L}}\\p{{N}}_]+)') THEN 'throw' WHEN regexp_matches(t, '(?i)([\\p{{L}}\\p{{N}}_]+)\\([\\p{{L}}\\p{{N}}_]+\\)') THEN 'call' END AS kind, t FROM hit)"""
ORACLES["search_lines_documents"] = _HITS + f"""
SELECT doc_id, {_shown('t')} AS search_line, i::BIGINT AS search_linenum, kind AS search_regex,
       CASE kind WHEN 'throw' THEN regexp_extract(t, '(?i)(?:throw{_S}+new|raise){_S}+([\\p{{L}}\\p{{N}}_]+)', 1) ELSE regexp_extract(t, '(?i)([\\p{{L}}\\p{{N}}_]+)\\([\\p{{L}}\\p{{N}}_]+\\)', 1) END AS search_match
FROM one WHERE kind IS NOT NULL"""
ORACLES["search_totals_documents"] = _HITS + """
SELECT doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = one.doc_id) AS file_total, count(*) AS search_total, count(*) AS hits FROM one WHERE kind IS NOT NULL GROUP BY doc_id"""
ORACLES["search_multi_documents"] = f"""
WITH t AS (SELECT doc_id, replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(0), '') AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)version{_S}+([0-9]+)') THEN 'version' WHEN regexp_matches(t, '(?i)code{_S}+([0-9]+)\\.') THEN 'code' END AS kind FROM t WHERE NOT regexp_matches(t, '(?i)according{_S}+to{_S}+the{_S}+manual'))
SELECT doc_id, kind AS search_regex, CASE kind WHEN 'version' THEN regexp_extract(t, '(?i)version{_S}+([0-9]+)', 1) ELSE regexp_extract(t, '(?i)code{_S}+([0-9]+)\\.', 1) END AS search_match FROM k WHERE kind IS NOT NULL"""


def _once(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY loaded_at DESC) = 1)"


_HIT, _ROUTINE, _FILE = _once("search_hits", "hit_id"), _once("routine_rows", "routine_id"), _once("file_measures", "file_id")
ORACLES["hits_by_entry"] = f"SELECT entry_id, count(*) AS hits, count(DISTINCT file_name) AS file_names FROM {_HIT} GROUP BY entry_id"
ORACLES["routine_ranks"] = f"""
SELECT routine_id, {_rank('routine_nbnc', ROUTINE_SIZE)} AS size_rank, {_rank('routine_complexity', COMPLEXITY)} AS complexity_rank, {_rank('routine_nesting::INT', NESTING)} AS nesting_rank,
       {_rank('(CASE WHEN routine_comments > 0 THEN routine_nbnc / routine_comments ELSE 0 END)', COMMENT_DENSITY)} AS comments_rank FROM {_ROUTINE}"""
ORACLES["routine_complexity_parts"] = f"SELECT routine_id, routine_c_decisions + greatest(1, routine_c_escapes) + routine_c_cases AS complexity FROM {_ROUTINE}"
_PATHS = f"(SELECT *, coalesce(replace(file_full_name, '\\', '/'), '?' || file_id) AS path FROM {_FILE})"
ORACLES["dupes_by_crc"] = f"""
SELECT file_id, first AS dupe_first_path FROM (SELECT file_id, path, min(path) OVER (PARTITION BY file_crc) AS first FROM {_PATHS} WHERE file_crc IS NOT NULL) WHERE path <> first"""
ORACLES["dupes_by_size"] = """
SELECT file_id, first AS dupe_first_path FROM (SELECT file_id, path, min(path) OVER (PARTITION BY string_split(path, '/')[-1], size) AS first FROM file_tree) WHERE path <> first"""
ORACLES["dupe_totals"] = f"SELECT count(*) AS files_with_dupes, coalesce(sum(n), 0)::BIGINT AS dupe_files FROM (SELECT count(*) + 1 AS n FROM ({ORACLES['dupes_by_size']}) GROUP BY dupe_first_path)"
ORACLES["dupe_rows_blanked"] = f"""
WITH p AS (SELECT *, CASE WHEN file_crc IS NOT NULL THEN min(path) OVER (PARTITION BY file_crc) END AS first FROM {_PATHS}),
q AS (SELECT *, CASE WHEN path <> first THEN first END AS dupe_first_path FROM p)
SELECT file_id, file_name, file_type, CASE WHEN dupe_first_path IS NULL THEN file_nbnc END AS file_nbnc, CASE WHEN dupe_first_path IS NULL THEN file_total END AS file_total,
       dupe_first_path, CASE WHEN dupe_first_path IS NOT NULL THEN file_nbnc END AS dupe_nbnc FROM q"""
ORACLES["routines_by_file_name"] = f"""
SELECT file_name, sum(routine_complexity)::BIGINT AS routine_complexity, sum(routine_nbnc)::BIGINT AS routine_nbnc, arg_max(routine_nesting, routine_id) AS routine_nesting, count(*) AS aggregate_count
FROM {_ROUTINE} WHERE file_name IS NOT NULL GROUP BY file_name HAVING count(*) > 3"""
_SUMMARY = f"""
WITH f AS (SELECT *, lower(file_type) AS t FROM {_FILE}),
g AS (SELECT coalesce(t, '.(noext)') AS t, * EXCLUDE (t) FROM f),
s AS (SELECT coalesce(t, '') AS file_type, sum(file_bytes)::DOUBLE AS file_bytes, sum(file_comment)::DOUBLE AS file_comment, sum(file_machine)::DOUBLE AS file_machine, sum(file_nbnc)::DOUBLE AS file_nbnc, count(file_type)::DOUBLE AS n
      FROM g GROUP BY ROLLUP (t))
SELECT measure, file_type, total FROM (
  SELECT 'file_bytes' AS measure, file_type, file_bytes AS total FROM s UNION ALL SELECT 'file_comment', file_type, file_comment FROM s UNION ALL SELECT 'file_machine', file_type, file_machine FROM s
  UNION ALL SELECT 'file_nbnc', file_type, file_nbnc FROM s UNION ALL SELECT 'file_type', file_type, n FROM s) WHERE total IS NOT NULL"""
ORACLES["summary_totals"] = _SUMMARY
ORACLES["summary_top"] = f"""
SELECT measure, total, max(file_type) AS file_type, row_number() OVER (PARTITION BY measure ORDER BY total DESC) AS place FROM ({_SUMMARY}) GROUP BY measure, total QUALIFY place <= 6"""
_RATIO = "(CASE WHEN file_comment > 0 THEN file_nbnc / file_comment ELSE 0.0::DOUBLE END)"
ORACLES["comment_density"] = f"SELECT file_id, {_RATIO}::DOUBLE AS ratio, {_rank(_RATIO, COMMENT_DENSITY)} AS file_comment_rank FROM {_FILE} WHERE file_nbnc IS NOT NULL"
ORACLES["byte_ratio"] = f"SELECT file_id, (file_bytes / file_nbnc)::DOUBLE AS nbnc_byte_ratio FROM {_FILE} WHERE file_bytes > 0 AND file_nbnc > 0 AND file_nbnc > coalesce(file_machine, 0)"
_NAME = "string_split(path, '/')[-1]"
ORACLES["job_counts"] = f"""
SELECT (SELECT count(DISTINCT regexp_replace(path, '/[^/]*$', '')) FROM file_tree) AS folders, (SELECT count(*) FROM file_tree) AS unfiltered_files,
       count(DISTINCT file_id) AS measured_files, count(*) AS measure_rows FROM file_tree WHERE regexp_matches({_NAME}, '(?i)\\.(py|js)$')"""
ORACLES["folder_counts"] = f"SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS dir_files, {_rank('count(*)', FILES_IN_FOLDER)} AS dir_files_rank FROM file_tree GROUP BY 1"
_EXT = f"regexp_extract({_NAME}, '^\\.*[^.].*?(\\.[^.]*)$', 1)"
ORACLES["path_parts"] = f"""
WITH p AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, {_NAME} AS nm, {_EXT} AS ext2 FROM file_tree),
q AS (SELECT *, string_split(folder, '/') AS parts FROM p)
SELECT file_id, left(nm, len(nm) - len(ext2)) AS file_name, CASE WHEN ext2 = '' THEN '.(NoExt)' ELSE ext2 END AS file_type,
       coalesce(parts[2], '') AS dir1, coalesce(parts[3], '') AS dir2, coalesce(parts[4], '') AS dir3, coalesce(parts[5], '') AS dir4,
       count(*) OVER (PARTITION BY folder) AS dir_files, strftime(mtime, '%Y-%m-%d') AS file_date FROM q"""
ORACLES["config_matches"] = f"""
SELECT DISTINCT file_id, entry_id FROM file_tree, (SELECT entry_id, unnest(file_filters) AS f FROM config_entries) WHERE lower({_NAME}) LIKE lower(replace(f, '*', '%'))"""
ORACLES["skip_filters"] = f"""
SELECT file_id, {_NAME} AS name FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM file_tree)
WHERE NOT regexp_matches(folder, '(?i)(^|/)(vendor|node_modules|t[^/]*)(/|$)') AND (lower(folder) LIKE '%/src%' OR lower(folder) LIKE '%/lib%')
  AND (regexp_matches({_NAME}, '(?i)\\.(js|py)$') OR ({_EXT} = '' AND NOT starts_with({_NAME}, '.'))) AND NOT regexp_matches({_NAME}, '(?i)(\\.min\\.js$|^index\\.)')"""
ORACLES["exclude_filters"] = f"SELECT file_id, {_NAME} AS name FROM file_tree WHERE NOT regexp_matches({_NAME}, '(?i)\\.(js|py|java)$') AND regexp_matches({_NAME}, '(?i)^[a-m][\\p{{L}}\\p{{N}}_]')"
_LIST = ", ".join(f"'{x}'" for x in (*COMPRESSED, *NON_CODE))
ORACLES["non_code_gate"] = f"""
WITH p AS (SELECT file_id, lower(ltrim(regexp_extract(regexp_replace(name, '([^.])(\\.[0-9]+)+$', '\\1'), '^\\.*[^.].*?(\\.[^.]*)$', 1), '.')) AS code_ext FROM file_tree) SELECT file_id, code_ext, code_ext IN ({_LIST}) AS non_code FROM p"""
ORACLES["size_gate"] = "SELECT size <= 5000 AS opened, count(*) AS files FROM file_tree WHERE content IS NOT NULL GROUP BY 1"
ORACLES["measure_filter"] = f"SELECT file_id, file_name, file_type, file_nbnc, file_nbnc_rank, file_bytes FROM {_FILE}"
ORACLES["measures_with_hits"] = f"SELECT n.*, h.search_linenum, h.search_match FROM ({_NBNC}) n JOIN ({ORACLES['search_lines_documents']}) h USING (doc_id)"

ORACLES |= oracle_scan.ORACLES
