"""SQL (DuckDB) for the queries that run the line scan: lines, blocks and comments by window functions and one recursion.

Word ends, word characters and white space are spelt out, as RE2 knows them within ASCII only. Blocks are walked from edge to edge (lines that
match a start or an end), comments are the last set or reset and the parity of toggles since, within a run of one block.
"""

from __future__ import annotations

from lineweave.functions.ranks import COMMENT_DENSITY, COMPLEXITY, FILE_SIZE, IMPORTS, NESTING, ROUTINE_SIZE
from lineweave.plans import rules

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rank(value: str, table: tuple) -> str:
    cases = " ".join(f"WHEN {value} <= {bound} THEN '{label}'" for bound, label in table[:-1])
    return f"CASE WHEN {value} IS NULL THEN '' {cases} ELSE '{table[-1][1]}' END"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quote('(?i)' + pattern)})"


def _word(text: str, words: str) -> str:
    return _has(text, f"(^|{_NW})(?:{words})($|{_NW})")


def _stripped(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapsed(text: str) -> str:
    return _stripped(f"regexp_replace({text}, '{_WS}+', ' ', 'g')")


def adler(table: str, key: str, text: str) -> str:
    """A query (key, crc) of Adler-32 from 0, null for 0."""
    return f"""(WITH h AS (SELECT {key}, hex(encode({text})) AS h FROM {table}), v AS (SELECT {key}, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS i, h FROM h WHERE h <> ''),
w AS (SELECT {key}, n, i, ('0x' || substr(h, 2 * i + 1, 2))::INT::HUGEINT AS v FROM v)
SELECT {key}, nullif((sum((n - i) * v) % 65521) * 65536 + sum(v) % 65521, 0)::BIGINT::VARCHAR AS crc FROM w GROUP BY {key})"""


_NO_STRINGS = "regexp_replace(c, '\"[^\"]+\"|''[^'']+''', '', 'g')"

DOCUMENT_TEXTS = "texts AS (SELECT doc_id AS k, text AS t, octet_length(encode(coalesce(text, ''))) AS size, '' AS name FROM documents)"

# a file's text by byte order mark, as UTF-8, or byte by byte; null where it was not read
SEEN = """raw AS (SELECT file_id AS k, path, size, content, hex(content) AS h FROM file_tree),
seen AS (SELECT k, path, size, h, string_split(path, '/')[-1] AS name, CASE WHEN content IS NULL THEN NULL WHEN content = ''::BLOB THEN ''
    WHEN starts_with(h, 'FFFE') THEN array_to_string([chr(('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2))::INT) FOR i IN range(1, len(h) // 4)], '')
    ELSE coalesce(ltrim(TRY(decode(content)), chr(65279)), array_to_string([chr(('0x' || substr(h, 2 * i + 1, 2))::INT) FOR i IN range(len(h) // 2)], '')) END AS t FROM raw),
chars AS (SELECT k, unnest(range(1, least(128, length(t)) + 1)) AS i, t FROM (SELECT k, replace(left(t, 128), chr(0), '') AS t FROM seen)),
bad AS (SELECT k, i, length(t) AS n, sum(CASE WHEN i >= 4 AND NOT regexp_matches(substr(t, i::BIGINT, 1), '[\\x20-\\x7e\\t-\\r]') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS b FROM chars),
plain AS (SELECT k, NOT bool_or(i >= 4 AND (i >= 32 OR i = n) AND b / i > 0.2) AS plain FROM bad GROUP BY k),
gates AS (SELECT seen.*, regexp_matches(coalesce(left(t, 16384), ''), '[\\x00-\\x06\\x0e-\\x1a\\x1c-\\x1f\\x7f]') AS odd, coalesce(plain, true) AS plain FROM seen LEFT JOIN plain USING (k))"""
FILE_TEXTS = SEEN + ",\ntexts AS (SELECT k, CASE WHEN plain AND NOT odd AND NOT regexp_matches(name, '(?i)[^.]\\.pdf(\\.[0-9]+)*$') THEN t END AS t, size, name FROM gates)"


class Dialect:
    """What the patterns of a rule set are in SQL."""

    single = "(" + _has("s", "^(//|;|rem|!|%)") + " OR (starts_with(s, '#') AND NOT " + _has("s", r"^#(\||def|inc|if|else|region)") + ") OR (starts_with(s, '--') AND NOT starts_with(s, '--[')) OR (starts_with(s, '''') AND NOT regexp_matches(s, '^''[^'']+''')))"
    _open, _close = r"(/\*|--\[\[|=(begin|head)|#\||\{-|<!--|<%--)", r"(\*/|\]\]|=(cut|end)|\|#|-\}|-->|--%>)"
    opens, closes, again = _has("s", _open), _has("s", _close), _has("s", f"{_open}.*{_close}")
    blank = _has("c", rf"^(?:{_WS}|[\\+.,;=\-/*'`\"#!%{{}}()\[\]<>|])*$")
    dead = _has("c", rf"[;{{}}\[\](]+{_WS}*$|[A-Za-z]\.[A-Za-z]|[=&+\[\]|]+")
    state = "b"
    machine = (
        (rf"region($|{_NW}.*{_NW}|{_NW})generated", rf"end{_WS}*region"), (rf"(^|{_NW})do{_WS}+not{_WS}+(edit|modify)($|{_NW})", None),
        (rf"generated($|{_NW})", None), (rf"(^|{_NW})created({_NW}.*{_NW}|{_NW})(tool|auto|code|script)($|{_NW})", None),
    )
    content: tuple = ()
    measure, content_block = 0, 2
    template = "false"

    def starts(self) -> list[tuple[str, str | None, int]]:
        """(condition of the start, condition of the end, block) in order."""
        out = []
        for number, block in enumerate((self.machine, self.content), 1):
            for start, end in block:
                condition = _has("c", start)
                if start.startswith("generated("):  # "generated", then one of these words before the next full stop
                    condition = _has("c", rf"generated({_NW}|$)") + " AND " + _has("c", rf"generated({_NW}|{_NW}[^.]*{_NW})(by|with|date|time|code|file|class|script|source)($|{_NW})")
                out.append((f"({condition})", None if end is None else _has("c", end), number))
        return out


class Python(Dialect):
    single = "starts_with(s, '#')"
    _quotes = "(\"\"\"|''')"
    opens, closes, again = _has("s", _quotes), _has("s", _quotes), _has("s", f"{_quotes}.*{_quotes}")
    state = "p"


class Web(Dialect):
    content = ((r"[<{]%", r"%[>}]"), ("<script", "</script>"), (r"<\?php", r"\?>"), ("<[fm]x:script", "</[fm]x:script>"))
    measure, content_block = 2, 0


class Delphi(Dialect):
    single = "starts_with(s, '//')"
    opens, closes = _has("s", r"(\(\*|\{([^/$]|$))"), _has("s", r"(\*\)|\})")
    again = "(" + _has("s", r"\(\*.*(\*\)|\})") + " OR " + _has("s", r"\{(\}|\*\)|[^/$].*(\*\)|\}))") + ")"
    blank = _has("c", rf"^{_WS}*(begin|end;)?{_WS}*$")
    dead = _has("c", rf"[;\[\]]+{_WS}*$|[A-Za-z]\.[A-Za-z]|[=&+\[\]|]+")


class Machine(Dialect):
    measure = 1


class Template(Dialect):
    template = _has("c", rf"//{_WS}*({_W}+)")


def scanned(texts: str, d: Dialect) -> str:
    """CTEs up to ``z``: (k, i, x, c, b, code, block, live, blank, is_code, is_note, dead, template) of every line."""
    starts = d.starts()
    first = "CASE " + " ".join(f"WHEN {s} THEN {n}" for n, (s, _, _) in enumerate(starts, 1)) + " ELSE 0 END" if starts else "0"
    ends = " + ".join(f"CASE WHEN {e} THEN {1 << n} ELSE 0 END" for n, (_, e, _) in enumerate(starts) if e) or "0"
    block = lambda column: "0" if not starts else "CASE " + column + " " + " ".join(f"WHEN {n} THEN {b}" for n, (_, _, b) in enumerate(starts, 1)) + " ELSE 0 END"
    return f"""{texts},
split AS (SELECT k, string_split(regexp_replace(coalesce(t, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS a FROM texts),
every AS (SELECT k, unnest(a) AS x, generate_subscripts(a, 1) AS i, len(a) AS n FROM split),
lines AS (SELECT k, i, x, replace(left(x, 255), chr(0), '') AS c FROM every WHERE NOT (i = n AND x = '')),
bare AS (SELECT *, {_stripped('c')} AS p, {_stripped(_NO_STRINGS)} AS b FROM lines),
live AS (SELECT *, p <> '' AS live, {d.state} AS s FROM bare),
flags AS (SELECT *, {d.single} AS single, {d.opens} AS opens, {d.closes} AS closes, {d.again} AS again, {d.blank} AS blank, CASE WHEN live THEN {first} ELSE 0 END AS st, CASE WHEN live THEN {ends} ELSE 0 END AS en FROM live),
edges AS (SELECT k, i, st, en, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM flags WHERE st > 0 OR en > 0),
walk AS (
  SELECT k, 0::BIGINT AS r, 0::BIGINT AS i, 0 AS act, 0 AS here, false AS chg FROM (SELECT DISTINCT k FROM edges)
  UNION ALL
  SELECT e.k, e.r, e.i,
    CASE WHEN w.act > 0 THEN CASE WHEN (e.en >> (w.act - 1)) & 1 = 1 THEN 0 ELSE w.act END WHEN e.st > 0 AND (e.en >> (e.st - 1)) & 1 = 1 THEN 0 ELSE e.st END,
    CASE WHEN w.act > 0 THEN CASE WHEN (e.en >> (w.act - 1)) & 1 = 1 THEN 0 ELSE w.act END ELSE e.st END,
    CASE WHEN w.act > 0 THEN (e.en >> (w.act - 1)) & 1 = 1 ELSE e.st > 0 END
  FROM walk w JOIN edges e ON e.k = w.k AND e.r = w.r + 1),
blocked AS (SELECT f.*, coalesce(w.chg, false) AS chg, coalesce(w.here, last_value(w.act IGNORE NULLS) OVER (PARTITION BY f.k ORDER BY f.i), 0) AS det FROM flags f LEFT JOIN walk w ON w.k = f.k AND w.i = f.i),
runs AS (SELECT *, {block('det')} AS block, sum(CASE WHEN chg THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run, NOT single AND opens AND NOT again AS o FROM blocked WHERE live),
turns AS (SELECT *, sum(CASE WHEN o AND closes THEN 1 ELSE 0 END) OVER (PARTITION BY k, run ORDER BY i) AS flips FROM runs),
states AS (SELECT *,
    coalesce(last_value(CASE WHEN o <> closes THEN CASE WHEN o THEN 1 ELSE 0 END END IGNORE NULLS) OVER w, 0) AS base,
    coalesce(last_value(CASE WHEN o <> closes THEN flips END IGNORE NULLS) OVER w, 0) AS base_flips,
    coalesce(lag(flips) OVER (PARTITION BY k, run ORDER BY i), 0) AS before
  FROM turns WINDOW w AS (PARTITION BY k, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
noted AS (SELECT *, single OR opens OR (base + before - base_flips) % 2 = 1 AS note, CASE WHEN starts_with(b, '#') THEN b ELSE string_split(b, '//')[1] END AS half FROM states),
z AS (SELECT k, i, x, c, b, chg, block, blank, note, CASE WHEN starts_with(half, '#') THEN half ELSE string_split(half, '/*')[1] END AS code,
    NOT blank AND block = {d.measure} AND NOT note AS is_code, NOT blank AND block = {d.measure} AND note AS is_note, {d.template} AS template, {d.dead} AS dead FROM noted)"""


def measures(texts: str, d: Dialect, key: str, checksums: bool = True, where: str = "true", text_of: str = "texts") -> str:
    n = lambda c: f"count(*) FILTER ({c})"
    code = {
        "imports": _word("code", "using|import|include"), "classes": _word("code", "class|type|interface"), "preprocessor": _has("code", rf"^{_WS}*#(def|if|else|end)"),
        "routines": _has("code", rf"(^|{_NW})(def|public|private|protected|static|void|sub|func|function|prop|property|proc|procedure){_WS}*[( \[{{]+"),
        "decisions": _word("code", "if|elseif|elif|else|for|foreach|while|until|when|from|where|join|find"), "inline": "(contains(b, '//') OR contains(b, '/*'))",
    }
    seen = f"NOT blank AND (block <> {d.measure} OR NOT note)"
    sums = f"""
per AS (SELECT k, {n('is_code')} AS code, {n('is_note AND NOT template AND NOT dead')} AS note, {n('is_note AND template')} AS template, {n('is_note AND dead AND NOT template')} AS dead, {n(f'blank AND block = {d.measure}')} AS blank,
    {n(f'{seen} AND block = 1')} AS machine, {n(f'{seen} AND block = {d.content_block}')} AS content, {', '.join(f'{n(f"is_code AND {c}")} AS {name}' for name, c in code.items())},
    coalesce(sum(CASE WHEN is_code THEN length(code) - length(replace(code, ';', '')) END), 0) AS semicolons FROM z GROUP BY k),
tot AS (SELECT k, count(*) AS total, count(*) FILTER (p = '') AS blank_only FROM bare GROUP BY k),
m AS (SELECT texts.k, size, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('total', 'blank_only', 'code', 'note', 'template', 'dead', 'blank', 'machine', 'content', 'semicolons', *code))} FROM texts LEFT JOIN tot USING (k) LEFT JOIN per USING (k) WHERE {where})"""
    crc = f""",
joined AS (SELECT k, string_agg({_collapsed('c')}, '' ORDER BY i) AS t FROM z WHERE is_code GROUP BY k),
ncrc AS {adler('joined', 'k', 't')}, wholes AS (SELECT k, regexp_replace(t, '\\r\\n|\\r', chr(10), 'g') AS t FROM texts WHERE t IS NOT NULL), fcrc AS {adler('wholes', 'k', 't')}"""
    ratio = "CASE WHEN note > 0 THEN code / note ELSE 0 END"
    return f"""WITH RECURSIVE {scanned(texts, d)},{sums}{crc if checksums else ''}
SELECT m.k AS {key}, total AS file_total, NULL::BIGINT AS file_raw_total, NULL::BIGINT AS file_ignored, blank_only AS file_blank_only, code AS file_nbnc, {_rank('code', FILE_SIZE)} AS file_nbnc_rank, nullif(machine, 0) AS file_machine, nullif(content, 0) AS file_content,
    CASE WHEN content > 0 THEN content + code END AS file_code_content, blank AS file_blank, note + inline AS file_comment, nullif(inline, 0) AS nbnc_inline_comments, nullif(dead, 0) AS file_dead, {_rank(f'({ratio})', COMMENT_DENSITY)} AS file_comment_rank,
    nullif(preprocessor, 0) AS nbnc_preprocessor, nullif(template, 0) AS file_template, nullif(imports, 0) AS nbnc_imports, CASE WHEN imports > 0 THEN {_rank('imports', IMPORTS)} END AS nbnc_import_rank, nullif(classes, 0) AS nbnc_classes,
    nullif(decisions, 0) AS nbnc_decisions, nullif(routines, 0) AS nbnc_routines, size::BIGINT AS file_bytes, CASE WHEN size > 0 AND code > 0 AND code > machine AND code > content THEN (size / code)::DOUBLE END AS nbnc_byte_ratio, nullif(semicolons, 0) AS nbnc_semicolons
    {', ncrc.crc AS nbnc_crc, fcrc.crc AS file_crc' if checksums else ''} FROM m {'LEFT JOIN ncrc ON ncrc.k = m.k LEFT JOIN fcrc ON fcrc.k = m.k' if checksums else ''}"""


def named(pattern: str) -> str:
    return f"texts.name IS NOT NULL AND regexp_matches(texts.name, '(?i){pattern}')"


ORACLES: dict[str, str] = {
    "code_measures_documents": measures(DOCUMENT_TEXTS, Dialect(), "doc_id"),
    "code_measures_files": measures(FILE_TEXTS, Dialect(), "file_id"),
    "python_measures_files": measures(FILE_TEXTS, Python(), "file_id", where=named(r"\.py$")),
    "web_measures_files": measures(FILE_TEXTS, Web(), "file_id", where=named(r"\.(php|js|css)$")),
    "delphi_measures_files": measures(FILE_TEXTS, Delphi(), "file_id"),
    "machine_measures_files": measures(FILE_TEXTS, Machine(), "file_id", checksums=False),
    "template_measures_documents": f"SELECT doc_id, file_nbnc, file_comment, file_template, file_dead FROM ({measures(DOCUMENT_TEXTS, Template(), 'doc_id', False)})",
    "text_gate": f"WITH {SEEN} SELECT k AS file_id, t IS NOT NULL AS was_read, odd AS is_binary, plain AS is_text, coalesce(starts_with(h, '7F454C46') OR starts_with(h, '504B0304') OR starts_with(h, '1F8B08'), false) AS is_archive FROM gates",
}


class Plain(Dialect):
    """Counts lines alone: no blocks, no dead code."""

    machine = ()
    dead = "false"


ORACLES["nbnc_files"] = f"SELECT file_id, file_total, file_nbnc, file_comment - coalesce(nbnc_inline_comments, 0) AS file_comment FROM ({measures(FILE_TEXTS, Plain(), 'file_id', False)})"
ORACLES["line_class_counts"] = f"""WITH RECURSIVE {scanned(DOCUMENT_TEXTS, Dialect())},
classes AS (SELECT k, CASE WHEN blank THEN 'symbols' WHEN NOT is_code AND NOT is_note THEN 'other block' WHEN is_note AND dead THEN 'dead' WHEN is_note THEN 'comment' ELSE 'code' END AS line_class FROM z UNION ALL SELECT k, 'blank' FROM bare WHERE p = '')
SELECT line_class, count(*) AS lines, count(DISTINCT k) AS files FROM classes GROUP BY line_class"""

_THROW, _CALL = rf"(?:throw{_SP}+new|raise){_SP}+({_W}+)", rf"({_W}+)\({_W}+\)"
ORACLES["search_code_documents"] = f"""WITH RECURSIVE {scanned(DOCUMENT_TEXTS, Dialect())},
hit AS (SELECT *, CASE WHEN {_has('code', _THROW)} THEN 'throw' WHEN {_has('code', _CALL)} THEN 'call' END AS kind FROM z WHERE is_code AND NOT {_has('code', 'cannot')})
SELECT k AS doc_id, left({_stripped('c')}, 255) AS search_line, i::VARCHAR AS search_linenum, left(CASE kind WHEN 'throw' THEN regexp_extract(code, {_quote('(?i)' + _THROW)}, 1) ELSE regexp_extract(code, {_quote('(?i)' + _CALL)}, 1) END, 255) AS search_match,
    kind AS search_regex, CASE kind WHEN 'throw' THEN {_quote(r'(?:throw\s+new|raise)\s+(\w+)')} ELSE {_quote(r'(\w+)\(\w+\)')} END AS search_regex_full FROM hit WHERE kind IS NOT NULL"""
_CANNOT = rf"cannot{_SP}+({_W}+)"
ORACLES["search_comments_files"] = f"""WITH RECURSIVE {scanned(FILE_TEXTS, Dialect())}
SELECT k AS file_id, left({_stripped('c')}, 255) AS search_line, i::VARCHAR AS search_linenum, left(regexp_extract(b, {_quote('(?i)' + _CANNOT)}, 1), 255) AS search_match, 'word' AS search_regex, {_quote(r'cannot\s+(\w+)')} AS search_regex_full
FROM z WHERE is_note AND {_has('b', _CANNOT)}"""
_CODE_LINES = f"code_lines AS (SELECT k, i, {_collapsed('c')} AS line FROM z WHERE is_code)"
ORACLES["import_lines_files"] = f"""WITH RECURSIVE {scanned(FILE_TEXTS, Dialect())}, {_CODE_LINES}
SELECT k AS file_id, line AS depend_using, count(*) AS depend_count, string_agg(i::VARCHAR, ',' ORDER BY i) AS line_numbers FROM code_lines WHERE {_word('line', 'using|import|include')} GROUP BY k, line"""
ORACLES["dupe_lines_global"] = f"""WITH RECURSIVE {scanned(DOCUMENT_TEXTS, Dialect())}, {_CODE_LINES}
SELECT line AS dupeline_content, count(*)::BIGINT AS dupeline_count, count(DISTINCT k) AS files FROM code_lines GROUP BY line HAVING count(*) > 1"""


# CRC-32 of the different lines, byte by byte
ORACLES["dupe_lines_files"] = f"""WITH RECURSIVE {scanned(FILE_TEXTS, Dialect())}, {_CODE_LINES},
once AS (SELECT line, hex(encode(line)) AS h FROM (SELECT DISTINCT line FROM code_lines)),
bits AS (SELECT unnest(range(256)) AS n, n AS t, 0 AS bit UNION ALL SELECT n, xor(t >> 1, 3988292384 * (t & 1)), bit + 1 FROM bits WHERE bit < 8),
table_of AS (SELECT n, t FROM bits WHERE bit = 8),
steps AS (
  SELECT line, h, 0 AS i, 4294967295::BIGINT AS crc FROM once
  UNION ALL
  SELECT w.line, w.h, w.i + 1, xor(w.crc >> 8, t.t) FROM steps w JOIN table_of t ON t.n = xor(w.crc & 255, ('0x' || substr(w.h, 2 * w.i + 1, 2))::BIGINT) WHERE 2 * w.i < length(w.h)),
sums AS (SELECT line, xor(crc, 4294967295) AS crc FROM steps WHERE 2 * i = length(h))
SELECT k AS file_id, crc AS dupeline_crc, arg_min(line, i) AS dupeline_content, count(*) AS dupeline_count, string_agg(i::VARCHAR, ',' ORDER BY i) AS line_numbers FROM code_lines JOIN sums USING (line) GROUP BY k, crc"""

# -- jobs ----------------------------------------------------------------------------------------------------------

_NOT_SPACE = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CHOPPED = "(CASE WHEN starts_with(CASE WHEN starts_with(c, '#') THEN c ELSE string_split(c, '//')[1] END, '#') THEN CASE WHEN starts_with(c, '#') THEN c ELSE string_split(c, '//')[1] END ELSE string_split(CASE WHEN starts_with(c, '#') THEN c ELSE string_split(c, '//')[1] END, '/*')[1] END)"
_TRIED = (
    r"regexp_matches(y, '\p{Nd}')", _has("y", rf"(^|{_NW})class{_WS}+{_W}"), f"regexp_matches(y, '{_NOT_SPACE}')", _has("y", rf"(thrownew|raise|catch\(){_WS}*{_W}"), "regexp_matches(y, 'TODO|FIXME|XXX')",
    _has("y", rf"(import|include|require\(){_WS}*{_NOT_SPACE}"), _has("y", "[\"'][^\"']+[\"']"), None, r"regexp_matches(y, '[^\x00-\x7f]')",
)
ORACLES["search_by_config"] = f"""WITH RECURSIVE {scanned(FILE_TEXTS, Dialect())}, plain_lines AS (SELECT k, i, replace(x, chr(0), '') AS y FROM lines),
hits AS ({' UNION ALL '.join(f'SELECT {n} AS entry, k FROM plain_lines WHERE {c}' for n, c in enumerate(_TRIED) if c)}
  UNION ALL SELECT 7, k FROM z JOIN texts USING (k) WHERE is_code AND regexp_matches(texts.name, '(?i)\\.sql$') AND {_has(_CHOPPED, rf'from{_WS}+{_W}')})
SELECT entry::INT AS entry, count(*) AS hits, count(DISTINCT k) AS files FROM hits GROUP BY entry"""

_EXT = "regexp_extract(nm, '^\\.*[^.].*?(\\.[^.]*)$', 1)"
_DESCRIBED = f"""(SELECT *, left(nm, length(nm) - length(ext2)) AS file_name, CASE WHEN ext2 = '' THEN '.(NoExt)' ELSE ext2 END AS file_type, nm AS file_full_name, path AS file_abs_path, {', '.join(f"coalesce(parts[{i + 1}], '') AS dir{i}" for i in range(1, 8))}
FROM (SELECT *, {_EXT} AS ext2, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS parts FROM (SELECT file_id, path, string_split(path, '/')[-1] AS nm FROM file_tree)))"""
_ABOUT = ["file_name", "file_type", "file_full_name", "file_abs_path", *(f"dir{i}" for i in range(1, 8))]
_FILE_COLUMNS = ("total", "raw_total", "ignored", "blank_only", "nbnc", "nbnc_rank", "machine", "content", "code_content", "blank", "comment", "dead", "comment_rank", "template", "bytes", "crc")
_NBNC_COLUMNS = ("inline_comments", "preprocessor", "imports", "import_rank", "classes", "decisions", "routines", "byte_ratio", "semicolons", "crc")


def _entry(number: int, tag: str, d: Dialect, names: str, with_nbnc: bool) -> str:
    kept = [*(f"file_{c}" for c in _FILE_COLUMNS), *(f"nbnc_{c}" if with_nbnc else f"NULL AS nbnc_{c}" for c in _NBNC_COLUMNS)]
    return f"SELECT file_id, {number} AS entry, NULL::VARCHAR AS out, {', '.join(_ABOUT)}, '{tag}' AS tag1, {', '.join(kept)} FROM ({measures(FILE_TEXTS, d, 'file_id', where=named(names))}) JOIN {_DESCRIBED} USING (file_id)"


ORACLES["config_measures"] = " UNION ALL ".join(f"({e})" for e in (_entry(0, "script", Python(), r"\.(py|rb)$", True), _entry(1, "managed", Dialect(), r"\.(java|cs|kt)$", False), _entry(2, "native", Dialect(), r"\.(c|h|cpp)$", True)))
_REPORTED = ["file_id", "entry", "out", *_ABOUT, "tag1", "tag2", "file_total", "file_nbnc", "file_comment"]
ORACLES["report_rows"] = f"""WITH n AS ({ORACLES['nbnc_files']})
SELECT {', '.join(_REPORTED)} FROM (SELECT *, 0 AS entry, 'py.csv' AS out, 'py' AS tag1, NULL::VARCHAR AS tag2 FROM n JOIN {_DESCRIBED} USING (file_id) WHERE regexp_matches(file_full_name, '(?i)\\.py$')
  UNION ALL SELECT * REPLACE (NULL AS file_comment, NULL AS file_full_name), 1, NULL, 'web', 'js' FROM n JOIN {_DESCRIBED} USING (file_id) WHERE regexp_matches(file_full_name, '(?i)\\.(js|ts)$'))"""

# -- PowerBuilder --------------------------------------------------------------------------------------------------

_SHOWN = "regexp_replace(replace(x, chr(0), ''), '[\\x{7f}-\\x{fe}]', '', 'g')"
ORACLES["powerbuilder_lines_documents"] = f"""WITH RECURSIVE {DOCUMENT_TEXTS},
split AS (SELECT k, string_split(regexp_replace(coalesce(t, ''), '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS a FROM texts),
every AS (SELECT k, unnest(a) AS x, generate_subscripts(a, 1) AS i, len(a) AS n FROM split),
lines AS (SELECT k, i, {_SHOWN} AS l, regexp_matches(replace(x, chr(0), ''), '^{_WS}*(text|column)\\(') AS gen, n, x FROM every WHERE NOT (i = n AND x = '')),
live AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM lines WHERE NOT gen AND regexp_matches(l, '{_NOT_SPACE}')),
f AS (SELECT k, r, CASE WHEN regexp_matches(l, '{_WS}function{_WS}+.*;') THEN 1 WHEN regexp_matches(l, '{_WS}subroutine{_WS}+.*;') THEN 2 WHEN regexp_matches(l, '(^|{_NW})event{_WS}+.*;') THEN 3 ELSE 0 END AS st,
    CASE WHEN regexp_matches(l, '^end{_WS}+function') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(l, '^end{_WS}+subroutine') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(l, '^end{_WS}+event') THEN 4 ELSE 0 END AS en,
    regexp_matches(l, '^{_WS}*table\\(') AS tb, regexp_matches(l, '^{_NOT_SPACE}') AS te, length(l) - length(replace(l, ';', '')) AS semis FROM live),
walk AS (
  SELECT k, 0::BIGINT AS r, 0 AS rt, false AS tb, '' AS kind, 0::BIGINT AS rows FROM (SELECT DISTINCT k FROM f)
  UNION ALL
  SELECT f.k, f.r, CASE WHEN w.rt > 0 THEN CASE WHEN (f.en >> (w.rt - 1)) & 1 = 1 THEN 0 ELSE w.rt END ELSE f.st END, CASE WHEN w.rt > 0 OR f.st > 0 THEN w.tb WHEN w.tb THEN NOT f.te ELSE f.tb END,
    CASE WHEN w.rt > 0 OR f.st > 0 THEN 'routines' WHEN CASE WHEN w.tb THEN NOT f.te ELSE f.tb END THEN 'tables' ELSE 'code' END, CASE WHEN w.rt = 0 AND f.st > 0 THEN f.semis + 2 ELSE 1 END
  FROM walk w JOIN f ON f.k = w.k AND f.r = w.r + 1)
SELECT kind, sum(rows)::BIGINT AS lines FROM (SELECT kind, rows FROM walk WHERE r > 0 UNION ALL SELECT 'gen', 1 FROM lines WHERE gen AND regexp_matches(l, '{_NOT_SPACE}')) GROUP BY kind"""

# -- routines ------------------------------------------------------------------------------------------------------

_LEAD = f"string_split(regexp_extract(c, '^{_WS}*'), chr(9))"
_INDENT = f"coalesce(list_sum([(length(s) // 4 + 1) * 4 FOR s IN {_LEAD}[:-2]]), 0) + length({_LEAD}[-1])"


def routines(texts: str, key: str, start: str, name: str, raw: str, full: str, file_lines: bool) -> str:
    """One row per routine. Events are block changes (0), starts (1) and the end of the file (2); a routine is saved at the next event."""
    d = Dialect()
    marks = {
        "decisions": _word("code", "if|elseif|elif|else|for|foreach|while|until|when|from|where|join|find"), "escapes": _word("code", "return|continue|break|goto|except|catch|finally"),
        "cases": _word("code", "case"), "booleans": _has("code", rf"({_WS}+and{_WS}+|{_WS}+or{_WS}+|\|\||&&)"),
    }
    within = "z.i >= coalesce(kept.pi, 0) AND z.i < kept.i AND z.is_code"
    complexity = "decisions + greatest(1, escapes) + cases"
    return f"""WITH RECURSIVE {scanned(texts, d)},
zz AS (SELECT *, is_code AND {start} AS starts, {', '.join(f'{c} AS {n}' for n, c in marks.items())} FROM z),
sizes AS (SELECT texts.k, count(bare.i) AS n FROM texts LEFT JOIN bare USING (k) GROUP BY texts.k),
ev AS (SELECT k, i, 0 AS kind, block FROM zz WHERE chg UNION ALL SELECT k, i, 1, block FROM zz WHERE starts UNION ALL SELECT k, n + 1, 2, NULL FROM sizes),
evo AS (SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY i, kind) AS pk, lag(i) OVER (PARTITION BY k ORDER BY i, kind) AS pi,
    coalesce(last_value(CASE WHEN kind = 0 THEN block END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS active FROM ev),
kept AS (SELECT *, coalesce(pk = 1, false) AS found FROM evo WHERE (kind = 1 OR active = {d.measure}) AND (coalesce(pk = 1, false) OR {file_lines})),
sums AS (SELECT kept.k, kept.i, kept.kind, kept.pi, kept.found, count(z.i) FILTER (z.is_code AND z.i < kept.i + CASE WHEN kept.kind = 1 THEN 1 ELSE 0 END) AS code, count(z.i) FILTER (z.is_note AND NOT z.dead AND z.i < kept.i + CASE WHEN kept.kind = 1 THEN 1 ELSE 0 END) AS notes,
    {', '.join(f'count(z.i) FILTER ({within} AND z.{n}) AS {n}' for n in marks)}, greatest(0, coalesce(max(CASE WHEN {within} AND z.decisions THEN ({_INDENT.replace('(c,', '(z.c,')})::BIGINT // 4 - 2 END), 0)) AS nesting
  FROM kept LEFT JOIN zz z ON z.k = kept.k GROUP BY ALL),
parts AS (SELECT *, code - coalesce(lag(code) OVER w, 0) AS nbnc, notes - coalesce(lag(notes) OVER w, 0) AS comments FROM sums WINDOW w AS (PARTITION BY k ORDER BY i, kind)),
r AS (SELECT parts.*, parts.decisions + greatest(1, parts.escapes) + parts.cases AS complexity, CASE WHEN found THEN s.c END AS c FROM parts LEFT JOIN zz s ON s.k = parts.k AND s.i = parts.pi AND parts.found)
SELECT k AS {key}, CASE WHEN found THEN {name} ELSE '{rules.NO_ROUTINE}' END AS routine_name, CASE WHEN found THEN {_stripped('c')} ELSE '' END AS routine_line, CASE WHEN found THEN pi ELSE 0 END::VARCHAR AS routine_linenum,
    decisions AS routine_c_decisions, greatest(1, escapes) AS routine_c_escapes, cases AS routine_c_cases, booleans AS routine_c_booleans, nbnc AS routine_nbnc, {_rank('nbnc', ROUTINE_SIZE)} AS routine_nbnc_rank,
    nesting::VARCHAR AS routine_nesting, {_rank('nesting', NESTING)} AS routine_nesting_rank, complexity AS routine_complexity, {_rank(f'({complexity})', COMPLEXITY)} AS routine_complexity_rank, comments AS routine_comments,
    {_rank('(CASE WHEN comments > 0 THEN nbnc / comments ELSE 0 END)', COMMENT_DENSITY)} AS routine_comments_rank, CASE WHEN found THEN {raw} ELSE '' END AS routine_regex, CASE WHEN found THEN {full} ELSE '' END AS routine_regex_full FROM r"""


_KEYWORD = rf"(?:^|{_NW})(def|public|private|protected|static|void|sub|func|function|prop|property|proc|procedure){_WS}*[( \[{{]+"
_BY_KEYWORD = {"start": _has("c", _KEYWORD), "name": f"regexp_extract(c, {_quote('(?i)' + _KEYWORD)}, 1)", "raw": _quote(rules.ROUTINE), "full": _quote(rules.ROUTINE)}
_DEF, _CLASS = rf"(?:def|func|function){_WS}+({_W}+)", rf"(?:^|{_NW})class{_WS}+({_W}+)"
_IS_DEF = _has("c", _DEF)
ORACLES["routines_documents"] = routines(
    DOCUMENT_TEXTS, "doc_id", f"({_IS_DEF} OR {_has('c', _CLASS)}) AND NOT {_has('c', 'async')}", f"CASE WHEN {_IS_DEF} THEN regexp_extract(c, {_quote('(?i)' + _DEF)}, 1) ELSE regexp_extract(c, {_quote('(?i)' + _CLASS)}, 1) END",
    f"CASE WHEN {_IS_DEF} THEN 'def' ELSE 'class' END", f"CASE WHEN {_IS_DEF} THEN {_quote(r'(?:def|func|function)' + chr(92) + 's+(' + chr(92) + 'w+)')} ELSE {_quote(chr(92) + 'bclass' + chr(92) + 's+(' + chr(92) + 'w+)')} END", False,
)
ORACLES["routines_files"] = routines(FILE_TEXTS, "file_id", file_lines=True, **_BY_KEYWORD)
ORACLES["routine_totals_files"] = f"SELECT file_id, count(*) FILTER (routine_regex <> '') AS nbnc_routines, sum(routine_c_decisions)::BIGINT AS nbnc_decisions FROM ({routines(FILE_TEXTS, 'file_id', file_lines=False, **_BY_KEYWORD)}) GROUP BY file_id"

ORACLES["dupes_by_size_threshold"] = """WITH RECURSIVE sizes AS (SELECT string_split(path, '/')[-1] AS name, size, min(path) AS path FROM file_tree GROUP BY 1, 2),
arrived AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM sizes),
walk AS (
  SELECT name, r, size, path AS leader, [{'s': size, 'p': path}] AS leaders FROM arrived WHERE r = 1
  UNION ALL
  SELECT a.name, a.r, a.size, coalesce([x.p FOR x IN w.leaders IF abs(x.s - a.size) <= 40][1], a.path),
    CASE WHEN len([x.p FOR x IN w.leaders IF abs(x.s - a.size) <= 40]) = 0 THEN list_append(w.leaders, {'s': a.size, 'p': a.path}) ELSE w.leaders END
  FROM walk w JOIN arrived a ON a.name = w.name AND a.r = w.r + 1)
SELECT file_id, leader AS dupe_first_path FROM file_tree f JOIN walk w ON w.name = string_split(f.path, '/')[-1] AND w.size = f.size WHERE f.path <> leader"""
