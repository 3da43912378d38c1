"""Measures against a sequential specification, on fixtures written by hand and on the test documents."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from lineweave.operators import measure, powerbuilder
from lineweave.plans import metadata
from lineweave.plans import queries as Q
from lineweave.plans import rules as R
from lineweave.sources import files as S


def py(source):
    return re.compile(source)


def specified(text, rules):
    lines = re.sub("\r\n|\r", "\n", text or "").split("\n")
    if lines[-1] == "":
        lines.pop()
    n = dict.fromkeys(("total", "blank_only", "blank", "nbnc", "comment", "dead", "machine", "content", "inline", "decisions", "semicolons", "imports"), 0)
    active, end, single, multi, crc = 0, None, False, False, 0
    string = re.compile(r"\"(?!\").+?\"|'(?!').+?'")

    def start(line):
        for number, block in enumerate(rules.detectors, 1):
            for s, e in block:
                if py(s).search(line):
                    return number, e, bool(e and py(e).search(line))
        return 0, None, False

    for raw in lines:
        n["total"] += 1
        line = raw[: rules.width].replace("\0", "")
        if py(R.TRUE_BLANK).match(line):
            n["blank_only"] += 1
            continue
        if any(rules.detectors):
            old = active
            if active and single:
                old = 0
                active, end, single = start(line)
            elif active:
                if end and py(end).search(line):
                    active, end = 0, None
            else:
                active, end, single = start(line)
            if old != active:
                multi = False
        bare = string.sub("", line).strip()
        state = line.strip() if rules.python else bare
        comment = not multi and bool(py(rules.single).match(state))
        if not comment:
            if multi:
                comment = True
                multi = not py(rules.close).search(state)
            elif m := py(rules.open).search(state):
                comment = True
                multi = not py(rules.close).search(state[m.end() :])
        mine = active == rules.measure_block
        if py(rules.blank).match(line):
            n["blank"] += mine
            continue
        if not mine:
            n["machine"] += active == R.MACHINE
            n["content"] += active == rules.content_block
        elif comment:
            n["dead" if rules.dead and py(rules.dead).search(line) else "comment"] += 1
        else:
            n["nbnc"] += 1
            code = bare
            n["inline"] += any(x in bare for x in rules.inline)
            for x in rules.inline:
                if code and code[0] != "#":
                    code = code.split(x, 1)[0]
            n["decisions"] += bool(py(rules.decision).search(code))
            n["imports"] += bool(py(rules.imports).search(code))
            n["semicolons"] += code.count(";")
            crc = zlib.adler32(" ".join(line.split()).encode(), crc)
    return n | {"crc": crc}


FIXTURES = [
    None, "", "\n\n\n", "a", "a\n", "{\n);\n/*\nx\n*/\ny", "/* a\nb\nc */\nx", "x = 1; /* n */", "*/ a /*\nq\n*/ b /*\nz", "remove(x)\n--[[ c\n]]\n#define X 1\n' note\n'str' + x", "y" * 250 + " */ z", "/*" + "q" * 300 + "*/\nx",
    'a = "// not a comment"; // real', "#region generated\nx = 1\n#endregion\ny = 2", "a = 1\nb = 2\n// do not edit\nc = 3\nd = 4", "<script>x</script>\nplain\n<script>\nvar a = 1;\n</script>\nrest", "// a = b\n// foo.bar\n// plain words\n/* plain words */",
    "if (a) { return b; }\nimport x;\n#include <y>\nfor (;;) ;", "a\r\nb\rc\n", "\xa0\n　x\n  \t\n", "# py\n'''doc\nmore'''\nx = 1",
]


@pytest.mark.parametrize("rules", [R.CODE, R.WEB, R.rules_for("Code", [("PYTHON", None)]), R.DELPHI], ids=["code", "web", "python", "delphi"])
def test_code_measures(spark, sf, rules):
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = FIXTURES + docs
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    rows = {r.file_id: r for r in measure.code(files, rules).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want, r = specified(text, rules), rows[i]
        got = {"total": r.file_total, "blank_only": r.file_blank_only, "blank": r.file_blank, "nbnc": r.file_nbnc, "comment": r.file_comment - (r.nbnc_inline_comments or 0), "dead": r.file_dead or 0, "machine": r.file_machine or 0, "content": r.file_content or 0}
        got |= {"inline": r.nbnc_inline_comments or 0, "decisions": r.nbnc_decisions or 0, "semicolons": r.nbnc_semicolons or 0, "imports": r.nbnc_imports or 0, "crc": int(r.nbnc_crc or 0)}
        assert got == want, text


def test_options(spark):
    text = "a;b;c\n// x\nskip me\n/* q */ code();\n"
    files = spark.createDataFrame([(1, text)], "file_id long, text string")
    one = lambda *options: measure.code(files, R.rules_for("Code", list(options))).first()
    assert one(("ADD_LINE_SEP", ";")).file_total == 7 and one(("ADD_LINE_SEP", ";")).file_raw_total == 4
    assert one(("IGNORE_LINE", "^skip")).file_ignored == 1
    assert one(("COMMENT_CLOSE_CODE", None)).file_nbnc == one().file_nbnc + 1
    assert one(("MACHINE_ALL", None)).file_machine == 4
    assert one(("MAX_LINE_LENGTH", "2")).file_nbnc >= 1
    with pytest.raises(R.OptionError):
        one(("NO_SUCH", None))


def test_extra_columns_and_empty_tables(spark):
    files = spark.createDataFrame([(1, "x", 5, ["a"], 3)], "file_id long, text string, flags int, items array<string>, total int")
    assert measure.nbnc(files).first().file_nbnc == 1
    clash = files.select("file_id", "text", "items", F.lit(1).alias("codes"), F.lit(2).alias("n"), F.lit(3).alias("lines"))
    r = measure.code(clash, keep=["file_id", "items", "codes", "n", "lines"]).first()
    assert (r["items"], r.codes, r.n, r.lines, r.file_nbnc) == (["a"], 1, 2, 3, 1)
    assert measure.code(files.limit(0)).count() == 0 and measure.document(files.limit(0)).count() == 0


def test_invariant(spark, sf):
    """In files without blocks every line is of one kind."""
    r = measure.code(Q.documents(spark, sf), R.rules_for("Code", [("MACHINE_NONE", None)]), checksums=False)
    inline = F.coalesce("nbnc_inline_comments", F.lit(0))
    assert r.where(F.col("file_blank_only") + F.col("file_blank") + F.col("file_comment") - inline + F.coalesce("file_dead", F.lit(0)) + F.col("file_nbnc") != F.col("file_total")).count() == 0


def test_files_gates_and_metadata(spark, tmp_path):
    """Every file is listed, whatever its name begins with; gates keep files shut, their rows stay."""
    for name in ("src", "_build", ".git", "pkg"):
        (tmp_path / name).mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.zip.001").write_bytes(b"PK\x03\x04\x00")
    (tmp_path / "blob").write_bytes(bytes(range(200)))
    (tmp_path / "Makefile").write_text("all:\n")
    for name in ("pkg/__init__.py", "_build/c.py", ".git/config", ".hidden.py"):
        (tmp_path / name).write_text("y = 2\n")
    found = S.folder_tree(spark, str(tmp_path))
    assert {r.name: r.ext for r in found.collect()} == {"a.py": ".py", "b.zip.001": ".001", "blob": "", "Makefile": "", "__init__.py": ".py", "c.py": ".py", "config": "", ".hidden.py": ".py"}
    for tree in (found, S.folder_tree(spark, str(tmp_path), content=False)):
        opened = {r.name: r.text for r in S.opened(tree, non_code=True).collect()}
        assert len(opened) == 8 and {n for n, t in opened.items() if t is None} == {"b.zip.001", "blob"} and opened["c.py"] == "y = 2\n"
    assert S.opened(found, metadata_only=True).where("text is not null").count() == 0
    assert S.opened(found, largest=5).where("text is not null").count() == 1
    assert S.folder_tree(spark, str(tmp_path), recursive=False).count() == 3
    assert [r.name for r in S.walk_order(found).collect()] == [".hidden.py", "Makefile", "blob", "config", "c.py", "__init__.py", "a.py", "b.zip.001"]
    kinds = metadata.Metadata(dirs=2, size=True, folder=True)
    meta = {r.file_full_name: r for r in metadata.described(found, kinds).collect()}
    assert meta["Makefile"].file_type == ".(NoExt)" and meta["a.py"].file_name == "a" and meta["a.py"].dir_files == 2 and meta["c.py"].file_bytes == 6
    raws = ["é".encode("utf-16"), b"\xe9", None, b"", "x".encode("utf-16-le") * 9, b"a\x01b"]
    decoded = S.seen(spark.createDataFrame([(bytearray(r) if r is not None else None,) for r in raws], "content binary")).select("_seen.*").collect()
    assert [r.text for r in decoded] == ["é", "é", None, "", "x" * 9, "a\x01b"] and [r.binary for r in decoded] == [False] * 5 + [True]


def test_text_gate_counts_characters(spark):
    """Letters beyond ASCII count once each, however many bytes they take."""
    czech = "Příliš žluťoučký kůň úpěl ďábelské ódy a potom ještě jednou dlouho dlouho spal na louce pod lesem, kde rostlo mnoho travin."
    german = "Größe der Fläche wählen, dann zurück zum Menü und über das Kästchen für die Übersicht gehen, bis alles schön überprüft ist."
    russian = "съешь ещё этих мягких французских булок, да выпей чаю"
    rows = S.seen(spark.createDataFrame([(bytearray(t.encode()),) for t in (czech, german, russian, "plain", "", "абв")], "content binary")).select("_seen.plain").collect()
    assert [r.plain for r in rows] == [specified_gate(t) for t in (czech, german, russian, "plain", "", "абв")] and rows[1].plain and not rows[2].plain


def specified_gate(text):
    """The text test, character by character."""
    bad, start = 0, text[:128].replace("\0", "")
    for at, c in enumerate(start, 1):
        if at < 4:
            continue
        bad += not (c.isascii() and (c.isprintable() or c.isspace()))
        if (at >= 32 or at == len(start)) and bad / at > 0.2:
            return False
    return True


def test_delta(spark):
    new = spark.createDataFrame([(1, "a", "x\ny\nz\n"), (2, "b", "same\n"), (3, "c", "new\n")], "file_id long, path string, text string")
    old = spark.createDataFrame([("a", "x\nz\n"), ("b", "same\n")], "path string, text string")
    rows = {r.file_id: r for r in S.delta(new, old).collect()}
    assert rows[1].text == "y" and rows[2].text == "" and rows[2].dupe_first_path == "b" and rows[3].text == "new\n"


def test_powerbuilder(spark):
    text = "text(x)\n function f ();a;b\n x = 1\nend function\ntable(\n  col\n)\ny = 2\n event open;\nend subroutine\nend event\n"
    rows = powerbuilder.line_kinds(spark.createDataFrame([(1, ".sru", text)], "file_id long, ext string, text string")).collect()
    assert [(r.line_number, r.kind) for r in rows] == [(1, "gen"), *[(2, "routines")] * 4, (3, "routines"), (4, "routines"), (5, "tables"), (6, "tables"), (7, "code"), (8, "code"), *[(9, "routines")] * 3, (10, "routines"), (11, "routines")]
    assert [r.line for r in rows][1:5] == ["", " function f ();", "a;", "b"]
    files = spark.createDataFrame([(1, ".sru", text), (2, ".pbl", "\u20ac" * 40 + "\nx = 1\n")], "file_id long, ext string, text string")
    got = {r.file_id: r for r in measure.code(files, R.MODULES["customPowerBuilder"]).collect()}
    assert (got[1].file_pb_gen_lines, got[1].file_pb_bin_lines, got[1].file_total, got[1].file_raw_total) == (1, 0, 10, 11)
    assert (got[2].file_pb_bin_lines, got[2].file_nbnc) == (1, 1)


def test_hooks(spark):
    """Code of one's own: lines left out, changed and counted."""
    import numpy as np
    import pyarrow.compute as pc

    hooks = R.Hooks(skip=lambda raw: np.array(pc.starts_with(raw, "@")), preprocess=lambda lines: pc.replace_substring(lines, "REM:", "//"), blank=lambda lines: np.array(pc.starts_with(lines, "===")), measures=lambda s: {"long": s.sums(np.array(pc.utf8_length(s.lines))[s.ids] > 10)})
    files = spark.createDataFrame([(1, "@x\nREM: note\n=====x\na = 1234567890\n"), (2, None)], "file_id long, text string")
    rows = {r.file_id: r for r in measure.code(files, R.replace(R.CODE, hooks=hooks)).collect()}
    assert (rows[1].file_total, rows[1].file_raw_total, rows[1].file_nbnc, rows[1].file_comment, rows[1].file_blank, rows[1].extra) == (3, 4, 1, 1, 1, {"long": 1}) and rows[2].extra == {"long": 0}


def test_string_option(spark):
    files = spark.createDataFrame([(1, "x = |// a|;\ny = `b`;\n")], "file_id long, text string")
    assert measure.code(files).first().nbnc_semicolons == 1
    own = R.rules_for("Code", [("STRINGS", r"\|[^|]*\|")])
    assert measure.code(files, own).first().nbnc_semicolons == 2


def test_pdf_pages_of_a_job(spark):
    """A document job tells the pages of a PDF, which no text gate lets in, and the lines of texts."""
    from lineweave.plans import config, jobs

    files = S.with_names(spark.createDataFrame([("/a.pdf", bytearray(b"%PDF-1.4 \x00\x01 /Type /Page >> /Type/Page>>")), ("/b.txt", bytearray(b"x\n\ny\n")), ("/c.txt", None)], "path string, content binary").withColumn("size", F.lit(9)))
    rows = {r.file_full_name: r for r in jobs.run(files, config.parse("measure Document * *"))[0].rows.collect()}
    assert rows["a.pdf"].doc_pages == 2 and rows["a.pdf"].file_total == 0 and (rows["b.txt"].file_total, rows["b.txt"].file_blank, rows["b.txt"].doc_pages) == (3, 1, None) and len(rows) == 2


def test_pdf_pages(spark):
    rows = spark.createDataFrame([(1, "a.pdf", bytearray(b"/Type /Page >> /Type /Pages >> /Type/Page>>"))], "file_id long, name string, content binary")
    assert measure.pdf_pages(rows).first().doc_pages == 2
