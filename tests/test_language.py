"""Expressions, names, ranks and the config language."""

import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.functions import match as M
from lineweave.functions import paths as P
from lineweave.functions import ranks
from lineweave.functions import text as T
from lineweave.functions.regex import strip, to_java
from lineweave.plans import config

PATTERNS = [r"\b class \s+ (\w+) # name", r"[a b]+x", r"[x\[&&]+", r"(?P<q_q>a)(?P=q_q)", r"a{2}b{,1}\{c\}", r"^ \s* [#] x", r"[^]a]b", r"(\d+)|([\"'])", r"\#\ x", r"{-|-}"]
TEXTS = ["class  Foo", "a b x", "x[&&", "aa", "aab{c}", "  #x", "zb]b", "12 \"'", "# x", "{- -}", "", "éclass É", " #x", "CLASS bar"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_java_spelling(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", F.col("t").rlike(to_java(pattern)).alias("hit")).collect():
        assert r.hit == bool(re.search(pattern, r.t, re.I | re.X)), r.t


MORE = [r"\bif\b", r"^\s*x|y$", r"(?:a|b)*c$", r"a$|b", r"\Bx", r"[^\W\d]+é", r"(?<=a)b", r"a(?!b)", r"(a)\1", r"\w{2,3}$", r"[^a-c]", r".\Z", r"(?i:ab)c", r"x{1001}", r"\S\s$", r"a??b", r"[\]\-^]"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcxyifIF éÉßſK\t\n\x0b\x1c\x85 -^]1_", max_size=12), min_size=1, max_size=6))
def test_patterns_over_columns(texts):
    """A pattern over a column finds what Python finds line by line."""
    import pyarrow as pa

    lines = pa.array(texts, pa.string())
    for source in (*PATTERNS, *MORE):
        for flags in (re.I | re.X, 0):
            p = M.pattern(source, flags)
            assert M.Pattern.mask(p, lines, M.beyond_ascii(lines)).tolist() == [bool(p.compiled.search(t)) for t in texts], source
            assert M.pattern(source, flags, True).mask(lines, M.beyond_ascii(lines)).tolist() == [bool(p.compiled.match(t)) for t in texts], source


def test_searches():
    import pyarrow as pa

    texts = ["foo(x) bar", "BAR", "bar baz", "foo()", "é bar baz", "é bar"]
    lines = pa.array(texts)
    s = M.Searches([(True, "A", r"foo\((\w*)"), (True, "B", "bar"), (False, "N", "baz")])
    at = s.index(lines, M.beyond_ascii(lines)).tolist()
    assert at == [0, 1, -1, 0, -1, 1] and [s.match(i, t) for i, t in zip(at, texts) if i >= 0] == ["x", "", "", ""]
    assert M.Searches([(True, "B", "bar")], True).index(pa.array(["BAR"]), M.beyond_ascii(pa.array(["BAR"]))).tolist() == [-1]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + " \t\n\r ;", max_size=30), min_size=1, max_size=8))
def test_text_functions(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.lines_of(F.col("t")).alias("lines"), T.collapse(F.col("t")).alias("c"), strip(F.col("t")).alias("s"), T.fit(F.col("t"), 10).alias("f")).collect()
    for r in rows:
        t = texts[r.i]
        lines = re.sub("\r\n|\r", "\n", t).split("\n")
        assert r.lines == (lines[:-1] if lines[-1] == "" else lines)
        assert r.c == " ".join(t.split()) and r.s == t.strip()
        assert r.f == (t if len(t) <= 10 else t[:2] + "..." + t[-5:])


NAMES = ["a.c", "A.C", "Makefile", ".hidden", "x.zip.001", "main.min.js", "b.h", "noext.", "..x", "m1"]


@pytest.mark.parametrize("one", ["*.c", "*", "NO_EXT", "EX:*.c:*.h", "RE:^M", "RE:m", "?.c", "[ab].*", "*.zip.*"])
def test_file_filters(spark, one):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n for r in df.where(P.matches(F.col("n"), one)).collect()}
    assert got == {n for n in NAMES if config.globbed(n, [one])}


def test_extensions(spark):
    import os

    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for r in df.select("n", P.extension(F.col("n")).alias("e"), P.is_non_code(F.col("n")).alias("x")).collect():
        assert r.e == os.path.splitext(r.n)[1]
        assert r.x == (r.n == "x.zip.001")


def test_measure_filters():
    names = ["fileName", "file.nbnc", "file.total", "search.line", "nbnc.crc"]
    assert P.filter_measures(names, ["*"]) == names
    assert P.filter_measures(names, ["file.*"]) == ["fileName", "file.nbnc", "file.total"]
    assert P.filter_measures(names, ["search.line"]) == ["fileName", "search.line"]


def test_ranks(spark):
    df = spark.createDataFrame([(0,), (4,), (200,), (201,), (5000,), (None,)], "v int")
    assert [r[0] for r in df.select(ranks.rank(F.col("v"), ranks.FILE_SIZE)).collect()] == ["1 to 200", "1 to 200", "1 to 200", "201 to 600", "1800+", ""]


CONFIG = r"""
# comment
CONSTANT:_CODE_: *.c;*.h
CONSTANT:_ALL_: _CODE_;*.cpp
measure Code * *.py OPT:PYTHON script OUT:py.csv   # trailing
IGNORE_START
nonsense
IGNORE_STOP
search Search search.* _ALL_ notes
    POSITIVE__todo \s+ (\w+)
    NEGATIVE__not
search_end
routines Code routine.* *.java \
OPT:DECISIONS:(\b(if|for)\b)
    void \s+ (\w+)
routines_end
INCLUDE:other.code: EXTRA OPT:IGNORE_SIZE:10
"""


def test_config():
    entries = config.parse(CONFIG, read=lambda p: "measure NBNC file.* *.py a\nmeasure Document * *.txt text\n")
    assert [(e.verb, e.module, e.file_filters) for e in entries] == [("measure", "Code", ("*.py",)), ("search", "Search", ("*.c", "*.h", "*.cpp")), ("routines", "Code", ("*.java",)), ("measure", "Document", ("*.txt",))]
    assert entries[0].out == "py.csv" and entries[0].plain_tags == ("script",) and entries[0].rules().python
    assert entries[1].params == ((True, r"POSITIVE__todo \s+ (\w+)", r"todo \s+ (\w+)"), (False, "NEGATIVE__not", "not"))
    assert entries[2].options[0][0] == "DECISIONS"
    assert entries[3].tags == ("text", "EXTRA") and entries[3].options == (("IGNORE_SIZE", "10"),)


@pytest.mark.parametrize("bad", ["measure Nope * *.c", "search NBNC * *.c", "measure Code * *.c OPT:WHAT", "measure Code", "measure Code * *.c;*.h\nmeasure Code file.* *.c", "CONSTANT:a: ab\nmeasure Code * a", "search Search * *\n(\nsearch_end", "measure Code * *.c OPT:MACHINE_DETECTORS:[[__import__('os').system('x'),None]]"])
def test_bad_configs(bad):
    with pytest.raises(config.ConfigError):
        config.parse(bad)


def test_config_details():
    """Lines that go on, constants in constants, blocks left open, includes of includes."""
    texts = {"a.code": "INCLUDE:b.code: X\nmeasure NBNC file.* *.a t\n", "b.code": "measure NBNC file.* *.b\n"}
    entries = config.parse("INCLUDE:a.code: Y\nCONSTANT:_E_:*.c\nCONSTANT:_F_:_E_;*.d\nmeasure Code file.* \\\n  _F_ \\\n  z # note\nsearch Search * *\n  x\n", read=texts.__getitem__)
    assert [(e.file_filters, e.tags) for e in entries] == [(("*.b",), ("X", "Y")), (("*.a",), ("t", "Y")), (("*.c", "*.d"), ("z",))]


def test_wanted_entries(spark):
    """Filters by extension go through a join, all others through conditions; both see what a glob sees."""
    filters = ["*.c", "*.C;*.h", "*.zip.*", "*", "NO_EXT", "EX:*.c:*.h", "RE:m", "?.c;*.h", "*."]
    entries = [config.parse_entry(f"measure NBNC file.* {f} t{i}") for i, f in enumerate(filters)]
    rows = config.wanted(spark.createDataFrame([(n,) for n in NAMES], "name string"), entries).collect()
    order = sorted(range(len(entries)), key=lambda i: str(entries[i]))
    assert {r.name: r["_wanted"] for r in rows} == {n: [i for i in order if config.globbed(n, list(entries[i].file_filters))] for n in NAMES}


def test_stack(spark):
    files = spark.createDataFrame([("/r", "a.c"), ("/r/x", "a.c"), ("/r/x/y", "b.py"), ("/r/z", "a.c"), ("/r/zz", "a.c")], "folder string, name string")
    root, deep = config.parse("measure Code * *.c"), config.parse("measure NBNC file.* *.py\nmeasure Document * *.c")
    joined, entries = config.Stack(root, {"/r/x": deep, "/r/z": []}).joined(files)
    got = sorted((r.folder, r.name, entries[r.entry].module) for r in joined.collect())
    assert got == [("/r", "a.c", "Code"), ("/r/x", "a.c", "Document"), ("/r/x/y", "b.py", "NBNC"), ("/r/zz", "a.c", "Code")]
