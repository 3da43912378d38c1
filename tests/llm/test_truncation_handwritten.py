"""Cut texts and files not written by hand: planted cases in small corpora, odd rows."""

import random

import pytest

from lineweave.llm import handwritten, truncation

SENTENCES = ["I found that the {} cache was the cause, not the {}.", "If the {} is {}, then leave the whole thing alone.", "Have you checked whether the {} is open before you read it?", "There is an option called {} that does exactly this for every {}."]
WORDS = "kernel logger widget parser marker bundle vector session pointer fixture canvas monitor".split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(SENTENCES).format(rng.choice(WORDS), rng.choice(WORDS)) for _ in range(n))
    rows, cut = [], set()
    for i in range(700):
        text, source = prose(rng.randint(3, 8)), "free" if i % 2 else "limited"
        if i % 10 == 0:
            text += "\n\nBest regards"
        if i % 14 == 1:
            text += "\n\n```\nx = 1\ny = 2\n```"
        if source == "limited" and len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith((".", "?")):
                cut.add(i)
        rows.append((i, text, source, "en", len(text), 1))
    extra = {1000: "I found that the kernel cache was the cau", 1001: "There is an option called parser that does", 1002: "Look:\n\n```\nx = 1\n", 1003: "Have you checked whether the widget is (more)", 1004: None, 1005: "", 1006: "  \n", 1007: "See the answer above.", 1008: "If the kernel is open, then leave the whole…"}
    rows += [(i, t, "free", "en", None, 1) for i, t in extra.items()]
    return rows, cut | {1000, 1001, 1002, 1003, 1008}


def test_truncated(spark, corpus):
    rows, cut = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, token int").repartition(3, "doc_id")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    assert cut - got == set() or len(cut - got) <= 0.02 * len(cut)
    assert len(got - cut) <= 2
    shares = {r.source: r for r in truncation.share_by_source(df).collect()}
    assert shares["limited"].share > 0.5 > shares["free"].share and shares["free"].texts == 350 + len([t for t in (r[1] for r in rows if r[0] >= 1000) if t and t.strip()])  # blank texts are none
    assert truncation.truncated(df.limit(0)).count() == 0


def test_copies_of_a_cut_text(spark, corpus):
    rows, cut = corpus
    copies = [(2000 + i, "If the widget is open, then leave. I found that the kernel cache was the cau", "free", "en", None, 1) for i in range(300)]
    copies += [(3000 + i, "Have you checked? There is an option called marker that does", "free", "en", None, 1) for i in range(6)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, source string, lang string, n_chars long, token int").repartition(3, "doc_id")
    got = {r.doc_id for r in truncation.truncated(df).collect()}
    assert {r[0] for r in copies} <= got
    assert not got & {i for i, t, *_ in rows if t and i not in cut and t.endswith("Best regards")}


def test_share_of_formulas(spark):
    columns = "line_texts long, texts long, token string, whole long, longer long, ends5 long, on5 long, ends3 long, on3 long, final5 long, mark boolean, dots boolean, open boolean, closed boolean, url boolean, unbalanced boolean, at_limit boolean, stated long, chars long"
    row = lambda n, all_, whole, longer: (n, all_, "x", whole, longer, 0, 100, 0, 100, 0, False, False, False, False, False, False, False, 10, 10)
    df = spark.createDataFrame([row(60, 10_000, 5, 0), row(60 * 1000, 10_000 * 1000, 5, 0), row(6, 10_000, 5, 0), row(6 * 1000, 10_000 * 1000, 5, 0), row(60, 10_000, 0, 5)], columns)
    assert [r.cut for r in df.select(truncation._verdict().alias("cut")).collect()] == [False, False, True, True, True]


def test_long_last_lines(spark):
    same = "word " * 50
    assert truncation.line_key(same + "one end") != truncation.line_key(same + "one e") and truncation.line_key(same + "7") == truncation.line_key(same + "88") and truncation.line_key("a 12") == "a 0"
    # a long closing paragraph that many texts share, cut in one of them
    footer = "This message and all that is attached to it is meant for the reader it was sent to and for nobody else, and whoever gets it in error is asked to tell the sender at once, to delete every copy, and not to pass it on to any other person"
    rows = [(i, f"Question {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}.\n{footer}", "s", "en", None) for i in range(60)] + [(100, f"Question z y.\n{footer[: footer.index(' other person')]}", "s", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    ends = {r.doc_id: r for r in truncation.ends(df).collect()}
    assert ends[0].line_texts == 60 and ends[100].line_texts == 1
    assert [k for k, r in ends.items() if r.cut] == [100]


def test_subwords():
    assert truncation.subwords("young_driv") == ["young", "driv"] and truncation.subwords("ColdProxySna") == ["cold", "proxy", "sna"]


def _hand(rng):
    line = lambda: rng.choice(["def {0}({1}):", "    return {0}.{1}({2})", "    if {0} is None:", "# {0} and {1}", "    {0} = [{1}(x) for x in {2}]", "    raise ValueError('{0}')", "    with {0} as {1}:", "    for {0} in {1}.{2}():", "from {0} import {1}"]).format(*rng.sample(WORDS, 3)) + rng.choice(["", "  # " + rng.choice(WORDS)])
    return "\n".join(line() + str(rng.randint(0, 999)) for _ in range(24))


@pytest.fixture(scope="module")
def tree():
    rng = random.Random(9)
    library = [_hand(rng) for _ in range(4)]
    rows, made = [], set()
    for i in range(240):
        project, text, path = f"/repos/p{i % 12}", _hand(rng), f"src/{rng.choice(WORDS)}{i}.py"
        if i % 8 == 1:
            text, path = "# Code generated by Tool 1.2 from x.def\n" + "\n".join(f"FIELD_{k} = desc(name='a_{k}', number={k})" for k in range(20)), f"gen/{rng.choice(WORDS)}{i}_pb2.py"
            made.add(i)
        elif i % 8 == 2:
            text, path = "var a=1;" * 140, f"static/{rng.choice(WORDS)}{i}.min.js"
            made.add(i)
        elif i % 8 == 3:
            text, path = library[i % 4], f"third_party/lib/{'abcd'[i % 4]}{i}.py"
            made.add(i)
        elif i % 8 == 5:
            text = "import a\n# please do not edit while the nightly job runs\n" + text
        rows.append((i, f"{project}/{path}", path.rsplit("/", 1)[-1], path.rsplit(".", 1)[-1], len(text) * (200 if i % 8 == 2 else 1), bytearray(text.encode()), 1))
    rows += [(900, "/repos/p1/gen/unread_pb2.py", "unread_pb2.py", "py", 4000, None, 1), (901, "/repos/p1/src/unread.py", "unread.py", "py", 4000, None, 1), (902, "/repos/p1/src/empty.py", "empty.py", "py", 0, bytearray(b""), 1), (903, None, None, None, None, None, 1)]
    return rows, made | {900}


def test_not_hand_written(spark, tree):
    rows, made = tree
    df = spark.createDataFrame(rows, "file_id long, path string, name string, ext string, size long, content binary, kind int")
    measures = spark.createDataFrame([(r[0], r[1], r[2], "." + (r[3] or "x"), None, 30, 2 if r[2] and "min" in r[2] else 40, r[4]) for r in rows if r[0] != 903] * 2, "file_id long, file_full_name string, file_name string, file_type string, file_machine long, file_nbnc long, file_total long, file_bytes long")
    got = {r.file_id for r in handwritten.not_hand_written(df, measures).collect()}
    assert got == made
    assert handwritten.not_hand_written(df.limit(0), measures.limit(0)).count() == 0


def test_mangled_names_in_short_lines(spark):
    rng = random.Random(10)
    rows = [(i, f"/repos/p{i % 12}/src/{rng.choice(WORDS)}{i}.js", "js", bytearray(_hand(rng).encode())) for i in range(120)]
    part = lambda: "function {}({},{}){{return {}.{}({})}}".format(*("".join(rng.choices("abcdefghijkqxzXYZ", k=rng.choice([1, 1, 2, 3]))) for _ in range(6)))
    mangled = {200 + i: "\n".join(";".join(part() for _ in range(rng.randint(1, 3))) for _ in range(14)) for i in range(60)}
    rows += [(k, f"/repos/p{k % 12}/src/{rng.choice(WORDS)}{k}.js", "js", bytearray(x.encode())) for k, x in mangled.items()]
    df = spark.createDataFrame([(k, p, e, len(x), x) for k, p, e, x in rows], "file_id long, path string, ext string, size long, content binary")
    measures = spark.createDataFrame([], "file_id long, file_full_name string, file_name string, file_type string, file_machine long, file_nbnc long, file_total long, file_bytes long")
    measures = measures.unionByName(df.selectExpr("file_id", "path file_full_name", "path file_name", "'.js' file_type", "cast(null as long) file_machine", "20L file_nbnc", "24L file_total", "size file_bytes"))
    got = {r.file_id: r.kind for r in handwritten.judged(df, measures).where("machine_made").collect()}
    assert set(got) == set(mangled) and set(got.values()) <= {"minified", "data"} and list(got.values()).count("minified") >= 55


def test_part_of_another_head(spark):
    lines = [f"{w}_{i} = {v}({i})" for i, (w, v) in enumerate((w, v) for w in WORDS for v in WORDS[:4])]
    own = [[f"{w}.{v}({i}, {k})" for i, (w, v) in enumerate((w, v) for w in WORDS for v in WORDS[:2])][:20] for k in range(3)]
    texts = {1: "\n".join(lines[:42]), **{10 + i: "\n".join(lines[i * 5 : i * 5 + 17]) for i in range(5)}, **{20 + k: "\n".join(x) for k, x in enumerate(own)}}
    df = spark.createDataFrame([(k, f"/repos/p{k}/src/a{k}.py", "py", len(x), bytearray(x.encode())) for k, x in texts.items()], "file_id long, path string, ext string, size long, content binary")
    measures = spark.createDataFrame([], "file_id long, file_full_name string, file_name string, file_type string, file_machine long, file_nbnc long, file_total long, file_bytes long")
    for one in range(10, 15):
        got = {r.file_id: r.foreign for r in handwritten.judged(df.where(f"file_id in (1, {one}) or file_id >= 20"), measures).collect()}
        assert got[one] == 1.0 and 15 / 42 <= got[1] <= 15 / 39 and got[20] == 0.0


def test_trigrams_beyond_the_broadcast_ones(spark, tree, monkeypatch):
    rows, made = tree
    text = "\n".join(f"größe_{a} = zähler_{b}(qzx{b})" for a, b in zip(WORDS, WORDS[1:], strict=False))
    rows = rows + [(1000 + i, f"/repos/q{i}/src/rare{i}.Rare", f"rare{i}.Rare", "Rare", len(text) + i, bytearray(("x" * i + text).encode()), 1) for i in range(4)]
    rows += [(1000, "/repos/q0/src/rare0.Rare", "rare0.Rare", "Rare", len(text), bytearray(text.encode()), 1)]  # delivered twice
    df = spark.createDataFrame(rows, "file_id long, path string, name string, ext string, size long, content binary, kind int")
    measures = spark.createDataFrame([], "file_id long, file_full_name string, file_name string, file_type string, file_machine long, file_nbnc long, file_total long, file_bytes long")

    def judge(most):
        monkeypatch.setattr(handwritten, "MOST_GRAMS", most)
        return sorted((r.file_id, r.bits, r.usual_bits or 0.0, r.kind or "", r.evidence or "") for r in handwritten.judged(df, measures).select("file_id", "bits", "usual_bits", "kind", "evidence").collect())

    whole = judge(400_000)
    assert len(whole) == len(rows) and any(r[1] > 0 for r in whole if r[0] >= 1000)
    for most in (1, 40):
        part = judge(most)
        assert [(r[0], *r[3:]) for r in part] == [(r[0], *r[3:]) for r in whole]
        assert [r[1:3] for r in part] == [pytest.approx(r[1:3], abs=1e-9) for r in whole]


def test_folders_of_a_deep_path(spark):
    deep = "/repos/p/" + "/".join(f"{w}{v}" for w in WORDS[:10] for v in "abcdefgh")
    df = spark.createDataFrame([(f"{deep}/Gen/a.py", 1.0), ("/repos/p/src/a.py", 1.0), ("a.py", 1.0), (None, 1.0)], "path string, per_line double").selectExpr("path", "per_line", "cast(null as int) machine", "1 total", "1 nbnc")
    got = [{t for t in r.traits if t.startswith("dir:")} for r in df.select(handwritten._trait_list().alias("traits")).collect()]
    assert "dir:gen" in got[0] and len(got[0]) == 81 and got[1:] == [{"dir:src"}, set(), set()]


def test_traits_of_heads():
    assert handwritten.head(None, False) == {} and handwritten.head(b"", False) == {}
    assert handwritten.periodicity(handwritten.skeletons("\n".join(f"x[{i}] = {i * 3};" for i in range(12)))) == 1
    assert handwritten.decode("é".encode("utf-16")) == "é" and handwritten.decode(b"\xe9t\xe9 und mehr") == "été und mehr"
