"""Leaks: passages by length, form and replacement against brute force, re-parameterised items, odd rows."""

import random
import re

import numpy as np
import pytest

from lineweave.llm import leakage

ITEM = "Some loose kernel in Trihex holds 936 narrow driquils and loses 16 of them every calgil morning. The second grahal may resolve only after 44 buffers have left Tensel. Which sheet of Yorwilcal will derive the 66th yorkor first?"
OTHER = "Nobody in Lamnex has seen a lamnex rotate more than 462 odd canvass. No active signal can shift two beljuns unless Normarmel lies 31 leagues away. How many wextals remain in Lorjun after 80 final days?"
W = ITEM.split()


def wrap(words, prefix, width=6):
    return "\n".join(prefix + " ".join(words[i : i + width]) for i in range(0, len(words), width))


FOUND = {
    "whole": ITEM, "eighteen": " ".join(W[3:21]), "lower": re.sub(r"[^\w\s]", "", ITEM).lower(), "upper": ITEM.upper(), "quoted": wrap(W, "> "), "comment": wrap(W, " * "), "hash": wrap(W, "# "), "markup": "<p>" + ITEM.replace(". ", ".</p>\n<p><b>") + "</b></p>",
    "json": '{"prompt": "' + ITEM.replace(". ", ".\\n") + '"}', "spaces": "\xa0 ".join(W), "entities": ITEM.replace(",", "&#44;").replace("'", "&apos;"), "replaced": " ".join("strange" if i in (12, 25) else w for i, w in enumerate(W)), "numbered": "1. " + ITEM.replace(". ", ".\n2. "), "percent": ITEM.replace(" ", "%20"),
}
NOT_FOUND = {"seventeen": " ".join(W[3:20]), "third replaced": " ".join("strange" if i % 3 == 0 else w for i, w in enumerate(W)), "same style": ITEM.replace("936", "12").replace("Trihex", "Zanfloval").replace("driquils", "zanpels").replace("calgil", "kornor").replace("narrow", "wide").replace("kernel", "logger").replace("grahal", "zanpel").replace("resolve", "accept").replace("44", "7").replace("buffers", "streams").replace("Tensel", "Korgil").replace("sheet", "query").replace("derive", "bind").replace("yorkor", "calcor"), "empty": ""}


@pytest.fixture(scope="module")
def templates():
    return leakage.Templates([(1, ITEM), (2, OTHER), (3, None), (4, "too short")])


@pytest.mark.parametrize("name", FOUND)
def test_found(templates, name):
    text = "Something before this, and then.\n\n" + FOUND[name] + "\n\nAnd something after it."
    assert [i for i, *_, literal in templates.alignments(text, 18, 13) if literal] == [1]


@pytest.mark.parametrize("name", NOT_FOUND)
def test_not_found(templates, name):
    assert not [i for i, *_, literal in templates.alignments("Before. " + NOT_FOUND[name] + " after", 18, 13) if literal]


def test_reparameterised(templates):
    text = ITEM.replace("936", "12").replace("16 of", "99 of").replace("44", "7").replace("66th", "3rd").replace("Trihex", "Lamnex")
    got = {i: literal for i, *_, literal in templates.alignments(text, 36, 13)}
    assert got == {1: False}


def rewritten(text, rng):
    """All numbers, names and units of an item replaced, the same value by the same value."""
    given = {}

    def other(kind, value):
        if (kind, value) not in given:
            given[kind, value] = str(rng.randint(100_000, 999_999)) if kind == "number" else "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(4))
        return given[kind, value]

    out = re.sub(r"(?<=[a-z,;] )([A-Z]\w+)", lambda m: other("name", m[1]).capitalize(), text)
    out = re.sub(r"\b(\d+) ([a-z]{4,}s)\b", lambda m: f"{m[1]} {other('unit', m[2])}s", out)
    return re.sub(r"\b\d+\b", lambda m: other("number", m[0]), out)


def test_reparameterised_recall_and_precision(sf):
    """Whole items with new numbers, names and units, as no item has them, are found; so are they in the middle of another text. Documents of the corpus are not."""
    import pyarrow.parquet as pq

    rng = random.Random(11)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist() if r["text"] and len(r["text"].split()) >= 18]
    own = leakage.Templates(items)
    found = rewritten_only = wrong = 0
    for item, text in items:
        new = rewritten(text, rng)
        assert not any(w in own.ids for w in re.findall(r"\d{6}", new))
        got = {i: literal for i, *_, literal in own.alignments(f"Somebody asked me this. {new} I do not know.", 18, 13)}
        found += item in got
        rewritten_only += not got.get(item, True)
        wrong += len(set(got) - {item})
    # an item with few slots can hold eighteen words of which one in ten is another: that is literal
    assert found >= 0.98 * len(items) and rewritten_only >= 0.5 * len(items) and wrong <= 0.1 * found
    docs = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()
    assert sum(1 for t in docs for *_, literal in own.alignments(t, 18, 13) if not literal) <= 0.02 * len(docs)
    swapped = ITEM.replace("936", "12").replace("16 of", "12 of").replace("44", "7").replace("66th", "3rd")
    assert leakage.Templates([(1, ITEM)]).template_windows and not [1 for *_, literal in leakage.Templates([(1, ITEM)]).alignments(swapped, 40, 13) if not literal]  # 936 and 16 both became 12


def test_short_items(templates):
    """An item of eighteen words with both numbers replaced."""
    item = "If 12 workers repair the old engine in 7 days then how many days would one of them need?"
    own = leakage.Templates([(5, item)])
    assert [(i, literal) for i, *_, literal in own.alignments("Ask. " + item.replace("12", "35").replace("7", "90"), 18, 13)] == [(5, False)]


def test_tables_of_numbers():
    """A table of numbers is not everywhere alike: time and memory stay small, a quoted stretch of it is found."""
    import time

    rng = random.Random(5)
    table = " ".join(str(rng.randint(0, 9)) for _ in range(2000))
    own = leakage.Templates([(1, table), (2, "0 " * 500)])
    began = time.time()
    assert [i for i, *_, literal in own.alignments("see " + table[1000:1100] + " and so on", 18, 13) if literal] == [1]
    assert [i for i, *_, literal in own.alignments("x " + "0 " * 3000 + "y", 18, 13) if literal] == [2]
    assert not list(own.alignments(" ".join(str(rng.randint(10, 99)) for _ in range(20_000)), 18, 13)) and time.time() - began < 5


def test_longest_against_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        same = np.array([rng.random() < 0.85 for _ in range(rng.randint(0, 45))], bool)
        best = 0
        for i in range(len(same)):
            for j in range(i + 8, len(same) + 1):
                if same[i] and same[j - 1] and (~same[i:j]).sum() * 10 <= j - i:
                    best = max(best, j - i)
        assert leakage.longest(same, 8)[0] == best


def test_rows(spark):
    docs = spark.createDataFrame([(10, FOUND["quoted"], 1), (10, FOUND["quoted"], 1), (11, None, 1), (12, "", 1), (13, OTHER + " " + ITEM, 1), (14, "x " * 200_000, 1), (None, ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "a"), (2, OTHER, "b"), (3, None, "c"), (None, ITEM, "d")], "item_id long, text string, words string")
    want = {(1, 10), (1, 13), (2, 13)}
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(docs, items).where("literal").collect()} == want
    assert {(r.item_id, r.doc_id) for r in leakage.leaks(docs, items, block_words=20).where("literal").collect()} == want
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0
