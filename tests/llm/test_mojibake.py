"""Garbled text: round trips through wrong encodings, text that is merely foreign, odd rows."""

import pytest

from lineweave.llm import mojibake

CLEAN = ["größe prüfen", "höchstens fünf Einträge", "où est passé le répertoire", "vérifier l’élément", "año de la última revisión", "проверить длину очереди", "следующий шаг", "επόμενη γραμμή", "値の範囲を確認する", "設定ファイル", "žluťoučký kůň", "şube kodu değer", "price in € or £", "fold • wrap"] * 12
WRONG = [("größe", "utf-8", "cp1252"), ("répertoire", "utf-8", "mac_roman"), ("répertoire", "utf-8", "cp437"), ("проверить", "utf-8", "cp1251"), ("следующий", "koi8_r", "cp1251"), ("очереди", "cp1251", "cp1252"), ("γραμμή", "cp1253", "cp1252"), ("確認する", "utf-8", "cp1252"), ("範囲を確認する", "euc_jp", "latin-1")]


@pytest.fixture(scope="module")
def model():
    counts = {}
    for t in CLEAN:
        for w in t.split():
            for g in mojibake.grams(w):
                counts[g] = counts.get(g, 0) + 1
    return mojibake.Plausibility(counts, sum(counts.values()))


@pytest.mark.parametrize("word,written,read", WRONG)
def test_round_trip(model, word, written, read):
    garbled = word.encode(written).decode(read, "keep_c1" if read.startswith("cp125") else "strict")
    found, gain, path = mojibake.restore(garbled, model)
    assert found == word and gain > mojibake.MARGIN and path


def test_twice(model):
    twice = "größe".encode().decode("cp1252", "keep_c1").encode().decode("cp1252", "keep_c1")
    assert mojibake.restore(twice, model)[0] == "größe"


def test_foreign_text_stays(model):
    for t in CLEAN:
        for w in t.split():
            assert mojibake.restore(w, model)[1] < mojibake.MARGIN, w


def test_parts_of_a_token(model):
    assert mojibake._utf8_within("dÃ©jÃ", "cp1252") == "déjÃ"


def test_rows(spark):
    rows = [("t", i, t, 0) for i, t in enumerate(CLEAN)] + [("t", 1000, "grÃ¶Ã\x9fe prüfen", 1), ("t", 1000, "grÃ¶Ã\x9fe prüfen", 1), ("t", 1001, "gr��e", 2), ("t", 1002, None, 3), ("t", 1003, "", 4), ("u", 1004, "plain", 5), ("u", None, "grÃ¶Ã\x9fe", 6), ("u", 1005, "x" * 50_000 + " grÃ¶Ã\x9fe", 7)]
    df = spark.createDataFrame(rows, "table_name string, row_id long, text string, token int")
    got = {(r.table_name, r.row_id): r for r in mojibake.garbled_rows(df).collect()}
    assert set(got) == {("t", 1000), ("t", 1001), ("u", 1005)}
    assert got["t", 1000].restored == "größe prüfen" and got["t", 1000].whole and not got["t", 1001].whole
    assert mojibake.garbled_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("word,read", [("größe", "cp1252"), ("où", "cp1252"), ("répertoire", "mac_roman"), ("répertoire", "cp437"), ("проверить", "cp1251"), ("© größe", "latin-1")])
def test_garbled_in_a_third_of_the_rows(spark, word, read):
    garbled = word.encode().decode(read, "keep_c1" if read.startswith("cp125") else "strict").replace("\xc2\xa0", "")
    rows = [("t", i, t) for i, t in enumerate(CLEAN)] + [("t", 1000 + i, garbled) for i in range(len(CLEAN) // 2)]
    got = {r.row_id: r.restored for r in mojibake.garbled_rows(spark.createDataFrame(rows, "table_name string, row_id long, text string")).collect()}
    assert got == {1000 + i: word for i in range(len(CLEAN) // 2)}


def test_clean_words_are_counted():
    for word in ("größe", "l’école", "qu’à", "шаг", "Её", "値の範囲", "•", "CAFÉ"):
        assert not mojibake.reads_as_utf8(word), word


@pytest.mark.parametrize("text,restored", [("gr&Atilde;&para;&Atilde;&#159;e", "größe"), ("gr\\u00c3\\u00b6\\u00c3\\u009fe", "größe"), ("gr%C3%83%C2%B6%C3%83%C2%9Fe", "größe"), ("r=C3=83=C2=A9pertoire", "répertoire"), ("gr%C3%B6%C3%9Fe", None), ("gr=C3=B6=C3=9Fe", None), ("gr&ouml;&szlig;e", None), ("gr\\u00f6\\u00dfe", None), ("\\xc3\\xb6\\xc3\\x9f", None), ("\\x89PNG\\xff\\xd8\\xfe", None), ("a&&b||c;", None), ("%C3%C3", None)])
def test_escaped(model, text, restored):
    """Escapes of garbled text are garbled text; escapes of sound text and of bytes are not."""
    got = mojibake.restore_escaped(text, model)
    assert (got[0] if got else None) == restored


def test_tokens_within_tokens(spark):
    """A garbled token that is part of another, sound or garbled, is replaced where it stands alone."""
    bad = "größe".encode().decode("cp1252", "keep_c1")
    rows = [("t", i, t) for i, t in enumerate(CLEAN)] + [("t", 1000, f"{bad}\t x{bad}x  {bad} caf&Atilde;&copy; é")]
    got = {r.row_id: r.restored for r in mojibake.garbled_rows(spark.createDataFrame(rows, "table_name string, row_id long, text string")).collect()}
    assert got == {1000: "größe\t xgrößex  größe café é"}
