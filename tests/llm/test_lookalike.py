from conftest import rows

from tessella.llm import lookalike as L

BANK = "ord bigint, question struct<stem: string, choices: array<struct<label: string, text: string>>>"


def test_forms():
    cases = {
        "Ｗｉｄｅ，　１": "Wide, 1", "a b c": "a b c", "in​vis­ible﻿": "invisible", "é": "é", "ﬁne": "fine",
        "29.\U0001d7d2": "29.4", "thе оne": "the one", "саѕеѕ here": "cases here", "idiοm": "idiom", "Νearby": "Nearby", "Ⅳ": "IV",
    }
    for given, want in cases.items():
        assert L.unify(given) == want


def test_more_scripts_and_numbers():
    cases = {
        "a ɡraph": "a graph", "ıt is": "it is", "the ᴡord": "the word", "Ꭺ plain Ꭼnd": "A plain End", "ꓮ and ꓡist": "A and List", "ⲟne": "one",
        "1О0 and 10О": "100 and 100", "2ⅼ5": "215", "О5 left": "O5 left", "cafɡé": "cafgé", "weⅼⅼ": "well",
    }
    for given, want in cases.items():
        assert L.unify(given) == want and L.unify(want) == want
    for text in ("[ɡræf]", "kapı ve ağaç", "/wɜːd/", "ᴡᴏᴠ", "x ɑ"):
        assert L.unify(text) == text


def test_what_is_right_stays():
    for text in ("", "plain", "x²", "½ of it", "30 °C ≤ 5", "Δt and π", "Π", "café naïve façade", "The sign reads жёлтый.", "reads сор деньги", "a\tb\nc\r\n", "中文", "می‌خواهم", "\U0001f468‍\U0001f469"):
        assert L.unify(text) == text


def test_idempotent_and_long():
    text = "ａе́​ " * 50_000
    once = L.unify(text)
    assert L.unify(once) == once and len(once) == 150_000


def test_found_positions_and_nulls(spark):
    rows_ = [(0, ("a b", [("a", "ok"), None, ("b", None), ("c", "ａ")])), (1, None), (2, (None, None)), (3, ("plain", []))]
    df = spark.createDataFrame(rows_, BANK)
    assert rows(L.standins(df)) == [(0, "stem", 0), (0, "text", 4)]
    assert L.standins(df.limit(0)).count() == 0
    assert L.uniform_questions(df).count() == 4
