from datetime import date

import pytest

from epistola.functions.text import fold_text, glob_pattern, spellings, words
from epistola.lang import terms as T


def test_terms():
    assert T.lex('von:müller "neue rechnung" -werbung') == [T.Term("von", "müller"), T.Term(None, "neue rechnung"), T.Term(None, "werbung", True)]
    assert T.parse("") == []
    assert T.parse("farbe:rot") == [T.Free("farbe rot")]
    assert T.parse("hat:humor") == [T.Free("hat humor")]
    assert T.parse("nur-an:x")[0] == T.Free("nur-an:x") or isinstance(T.parse("nur-an:x")[0], T.Free)


def test_literals():
    assert T.parse("jahr:2025-2020") == [T.Compare("year", "between", 2020, False, 2025)]
    assert T.read_date("14.03.69") == date(1969, 3, 14)
    assert T.read_date("2024-02-29") == date(2024, 2, 29)
    assert T.read_size(">1,5MB") == (">", 1572864)
    assert T.read_size("10") == (">=", 10)
    for wrong in ("jahr:x", "seit:1/2/2024", "groesse:viel", "wichtigkeit:egal"):
        with pytest.raises(T.QueryError):
            T.parse(wrong)


def test_literals_that_are_taken():
    assert T.parse("wichtigkeit:dringend") == T.parse("wichtigkeit:hoch") and T.parse("priority:mittel") == T.parse("wichtigkeit:normal")
    assert T.parse("jahr:999") == [T.Compare("year", "=", 999)] and T.parse('jahr:"2020 - 2024"') == [T.Compare("year", "between", 2020, False, 2024)]
    assert T.parse("archiviert:202") == [T.Compare("captured", "starts", "202")] and T.parse("archiviert:25.08.2026") == [T.Compare("captured", "starts", "2026-08-25")]
    assert T.read_size("<3k") == ("<", 3072)


@pytest.mark.parametrize(
    ("expression", "terms"),
    [
        ('-"a b"c', [T.Term(None, "a b", True), T.Term(None, "c")]),
        ("- x", [T.Term(None, "-"), T.Term(None, "x")]),
        ("von: x", [T.Term(None, "von:"), T.Term(None, "x")]),
        ('von:"" x', [T.Term(None, "x")]),
        ('"offen a', [T.Term(None, '"offen'), T.Term(None, "a")]),
        ("GRÖSSE:>1MB -typ:pdf", [T.Term("grösse", ">1MB"), T.Term("typ", "pdf", True)]),
        ("a1:b", [T.Term(None, "a1:b")]),
    ],
)
def test_terms_at_the_edges(expression, terms):
    assert T.lex(expression) == terms


def test_short_value_uses_words():
    assert T.parse("betreff:ab") == [T.Phrase("subject", "ab")]
    assert T.parse("betreff:abc") == [T.Part("subject", "abc")]


def test_spellings():
    assert "für" in spellings("fuer") and "strasse" in spellings("Straße")
    assert spellings("Straße")[0] == "Straße" and len(spellings("ueueueueue aeaeae")) <= 8


def test_spellings_go_one_way():
    assert spellings("für") == ["für"] and spellings("müller") == ["müller"]
    assert spellings("mueller") == ["mueller", "müller"] and spellings("Maße") == ["Maße", "masse"]
    assert spellings("Strassenmueller")[:3] == ["Strassenmueller", "straßenmueller", "strassenmüller"] and "straßenmüller" in spellings("Strassenmueller")


def test_words_and_folding():
    assert words("Rückvergütung, 7.") == ["ruckvergutung", "7"]
    assert fold_text("ß") == "ß" and words("*()") == []


def test_globs():
    import re

    assert re.fullmatch(glob_pattern("*.p?f"), "a.pdf") and not re.fullmatch(glob_pattern("a[^b]"), "ab")
    assert re.fullmatch(glob_pattern("a[!b]", "!"), "ac")


def test_form():
    values = {"words": "rechnung mahnung", "von": "müller", "not": "werbung spam", "jahr": "2024"}
    assert T.to_form(T.from_form(values)) == values
    assert T.to_form("-von:x") is None


def test_form_of_a_phrase():
    values = {"begriff": "neue rechnung", "von": "müller", "mit_anhang": "on", "typ": ".pdf", "archiviert": "2026", "ohne": "werbung spam", "fremd": "x"}
    made = T.from_form(values)
    assert made == '"neue rechnung" von:müller typ:pdf archiviert:2026 hat:anhang -werbung -spam'
    assert T.phrase_form(made) == {"begriff": "neue rechnung", "von": "müller", "mit_anhang": "1", "typ": "pdf", "archiviert": "2026", "ohne": "werbung spam"}
    assert T.phrase_form("rechnung müller") is None and T.phrase_form("rechnung") == {"begriff": "rechnung"}
    assert T.from_form({"mit_anhang": "nein"}) == ""
