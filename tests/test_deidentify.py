"""Labels in notes: aliases, exceptions, names, and a plain search over thousands of names."""

import random
import re

import pytest

from tessera.quality import deidentify as deid

CONFIG = {
    "alias": {"d": "[0-9]", "year": "${d}${d}", "date": r"\b${year}\.${d}{2}\.${d}{2}\b"},
    "items": [
        {"DATE": [{"short": {"pattern": "${date}", "exception": "^99"}}]},
        {"ID": [{"ward": {"pattern": r"ward (?P<__n>${d}+)"}}, {"number": {"pattern": r"(?<!\S)${d}{6,8}(?!\S)"}}]},
    ],
}


def test_aliases_exceptions_and_lines():
    rules = deid.Rules(CONFIG)
    assert deid.label_line("24.08.01 seen, 99.01.01 not", rules) == "<DATE>24.08.01</DATE> seen, 99.01.01 not"
    assert deid.label_line("WARD 12 and 123456", rules) == "<ID>WARD 12</ID> and <ID>123456</ID>"
    tagged = deid.Rules({**CONFIG, "format": True, "tag": "deid"})
    assert deid.label_line("ward 3", tagged) == '<deid item="ID" format="ward">ward 3</deid>'
    assert deid.label_line("", rules) == "" and deid.label_line("x", deid.Rules({"items": [{"A": [{"b": {"pattern": "y*"}}]}]})) == "x"
    with pytest.raises(KeyError, match="no alias"):
        deid.expand_aliases("${x}", {})
    with pytest.raises(ValueError, match="holds itself"):
        deid.expand_aliases("${x}", {"x": "${y}", "y": "${x}"})


def test_names_are_words_and_patterns_come_first():
    rules, names = deid.Rules(CONFIG), deid.build_names([("Kim", "NAME"), ("Kim Lee", "NAME"), ("ward 12", "PLACE"), ("a-b", "CODE"), ("İz", "NAME")])
    assert deid.label_line("kim lee met KIM, Kimchi, a-b and xa-b", rules, names) == "<NAME>kim lee</NAME> met <NAME>KIM</NAME>, Kimchi, <CODE>a-b</CODE> and xa-b"
    assert deid.label_line("ward 12, İZ", rules, names) == "<ID>ward 12</ID>, İZ".replace("İZ", "<NAME>İZ</NAME>")
    assert deid.build_names([]) is None


def test_thousands_of_names_against_a_plain_search(spark):
    rng = random.Random(6)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(3000)})
    texts = [None, "", *["\n".join(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(12)) for _ in range(4)) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r["i"]: r["labelled"] for r in deid.label_notes(df, "text", {"items": []}, [(n.upper(), "N") for n in names]).collect()}
    known = set(names)
    for i, t in enumerate(texts):
        assert found[i] == (None if t is None else re.sub("[abc]+", lambda m: f"<N>{m[0]}</N>" if m[0] in known else m[0], t))


def test_lists_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(deid, "MOST_NAMES", 3)
    with pytest.raises(ValueError, match="parts of the list"):
        deid.label_notes(spark.createDataFrame([("x",)], "text string"), "text", {"items": []}, [("abcd", "N")])
