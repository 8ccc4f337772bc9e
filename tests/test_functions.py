from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from canonry.functions import conventions, naming, normalize, schedule, text

CORPUS = {
    "AT&T": "at&t", "AT&T ": "at&t", "  at&t": "at&t", "verizon\twireless": "verizonwireless", "verizon\n wireless": "verizon wireless",
    "café": "café", "café": "café", "Å": "å", "foo\x01bar": "foobar", "foo\x7fbar": "foobar", "foo\x85bar": "foobar", "   ": "", "": "",
    "multi   space   runs": "multi space runs", "trailing nbsp": "trailing nbsp", "emoji 🚀 value": "emoji 🚀 value", "ünïcode ÇASE": "ünïcode çase",
    "ΑΣ": "ας", "İstanbul": "i̇stanbul", "﻿bom x": "bom x", "a　b": "a b", "x​y": "x​y",
}


def test_normalize_value():
    assert {k: normalize.normalize_value(k) for k in CORPUS} == CORPUS
    assert normalize.normalize_value(None) == ""
    assert [normalize.is_blank_value(v) for v in (None, "", " ", "\t\n", "\x01", " ", "n/a", "0", " x ")] == [True] * 6 + [False] * 3


def test_normalize_column_equals_helper(spark):
    rows = spark.createDataFrame([(k,) for k in [*CORPUS, None]], "v string").select("v", normalize.normalize(F.col("v")).alias("n")).collect()
    assert all(r["n"] == (None if r["v"] is None else CORPUS[r["v"]]) for r in rows)


def test_value_normalize_in_sql(spark):
    normalize.register(spark)
    assert spark.sql("select value_normalize('  A  B ') n, value_normalize(null) m").first() == ("a b", None)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Mn", "Cc"))))
def test_normalize_idempotent(value):
    once = normalize.normalize_value(value)
    if once.isascii():
        assert normalize.normalize_value(once) == once


STYLES = [
    ("The Walt Disney Company", {"leading_articles": "strip"}, "Walt Disney Company"),
    ("AT&T Inc", {"corporate_suffix": "strip"}, "AT&T"),
    ("Acme Corp. Ltd", {"corporate_suffix": "strip"}, "Acme"),
    ("Inc", {"corporate_suffix": "strip"}, "Inc"),
    ("Acme Incorporated", {"corporate_suffix": "normalize"}, "Acme Inc."),
    ("A & B", {"ampersand": "spell_out"}, "A and B"),
    ("A&B", {"ampersand": "drop"}, "A B"),
    ("t-mobile usa", {"case": "title"}, "T-Mobile Usa"),
    ("IBM global", {"case": "title", "acronyms": "force_caps"}, "IBM Global"),
    ("a  b", {"spaces": "underscore"}, "a_b"),
    ("a b", {"spaces": "concatenate"}, "ab"),
    ("U.S.A. (x)", {"special_chars": "alnum_periods"}, "U.S.A.x"),
    ("Acme, Inc.!", {"trailing_punct": "strip"}, "Acme, Inc"),
    ("---", {"special_chars": "alnum_only"}, ""),
]


def full(rules):
    return {k: {"value": v} for k, v in rules.items()}


@pytest.mark.parametrize("name,rules,want", STYLES)
def test_apply_rules(name, rules, want):
    assert conventions.apply_rules(name, full(rules)) == want


def test_apply_rules_column(spark):
    for name, rules, want in STYLES:
        assert spark.createDataFrame([(name,)], "n string").select(conventions.apply_rules_column(F.col("n"), full(rules))).first()[0] == want


def test_violations():
    assert conventions.violations("", full({"case": "lower"})) == ["empty"]
    assert conventions.violations("---", full({"special_chars": "alnum_only"})) == ["no_content"]
    assert conventions.violations("Ab", full({"case": "lower"})) == ["form"]
    assert conventions.violations("a b", full({"word_count": "single"})) == ["words_over"]
    assert conventions.violations("abc", {"length": {"value": "range", "min": 1, "max": 2}}) == ["length_over"]
    assert conventions.clean_rules({"case": {"value": "odd"}, "x": 1, "length": {"value": "max", "max": "3.7"}}) == {"length": {"value": "max", "max": 3}}


@pytest.mark.parametrize("pattern", ["(a+)+b", "(a*)*", "(a+)*", r"(\d+)+", "(?:(a+))+", "(a|a)*", "(a{1,}){2,}", "(?=x)y", r"(a)\1"])
def test_unsafe_patterns(pattern):
    assert conventions.pattern_error(pattern)
    assert conventions.compile_pattern(pattern) is None


@pytest.mark.parametrize("pattern", ["^[A-Z][a-z]+$", "[A-Za-z ]+", "(abc)+", "(cat|dog)", "(a+){3}", "([a*+])+", r"(a\+)+", "^(?:cat|dog)$"])
def test_safe_patterns(pattern):
    assert conventions.pattern_error(pattern) is None


def test_matches(spark):
    compiled = conventions.compile_pattern("[a-z]+")
    assert [conventions.matches(compiled, x) for x in ("abc", "", "a" * 201, "aB")] == [True, False, False, False]
    assert conventions.matches(None, "anything")
    df = spark.createDataFrame([("abc",), ("aB",), ("a" * 201,)], "n string")
    assert [r[0] for r in df.select(conventions.matches_column(F.col("n"), "[a-z]+")).collect()] == [True, False, False]


def test_spec_errors():
    assert conventions.spec_errors({"description": "x"}) == []
    assert len(conventions.spec_errors({"description": " ", "standardization_rules": ["r"] * 21, "convention_type": "regex", "convention_value": "(a+)+", "seeds": [" "]})) == 4
    assert conventions.describe(full({"case": "title"})) == ["case: title"]


def test_naming(spark):
    df = spark.createDataFrame([(1, "Acme"), (1, "Acme Inc!!"), (1, "the Acme"), (2, "IBM")], "g long, v string")
    scores = naming.name_scores(df, "g", "v")
    best = {r["group"]: r["literal"] for r in naming.best_names(scores).collect()}
    assert best == {1: "Acme", 2: "IBM"}
    assert all(0 <= r["name_score"] <= 1 for r in scores.collect())
    assert naming.display_case("o'brien t-mobile") == "O'Brien T-Mobile" and naming.display_case("AT&T") == "AT&T"
    assert naming.parse_tokens('["a", " b "]') == ["a", "b"] and naming.parse_tokens("x") == [] and naming.parse_tokens(None) == []
    assert naming.proposed_name("a\nb") is None and naming.proposed_name(" x ") == "x" and len(naming.proposed_name("y" * 300)) == 200
    assert [naming.band(naming.confidence(c)) for c in ("h", "m", "l", None)] == ["h", "m", "l", "l"] and naming.worse("h", "l") == "l"


def test_schedule(spark):
    at = lambda d, h, m=0: datetime(2024, 1, d, h, m, tzinfo=timezone.utc)  # noqa: E731  1 January 2024 is a Monday
    office = schedule.DEFAULT
    assert [office.active(at(1, h, m)) for h, m in ((8, 59), (9, 0), (16, 59), (17, 0))] == [False, True, True, False]
    night = schedule.Schedule(days=(5,), start=22, end=6)
    assert night.active(at(5, 23)) and night.active(at(5, 2)) and not night.active(at(6, 2))
    assert schedule.Schedule(zone="Nowhere/Else").active(at(1, 10))
    assert not schedule.Schedule(zone="America/New_York").active(at(1, 10))
    assert office.label() == "Mon–Fri, 9 AM–5 PM" and schedule.Schedule("always").label() == "24/7" and schedule.Schedule(days=(0, 6), start=0, end=12).label() == "Sun, Sat, 12 AM–12 PM"
    assert schedule.parse(office.stored()) == office and schedule.parse("{") is None and schedule.parse_stored("x") == office
    assert schedule.parse({"type": "window", "days": [9], "start_hour": 1, "end_hour": 2}) is None
    assert [schedule.scan_tier(n) for n in (500_000, 10_000_000, 100_000_000)] == [1, 2, 10] and schedule.scan_tier(100_000_000, True) == 60
    assert [schedule.retuned_tier(ms) for ms in (200, 20_000)] == [1, 10] and schedule.backoff_minutes(9) == 60
    assert [c for c in range(40) if schedule.recheck_due(c, 0)] == [2, 6, 14, 24, 34]
    row = spark.sql("select timestamp'2024-01-05 23:00:00' t").select(night.column(F.col("t")), office.column(F.col("t"))).first()
    assert row == (True, False)


def test_text():
    assert text.lenient_json('```json\n{"a": 1}\n```') == {"a": 1}
    assert text.lenient_json('so: {"a": {"b": "}"}} done') == {"a": {"b": "}"}}
    assert text.lenient_json("{“a”: 2}") == {"a": 2} and text.lenient_json("none") is None
    assert [text.column_letter(i) for i in (0, 25, 26, 27, 51, 52, 701, 702)] == ["A", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA"]
    assert text.sheet_range("it's", "A1:B2") == "'it''s'!A1:B2"
    assert text.export_kind("odd") == "table" and text.standardized_name("c") == "c_STANDARDIZED"
    assert text.standardized_file("a.b.csv") == "a.b (standardized).csv" and len(text.map_name("e", "c")) == 16
    assert text.parse_table_name("a.b.c") == ("a", "b", "c") and text.parse_table_name("c") == (None, None, "c")
    with pytest.raises(ValueError):
        text.quoted("a`b")
    with pytest.raises(ValueError):
        text.parse_table_name("x.b.c", "a")
    assert text.marker_deletes("1:2:3") == 3 and text.marker_deletes("x") is None
    assert text.classify_error(ValueError("[PATH_NOT_FOUND] x")) == "table" and text.classify_error(OSError("reset by peer")) == "transient"


def test_sql_literals(spark):
    from canonry.functions.text import sql_literal

    for value in ("plain", "it's", "back\\slash", "\\'", "tab\tnew\nline", "", "é𝛼", '"', "%_"):
        assert spark.sql(f"SELECT {sql_literal(value)} AS v").first()["v"] == value
    assert sql_literal(None) == "NULL"
