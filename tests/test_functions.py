import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracery.functions import ids, text


def values(spark, rows, column):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r.v for r in frame.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_safe_path(spark):
    cases = {"a/b": "a/b", " a\\b ": "a/b", "./a//b/.": "a/b", "/a": None, "../a": None, "a/../b": None, "C:/a": None, "c:a": None, "": None, ".": None, "a\0b": None, "é/ü.md": "é/ü.md", "\\a": None, "a/..b": "a/..b"}
    assert values(spark, list(cases), ids.safe_path) == list(cases.values())


def test_slug(spark):
    assert values(spark, ["Hello, World!", "  É-Ü 2 ", "", "a__b", "日本 語"], ids.slug) == ["hello-world", "é-ü-2", "", "a-b", "日本-語"]


def test_links(spark):
    raw = ["a#b|c", " note ", "src/x.rs#fn:run", "a##b", "a#|x", "source:a#L3-L9"]
    assert values(spark, raw, ids.link_target) == ["a", "note", "src/x.rs", "a", "a", "source:a"]
    assert values(spark, raw, ids.link_fragment) == ["b", None, "fn:run", "#b", None, "L3-L9"]
    assert values(spark, raw, ids.link_alias) == ["c", None, None, None, "x", None]
    assert values(spark, ["L1", "L0", "L2-L3", "L2-3", "x", "L+01"], ids.is_line_fragment) == [True, False, True, False, False, True]


def test_decision_ids(spark):
    cases = {"ADR-0001": True, "ADR-1": False, "ADR-20240229-x": True, "ADR-20230229-x": False, "adr-0001": False, "ADR-20240101-": False, "ADR-20240101-a-b": True}
    assert values(spark, list(cases), ids.is_decision_id) == list(cases.values())


def test_percent(spark):
    raw = ["a b", "é~x", "A.b-c_d", "1+2", "%"]
    coded = values(spark, raw, ids.percent_encoded)
    assert coded == ["a%20b", "%C3%A9~x", "A.b-c_d", "1%2B2", "%25"]
    assert values(spark, coded, ids.percent_decoded) == raw
    assert values(spark, ["%2", "%zz"], ids.percent_decoded) == [None, None]


def test_selector(spark):
    row = spark.range(1).select(ids.selector_parts(ids.callable_selector(F.lit("A.B"), F.lit("function"), F.lit("go?"), F.lit(2))).alias("x")).first().x
    assert (row.module, row.kind, row.name, row.arity) == ("A.B", "function", "go?", 2)


@pytest.mark.parametrize(
    "glob,yes,no",
    [("src/*.rs", ["src/a.rs"], ["src/a/b.rs", "src/a.rsx"]), ("**/x", ["x", "a/x", "a/b/x"], ["ax"]), ("a/**", ["a/b", "a/b/c"], ["b/a"]), ("a\\*", ["a*"], ["ab"]), ("{a,b}/?", ["a/x", "b/y"], ["c/x", "a/xy"]), ("[!a]b", ["cb"], ["ab"])],
)
def test_globs(glob, yes, no):
    import re

    assert all(re.match(text.glob_regex(glob), x) for x in yes) and not any(re.match(text.glob_regex(glob), x) for x in no)


def test_invalid_globs():
    for bad in ("a[", "{a"):
        with pytest.raises(ValueError):
            text.glob_regex(bad)
    assert text.glob_prefix("src/a*/b") == "src/" and text.glob_prefix("src/a") == "src/a"


def test_scores(spark):
    rows = ["src/main.rs", "main.rs", "a/main.rs", "src/main.rs.bak", "xmain.rs", "m/a/i"]
    assert values(spark, rows, lambda p: text.source_match_score(F.lit("main.rs"), p)) == [90000, 100000, 90000, 69985, 59991, None]
    assert values(spark, ["a/b", "xaxb", "ba"], lambda t: text.fuzzy_score(F.lit("ab"), t)) == [22, 6, None]


def test_escapes_and_lines(spark):
    assert values(spark, ["a%b\r\nc:d,e"], text.github_escaped) == ["a%25b%0D%0Ac:d,e"]
    assert values(spark, ["a:b,c"], lambda x: text.github_escaped(x, True)) == ["a%3Ab%2Cc"]
    assert values(spark, ["a\nb\n"], lambda x: text.line_number(x, F.lit(2))) == [2]
    assert values(spark, ["a🙂b"], text.utf16_length) == [4]


@settings(max_examples=10, deadline=None)
@given(st.text(max_size=20))
def test_any_value_survives_percent_coding(spark, x):
    x = x.encode("utf-8", "ignore").decode()
    assert values(spark, values(spark, [x], ids.percent_encoded), ids.percent_decoded) == [x]
