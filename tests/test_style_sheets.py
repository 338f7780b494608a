import pytest
from pyspark.sql import functions as F

from folioworks.operators import style_sheets as T
from folioworks.plans import style_queries as Q


@pytest.mark.parametrize(
    "css,want",
    [
        ("", []),
        ("/* p { color: red } */", []),
        ("p { color: red; } q{}", [("p", ["color: red"]), ("q", [])]),
        ("p { background: url(a;b}c.png); content: '}' ; x }", [("p", ["background: url(a;b}c.png)", "content: '}'"])]),
        ("@media x { p { a: b ! important } @media y { q { c: d } } } r { e: f", [("p", ["a: b!"]), ("q", ["c: d"]), ("r", ["e: f"])]),
        ("@import 'a;b'; @charset \"x\"; p {a:b}", [("@import 'a;b'", []), ('@charset "x"', []), ("p", ["a: b"])]),
        ("} } p { a: b }", [("p", ["a: b"])]),
        ("p:not(.a, .b), [x='1,2'] { a: b }", [("p:not(.a, .b), [x='1,2']", ["a: b"])]),
    ],
)
def test_parse(css, want):
    assert [(r["prelude"], [f"{d['property']}: {d['value']}{'!' if d['important'] else ''}" for d in r["declarations"]]) for r in T.parse_sheet(css)] == want


def test_selectors():
    s = {x["text"]: x["compounds"] for x in T._selectors("ns|Svg.a#b::BEFORE, *:hover > p:first-letter , p:not(.a, .b), ##, a[href='x,y'] b")}
    assert list(s) == ["ns|Svg.a#b::BEFORE", "*:hover > p:first-letter", "p:not(.a, .b)", "a[href='x,y'] b"]
    first = s["ns|Svg.a#b::BEFORE"][0]
    assert (first["tag"], first["namespace"], first["classes"], first["ids"], first["pseudo_elements"]) == ("svg", "ns", ["a"], ["b"], ["before"])
    assert s["*:hover > p:first-letter"][0]["pseudo_classes"] == ["hover"] and s["*:hover > p:first-letter"][1]["pseudo_elements"] == ["first-letter"]


def test_odd_sheets(spark):
    long = "p { a: " + "x " * 200_000 + "} " + "q { b: c } " * 2000
    df = spark.createDataFrame([(1, None, "e"), (2, "", "e"), (3, long, "e"), (3, "p {}", "e"), (None, "p { color: red }", "e")], "k long, css string, rule_no string")
    rules = T.style_rules(df, "k", "css")
    got = {(r.k, r.n) for r in rules.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {(3, 2002), (None, 1)}
    assert T.style_rules(df.limit(0), "k", "css").count() == 0


@pytest.mark.parametrize("level,want", [("light", {"color": "drop", "line-height": "keep", "font-size": "keep"}), ("standard", {"color": "drop", "line-height": "drop", "font-size": "convert"}), ("strict", {"color": "drop", "line-height": "drop", "font-size": "drop"})])
def test_levels(spark, level, want):
    df = spark.createDataFrame([(p, v, False, False, False, False, False) for p, v in (("color", "red"), ("line-height", "2"), ("font-size", "20px"))], "property string, value string, vector boolean, drop_cap boolean, root boolean, heading boolean, image boolean")
    assert {r.property: r.decision for r in T.declaration_decisions(df, T.LEVELS[level]).collect()} == want


def test_groups_are_not_broadcast(spark, sf):
    plan = Q.declaration_decisions(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [k#" in plan and "BroadcastHashJoin [k#" not in plan
