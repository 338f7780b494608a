"""Queries of the style sheet operators over sheets that vary by row, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators import markup as M
from folioworks.operators import style_sheets as T
from folioworks.plans.registry import Registry
from folioworks.session import materialize, table

_ALL = Registry()
query = _ALL.query


def queries() -> dict:
    return dict(_ALL.found)


def oracle_sql() -> dict[str, str]:
    return dict(_ALL.sql)


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """A sheet a part: lengths and names follow the part's size, every second sheet has a rule more."""
    n, k = F.col("p_size"), F.col("p_partkey")
    parts = [
        "/* a { color: red } */ @media screen { @supports (display: grid) { h1.cover", n % 3, ", p::first-letter, .x\\{ { color: red; font: italic bold 12px/1.5 'Courier New', serif } } } ",
        "html, .page { margin: 1px; background: url(a;b.png) #fff, none; width: 50% } ",
        "svg|rect { fill: red; width: 1px } p > .t", n % 3, " { font-size: ", n, "px; margin: 1em ", n, "px !important; text-align: LEFT; border: 1px solid Red; line-height: 2; width: 10px; font-family: Arial, sans-serif } ",
        "@font-face { font-family: 'F", n % 4, "'; src: url(x) } @page { margin: 1in; size: a5 } @page :first { margin: 0 } @import 'x.css'; ",
    ]
    extra = F.when(k % 2 == 0, F.concat(F.lit("h2:hover, #i"), n, F.lit(" img { text-indent: 2in; hyphens: auto; background: linear-gradient(red, blue) }"))).otherwise(" }")
    return table(spark, d, "part").select(k.alias("k"), n.alias("n"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], extra).alias("css"))


_PARTS = "p AS (SELECT p_partkey AS k, p_size AS n FROM part)"


@query(f"""WITH {_PARTS}, r(no, cond, rule, sel, decl) AS (VALUES (1, '@media screen and @supports (display: grid)', NULL, 2, 2), (2, '', NULL, 2, 3), (3, '', NULL, 1, 2), (4, '', NULL, 1, 7), (5, '', 'font-face', 0, 2), (6, '', 'page', 0, 2), (7, '', 'page', 0, 1), (8, '', 'import', 0, 0), (9, '', NULL, 2, 3))
SELECT k, no AS rule_no, cond AS condition, rule AS at_rule, sel AS n_selectors, decl AS n_declarations FROM p, r WHERE no < 9 OR k % 2 = 0""")
def style_rules(spark: SparkSession, d: str) -> DataFrame:
    r = T.style_rules(_sheets(spark, d), "k", "css")
    return r.select("k", "rule_no", "condition", "at_rule", F.size("selectors").alias("n_selectors"), F.size("declarations").alias("n_declarations"))


_SELECTORS = """s(no, sno, text, vector, drop_cap, root, heading, image) AS (VALUES (1, 1, 'h1.cover#', false, false, false, true, true), (1, 2, 'p::first-letter', false, true, false, false, false), (2, 1, 'html', false, false, true, false, false),
 (2, 2, '.page', false, false, true, false, false), (3, 1, 'svg|rect', true, false, false, false, false), (4, 1, 'p > .t#', false, false, false, false, false), (9, 1, 'h2:hover', false, false, false, true, false), (9, 2, '#i@ img', false, false, false, false, true))"""


def _selectors(spark: SparkSession, d: str) -> DataFrame:
    return T.selector_rows(T.style_rules(_sheets(spark, d), "k", "css"), "k", F.array(F.lit("page")))


@query(f"""WITH {_PARTS}, {_SELECTORS}
SELECT k, no AS rule_no, sno AS selector_no, replace(replace(text, '#i@', '#i' || n), 't#', 't' || (n % 3)) AS selector, vector, drop_cap, root, heading, image FROM p, s WHERE (no < 9 OR k % 2 = 0) AND NOT (no = 1 AND sno = 1)
UNION ALL SELECT k, 1, 1, 'h1.cover' || (n % 3), false, false, false, true, true FROM p""")
def selector_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _selectors(spark, d).select("k", "rule_no", "selector_no", "selector", *T.FLAGS)


@query(f"""WITH {_PARTS}
SELECT k, 1 AS rule_no, 1 AS group_no, 'h1.cover' || (n % 3) AS selectors FROM p UNION ALL SELECT k, 1, 2, 'p::first-letter' FROM p UNION ALL SELECT k, 2, 1, 'html, .page' FROM p UNION ALL SELECT k, 3, 1, 'svg|rect' FROM p
UNION ALL SELECT k, 4, 1, 'p > .t' || (n % 3) FROM p UNION ALL SELECT k, 9, 1, 'h2:hover' FROM p WHERE k % 2 = 0 UNION ALL SELECT k, 9, 2, '#i' || n || ' img' FROM p WHERE k % 2 = 0""")
def selector_groups(spark: SparkSession, d: str) -> DataFrame:
    return T.context_groups(_selectors(spark, d), "k").select("k", "rule_no", "group_no", "selectors")


_EM = "rtrim(rtrim(format('{{:.3f}}', round_even(greatest(0.4::DOUBLE, least(4.0::DOUBLE, {x})), 3)::DOUBLE), '0'), '.') || 'em'"


@query(f"""WITH {_PARTS}, e AS (SELECT *, {_EM.format(x='n / 16.0::DOUBLE')} AS em, CASE WHEN n >= 12 THEN true ELSE false END AS x FROM p),
q AS (
SELECT k, 1 AS rule_no, 'color' AS property, 'drop' AS decision, NULL AS new_value, 1 AS n FROM e UNION ALL SELECT k, 1, 'font', 'expand', 'font-style: italic; font-variant: normal; font-weight: bold; font-size: 12px; line-height: 1.5; font-family: monospace', 1 FROM e
UNION ALL SELECT k, 1, 'color', 'drop', NULL, 2 FROM e UNION ALL SELECT k, 1, 'font', 'keep', 'italic bold 12px/1.5 ''Courier New'', serif', 2 FROM e
UNION ALL SELECT k, 2, 'margin', 'drop', NULL, 1 FROM e UNION ALL SELECT k, 2, 'background', 'convert', 'none', 1 FROM e UNION ALL SELECT k, 2, 'width', 'drop', NULL, 1 FROM e
UNION ALL SELECT k, 3, 'fill', 'keep', 'red', 1 FROM e UNION ALL SELECT k, 3, 'width', 'keep', '1px', 1 FROM e
UNION ALL SELECT k, 4, 'font-size', CASE WHEN abs(n - 12) < 0.01 THEN 'drop' ELSE 'convert' END, CASE WHEN n <> 12 THEN em END, 1 FROM e UNION ALL SELECT k, 4, 'margin', 'convert', '1em ' || em, 1 FROM e UNION ALL SELECT k, 4, 'text-align', 'drop', NULL, 1 FROM e
UNION ALL SELECT k, 4, 'border', 'convert', '1px solid', 1 FROM e UNION ALL SELECT k, 4, 'line-height', 'drop', NULL, 1 FROM e UNION ALL SELECT k, 4, 'width', 'drop', NULL, 1 FROM e UNION ALL SELECT k, 4, 'font-family', 'drop', NULL, 1 FROM e
UNION ALL SELECT k, 9, 'text-indent', 'convert', '4em', 1 FROM e WHERE k % 2 = 0 UNION ALL SELECT k, 9, 'hyphens', 'drop', NULL, 1 FROM e WHERE k % 2 = 0 UNION ALL SELECT k, 9, 'background', 'drop', NULL, 1 FROM e WHERE k % 2 = 0
UNION ALL SELECT k, 9, 'text-indent', 'keep', '2in', 2 FROM e WHERE k % 2 = 0 UNION ALL SELECT k, 9, 'hyphens', 'drop', NULL, 2 FROM e WHERE k % 2 = 0 UNION ALL SELECT k, 9, 'background', 'drop', NULL, 2 FROM e WHERE k % 2 = 0)
SELECT k, rule_no, n AS group_no, property, decision, new_value FROM q""")
def declaration_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every declaration in every context of its rule, at the standard level, where the body text has 12 px."""
    rules = materialize(T.style_rules(_sheets(spark, d), "k", "css"), "style-rules")
    groups = T.context_groups(T.selector_rows(rules, "k", F.array(F.lit("page"))), "k")
    rows = rules.select("k", "rule_no", F.explode("declarations").alias("x")).select("k", "rule_no", "x.property", "x.value").join(groups.hint("merge"), ["k", "rule_no"])  # both sides grow; the written rules compress so well that their file size tells nothing
    size = F.struct(F.lit(12.0).alias("value"), F.lit("px").alias("unit"))
    return T.declaration_decisions(rows, T.LEVELS["standard"], 16.0, size).select("k", "rule_no", "group_no", "property", "decision", "new_value")


@query(f"""WITH {_PARTS}
SELECT k, 5 AS rule_no, CASE WHEN n % 4 IN (1, 2) THEN 'keep' ELSE 'drop' END AS decision FROM p UNION ALL SELECT k, 6, 'convert' FROM p UNION ALL SELECT k, 7, 'drop' FROM p UNION ALL SELECT k, 8, 'keep' FROM p""")
def at_rule_decisions(spark: SparkSession, d: str) -> DataFrame:
    rules = T.style_rules(_sheets(spark, d), "k", "css")
    return T.at_rule_decisions(rules, T.LEVELS["standard"], F.array(F.lit("f1"), F.lit("f2"))).select("k", "rule_no", "decision")


@query(f"""WITH {_PARTS} SELECT k, unnest(['courier new', 'serif']) AS family FROM p""")
def kept_families(spark: SparkSession, d: str) -> DataFrame:
    rules = T.style_rules(_sheets(spark, d), "k", "css")
    return T.kept_families(rules, T.selector_rows(rules, "k"), "k", False)


@query("""
WITH e AS (SELECT p_brand AS b, CASE p_size % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'div' ELSE 'h1' END AS tag, p_size % 4 AS c, p_size AS n FROM part)
SELECT b, r.no AS rule_no, CAST(count(*) FILTER (CASE r.no WHEN 1 THEN tag = 'p' OR c = 1 WHEN 2 THEN tag = 'div' AND c = 2 WHEN 3 THEN n = 5 AND tag = 'h1' WHEN 4 THEN c = 0 WHEN 5 THEN true ELSE false END) + CASE WHEN r.no = 1 THEN count(*) FILTER (tag = 'p' AND c = 1) ELSE 0 END AS BIGINT) AS weight
FROM e, (VALUES (1), (2), (3), (4), (5), (6)) r(no) GROUP BY b, r.no""")
def rule_weights(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = F.col("p_size")
    tag = F.when(n % 3 == 0, "p").when(n % 3 == 1, "div").otherwise("h1")
    census = p.groupBy(F.col("p_brand").alias("b"), tag.alias("tag"), F.array(F.lit("all"), F.concat(F.lit("c"), n % 4)).alias("classes"), F.concat(F.lit("i"), n).alias("element_id")).agg(F.count(F.lit(1)).alias("n"))
    css = "p, .c1.all { font-size: 1em } div.c2 {} h1#i5 { x: y } section > .c0 { x: y } * { x: y } html, p::before, .drop-cap { x: y }"
    rules = T.style_rules(p.select(F.col("p_brand").alias("b")).distinct().withColumn("css", F.lit(css)), "b", "css")
    return T.rule_weights(T.selector_rows(rules, "b"), census, "b")


#: Values with what is read from them: families, monospace, absolute, viewport, size, shorthand.
_VALUES = [
    ("Arial, 'Courier  New'", "arial|courier new", True, False, False, None, None),
    ('"A, b", C', 'a, b|c', False, False, False, None, None),
    ("12PX", "12px", False, True, False, "12.0px", None),
    ("1.5em", "1.5em", False, False, False, "1.5em", None),
    ("120%", "120%", False, False, False, "120.0%", None),
    ("calc(1px + 2vw)", "calc(1px + 2vw)", False, False, False, None, None),
    ("0 2pt -3cm", "0 2pt -3cm", False, True, False, None, "font-style=normal;font-variant=normal;font-weight=normal;font-size=0;line-height=normal"),
    ("10vmin", "10vmin", False, False, True, "10.0vmin", None),
    ("small-caps 700 condensed large/2 Menlo, x", "small-caps 700 condensed large/2 menlo|x", False, False, False, None, "font-style=normal;font-variant=small-caps;font-weight=700;font-size=large;line-height=2;font-family=monospace"),
    ("12pt Monaco", "12pt monaco", False, True, False, None, "font-style=normal;font-variant=normal;font-weight=normal;font-size=12pt;line-height=normal;font-family=monospace"),
    ("oblique 12px", "oblique 12px", False, True, False, None, None),
    ("inherit", "inherit", False, False, False, None, None),
    ("italic serif", "italic serif", False, False, False, None, None),
]


def _quoted(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"


def _picked(values: list, k: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))


@query(
    "WITH v(i, v, families, mono, absolute, viewport, size, shorthand) AS (VALUES "
    + ", ".join(f"({i}, {', '.join(_quoted(x) for x in row)})" for i, row in enumerate(_VALUES))
    + f") SELECT p_partkey AS k, v, families, mono, absolute, viewport, size, shorthand FROM part JOIN v ON i = p_partkey % {len(_VALUES)}"
)
def style_values(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    size = T.font_size(v)
    x = table(spark, d, "part").select(F.col("p_partkey").alias("k"), _picked([r[0] for r in _VALUES], F.col("p_partkey")).alias("v"))
    return x.select(
        "k", "v", F.array_join(T.family_names(v), "|").alias("families"), T.is_monospace(v).alias("mono"), T.has_absolute_length(v).alias("absolute"), T.is_viewport_length(v).alias("viewport"),
        F.concat(size["value"].cast("string"), size["unit"]).alias("size"), F.array_join(F.transform(F.map_entries(T.font_longhands(v)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("shorthand"),
    )


#: Start tags with the attributes that stay at the standard level.
_TAGS = [
    ("<td BGCOLOR=red align='left' width=\"10px\" colspan=2>", "colspan"), ("<img width=10 bgcolor=red align=left>", "align|bgcolor|width"), ("<font color=red face=Arial size=3>", "size"), ("<body text=red background=x leftmargin=0 class=a>", "class"),
    ("<div background=x align=center>", "align|background"), ("<p align=\"JUSTIFY\" id=p1 hidden>", "hidden|id"), ("<table width=50% height=20 bordercolor=red border=1>", "border|width"), ("<tr background=x align=right>", "align"), ("<svg width=1px/>", "width"),
    ("<td align=left align=center>", "align"),
]


@query("WITH v(i, kept) AS (VALUES " + ", ".join(f"({i}, {_quoted(k)})" for i, (_, k) in enumerate(_TAGS)) + f") SELECT p_partkey AS k, kept FROM part JOIN v ON i = p_partkey % {len(_TAGS)}")
def presentational_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The names of the attributes that stay."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), _picked([t for t, _ in _TAGS], F.col("p_partkey")).alias("html"))
    a = T.attribute_rows(M.start_tags(p, "k", "html"), "k")
    kept = a.where(~T.attribute_removed(F.col("tag"), F.col("name"), F.col("value"), T.LEVELS["standard"]))
    return kept.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("kept"))


#: Media types and addresses with the kind of member they are.
_MEMBERS = [("application/xhtml+xml", "a.css", "xhtml"), ("", "A.XHTML#x", "xhtml"), (None, "b.css?v=1", "css"), ("text/css", "x", "css"), ("image/svg+xml", "x.svg", "svg"), (None, "x.svg", "svg"), ("application/octet-stream", "F.TTF", "font"), ("font/woff2", None, "font"), ("image/png", "x.png", "other"), (None, None, "other")]


@query(
    "WITH v(i, kind) AS (VALUES " + ", ".join(f"({i}, {_quoted(m[2])})" for i, m in enumerate(_MEMBERS)) + f""") SELECT p_partkey AS k, kind, CASE WHEN p_size % 3 = 0 THEN '<head></head>' WHEN p_size % 3 = 1 THEN '<head><meta name="author" content="viewport"/></head>' ELSE '<head><title>x</title></head>' END AS text,
 CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS n FROM part JOIN v ON i = p_partkey % {len(_MEMBERS)}"""
)
def members_and_viewports(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    view, link = '<META content="width=1" name=viewport>', "<link rel='x' type='application/vnd.adobe-page-template+xml' href='t'/>"
    text = F.when(n % 3 == 0, f"<head>{view}{link}</head>").when(n % 3 == 1, '<head><meta name="author" content="viewport"/></head>').otherwise(f"<head>{view}<title>x</title></head>")
    bare, count = T.without_viewport(text)
    return table(spark, d, "part").select(k.alias("k"), T.member_kind(_picked([m[0] for m in _MEMBERS], k), _picked([m[1] for m in _MEMBERS], k)).alias("kind"), bare.alias("text"), count.alias("n"))


@query("""
WITH p AS (SELECT CASE p_size % 3 WHEN 0 THEN 'body' ELSE 'p' END AS tag, p_type AS c FROM part), u AS (SELECT c, bool_and(tag = 'body') AS o FROM (SELECT tag, lower(c) || (CASE tag WHEN 'body' THEN '-root' ELSE '' END) AS c FROM p UNION ALL SELECT tag, 'both' FROM p) GROUP BY c)
SELECT c AS name FROM u WHERE o""")
def root_only_names(spark: SparkSession, d: str) -> DataFrame:
    root = F.col("p_size") % 3 == 0
    html = F.concat(F.lit("<"), F.when(root, "body").otherwise("p"), F.lit(' class="both '), F.lower("p_type"), F.when(root, "-root").otherwise(""), F.lit('">'))
    tags = M.start_tags(table(spark, d, "part").select(F.col("p_partkey").alias("k"), html.alias("html")), "k", "html")
    named = tags.select("tag", F.explode(F.split(M.attribute(F.col("attrs"), "class"), r"\s+")).alias("c"))
    return M.names_only_on(named, F.col("c"), T.ROOT_TAGS)
