"""Null, tie, repeat, empty and clashing-name cases of the library operators."""

import zipfile

import pytest
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import assembly as A
from folioworks.operators import changes as C
from folioworks.operators import markup as M
from folioworks.operators import ordering as O
from folioworks.operators import relational as R
from folioworks.plans import library_queries as Q
from folioworks.sources import readers
from folioworks.streaming import feeds


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    "f,value,want",
    [
        (lambda c: S.plain_excerpt(c, 10), "<p>one two three</p>", "one two…"),
        (lambda c: S.plain_excerpt(c, 4), "abcdefgh", "abcd…"),
        (lambda c: S.plain_excerpt(c, 4), "<p> </p>", None),
        (S.int_or_null, "12,345", 12345),
        (S.int_or_null, "1\u202f234\u00a0567", 1234567),
        (S.int_or_null, "x", None),
        (S.int_list, "1, x,3", [1, 3]),
        (S.int_list, None, []),
        (S.isbn13, "0-306-40615-2", "9780306406157"),
        (S.isbn13, "9780306406157", "9780306406157"),
        (S.isbn13, "9780306406158", None),
        (S.rating_of_tag, "★★★☆☆", 3),
        (S.rating_of_tag, "★★", 2),
        (S.rating_of_tag, "rating: 4", 4),
        (S.rating_of_tag, "★★☆", None),
        (S.slug_title, "long-WAY home", "Long Way Home"),
        (S.nfc_casefold, "STRASSE e\u0301", "strasse é"),
        (lambda c: S.unknown_keys(c, ["a"]), "http://x/?b=1&a=2&c&b=3", ["b", "c"]),
        (S.canonical_url, "HTTPS://WWW.X.example/A/?q=1#f", "x.example/A/?q=1"),
        (S.bump_patch, "1.2.9", "1.2.10"),
        (S.bump_patch, "1.2", None),
        (S.exact_version, "pkg==1.2.3", "1.2.3"),
        (S.exact_version, "pkg>=1.2", None),
        (S.release_id, "my-plugin-1.0", "my-plugin"),
        (lambda c: S.identifier(c, "isbn"), "x:1, isbn:9:8", "9:8"),
        (S.mdy_date, "13/45/2020", None),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_first_by_key_ties_nulls_and_hot_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), (None, 3, "n"), (None, 4, "m")], "k string, pos int, v string")
    order = [F.col("pos"), F.col("v")]
    want = [(None, 3, "n"), ("a", 1, "y")]
    for f in (R.first_by_key, R.first_by_key_agg):
        assert sorted(map(tuple, f(df, ["k"], order).select("k", "pos", "v").collect()), key=repr) == sorted(want, key=repr)
    assert R.first_by_key(df, ["k"], order, keep_null_keys=True).count() == 3
    assert R.first_by_key_agg(df.limit(0), ["k"], order).count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 5.0, "9", True), (2, None, "9", True), (3, 5.0, "9", False)], "id int, n double, s string, b boolean")
    ids = lambda t: [r.id for r in R.at_least(df, t).collect()]
    assert ids({}) == [1, 2, 3] and ids({"n": 5}) == [1, 3] and ids({"b": 1}) == [1, 2] and ids({"s": 1}) == []


def test_longest_prefix_owner(spark):
    n = spark.createDataFrame([("f", "a.b.jpg"), ("f", "a-x"), ("f", "zz"), ("g", "any"), ("f", "a.")], "folder string, name string")
    o = spark.createDataFrame([("f", "a"), ("f", "a.b"), ("g", "only")], "folder string, stem string")
    got = {(r.folder, r.name): r.owner for r in R.longest_prefix_owner(n, o, "folder", "name", "stem").collect()}
    assert got == {("f", "a.b.jpg"): "a.b", ("f", "a-x"): "a", ("f", "zz"): None, ("g", "any"): "only", ("f", "a."): "a"}


def test_slot_sort_and_splice(spark):
    df = spark.createDataFrame([(1, 1, 2, 9), (1, 2, 2, None), (1, 3, 2, 3), (1, 4, 0, 5), (1, 5, 2, 3)], "doc int, pos int, zone int, num int")
    got = {r.pos: r.new_pos for r in O.slot_sort(df, "doc", "pos", F.col("zone"), F.col("num"), 2).collect()}
    assert got == {4: 1, 3: 2, 2: 3, 5: 4, 1: 5}
    df = spark.createDataFrame([("d", 1, None), ("d", 2, 7), ("d", 3, None), ("d", 4, None), ("d", 5, 3)], "doc string, auto int, stored int")
    order = [r.auto for r in O.splice_order(df, "doc", "auto", "stored").orderBy("new_pos").collect()]
    assert order == [1, 5, 2, 4, 3]


def test_three_way(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("a", "a", None), ("", "f", None), ("a", "f", None), ("a", None, None), ("a", "a2", h("a")), ("a2", "a", h("a")), ("x", "y", h("a")), (None, "a", h("a")), ("a", None, h("a"))]
    df = spark.createDataFrame(rows, "app string, file string, base string")
    text = [r.o for r in df.select(C.three_way(F.col("app"), F.col("file"), F.col("base"), True).alias("o")).collect()]
    data = [r.o for r in df.select(C.three_way(F.col("app"), F.col("file"), F.col("base"), False).alias("o")).collect()]
    assert text == ["equal", "adopt file", "conflict", "take app", "take file", "take app", "conflict", "take app", "none"]
    assert data[7] == "none" and data[:7] == text[:7]


def test_upsert_never_blanks_except_on_purpose(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    patch = spark.createDataFrame([(1, None, True), (3, "n", False)], "id int, x string, clear_y boolean")
    assert sorted(map(tuple, C.upsert(base, patch, "id", ["y"]).collect())) == [(1, "a", None), (2, "c", "d"), (3, "n", None)]


def test_links_and_fields(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2")],), (None,)], "l array<struct<label:string,url:string>>")
    got = [[tuple(x) for x in r.o] for r in df.select(C.upsert_links(F.col("l"), F.lit("b"), F.lit("9")).alias("o")).collect()]
    assert got == [[("a", "1"), ("b", "9")], [("b", "9")]]


def test_markup(spark):
    df = spark.createDataFrame([(1, '<P class="b a b" id=x>t</P><p>&nbsp;</p><font color="red" size=2>y</font>'), (2, None), (3, "")], "k int, t string")
    tags = M.start_tags(df, "k", "t")
    assert sorted((r.tag, r.classes, r.element_id, r.n) for r in M.tag_census(tags).collect()) == [("font", "", "", 1), ("p", "", "", 1), ("p", "a b", "x", 1)]
    assert one(spark, M.mark_blank_paragraphs, "<p>&nbsp;<br/></p><p>x</p>") == '<p class="blank"></p><p>x</p>'
    assert {r.k: r.well_formed for r in M.well_formed(spark.createDataFrame([(1, "<a>x</a>"), (2, "<a>"), (3, None)], "k int, t string"), "k", "t").collect()} == {1: True, 2: False, 3: False}
    pools = M.size_pools(spark.createDataFrame([("b", 1, 10.0, 2), ("b", 2, 10.009, 3), ("b", 3, 10.018, 4)], "book string, pos int, size double, weight int"), "book", "pos", "size", "weight")
    assert sorted((r.size, r.weight) for r in pools.collect()) == [(10.0, 5), (10.018, 4)]


def test_nearest_and_last_mark(spark):
    pts = spark.createDataFrame([("d", 5), ("d", 1), ("e", 3), ("d", 20)], "doc string, at int")
    marks = spark.createDataFrame([("d", 2), ("d", 8), ("d", 8)], "doc string, m int")
    assert {(r.doc, r.at): r.nearest for r in O.nearest_mark(pts, marks, "doc", "at", "m", ["at"]).collect()} == {("d", 5): 2, ("d", 1): 2, ("e", 3): None, ("d", 20): 8}
    for bucket in (None, lambda c: F.floor(c / 4), lambda c: F.floor(c / 100)):
        got = O.last_at_or_before(pts, marks.withColumn("v", F.col("m") * 10), "doc", "at", "m", "v", bucket)
        assert {(r.doc, r.at): r.v for r in got.collect()} == {("d", 5): 20, ("d", 1): None, ("e", 3): None, ("d", 20): 80}


def test_readers(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="c2" href="c2.xhtml" media-type="x"/><item id="c1" href="c1.xhtml" media-type="x"/></manifest><spine><itemref idref="c1"/><itemref idref="no"/><itemref idref="c2"/></spine></package>')
        z.writestr("O/c1.xhtml", "<html><title> One </title></html>")
        z.writestr("O/c2.xhtml", "<p>two</p>")
        z.writestr("O/img.png", b"123")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}">{p("Normal", "pre")}{p("Heading1", "A")}{p("Heading1", "B")}{p("Normal", "body")}</w:document>')
    (tmp_path / "r.rtf").write_bytes(b"{\\rtf1{\\info{\\title My T}}{\\fonttbl x}Hello \\'e9\\par \\u" + b"8212?end}")
    (tmp_path / "t.txt").write_text("plain")
    path = str(tmp_path)
    assert [(r.pos, r.item_id, r.title) for r in readers.epub_chapters(spark, path).orderBy("pos").collect()] == [(1, "c1", "One"), (3, "c2", None)]
    assert [r.name for r in readers.epub_resources(spark, path).collect()] == ["O/img.png"]
    assert sorted((r.chapter_no, r.title, tuple(r.paragraphs)) for r in readers.docx_chapters(readers.docx_paragraphs(spark, path)).collect()) == [(0, None, ("pre",)), (2, "B", ("body",))]
    r = readers.rtf_documents(spark, path).first()
    assert (r.title, r.text) == ("My T", "Hello é\n—end")
    assert readers.text_documents(spark, str(tmp_path / "t.txt")).first().text == "plain"
    made = readers.write_packages(spark.createDataFrame([(1, "b", "2"), (1, "a", "1")], "book int, name string, text string"), path, "book", "name", "text").first()
    assert zipfile.ZipFile(made.path).namelist() == ["mimetype", "a", "b"]


def test_paged_listing(spark, tmp_path):
    import json

    for i, n in ((1, 2), (2, 1), (3, 2)):
        (tmp_path / f"x-{i}.json").write_text(json.dumps({"data": [{"id": i * 10 + k} for k in range(n)]}))
    spark.dataSource.register(readers.PagedListing)
    df = spark.read.format("paged_listing").options(path=str(tmp_path), listings="x,none", page_size="2").load()
    assert sorted((r.page, r.pos, r.record) for r in df.collect()) == [(1, 1, '{"id": 10}'), (1, 2, '{"id": 11}'), (2, 1, '{"id": 20}')]


def test_echoes_are_suppressed(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", "1", 0), ("a", "1", 30), ("a", None, 40), ("a", None, 41), ("b", "1", 5), ("a", "1", 50), ("a", "1", 200), ("b", "1", None)]
    spark.createDataFrame(rows, "k string, v string, s long").selectExpr("k", "v", "timestamp_seconds(s) t").repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema("k string, v string, t timestamp").parquet(str(src))
    got = feeds.run_available(feeds.suppress_echoes(stream, "k", "v", "t", 60_000), str(tmp_path / "out"))
    assert sorted((r.k, r.v, r.at_us // 1_000_000) for r in got.collect() if r.v) == [("a", "1", 0), ("a", "1", 50), ("a", "1", 200), ("b", "1", 5)]
    assert [(r.k, r.at_us) for r in got.collect() if r.v is None] == [("a", 40_000_000)]


def test_open_windows_come_out(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("x", 0), ("x", 10), ("y", 4000), ("x", None)], "k string, s long").selectExpr("k", "timestamp_seconds(s) t").write.parquet(str(src))
    stream = spark.readStream.schema("k string, t timestamp").parquet(str(src))
    got = feeds.run_available(feeds.counts_by_window(stream, "t", "10 minutes", "1 hour", ["k"]), str(tmp_path / "out"), ["window_start", "k"])
    assert sorted((r.k, r.n) for r in got.collect()) == [("x", 2), ("y", 1)]
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "none"))
    assert feeds.run_available(feeds.counts_by_window(empty, "t", "10 minutes", "1 hour", ["k"]), str(tmp_path / "out2"), ["window_start", "k"]).count() == 0


def test_whole_names_are_looked_for(spark):
    names = spark.createDataFrame([("s", "Mira Toranby"), ("s", "mira toran"), ("s", "Jo"), ("s", "Xy"), ("t", "Mira Toranby"), (None, "Nils"), ("s", None)], "site string, name string")
    posts = spark.createDataFrame([("s", 1, "by MIRA TORANBY, and Jon"), ("t", 2, "mira of toranby " * 50), ("s", 3, None)], "site string, post_id long, content string")
    got = M.unreferenced(names, posts, "site", "name", "post_id", "content").collect()
    assert {(r.site, r.name) for r in got} == {("s", "Xy"), ("t", "Mira Toranby"), (None, "Nils"), ("s", None)}


def test_names_are_not_broadcast(spark, sf):
    plan = Q.unreferenced_names(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_names_of_any_length(spark):
    text = "An <b>Émile\n\U0001f600 Zola-the-second</b> of " + "Inkharbor " * 3
    inside = [text[i : i + n] for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 30) for i in range(0, len(text) - n + 1, 3)]
    names = spark.createDataFrame([(g, x) for g in "st" for x in [*inside, *(x[:-1] + "#" for x in inside)]] + [(g, "") for g in "su"], "site string, name string").distinct()
    posts = spark.createDataFrame([("s", None, text), ("t", 1, "of ink"), ("t", 1, "Émile"), ("t", 2, ""), (None, 3, text)], "site string, post_id long, content string")
    held = {"s": [text.lower()], "t": ["of ink", "émile", ""], "u": []}
    want = {(r.site, r.name) for r in names.collect() if not any(r.name.lower() in t for t in held[r.site])}
    assert {tuple(r) for r in M.unreferenced(names, posts, "site", "name", "post_id", "content").collect()} == want and ("u", "") in want


def test_addresses_of_chapters(spark):
    rows = [("a", 1, None, "http://x/a", False), ("b", 1, None, "http://x/b", False), ("b", 2, "", "http://x/b", False), ("c", 1, "http://own", "http://x/c", False), ("c", 2, None, "http://x/c", False), ("d", 1, None, "http://x/d", True), ("d", 2, "http://own", "http://x/d", False), ("e", 1, None, None, False)]
    df = spark.createDataFrame(rows, "book string, pos int, own string, of string, title boolean")
    got = {(r.book, r.pos): r.url for r in A.stamp_addresses(df, "book", "own", F.col("of"), F.col("title")).collect()}
    assert got == {("a", 1): "http://x/a", ("b", 1): "http://x/b", ("b", 2): "http://x/b", ("c", 1): "http://own", ("c", 2): None, ("d", 1): None, ("d", 2): "http://x/d", ("e", 1): None}


def test_splicing_follows_the_present_order(spark):
    # automatic order a b c d e, present order e d c b a, stored a=1, c=0
    rows = [(k, i, 5 - i, {"a": 1, "c": 0}.get(k)) for i, k in enumerate("abcde", 1)]
    df = spark.createDataFrame(rows, "k string, auto int, nav int, stored int").withColumn("doc", F.lit(1))
    got = [r.k for r in O.splice_order(df, "doc", "auto", "stored", "nav").orderBy("new_pos").collect()]
    result = ["c", "a"]
    for k in "edcba":  # one by one, directly behind the nearest earlier stored one
        if k not in "ac":
            anchor = next((x for x in reversed("abcde"[: "abcde".index(k)]) if x in "ac"), None)
            result.insert(result.index(anchor) + 1 if anchor else 0, k)
    assert got == result


def test_markers(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, ts int")
    assert [r.id for r in feeds.changes_since(df, "ts", F.lit(5)).collect()] == [3]
    assert feeds.changes_since(df, "ts", F.lit(None).cast("int")).count() == 0
    assert feeds.next_marker(df, "ts", F.lit(20), F.lit(0)).first().marker == 20
    assert feeds.next_marker(df.limit(0), "ts", F.lit(None).cast("int"), F.lit(0)).first().marker == 0


def test_report(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "x string, y int")
    assert readers.markdown_report(df, ["x", "y"], ["x"]).first().report == "| x | y |\n|---|---|\n| a |  |\n| b | 2 |"
