import json

from pyspark.sql import functions as F

from folioworks.operators import assembly as A
from folioworks.operators import payloads as P


def pages(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(docs, 1)], "page_id long, payload string")


def test_search_rows(spark):
    good = {"url": "x", "title": "T", "type": "poem", "author": {"username": ""}, "authorname": "N", "category_info": {"pageUrl": "c"}, "tags": [{"tag": "a"}, 7, None], "words_count": 0, "view_count": 3, "rank": None, "is_hot": 1}
    df = pages(spark, {"data": [good, {"title": "no url"}, None]}, {"data": {"url": "y", "title": "S"}}, None, "broken")
    rows = P.search_rows(df, "payload", {"": "/s/", "poem": "/p/"}, ["view_count", "rank"], ["is_hot"]).orderBy("page_id").collect()
    a, b = rows
    assert (a.url, a.author, a.tags, a.words, a.custom) == ("/p/x", "N", "a, 7", 0, {"view_count": "3", "is_hot": "true"})
    assert (b.url, b.author, b.tags, b.words, b.custom) == ("/s/y", None, None, None, {})


def test_graph(spark):
    inc = [
        {"type": "campaign", "id": "c1", "attributes": {"name": "C"}, "relationships": {"creator": {"data": {"id": "u1"}}}},
        {"type": "user", "id": "u1", "attributes": {"full_name": "Old"}},
        {"type": "user", "id": "u1", "attributes": {"full_name": "New"}},
        {"type": "member", "id": "m", "attributes": {"patron_status": "active"}, "relationships": {"campaign": {"data": {"id": "c1"}}}},
        {"type": "media", "id": "1", "attributes": {"file_name": "f.epub"}},
        {"type": "collection", "id": "k", "attributes": {"title": " K "}},
    ]
    assert [tuple(r) for r in P.graph_campaigns(pages(spark, {"included": inc}), "payload").collect()] == [("c1", "C", "New", "active")]
    post = {"id": "p", "attributes": {"title": "T"}, "relationships": {"attachments_section": {"data": {"id": "1"}}, "media": {"data": [{"id": "2"}, {"id": "1"}]}, "collections": {"data": [{"id": "k"}]}}}
    r = P.graph_posts(pages(spark, {"data": [post, {"id": "q"}], "included": inc, "meta": {"pagination": {"cursors": {"next": "n"}}}}), "payload").orderBy("pos").collect()
    assert ([tuple(m) for m in r[0].media], r[0].collection, r[0].next_cursor) == ([("1", "f.epub"), ("2", "")], "K", "n")
    assert (r[1].post_id, r[1].media, r[1].collection) == ("q", [], None)


def test_findings(spark):
    v = {"PkgName": "p", "InstalledVersion": "1", "VulnerabilityID": "V", "Severity": "LOW"}
    df = pages(spark, {"Results": [{"Vulnerabilities": [v, v]}, {}, {"Vulnerabilities": None}]}, {})
    assert [tuple(r) for r in P.report_findings(df, "page_id", "payload").collect()] == [(1, "p", "1", None, "V", "LOW")]


def test_assembly(spark):
    ch = spark.createDataFrame([("a", 1, None, False), ("a", 2, 5, True), ("a", 3, 4, True), ("b", 1, 9, None)], "book string, pos int, n int, c boolean")
    assert {r.book: (r.first_number, r.min_number, r.chapter_count) for r in A.candidate_facts(ch, "book", "pos", "n", F.col("c")).collect()} == {"a": (5, 4, 3), "b": (None, None, 0)}
    m = spark.createDataFrame([(1, "a", "f"), (1, "b", "f"), (2, "c", ""), (3, "d", ""), (3, "e", None)], "g int, book string, file string")
    assert {(r.g, r.reason) for r in A.refused_selections(m, "g", "book", "file").collect()} == {(1, "shared file"), (2, "too few")}
    assert {(r.book, r.action, r.superseded_by) for r in A.merge_patches(m.where("book = 'd'"), m.where("g = 3"), "g", "book").collect()} == {("d", "update", None), ("e", "delete", "d")}
    s = spark.createDataFrame([("a", "u1"), ("a", None), ("b", None)], "book string, own string")
    assert sorted(((r.book, r.url) for r in A.stamp_addresses(s, "book", "own", F.lit("https://x")).collect()), key=repr) == [("a", "u1"), ("a", None), ("b", "https://x")]
    n = A.free_numbers(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "book string, o int"), spark.createDataFrame([("a", 1), ("a", 3)], "book string, num int"), "book", "o", "num")
    assert {(r.book, r.o): r.num for r in n.collect()} == {("a", 1): 2, ("a", 2): 4, ("b", 1): 1}
    v = spark.createDataFrame([("a", "2.0"), ("a", "10.1"), ("a", "x")], "g string, v string")
    assert A.highest_version(v, "g", "v").first().v == "10.1"
    assert A.first_where(ch, "book", "n", "pos", F.col("c")).orderBy("book").collect()[1].n is None
    want = spark.createDataFrame([("T", ["A"]), ("T", None), ("T", [""]), ("U", ["A"])], "t string, au array<string>")
    books = spark.createDataFrame([("T", ["A", "B"], 1), ("T", ["C"], 2), ("U", ["A"], 3), ("U", ["A"], 4)], "t string, au array<string>, id int")
    got = {(r.t, tuple(r.au) if r.au is not None else None): r.id for r in A.match_title_authors(want, books, "t", "au", "id").collect()}
    assert got == {("T", ("A",)): 1, ("T", None): None, ("T", ("",)): None, ("U", ("A",)): None}
    links = spark.createDataFrame([("m", "u", 2, 1, "late"), ("m", "u", 1, 9, "own"), ("m", None, 0, 0, "x")], "book string, url string, prec int, pos int, title string")
    assert [(r.url, r.title) for r in A.absorbed_links(links, "book", "url", "prec", "pos").collect()] == [("u", "own")]
