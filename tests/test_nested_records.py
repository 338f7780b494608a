import json

from folioworks.operators.nested_records import child_table, child_tables, payload_status

GOOD = {"data": [{"id": "a1", "what": {"author": {"userid": 7}, "category_info": {"type": "x"}, "tags": [{"tag": "t"}, None, "u", {"tag": 12}, {"tag": None}, ["no"]], "series": {"items": [{"id": 5}, {"id": None}]}}}, {"what": {"tags": ["lost"]}}, None]}


def rows(spark, payloads, shape="wall_pages", extra=""):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads, 1)], "page_id long, payload string")
    return {tuple(r) for r in child_tables(df, shape).collect()}


def test_children_name_their_parent(spark):
    want = {(1, "1", "activity", 1, "a1"), (1, "a1", "author", 1, "7"), (1, "a1", "category", 1, "x"), (1, "a1", "tag", 1, "t"), (1, "a1", "tag", 3, "u"), (1, "a1", "tag", 4, "12"), (1, "a1", "episode", 1, "5")}
    assert rows(spark, [json.dumps(GOOD)]) == want


def test_wrapped_and_single_and_encoded(spark):
    one = {"ok": True, "result": {"data": {"id": "b", "what": None}}}
    text = json.dumps(one)
    for p in (text, "\ufeff" + text, json.dumps(text), "\ufeff" + json.dumps(text), " \n" + text + " "):
        assert rows(spark, [p]) == {(1, "1", "activity", 1, "b")}


def test_what_is_not_one_document_gives_nothing(spark):
    text = json.dumps(GOOD)
    bad = [None, "", "<html>", text[:-5], text + "x", text + text, text + "}", text + "]", "null", "[]", "3", json.dumps(text[:-3]), "{'data': []}"]
    assert rows(spark, bad) == set()


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD)), (1, json.dumps(GOOD))], "page_id long, payload string")
    assert child_table(df, "wall_pages", "tag").count() == 3
    assert child_tables(df.limit(0), "wall_pages").count() == 0


def test_books(spark):
    p = json.dumps({"content": [{"id": "x", "media": {"status": "READY"}, "metadata": {"authors": [{"name": None}, {"name": "N"}]}}]})
    assert rows(spark, [p], "book_pages") == {(1, "1", "book", 1, "x"), (1, "x", "media", 1, "READY"), (1, "x", "contributor", 2, "N")}


def test_repeated_member_names_keep_the_page(spark):
    rows = [(1, '{"data": [{"id": "a", "x": 1, "x": 2, "what": {"author": {"userid": 7, "userid": 8}}}]}'), (2, '{"data": [{"id": "b"}]}'), (3, "{"), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, payload string")
    got = {(r.page_id, r.child_kind, r.child_key) for r in child_tables(df, "wall_pages").collect()}
    assert got == {(1, "activity", "a"), (1, "author", "8"), (2, "activity", "b")}
    assert {r.page_id: r.status for r in payload_status(df, "wall_pages").collect()} == {1: "read", 2: "read", 3: "not one document", 4: "empty"}
