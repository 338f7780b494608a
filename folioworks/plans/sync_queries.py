"""Queries of the library sync operators over whole tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import library_sync as L
from folioworks.plans.registry import Registry
from folioworks.session import table

_ALL = Registry()
query = _ALL.query


def queries() -> dict:
    return dict(_ALL.found)


def oracle_sql() -> dict[str, str]:
    return dict(_ALL.sql)




def _none():
    return F.lit(None).cast("string")

# Parts as books: categories and tags are lists that share values in other cases, ratings run from null over 0 to 5.
_SHELF = """
shelf AS (SELECT p_partkey AS k, p_type || ', ' || split_part(p_name, ' ', 1) || ', ' || lower(p_type) AS category,
  upper(split_part(p_name, ' ', 2)) || ', ' || chr(233) || p_brand || ', ' || split_part(p_name, ' ', 2) || ', ' || lower(p_type) || ', ' || p_brand AS tags,
  CASE WHEN p_partkey % 7 < 6 THEN CAST(p_partkey % 7 AS INT) END AS rating FROM part)"""


def _shelf(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return p.select(
        F.col("p_partkey").alias("k"),
        F.concat_ws(", ", "p_type", first, F.lower("p_type")).alias("category"),
        F.concat_ws(", ", F.upper(second), F.concat(F.lit(chr(233)), "p_brand"), second, F.lower("p_type"), "p_brand").alias("tags"),
        F.when(F.col("p_partkey") % 7 < 6, (F.col("p_partkey") % 7).cast("int")).alias("rating"),
    )


@query(f"""WITH {_SHELF},
x AS (SELECT k, 0 AS part, CASE WHEN rating BETWEEN 1 AND 5 THEN repeat('★', rating) || repeat('☆', 5 - rating) END AS v, 0 AS i FROM shelf
      UNION ALL SELECT k, 1, unnest(string_split(category, ', ')), generate_subscripts(string_split(category, ', '), 1) FROM shelf
      UNION ALL SELECT k, 2, unnest(string_split(tags, ', ')), generate_subscripts(string_split(tags, ', '), 1) FROM shelf),
f AS (SELECT *, row_number() OVER (PARTITION BY k, lower(nfc_normalize(v)) ORDER BY part, i) AS rn FROM x WHERE v IS NOT NULL AND v <> '')
SELECT k, string_agg(nfc_normalize(v), '|' ORDER BY part, CASE WHEN part = 2 THEN lower(v) ELSE '' END, i) AS composed FROM f WHERE rn = 1 GROUP BY k""")
def tag_composition(spark: SparkSession, d: str) -> DataFrame:
    from folioworks.operators.relational import nfc

    c = L.composed_tags(F.col("category"), F.col("tags"), F.col("rating"))
    return _shelf(spark, d).select("k", nfc(F.array_join(c, "|")).alias("composed"))


@query("""
WITH r AS (SELECT listing_id, CASE WHEN listing_id % 8 < 7 THEN CAST(listing_id % 8 AS INT) - 1 END AS l, CASE listing_id % 5 WHEN 0 THEN 'drama' WHEN 1 THEN 'rating:' || (listing_id % 6) WHEN 2 THEN repeat('★', CAST(1 + listing_id % 5 AS INT)) ELSE '' END AS tag FROM stories),
t AS (SELECT listing_id, CASE WHEN l >= 0 THEN l END AS l, CASE listing_id % 5 WHEN 1 THEN CAST(listing_id % 6 AS INT) WHEN 2 THEN CAST(1 + listing_id % 5 AS INT) END AS r FROM r)
SELECT listing_id, CASE WHEN l IS NULL THEN CASE WHEN r BETWEEN 1 AND 5 THEN r END WHEN l <> 0 THEN l END AS desired, CASE WHEN l IS NULL AND r BETWEEN 1 AND 5 THEN r END AS adopt, coalesce(l = 0, false) AS clear FROM t""")
def rating_table(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("listing_id")
    local = F.when((k % 8).between(1, 6), (k % 8 - 1).cast("int"))
    tag = F.when(k % 5 == 0, "drama").when(k % 5 == 1, F.concat(F.lit("rating:"), k % 6)).when(k % 5 == 2, F.repeat(F.lit("★"), (1 + k % 5).cast("int"))).otherwise("")
    x = table(spark, d, "stories").select("listing_id", L.rating_decision(local, S.rating_of_tags(F.array(F.lit("plain"), tag))).alias("x"))
    return x.select("listing_id", "x.desired", "x.adopt", "x.clear")


@query(f"""WITH {_SHELF},
r AS (SELECT k, category, tags, ['rating:9', 'New ' || (k % 3), 'NEW ' || (k % 3), 'a, b', '★★', upper(split_part(category, ', ', 1)), 'Pushed ' || (k % 4), 'own'] AS remote, ['pushed 1', 'PUSHED 2'] AS pushed FROM shelf)
SELECT k, CASE WHEN k % 4 IN (1, 2) THEN 'New ' || (k % 3) || '|own' ELSE 'New ' || (k % 3) || '|Pushed ' || (k % 4) || '|own' END AS new_tags, 'New ' || (k % 3) || ', NEW ' || (k % 3) || ', a, b, Pushed ' || (k % 4) || ', own' AS server_tags, lower(split_part(category, ', ', 1)) || ', x' AS server_category FROM r""")
def remote_tags(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("k"), _shelf(spark, d)
    first = F.split_part("category", F.lit(", "), F.lit(1))
    remote = F.array(F.lit("rating:9"), F.concat(F.lit("New "), k % 3), F.concat(F.lit("NEW "), k % 3), F.lit("a, b"), F.lit("★★"), F.upper(first), F.concat(F.lit("Pushed "), k % 4), F.lit("own"))
    new = L.remote_only_tags(remote, F.col("category"), F.col("tags"), F.array(F.lit("pushed 1"), F.lit("PUSHED 2")))
    category, tags = L.catalog_of(F.array(F.lower(first), F.lit("x")), remote)
    return x.select("k", F.array_join(new, "|").alias("new_tags"), tags.alias("server_tags"), category.alias("server_category"))


_BOOK = """
b AS (SELECT book_key AS k, title AS cur_title, coalesce(summary, '') AS cur_summary, release_year, pages_count FROM library_books),
m AS (SELECT meta_id - 100000000000 AS k, nullif(trim(title), '') AS title, nullif(trim(description), '') AS description, nullif(trim(author), '') AS author, CAST((meta_id - 100000000000) % 6 AS DOUBLE) / 2 AS idx,
  CASE WHEN (meta_id - 100000000000) % 3 = 0 THEN NULL ELSE (meta_id - 100000000000) % 4 END AS date_no, category, storyurl, site, story_status FROM story_meta)"""


def _books(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "library_books").select(F.col("book_key").alias("k"), F.col("title").alias("cur_title"), F.col("summary").alias("cur_summary"), "release_year", "pages_count")
    m = table(spark, d, "story_meta").select((F.col("meta_id") - 100_000_000_000).alias("k"), "title", "description", "author", "category", "storyurl", "site", "story_status")
    return b.join(m.hint("merge"), "k")


@query(f"""WITH {_BOOK}
SELECT k, concat_ws(';',
  CASE WHEN title IS NOT NULL AND title IS DISTINCT FROM cur_title THEN 'title=' || title END,
  CASE WHEN coalesce(description, '') <> cur_summary THEN 'summary=' || coalesce(description, '') END,
  CASE WHEN date_no IS NOT NULL AND date_no <> 1 THEN 'releaseDate=202' || date_no || '-01-01' END,
  CASE WHEN author IS NOT NULL THEN 'authors=["' || 'a' || (k % 9) || '"]' END,
  CASE WHEN k % 6 <> 2 THEN 'number=' || CASE WHEN idx = floor(idx) THEN CAST(CAST(idx AS INT) AS VARCHAR) ELSE CAST(idx AS VARCHAR) END END,
  CASE WHEN k % 6 <> 4 THEN 'numberSort=' || CASE WHEN idx = floor(idx) THEN CAST(CAST(idx AS INT) AS VARCHAR) ELSE CAST(idx AS VARCHAR) END END,
  CASE WHEN k % 2 = 0 THEN 'isbn=9780306406157' END,
  CASE WHEN k % 5 <> 0 THEN 'tags=["t' || (k % 5) || '","x"]' END,
  CASE WHEN k % 3 <> 1 THEN 'links=[' || CASE WHEN k % 3 = 0 THEN '' ELSE '{{"label":"Shop","url":"s"}},' END || '{{"label":"Book","url":"u' || k || '"}}]' END) AS patch
FROM b JOIN m USING (k)""")
def book_patch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    link = lambda a, u: F.struct(F.lit(a).alias("label"), u.alias("url"))
    none = F.array().cast("array<struct<label:string,url:string>>")
    book_url = F.concat(F.lit("u"), k)
    local = {
        "title": F.col("title"), "synopsis": _none(), "description": F.col("description"), "published": F.when(k % 3 != 0, F.make_date(2020 + (k % 4).cast("int"), F.lit(1), F.lit(1))),
        "authors": F.when(S.blank_to_null(F.col("author")).isNotNull(), F.array(F.concat(F.lit(" a"), k % 9), F.lit(" "))).otherwise(F.array().cast("array<string>")),
        "series_index": (k % 6).cast("double") / 2, "identifiers": F.when(k % 2 == 0, "x:1, ISBN : 0-306-40615-2").otherwise("isbn:0306406153"),
        "tags": F.array(F.concat(F.lit("t"), k % 5), F.lit("x")), "book_url": book_url, "author_url": F.lit(" "),
    }
    current = {
        "title": F.col("cur_title"), "summary": F.col("cur_summary"), "release_date": F.lit("2021-01-01"), "authors": F.array(F.lit("b")), "number": F.lit("1"), "number_sort": F.lit(2.0),
        "isbn": _none(), "tags": F.array(F.lit("X"), F.lit("T0")), "links": F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(link("Book", book_url))).otherwise(F.array(link("Shop", F.lit("s")), link("Book", F.lit("old")))),
    }
    shown = F.array_join(F.transform(F.map_entries(L.book_patch(local, current)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _books(spark, d).select("k", shown.alias("patch"))


@query(f"""WITH {_BOOK}
SELECT k, concat_ws(';', CASE WHEN k % 4 <> 1 THEN 'genres=["g' || (k % 4) || '","Het"]' END,
  CASE WHEN story_status = 'Completed' THEN 'status=ENDED' WHEN story_status = 'In-Progress' AND k % 2 = 0 THEN 'status=ONGOING' END,
  CASE WHEN site IS NOT NULL AND k % 3 <> 0 THEN 'publisher=' || site END,
  CASE WHEN k % 5 = 0 THEN 'links=[{{"label":"Story","url":"series ' || k || '"}}]' WHEN storyurl IS NOT NULL THEN 'links=[{{"label":"Story","url":"' || storyurl || '"}}]' END) AS patch
FROM b JOIN m USING (k) WHERE storyurl IS NULL OR storyurl = trim(storyurl)""")
def series_patch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    local = {
        "category": F.concat(F.lit("g"), k % 4, F.lit(", Het")), "status": F.col("story_status"), "publisher": F.lit(" "), "site": F.col("site"),
        "series": F.when(k % 5 == 0, "A series"), "series_url": F.concat(F.lit("series "), k), "story_url": F.col("storyurl"),
    }
    current = {"genres": F.array(F.lit("HET"), F.lit("G1"), F.lit("het")), "status": F.when(k % 2 == 1, "ONGOING"), "publisher": F.when(k % 3 == 0, F.col("site")), "links": F.lit(None).cast("array<struct<label:string,url:string>>")}
    shown = F.array_join(F.transform(F.map_entries(L.series_patch(local, current)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _books(spark, d).where("storyurl IS NULL OR storyurl = trim(storyurl)").select("k", shown.alias("patch"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS page, CASE WHEN l_linenumber % 4 > 0 THEN 40 * (l_linenumber % 3) END AS pages, CASE l_linenumber % 5 WHEN 0 THEN NULL ELSE l_linenumber % 5 = 1 END AS done,
  l_shipdate AS t, l_partkey % 3 AS href, l_suppkey % 4 AS live FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(done, false) THEN 100 WHEN pages > 0 THEN CAST(least(100, floor(page * 100 / pages)) AS INT) END AS percent,
 CASE WHEN coalesce(done, false) THEN 'read' WHEN page > 0 THEN 'reading' ELSE 'unread' END AS state, page % 3 <> 0 OR coalesce(pages, 0) <> 0 AS progress,
 CASE WHEN href = 0 THEN 'live' WHEN coalesce(t < TIMESTAMP '1995-06-01', false) AND href <> live THEN 'live' ELSE 'stored' END AS kept,
 CASE WHEN page > 1 AND pages IS NULL THEN 'lost' WHEN page > 1 AND coalesce(pages, 0) <= 1 THEN 'page reset' ELSE 'none' END AS repair,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN href = 0 AND live = 0 THEN 'first attempt' WHEN live <> 0 AND page IS DISTINCT FROM pages THEN 'file changed' END AS nudge FROM x""")
def reading_states(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("page"), F.when(n % 4 > 0, 40 * (n % 3)).alias("pages"), F.when(n % 5 != 0, n % 5 == 1).alias("done"), F.col("l_shipdate").alias("t"),
        (F.col("l_partkey") % 3).alias("href"), (F.col("l_suppkey") % 4).alias("live"),
    )
    c = F.col
    state = L.reading_state(c("page"), c("pages"), c("done"))
    address = lambda h: F.concat(F.lit("dir"), n, F.lit("/c"), h, F.lit(".xhtml#p"))
    return x.select(
        "l_orderkey", "l_linenumber", state["percent"].alias("percent"), state["state"].alias("state"), L.has_progress(c("page") % 3, c("pages"), F.lit(None).cast("int")).alias("progress"),
        L.kept_position(c("t"), F.when(c("href") != 0, address(c("href"))), F.lit("1995-06-01").cast("timestamp_ntz"), F.concat(F.lit("other/c"), c("live"), F.lit(".xhtml"))).alias("kept"),
        L.repair_needed(c("page"), c("pages"), F.lit(9), c("pages")).alias("repair"),
        L.nudge_due(F.when(n != 7, F.lit("f")).otherwise(" "), F.when(c("href") != 0, "i"), F.when(c("live") != 0, F.lit(1)), c("pages"), c("page")).alias("nudge"),
    )


@query("""
WITH a AS (SELECT user_id, event_id, event_id % 1000 AS start FROM events),
     s AS (SELECT *, (SELECT min(b.start) FROM (SELECT DISTINCT user_id, start FROM a) b WHERE b.user_id = a.user_id AND b.start > a.start) AS nxt FROM a),
     p AS (SELECT user_id, event_id, start, greatest(1, coalesce(nxt, 1000) - start) AS span, CASE WHEN nxt IS NOT NULL THEN start + greatest(1, nxt - start) - 1 ELSE start + greatest(1, 1000 - start) END AS max_page FROM s),
     q AS (SELECT *, start + event_id % 5 AS page, least(start + event_id % 5, max_page) - start AS o FROM p)
SELECT user_id, event_id, CAST(span AS BIGINT) AS span, CAST(max_page AS BIGINT) AS max_page, greatest(0.0::DOUBLE, CASE WHEN o <= 0 THEN 0.0::DOUBLE ELSE (o - 0.5)::DOUBLE / span END) AS low, least(1.0::DOUBLE, CASE WHEN page >= max_page THEN 1.0::DOUBLE ELSE (o + 0.5)::DOUBLE / span END) AS high FROM q""")
def page_spans(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 1000).alias("start"))
    b = L.page_bounds(a, "user_id", "start", F.lit(1000)).withColumn("page", F.col("start") + F.col("event_id") % 5)
    low, high = L.page_covers(F.col("page"), F.col("start"), F.col("span"), F.col("max_page"))
    return b.select("user_id", "event_id", F.col("span").cast("bigint").alias("span"), F.col("max_page").cast("bigint").alias("max_page"), low.cast("double").alias("low"), high.cast("double").alias("high"))


@query("""
WITH a AS (SELECT l_orderkey AS book, CASE l_returnflag WHEN 'R' THEN 'cover' ELSE 'synopsis' END AS kind, CASE WHEN l_linestatus = 'O' THEN 'other' WHEN l_linenumber % 2 = 0 THEN '' END AS space, 'm' || (l_partkey % 3) AS model, l_linenumber AS n FROM lineitem),
     own AS (SELECT DISTINCT book, model FROM a WHERE kind = 'cover' AND coalesce(nullif(space, ''), 'own') = 'own')
SELECT o_orderkey AS book, m.model FROM orders, (VALUES ('m0'), ('m1'), ('m2')) m(model) WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM own WHERE own.book = o_orderkey AND own.model = m.model)""")
def assets_to_generate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("book"), F.when(li.l_returnflag == "R", "cover").otherwise("synopsis").alias("kind"), F.when(li.l_linestatus == "O", "other").when(li.l_linenumber % 2 == 0, "").alias("space"), F.concat(F.lit("m"), li.l_partkey % 3).alias("model"))
    books = table(spark, d, "orders").select(F.col("o_orderkey").alias("book"), (F.col("o_orderstatus") == "P").alias("edited"), F.explode(F.array(F.lit("m0"), F.lit("m1"), F.lit("m2"))).alias("model"))
    return L.to_generate(books, L.own_candidates(a, "kind", "space", "cover", "own"), "book", "model", F.col("edited")).select("book", "model")


@query("""
WITH c AS (SELECT l_orderkey AS s, l_linenumber AS pos, [{'id': CASE WHEN l_linenumber % 3 > 0 THEN l_partkey END, 'path': '/lib/x' || (l_suppkey % 4) || '/b' || (l_partkey % 5) || '.epub'}, {'id': l_partkey, 'path': 'c\\b' || (l_suppkey % 5) || '.epub'}] AS files FROM lineitem),
     f AS (SELECT s, pos, unnest(files) AS f, generate_subscripts(files, 1) - 1 AS fp FROM c),
     w AS (SELECT o_orderkey AS s, unnest(['b1.epub', 'x2/b3.epub', 'C/B2.epub']) AS path FROM orders),
     h AS (SELECT w.s, w.path, min({'a': pos, 'b': fp, 'c': f.id}) AS b FROM w JOIN f ON w.s = f.s WHERE f.id IS NOT NULL AND (replace(f.path, '\\', '/') = lower(w.path) OR ends_with(replace(f.path, '\\', '/'), '/' || lower(w.path))) GROUP BY 1, 2)
SELECT s, path, CAST(b.a AS INT) AS chapter_pos, CAST(b.b AS INT) AS file_pos, b.c AS file_id FROM h""")
def matching_files(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    one = F.struct(F.when(li.l_linenumber % 3 > 0, li.l_partkey).alias("id"), F.concat(F.lit("/lib/x"), li.l_suppkey % 4, F.lit("/b"), li.l_partkey % 5, F.lit(".epub")).alias("path"))
    two = F.struct(li.l_partkey.alias("id"), F.concat(F.lit("c\\b"), li.l_suppkey % 5, F.lit(".epub")).alias("path"))
    chapters = li.select(F.col("l_orderkey").alias("s"), F.col("l_linenumber").alias("pos"), F.array(one, two).alias("files"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("s"), F.explode(F.array(F.lit("b1.epub"), F.lit("x2/b3.epub"), F.lit("C/B2.epub"))).alias("path")).withColumn("folded", S.nfc_casefold(F.col("path")))
    return L.matching_file(chapters, wanted, "s", "files", "path", "folded")
