"""Queries of merge plans, page text, option text and locked packages over whole tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import assembly as A
from folioworks.operators import changes as C
from folioworks.operators import merge_plan as G
from folioworks.operators import ordering as O
from folioworks.plans.registry import Registry
from folioworks.session import table

_ALL = Registry()
query = _ALL.query


def queries() -> dict:
    return dict(_ALL.found)


def oracle_sql() -> dict[str, str]:
    return dict(_ALL.sql)


_ZONED = """
c AS (SELECT story_id AS b, doc_id AS nav, chapter_no AS num, CASE doc_kind WHEN 'synopsis' THEN 0 WHEN 'note' THEN 1 WHEN 'comment' THEN 3 ELSE 2 END AS zone, 'k' || doc_id AS key FROM documents WHERE story_id IS NOT NULL),
pl AS (SELECT *, zone = 2 AND num IS NOT NULL AS s, row_number() OVER (PARTITION BY b ORDER BY zone, nav) AS place FROM c),
sl AS (SELECT b, place, row_number() OVER (PARTITION BY b ORDER BY place) AS k FROM pl WHERE s),
nk AS (SELECT b, nav, row_number() OVER (PARTITION BY b ORDER BY num, nav) AS k FROM pl WHERE s),
au AS (SELECT pl.*, coalesce(sl.place, pl.place) AS auto FROM pl LEFT JOIN nk ON pl.b = nk.b AND pl.nav = nk.nav LEFT JOIN sl ON sl.b = nk.b AND sl.k = nk.k),
st AS (SELECT b, list(key ORDER BY nav DESC) FILTER (nav % 3 = 0) AS stored, b % 4 AS q FROM c GROUP BY b),
jo AS (SELECT au.*, CASE WHEN q IN (1, 2) AND len(stored) > 0 AND zone = 2 THEN true ELSE false END AS m, CASE WHEN list_contains(stored, key) THEN list_position(stored, key) END AS sat FROM au JOIN st USING (b)),
an AS (SELECT *, CASE WHEN sat IS NOT NULL THEN sat * 1000000 + auto ELSE last_value(CASE WHEN sat IS NOT NULL THEN sat * 1000000 + auto END IGNORE NULLS) OVER (PARTITION BY b ORDER BY auto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS anchor FROM jo WHERE m),
me AS (SELECT b, nav, (SELECT min(auto) FROM an x WHERE x.b = an.b) - 1 + row_number() OVER (PARTITION BY b ORDER BY anchor NULLS FIRST, CASE WHEN sat IS NOT NULL THEN 0 ELSE 1 END, nav DESC) AS p FROM an)"""


@query(f"""WITH {_ZONED}
SELECT jo.b AS story_id, jo.nav AS doc_id, CAST(coalesce(me.p, jo.auto) AS INT) AS new_pos FROM jo LEFT JOIN me ON jo.b = me.b AND jo.nav = me.nav""")
def manual_order(spark: SparkSession, d: str) -> DataFrame:
    """The automatic order with a stored one laid over the content zone; repeated, unreadable and missing orders are ignored."""
    zone = F.when(F.col("doc_kind") == "synopsis", 0).when(F.col("doc_kind") == "note", 1).when(F.col("doc_kind") == "comment", 3).otherwise(2)
    c = table(spark, d, "documents").where("story_id IS NOT NULL").select("story_id", "doc_id", "chapter_no", zone.alias("zone"), F.concat(F.lit("k"), "doc_id").alias("key"))
    keys = F.transform(F.sort_array(F.collect_list(F.when(F.col("doc_id") % 3 == 0, F.struct("doc_id", "key"))), asc=False), lambda x: x["key"])
    q = F.col("story_id") % 4
    stored = c.groupBy("story_id").agg(keys.alias("k")).select("story_id", F.when(q.isin(1, 2), F.to_json("k")).when(q == 3, F.to_json(F.concat("k", "k"))).otherwise('{"a": 1}').alias("text"))
    j = c.join(stored.hint("merge"), "story_id").withColumn("stored", O.stored_order(F.col("text"))).drop("text")
    return O.zoned_order(j, "story_id", "doc_id", F.col("zone"), F.col("chapter_no"), "key", F.col("stored")).select("story_id", "doc_id", "new_pos")


_MERGED = """
g AS (SELECT o_custkey AS g, o_orderkey AS b, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE CASE WHEN o_custkey % 3 = 0 THEN 'de' ELSE 'l' || (o_orderkey % 2) END END AS lang, CASE WHEN o_custkey % 2 = 0 THEN 'ltr' WHEN o_orderkey % 2 = 0 THEN 'rtl' ELSE 'ltr' END AS dir,
  CASE o_orderstatus WHEN 'F' THEN 'F & Co' WHEN 'O' THEN ' ' END AS pub, 'B' || o_orderkey AS title, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS descr, CASE WHEN o_orderkey % 4 = 0 THEN '3.1' WHEN o_orderkey % 4 = 1 THEN '2.0' END AS ver FROM orders)"""


@query(f"""WITH {_MERGED}
SELECT g, coalesce(CASE WHEN min(nullif(lang, '')) = max(nullif(lang, '')) THEN min(nullif(lang, '')) END, arg_min({{'l': nullif(lang, '')}}, b).l, 'en') AS language, CASE WHEN min(dir) = max(dir) THEN min(dir) END AS direction,
 arg_min({{'p': nullif(trim(pub), '')}}, b).p AS publisher, string_agg(title || ': ' || descr, chr(10) ORDER BY b) AS description, CASE WHEN coalesce(bool_or(ver LIKE '3%'), false) THEN '3.0' ELSE '2.0' END AS version FROM g GROUP BY g""")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    books = table(spark, d, "orders").select(
        c.alias("g"), k.alias("b"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.lit(None).cast("string")).otherwise(F.when(c % 3 == 0, "de").otherwise(F.concat(F.lit("l"), k % 2))).alias("language"),
        F.when(c % 2 == 0, "ltr").when(k % 2 == 0, "rtl").otherwise("ltr").alias("direction"),
        F.when(F.col("o_orderstatus") == "F", "F & Co").when(F.col("o_orderstatus") == "O", " ").alias("publisher"), F.concat(F.lit("B"), k).alias("title"),
        F.when(k % 3 > 0, F.col("o_orderpriority")).alias("description"), F.when(k % 4 == 0, "3.1").when(k % 4 == 1, "2.0").alias("version"),
    )
    return G.merged_metadata(books, "g", "b", {"publisher": F.lit(" ")})


@query("""
WITH t AS (SELECT p_partkey AS k, CASE WHEN p_size % 3 = 0 THEN p_name || ' & <b>' ELSE p_name END AS title, CASE WHEN p_size % 2 = 0 THEN p_brand END AS creator, CASE WHEN p_size % 5 = 0 THEN 'c/' || p_size || '.jpg' WHEN p_size % 5 = 1 THEN ' ' END AS given, CASE WHEN p_size % 7 > 2 THEN 's.png' END AS own FROM part),
     e AS (SELECT *, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM t)
SELECT k, '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en"><head><title>' || x || '</title><link rel="stylesheet" type="text/css" href="a&amp;b.css"/></head><body><h1>' || x || '</h1>' || CASE WHEN creator IS NOT NULL THEN '<p class="creators">' || creator || ', Z</p>' ELSE '' END || '</body></html>' AS page,
 coalesce(nullif(trim(given), ''), own) AS cover, CASE WHEN nullif(trim(given), '') IS NOT NULL THEN 'given' WHEN own IS NOT NULL THEN 'survivor' ELSE 'none' END AS cover_from,
 CASE WHEN coalesce(nullif(trim(given), ''), own) IS NOT NULL THEN '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>Cover</title></head><body><img alt="Cover" src="' || coalesce(nullif(trim(given), ''), own) || '"/></body></html>' END AS cover_page FROM e""")
def title_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    title = F.when(n % 3 == 0, F.concat("p_name", F.lit(" & <b>"))).otherwise(F.col("p_name"))
    none = F.array().cast("array<string>")
    page = G.title_page(title, F.when(n % 2 == 0, F.array("p_brand", F.lit("Z"))).otherwise(none), none, F.lit("en"), F.array(F.lit("a&b.css")))
    cover = G.chosen_cover(F.when(n % 5 == 0, F.concat(F.lit("c/"), n, F.lit(".jpg"))).when(n % 5 == 1, " "), F.when(n % 7 > 2, "s.png"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), page.alias("page"), cover["path"].alias("cover"), cover["source"].alias("cover_from"), G.cover_page(cover["path"]).alias("cover_page"))


@query("""
WITH p AS (SELECT p_brand AS g, p_partkey AS o, CASE p_size % 4 WHEN 0 THEN p_type || '/' || split_part(p_name, ' ', 1) || '.xhtml' WHEN 1 THEN (p_size % 9) || '_x.css' WHEN 2 THEN '..' ELSE 'Fonts/' || p_type || '.TTF' END AS path FROM part),
     s AS (SELECT *, regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM p),
     v AS (SELECT g, o, CASE WHEN s = '' THEN 'resource' WHEN s[1] BETWEEN '0' AND '9' THEN '_' || s ELSE s END AS s FROM s),
     n AS (SELECT *, row_number() OVER (PARTITION BY g, s ORDER BY o) AS n FROM v)
SELECT o AS k, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS item_id FROM n""")
def resource_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    path = F.when(n % 4 == 0, F.concat("p_type", F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".xhtml"))).when(n % 4 == 1, F.concat(n % 9, F.lit("_x.css"))).when(n % 4 == 2, "..").otherwise(F.concat(F.lit("Fonts/"), "p_type", F.lit(".TTF")))
    return G.resource_ids(table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("k"), path.alias("path")), "p_brand", "path", "k").select("k", "item_id")


@query("""
WITH c AS (SELECT l_orderkey AS g, l_linenumber AS pos, l_partkey, CASE l_partkey % 5 WHEN 0 THEN 'NAV' WHEN 1 THEN NULL ELSE 'c' || l_partkey END AS id, l_suppkey % 4 = 0 AS t, 'f' || l_partkey || '.xhtml' AS f FROM lineitem),
     s AS (SELECT g, min({'p': pos, 'f': f}) FILTER (t).f AS t, min({'p': pos, 'f': f}) FILTER (NOT t AND coalesce(id, '') <> 'NAV').f AS s FROM c GROUP BY g),
     l AS (SELECT g, unnest([1, 2, 3, 4]) AS place, unnest(['cover', 'titlepage', 'toc', 'bodymatter']) AS kind, unnest(['Cover', 'Title Page', 'Table of Contents', 'Start of Content']) AS label, unnest([CASE WHEN g % 3 = 0 THEN 'cover.xhtml' END, t, '#toc', s]) AS target FROM s)
SELECT * FROM l WHERE target IS NOT NULL""")
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("pos"), F.when(k % 5 == 0, "NAV").when(k % 5 != 1, F.concat(F.lit("c"), k)).alias("id"), (F.col("l_suppkey") % 4 == 0).alias("t"), F.concat(F.lit("f"), k, F.lit(".xhtml")).alias("f"))
    covers = c.select("g").distinct().withColumn("cover", F.when(F.col("g") % 3 == 0, "cover.xhtml").otherwise(""))
    return G.landmarks(c, "g", "pos", "id", F.col("t"), "f", covers, "cover")


@query("""
WITH x AS (SELECT p_partkey AS k, p_size AS n FROM part)
SELECT k, CASE WHEN n % 3 = 0 THEN '<head><LINK href="old' || n || '.css" rel="stylesheet"/><link rel="next" href="n"/><link rel=stylesheet href="b.css"></head><svg/><p/>' WHEN n % 4 = 0 THEN '<head><link rel="next" href="n"/></head><m:math x="1"><script>' 
 ELSE '<head>' || CASE WHEN n % 5 > 0 THEN '<link rel="stylesheet" type="text/css" href="s1.css"/><link rel="stylesheet" type="text/css" href="s2.css"/>' ELSE '' END || '<link rel="next" href="n"/></head><mathx><scripts>' END AS text,
 CASE WHEN n % 3 = 0 THEN 'svg' WHEN n % 4 = 0 THEN 'mathml scripted' ELSE '' END AS properties FROM x""")
def canonical_stylesheets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    old = F.concat(F.lit('<head><LINK href="old'), n, F.lit('.css" rel="stylesheet"/><link rel="next" href="n"/><link rel=stylesheet href="b.css"></head>'))
    text = F.when(n % 3 == 0, F.concat(old, F.lit("<svg/><p/>"))).when(n % 4 == 0, F.lit('<head><link rel="next" href="n"/></head><m:math x="1"><script>')).otherwise(F.concat(old, F.lit("<mathx><scripts>")))
    sheets = F.when(n % 5 > 0, F.array(F.lit("s1.css"), F.lit("s2.css"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), G.relinked_stylesheets(text, sheets, n % 3 == 0).alias("text"), G.content_properties(text).alias("properties"))


@query("""
WITH c AS (SELECT l_orderkey AS g, CASE WHEN l_partkey % 4 = 0 THEN 'Nav' ELSE 'c' || l_linenumber END AS id FROM lineitem), e AS (SELECT o_orderkey AS g, o_custkey % 5 AS n FROM orders),
     h AS (SELECT g, count(*) AS n FROM c WHERE id <> 'Nav' GROUP BY g)
SELECT 'chapters' AS check_name, e.g || ': ' || coalesce(h.n, 0) || ' of ' || e.n AS detail FROM e LEFT JOIN h USING (g) WHERE coalesce(h.n, 0) < e.n
UNION ALL SELECT DISTINCT 'twice', CAST(l_partkey AS VARCHAR) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) > 1)""")
def plan_checks(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    c = li.select(F.col("l_orderkey").alias("g"), F.when(F.col("l_partkey") % 4 == 0, "Nav").otherwise(F.concat(F.lit("c"), "l_linenumber")).alias("id"))
    few = G.too_few(c, o.select(F.col("o_orderkey").alias("g"), (F.col("o_custkey") % 5).alias("n")), "g", "id", "n")
    return few.unionByName(C.repeated(li, "twice", "l_partkey"))


@query("""
WITH RECURSIVE e AS (SELECT user_id AS g, event_id AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
p AS (SELECT e.g, e.n, e.r, q.n AS parent FROM e LEFT JOIN e q ON e.g = q.g AND q.r = e.r // 4 AND e.r // 4 > 0 WHERE e.r <= 1000),
t AS (SELECT g, n, 1 AS level, [r] AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.g, p.n, t.level + 1, list_append(t.path, p.r) FROM p JOIN t ON p.g = t.g AND p.parent = t.n)
SELECT g AS user_id, n AS event_id, level, CAST(row_number() OVER (PARTITION BY g ORDER BY path) AS INT) AS place FROM t""")
def flat_contents(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id"), "event_id").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")).where("r <= 1000")
    up = e.select("user_id", F.col("event_id").alias("parent"), F.col("r").alias("up"))
    tree = e.withColumn("up", F.when(F.expr("r div 4") > 0, F.expr("r div 4"))).join(up, ["user_id", "up"], "left")
    return G.flat_contents(tree, "user_id", "event_id", "parent", "r").select("user_id", "event_id", "level", "place")


@query("""
WITH c AS (SELECT l_orderkey AS b, l_linenumber AS n, l_quantity AS q, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'http://own/' || l_partkey WHEN l_partkey % 3 = 1 THEN ' ' END AS own, l_suppkey % 9 = 0 AS title, CASE l_orderkey % 4 WHEN 0 THEN 'http://given/' || l_orderkey WHEN 1 THEN 'http://source/' || l_orderkey WHEN 2 THEN 'http://page/' || l_orderkey END AS url FROM lineitem),
     f AS (SELECT b, count(*) AS k, count(nullif(trim(own), '')) AS d FROM c WHERE NOT title GROUP BY b)
SELECT c.b AS book, c.n AS line, l_partkey, CASE WHEN NOT title AND (k = 1 OR d = 0) THEN coalesce(c.url, nullif(trim(own), '')) ELSE nullif(trim(own), '') END AS url FROM c LEFT JOIN f USING (b)""")
def chapter_addresses(spark: SparkSession, d: str) -> DataFrame:
    k, b = F.col("l_partkey"), F.col("l_orderkey")
    at = lambda name, on: F.when(b % 4 == on, F.concat(F.lit(f"http://{name}/"), b))
    c = table(spark, d, "lineitem").select(b.alias("book"), F.col("l_linenumber").alias("line"), "l_partkey", F.when(k % 3 == 0, F.concat(F.lit("http://own/"), k)).when(k % 3 == 1, " ").alias("own"), (F.col("l_suppkey") % 9 == 0).alias("title"), at("given", 0).alias("g"), F.coalesce(at("source", 1), F.lit("urn:x")).alias("s"), at("page", 2).alias("t"))
    return A.stamp_addresses(c, "book", "own", A.book_address(F.col("g"), F.col("s"), F.col("t")), F.col("title")).select("book", "line", "l_partkey", "url")


@query("""
WITH s AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS page, l_linenumber % 4 AS y, l_partkey AS x, CASE WHEN l_quantity > 40 THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS size, CASE l_partkey % 4 WHEN 0 THEN '12' WHEN 1 THEN ' ' ELSE 'w' || l_partkey || ' ' END AS text FROM lineitem),
     l AS (SELECT doc, page, y, max(size) AS size, trim(string_agg(text, '' ORDER BY x, text)) AS text FROM s GROUP BY ALL),
     p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, y) AS place FROM l WHERE text <> '' AND NOT regexp_full_match(text, '[0-9]+')),
     m AS (SELECT doc, median(size) AS m FROM s GROUP BY doc),
     h AS (SELECT doc, page, y, lead(page) OVER (PARTITION BY doc ORDER BY page, y) AS end_page FROM p JOIN m USING (doc) WHERE size >= m * 1.3 AND length(text) < 20)
SELECT p.doc, CAST(p.page AS BIGINT) AS page, CAST(p.y AS BIGINT) AS y, p.text, CAST(p.place AS INT) AS place, h.doc IS NOT NULL AS heading, CAST(h.end_page AS BIGINT) AS end_page FROM p LEFT JOIN h ON p.doc = h.doc AND p.page = h.page AND p.y = h.y""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    text = F.when(k % 4 == 0, "12").when(k % 4 == 1, " ").otherwise(F.concat(F.lit("w"), k, F.lit(" ")))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).cast("bigint").alias("page"), (F.col("l_linenumber") % 4).cast("bigint").alias("y"), k.alias("x"), F.when(F.col("l_quantity") > 40, 20.0).otherwise(10.0).alias("size"), text.alias("text"))
    lines = G.page_lines(s, "doc")
    h = G.headings(lines, s, "doc", 1.3, 11.0, 20).select("doc", "page", "y", F.lit(True).alias("heading"), "end_page")
    return lines.join(h, ["doc", "page", "y"], "left").select("doc", "page", "y", "text", "place", F.coalesce("heading", F.lit(False)).alias("heading"), "end_page")


@query("""
WITH t AS (SELECT book_key AS k, CASE book_key % 4 WHEN 0 THEN 'Given' WHEN 1 THEN ' ' END AS g, CASE book_key % 3 WHEN 0 THEN 'Untitled' WHEN 1 THEN title END AS i, CASE WHEN book_key % 5 > 0 THEN summary END AS f FROM library_books)
SELECT k, coalesce(nullif(trim(g), ''), CASE WHEN k % 3 = 1 AND lower(nullif(trim(i), '')) <> 'untitled' THEN nullif(trim(i), '') END, nullif(trim(f), ''), 'stem') AS title, coalesce(nullif(trim(i), ''), CASE WHEN k % 2 = 0 THEN 'own' END, 'file.x') AS label FROM t""")
def document_titles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("book_key")
    info = F.when(k % 3 == 0, "Untitled").when(k % 3 == 1, F.col("title"))
    title = G.document_title(F.when(k % 4 == 0, "Given").when(k % 4 == 1, " "), info, F.when(k % 5 > 0, F.col("summary")), F.lit("stem"))
    return table(spark, d, "library_books").select(k.alias("k"), title.alias("title"), G.chapter_label(info, F.when(k % 2 == 0, "own").otherwise(""), F.lit("dir/file.x.html")).alias("label"))


@query("""
WITH t AS (SELECT p_partkey AS k, p_size % 6 AS n FROM part),
     x AS (SELECT k, n IN (1, 4) AS u, n IN (2, 4, 5) AS o FROM t)
SELECT k, true AS blocking, CASE WHEN k % 2 = 0 THEN 'lines 3 and 7' ELSE 'line 3' END || ': sign-ins do not belong here' AS message, 1 AS part FROM x WHERE u
UNION ALL SELECT k, false, CASE WHEN k % 3 = 0 THEN 'lines 4, 5 and 6: include_images and is_adult are set elsewhere' ELSE 'line 4: is_adult is set elsewhere' END, 2 FROM x WHERE o""")
def option_problems(spark: SparkSession, d: str) -> DataFrame:
    p = _option_text(spark, d)
    r = G.option_problems(p, "k", "text", ["username", "password"], ["is_adult", "include_images"])
    return r.withColumn("part", F.when(F.col("blocking"), 1).otherwise(2))


@query("""
WITH t AS (SELECT p_partkey AS k, p_size % 6 AS n FROM part)
SELECT k, '[defaults]' || chr(10) || '# username: x' || chr(10) || CASE WHEN n IN (1, 4) THEN 'UserName = me' ELSE 'plain: 1' END || chr(10) || CASE WHEN n IN (2, 4, 5) THEN 'is_adult: true' ELSE '' END || chr(10) || CASE WHEN n IN (2, 4, 5) AND k % 3 = 0 THEN '' ELSE 'x' || chr(10) || 'y' || chr(10) END || CASE WHEN n IN (1, 4) AND k % 2 = 0 THEN 'password: p' ELSE 'z: 1' END AS text FROM t""")
def options_without_names(spark: SparkSession, d: str) -> DataFrame:
    return _option_text(spark, d).select("k", G.without_options(F.col("text"), ["output_filename", "include_images"]).alias("text"))


def _option_text(spark: SparkSession, d: str) -> DataFrame:
    """Option text whose lines vary by row."""
    k, n = F.col("p_partkey"), F.col("p_size") % 6
    two = n.isin(2, 4, 5) & (k % 3 == 0)
    lines = [
        F.lit("[defaults]"), F.lit("# username: x"), F.when(n.isin(1, 4), "UserName = me").otherwise("plain: 1"), F.when(n.isin(2, 4, 5), "is_adult: true").otherwise(""),
        F.when(two, "include_images: a").otherwise("x"), F.when(two, "include_images = b\n  more").otherwise("y"), F.when(n.isin(1, 4) & (k % 2 == 0), "password: p").otherwise("z: 1"),
    ]
    # The continuation line stands behind line 6 and moves the last one down only where nothing is asked of it.
    shifted = F.when(two & n.isin(1, 4) & (k % 2 == 0), F.regexp_replace(lines[5], "\n  more", "")).otherwise(lines[5])
    lines[5] = shifted
    return table(spark, d, "part").select(k.alias("k"), F.array_join(F.array(*lines), "\n").alias("text"))


@query("""
WITH u AS (SELECT l_suppkey AS s, max(l_shipdate) AS t FROM lineitem GROUP BY 1), f AS (SELECT s, t FROM u WHERE t > TIMESTAMP '1998-11-01'),
     p AS (SELECT DISTINCT 'pkg-' || (l_partkey % 50) || '-x' AS name, '1.' || (l_suppkey % 3) AS v FROM lineitem WHERE l_linenumber = 1), g AS (SELECT DISTINCT 'pkg-' || p_partkey || '-x' AS name, '1.1' AS v FROM part WHERE p_partkey < 30)
SELECT CAST(s AS VARCHAR) AS name, 'fresh' AS problem FROM f UNION ALL SELECT DISTINCT p.name, CASE WHEN g.v IS NULL THEN 'missing' ELSE 'different' END FROM p LEFT JOIN g ON p.name = g.name WHERE p.v IS DISTINCT FROM g.v""")
def locked_packages(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    packages = li.groupBy(F.col("l_suppkey").cast("string").alias("name"), F.col("l_linenumber")).agg(F.collect_set(F.struct(F.col("l_shipdate").alias("upload_time"))).alias("files"))
    fresh = G.fresh(G.newest_uploads(packages, "name", "files"), "newest", F.lit("1998-11-01").cast("timestamp_ntz")).select("name", F.lit("fresh").alias("problem"))
    pin = S.exact_version(F.concat(F.lit("Pkg_"), F.col("l_partkey") % 50, F.lit(".X == 1."), F.col("l_suppkey") % 3))
    pins = li.where("l_linenumber = 1").select(F.concat(F.lit("Pkg_"), F.col("l_partkey") % 50, F.lit(".X")).alias("name"), pin.alias("version"))
    group = table(spark, d, "part").where("p_partkey < 30").select(F.concat(F.lit("pkg--"), "p_partkey", F.lit("-x")).alias("name"), F.lit("1.1").alias("version"))
    return fresh.unionByName(G.pin_problems(pins, group, "name", "version"))


@query("""
WITH c AS (SELECT l_orderkey AS g, l_linenumber AS n, l_partkey AS b, CASE l_partkey % 4 WHEN 0 THEN 'The Gate' WHEN 1 THEN 'The Gate, Part ' || (l_suppkey % 3 + 1) WHEN 2 THEN 'The Wall ' || (l_suppkey % 3 + 2) ELSE 'the wall' END AS title, CASE WHEN l_partkey % 4 = 1 THEN l_suppkey % 3 + 1 WHEN l_partkey % 4 = 2 THEN l_suppkey % 3 + 2 END AS num FROM lineitem),
     w AS (SELECT g, CASE WHEN title LIKE 'The Gate%' THEN 'the gate' ELSE 'the wall' END AS w, bool_or(num = 1) AS one FROM c WHERE num IS NOT NULL GROUP BY ALL)
SELECT c.g, c.n, c.b, CAST(CASE WHEN num IS NULL AND w.w IS NOT NULL AND NOT one THEN 1 ELSE num END AS BIGINT) AS first_number FROM c LEFT JOIN w ON c.g = w.g AND lower(c.title) = w.w""")
def implied_first(spark: SparkSession, d: str) -> DataFrame:
    m, n = F.col("l_partkey") % 4, F.col("l_suppkey") % 3
    title = F.when(m == 0, "The Gate").when(m == 1, F.concat(F.lit("The Gate, Part "), n + 1)).when(m == 2, F.concat(F.lit("The Wall "), n + 2)).otherwise("the wall")
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("b"), title.alias("title"), F.when(m == 1, n + 1).when(m == 2, n + 2).alias("first_number")).withColumn("min_number", F.col("first_number"))
    return G.with_implied_first(c, "g", "title", "first_number", "min_number").select("g", "n", "b", F.col("first_number").cast("bigint").alias("first_number"))
