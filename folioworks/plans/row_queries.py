"""Queries of the story row operators over whole tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import nested_records as N
from folioworks.operators import relational as R
from folioworks.operators import story_rows as W
from folioworks.plans.data_queries import _DOCS
from folioworks.plans.registry import Registry
from folioworks.session import table

_ALL = Registry()
query = _ALL.query

#: Names of some category ids; the others fall back to their addresses.
CATEGORIES = {1: "Heist", 2: "Drama", 3: "Comedy", 5: "Space", 8: "Letters", 13: "Winter"}


def queries() -> dict:
    return dict(_ALL.found)


def oracle_sql() -> dict[str, str]:
    return dict(_ALL.sql)


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items())
_ACTIVITIES = _DOCS.format(table="wall_pages", list="data") + f""",
acts AS (SELECT page_id, pos, rec->>'$.id' AS activity_id, rec->'$.what' AS w, rec->>'$.when' AS t FROM r WHERE rec->>'$.action' = 'published-story' AND json_type(rec->'$.what') = 'OBJECT'),
f AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, activity_id, w->>'$.id' AS story_id, nullif(w->>'$.id', '') AS slug, nullif(w->>'$.type', '') AS kind, nullif(w->>'$.title', '') AS title,
  coalesce(nullif(w->>'$.author.username', ''), nullif(w->>'$.authorname', '')) AS author, CASE nullif(w->>'$.category', '') {_CASE} END AS named, nullif(w->>'$.category_info.pageUrl', '') AS page_url,
  TRY_CAST(w->>'$.rate_all' AS DOUBLE) AS rating, TRY_CAST(w->>'$.words_count' AS BIGINT) AS words, json_type(w->'$.series') = 'OBJECT' AS s, nullif(w->>'$.series.meta.title', '') AS st, w, t FROM acts),
act AS (SELECT *, '/' || CASE kind WHEN 'poem' THEN 'p' WHEN 'illustra' THEN 'i' ELSE 's' END || '/' || slug AS url FROM f WHERE slug IS NOT NULL AND story_id IS NOT NULL)
"""


def _activities(spark: SparkSession, d: str) -> DataFrame:
    """The works of these payloads have no address of their own; their id stands for it."""
    return W.activity_rows(table(spark, d, "wall_pages"), "page_id", "payload", N.SHAPES["wall_pages"]["lists"], "published-story", CATEGORIES, "$.id")


@query(_ACTIVITIES + """SELECT page_id, pos, activity_id, story_id, url, title, author, rating, words, CASE WHEN s THEN st END AS work,
 CASE WHEN s AND json_type(w->'$.series.items') = 'ARRAY' THEN CAST(json_array_length(w->'$.series.items') AS INT) END AS parts, CASE w->>'$.is_new' WHEN 'true' THEN 'true' WHEN '1' THEN 'true' WHEN 'false' THEN 'false' WHEN '0' THEN 'false' END AS is_new,
 nullif(array_to_string(list_filter(list_transform(CASE json_type(w->'$.tags') WHEN 'ARRAY' THEN CAST(w->'$.tags' AS JSON[]) WHEN 'OBJECT' THEN [w->'$.tags'] END, lambda e: CASE WHEN json_type(e) = 'OBJECT' AND json_type(e->'$.tag') NOT IN ('OBJECT', 'ARRAY') THEN e->>'$.tag' END), lambda x: x IS NOT NULL AND x <> ''), ', '), '') AS tags,
 strftime(make_timestamp(TRY_CAST(t AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS announced FROM act""")
def activity_rows(spark: SparkSession, d: str) -> DataFrame:
    a = _activities(spark, d)
    return a.select("page_id", "pos", "activity_id", "story_id", "url", "title", "author", "rating", "words", "work", "parts", F.try_element_at("custom", F.lit("Is New")).alias("is_new"), "tags", "announced")


@query(_ACTIVITIES + "SELECT story_id, arg_min(page_id, (page_id, pos)) AS page_id, CAST(count(*) AS BIGINT) AS seen FROM act GROUP BY 1")
def activity_stories(spark: SparkSession, d: str) -> DataFrame:
    """Each story once, at its first place, with how often it was announced."""
    return W.first_sightings(_activities(spark, d).select("story_id", "page_id", "pos"), "story_id", ["page_id", "pos"]).select("story_id", "page_id", "seen")


@query("""
WITH u AS (SELECT DISTINCT category_id FROM stories WHERE category_id IS NOT NULL AND category_id NOT IN (1, 2, 3, 5, 8, 13))
SELECT coalesce(string_agg(CAST(category_id AS VARCHAR), ', ' ORDER BY category_id), '') AS unmapped FROM u""")
def unmapped_categories(spark: SparkSession, d: str) -> DataFrame:
    return W.unmapped(table(spark, d, "stories").select("category_id"), "category_id", list(CATEGORIES))


@query("""
WITH x AS (SELECT c_custkey AS k, c_custkey % 7 AS s, c_custkey % 3 AS e, DATE '2024-01-01' + CAST(c_custkey % 400 AS INT) AS d FROM customer)
SELECT k, CASE s WHEN 0 THEN NULL WHEN 1 THEN 'Free' WHEN 2 THEN 'Payment declined' WHEN 3 THEN 'Former' WHEN 4 THEN NULL ELSE CASE e WHEN 0 THEN 'Active' WHEN 1 THEN 'Cancelled' ELSE 'Cancelled (access until ' || strftime(d, '%-d %b %Y') || ')' END END AS label, k % 5 IN (1, 2) AS signed_in FROM x""")
def membership_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s, e = k % 7, k % 3
    status = F.when(s == 1, '"patron_status": null').when(s == 2, '"patron_status": "declined_patron"').when(s == 3, '"patron_status": "former_patron"').when(s == 4, '"patron_status": "strange"').when(s > 4, '"patron_status": "active_patron"').otherwise('"other": 1')
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd'T'03:04:05'Z'")
    end = F.when(e == 0, ', "pledge_relationship_end": ""').when(e == 1, ', "pledge_relationship_end": "2024-02-02", "access_expires_at": "never"').otherwise(F.concat(F.lit(', "pledge_relationship_end": "2024-02-02", "access_expires_at": "'), day, F.lit('"')))
    member = F.concat(F.lit("{"), status, end, F.lit("}"))
    who = F.when(k % 5 == 1, '{"data": {"id": "7"}}').when(k % 5 == 2, '{"data": {"id": 7}}').when(k % 5 == 3, '{"data": {"id": ""}}').when(k % 5 == 4, '{"data": [1]}').otherwise("{")
    return table(spark, d, "customer").select(k.alias("k"), W.membership_label(member).alias("label"), W.is_signed_in(who).alias("signed_in"))


@query("""
WITH p AS (SELECT post_id, title, campaign_id, post_kind, post_id % 4 AS m FROM posts WHERE campaign_id IS NOT NULL),
     c AS (SELECT DISTINCT campaign_id FROM posts WHERE campaign_id IS NOT NULL)
SELECT post_id, '/file?h=' || post_id || '&m=m' || m AS url, CASE m WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' ELSE 'epub' END AS format, coalesce(nullif(title, ''), 'file.' || post_id) AS title, 'creator ' || campaign_id AS author,
 CASE WHEN post_id % 3 = 1 THEN 'Collection ' || (post_id % 5) END AS series, CASE WHEN campaign_id % 2 = 0 THEN 'Free' END AS membership, post_kind FROM p JOIN c USING (campaign_id) WHERE m > 0""")
def post_rows(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "posts"), F.col("post_id")
    collection = F.when(k % 3 == 1, F.concat(F.lit("Collection "), k % 5)).otherwise("")
    posts = p.select("post_id", "campaign_id", "title", "content", "post_kind", F.lit("c").alias("collection_id"), collection.alias("collection"))
    campaigns = p.where("campaign_id IS NOT NULL").select("campaign_id").distinct().select("campaign_id", F.lit("n").alias("name"), F.concat(F.lit("creator "), "campaign_id").alias("creator"), F.when(F.col("campaign_id") % 2 == 0, "Free").otherwise("").alias("membership"))
    mime = F.when(k % 4 == 1, "Application/PDF").when(k % 4 == 2, "text/plain; charset=utf-8").otherwise("image/x")
    media = p.where(k % 4 > 0).select("post_id", F.concat(F.lit("m"), k % 4).alias("media_id"), F.concat(F.lit("file."), k, F.lit(".docx")).alias("file_name"), mime.alias("mimetype"))
    r = W.post_rows(posts, campaigns, media, "post_id", "campaign_id")
    return r.select("post_id", "url", "format", "title", "author", "series", F.try_element_at("custom", F.lit("Membership")).alias("membership"), F.try_element_at("custom", F.lit("Post Type")).alias("post_kind"))


@query("""
WITH l AS (SELECT l_orderkey AS listing, l_linenumber AS n, CASE l_partkey % 4 WHEN 0 THEN 'https://www.X.example/s/' || (l_suppkey % 3) || '/' WHEN 1 THEN 'http://x.example/s/' || (l_suppkey % 3) WHEN 2 THEN '#top' ELSE 'https://x.example/s/' || (l_suppkey % 3) || '#p' END AS url FROM lineitem),
     i AS (SELECT *, row_number() OVER (PARTITION BY listing ORDER BY n, url) AS pos FROM l)
SELECT listing, url, CAST(min(pos) AS BIGINT) AS pos, 'x.example/s/' || regexp_extract(url, '/s/([0-9]+)', 1) AS identity FROM i WHERE url <> '#top' GROUP BY listing, url""")
def listed_urls(spark: SparkSession, d: str) -> DataFrame:
    li, n = table(spark, d, "lineitem"), F.col("l_suppkey") % 3
    k = F.col("l_partkey") % 4
    url = F.when(k == 0, F.concat(F.lit("https://www.X.example/s/"), n, F.lit("/"))).when(k == 1, F.concat(F.lit("http://x.example/s/"), n)).when(k == 2, "#top").otherwise(F.concat(F.lit("https://x.example/s/"), n, F.lit("#p")))
    link = F.concat(F.lit("<p><a class='c' href=\""), url, F.lit('">x</a>'))
    pages = li.groupBy(F.col("l_orderkey").alias("listing")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", link.alias("h")))), lambda x: x["h"]), " ").alias("html"))
    return W.listed_urls(pages, "listing", "html").select("listing", "url", "pos", "identity")


@query("""
WITH k AS (SELECT DISTINCT storyurl FROM story_meta WHERE meta_id % 3 = 0 AND storyurl IS NOT NULL),
     n AS (SELECT meta_id, storyurl, row_number() OVER (ORDER BY meta_id) AS rn FROM story_meta WHERE storyurl NOT IN (SELECT storyurl FROM k))
SELECT m.meta_id, coalesce(n.rn <= 25, false) AS chosen FROM story_meta m LEFT JOIN n USING (meta_id) WHERE m.storyurl IS NOT NULL""")
def enrich_within_budget(spark: SparkSession, d: str) -> DataFrame:
    """All listed rows, and which of them the fetch budget reaches."""
    m = table(spark, d, "story_meta").where("storyurl IS NOT NULL").select("meta_id", "storyurl")
    return R.mark_within_budget(m.withColumn("row", F.col("meta_id")), m.where("meta_id % 3 = 0"), "storyurl", [F.col("meta_id")], 25, "meta_id").select("meta_id", "chosen")


_LAID = """
WITH s AS (SELECT listing_id AS k, 'https://x.example/s/' || listing_id AS url, title, authorname AS author, blurb AS description, words_count FROM stories),
m AS (SELECT meta_id - 100000000000 AS k, nullif(trim(title), '') AS mt, 'a' || (meta_id % 9) AS ma, CASE WHEN numchapters NOT LIKE '%.%' THEN TRY_CAST(regexp_replace(numchapters, '[,\\s\u00a0\u202f\u2009]', '', 'g') AS BIGINT) END AS ch, CASE WHEN numwords NOT LIKE '%.%' THEN TRY_CAST(regexp_replace(numwords, '[,\\s\u00a0\u202f\u2009]', '', 'g') AS BIGINT) END AS wo,
  CASE (meta_id - 100000000000) % 4 WHEN 0 THEN 'http://www.x.example/s/' || (meta_id - 100000000000) || '/' WHEN 1 THEN 'https://x.example/s/0' WHEN 2 THEN '' END AS mu FROM story_meta WHERE strpos(title, '&') = 0 OR title IS NULL),
p AS (SELECT *, coalesce(mu <> '' AND k % 4 = 1, false) OR coalesce(ch > 1 AND k % 5 = 0 AND nullif(regexp_extract(lower(mt), '([0-9]{1,6})', 1), '') IS NULL, false) AS part FROM s JOIN m USING (k))
"""


@query(_LAID + """SELECT k, part, CASE WHEN part THEN title ELSE coalesce(mt, title) END AS title, ma AS author, CASE WHEN part THEN words_count ELSE coalesce(wo, words_count) END AS words_count,
 CASE WHEN part THEN mt END AS work, CASE WHEN part AND k % 4 = 1 THEN mu END AS work_url FROM p""")
def metadata_laid_over(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stories").select(F.col("listing_id").alias("k"), F.concat(F.lit("https://x.example/s/"), "listing_id").alias("url"), "title", F.col("authorname").alias("author"), "words_count")
    m = table(spark, d, "story_meta").where("instr(title, '&') = 0 OR title IS NULL")
    k = F.col("meta_id") - 100_000_000_000
    mu = F.when(k % 4 == 0, F.concat(F.lit("http://www.x.example/s/"), k, F.lit("/"))).when(k % 4 == 1, "https://x.example/s/0").when(k % 4 == 2, "")
    m = m.select(k.alias("k"), F.col("title").alias("mt"), F.concat(F.lit(" a"), F.col("meta_id") % 9).alias("ma"), S.int_or_null(F.col("numchapters")).alias("ch"), S.int_or_null(F.col("numwords")).alias("wo"), mu.alias("mu"))
    j = s.join(m.hint("merge"), "k")
    part = W.is_part(F.col("url"), F.when(F.col("k") % 5 == 0, 1), F.col("mu"), F.col("ch"), S.chapter_number(F.col("mt")))
    j = j.withColumn("part", part)
    out = W.with_metadata(j, F.col("part"), {"title": F.col("mt"), "author": F.col("ma")}, {"words_count": F.col("wo")}, ["author"], F.col("mt"), F.col("mu"))
    return out.select("k", "part", "title", "author", "words_count", "work", "work_url")


@query("""
WITH c AS (SELECT meta_id, nullif(trim(title), '') AS title, nullif(trim(story_status), '') AS st, CASE meta_id % 3 WHEN 0 THEN 'Ring [' || (meta_id % 7) || ']' WHEN 1 THEN 'Ring [x]' ELSE ' ' END AS series, meta_id % 4 AS q FROM story_meta)
SELECT meta_id, coalesce(title, CASE WHEN q <> 0 THEN 'from book' END, '') AS shown, CASE st WHEN 'Completed' THEN 'ENDED' WHEN 'In-Progress' THEN 'ONGOING' END AS status,
 CASE meta_id % 3 WHEN 0 THEN 'Ring' WHEN 1 THEN 'Ring [x]' END AS series, CASE meta_id % 3 WHEN 0 THEN CAST(meta_id % 7 AS DOUBLE) END AS series_index,
 CASE q WHEN 0 THEN 'genre|ships' WHEN 1 THEN 'a|b c|a' WHEN 2 THEN '' ELSE 'x' END AS keys, CASE q WHEN 1 THEN 3.5::DOUBLE WHEN 2 THEN -2::DOUBLE END AS rating, CASE WHEN q <> 3 THEN CAST('202' || q || '-01-02' AS VARCHAR) END AS synced,
 CASE q WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE 'image/png' END AS cover_type, CASE q WHEN 0 THEN 7 ELSE 0 END AS budget, q <> 1 AND q <> 2 AS bare FROM c""")
def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    from folioworks.operators.library_sync import STATUS, is_bare_filename

    k, q = F.col("meta_id"), F.col("meta_id") % 4
    name, index = W.series_of(F.when(k % 3 == 0, F.concat(F.lit("Ring ["), k % 7, F.lit("]"))).when(k % 3 == 1, "Ring [x]").otherwise(" "))
    keys = S.tag_keys(F.when(q == 1, " a ,b c,,a,status").when(q == 2, "category, ,").when(q == 3, "x"), ["genre", "ships"], ["category", "status", "lastupdate"])
    return table(spark, d, "story_meta").select(
        "meta_id",
        S.display_title(F.trim("title"), F.when(q != 0, "from book").otherwise(" ")).alias("shown"),
        S.mapped(S.blank_to_null(F.col("story_status")), STATUS).alias("status"),
        name.alias("series"),
        index.alias("series_index"),
        F.array_join(keys, "|").alias("keys"),
        S.float_or_null(F.when(q == 1, " 3.5 ").when(q == 2, "-2").otherwise("four")).alias("rating"),
        S.real_instant(F.when(q == 3, "0001-01-01T00:00:00").otherwise(F.concat(F.lit("202"), q, F.lit("-01-02")))).alias("synced"),
        S.image_type(F.when(q == 0, ".JPG").when(q == 1, "webp").otherwise("tiff")).alias("cover_type"),
        S.whole_or_zero(F.when(q == 0, " 7 ").when(q == 1, "-3").otherwise("many")).alias("budget"),
        is_bare_filename(F.when(q == 1, "a/b.jpg").when(q == 2, "..").otherwise("cover.jpg")).alias("bare"),
    )


@query("""
WITH e AS (SELECT o_orderkey AS k, unnest(generate_series(1, o_orderkey % 6 + 1)) AS i FROM orders),
     u AS (SELECT k, i, CASE WHEN i % 5 = 4 THEN NULL ELSE 'c' || ((i * k) % 4) END AS url, CASE WHEN i % 2 = 0 THEN 'T' || i END AS title FROM e)
SELECT k, url, arg_min({'t': title}, i).t AS title, CAST(min(i) AS BIGINT) AS ordinal FROM u WHERE url IS NOT NULL GROUP BY 1, 2""")
def chapter_links(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pair = lambda i: F.when(i % 5 == 4, F.lit('[9, {"title": "no address", "url": 5}]')).otherwise(F.concat(F.lit("["), i, F.lit(', {"title": '), F.when(i % 2 == 0, F.concat(F.lit('"T'), i, F.lit('"'))).otherwise(F.lit("7")), F.lit(', "url": "c'), (i * k) % 4, F.lit('"}]')))
    text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), k % 6 + 1), pair), ", "), F.lit(", null, 3]"))
    return W.chapter_links(table(spark, d, "orders").select(k.alias("k"), text.alias("t")), "k", "t").select("k", "url", "title", "ordinal")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'updated' ELSE 'same' END AS o, l_suppkey % 3 AS site, l_quantity % 3 AS after, (l_quantity % 3) - CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS dist, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 = 1 END AS miss, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 'duplicate chapters' WHEN o = 'created' AND after <> site THEN 'incomplete download' WHEN o = 'updated' AND coalesce(miss, false) THEN 'chapters the site lists are missing' END AS fault,
 l_linenumber <> 2 AND CASE WHEN coalesce(miss, false) THEN o = 'same' ELSE site <= after END AS nothing_new, 5.0::DOUBLE + 87.0::DOUBLE * CASE WHEN site > 0 THEN CAST(after AS DOUBLE) / CAST(site AS DOUBLE) ELSE 1.0::DOUBLE END AS percent,
 CASE WHEN o = 'same' THEN 'same validator' WHEN site = 1 THEN 'same content' END AS unchanged FROM x""")
def download_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(c("l_partkey") % 3 == 0, "created").when(c("l_partkey") % 3 == 1, "updated").otherwise("same").alias("o"), (c("l_suppkey") % 3).alias("site"), (c("l_quantity") % 3).alias("after"),
        (c("l_quantity") % 3 - F.when(c("l_linenumber") == 5, 1).otherwise(0)).alias("dist"), F.when(c("l_linenumber") % 3 > 0, c("l_linenumber") % 3 == 1).alias("miss"),
    )
    return x.select(
        "l_orderkey", "l_linenumber", W.download_fault(c("o"), c("site"), c("after"), c("dist"), c("miss")).alias("fault"),
        W.no_new_content(F.when(c("l_linenumber") != 2, True), c("miss"), c("o") == "same", c("site"), c("after")).alias("nothing_new"),
        W.progress_band(c("after").cast("double"), c("site").cast("double")).alias("percent"),
        W.unchanged(c("o"), F.lit("same"), F.when(c("site") != 2, c("site")), F.lit(1)).alias("unchanged"),
    )


@query("""
SELECT user_id, event_id, CAST(rn - 5 AS INT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 > 0 THEN value END DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn BETWEEN 6 AND 10""")
def reading_changes_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five of each user's changes, newest first."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 > 0, F.col("value")).alias("stamp"))
    return W.newest_first_page(e, "user_id", "stamp", ["event_id"], 1, 5).select("user_id", "event_id", "place")


@query("""
WITH v AS (SELECT part.*, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE p_size END AS field FROM part)
SELECT p_partkey, coalesce(CASE WHEN field IS NOT NULL THEN field >= 20 WHEN p_partkey % 3 = 0 THEN p_size >= 20 WHEN p_partkey % 3 = 1 THEN false ELSE 1 >= 20 END, false) AS kept FROM v""")
def field_or_custom_threshold(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    value = F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, '"99"').otherwise("true")
    custom = F.create_map(F.lit("Votes"), F.parse_json(value))
    return table(spark, d, "part").select("p_partkey", S.meets(F.when(k % 4 != 0, F.col("p_size")), custom, "Votes", 20).alias("kept"))


_BOOKS = _DOCS.format(table="book_pages", list="content")


@query(_BOOKS + """SELECT page_id, CAST(pos AS BIGINT) AS pos, rec->>'$.id' AS book_id, rec->>'$.name' AS name FROM r WHERE rec->>'$.id' IS NOT NULL AND nullif(rec->>'$.name', '') IS NOT NULL AND coalesce(rec->>'$.deleted', 'false') <> 'true'""")
def listed_books(spark: SparkSession, d: str) -> DataFrame:
    """Books of the library listing that have an id and a name and are not deleted."""
    r = N.with_records(table(spark, d, "book_pages"), "book_pages").selectExpr("page_id", "inline_outer(recs)").where("rec_key IS NOT NULL")
    r = r.select("page_id", F.col("rec_pos").alias("pos"), F.col("rec_key").alias("book_id"), F.expr(N.scalar("rec", "$.name")).alias("name"), F.expr(N.scalar("rec", "$.deleted")).alias("gone"))
    return r.where("name <> '' AND coalesce(gone, 'false') <> 'true'").select("page_id", "pos", "book_id", "name")


@query("""
WITH t AS (SELECT 'wall_pages' AS src_table, payload FROM wall_pages UNION ALL SELECT 'book_pages', payload FROM book_pages),
x AS (SELECT src_table, ltrim(payload, chr(65279) || chr(10) || ' ') AS x FROM t),
u AS (SELECT src_table, CASE WHEN json_valid(x) AND json_type(x) = 'VARCHAR' THEN ltrim(json_extract_string(x, '$'), chr(65279) || chr(10) || ' ') ELSE x END AS x FROM x)
SELECT src_table, CASE WHEN coalesce(trim(x), '') = '' THEN 'empty' WHEN json_valid(x) THEN 'read' ELSE 'not one document' END AS status, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY ALL""")
def p2_payload_status(spark: SparkSession, d: str) -> DataFrame:
    """How many payloads of each table are read, and how many are not."""
    parts = [N.payload_status(table(spark, d, t), t).select(F.lit(t).alias("src_table"), "status") for t in ("wall_pages", "book_pages")]
    return parts[0].unionByName(parts[1]).groupBy("src_table", "status").agg(F.count(F.lit(1)).alias("n"))
