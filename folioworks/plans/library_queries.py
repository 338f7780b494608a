"""Queries of the library operators over whole tables, each with the DuckDB statement it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators import changes as C
from folioworks.operators import markup as M
from folioworks.operators import ordering as O
from folioworks.operators import payloads as P
from folioworks.operators import relational as R
from folioworks.session import table
from folioworks.streaming import feeds

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- scans, projections, filters ----


@query("""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY fetched_at NULLS FIRST, listing_id) rn FROM stories
           WHERE story_id IS NOT NULL AND rate_all >= 4 AND words_count >= 1000)
SELECT story_id, listing_id, coalesce(nullif(trim(title), ''), 'untitled') AS title, nullif(trim(authorname), '') AS author,
       CAST(words_count AS BIGINT) AS words_count, coalesce(CAST(is_hot AS INT), 0) AS hot, CAST(floor(epoch(fetched_at)) AS BIGINT) AS fetched_s
FROM s WHERE rn = 1""")
def catalog_scan(spark: SparkSession, d: str) -> DataFrame:
    kept = R.at_least(table(spark, d, "stories"), {"rate_all": 4, "words_count": 1000}).where("story_id IS NOT NULL")
    first = R.first_by_key_agg(kept.select("story_id", "listing_id", "title", "authorname", "words_count", "is_hot", "fetched_at"), ["story_id"], [F.col("fetched_at"), F.col("listing_id")])
    return first.select(
        "story_id",
        "listing_id",
        F.coalesce(S.blank_to_null(F.col("title")), F.lit("untitled")).alias("title"),
        S.blank_to_null(F.col("authorname")).alias("author"),
        "words_count",
        F.coalesce(F.col("is_hot").cast("int"), F.lit(0)).alias("hot"),
        F.unix_seconds(F.col("fetched_at").cast("timestamp")).alias("fetched_s"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount >= 0.05")
def threshold_and(spark: SparkSession, d: str) -> DataFrame:
    return R.at_least(table(spark, d, "lineitem"), {"l_quantity": 30, "l_discount": 0.05}).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn = 1""")
def first_by_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return R.first_by_key_agg(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""
WITH p AS (SELECT event_id // 50 AS page, event_id % 50 AS pos, event_id FROM events
           UNION ALL SELECT event_id // 50 - 1, 50 + event_id % 50, event_id FROM events WHERE event_id % 50 < 5 AND event_id >= 50)
SELECT event_id, min(page) AS first_page, CAST(count(*) AS BIGINT) AS seen FROM p GROUP BY event_id""")
def paged_cursor_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id")
    pages = e.select(F.expr("event_id div 50").alias("page"), (F.col("event_id") % 50).alias("pos"), "event_id")
    overlap = e.where("event_id % 50 < 5 AND event_id >= 50").select(F.expr("event_id div 50 - 1").alias("page"), (50 + F.col("event_id") % 50).alias("pos"), "event_id")
    both = pages.unionByName(overlap)
    seen = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("seen"))
    return R.first_by_key_agg(both, ["event_id"], [F.col("page"), F.col("pos")]).join(seen, "event_id").select("event_id", F.col("page").alias("first_page"), "seen")


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY post_id) rn FROM posts)
SELECT CASE WHEN loaded_at < TIMESTAMP '2025-02-01' THEN 'old' WHEN NOT can_view THEN 'locked' WHEN post_kind IS NULL OR post_kind <> 'text_post' THEN 'no file'
            WHEN title IS NOT NULL AND rn > 1 THEN 'repeated' ELSE 'kept' END AS disposition, CAST(count(*) AS BIGINT) AS n
FROM t GROUP BY 1""")
def disposition_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts")
    first = p.where("title IS NOT NULL").groupBy("title").agg(F.min("post_id").alias("first_id"))
    keyed = p.where("title IS NOT NULL").join(first, "title").unionByName(p.where("title IS NULL"), allowMissingColumns=True)
    what = R.dispositions(
        ("old", F.col("loaded_at") < F.lit("2025-02-01").cast("timestamp_ntz")),
        ("locked", ~F.col("can_view")),
        ("no file", F.col("post_kind").isNull() | (F.col("post_kind") != "text_post")),
        ("repeated", F.col("post_id") > F.col("first_id")),
    )
    return keyed.groupBy(what.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY")
def lookback(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("__now"))  # one row
    return feeds.within_weeks(e.join(F.broadcast(newest), how="inner"), "ts", F.col("__now"), 2).select("event_id")


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['1-URGENT','2-HIGH','3-MEDIUM'], o_orderpriority), o_orderkey) rn
FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM')) WHERE rn = 1""")
def format_preference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return R.preferred(o, ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], ["o_orderkey"])


@query("""
WITH t AS (SELECT post_id, trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS x FROM posts),
     h AS (SELECT *, substr(x, 1, 80) AS head FROM t)
SELECT post_id, nullif(CASE WHEN length(x) <= 80 THEN x WHEN strpos(head, ' ') > 1 THEN regexp_replace(head, ' [^ ]*$', '') || '…' ELSE head || '…' END, '') AS excerpt FROM h""")
def plain_excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").select("post_id", S.plain_excerpt(F.col("content"), 80).alias("excerpt"))


@query("""SELECT listing_id, regexp_replace(replace(replace(replace(replace(regexp_replace(tags, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^[\\s\\x{A0}\\x{3000}]+|[\\s\\x{A0}\\x{3000}]+$', '', 'g') AS tags FROM stories""")
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stories").select("listing_id", S.sanitize(F.col("tags")).alias("tags"))


@query("""SELECT meta_id, CASE WHEN numwords NOT LIKE '%.%' THEN TRY_CAST(regexp_replace(numwords, '[,\\s\u00a0\u202f\u2009]', '', 'g') AS BIGINT) END AS words,
CASE WHEN numchapters NOT LIKE '%.%' THEN TRY_CAST(replace(numchapters, ',', '') AS BIGINT) END AS chapters FROM story_meta""")
def int_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_meta").select("meta_id", S.int_or_null(F.col("numwords")).alias("words"), S.int_or_null(F.col("numchapters")).alias("chapters"))


@query("""
WITH x AS (SELECT meta_id, unnest(string_split(category, ', ')) AS v, generate_subscripts(string_split(category, ', '), 1) AS i FROM story_meta WHERE category IS NOT NULL),
     f AS (SELECT meta_id, v, i, row_number() OVER (PARTITION BY meta_id, lower(nfc_normalize(replace(v, 'ß', 'ss'))) ORDER BY i) rn FROM x)
SELECT meta_id, string_agg(v, '|' ORDER BY i) AS categories FROM f WHERE rn = 1 GROUP BY meta_id""")
def fold_dedupe(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "story_meta").where("category IS NOT NULL")
    return m.select("meta_id", F.array_join(R.folded_distinct(F.split("category", ", ")), "|").alias("categories"))


@query("""
WITH g AS (SELECT story_id, min(nullif(trim(authorname), '')) lo, max(nullif(trim(authorname), '')) hi, arg_min(nullif(trim(authorname), ''), listing_id) FILTER (nullif(trim(authorname), '') IS NOT NULL) f FROM stories GROUP BY story_id)
SELECT s.listing_id, CASE WHEN lo = hi THEN lo END AS authorname_all, f AS authorname_first FROM stories s JOIN g USING (story_id)""")
def unanimity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stories").select("listing_id", "story_id", "authorname").where("story_id IS NOT NULL")
    return R.unanimous(s, ["story_id"], "authorname", [F.col("listing_id")]).select("listing_id", "authorname_all", "authorname_first")


# ---- joins and lookups ----


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) ORDER BY c_custkey LIMIT 50")
def budget_antijoin(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.budget_antijoin(table(spark, d, "customer"), known, "c_custkey", [F.col("c_custkey")], 50).select("c_custkey", "c_name")


@query("""
WITH k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 5),
     m AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS m FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = l.l_orderkey AND k.l_partkey = l.l_partkey) GROUP BY 1)
SELECT o.l_orderkey, CAST(coalesce(m, 0) AS BIGINT) AS n_missing, m IS NULL AS subset FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN m USING (l_orderkey)""")
def subset_check(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return R.missing_from(li.select("l_orderkey", "l_partkey"), li.where("l_quantity >= 5").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("""
WITH p AS (SELECT DISTINCT regexp_extract(storyurl, '([^/]+/[^/]+)$', 1) AS path FROM story_meta WHERE storyurl IS NOT NULL),
     m AS (SELECT path, min(meta_id) AS v, count(*) AS n FROM p JOIN story_meta ON ends_with(storyurl, '/' || path) GROUP BY path)
SELECT p.path, CASE WHEN n = 1 THEN v END AS meta_id FROM p LEFT JOIN m USING (path)""")
def unique_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "story_meta").select("meta_id", "storyurl")
    return R.suffix_match(m.select(F.nullif(F.regexp_extract("storyurl", "([^/]+/[^/]+)$", 1), F.lit("")).alias("path")), m, "path", "storyurl", "meta_id")


@query("""
WITH n AS (SELECT DISTINCT site, regexp_replace(url, '^/s/', '') AS name FROM stories WHERE site IS NOT NULL AND url IS NOT NULL),
     c AS (SELECT site, count(*) k, min(name) s FROM n GROUP BY site),
     p AS (SELECT site, name, unnest(generate_series(1, length(name) - 1)) AS i FROM n),
     b AS (SELECT p.site, p.name, arg_max(o.name, i) AS best FROM p JOIN n o ON p.site = o.site AND o.name = substr(p.name, 1, i) WHERE substr(p.name, i + 1, 1) IN ('.','-','_',' ') GROUP BY 1, 2)
SELECT n.site, n.name, CASE WHEN k = 1 THEN s ELSE best END AS owner FROM n LEFT JOIN b USING (site, name) LEFT JOIN c USING (site)""")
def longest_prefix_owner(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "stories").where("site IS NOT NULL AND url IS NOT NULL").select("site", F.regexp_replace("url", "^/s/", "").alias("name")).distinct()
    return R.longest_prefix_owner(n, n, "site", "name", "name")


@query("""SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) > 1)""")
def held_by_other(spark: SparkSession, d: str) -> DataFrame:
    return R.held_by_other(table(spark, d, "supplier"), "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey")


@query("""
WITH u AS (SELECT title, min(meta_id) AS v FROM story_meta WHERE title IS NOT NULL GROUP BY title HAVING count(*) = 1)
SELECT b.book_key, u.v AS meta_id FROM library_books b LEFT JOIN u USING (title)""")
def unique_title(spark: SparkSession, d: str) -> DataFrame:
    b, m = table(spark, d, "library_books").select("book_key", "title"), table(spark, d, "story_meta").select("meta_id", F.col("title").alias("m_title"))
    return R.unique_or_null(b, m, F.col("title"), F.col("m_title"), "meta_id", "found").select("book_key", F.col("found").alias("meta_id"))


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Value' WHEN 'SMALL' THEN 'Compact' ELSE upper(substr(p_name, 1, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || lower(substr(split_part(p_name, ' ', 2), 2)) END AS label FROM part""")
def slug_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.coalesce(S.mapped(F.col("p_type"), {"ECONOMY": "Value", "SMALL": "Compact"}), S.slug_title(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))).alias("label"))


# ---- aggregations ----


@query("""SELECT author_userid, min(listing_id) AS first_pos, arg_min(authorname, listing_id) FILTER (authorname IS NOT NULL) AS authorname FROM stories GROUP BY 1""")
def creator_upgrade(spark: SparkSession, d: str) -> DataFrame:
    return R.first_with_upgrade(table(spark, d, "stories").select("author_userid", "listing_id", "authorname"), ["author_userid"], "listing_id", "authorname")


@query("""SELECT source, CASE WHEN count(DISTINCT nullif(lang, '')) = 1 THEN min(nullif(lang, '')) ELSE coalesce(arg_min(nullif(lang, ''), doc_id) FILTER (nullif(lang, '') IS NOT NULL), 'en') END AS lang FROM documents GROUP BY source""")
def language_resolve(spark: SparkSession, d: str) -> DataFrame:
    v = F.nullif("lang", F.lit(""))
    first = F.min(F.when(v.isNotNull(), F.struct("doc_id", v.alias("v"))))["v"]
    return R.single_value(table(spark, d, "documents").select("source", "lang", "doc_id"), ["source"], "lang", F.coalesce(first, F.lit("en")))


@query("""SELECT story_id, CASE WHEN min(chapter_no) = max(chapter_no) THEN 'Story ' || story_id || ' ' || min(chapter_no) WHEN min(chapter_no) IS NOT NULL THEN 'Story ' || story_id || ' ' || min(chapter_no) || '-' || max(chapter_no) END AS title FROM documents WHERE story_id IS NOT NULL GROUP BY 1""")
def title_range(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("story_id IS NOT NULL").select("story_id", "chapter_no")
    return R.number_range_title(docs, "story_id", "chapter_no", F.lit(None).cast("bigint"), F.concat(F.lit("Story "), "story_id"))


@query("""
WITH x AS (SELECT l_suppkey, unnest(generate_series(CAST(l_linenumber AS BIGINT), CAST(l_linenumber + l_quantity AS BIGINT))) AS number FROM lineitem)
SELECT l_suppkey, number, CAST(count(*) AS BIGINT) AS n_ranges FROM x GROUP BY 1, 2 HAVING count(*) > 1""")
def range_overlap(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").cast("bigint").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity")).cast("bigint").alias("hi"))
    return R.repeated_numbers(li, "l_suppkey", "lo", "hi")


@query("""
SELECT doc_id, (text IS NOT NULL AND count(*) OVER (PARTITION BY text) > 1) OR (story_id IS NOT NULL AND chapter_no IS NOT NULL AND count(*) OVER (PARTITION BY story_id, chapter_no) > 1) AS is_duplicate FROM documents""")
def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "story_id", "chapter_no")
    chapter = F.when(F.col("story_id").isNotNull() & F.col("chapter_no").isNotNull(), F.struct("story_id", "chapter_no"))
    return R.duplicate_flags(docs, F.sha2("text", 256), chapter).select("doc_id", "is_duplicate")


@query("""
WITH t AS (SELECT source || '/' || coalesce(doc_kind, 'none') AS path, sha256(text) AS digest, min(doc_id) AS f FROM documents WHERE text IS NOT NULL GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY f, digest) AS claim_no FROM t)
SELECT path, digest, CAST(claim_no AS INT) AS claim_no, CASE WHEN claim_no = 1 THEN path ELSE path || '-' || claim_no END AS claimed FROM r WHERE path IS NOT NULL""")
def content_claim(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select(F.concat_ws("/", "source", F.coalesce("doc_kind", F.lit("none"))).alias("path"), "text", "doc_id")
    return R.content_claims(docs, "path", F.col("text"), ["doc_id"])


@query("""
WITH w AS (SELECT user_id, event_type, sum(event_id % 7 + 1) AS w FROM events GROUP BY 1, 2),
     b AS (SELECT user_id, min({'w': -w, 'v': event_type}) AS b, sum(w) AS t FROM w GROUP BY 1)
SELECT user_id, CASE WHEN -b.w >= t * 0.25 THEN b.v END AS event_type, CAST(-b.w AS BIGINT) AS weight, CAST(t AS BIGINT) AS total FROM b""")
def weighted_mode_share(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 7 + 1).alias("w"))
    return R.heaviest(e, ["user_id"], "event_type", F.col("w"), 0.25)


@query("""
WITH m AS (SELECT doc_kind, median(n_chars) AS med FROM documents GROUP BY 1)
SELECT d.doc_kind, m.med AS median_size, CAST(count(*) FILTER (d.n_chars >= 1.3 * m.med) AS BIGINT) AS n_large FROM documents d JOIN m ON d.doc_kind = m.doc_kind GROUP BY 1, 2""")
def median_heading(spark: SparkSession, d: str) -> DataFrame:
    return R.large_rows(table(spark, d, "documents").select("doc_kind", "n_chars"), "doc_kind", "n_chars", 1.3)


@query("""SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS n_values, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS all_values FROM part WHERE p_type IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_type) > 1""")
def pin_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return R.conflicting(table(spark, d, "part"), "p_brand", "p_type")


@query("""
SELECT s.k AS state, CAST(count(o_orderkey) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('X')) s(k) LEFT JOIN orders ON o_orderstatus = s.k GROUP BY 1
UNION ALL SELECT 'unknown', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'X')""")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.counts_by_state(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "X"])


# ---- ordered operators ----

_CHAPTERS = """SELECT story_id, doc_id, chapter_no, CASE doc_kind WHEN 'synopsis' THEN 0 WHEN 'note' THEN 1 WHEN 'comment' THEN 3 ELSE 2 END AS zone FROM documents WHERE story_id IS NOT NULL"""


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("doc_kind") == "synopsis", 0).when(F.col("doc_kind") == "note", 1).when(F.col("doc_kind") == "comment", 3).otherwise(2)
    return table(spark, d, "documents").where("story_id IS NOT NULL").select("story_id", "doc_id", "chapter_no", zone.alias("zone"))


@query(f"""
WITH c AS ({_CHAPTERS}), p AS (SELECT *, zone = 2 AND chapter_no IS NOT NULL AS s, row_number() OVER (PARTITION BY story_id ORDER BY zone, doc_id) AS place FROM c),
     a AS (SELECT story_id, place, row_number() OVER (PARTITION BY story_id ORDER BY place) AS k FROM p WHERE s),
     n AS (SELECT story_id, doc_id, row_number() OVER (PARTITION BY story_id ORDER BY chapter_no, doc_id) AS k FROM p WHERE s)
SELECT p.story_id, p.doc_id, CAST(coalesce(a.place, p.place) AS INT) AS new_pos FROM p LEFT JOIN n ON p.story_id = n.story_id AND p.doc_id = n.doc_id LEFT JOIN a ON a.story_id = n.story_id AND a.k = n.k""")
def slot_sort(spark: SparkSession, d: str) -> DataFrame:
    return O.slot_sort(_chapters(spark, d), "story_id", "doc_id", F.col("zone"), F.col("chapter_no"), 2).select("story_id", "doc_id", "new_pos")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 1000000000 - event_id END AS stored FROM events),
     a AS (SELECT *, coalesce(stored, last_value(stored IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS anchor FROM e)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor, CASE WHEN stored IS NULL THEN 1 ELSE 0 END, event_id DESC) AS INT) AS new_pos FROM a""")
def splice_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, 1_000_000_000 - F.col("event_id")).alias("stored"))
    return O.splice_order(e, "user_id", "event_id", "stored").select("user_id", "event_id", "new_pos")


@query("""
SELECT user_id, event_id, CAST(epoch_us(ts) AS BIGINT) AS range_start, CAST(coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id), 1800000000000000) AS BIGINT) AS range_end FROM events""")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("range_start"))
    return O.ranges_to_next(e, "user_id", "range_start", ["event_id"], F.lit(1_800_000_000_000_000))


@query("""
WITH m AS (SELECT DISTINCT user_id, floor(value) / 1024 AS mark FROM events)
SELECT user_id, mark, coalesce((lag(mark) OVER w + mark) / 2, 0.0) AS low, coalesce((lead(mark) OVER w + mark) / 2, 1.0) AS high FROM m WINDOW w AS (PARTITION BY user_id ORDER BY mark)""")
def midpoint_ranges(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("user_id", (F.floor("value").cast("double") / 1024).alias("mark")).distinct()
    return O.midpoint_ranges(m, "user_id", "mark")


@query("""
SELECT c.user_id, c.event_id, (SELECT max({'t': p.ts, 'e': p.event_id}).e FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts <= c.ts) AS last_purchase FROM events c WHERE c.event_type = 'click'""")
def last_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("start"), F.col("event_id").alias("last_purchase"))
    return O.last_at_or_before(e.where("event_type = 'click'").drop("event_type"), marks, "user_id", "ts", "start", "last_purchase", bucket=lambda t: F.to_date(t)).select("user_id", "event_id", "last_purchase")


@query("""
SELECT c.user_id, c.event_id, (SELECT min({'d': abs(p.event_id - c.event_id), 'e': p.event_id}).e FROM events p WHERE p.user_id = c.user_id AND p.event_type = 'purchase') AS nearest FROM events c WHERE c.event_type = 'click'""")
def nearest_mark(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mark"))
    return O.nearest_mark(e.where("event_type = 'click'").drop("event_type"), marks, "user_id", "event_id", "mark", ["event_id"], bucket=lambda k: F.shiftright(k, 12)).select("user_id", "event_id", "nearest")


@query("""SELECT l_orderkey, l_linenumber, least(200, greatest(CAST(l_linenumber AS BIGINT), CAST(l_linenumber + round_even(l_discount * l_quantity * 4, 0) AS BIGINT))) AS page FROM lineitem""")
def clamped_round(spark: SparkSession, d: str) -> DataFrame:
    page = O.place_in_span(F.col("l_linenumber").cast("bigint"), F.col("l_discount") * F.col("l_quantity"), F.lit(4), F.lit(200).cast("bigint"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", page.alias("page"))


@query("""
WITH r AS (SELECT source, doc_id, sum(CASE WHEN doc_kind = 'synopsis' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents)
SELECT source, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM r GROUP BY 1, 2""")
def heading_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "doc_kind")
    runs = O.runs_by_heading(docs, "source", "doc_id", F.col("doc_kind") == "synopsis", bucket=lambda k: F.shiftright(k, 14))
    return runs.groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY nullif(s_suppkey % 3, 0) NULLS LAST, s_acctbal DESC, s_suppkey) rn FROM supplier) WHERE rn = 1""")
def election(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("first_number", F.nullif(F.col("s_suppkey") % 3, F.lit(0)))
    return R.elect(s, ["s_nationkey"], [F.asc_nulls_last("first_number"), F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_nationkey", "s_suppkey")


@query("""
WITH u AS (SELECT coalesce(site, '-') AS site, regexp_replace(storyurl, '^[a-z]+:/', '') AS p FROM story_meta WHERE storyurl IS NOT NULL),
     e AS (SELECT site, min(p) AS lo, max(p) AS hi FROM u GROUP BY site UNION ALL SELECT 'all', min(p), max(p) FROM u),
     l AS (SELECT site, string_split(lo, '/')[1:-2] AS a, string_split(hi, '/')[1:-2] AS b FROM e),
     n AS (SELECT *, coalesce(list_max(list_filter(generate_series(1, len(a)), lambda i: a[1:i] = b[1:i])), 0) AS n FROM l)
SELECT site, CASE WHEN n > 0 THEN array_to_string(a[1:n], '/') || '/' ELSE '' END AS directory FROM n""")
def common_directory(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "story_meta").where("storyurl IS NOT NULL").select(F.coalesce("site", F.lit("-")).alias("site"), F.regexp_replace("storyurl", "^[a-z]+:/", "").alias("p"))
    return O.common_directory(u.unionByName(u.withColumn("site", F.lit("all"))), "site", "p")


@query("""
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) a, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10, event_id) b FROM events)
SELECT user_id, CAST(count(*) FILTER (a <> b) AS BIGINT) AS n_moved, CAST(count(*) AS BIGINT) AS n_rows FROM c GROUP BY 1""")
def moved_count(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id")
    w = Window.partitionBy("user_id")
    return O.moved_count(e.withColumns({"a": F.row_number().over(w.orderBy("event_id")), "b": F.row_number().over(w.orderBy(F.col("event_id") % 10, "event_id"))}), "user_id", "a", "b")


# ---- sets, differences, merges, checks ----


@query("""SELECT book_key, array_to_string(list_filter(string_split(tags, ','), lambda x: NOT list_contains(['drama', 'heist', 'space opera'], lower(nfc_normalize(replace(x, 'ß', 'ss'))))), ',') AS own_tags FROM library_books WHERE tags IS NOT NULL""")
def folded_set_diff(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "library_books").where("tags IS NOT NULL")
    drop = F.array(*[F.lit(x) for x in ("Drama", "HEIST", "space opera")])
    return b.select("book_key", F.array_join(R.folded_difference(F.split("tags", ","), drop), ",").alias("own_tags"))


@query("""SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' AND user_id NOT IN (SELECT user_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-11')""")
def snapshot_reset(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"))
    return C.vanished(e.where("day = DATE '2024-01-10'"), e.where("day = DATE '2024-01-11'"), "user_id")


@query("""
WITH n AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS seg2, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nat2 FROM customer)
SELECT c_custkey, concat_ws(';', CASE WHEN c_mktsegment IS DISTINCT FROM seg2 THEN 'segment=' || seg2 END, CASE WHEN c_nationkey IS DISTINCT FROM nat2 THEN 'nation=' || coalesce(CAST(nat2 AS VARCHAR), 'null') END) AS patch FROM n
WHERE c_mktsegment IS DISTINCT FROM seg2 OR c_nationkey IS DISTINCT FROM nat2""")
def changed_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    seg = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.upper("c_mktsegment"), F.lit("!"))).otherwise(F.col("c_mktsegment"))
    nat = F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey"))
    patch = C.changed_fields({"segment": seg, "nation": nat}, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})
    shown = F.array_join(F.transform(F.map_entries("p"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")
    return c.select("c_custkey", patch.alias("p")).where(F.size("p") > 0).select("c_custkey", shown.alias("patch"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'origin=new/' || p_partkey || ',shop=s' ELSE 'shop=s,origin=new/' || p_partkey END AS links FROM part""")
def links_upsert(spark: SparkSession, d: str) -> DataFrame:
    link = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("url"))
    cur = F.when(F.col("p_size") % 2 == 0, F.array(link("origin", "old"), link("shop", "s"))).otherwise(F.array(link("shop", "s")))
    new = C.upsert_links(cur, F.lit("origin"), F.concat(F.lit("new/"), F.col("p_partkey")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(new, lambda x: F.concat(x["label"], F.lit("="), x["url"])), ",").alias("links"))


@query("""
WITH v AS (SELECT doc_id, text AS base, CASE doc_id % 4 WHEN 1 THEN text || ' app' WHEN 3 THEN text || ' app' ELSE CASE WHEN doc_id % 9 <> 0 THEN text END END AS app, CASE WHEN doc_id % 4 IN (2, 3) THEN text || ' file' WHEN doc_id % 10 = 0 THEN NULL ELSE text END AS file FROM documents WHERE text IS NOT NULL),
     a AS (SELECT doc_id, kind, app, file, base, CASE WHEN app IS NULL THEN kind = 'text' AND base <> '' ELSE app <> base END AS am, file IS NOT NULL AND file <> base AS fm FROM v, (VALUES ('text'), ('bytes')) k(kind))
SELECT doc_id, kind, CASE WHEN app IS NOT DISTINCT FROM file THEN 'equal' WHEN NOT am AND NOT fm THEN 'none' WHEN NOT am THEN 'take file' WHEN NOT fm THEN 'take app' ELSE 'conflict' END AS action FROM a""")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 4
    app = F.when(k.isin(1, 3), F.concat(t, F.lit(" app"))).when(F.col("doc_id") % 9 != 0, t)
    file = F.when(k.isin(2, 3), F.concat(t, F.lit(" file"))).when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string")).otherwise(t)
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    both = F.array(*[F.struct(F.lit(n).alias("kind"), C.three_way(app, file, F.sha2("text", 256), n == "text").alias("action")) for n in ("text", "bytes")])
    return docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.kind", "x.action")


@query("""
WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(s.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL OR s.h IS DISTINCT FROM f.h THEN 'import' ELSE 'skip' END AS action FROM s FULL JOIN f ON s.doc_id = f.doc_id""")
def sync_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("digest"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return C.classify_snapshot(stored, docs.where("doc_id % 4 <> 0").select("doc_id", F.sha2(edited, 256).alias("digest")), ["doc_id"], "digest")


@query("""
SELECT 'repeated story' AS check_name, CAST(story_id AS VARCHAR) AS detail FROM stories WHERE story_id IS NOT NULL GROUP BY story_id HAVING count(*) > 1
UNION ALL SELECT 'order without lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'slug with a slash', CAST(listing_id AS VARCHAR) FROM stories WHERE NOT regexp_full_match(url, '/s/[^/]+')""")
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stories")
    out = C.repeated(s, "repeated story", "story_id")
    out = out.unionByName(C.dangling(table(spark, d, "orders"), table(spark, d, "lineitem"), "order without lines", "o_orderkey", "l_orderkey"))
    return out.unionByName(C.failing(s, "slug with a slash", "listing_id", F.col("url").rlike("^/s/[^/]+$")))


@query("""
WITH v AS (SELECT 1 AS check_rank, 'repeated story' AS check_name, min(CAST(story_id AS VARCHAR)) AS detail FROM (SELECT story_id FROM stories WHERE story_id IS NOT NULL GROUP BY story_id HAVING count(*) > 1)),
     n AS (SELECT 0 AS check_rank, 'repeated nation' AS check_name, min(CAST(n_nationkey AS VARCHAR)) AS detail FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1))
SELECT * FROM (SELECT * FROM n UNION ALL SELECT * FROM v) WHERE detail IS NOT NULL ORDER BY check_rank LIMIT 1""")
def first_violation(spark: SparkSession, d: str) -> DataFrame:
    return C.first_violation([C.repeated(table(spark, d, "nation"), "repeated nation", "n_nationkey"), C.repeated(table(spark, d, "stories"), "repeated story", "story_id")])


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' END AS c_name, c_custkey % 5 = 0 AS clear FROM customer WHERE c_custkey % 3 = 0
           UNION ALL SELECT -1, 'new', false)
SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, coalesce(p.c_name, c.c_name) AS c_name, CASE WHEN coalesce(p.clear, false) THEN NULL ELSE c.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN p ON c.c_custkey = p.c_custkey""")
def patch_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    p = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("*"))).alias("c_name"), (F.col("c_custkey") % 5 == 0).alias("clear_c_mktsegment"))
    p = p.unionByName(spark.createDataFrame([(-1, "new", False)], p.schema))
    return C.upsert(c, p, "c_custkey", ["c_mktsegment"])


@query("""
WITH a AS (SELECT n_nationkey AS k, n_name AS v FROM nation), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN n_name || '2' ELSE n_name END AS v FROM nation WHERE n_nationkey % 6 <> 0 UNION ALL SELECT 99, 'NEW')
SELECT coalesce(a.k, b.k) AS k, a.v AS before_value, b.v AS after_value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.k = b.k""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    b = n.where("k % 6 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.concat("v", F.lit("2"))).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(99, "NEW")], n.schema))
    return R.full_outer_state(n, b, "k", "v")


# ---- scalar functions ----


@query("""SELECT part.p_partkey, x.i AS isbn, CASE WHEN length(x.i) = 13 THEN CASE WHEN (SELECT sum(TRY_CAST(substr(x.i, k, 1) AS INT) * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END) FROM generate_series(1, 13) g(k)) % 10 = 0 THEN x.i END
 ELSE CASE WHEN (SELECT sum(TRY_CAST(substr(x.i, k, 1) AS INT) * (11 - k)) FROM generate_series(1, 10) g(k)) % 11 = 0 THEN '978' || substr(x.i, 1, 9) || CAST((10 - (SELECT sum(TRY_CAST(substr('978' || substr(x.i, 1, 9), k, 1) AS INT) * CASE WHEN k % 2 = 1 THEN 1 ELSE 3 END) FROM generate_series(1, 12) g(k)) % 10) % 10 AS VARCHAR) END END AS isbn13
FROM part, LATERAL (SELECT CASE WHEN p_partkey % 2 = 0 THEN '978' || lpad(CAST(p_partkey * 7 AS VARCHAR), 10, '0') ELSE lpad(CAST(p_partkey * 3 AS VARCHAR), 10, '0') END AS i) x""")
def isbn13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    i = F.when(k % 2 == 0, F.concat(F.lit("978"), F.lpad((k * 7).cast("string"), 10, "0"))).otherwise(F.lpad((k * 3).cast("string"), 10, "0"))
    return table(spark, d, "part").select("p_partkey", i.alias("isbn")).withColumn("isbn13", S.isbn13(F.col("isbn")))


@query("""
WITH r AS (SELECT listing_id, CAST(floor(rate_all) AS INT) AS r, CASE listing_id % 4 WHEN 0 THEN 'rating:' || (listing_id % 8) WHEN 1 THEN repeat('★', CAST(listing_id % 7 AS INT)) WHEN 2 THEN repeat('☆', CAST(listing_id % 6 AS INT)) ELSE 'drama' END AS other FROM stories)
SELECT listing_id, CASE WHEN r BETWEEN 1 AND 5 THEN repeat('★', r) || repeat('☆', 5 - r) END AS tag, CASE WHEN r BETWEEN 1 AND 5 THEN r END AS back, other,
 CASE listing_id % 4 WHEN 0 THEN CASE WHEN listing_id % 8 <= 5 THEN CAST(listing_id % 8 AS INT) END WHEN 1 THEN CASE WHEN listing_id % 7 BETWEEN 1 AND 5 THEN CAST(listing_id % 7 AS INT) END WHEN 2 THEN CASE WHEN listing_id % 6 = 5 THEN 0 END END AS other_rating,
 listing_id % 4 = 0 OR (listing_id % 4 = 1 AND listing_id % 7 BETWEEN 1 AND 5) OR (listing_id % 4 = 2 AND listing_id % 6 = 5) AS rating_like FROM r""")
def star_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("listing_id")
    other = F.when(k % 4 == 0, F.concat(F.lit("rating:"), k % 8)).when(k % 4 == 1, F.repeat(F.lit("★"), (k % 7).cast("int"))).when(k % 4 == 2, F.repeat(F.lit("☆"), (k % 6).cast("int"))).otherwise("drama")
    r = table(spark, d, "stories").select("listing_id", S.star_tag(F.floor("rate_all").cast("int")).alias("tag"), other.alias("other"))
    return r.select("*", S.rating_of_tag(F.col("tag")).alias("back"), S.rating_of_tag(F.col("other")).alias("other_rating"), F.coalesce(S.is_rating_like(F.col("other")), F.lit(False)).alias("rating_like"))


@query("""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')[1:12], ' ') AS opening FROM documents WHERE text IS NOT NULL""")
def opening_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", S.opening_words(F.col("text"), 12).alias("opening"))


@query("""
WITH u AS (SELECT listing_id, 'https://x.example/search?page=' || (listing_id % 9) || '&tag=' || coalesce(story_kind, 'none') || '&x=1&b=2' AS url FROM stories)
SELECT listing_id, CAST(regexp_extract(url, '[?&]page=([^&]*)', 1) AS BIGINT) AS page, regexp_extract(url, '[?&]tag=([^&]*)', 1) AS tag, 'b,x' AS unknown FROM u""")
def url_params(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "stories").select("listing_id", F.concat(F.lit("https://x.example/search?page="), F.col("listing_id") % 9, F.lit("&tag="), F.coalesce("story_kind", F.lit("none")), F.lit("&x=1&b=2")).alias("url"))
    url = F.col("url")
    return u.select("listing_id", S.url_query(url, "page").try_cast("bigint").alias("page"), S.url_query(url, "tag").alias("tag"), F.array_join(S.unknown_keys(url, ["page", "tag"]), ",").alias("unknown"))


@query("""
WITH u AS (SELECT doc_id, 'https://' || source || '/a' || doc_id || list_extract(['.docx', '.PDF', '.rtf?x=1', '.md', '.epub#p', '.html'], CAST(doc_id % 6 + 1 AS INT)) AS url FROM documents)
SELECT doc_id, url, list_extract(['docx', 'pdf', 'rtf', 'text', 'epub', 'any'], CAST(doc_id % 6 + 1 AS INT)) AS reader FROM u""")
def claiming_source(spark: SparkSession, d: str) -> DataFrame:
    ext = F.get(F.array(*[F.lit(x) for x in (".docx", ".PDF", ".rtf?x=1", ".md", ".epub#p", ".html")]), (F.col("doc_id") % 6).cast("int"))
    u = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://"), F.col("source"), F.lit("/a"), F.col("doc_id"), ext).alias("url"))
    return u.withColumn("reader", S.claiming_source(F.col("url")))


@query("""
WITH u AS (SELECT meta_id, storyurl, CASE WHEN meta_id % 3 = 0 THEN 'attachment; filename="b' || meta_id || '.epub"' END AS h FROM story_meta)
SELECT meta_id, coalesce(regexp_extract(h, 'filename="?([^";]+)"?', 1), regexp_extract(storyurl, '([^/]+)$', 1) || '.epub', 'book.epub') AS file FROM u""")
def download_name(spark: SparkSession, d: str) -> DataFrame:
    h = F.when(F.col("meta_id") % 3 == 0, F.concat(F.lit('attachment; filename="b'), F.col("meta_id"), F.lit('.epub"')))
    return table(spark, d, "story_meta").select("meta_id", S.download_name(h, F.col("storyurl")).alias("file"))


@query("""SELECT meta_id, rtrim(regexp_replace(regexp_replace(lower(regexp_extract(storyurl, '^[a-z]+://([^/]*)', 1)), '^www\\.', '') || regexp_replace(storyurl, '^[a-z]+://[^/]*', ''), '#.*$', ''), '/') AS identity FROM story_meta WHERE storyurl IS NOT NULL""")
def url_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "story_meta").where("storyurl IS NOT NULL").select("meta_id", S.canonical_url(F.col("storyurl")).alias("identity"))


@query("""
WITH v AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, list_extract(['px', 'pt', 'em', 'in'], CAST(p_partkey % 4 + 1 AS INT)) AS u FROM part),
     p AS (SELECT *, CASE u WHEN 'px' THEN x WHEN 'pt' THEN x * (4.0::DOUBLE / 3.0::DOUBLE) WHEN 'in' THEN x * 96.0::DOUBLE END / 16.0::DOUBLE AS em FROM v)
SELECT p_partkey, CASE WHEN em IS NOT NULL THEN rtrim(rtrim(format('{:.3f}', round_even(greatest(0.4::DOUBLE, least(4.0::DOUBLE, em)), 3)::DOUBLE), '0'), '.') || 'em' END AS size FROM p""")
def css_lengths(spark: SparkSession, d: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(x) for x in ("px", "pt", "em", "in")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.to_em(F.col("p_size").cast("double"), unit, 16.0).alias("size"))


@query("""SELECT event_id, strftime(ts, '%-d %b %Y') AS shown, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events""")
def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format("ts", "d MMM yyyy").alias("shown"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


@query("""SELECT listing_id, CAST(try_strptime(date_approve, '%m/%d/%Y') AS DATE) AS approved FROM stories WHERE regexp_full_match(date_approve, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}')""")
def mdy_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stories").where(F.col("date_approve").rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$")).select("listing_id", S.mdy_date(F.col("date_approve")).alias("approved"))


@query("""SELECT p_partkey, '1.' || (p_partkey % 10) || '.' || (p_size + 1) AS bumped, 'plugin-' || p_partkey AS release FROM part""")
def version_text(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("1."), F.col("p_partkey") % 10, F.lit("."), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", S.bump_patch(v).alias("bumped"), S.release_id(F.concat(F.lit("plugin-"), F.col("p_partkey"), F.lit("-"), v)).alias("release"))


@query("""SELECT listing_id, CAST(nullif(regexp_extract(lower(title), '([0-9]{1,6})', 1), '') AS INT) AS number FROM stories WHERE title IS NOT NULL""")
def chapter_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stories").where("title IS NOT NULL").select("listing_id", S.chapter_number(F.col("title"))["number"].alias("number"))


@query("""SELECT book_key, lower(nfc_normalize(replace(title, 'ß', 'ss'))) AS folded FROM library_books""")
def unicode_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "library_books").select("book_key", S.nfc_casefold(F.col("title")).alias("folded"))


# ---- markup ----


@query("""
WITH t AS (SELECT lower(unnest(regexp_extract_all(content, '<([A-Za-z][A-Za-z0-9]*)(?:\\s[^<>]*)?>', 1))) AS tag FROM posts),
     p AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'p' ELSE 'div' END AS tag, CASE WHEN p_size % 3 = 0 THEN '' WHEN lower(p_type) < 'note' THEN lower(p_type) || ' note' ELSE 'note ' || lower(p_type) END AS classes, CASE WHEN p_size % 5 = 0 THEN 's' || p_size ELSE '' END AS element_id FROM part)
SELECT tag, classes, element_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT tag, '' AS classes, '' AS element_id FROM t UNION ALL SELECT * FROM p) GROUP BY ALL""")
def tag_census(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    tag = F.when(p.p_size % 2 == 0, "P").otherwise("div")
    classes = F.when(p.p_size % 3 != 0, F.concat(F.lit(" class='note "), F.lower("p_type"), F.lit("  note'"))).otherwise("")
    ident = F.when(p.p_size % 5 == 0, F.concat(F.lit(' id="s'), "p_size", F.lit('"'))).otherwise("")
    made = p.select(F.col("p_partkey").alias("post_id"), F.concat(F.lit("<"), tag, classes, ident, F.lit(">x")).alias("content"))
    return M.tag_census(M.start_tags(table(spark, d, "posts").select("post_id", "content").unionByName(made), "post_id", "content"))


@query("""SELECT doc_id, substr(sha256('v1:' || CAST(doc_id % 8 AS VARCHAR)), 1, 12) AS signature, doc_id % 8 = 3 AS skipped FROM documents WHERE text IS NOT NULL""")
def signature_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    own = S.options_signature("v1", (F.col("doc_id") % 8).cast("string"))
    stamped = M.stamp(M.stamp(F.col("text"), own), own)
    return docs.select("doc_id", M.read_marker(stamped).alias("signature"), (M.read_marker(stamped) == S.options_signature("v1", F.lit("3"))).alias("skipped"))


@query("""SELECT post_id, content || '<p class="blank"></p>' AS content, CAST(1 AS BIGINT) AS n FROM posts WHERE content IS NOT NULL""")
def blank_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posts").where("content IS NOT NULL").select("post_id", F.concat("content", F.lit("<p>&nbsp;<br/></p>")).alias("c"))
    return p.select("post_id", M.mark_blank_paragraphs(F.col("c")).alias("content"), M.blank_paragraphs(F.col("c")).cast("bigint").alias("n"))


@query("""SELECT doc_id, 'see <a href="n' || (doc_id % 5) || '.xhtml#p1">x</a> and <a href="other.html">y</a>' AS text FROM documents WHERE doc_kind IS NOT NULL""")
def repointed_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind IS NOT NULL").select("doc_kind", "doc_id", F.concat(F.lit('see <a href="o'), F.col("doc_id") % 5, F.lit('.html#p1">x</a> and <a href="other.html">y</a>')).alias("text"))
    mapping = docs.select("doc_kind", F.concat(F.lit("o"), F.col("doc_id") % 5, F.lit(".html")).alias("old"), F.concat(F.lit("n"), F.col("doc_id") % 5, F.lit(".xhtml")).alias("new")).distinct()
    return M.repoint_links(docs, mapping, "doc_kind", "doc_id", "text", "old", "new").select("doc_id", "text")


@query(None)
def unreferenced_names(spark: SparkSession, d: str) -> DataFrame:
    """Whole names; a nested-loop statement over whole tables is too slow for DuckDB, the operator is tested by brute force."""
    n = table(spark, d, "stories").where("site IS NOT NULL AND authorname IS NOT NULL").select("site", F.col("authorname").alias("name")).distinct()
    p = table(spark, d, "posts").where("site IS NOT NULL AND content IS NOT NULL").select("site", "post_id", "content")
    return M.unreferenced(n, p, "site", "name", "post_id", "content")


@query("""
WITH RECURSIVE f AS (SELECT p_brand, p_retailprice / 100 AS s, min(p_partkey) AS pos, count(*) AS w FROM part WHERE p_retailprice IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos, s) AS rn FROM f),
t AS (SELECT p_brand, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS ss, CAST([] AS BIGINT[]) AS ws FROM (SELECT DISTINCT p_brand FROM o)
      UNION ALL SELECT p_brand, rn, CASE WHEN q > 0 THEN ss ELSE list_append(ss, s) END, CASE WHEN q > 0 THEN list_concat(list_append(ws[1:q - 1], ws[q] + w), ws[q + 1:]) ELSE list_append(ws, w) END
      FROM (SELECT o.*, ss, ws, coalesce(list_position(list_transform(ss, lambda x: abs(x - o.s) <= 0.05), true), 0) AS q FROM t JOIN o ON o.p_brand = t.p_brand AND o.rn = t.rn + 1)),
z AS (SELECT p_brand, ss, ws FROM t QUALIFY rn = max(rn) OVER (PARTITION BY p_brand))
SELECT p_brand, unnest(ss) AS size, CAST(unnest(ws) AS BIGINT) AS weight FROM z""")
def font_size_pools(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("pos"), (F.col("p_retailprice") / 100).alias("size"), F.lit(1).alias("weight"))
    return M.size_pools(p, "p_brand", "pos", "size", "weight", 0.05)


# ---- feeds ----


@query("""SELECT listing_id FROM stories WHERE loaded_at > TIMESTAMP '2025-06-01'""")
def marker_feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.changes_since(table(spark, d, "stories"), "loaded_at", F.lit("2025-06-01").cast("timestamp_ntz")).select("listing_id")


@query("""SELECT CAST(epoch_us(greatest(max(loaded_at), TIMESTAMP '2025-06-01')) AS BIGINT) AS marker FROM stories""")
def next_marker(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stories").select(F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("t"))
    return feeds.next_marker(s, "t", F.unix_micros(F.lit("2025-06-01").cast("timestamp")), F.lit(0).cast("bigint"))


@query("""SELECT listing_id FROM stories WHERE site IN (SELECT site FROM stories GROUP BY site HAVING max(loaded_at) > TIMESTAMP '2025-06-01')""")
def page_feed(spark: SparkSession, d: str) -> DataFrame:
    return feeds.page_feed(table(spark, d, "stories"), "site", "loaded_at", F.lit("2025-06-01").cast("timestamp_ntz")).select("listing_id")


@query("""
WITH e AS (SELECT user_id % 50 AS report, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events WHERE props IS NOT NULL)
SELECT DISTINCT report, 'p' || k AS package, '1.' || report AS installed, CASE WHEN k % 2 = 0 THEN '2.0' END AS fixed, 'A-' || event_type AS advisory, CASE WHEN k % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM e WHERE k IS NOT NULL""")
def nested_findings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props IS NOT NULL").select((F.col("user_id") % 50).alias("report"), F.from_json("props", "k int")["k"].alias("k"), "event_type").where("k IS NOT NULL")
    found = F.struct(
        F.concat(F.lit("p"), "k").alias("PkgName"), F.concat(F.lit("1."), "report").alias("InstalledVersion"), F.when(F.col("k") % 2 == 0, "2.0").alias("FixedVersion"),
        F.concat(F.lit("A-"), "event_type").alias("VulnerabilityID"), F.when(F.col("k") % 3 == 0, "HIGH").otherwise("LOW").alias("Severity"),
    )
    # Every second finding stands alone where a list is meant, and some results have none.
    listed = F.when(F.col("k") % 5 == 0, F.to_json(found)).otherwise(F.to_json(F.array(found, found)))
    report = F.concat(F.lit('{"Results": [{"Target": "empty"}, {"Vulnerabilities": '), listed, F.lit("}]}"))
    return P.report_findings(e.select("report", report.alias("payload")), "report", "payload")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's file as a stream source."""
    folder, _, _ = f"{d}/{name}.parquet".rpartition("/")
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def _run(spark: SparkSession, stream: DataFrame, label: str, latest_by: list[str] | None = None) -> DataFrame:
    import uuid

    from folioworks.session import shared_dir

    return feeds.run_available(stream, f"{shared_dir(spark)}/folioworks/stream-{label}-{uuid.uuid4().hex}", latest_by)


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "events").select("user_id", "ts")
    return _run(spark, feeds.first_seen(s, "user_id", "ts", "60 days"), "first-seen").select("user_id")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_us, event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d, "events").select("ts", "event_type")
    counts = feeds.counts_by_window(s, "ts", "10 minutes", "1 hour", ["event_type"])
    return _run(spark, counts, "counts", ["window_start", "event_type"]).select(F.unix_micros("window_start").alias("window_us"), "event_type", "n")


@query("""
WITH o AS (SELECT user_id, event_type, epoch_us(ts) AS at_us, lag(event_type) OVER w AS last_type, lag(epoch_us(ts)) OVER w AS last_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_type))
SELECT user_id, event_type, CAST(at_us AS BIGINT) AS at_us FROM o WHERE last_us IS NULL OR event_type IS DISTINCT FROM last_type OR at_us - last_us > 86400000000""")
def echo_suppression(spark: SparkSession, d: str) -> DataFrame:
    """A value that a key just had is an echo within a day."""
    s = _stream(spark, d, "events").select("user_id", "event_type", "ts")
    return _run(spark, feeds.suppress_echoes(s, "user_id", "event_type", "ts", 86_400_000), "echoes")
