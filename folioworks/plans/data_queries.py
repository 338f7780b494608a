"""The core queries of problems 2 to 4, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators.nested_records import child_table, child_tables
from folioworks.operators.packed_fields import explode_packed_values, with_packed_values
from folioworks.operators.timestamps import choose_readings, with_readings, zone_abbreviations
from folioworks.session import table

#: Tables with a packed field: the row key and the field.
PACKED = {"stories": ("listing_id", "tags"), "library_books": ("book_key", "tags"), "story_meta": ("meta_id", "eroticatags")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        child_tables(table(spark, sf_dir, t), t).select(F.lit(t).alias("src_table"), "page_id", "parent_key", "child_kind", "child_pos", "child_key")
        for t in ("wall_pages", "book_pages")
    ]
    return parts[0].unionByName(parts[1])


def p2_activity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag table alone: one row per activity, place and tag."""
    return child_table(table(spark, sf_dir, "wall_pages"), "wall_pages", "tag")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, (key, field) in PACKED.items():
        part = explode_packed_values(table(spark, sf_dir, t), key, field).select(
            F.lit(t).alias("src_table"), F.col(key).alias("row_key"), "item_pos", "item"
        )
        out = part if out is None else out.unionByName(part)
    return out


#: Tables with a dated field: the row key and the field.
DATED = {"stories": ("listing_id", "date_approve"), "posts": ("post_id", "published_at"), "story_meta": ("meta_id", "datepublished"), "library_books": ("book_key", "created")}


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for t, (key, field) in DATED.items():
        part = table(spark, sf_dir, t).select(F.lit(t).alias("src_table"), F.col(key).alias("row_key"), F.col(field).alias("value"), "site")
        rows = part if rows is None else rows.unionByName(part)
    sites = table(spark, sf_dir, "sites").select("site", "zone_name", "date_order").dropDuplicates(["site"])
    # Zone names are bounded by the time zone database.
    zones = sorted(r.zone_name for r in sites.select("zone_name").where("zone_name IS NOT NULL").distinct().collect())
    joined = rows.join(sites, "site", "left").withColumn("sited", F.col("date_order").isNotNull())
    return with_readings(joined, "value", "zone_name", "date_order", zone_abbreviations(zones))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _readings(spark, sf_dir)
    # A numeric date of a row without a declared order has two orders, even where only one of them is a date.
    unsure = ~F.col("sited") & F.exists("readings", lambda r: r.style.isin("MDY", "DMY"))
    read = read.withColumn("unordered", unsure)
    source = F.concat_ws(" ", "src_table", F.coalesce("site", F.lit("-")), F.when(F.col("unordered"), "unordered"))
    return choose_readings(read.withColumn("source", source), ["src_table", "source"], "row_key")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that denote exactly one instant: the chosen reading, where it is the only one and no order was guessed."""
    c = _chosen(spark, sf_dir)
    return c.where((F.col("n_instants") == 1) & ~F.col("source").endswith(" unordered")).select("src_table", "row_key", "utc_micros")


def p4_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the reading the Viterbi pass chose, also where the value alone leaves several."""
    return _chosen(spark, sf_dir).select("src_table", "row_key", "utc_micros", "n_instants", "style")


#: Fields that only plain separators cut: nothing in them is quoted, escaped, a list, a reference, a hash sign or a separator between blanks.
PLAIN_FIELD = r"^[^\"'\\&#/·•\[\]{}\x{E000}-\x{E002}]*$"


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every plain field of the three tables, joined, and their number; all other fields are read too and left out of the result."""
    out = None
    for t, (key, field) in PACKED.items():
        rows = with_packed_values(table(spark, sf_dir, t).select(F.col(key).alias("row_key"), F.col(field).alias("field")), "field", "items")
        part = rows.where(F.col("field").rlike(PLAIN_FIELD)).select(F.lit(t).alias("src_table"), "row_key", F.array_join("items", "|").alias("items"), F.size("items").cast("long").alias("n_items"))
        out = part if out is None else out.unionByName(part)
    return out


ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$"


def p4_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of every value of the four tables that is an ISO time with an offset; all other values are read too and left out of the result."""
    read = _readings(spark, sf_dir).where(F.col("value").rlike(ISO_INSTANT))
    return read.select("src_table", "row_key", F.size("readings").cast("long").alias("n_readings"), F.try_element_at("readings", F.lit(1))["micros"].alias("utc_micros"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_activity_tags, p3_found, p3_plain, p4_found, p4_iso, p4_resolved)}


# The same tables in DuckDB's JSON functions: unwrap, list, then one SELECT a child table.
_DOCS = """
WITH t AS (SELECT page_id, ltrim(payload, chr(65279) || chr(10) || ' ') AS x FROM {table} WHERE payload IS NOT NULL),
u AS (SELECT page_id, CASE WHEN json_valid(x) AND json_type(x) = 'VARCHAR' THEN ltrim(json_extract_string(x, '$'), chr(65279) || chr(10) || ' ') ELSE x END AS x FROM t),
v AS (SELECT page_id, TRY_CAST(x AS JSON) AS j FROM u WHERE json_valid(x)),
w AS (SELECT page_id, coalesce(j->'$.{list}', j->'$.result.{list}') AS d FROM v),
a AS (SELECT page_id, CASE json_type(d) WHEN 'ARRAY' THEN CAST(d AS JSON[]) WHEN 'OBJECT' THEN [d] END AS ds FROM w),
r AS (SELECT page_id, unnest(ds) AS rec, generate_subscripts(ds, 1) AS pos FROM a),
k AS (SELECT page_id, rec, pos, rec->>'$.id' AS rec_key FROM r WHERE rec->>'$.id' IS NOT NULL)
"""


def _child_sql(kind: str, path: str, key: str) -> str:
    lists = f"CASE json_type(rec->'{path}') WHEN 'ARRAY' THEN CAST(rec->'{path}' AS JSON[]) WHEN 'OBJECT' THEN [rec->'{path}'] END"
    inner = f"SELECT page_id, rec_key, unnest({lists}) AS e, generate_subscripts({lists}, 1) AS pos FROM k"
    return f"SELECT page_id, rec_key AS parent_key, '{kind}' AS child_kind, CAST(pos AS BIGINT) AS child_pos, {key} AS child_key FROM ({inner}) WHERE {key} IS NOT NULL"


def _one_sql(kind: str, path: str) -> str:
    return f"SELECT page_id, rec_key AS parent_key, '{kind}' AS child_kind, CAST(1 AS BIGINT) AS child_pos, rec->>'{path}' AS child_key FROM k WHERE rec->>'{path}' IS NOT NULL"


def _top_sql(kind: str) -> str:
    return f"SELECT page_id, CAST(page_id AS VARCHAR) AS parent_key, '{kind}' AS child_kind, CAST(pos AS BIGINT) AS child_pos, rec_key AS child_key FROM k"


def _nested_sql() -> tuple[str, str]:
    tag = _child_sql("tag", "$.what.tags", "CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.tag' WHEN 'ARRAY' THEN NULL ELSE e->>'$' END")
    wall = [_top_sql("activity"), _one_sql("author", "$.what.author.userid"), _one_sql("category", "$.what.category_info.type"), tag, _child_sql("episode", "$.what.series.items", "e->>'$.id'")]
    book = [_top_sql("book"), _one_sql("media", "$.media.status"), _child_sql("contributor", "$.metadata.authors", "e->>'$.name'")]
    whole = [
        f"SELECT DISTINCT '{t}' AS src_table, * FROM ({_DOCS.format(table=t, list=x)} {' UNION ALL '.join(parts)})"
        for t, x, parts in (("wall_pages", "data", wall), ("book_pages", "content", book))
    ]
    return " UNION ALL ".join(whole), f"SELECT DISTINCT * FROM ({_DOCS.format(table='wall_pages', list='data')} {tag})"


def _plain_sql() -> str:
    """Split at any of the plain separators, trim white space of any kind, drop what is empty."""
    blank = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
    items = f"list_filter(list_transform(string_split_regex(f, '[,;|\\t\\r\\n，、；｜]'), lambda x: regexp_replace(x, '^{blank}+|{blank}+$', '', 'g')), lambda x: x <> '')"
    parts = [f"SELECT '{t}' AS src_table, {key} AS row_key, {field} AS f FROM {t}" for t, (key, field) in PACKED.items()]
    special = "[\"''\\\\&#/·•\\[\\]{}\\x{E000}-\\x{E002}]"
    return f"WITH t AS ({' UNION ALL '.join(parts)}), i AS (SELECT src_table, row_key, {items} AS i FROM t WHERE f IS NOT NULL AND NOT regexp_matches(f, '{special}')) SELECT src_table, row_key, coalesce(array_to_string(i, '|'), '') AS items, CAST(len(i) AS BIGINT) AS n_items FROM i"


def _iso_sql() -> str:
    parts = [f"SELECT '{t}' AS src_table, {key} AS row_key, {field} AS v FROM {t}" for t, (key, field) in DATED.items()]
    at = "epoch_us(TRY_CAST(v AS TIMESTAMPTZ))"
    ok = f"{at} >= 631152000000000 AND {at} < 2082758400000000"
    return f"WITH t AS ({' UNION ALL '.join(parts)}) SELECT src_table, row_key, CAST(CASE WHEN coalesce({ok}, false) THEN 1 ELSE 0 END AS BIGINT) AS n_readings, CASE WHEN {ok} THEN {at} END AS utc_micros FROM t WHERE regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]{{1,6}})?(Z|[+-][0-9]{{2}}:[0-9]{{2}})')"


def oracle_sql() -> dict[str, str]:
    found, tags = _nested_sql()
    return {"p2_found": found, "p2_activity_tags": tags, "p3_plain": _plain_sql(), "p4_iso": _iso_sql()}
