"""Listing payloads into flat rows: search pages, document graphs with included records, nested reports.

Every row comes out of one pass over its payload; lookups among a page's included records are higher-order filters over that
page's own array, so that nothing is shuffled. Where an id stands twice among the included records the last one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.operators.nested_records import many, parse_payload, scalar


def _v(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def _included(kind: str, wanted: str) -> str:
    """The last included record of a type with an id."""
    return f"try_element_at(filter(inc, x -> {scalar('x', '$.type')} = '{kind}' AND {scalar('x', '$.id')} = {wanted}), -1)"


def _with_included(df: DataFrame, text_col: str) -> DataFrame:
    doc = parse_payload(df, text_col, "__doc").where(F.col("__doc").isNotNull())
    return doc.withColumn("inc", F.expr(f"coalesce({many(_v('__doc', '$.included'))}, array())"))


def search_rows(df: DataFrame, text_col: str, kinds: dict[str, str], counters: list[str], flags: list[str]) -> DataFrame:
    """One row per record with a url: page_id, pos, url, title, author, category_slug, tags (joined by ', '), words, custom.

    ``kinds`` gives the url prefix of each record type ('' the default). The author falls back to the flat name; blank texts are
    null, zero counts are kept. ``custom`` maps the names of non-null counters, and of flags that are present, to text.
    """
    doc = parse_payload(df.select("page_id", text_col), text_col, "__doc").where(F.col("__doc").isNotNull())
    rows = doc.selectExpr("page_id", f"posexplode_outer({many(_v('__doc', '$.data'))}) AS (p, r)").where("r IS NOT NULL")
    prefix = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    named = [F.struct(F.lit(c).alias("k"), F.expr(scalar("r", f"$.{c}")).alias("v")) for c in counters]
    named += [F.struct(F.lit(f).alias("k"), F.expr(f"CASE {scalar('r', f'$.{f}')} WHEN '1' THEN 'true' WHEN '0' THEN 'false' ELSE {scalar('r', f'$.{f}')} END").alias("v")) for f in flags]
    text = lambda path: F.nullif(F.expr(scalar("r", path)), F.lit(""))
    tag = f"coalesce({scalar('t')}, {scalar('t', '$.tag')})"
    return rows.select(
        "page_id",
        (F.col("p") + 1).alias("pos"),
        F.concat(F.coalesce(F.try_element_at(prefix, text("$.type")), F.try_element_at(prefix, F.lit("")), F.lit("")), text("$.url")).alias("url"),
        text("$.title").alias("title"),
        F.coalesce(text("$.author.username"), text("$.authorname")).alias("author"),
        text("$.category_info.pageUrl").alias("category_slug"),
        F.nullif(F.expr(f"array_join(filter(transform({many(_v('r', '$.tags'))}, t -> {tag}), t -> t IS NOT NULL), ', ')"), F.lit("")).alias("tags"),
        F.expr(scalar("r", "$.words_count")).try_cast("bigint").alias("words"),
        F.map_from_entries(F.filter(F.array(*named), lambda e: e["v"].isNotNull())).alias("custom"),
    ).where("url IS NOT NULL AND title IS NOT NULL")


def graph_campaigns(df: DataFrame, text_col: str) -> DataFrame:
    """One row per included campaign: campaign_id, name, creator, status (null where the member has none or is missing)."""
    doc = _with_included(df.select(text_col), text_col)
    rows = doc.selectExpr("inc", f"explode_outer(filter(inc, x -> {scalar('x', '$.type')} = 'campaign')) AS c").where("c IS NOT NULL")
    rows = rows.withColumn("creator_id", F.expr(scalar("c", "$.relationships.creator.data.id"))).withColumn("campaign_id", F.expr(scalar("c", "$.id")))
    member = f"try_element_at(filter(inc, x -> {scalar('x', '$.type')} = 'member' AND {scalar('x', '$.relationships.campaign.data.id')} = campaign_id), -1)"
    return rows.where("campaign_id IS NOT NULL").select(
        "campaign_id",
        F.expr(scalar("c", "$.attributes.name")).alias("name"),
        F.expr(scalar(_included("user", "creator_id"), "$.attributes.full_name")).alias("creator"),
        F.expr(scalar(member, "$.attributes.patron_status")).alias("status"),
    )


def graph_posts(df: DataFrame, text_col: str) -> DataFrame:
    """One row per post: page_id, pos, post_id, title, published_at, media (ids with file names, '' where unknown, in order of
    first mention over both relationships), collection (title of the first collection, null where blank), next_cursor."""
    doc = _with_included(df.select("page_id", text_col), text_col)
    rows = doc.selectExpr("page_id", "inc", f"{scalar('__doc', '$.meta.pagination.cursors.next')} AS next_cursor", f"posexplode_outer({many(_v('__doc', '$.data'))}) AS (p, r)").where("r IS NOT NULL")
    ids = " , ".join(f"coalesce(transform({many(_v('r', f'$.relationships.{k}.data'))}, m -> {scalar('m', '$.id')}), array())" for k in ("attachments_section", "media"))
    rows = rows.withColumn("ids", F.expr(f"filter(array_distinct(concat({ids})), i -> i IS NOT NULL)"))
    first = f"try_element_at({many(_v('r', '$.relationships.collections.data'))}, 1)"
    rows = rows.withColumn("collection_id", F.expr(scalar(first, "$.id")))
    media = f"transform(ids, i -> struct(i AS id, coalesce({scalar(_included('media', 'i'), '$.attributes.file_name')}, '') AS file_name))"
    return rows.select(
        "page_id",
        (F.col("p") + 1).alias("pos"),
        F.expr(scalar("r", "$.id")).alias("post_id"),
        F.expr(scalar("r", "$.attributes.title")).alias("title"),
        F.expr(scalar("r", "$.attributes.published_at")).alias("published_at"),
        F.expr(media).alias("media"),
        F.nullif(F.trim(F.expr(scalar(_included("collection", "collection_id"), "$.attributes.title"))), F.lit("")).alias("collection"),
        "next_cursor",
    )


def report_findings(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Results[].Vulnerabilities[] of reports as distinct rows: key, package, installed, fixed, advisory, severity."""
    doc = parse_payload(df.select(key, text_col), text_col, "__doc").where(F.col("__doc").isNotNull())
    found = f"flatten(transform({many(_v('__doc', '$.Results'))}, r -> coalesce({many(_v('r', '$.Vulnerabilities'))}, array())))"
    rows = doc.selectExpr(key, f"explode_outer({found}) AS v").where("v IS NOT NULL")
    names = {"package": "PkgName", "installed": "InstalledVersion", "fixed": "FixedVersion", "advisory": "VulnerabilityID", "severity": "Severity"}
    return rows.select(key, *[F.expr(scalar("v", f"$.{n}")).alias(a) for a, n in names.items()]).distinct()
