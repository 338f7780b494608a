"""Listing records into flat story rows: activities, posts, addresses on pages, metadata laid over what is known, chapter tables.

Rows come out of one pass over a payload; see ``nested_records`` for how payloads are read. A malformed value is unset, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators.nested_records import many, parse_payload, scalar

# The address prefix of each kind of work, and the labels of counters and flags of an activity.
KIND_PREFIX = {"story": "s", "audio": "s", "poem": "p", "illustra": "i"}
COUNTERS = {"Votes": "rate_count", "Views": "view_count", "Favorites": "favorite_count", "Comments": "comment_count", "Rank": "rank", "Reading Lists": "reading_lists_count"}
FLAGS = {"Is Hot": "is_hot", "Is New": "is_new", "Writer's Pick": "writers_pick", "Contest Winner": "contest_winner"}


def _is_object(value: str) -> str:
    return f"(try_variant_get({value}, '$', 'map<string,variant>') IS NOT NULL)"


def activity_rows(df: DataFrame, page: str, text_col: str, lists: tuple[str, ...], action: str, categories: dict[int, str], slug_path: str = "$.url") -> DataFrame:
    """Published works on activity pages: page, pos, activity_id, story_id, url, title, description, author, category, category_id, tags,
    rating, words, work, work_id, parts, announced, custom.

    Kept are activities of this action whose ``what`` is an object with a slug (its url, or what stands at ``slug_path``) and an id. Texts that are blank are null, numbers keep 0.
    The category is the table's name of its id, else its address in title case. A series that is a list says nothing. ``announced`` is
    the activity's second in ISO form. ``custom`` has non-null counters, and flags where they stand, as text.
    """
    doc = parse_payload(df.select(page, text_col), text_col, "__doc").where(F.col("__doc").isNotNull())
    found = "coalesce(" + ", ".join(many(f"try_variant_get(__doc, '{p}', 'variant')") for p in lists) + ")"
    rows = doc.selectExpr(page, f"posexplode_outer({found}) AS (p, r)").where("r IS NOT NULL")
    rows = rows.selectExpr(page, "CAST(p + 1 AS BIGINT) AS pos", "r", "try_variant_get(r, '$.what', 'variant') AS w")
    rows = rows.where(F.expr(f"{scalar('r', '$.action')} = '{action}' AND {_is_object('w')}"))
    text = lambda path, of="w": F.nullif(F.expr(scalar(of, path)), F.lit(""))
    known = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    number = text("$.category").try_cast("int")
    slug = S.slug_title(text("$.category_info.pageUrl"))
    tag = f"{scalar('t', '$.tag')}"
    named = [F.struct(F.lit(k).alias("k"), F.expr(scalar("w", f"$.{c}")).alias("v")) for k, c in COUNTERS.items()]
    flag = lambda c: F.expr(f"CASE WHEN {scalar('w', f'$.{c}')} IN ('1', 'true') THEN 'true' WHEN {scalar('w', f'$.{c}')} IS NOT NULL THEN 'false' END")
    named += [F.struct(F.lit(k).alias("k"), flag(c).alias("v")) for k, c in FLAGS.items()]
    series = "try_variant_get(w, '$.series', 'map<string,variant>')"
    prefix = S.mapped(text("$.type"), KIND_PREFIX, "s")
    return rows.select(
        page,
        "pos",
        text("$.id", "r").alias("activity_id"),
        F.expr(scalar("w", "$.id")).alias("story_id"),
        F.concat(F.lit("/"), prefix, F.lit("/"), text(slug_path)).alias("url"),
        text("$.title").alias("title"),
        text("$.description").alias("description"),
        F.coalesce(text("$.author.username"), text("$.authorname")).alias("author"),
        F.coalesce(F.try_element_at(known, number), slug).alias("category"),
        number.alias("category_id"),
        F.nullif(F.expr(f"array_join(filter(transform({many('try_variant_get(w, ' + chr(39) + '$.tags' + chr(39) + ', ' + chr(39) + 'variant' + chr(39) + ')')}, t -> {tag}), t -> t IS NOT NULL AND t <> ''), ', ')"), F.lit("")).alias("tags"),
        F.expr(scalar("w", "$.rate_all")).try_cast("double").alias("rating"),
        F.expr(scalar("w", "$.words_count")).try_cast("bigint").alias("words"),
        F.when(F.expr(f"{series} IS NOT NULL"), text("$.series.meta.title")).alias("work"),
        F.when(F.expr(f"{series} IS NOT NULL"), text("$.series.meta.id")).alias("work_id"),
        F.when(F.expr(f"{series} IS NOT NULL"), F.expr("size(try_variant_get(w, '$.series.items', 'array<variant>'))")).alias("parts"),
        F.date_format(F.timestamp_seconds(F.expr(scalar("r", "$.when")).try_cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss").alias("announced"),
        F.map_from_entries(F.filter(F.array(*named), lambda e: e["v"].isNotNull())).alias("custom"),
    ).where("url IS NOT NULL AND story_id IS NOT NULL")


def first_sightings(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in order, with ``seen``: how many rows it stands for. One mergeable aggregate."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"), F.count(F.lit(1)).alias("seen"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in rest], "seen")


def unmapped(rows: DataFrame, number: str, known: list[int]) -> DataFrame:
    """One row: the ids outside the table, each once, in order, joined by ', '; '' where all are known. Ids are a small closed set by nature."""
    strange = rows.where(F.col(number).isNotNull() & ~F.col(number).isin(*known)).select(number).distinct()
    return strange.agg(F.array_join(F.transform(F.array_sort(F.collect_list(number)), lambda x: x.cast("string")), ", ").alias("unmapped"))


def membership_label(member: Column) -> Column:
    """What a membership is, from its attributes as JSON text: 'Active', 'Cancelled' (with the last day of access if there is one), 'Payment
    declined', 'Former', 'Free' for a status that is there and null; null without attributes, without a status, and for an unknown one."""
    m = F.from_json(member, "map<string,string>")
    status, ended = F.try_element_at(m, F.lit("patron_status")), S.blank_to_null(F.try_element_at(m, F.lit("pledge_relationship_end")))
    until = F.date_format(F.try_element_at(m, F.lit("access_expires_at")).try_cast("timestamp"), "d MMM yyyy")
    cancelled = F.when(until.isNotNull(), F.concat(F.lit("Cancelled (access until "), until, F.lit(")"))).otherwise("Cancelled")
    return F.when(
        F.map_contains_key(m, F.lit("patron_status")),
        F.when(status.isNull(), "Free").when(status == "active_patron", F.when(ended.isNull(), "Active").otherwise(cancelled)).when(status == "declined_patron", "Payment declined").when(status == "former_patron", "Former"),
    )


def is_signed_in(memberships: Column) -> Column:
    """Whether an answer describes somebody: ``data`` is an object whose id is not blank."""
    return F.coalesce(F.get_json_object(memberships, "$.data.id") != "", F.lit(False))


def post_rows(posts: DataFrame, campaigns: DataFrame, media: DataFrame, post: str, campaign: str) -> DataFrame:
    """Posts with their campaign and chosen medium: post, url, format, title, author, description, series, custom.

    ``posts``: title, content, post_kind, collection_id, collection. ``campaigns``: name, creator, membership. ``media``: one row a post with
    media_id, file_name, mimetype. The title falls back to the file's stem, an unknown type of file is an epub. Posts without a medium have no row.
    """
    j = posts.join(media.hint("merge"), post).join(campaigns.hint("merge"), campaign)
    stem = F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", "")
    entries = {"Post Type": F.col("post_kind"), "Campaign": F.col("name"), "Membership": F.nullif("membership", F.lit("")), "source_filename": F.nullif("file_name", F.lit(""))}
    custom = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries.items()]), lambda e: e["v"].isNotNull()))
    whole = F.nullif("collection_id", F.lit("")).isNotNull() & F.nullif("collection", F.lit("")).isNotNull()
    return j.select(
        post,
        F.concat(F.lit("/file?h="), F.col(post), F.lit("&m="), F.col("media_id")).alias("url"),
        S.format_of_mime(F.col("mimetype")).alias("format"),
        F.coalesce(F.nullif("title", F.lit("")), stem).alias("title"),
        F.col("creator").alias("author"),
        S.plain_excerpt(F.col("content"), 500).alias("description"),
        F.when(whole, F.col("collection")).alias("series"),
        custom.alias("custom"),
    )


# ---- addresses on pages, metadata ----


def listed_urls(df: DataFrame, listing: str, html: str) -> DataFrame:
    """Link targets on listing pages, each once a listing, with their first place: listing, pos (from 1), url, identity. Targets without an
    identity are dropped."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^<>]*?href\s*=\s*[\"']([^\"'<>]*)[\"']"), F.lit(1))
    rows = df.select(listing, F.posexplode_outer(links).alias("__p", "url")).where("url IS NOT NULL")
    rows = rows.withColumn("identity", S.canonical_url(F.col("url"))).where("identity IS NOT NULL")
    return rows.groupBy(listing, "url", "identity").agg((F.min("__p") + 1).cast("bigint").alias("pos")).select(listing, "pos", "url", "identity")


def is_part(story_url: Column, url_number: Column, meta_url: Column, chapters: Column, title_number: Column) -> Column:
    """Whether metadata tells of a larger work: it names another address, or it has several chapters, the address has a chapter number and
    the title has none."""
    other = F.coalesce((S.blank_to_null(meta_url).isNotNull()) & (S.canonical_url(meta_url) != S.canonical_url(story_url)), F.lit(False))
    return other | F.coalesce((chapters > 1) & url_number.isNotNull() & title_number.isNull(), F.lit(False))


def with_metadata(rows: DataFrame, part: Column, texts: dict[str, Column], numbers: dict[str, Column], shared: list[str], parent_title: Column, parent_url: Column) -> DataFrame:
    """Lay metadata over rows: of a part only the ``shared`` texts count, and the work's title and address are kept beside it; of a whole story
    all texts and numbers count. What metadata leaves out never blanks what is there. The rows have all of these columns."""
    out = {}
    for name, value in texts.items():
        new = S.blank_to_null(S.html_unescape(value))
        out[name] = F.coalesce(new, F.col(name)) if name in shared else F.when(part, F.col(name)).otherwise(F.coalesce(new, F.col(name)))
    for name, value in numbers.items():
        out[name] = F.when(part, F.col(name)).otherwise(F.coalesce(value, F.col(name)))
    out["work"] = F.when(part, S.blank_to_null(parent_title))
    out["work_url"] = F.when(part & (S.canonical_url(parent_url) != S.canonical_url(F.col("url"))), parent_url)
    return rows.select(*[c for c in rows.columns if c not in out], *[v.alias(n) for n, v in out.items()])


def series_of(c: Column) -> tuple[Column, Column]:
    """(name, number) of a series written 'Name [3]'; the number is null where there is none."""
    number = F.nullif(F.regexp_extract(c, r"^\s*.*\S\s*\[(\d+(?:\.\d+)?)\]\s*$", 1), F.lit("")).try_cast("double")
    return S.blank_to_null(F.when(number.isNotNull(), F.regexp_replace(c, r"\s*\[\d+(?:\.\d+)?\]\s*$", "")).otherwise(c)), number


def chapter_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """Chapters of a JSON list of [number, {title, url}] pairs: key, url, title, ordinal; each url once, with the place it had before repeats
    fell away. Entries that are no such pair are skipped; a title that is no text is null."""
    doc = parse_payload(df.select(key, text), text, "__doc").where(F.col("__doc").isNotNull())
    entry = "try_variant_get(e, '$[1]', 'variant')"
    rows = doc.selectExpr(key, "posexplode_outer(try_variant_get(__doc, '$', 'array<variant>')) AS (p, e)").where("e IS NOT NULL")
    rows = rows.select(
        key,
        (F.col("p") + 1).cast("bigint").alias("ordinal"),
        F.expr(f"CASE WHEN schema_of_variant(try_variant_get({entry}, '$.url', 'variant')) = 'STRING' THEN {scalar(entry, '$.url')} END").alias("url"),
        F.expr(f"CASE WHEN schema_of_variant(try_variant_get({entry}, '$.title', 'variant')) = 'STRING' THEN {scalar(entry, '$.title')} END").alias("title"),
    ).where("url <> ''")
    first = rows.groupBy(key, "url").agg(F.min_by(F.struct("title", "ordinal"), "ordinal").alias("b"))
    return first.select(key, "url", "b.title", "b.ordinal")


# ---- checks of a download ----


def download_fault(outcome: Column, site: Column, after: Column, distinct: Column, missing: Column) -> Column:
    """The first rule a download breaks: 'duplicate chapters', 'incomplete download' of a new book, 'chapters the site lists are missing' in
    an updated one; null if none."""
    return (
        F.when(~distinct.eqNullSafe(after), "duplicate chapters")
        .when((outcome == "created") & ~after.eqNullSafe(site), "incomplete download")
        .when((outcome == "updated") & F.coalesce(missing, F.lit(False)), "chapters the site lists are missing")
    )


def no_new_content(same_date: Column, has_table: Column, subset: Column, remote: Column, known: Column) -> Column:
    """Whether there is nothing to fetch: the date is the same, and every listed chapter is known or, without a chapter table, the site has
    no more chapters than are known."""
    return F.coalesce(same_date, F.lit(False)) & F.when(F.coalesce(has_table, F.lit(False)), F.coalesce(subset, F.lit(False))).otherwise(F.coalesce(remote <= known, F.lit(False)))


def progress_band(done: Column, total: Column, low: float = 5.0, high: float = 92.0) -> Column:
    """Progress mapped onto a band; nothing to do is all done."""
    return F.lit(low) + (high - low) * F.when(total > 0, done / total).otherwise(F.lit(1.0))


def unchanged(prior_validator: Column, validator: Column, prior_digest: Column, digest: Column) -> Column:
    """Why a source needs no reading: 'same validator', 'same content', else null; unknown validators and digests prove nothing."""
    return F.when(prior_validator == validator, "same validator").when(prior_digest == digest, "same content")


def newest_first_page(df: DataFrame, group: str, stamp: str, order: list[str], page: int, size: int) -> DataFrame:
    """One page of each group's rows, newest first, rows without a stamp last. Catalyst turns the rank into a limit before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(stamp), *order)
    rn = F.row_number().over(w)
    return df.withColumn("__rn", rn).where((F.col("__rn") > page * size) & (F.col("__rn") <= (page + 1) * size)).withColumn("place", F.col("__rn") - page * size).drop("__rn")
