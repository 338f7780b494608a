"""Keeping a library server's records in step: tags, ratings, field-wise patches, reading state, page positions, file lookups.

Expressions over the columns of joined records; nothing here shuffles. Null means unset throughout; what is said of it is said in each docstring.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioworks.functions import scalars as S
from folioworks.operators.changes import same_folded_set, upsert_links
from folioworks.operators.relational import _fold, folded_difference, folded_distinct

# How a story's status is called on the server.
STATUS = {"Completed": "ENDED", "In-Progress": "ONGOING"}


@F.pandas_udf(ArrayType(StringType()))
def _composed(star: pd.Series, categories: pd.Series, tags: pd.Series) -> pd.Series:
    def compose(s: str | None, cats: list[str], others: list[str]) -> list[str]:
        out = {_fold(x): x for x in ([s] if s else [])}
        for x in cats:
            out.setdefault(_fold(x), x)
        rest: dict[str, str] = {}
        for x in others:
            if _fold(x) not in out:
                rest.setdefault(_fold(x), x)
        return [*out.values(), *sorted(rest.values(), key=str.lower)]

    return pd.Series([compose(s, [] if c is None else list(c), [] if t is None else list(t)) for s, c, t in zip(star, categories, tags)])


def composed_tags(category: Column, tags: Column, rating: Column) -> Column:
    """The tag list in its one order: the star tag of a rating from 1 to 5, the categories as they stand, all other tags from A to Z; each
    once, whatever its case and Unicode form. Both fields are lists joined by ', '; null is an empty list."""
    return _composed(S.star_tag(rating), S.split_csv(category), S.split_csv(tags))


def remote_only_tags(remote: Column, category: Column, tags: Column, pushed: Column) -> Column:
    """Tags that only the server has: no ratings, none that holds the list separator, none of the known or of those pushed before."""
    own = F.filter(remote, lambda t: t.isNotNull() & ~F.contains(t, F.lit(", ")) & ~F.coalesce(S.is_rating_like(t), F.lit(False)))
    return folded_distinct(folded_difference(own, F.concat(S.split_csv(category), S.split_csv(tags), F.coalesce(pushed, F.array().cast("array<string>")))))


def catalog_of(genres: Column, tags: Column) -> tuple[Column, Column]:
    """(category, tags) as lists joined by ', ' from a server's genres and tags; ratings and genres are no tags; null where empty."""
    bare = F.filter(tags, lambda t: t.isNotNull() & ~F.coalesce(S.is_rating_like(t), F.lit(False)))
    return S.blank_to_null(F.array_join(genres, ", ")), S.blank_to_null(F.array_join(folded_difference(bare, genres), ", "))


def rating_decision(local: Column, remote: Column) -> Column:
    """struct(desired, adopt, clear): an own rating wins; 0 asks to clear; unset takes over 1 to 5 from the server and nothing else."""
    taken = F.when(remote.between(1, 5), remote)
    return F.struct(
        F.when(local.isNull(), taken).when(local != 0, local).cast("int").alias("desired"),
        F.when(local.isNull(), taken).cast("int").alias("adopt"),
        F.coalesce(local == 0, F.lit(False)).alias("clear"),
    )


def _patch(entries: list[tuple[str, Column, Column]]) -> Column:
    """A map of (field, value as text) of the entries whose condition holds."""
    structs = [F.when(F.coalesce(changed, F.lit(False)), F.struct(F.lit(name).alias("k"), value.cast("string").alias("v"))) for name, value, changed in entries]
    return F.map_from_entries(F.filter(F.array(*structs), lambda e: e.isNotNull()))


def book_patch(local: dict[str, Column], current: dict[str, Column]) -> Column:
    """The changed fields of a book, as text or JSON text.

    ``local``: title, synopsis, description, published (date), authors (array), series_index (double), identifiers, tags (array),
    book_url, author_url. ``current``: title, summary, release_date, authors (array), number, number_sort, isbn, tags, links.
    A blank title, no date, no authors, no series number and no valid ISBN change nothing; the summary may become ''.
    """
    title = S.blank_to_null(local["title"])
    summary = F.coalesce(S.blank_to_null(local["synopsis"]), S.blank_to_null(local["description"]), F.lit(""))
    date = F.date_format(local["published"], "yyyy-MM-dd")
    names = F.filter(F.transform(local["authors"], lambda x: F.trim(x)), lambda n: n != "")
    number, isbn = S.number_text(local["series_index"]), S.isbn13(S.identifier(local["identifiers"], "isbn"))
    before = F.coalesce(current["links"], F.array().cast("array<struct<label:string,url:string>>"))
    links = before
    for label, url in (("Book", local["book_url"]), ("Author", local["author_url"])):
        links = F.when(S.blank_to_null(url).isNotNull(), upsert_links(links, F.lit(label), url)).otherwise(links)
    differs = lambda new, old: ~new.eqNullSafe(old)
    return _patch(
        [
            ("title", title, title.isNotNull() & differs(title, current["title"])),
            ("summary", summary, summary != F.coalesce(current["summary"], F.lit(""))),
            ("releaseDate", date, date.isNotNull() & differs(date, current["release_date"])),
            ("authors", F.to_json(names), (F.size(names) > 0) & differs(names, F.coalesce(current["authors"], F.array().cast("array<string>")))),
            ("number", number, number.isNotNull() & differs(number, current["number"])),
            ("numberSort", number, number.isNotNull() & differs(local["series_index"], current["number_sort"])),
            ("isbn", isbn, isbn.isNotNull() & differs(isbn, current["isbn"])),
            ("tags", F.to_json(local["tags"]), ~same_folded_set(local["tags"], current["tags"])),
            ("links", F.to_json(links), differs(links, before)),
        ]
    )


def series_patch(local: dict[str, Column], current: dict[str, Column]) -> Column:
    """The changed fields of a series, as text or JSON text.

    ``local``: category, status, publisher, site, series, series_url, story_url. ``current``: genres (array), status, publisher, links.
    A status outside the table changes nothing. A book of a series links the series, any other its own story.
    """
    genres, status = S.split_csv(local["category"]), S.mapped(S.blank_to_null(local["status"]), STATUS)
    publisher = F.coalesce(S.blank_to_null(local["publisher"]), S.blank_to_null(local["site"]))
    url = S.blank_to_null(F.when(S.blank_to_null(local["series"]).isNotNull(), local["series_url"]).otherwise(local["story_url"]))
    before = F.coalesce(current["links"], F.array().cast("array<struct<label:string,url:string>>"))
    links = upsert_links(before, F.lit("Story"), url)
    return _patch(
        [
            ("genres", F.to_json(genres), ~same_folded_set(genres, current["genres"])),
            ("status", status, status.isNotNull() & ~status.eqNullSafe(current["status"])),
            ("publisher", publisher, publisher.isNotNull() & ~publisher.eqNullSafe(current["publisher"])),
            ("links", F.to_json(links), url.isNotNull() & ~links.eqNullSafe(before)),
        ]
    )


# ---- reading state ----


def reading_state(page: Column, pages: Column, completed: Column) -> Column:
    """struct(percent, state): whole percent, 100 where completed, null without a page total; 'unread', 'reading' or 'read'."""
    share = F.when(pages > 0, F.least(F.lit(100), F.floor(page * 100 / pages)).cast("int"))
    done = F.coalesce(completed, F.lit(False))
    return F.struct(F.when(done, 100).otherwise(share).alias("percent"), F.when(done, "read").when(F.coalesce(page, F.lit(0)) > 0, "reading").otherwise("unread").alias("state"))


def has_progress(position: Column, progression: Column, total: Column) -> Column:
    """Whether a stored position says anything: one of its three numbers is there and not zero."""
    any_ = [F.coalesce(c != 0, F.lit(False)) for c in (position, progression, total)]
    return any_[0] | any_[1] | any_[2]


def kept_position(stored_at: Column, stored_href: Column, live_at: Column, live_href: Column) -> Column:
    """'stored' or 'live': the stored position is taken up again unless it is older and in another chapter; an unknown time counts as not older.
    Chapters are compared by file name."""
    older = F.coalesce(stored_at < live_at, F.lit(False))
    elsewhere = ~S.basename(stored_href).eqNullSafe(S.basename(live_href))
    return F.when(stored_href.isNull() | (older & elsewhere), "live").otherwise("stored")


def repair_needed(before_page: Column, after_page: Column, before_pages: Column, after_pages: Column) -> Column:
    """'page reset' where a page was known and is gone or first again, 'lost' where the record itself is gone, 'none' else."""
    return F.when((before_page > 1) & after_pages.isNull() & before_pages.isNotNull(), "lost").when((before_page > 1) & (F.coalesce(after_page, F.lit(0)) <= 1), "page reset").otherwise("none")


def nudge_due(file: Column, item: Column, attempted: Column, attempt_size: Column, size: Column) -> Column:
    """Why a folder has to be scanned again: 'first attempt' without a link and an attempt, 'file changed' where the size differs from the one
    at the last attempt, else null; without a file never."""
    return F.when(S.blank_to_null(file).isNull(), None).when(S.blank_to_null(item).isNull() & attempted.isNull(), "first attempt").when(attempted.isNotNull() & ~size.eqNullSafe(attempt_size), "file changed")


# ---- pages of chapters ----


def page_bounds(anchors: DataFrame, doc: str, start: str, total: Column) -> DataFrame:
    """Anchors in reading order with ``span`` (pages to the next later start, else to the end, at least 1) and ``max_page``: a chapter that
    another follows ends on its own last page, the last one may end on the book's last. Anchors with one start have one span."""
    marks = anchors.select(doc, start).where(F.col(start).isNotNull()).distinct()
    marks = marks.select(F.col(doc).alias("__d"), F.col(start).alias("__s"), F.lead(start).over(Window.partitionBy(doc).orderBy(start)).alias("__next"))
    j = anchors.join(marks, anchors[doc].eqNullSafe(F.col("__d")) & (anchors[start] == F.col("__s")), "left")
    span = F.greatest(F.lit(1), F.coalesce(F.col("__next"), total) - F.col(start))
    last = F.when(F.col("__next").isNotNull(), F.col(start) + span - 1).otherwise(F.col(start) + span)
    return j.withColumns({"span": span, "max_page": last}).drop("__d", "__s", "__next")


def page_covers(page: Column, start: Column, span: Column, max_page: Column) -> tuple[Column, Column]:
    """(low, high): the progress within a chapter that rounds to this page; the ends are open to 0 and 1."""
    offset = F.least(page, max_page) - start
    low = F.when(offset <= 0, F.lit(0.0)).otherwise((offset - 0.5) / span)
    high = F.when(page >= max_page, F.lit(1.0)).otherwise((offset + 0.5) / span)
    return F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)


# ---- files and assets ----


def is_bare_filename(name: Column) -> Column:
    return F.coalesce(~name.rlike(r"[/\\]") & ~name.isin(".", "..", ""), F.lit(False))


def own_candidates(assets: DataFrame, kind: str, namespace: str, wanted_kind: str, own: str) -> DataFrame:
    """Assets of a kind in one's own name space; a missing name space is one's own."""
    return assets.where((F.col(kind) == wanted_kind) & (F.coalesce(S.blank_to_null(F.col(namespace)), F.lit(own)) == own))


def to_generate(books: DataFrame, assets: DataFrame, book: str, model: str, overridden: Column) -> DataFrame:
    """Books and models for which nothing was made yet and which nobody edited by hand."""
    return books.where(~F.coalesce(overridden, F.lit(False))).join(assets.select(book, model).distinct(), [book, model], "left_anti")


def matching_file(chapters: DataFrame, wanted: DataFrame, doc: str, files: str, path: str, fold_of: str) -> DataFrame:
    """Per wanted path the first chapter and file, in order, that is the same file and has an id: doc, path, chapter_pos, file_pos, file_id.

    ``files`` is an array of struct(id, path) of folded paths, ``fold_of`` the folded wanted path. The last segment, which must be
    equal, is the join key, so no path meets every file.
    """
    last = lambda c: F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    rows = chapters.select(F.col(doc).alias("__doc"), F.col("pos").alias("chapter_pos"), F.posexplode(files).alias("file_pos", "__f")).select("__doc", "chapter_pos", "file_pos", F.col("__f.id").alias("file_id"), F.col("__f.path").alias("__p"))
    rows = rows.where("file_id IS NOT NULL").withColumn("__last", last(F.col("__p")))
    w = wanted.select(doc, path, fold_of).withColumn("__last", last(F.col(fold_of)))
    slashes = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", "")
    hit = w.join(rows, (w[doc] == F.col("__doc")) & (w["__last"] == rows["__last"])).where(slashes(F.col("__p")).eqNullSafe(slashes(F.col(fold_of))) | slashes(F.col("__p")).endswith(F.concat(F.lit("/"), slashes(F.col(fold_of)))))
    best = hit.groupBy(doc, path).agg(F.min(F.struct("chapter_pos", "file_pos", "file_id")).alias("b"))
    return best.select(doc, path, "b.chapter_pos", "b.file_pos", "b.file_id")
