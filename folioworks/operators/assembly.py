"""Putting several books together: facts of candidates, the survivor's patches, chapter addresses, landmarks, free numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_facts(chapters: DataFrame, book: str, pos: str, number: str, is_content: Column) -> DataFrame:
    """Per book: first_number (of its first content chapter), min_number (of all content chapters), chapter_count (of all chapters, 0
    without a content chapter)."""
    c = chapters.withColumn("__c", F.coalesce(is_content, F.lit(False)))
    g = c.groupBy(book).agg(
        F.min(F.when(F.col("__c"), F.struct(pos, number)))[number].alias("first_number"),
        F.min(F.when(F.col("__c"), F.col(number))).alias("min_number"),
        F.when(F.bool_or("__c"), F.count(F.lit(1))).otherwise(F.lit(0)).alias("chapter_count"),
    )
    return g


def merge_patches(elected: DataFrame, members: DataFrame, group: str, book: str) -> DataFrame:
    """One patch per member of a merge: the survivor is updated, each other is deleted and superseded by it."""
    s = elected.select(group, F.col(book).alias("survivor"))
    j = members.select(group, book).distinct().join(s, group)
    own = F.col(book) == F.col("survivor")
    return j.select(group, book, F.when(own, "update").otherwise("delete").alias("action"), F.when(~own, F.col("survivor")).alias("superseded_by"))


def refused_selections(members: DataFrame, group: str, book: str, file: str) -> DataFrame:
    """Groups that cannot be merged: fewer than two books, or two of them with the same file (blank files do not count)."""
    f = F.nullif(F.trim(F.col(file)), F.lit(""))
    g = members.groupBy(group).agg(F.count_distinct(book).alias("n"), F.count(f).alias("files"), F.count_distinct(f).alias("distinct_files"))
    return g.where("n < 2 OR files > distinct_files").select(group, F.when(F.col("n") < 2, "too few").otherwise("shared file").alias("reason"))


def stamp_addresses(chapters: DataFrame, book: str, own_url: str, book_url: Column, is_title_page: Column | None = None) -> DataFrame:
    """Add ``url``. The only chapter of a book gets the book's address in place of its own; the chapters of a book of several get it just
    where none of them declares one, else each keeps what it declares. Title pages do not count and keep what they declare. ``book_url``
    is used as it stands; see ``book_address``. Blank addresses are none."""
    own = F.nullif(F.trim(F.col(own_url)), F.lit(""))
    content = ~F.coalesce(is_title_page, F.lit(False)) if is_title_page is not None else F.lit(True)
    c = chapters.withColumns({"__own": own, "__content": content, "__url": F.nullif(F.trim(book_url), F.lit(""))})
    facts = c.where("__content").groupBy(F.col(book).alias("__book")).agg(F.count(F.lit(1)).alias("__n"), F.count("__own").alias("__declared"))
    j = c.join(facts, c[book].eqNullSafe(F.col("__book")), "left")
    stamped = F.col("__content") & ((F.col("__n") == 1) | (F.col("__declared") == 0))
    return j.withColumn("url", F.when(stamped, F.coalesce("__url", "__own")).otherwise(F.col("__own"))).drop("__own", "__content", "__url", "__book", "__n", "__declared")


def book_address(given: Column, source: Column, title_page: Column) -> Column:
    """A book's address: the one given, else its source if that is a web address, else the one on its title page."""
    return F.coalesce(F.nullif(given, F.lit("")), F.when(source.rlike("^https?://"), source), F.nullif(title_page, F.lit("")))


def absorbed_links(parts: DataFrame, book: str, url: str, precedence: str, pos: str) -> DataFrame:
    """Addresses of all merged books, each once: the part with the lowest precedence value, then the earliest place, gives it."""
    rest = [c for c in parts.columns if c not in (book, url)]
    best = parts.where(F.col(url).isNotNull()).groupBy(book, url).agg(F.min_by(F.struct(*rest), F.struct(precedence, pos)).alias("__b"))
    return best.select(book, url, *[F.col(f"__b.{c}").alias(c) for c in rest])


def first_where(df: DataFrame, group: str, value: str, pos: str, condition: Column) -> DataFrame:
    """Per group the value at the first place where a condition holds; null where it never does."""
    return df.groupBy(group).agg(F.min(F.when(condition, F.struct(pos, value)))[value].alias(value))


def highest_version(df: DataFrame, group: str, version: str) -> DataFrame:
    """Per group the highest dotted version, by numbers; unreadable ones lose."""
    parts = F.transform(F.split(F.col(version), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    return df.groupBy(group).agg(F.max(F.struct(parts.alias("p"), F.col(version).alias("v")))["v"].alias(version))


def free_numbers(staged: DataFrame, taken: DataFrame, book: str, order: str, number: str) -> DataFrame:
    """Give each staged row the next number of its book that is not taken, in order."""
    used = taken.groupBy(book).agg(F.collect_set(number).alias("__used"))
    ranked = staged.withColumn("__k", F.row_number().over(Window.partitionBy(book).orderBy(order))).join(used, book, "left")
    used_or_none = F.coalesce("__used", F.array().cast(dict(used.dtypes)["__used"]))
    free = F.filter(F.sequence(F.lit(1), F.col("__k") + F.size(used_or_none)), lambda i: ~F.array_contains(used_or_none, i))
    return ranked.withColumn(number, F.get(free, F.col("__k") - 1)).drop("__k", "__used")


def match_title_authors(wanted: DataFrame, books: DataFrame, title: str, authors: str, value: str) -> DataFrame:
    """(title, authors, value): the one book with this very title whose authors include all wanted ones; null if none or several.

    Null wanted authors ask for the title only; an empty name matches nobody.
    """
    w = wanted.select(title, authors).distinct().withColumn("__id", F.xxhash64(title, authors))
    hit = w.join(books.select(F.col(title), F.col(authors).alias("__have"), F.col(value)), title)
    hit = hit.where(F.col(authors).isNull() | (F.size(F.array_except(F.col(authors), F.coalesce("__have", F.array().cast("array<string>")))) == 0))
    one = hit.groupBy("__id").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return w.join(one, "__id", "left").select(title, authors, value)
