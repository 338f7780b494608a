"""Markup as data: start tags, a tag census, style rules and the decision for each declaration, small text rewrites."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TAG = r"<([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)>"


def start_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per start tag: key, tag_pos (from 1), tag (lower case), attrs (the raw attribute text)."""
    found = F.regexp_extract_all(F.col(text), F.lit(_TAG), F.lit(0))
    rows = df.select(key, F.posexplode_outer(found).alias("__p", "__t")).where("__t IS NOT NULL")
    return rows.select(key, (F.col("__p") + 1).alias("tag_pos"), F.lower(F.regexp_extract("__t", _TAG, 1)).alias("tag"), F.trim(F.regexp_extract("__t", _TAG, 2)).alias("attrs"))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare; null without it."""
    pattern = rf"(?i)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.coalesce(*[F.nullif(F.regexp_extract(attrs, pattern, i), F.lit("")) for i in (1, 2, 3)])


def tag_census(tags: DataFrame) -> DataFrame:
    """How often each (tag, set of classes, id) occurs; classes in order, joined by a blank."""
    names = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(attribute(F.col("attrs"), "class"), F.lit("")), r"\s+"), lambda x: x != "")))
    keyed = tags.select("tag", F.array_join(names, " ").alias("classes"), F.coalesce(attribute(F.col("attrs"), "id"), F.lit("")).alias("element_id"))
    return keyed.groupBy("tag", "classes", "element_id").agg(F.count(F.lit(1)).alias("n"))


def names_only_on(tags: DataFrame, name: Column, roots: list[str]) -> DataFrame:
    """Names that root elements use and no other element does."""
    named = tags.select(name.alias("name"), F.col("tag").isin(*roots).alias("root")).where("name IS NOT NULL")
    return named.groupBy("name").agg(F.bool_and("root").alias("only")).where("only").select("name")


def mark_blank_paragraphs(text: Column) -> Column:
    """Empty paragraphs get class="blank"."""
    return F.regexp_replace(text, r"(?i)<p>(?:\s|&nbsp;|&#160;|\u00a0|<br\s*/?>)*</p>", '<p class="blank"></p>')


def blank_paragraphs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)<p>(?:\s|&nbsp;|&#160;|\u00a0|<br\s*/?>)*</p>"))


def read_marker(text: Column) -> Column:
    """The signature in a leading marker comment, else null."""
    return F.nullif(F.regexp_extract(text, r"^/\* folioworks:([0-9a-f]{12}) \*/", 1), F.lit(""))


def strip_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"^/\* folioworks:[0-9a-f]{12} \*/\n?", "")


def stamp(text: Column, signature: Column) -> Column:
    """The text with exactly one marker; stamping twice changes nothing."""
    return F.concat(F.lit("/* folioworks:"), signature, F.lit(" */\n"), strip_marker(text))


def unreferenced(names: DataFrame, corpus: DataFrame, group: str, name: str, key: str, text: str) -> DataFrame:
    """Names no text of their group holds, without regard to case; every name is looked for whole, and within longer words too.

    Eight characters of each name, of its pieces of eight the one that is rarest among the names, are its anchor; the texts' distinct windows of
    eight characters meet the anchors by equality of a hash, and only then is the whole name looked for. So no name is held against every text.
    Names under eight characters have an anchor of four, those under four are their own; the texts have windows of the sizes that occur. A blank
    name is held by any text. Every side grows with the data, so the joins are merged: file sizes tell nothing of the number of windows.
    """
    tier = lambda c: F.when(F.length(c) >= 8, 8).when(F.length(c) >= 4, 4).otherwise(F.length(c))
    windows = lambda c, size: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) if size else F.array(F.lit(""))
    hashed = lambda w: F.xxhash64("__g", w)
    n = names.where(F.col(group).isNotNull() & F.col(name).isNotNull()).select(F.col(group).alias("__g"), F.lower(name).alias("__n"))
    sizes = sorted(r[0] for r in n.select(tier(F.col("__n"))).distinct().collect())  # at most 0 to 4 and 8
    pieces = lambda size: F.filter(windows(F.col("__n"), size), lambda w, i: (i % max(size, 1) == 0) | (i == F.length("__n") - size))
    chosen = F.coalesce(*[F.when(tier(F.col("__n")) == s, pieces(s)) for s in sizes], F.array().cast("array<string>"))
    blocks = n.distinct().select("__g", "__n", F.explode(F.array_distinct(chosen)).alias("__w")).select("__g", "__n", hashed("__w").alias("__h"))
    counted = blocks.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("__h")))
    anchors = counted.groupBy("__g", "__n").agg(F.min(F.struct("__c", "__h"))["__h"].alias("__h"))
    texts = corpus.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.lower(text).alias("__t"))
    every = F.concat(F.array().cast("array<string>"), *[F.array_distinct(windows(F.col("__t"), s)) for s in sizes])
    seen = texts.select("__g", "__k", F.explode(every).alias("__w")).select("__k", hashed("__w").alias("__h")).join(anchors.hint("merge"), "__h").select("__g", "__k", "__n")
    whole = texts.select(F.col("__g").alias("__tg"), F.col("__k").alias("__tk"), "__t").hint("merge")
    held = seen.join(whole, (F.col("__g") == F.col("__tg")) & F.col("__k").eqNullSafe(F.col("__tk"))).where(F.contains("__t", F.col("__n"))).select("__g", "__n").distinct()
    return names.join(held, (names[group] == F.col("__g")) & (F.lower(names[name]) == F.col("__n")), "left_anti")


def repoint_links(chapters: DataFrame, mapping: DataFrame, book: str, chapter: str, text: str, old: str, new: str) -> DataFrame:
    """Rewrite href targets by a per-book table; other links stay. Fragments are kept."""
    table = mapping.groupBy(book).agg(F.map_from_entries(F.collect_set(F.struct(old, new))).alias("__map"))
    cut = r"(href=\"[^\"#]*)"
    joined = chapters.join(table, book, "left")
    parts = F.split(F.regexp_replace(F.col(text), cut, "\u0001$1\u0002"), "\u0001")
    fixed = F.transform(
        parts,
        lambda p: F.when(p.startswith('href="') & p.contains("\u0002"), F.concat(F.lit('href="'), F.coalesce(F.try_element_at(F.col("__map"), F.substring_index(F.substring(p, F.lit(7), F.length(p)), "\u0002", 1)), F.substring_index(F.substring(p, F.lit(7), F.length(p)), "\u0002", 1)), F.substring_index(p, "\u0002", -1))).otherwise(p),
    )
    return joined.select(book, chapter, F.array_join(fixed, "").alias(text))


def size_pools(df: DataFrame, book: str, pos: str, size: str, weight: str, tolerance: float = 0.01) -> DataFrame:
    """Sizes of a book pooled with the first earlier size within the tolerance, in order of appearance: book, size, weight.

    The relation is not transitive and depends on the order, so each book's distinct sizes are walked in order, once: pools are held in bins as
    wide as the tolerance, and only the three bins around a size can hold its pool.
    """

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes: list[float] = []
        weights: list[int] = []
        bins: dict[int, list[int]] = {}
        ordered = pdf.sort_values([pos, size])
        for s, w in zip(ordered[size], ordered[weight]):
            k = int(s // tolerance) if tolerance > 0 else hash(s)
            near = [i for b in (k - 1, k, k + 1) for i in bins.get(b, ()) if abs(sizes[i] - s) <= tolerance]
            if near:
                weights[min(near)] += int(w)
            else:
                bins.setdefault(k, []).append(len(sizes))
                sizes.append(float(s))
                weights.append(int(w))
        return pd.DataFrame({book: pdf[book].iloc[0], size: sizes, weight: weights})

    kind = dict(df.dtypes)[book]
    few = df.where(F.col(size).isNotNull()).groupBy(book, size).agg(F.min(pos).alias(pos), F.sum(weight).alias(weight))
    return few.groupBy(book).applyInPandas(pool, f"{book} {kind}, {size} double, {weight} long")


def well_formed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and whether the text parses as XML."""
    from xml.etree import ElementTree

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok = []
            for t in pdf[text]:
                try:
                    ElementTree.fromstring(f"<r>{t}</r>" if t is not None else "<")
                    ok.append(True)
                except ElementTree.ParseError:
                    ok.append(False)
            yield pd.DataFrame({key: pdf[key], "well_formed": ok})

    return df.select(key, text).mapInPandas(check, f"{key} {dict(df.dtypes)[key]}, well_formed boolean")
