"""Planning one book out of several: order of chapters, metadata, ids and files, landmarks, stylesheets, and checks before anything is written.

All tables are keyed by a group (the merge); ``book_index`` 0 is the survivor. Plans are tables, so a check is a query over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import scalars as S
from folioworks.operators.relational import nfc

# Manifest ids that are no chapters.
NON_CHAPTER_IDS = ["cover", "nav", "toc", "titlepage", "title-page", "title_page"]


def flattened(chapters: DataFrame, group: str, book_index: str, pos: str) -> DataFrame:
    """Add ``place``: the chapters of all books of a group in the order of the books, from 1."""
    return chapters.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(book_index, pos)))


def chapter_label(navigation: Column, own_title: Column, file: Column) -> Column:
    """The navigation's label, else the chapter's own title, else its file's name without ending; blank ones do not count."""
    return F.coalesce(S.blank_to_null(navigation), S.blank_to_null(own_title), F.regexp_replace(S.basename(file), r"(?<=.)\.[^.]*$", ""))


def with_implied_first(candidates: DataFrame, group: str, title: str, first: str, least: str) -> DataFrame:
    """Give part 1 to a candidate without a number whose title is the work name of a numbered one of its group: that title without its
    number and part word. Not where another one already is part 1."""
    work = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s,:\-–—]*(?:\b(?:part|pt|chapter|ch|book|vol)\b\.?\s*)?#?\d+\s*$", ""))
    numbered = candidates.where(F.col(least).isNotNull())
    names = numbered.select(F.col(group).alias("__g"), work(F.col(title)).alias("__w"), (F.col(least) == 1).alias("__one")).groupBy("__g", "__w").agg(F.bool_or("__one").alias("__taken"))
    j = candidates.join(names, (F.col(group) == F.col("__g")) & (F.trim(F.lower(title)) == F.col("__w")), "left")
    implied = F.col(first).isNull() & F.col(least).isNull() & (~F.col("__taken"))
    return j.withColumns({first: F.when(implied, 1).otherwise(F.col(first)), least: F.when(implied, 1).otherwise(F.col(least))}).drop("__g", "__w", "__taken")


# ---- metadata of the merged book ----


def merged_metadata(books: DataFrame, group: str, pos: str, override: dict[str, Column]) -> DataFrame:
    """One row a group: language, direction, publisher, description, version.

    ``books`` has the columns language, direction, publisher, title, description, version; the survivor is the first by ``pos``.
    language: the override, else the only one declared, else the survivor's, else 'en'. direction: the only one declared, else null.
    publisher: the override, else the survivor's. description: the override, else one line a book in order. version: 3.0 if any book is of
    version 3, else 2.0. Blank values are none. ``override`` gives aggregate expressions or literals.
    """
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    only = lambda c: F.when(F.min(value(c)) == F.max(value(c)), F.min(value(c)))
    survivor = lambda c: F.min(F.struct(F.col(pos).alias("p"), value(c).alias("v")))["v"]
    given = lambda n: value(override[n]) if n in override else F.lit(None).cast("string")
    line = F.when(value("description").isNotNull(), F.concat(value("title"), F.lit(": "), value("description")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(pos).alias("p"), line.alias("l"))))), lambda x: x["l"]), "\n")
    return books.groupBy(group).agg(
        F.coalesce(given("language"), only("language"), survivor("language"), F.lit("en")).alias("language"),
        only("direction").alias("direction"),
        F.coalesce(given("publisher"), survivor("publisher")).alias("publisher"),
        F.coalesce(given("description"), F.nullif(lines, F.lit(""))).alias("description"),
        F.when(F.bool_or(F.coalesce(F.col("version").startswith("3"), F.lit(False))), "3.0").otherwise("2.0").alias("version"),
    )


def chosen_cover(given: Column, survivor: Column) -> Column:
    """struct(path, from): a given cover, else the survivor's, else none."""
    g, s = S.blank_to_null(given), S.blank_to_null(survivor)
    return F.struct(F.coalesce(g, s).alias("path"), F.when(g.isNotNull(), "given").when(s.isNotNull(), "survivor").otherwise("none").alias("source"))


def xml_text(c: Column) -> Column:
    """Text as it may stand between tags."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def title_page(title: Column, creators: Column, subjects: Column, language: Column, stylesheets: Column) -> Column:
    """An XHTML title page; creators and subjects are lists and left out where empty."""
    links = F.array_join(F.transform(stylesheets, lambda s: F.concat(F.lit('<link rel="stylesheet" type="text/css" href="'), xml_text(s), F.lit('"/>'))), "")
    block = lambda name, values: F.when(F.size(values) > 0, F.concat(F.lit(f'<p class="{name}">'), F.array_join(F.transform(values, xml_text), ", "), F.lit("</p>"))).otherwise("")
    return F.concat(
        F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), xml_text(language), F.lit('"><head><title>'), xml_text(title), F.lit("</title>"), links, F.lit("</head><body><h1>"), xml_text(title), F.lit("</h1>"),
        block("creators", creators), block("subjects", subjects), F.lit("</body></html>"),
    )


def cover_page(image: Column) -> Column:
    return F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>Cover</title></head><body><img alt="Cover" src="'), xml_text(image), F.lit('"/></body></html>'))


# ---- ids, files, landmarks ----


def resource_ids(paths: DataFrame, group: str, path: str, order: str) -> DataFrame:
    """Add ``item_id``: a valid XML name from the path, unique in its group: the first path of a name has it bare, the k-th with _k behind it. A
    name that already ends so is told apart by two underscores, so that none is given twice."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(nfc(F.col(path))), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(slug == "", "resource").when(slug.rlike("^[0-9]"), F.concat(F.lit("_"), slug)).otherwise(slug)
    p = paths.withColumn("__s", slug)
    no = F.row_number().over(Window.partitionBy(group, "__s").orderBy(order))
    return p.withColumn("__n", no).withColumn("item_id", F.when(F.col("__n") == 1, F.col("__s")).otherwise(F.concat("__s", F.lit("_"), "__n"))).drop("__s", "__n")


def content_properties(xhtml: Column) -> Column:
    """What a chapter's manifest entry has to declare, in order: mathml, scripted, svg; '' for none."""
    has = lambda tag: xhtml.rlike(rf"(?i)<(?:\w+:)?{tag}(?=[\s/>])")
    return F.array_join(F.filter(F.array(F.when(has("math"), "mathml"), F.when(has("script"), "scripted"), F.when(has("svg"), "svg")), lambda x: x.isNotNull()), " ")


def landmarks(chapters: DataFrame, group: str, pos: str, item_id: str, is_title: Column, file: str, covers: DataFrame, cover: str) -> DataFrame:
    """Landmarks in order: group, place, kind, label, target. The cover and the title page where there are any, the contents always, and the first
    chapter that is neither a title page nor one of the ids that are no chapters."""
    title = F.coalesce(is_title, F.lit(False))
    story = ~title & ~F.coalesce(F.lower(item_id).isin(*NON_CHAPTER_IDS), F.lit(False))
    first = lambda ok: F.min(F.when(ok, F.struct(pos, file)))[file]
    g = chapters.groupBy(group).agg(first(title).alias("__t"), first(story).alias("__s")).join(covers.select(group, F.col(cover).alias("__c")), group, "left")
    rows = [("cover", "Cover", F.nullif("__c", F.lit(""))), ("titlepage", "Title Page", F.col("__t")), ("toc", "Table of Contents", F.lit("#toc")), ("bodymatter", "Start of Content", F.col("__s"))]
    made = F.array(*[F.when(t.isNotNull(), F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.lit(n).alias("label"), t.alias("target"))) for i, (k, n, t) in enumerate(rows, 1)])
    return g.select(group, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("r")).select(group, "r.place", "r.kind", "r.label", "r.target")


def relinked_stylesheets(xhtml: Column, stylesheets: Column, is_survivor: Column) -> Column:
    """Point a chapter's stylesheet links at the survivor's: the first link makes room for all of them, the others go. Without stylesheets the
    links go; a chapter without a link, and the survivor's own, stay as they are."""
    link = r"(?i)<link\b(?=[^<>]*\brel\s*=\s*[\"']?stylesheet)[^<>]*>"
    new = F.array_join(F.transform(stylesheets, lambda s: F.concat(F.lit('<link rel="stylesheet" type="text/css" href="'), xml_text(s), F.lit('"/>'))), "")
    at = F.regexp_instr(xhtml, F.lit(link))
    bare = F.regexp_replace(xhtml, link, "")
    return F.when(is_survivor | (at == 0), xhtml).otherwise(F.concat(F.substring(xhtml, F.lit(1), at - 1), new, F.substring(bare, at, F.length(bare))))


# ---- checks ----


def too_few(plan: DataFrame, expected: DataFrame, group: str, item_id: str, count: str) -> DataFrame:
    """Groups whose plan has fewer chapters than expected, title pages and the like aside: check_name, detail."""
    chapters = plan.where(~F.coalesce(F.lower(item_id).isin(*NON_CHAPTER_IDS), F.lit(False))).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    j = expected.select(group, F.col(count).alias("__e")).join(chapters, group, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    return j.where("__n < __e").select(F.lit("chapters").alias("check_name"), F.concat(F.col(group).cast("string"), F.lit(": "), "__n", F.lit(" of "), "__e").alias("detail"))


def flat_contents(entries: DataFrame, group: str, node: str, parent: str, pos: str, depth: int = 6) -> DataFrame:
    """A nested table of contents in reading order: group, node, level (from 1), path (the places from the top down), place. Each level is one join on
    the parent; entries deeper than ``depth`` or on a circle have no row, see ``depth``."""
    top = entries.where(F.col(parent).isNull()).select(group, node, F.lit(1).alias("level"), F.array(F.col(pos)).alias("path"))
    out = level = top
    for n in range(2, depth + 1):
        below = entries.where(F.col(parent).isNotNull()).select(F.col(group), F.col(node), F.col(parent).alias("__p"), F.col(pos).alias("__pos"))
        up = level.select(F.col(group).alias("__g"), F.col(node).alias("__p2"), F.col("path").alias("__path"))
        level = below.join(up, (below[group] == F.col("__g")) & (F.col("__p") == F.col("__p2"))).select(group, node, F.lit(n).alias("level"), F.concat("__path", F.array("__pos")).alias("path"))
        out = out.unionByName(level)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("path")))


# ---- pages of extracted text ----


def page_lines(spans: DataFrame, doc: str, drop_digits: bool = True) -> DataFrame:
    """Lines in reading order out of spans (doc, page, y, x, size, text): doc, page, y, size (the largest), text (spans from left to right), place. Blank
    lines fall away, and with ``drop_digits`` those of digits only, which are page numbers."""
    lines = spans.groupBy(doc, "page", "y").agg(F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), "").alias("text"))
    lines = lines.withColumn("text", F.trim("text")).where("text <> ''")
    if drop_digits:
        lines = lines.where(~F.col("text").rlike(r"^\p{Nd}+$"))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("page", "y")))


def headings(lines: DataFrame, spans: DataFrame, doc: str, factor: float = 1.3, default: float = 11.0, most: int = 80) -> DataFrame:
    """Lines that are headings, by size: at least ``factor`` times the document's median span size, and shorter than ``most`` characters; with ``end_page``, the
    page of the next heading or null. Two headings on one page leave the first an empty range."""
    body = spans.groupBy(doc).agg(F.coalesce(F.median("size"), F.lit(default)).alias("__m"))
    h = lines.join(body, doc).where((F.col("size") >= F.col("__m") * factor) & (F.length("text") < most)).drop("__m")
    return h.withColumn("end_page", F.lead("page").over(Window.partitionBy(doc).orderBy("page", "y")))


def document_title(given: Column, info: Column, first_line: Column, stem: Column) -> Column:
    """A document's title: the one given, else its own unless that is 'untitled', else its first line, else the file's stem."""
    own = S.blank_to_null(info)
    return F.coalesce(S.blank_to_null(given), F.when(F.lower(own) != "untitled", own), S.blank_to_null(first_line), stem)


# ---- option text ----

_OPTION = r"^([A-Za-z0-9_][^:=\[\]#;]*?)\s*[:=]"


def option_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Option lines of ini text: key, line (from 1), option (lower case). Comments, sections and continuation lines are none."""
    rows = df.select(key, F.posexplode_outer(F.split(text, r"\r?\n")).alias("__p", "__l"))
    rows = rows.select(key, (F.col("__p") + 1).alias("line"), F.lower(F.regexp_extract("__l", _OPTION, 1)).alias("option"))
    return rows.where("option <> ''")


def without_options(text: Column, dropped: list[str]) -> Column:
    """Ini text without the lines of these options and the indented lines behind them."""
    lines = F.split(text, r"\r?\n")
    option = lambda l: F.lower(F.regexp_extract(l, _OPTION, 1))
    more = lambda l: l.rlike(r"^[ \t]+\S")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("off"))
    step = lambda acc, l: F.when(acc["off"] & more(l), acc).when(option(l).isin(*dropped), F.struct(acc["kept"].alias("kept"), F.lit(True).alias("off"))).otherwise(F.struct(F.concat(acc["kept"], F.array(l)).alias("kept"), F.lit(False).alias("off")))
    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["kept"], "\n"))


def option_problems(df: DataFrame, key: str, text: str, sign_in: list[str], owned: list[str]) -> DataFrame:
    """What is wrong with option text, naming lines and never their content: key, blocking, message."""
    lines = option_lines(df, key, text)
    numbers = lambda keys: F.array_sort(F.collect_list(F.when(F.col("option").isin(*keys), F.col("line"))))
    names = F.array_sort(F.collect_set(F.when(F.col("option").isin(*owned), F.col("option"))))
    g = lines.groupBy(key).agg(numbers(sign_in).alias("__s"), numbers(owned).alias("__o"), names.alias("__n"))
    sign = F.when(F.size("__s") > 0, F.struct(F.lit(True).alias("blocking"), F.concat(S.line_numbers(F.col("__s")), F.lit(": sign-ins do not belong here")).alias("message")))
    over = F.when(F.size("__o") > 0, F.struct(F.lit(False).alias("blocking"), F.concat(S.line_numbers(F.col("__o")), F.lit(": "), S.listed(F.col("__n")), F.when(F.size("__n") == 1, " is").otherwise(" are"), F.lit(" set elsewhere")).alias("message")))
    return g.select(key, F.explode(F.filter(F.array(sign, over), lambda x: x.isNotNull())).alias("p")).select(key, "p.blocking", "p.message")


# ---- locked packages ----


def newest_uploads(packages: DataFrame, name: str, files: str) -> DataFrame:
    """The newest upload of each package over all of its files (an array of struct(upload_time)): name, newest."""
    return packages.select(name, F.explode_outer(files).alias("__f")).groupBy(name).agg(F.max("__f.upload_time").alias("newest"))


def fresh(uploads: DataFrame, newest: str, cutoff: Column) -> DataFrame:
    """Packages whose newest upload is after the cutoff; an unknown one is not."""
    return uploads.where(F.col(newest) > cutoff)


def pin_problems(pins: DataFrame, group: DataFrame, name: str, version: str) -> DataFrame:
    """Pins the development group lacks or holds otherwise: name, problem. Names are compared by lower case with runs of - _ . as one hyphen."""
    norm = lambda c: F.regexp_replace(F.lower(c), r"[-_.]+", "-")
    p = pins.select(norm(F.col(name)).alias("name"), F.col(version).alias("__v")).distinct()
    g = group.select(norm(F.col(name)).alias("name"), F.col(version).alias("__w")).distinct()
    j = p.join(g, "name", "left")
    return j.where(~F.col("__v").eqNullSafe(F.col("__w"))).select("name", F.when(F.col("__w").isNull(), "missing").otherwise("different").alias("problem")).distinct()
