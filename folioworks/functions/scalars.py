"""Scalar expressions: text, numbers, addresses, dates and digests. All but the two Unicode helpers stay in the JVM.

Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioworks.operators.packed_fields import lit_trim

# Digit group separators beside the comma.
GROUP_BLANKS = r"[,\s\u00a0\u202f\u2009]"
# File formats by media type, and image types by extension.
FORMAT_OF_MIME = {
    "application/epub+zip": "epub",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/pdf": "pdf",
    "application/rtf": "rtf",
    "text/rtf": "rtf",
    "text/plain": "txt",
}
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif"}
# Address suffixes that a document source claims, by source.
CLAIMS = {"docx": "docx", "pdf": "pdf", "rtf": "rtf", "text": "txt|md|markdown", "epub": "epub"}
# CSS pixels of one absolute unit.
PIXELS = {"px": 1.0, "pt": 4.0 / 3.0, "pc": 16.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "q": 96.0 / 101.6}


def format_of_mime(c: Column) -> Column:
    """The file format of a media type, parameters and case aside; an unknown one is an epub."""
    return mapped(F.lower(F.trim(F.substring_index(c, ";", 1))), FORMAT_OF_MIME, "epub")


def image_type(extension: Column) -> Column:
    """The media type of an image by its extension, with or without the dot; png where unknown."""
    return mapped(F.lower(F.regexp_replace(extension, r"^\.", "")), IMAGE_TYPES, "image/png")


@F.pandas_udf(StringType())
def nfc_casefold(s: pd.Series) -> pd.Series:
    """Composed and case-folded text: the equality of names throughout."""
    return s.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold()), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Character references resolved."""
    return s.map(html.unescape, na_action="ignore")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, "<[^>]+>", by)


def sanitize(c: Column) -> Column:
    """Tags away first, then character references resolved, then white space of any kind trimmed at the ends."""
    return lit_trim(html_unescape(strip_tags(c)))


def plain_excerpt(c: Column, limit: int) -> Column:
    """Tags become blanks, white space is collapsed, and a longer text is cut at its last blank within the limit, with an ellipsis.

    Without a blank within the limit the text is cut at the limit. Empty results are null.
    """
    text = F.trim(F.regexp_replace(strip_tags(c, " "), r"[ \t\r\n]+", " "))
    head = F.substring(text, 1, limit)
    at_blank = F.regexp_replace(head, " [^ ]*$", "")
    cut = F.when(F.instr(head, " ") > 1, at_blank).otherwise(head)
    return F.nullif(F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…"))), F.lit(""))


def int_or_null(c: Column) -> Column:
    """A whole number whose digits may be grouped by commas or blanks of several kinds."""
    return F.regexp_replace(c, GROUP_BLANKS, "").try_cast("bigint")


def int_list(c: Column) -> Column:
    """The whole numbers of a comma list; other elements are left out. Null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("bigint"))
    return F.filter(parts, lambda x: x.isNotNull())


def string_list(c: Column) -> Column:
    """The non-blank elements of a comma list, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def slug_title(c: Column) -> Column:
    """'long-way home' -> 'Long Way Home'."""
    return F.initcap(F.replace(c, F.lit("-"), F.lit(" ")))


def number_text(c: Column) -> Column:
    """2.0 -> '2', 2.5 -> '2.5'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def identifier(c: Column, scheme: str) -> Column:
    """The first non-blank value behind 'scheme:' in a comma list of identifiers; schemes are compared without case and blanks, later
    colons belong to the value."""
    return blank_to_null(F.regexp_extract(c, rf"(?i)(?:^|,)\s*{scheme}\s*:\s*([^,\s][^,]*)", 1))


def isbn13(c: Column) -> Column:
    """A valid ISBN-13, or the ISBN-13 of a valid ISBN-10, else null."""
    bare = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    digit = lambda s, i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.substring(s, i, 1).try_cast("int"))
    total13 = sum((digit(bare, i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    total10 = sum((digit(bare, i) * (11 - i) for i in range(1, 11)), F.lit(0))
    body = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    check = (10 - sum((digit(body, i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0)) % 10) % 10
    return F.when(bare.rlike("^97[89][0-9]{10}$") & (total13 % 10 == 0), bare).when(
        bare.rlike("^[0-9]{9}[0-9X]$") & (total10 % 11 == 0), F.concat(body, check.cast("string"))
    )


def star_tag(rating: Column) -> Column:
    """3 -> '★★★☆☆'; outside 1 to 5 null."""
    return F.when(rating.between(1, 5), F.concat(F.repeat(F.lit("★"), rating.cast("int")), F.repeat(F.lit("☆"), (5 - rating).cast("int"))))


def rating_of_tag(tag: Column) -> Column:
    """The rating, 0 to 5, of a star tag (five stars in all, or one to five full ones alone) or of the older 'rating:n'; else null."""
    full = F.length(F.regexp_replace(tag, "☆", ""))
    stars = tag.rlike("^★*☆*$") & ((F.length(tag) == 5) | ((F.length(tag).between(1, 4)) & (full == F.length(tag))))
    old = F.trim(F.substring(tag, F.lit(8), F.length(tag))).try_cast("int")
    return F.when(tag.startswith("rating:"), F.when(old.between(0, 5), old)).when(stars, full)


def is_rating_like(tag: Column) -> Column:
    """Whether the rating machinery owns a tag: any 'rating:' tag, readable or not, and the star forms."""
    return tag.startswith("rating:") | rating_of_tag(tag).isNotNull()


def rating_of_tags(tags: Column) -> Column:
    """The first readable rating of a tag list; null without one."""
    return F.get(F.filter(F.transform(tags, rating_of_tag), lambda r: r.isNotNull()), F.lit(0))


def split_csv(c: Column) -> Column:
    """The non-empty parts of a field joined by ', '; null gives an empty list."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ", "), lambda x: x != "")


def mdy_date(c: Column) -> Column:
    """Month/day/year with one or two digits; else null."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")


def basename(c: Column) -> Column:
    return F.nullif(F.element_at(F.split(F.regexp_replace(c, r"[?#].*$", ""), "/"), -1), F.lit(""))


def canonical_url(c: Column) -> Column:
    """Our own address identity: lower host, without scheme, www., fragment and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), "/+$", "")
    return F.nullif(F.concat(host, rest), F.lit(""))


def url_query(c: Column, key: str) -> Column:
    """The decoded value of a query key; the first one counts."""
    return F.try_url_decode(F.nullif(F.regexp_extract(c, rf"[?&]{key}=([^&#]*)", 1), F.lit("")))


def unknown_keys(c: Column, known: list[str]) -> Column:
    """Query keys outside the known ones, distinct and sorted."""
    pairs = F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&")
    keys = F.filter(F.transform(pairs, lambda p: F.try_url_decode(F.substring_index(p, "=", 1))), lambda k: k.isNotNull() & (k != ""))
    return F.array_sort(F.array_except(F.array_distinct(keys), F.array(*[F.lit(k) for k in known])))


def api_url(base: str, params: Column) -> Column:
    """An address whose 'params' is compact JSON, percent-encoded with %20 for a blank and the slash kept."""
    return F.concat(F.lit(base + "?params="), F.replace(F.replace(F.url_encode(F.to_json(params)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def download_name(disposition: Column, *urls: Column) -> Column:
    """A file name from the header, else from an address's path, else 'book', always with .epub."""
    named = F.nullif(F.regexp_extract(disposition, r'filename="?([^";]+)"?', 1), F.lit(""))
    paths = [F.try_url_decode(basename(F.regexp_replace(u, r"^[^/]*//[^/]*", ""))) for u in urls]
    stem = F.regexp_replace(F.coalesce(named, *paths, F.lit("book")), r"(?i)\.epub$", "")
    return F.concat(stem, F.lit(".epub"))


def claiming_source(url: Column) -> Column:
    """Which source reads an address: by path suffix, else the catch-all for web addresses, else null."""
    out = None
    for name, suffix in CLAIMS.items():
        hit = url.rlike(rf"(?i)^[^:/?#]+://[^/?#]*/[^?#]*\.(?:{suffix})(?:[?#]|$)")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(url.rlike("(?i)^https?://"), "any")


def mapped(key: Column, pairs: dict, default: object = None) -> Column:
    """Lookup in a small fixed table."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def pixels(value: Column, unit: Column) -> Column:
    """A CSS length in pixels; null for relative units."""
    return value * mapped(F.lower(unit), PIXELS)


def to_em(value: Column, unit: Column, base_px: float, least: float = 0.4, most: float = 4.0) -> Column:
    """An absolute length in em, clamped, with three decimals (half to even) and no trailing zeros; null for relative units."""
    px = pixels(value, unit)
    em = F.bround(F.greatest(F.lit(least), F.least(F.lit(most), px / base_px)), 3)
    return F.when(px.isNotNull(), F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", em), "0+$", ""), r"\.$", ""), F.lit("em")))


def options_signature(version: str, flags: Column) -> Column:
    """Twelve hex digits of the SHA-256 of a version and flag bits."""
    return F.substring(F.sha2(F.concat(F.lit(version + ":"), flags), 256), 1, 12)


def release_id(tag: Column) -> Column:
    """What stands before the last hyphen."""
    return F.nullif(F.regexp_extract(tag, "^(.*)-", 1), F.lit(""))


def bump_patch(version: Column) -> Column:
    """1.4.0 -> 1.4.1; other shapes null."""
    p = lambda i: F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", i)
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.concat(p(1), F.lit("."), p(2), F.lit("."), (p(3).try_cast("bigint") + 1).cast("string")))


def exact_version(requirement: Column) -> Column:
    """The version of one exact pin without a wildcard; else null."""
    return F.nullif(F.regexp_extract(requirement, r"^[A-Za-z0-9._\[\]-]+\s*==\s*([A-Za-z0-9.!+_-]+)\s*(?:;.*)?$", 1), F.lit(""))


def opening_words(c: Column, n: int) -> Column:
    words = F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def chapter_number(label: Column) -> Column:
    """Our own chapter numbers: the first of '3', '3a' or '3-5' in a label, as struct(number, end, letter); null without one.

    They order 3 < 3a < 3-5 < 4.
    """
    pattern = r"(\d{1,6})(?:\s*[-–]\s*(\d{1,6})|([a-z])\b)?"
    p = lambda i: F.nullif(F.regexp_extract(F.lower(label), pattern, i), F.lit(""))
    n = p(1).try_cast("int")
    return F.when(n.isNotNull(), F.struct(n.alias("number"), F.coalesce(p(2).try_cast("int"), F.lit(0)).alias("range_end"), F.coalesce(p(3), F.lit("")).alias("letter")))


def float_or_null(c: Column) -> Column:
    """A number with blanks around it; else null."""
    return F.trim(c).try_cast("double")


def real_instant(c: Column) -> Column:
    """A time stamp's text, null where it is of the year 1, which stands for never."""
    return F.when(~c.startswith("0001-01-01"), c)


def display_title(record: Column, other: Column) -> Column:
    """The record's title as it stands unless blank, else the other one unless blank, else ''."""
    return F.when(blank_to_null(record).isNotNull(), record).when(blank_to_null(other).isNotNull(), other).otherwise(F.lit(""))


def tag_keys(setting: Column, default: list[str], never: list[str]) -> Column:
    """The names of a comma list, trimmed, without empty ones and those that are never tags; null gives the default."""
    names = F.filter(F.transform(F.split(setting, ","), lambda x: F.trim(x)), lambda n: (n != "") & ~n.isin(*never))
    return F.when(setting.isNull(), F.array(*[F.lit(d) for d in default])).otherwise(names)


def listed(words: Column) -> Column:
    """'a', 'a and b', 'a, b and c'; '' for none."""
    n = F.size(words)
    return F.when(n > 1, F.concat(F.array_join(F.slice(words, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(words, -1))).otherwise(F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def line_numbers(numbers: Column) -> Column:
    """'line 2', 'lines 2 and 3'."""
    return F.concat(F.when(F.size(numbers) == 1, "line ").otherwise("lines "), listed(F.transform(numbers, lambda x: x.cast("string"))))


def whole_or_zero(setting: Column) -> Column:
    """A setting's whole number, 0 where it has none or a negative one."""
    return F.greatest(F.coalesce(F.trim(setting).try_cast("int"), F.lit(0)), F.lit(0))


def meets(field: Column, custom: Column, name: str, least: float) -> Column:
    """A threshold on a field, else on the custom map (of VARIANT) where the field is missing: numbers and booleans count, texts never do."""
    held = F.try_element_at(custom, F.lit(name))
    kind = F.schema_of_variant(held)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(held, "$", "int").cast("double")).when(kind != "STRING", F.try_variant_get(held, "$", "double"))
    return F.coalesce(F.coalesce(field.cast("double"), number) >= least, F.lit(False))
