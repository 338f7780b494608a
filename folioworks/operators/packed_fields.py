"""Several values packed in one text field: one value per row, with its place.

Quoted spans, escapes and character references are replaced by indexed placeholders, the remaining
delimiters are split, the spans are restored by array lookup, and the values are exploded with
their positions. All of it is a Catalyst expression; there is no Python in the row path and no shuffle.

A placeholder is U+E000, the span's index, U+E001; the delimiters become U+E002 before the split, as a split at one
plain character needs no pattern. A text that itself holds one of these characters cannot collide with them, because
such a character is protected as a span of its own.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, CUT = "\ue000", "\ue001", "\ue002"

# Characters that separate wherever they stand, unless quoted or escaped.
SEPARATORS = ",;|\t\r\n，、；｜"
# Characters that separate only between blanks.
SPACED_SEPARATORS = "/·•"

_BLANK = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SEP = "[" + SEPARATORS.replace("|", r"\|").replace("\t", r"\t").replace("\r", r"\r").replace("\n", r"\n") + "]"
_ITEM_END = rf"(?={_BLANK}*(?:$|{_SEP}|[/·•]{_BLANK}|[\"}}\]]))"
_ITEM_START = r"(?<![^\s\u00a0\u3000,;|，、；｜/·•\[{\"])"


def _entity_pattern() -> str:
    """Named references of HTML 4 (from Python's table) and numeric ones."""
    names = sorted(set(html.entities.name2codepoint) | {"apos"}, key=lambda n: (-len(n), n))
    return r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|" + "|".join(names) + ");"




def _span(q: str) -> str:
    """A quoted span. Possessive runs, so that the matcher neither recurses nor goes back, however long the span is; where reading doubled
    quotes as one finds no end, the second form takes the first quote that ends an item."""
    run = rf"[^{q}\\]*+"
    return rf"{_ITEM_START}(?:{q}{run}(?:(?:\\.|{q}{q}){run})*+{q}{_ITEM_END}|{q}{run}(?:\\.{run})*+{q}{_ITEM_END})"


_DOUBLE, _SINGLE = _span('"'), _span("'")
_ESCAPED = r"\\[,;|/·•，、；｜\\\"'#]"
PROTECTED = "(?s)(?:" + "|".join([_DOUBLE, _SINGLE, _ESCAPED, _entity_pattern(), f"[{OPEN}{CLOSE}{CUT}]"]) + ")"
SPACED = rf"[{SPACED_SEPARATORS}](?<={_BLANK}.)(?={_BLANK})"
BETWEEN_SPANS = rf"{CLOSE}{_BLANK}++{OPEN}"
HASHTAGS = rf"{_BLANK}++(?=#)"
#: The characters of _BLANK, for trimming without a pattern.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lit_trim(c: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.btrim(c, F.lit(BLANKS))


def _unquote(span: Column) -> Column:
    body = F.substring(span, F.lit(2), F.length(span) - 2)
    backslash = lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1")
    return (
        F.when(span.startswith('"') & (F.length(span) > 1), backslash(F.replace(body, F.lit('""'), F.lit('"'))))
        .when(span.startswith("'") & (F.length(span) > 1), backslash(F.replace(body, F.lit("''"), F.lit("'"))))
        .when(span.startswith("\\"), F.substring(span, 2, 1))
        .otherwise(span)
    )


def _restore(item: Column, spans: Column) -> Column:
    """Put the spans back: every piece after the first begins with an index and CLOSE."""
    pieces = F.split(item, OPEN)
    tail = F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.concat(
            F.get(spans, F.substring_index(p, CLOSE, 1).try_cast("int")),
            F.substring(p, F.instr(p, CLOSE) + 1, F.length(p)),
        ),
    )
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))


def _tidy(items: Column) -> Column:
    """Trim, drop one leading #, trim again, and drop what is empty."""
    trimmed = F.transform(items, lit_trim)
    bare = F.transform(trimmed, lambda x: F.when(x.startswith("#"), lit_trim(F.substring(x, F.lit(2), F.length(x)))).otherwise(x))
    return F.filter(bare, lambda x: x.isNotNull() & (x != ""))


def with_packed_values(df: DataFrame, value_col: str, out: str = "items") -> DataFrame:
    """Add ``out``: the array of values packed in ``value_col``.

    A JSON list is read as JSON; ``{a,"b c"}`` is an array literal of which only commas separate; anything else is
    delimited text. Null, empty and separator-only fields give an empty array. Values repeat as they stand.
    Helper columns start with ``__pf_`` and are dropped again; other columns are untouched.
    """
    raw = F.col(f"`{value_col}`")
    df = df.withColumn("__pf_text", lit_trim(raw))
    text = F.col("__pf_text")
    df = df.withColumn("__pf_json", F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")))
    braces = text.startswith("{") & text.endswith("}")
    brackets = text.startswith("[") & text.endswith("]")
    df = df.withColumn("__pf_body", F.when(braces | brackets, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text))
    body = F.col("__pf_body")
    guarded = body.rlike(rf"[\"'\\&{OPEN}{CLOSE}{CUT}]")
    df = df.withColumn("__pf_spans", F.when(guarded, F.regexp_extract_all(body, F.lit(PROTECTED), F.lit(0))))
    has_spans = F.coalesce(F.size("__pf_spans"), F.lit(0)) > 0
    pieces = F.split(F.regexp_replace(body, PROTECTED, OPEN), OPEN)
    indexed = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), p))), "")
    df = df.withColumn("__pf_template", F.when(has_spans, indexed).otherwise(body))
    template = F.col("__pf_template")
    commas = F.translate(template, ",", CUT)
    marked = F.translate(template, SEPARATORS, CUT * len(SEPARATORS))
    marked = F.when(marked.rlike(f"[{SPACED_SEPARATORS}]"), F.regexp_replace(marked, SPACED, CUT)).otherwise(marked)
    marked = F.when(has_spans, F.regexp_replace(marked, BETWEEN_SPANS, CLOSE + CUT + OPEN)).otherwise(marked)
    marked = F.when(template.startswith("#"), F.regexp_replace(marked, HASHTAGS, CUT)).otherwise(marked)
    split = F.split(F.when(braces, commas).otherwise(marked), CUT)
    df = df.withColumn("__pf_split", split).withColumn("__pf_values", F.transform("__pf_spans", _unquote))
    restored = F.when(has_spans, F.transform("__pf_split", lambda x: _restore(x, F.col("__pf_values")))).otherwise(F.col("__pf_split"))
    df = df.withColumn(out, F.coalesce(_tidy(F.coalesce(F.col("__pf_json"), restored)), F.array().cast("array<string>")))
    return df.drop("__pf_text", "__pf_json", "__pf_body", "__pf_spans", "__pf_template", "__pf_split", "__pf_values")


def explode_packed_values(df: DataFrame, key_col: str, value_col: str, pos_name: str = "item_pos", item_name: str = "item") -> DataFrame:
    """One row per packed value: the key, the value's place counted from 1, and the value.

    The outer explode keeps Catalyst from inferring a size filter, which would evaluate the whole parse a second time below it.
    Rows without any value vanish; rows with a null key keep their values; repeated input rows give repeated output rows.
    """
    slim = df.select(F.col(f"`{key_col}`"), F.col(f"`{value_col}`"))
    arrays = with_packed_values(slim, value_col, "__items")
    return arrays.select(F.col(f"`{key_col}`"), F.posexplode_outer("__items").alias("__pos", item_name)).where(F.col(item_name).isNotNull()).select(
        F.col(f"`{key_col}`"), (F.col("__pos") + 1).cast("long").alias(pos_name), F.col(item_name)
    )
