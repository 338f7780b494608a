"""Deeply nested records into related flat tables that keep parent and child apart and in order.

A payload is parsed once into a VARIANT. Nested ``transform`` calls over its arrays attach the ancestor's key and the
element's index, ``flatten`` combines the arrays of arrays, and one ``inline`` per target table emits the rows.
Everything is a Catalyst expression; the only shuffle is the final distinct.

Defined results: a payload that is null, empty, damaged or not one whole JSON document gives no row; a byte-order mark
is skipped and a document held in a JSON string is unwrapped; one object stands for a list of one; elements that are
null count as places; a null, missing or non-scalar key gives no row, and so do the children of a parent without a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTINEL = "folioworks: whole document"
_CHILD = "struct<parent_key: string, child_kind: string, child_pos: bigint, child_key: string>"


def parse_payload(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the parsed payload as VARIANT, or null where it is not one whole JSON document.

    The JSON parser stops at the end of the first value. Framing the text as the first of two list elements makes
    whatever follows that value visible: the list then fails to parse or has another size. Of a repeated member name the last one
    counts; the session is told so, as the parser else refuses the document. Documents beyond the size of a VARIANT (16 MiB,
    128 MiB in later releases) read as null; ``payload_status`` counts them.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bare = f"regexp_replace(`{text_col}`, '^[\\\\s]*\ufeff?[\\\\s]*', '')"
    df = df.withColumn("__nr_text", F.expr(bare))
    inner = f"from_json(concat('[', __nr_text, ',\"{_SENTINEL}\"]'), 'array<string>')"
    # A JSON string holds the document one level deeper; it may carry a byte-order mark of its own.
    df = df.withColumn(
        "__nr_doc",
        F.expr(f"CASE WHEN startswith(__nr_text, '\"') THEN CASE WHEN size({inner}) = 2 THEN regexp_replace({inner}[0], '^[\\\\s]*\ufeff?[\\\\s]*', '') END ELSE __nr_text END"),
    )
    framed = f"try_variant_get(try_parse_json(concat('[', __nr_doc, ',\"{_SENTINEL}\"]')), '$', 'array<variant>')"
    df = df.withColumn("__nr_framed", F.expr(framed))
    df = df.withColumn(out, F.expr("CASE WHEN size(__nr_framed) = 2 THEN __nr_framed[0] END"))
    return df.drop("__nr_text", "__nr_doc", "__nr_framed")


def many(value: str) -> str:
    """SQL: a list as it stands, one object as a list of one, else null."""
    return (
        f"coalesce(try_variant_get({value}, '$', 'array<variant>'), "
        f"CASE WHEN try_variant_get({value}, '$', 'map<string,variant>') IS NOT NULL THEN array({value}) END)"
    )


def scalar(value: str, path: str = "$") -> str:
    """SQL: the scalar at ``path`` as text; null for objects and lists."""
    at = f"try_variant_get({value}, '{path}', 'variant')"
    return (
        f"CASE WHEN try_variant_get({at}, '$', 'array<variant>') IS NULL AND try_variant_get({at}, '$', 'map<string,variant>') IS NULL "
        f"THEN try_variant_get({at}, '$', 'string') END"
    )


def _at(value: str, path: str) -> str:
    return f"try_variant_get({value}, '{path}', 'variant')"


def _child(parent: str, kind: str, pos: str, key: str) -> str:
    return f"CAST(struct({parent} AS parent_key, '{kind}' AS child_kind, {pos} AS child_pos, {key} AS child_key) AS {_CHILD})"


def _one(records: str, kind: str, path: str) -> str:
    """Rows for a single member of each record."""
    return f"transform({records}, r -> {_child('r.rec_key', kind, '1L', scalar('r.rec', path))})"


def _nested(records: str, kind: str, path: str, key: str) -> str:
    """Rows for the elements of a list inside each record; ``key`` is SQL over the element ``e``."""
    return (
        f"flatten(transform({records}, r -> coalesce(transform({many(_at('r.rec', path))}, (e, j) -> "
        f"{_child('r.rec_key', kind, 'CAST(j + 1 AS BIGINT)', key)}), array())))"
    )


TAG_TEXT = f"coalesce({scalar('e')}, {scalar('e', '$.tag')})"

#: What stands where: the paths of the record list, the record kind, and the SQL of each target table.
SHAPES: dict[str, dict] = {
    "wall_pages": {
        "lists": ("$.data", "$.result.data"),
        "kind": "activity",
        "tables": {
            "author": lambda r: _one(r, "author", "$.what.author.userid"),
            "category": lambda r: _one(r, "category", "$.what.category_info.type"),
            "tag": lambda r: _nested(r, "tag", "$.what.tags", TAG_TEXT),
            "episode": lambda r: _nested(r, "episode", "$.what.series.items", scalar("e", "$.id")),
        },
    },
    "book_pages": {
        "lists": ("$.content", "$.result.content"),
        "kind": "book",
        "tables": {
            "media": lambda r: _one(r, "media", "$.media.status"),
            "contributor": lambda r: _nested(r, "contributor", "$.metadata.authors", scalar("e", "$.name")),
        },
    },
}


def with_records(df: DataFrame, shape: str, text_col: str = "payload") -> DataFrame:
    """Keep page_id and ``recs``: the payload's records, each with its key and its place."""
    spec = SHAPES[shape]
    df = parse_payload(df.select("page_id", text_col), text_col, "__doc").where(F.col("__doc").isNotNull())
    found = "coalesce(" + ", ".join(many(_at("__doc", p)) for p in spec["lists"]) + ")"
    df = df.withColumn("__list", F.expr(found))
    return df.select(
        "page_id",
        F.expr(f"transform(__list, (x, i) -> struct(CAST(i + 1 AS BIGINT) AS rec_pos, {scalar('x', '$.id')} AS rec_key, x AS rec))").alias("recs"),
    )


def payload_status(df: DataFrame, shape: str, text_col: str = "payload") -> DataFrame:
    """One row per payload: page_id and status ('read', 'empty', or 'not one document'), so that no page vanishes uncounted."""
    doc = parse_payload(df.select("page_id", text_col), text_col, "__doc")
    blank = F.coalesce(F.trim(F.col(text_col)) == "", F.lit(True))
    return doc.select("page_id", F.when(F.col("__doc").isNotNull(), "read").when(blank, "empty").otherwise("not one document").alias("status"))


def _top(spec: dict) -> str:
    return f"transform(recs, r -> {_child('CAST(page_id AS STRING)', spec['kind'], 'r.rec_pos', 'r.rec_key')})"


def child_table(df: DataFrame, shape: str, kind: str, text_col: str = "payload") -> DataFrame:
    """One target table: page_id, parent_key, child_kind, child_pos, child_key; distinct rows."""
    return _emit(df, shape, [kind], text_col)


def child_tables(df: DataFrame, shape: str, text_col: str = "payload") -> DataFrame:
    """All target tables of a payload shape in one pass: the rows' arrays are joined before the one ``inline``."""
    return _emit(df, shape, [SHAPES[shape]["kind"], *SHAPES[shape]["tables"]], text_col)


def _emit(df: DataFrame, shape: str, kinds: list[str], text_col: str) -> DataFrame:
    spec = SHAPES[shape]
    recs = with_records(df, shape, text_col)
    parts = [_top(spec) if k == spec["kind"] else spec["tables"][k]("recs") for k in kinds]
    joined = parts[0] if len(parts) == 1 else "concat(" + ", ".join(f"coalesce({p}, array())" for p in parts) + ")"
    rows = recs.selectExpr("page_id", f"inline_outer({joined})")
    return rows.where("parent_key IS NOT NULL AND child_key IS NOT NULL").distinct()
