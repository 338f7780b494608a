"""Change data: field-wise differences, upserts into lists, three-way merges, snapshot classification, integrity checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.relational import folded_set


def changed_fields(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """A map of the fields whose new value differs from the old one, nulls compared as values. Values are text."""
    entries = [F.when(~new[f].eqNullSafe(old[f]), F.struct(F.lit(f).alias("k"), new[f].cast("string").alias("v"))) for f in new]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def same_folded_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same values without regard to case, Unicode form, order and repetition; null is an empty list."""
    return folded_set(a) == folded_set(b)


def upsert_links(current: Column, label: Column, url: Column) -> Column:
    """A list of struct(label, url) with this label's url replaced in place, or appended if the label is missing."""
    cur = F.coalesce(current, F.array().cast("array<struct<label:string,url:string>>"))
    put = F.struct(label.alias("label"), url.alias("url"))
    return F.when(F.exists(cur, lambda x: x["label"] == label), F.transform(cur, lambda x: F.when(x["label"] == label, put).otherwise(x))).otherwise(F.concat(cur, F.array(put)))


def three_way(app: Column, file: Column, base: Column, null_app_changes: bool) -> Column:
    """What to do with two versions of a value and the digest of the one they last agreed on.

    'equal' where both are the same; without a base the file wins if the application has nothing ('adopt file'), else 'conflict';
    otherwise 'none', 'take file', 'take app' or, if both moved, 'conflict', which keeps the application's value.
    ``null_app_changes``: whether a missing application value counts as changed (texts) or never does (bytes).
    """
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    app_moved = digest(app) != base
    if not null_app_changes:
        app_moved = app_moved & app.isNotNull()
    file_moved = file.isNotNull() & (digest(file) != base)
    blank = app.isNull() | (app == "")
    return (
        F.when(app.eqNullSafe(file), "equal")
        .when(base.isNull(), F.when(file.isNull(), "take app").when(blank, "adopt file").otherwise("conflict"))
        .when(~app_moved & ~file_moved, "none")
        .when(~app_moved, "take file")
        .when(~file_moved, "take app")
        .otherwise("conflict")
    )


def classify_snapshot(stored: DataFrame, found: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys with what a sync has to do: import (new or other bytes), skip (same), delete (vanished)."""
    s = stored.select(*keys, F.col(digest).alias("__s"), F.lit(1).alias("__in_s"))
    f = found.select(*keys, F.col(digest).alias("__f"), F.lit(1).alias("__in_f"))
    j = s.join(f, keys, "full")
    return j.select(*keys, F.when(F.col("__in_f").isNull(), "delete").when(F.col("__in_s").isNull() | ~F.col("__s").eqNullSafe(F.col("__f")), "import").otherwise("skip").alias("action"))


def vanished(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were listed before and are no more."""
    return before.select(key).distinct().join(after.select(key).distinct(), key, "left_anti")


def upsert(base: DataFrame, patch: DataFrame, key: str, clearable: Iterable[str] = ()) -> DataFrame:
    """Apply a patch: its non-null fields win, absent ones leave the value, new keys are added. A boolean column ``clear_<field>``
    of the patch, for the named fields, sets null on purpose."""
    fields = [c for c in base.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in patch.columns if c != key])
    j = base.join(p, key, "full")

    def value(c: str) -> Column:
        out = F.coalesce(F.col(f"__p_{c}"), F.col(c)) if c in patch.columns else F.col(c)
        if c in set(clearable):
            out = F.when(F.coalesce(F.col(f"__p_clear_{c}"), F.lit(False)), F.lit(None)).otherwise(out)
        return out.alias(c)

    return j.select(key, *[value(c) for c in fields])


# ---- integrity checks: each gives (check_name, detail) rows ----


def repeated(df: DataFrame, name: str, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 AND `{key}` IS NOT NULL").select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("detail"))


def dangling(df: DataFrame, other: DataFrame, name: str, key: str, other_key: str) -> DataFrame:
    """References that lead nowhere."""
    refs = df.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct()
    return refs.join(other.select(F.col(other_key).alias("__k")).distinct(), "__k", "left_anti").select(F.lit(name).alias("check_name"), F.col("__k").cast("string").alias("detail"))


def failing(df: DataFrame, name: str, key: str, ok: Column) -> DataFrame:
    """Rows for which a condition is false; unknown is not a failure."""
    return df.where(~ok).select(F.lit(name).alias("check_name"), F.col(key).cast("string").alias("detail")).distinct()


def first_violation(checks: list[DataFrame]) -> DataFrame:
    """Of checks in their order of rank, the first that fails and its least detail; empty if all hold."""
    ranked = None
    for rank, c in enumerate(checks):
        part = c.select(F.lit(rank).alias("check_rank"), "check_name", "detail")
        ranked = part if ranked is None else ranked.unionByName(part)
    least = ranked.agg(F.min(F.struct("check_rank", "check_name", "detail")).alias("v")).where("v IS NOT NULL")
    return least.select("v.check_rank", "v.check_name", "v.detail")
