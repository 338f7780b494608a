"""Lookups, first-seen deduplication, elections, unanimity and other group facts.

Order is data: wherever one row wins over another, the columns that decide are named. Nulls never equal a key, so rows with a
null key pass through deduplication and take part in no lookup, unless a docstring says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def first_by_key(df: DataFrame, keys: list[str], order: list[Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key. Ties must be broken by ``order``. Rows with a null key are kept all or, by default, treated as one key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = df.withColumn("__rn", rn)
    keep = F.col("__rn") == 1
    if keep_null_keys:
        for k in keys:
            keep = keep | F.col(k).isNull()
    return ranked.where(keep).drop("__rn")


def first_by_key_agg(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The same survivor by a mergeable aggregate: rows are reduced before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def at_least(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Rows whose every named value is a number and reaches its minimum; booleans count as 0 or 1; no thresholds keep all.

    Plain comparisons, so that they reach the scan; a filter drops what is unknown anyway.
    """
    for name, least in thresholds.items():
        kind = dict(df.dtypes)[name]
        if kind == "string":
            df = df.where(F.lit(False))
        else:
            df = df.where((F.col(name).cast("int") if kind == "boolean" else F.col(name)) >= F.lit(least))
    return df


def budget_antijoin(df: DataFrame, known: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """The first ``budget`` rows, in order, whose key is not known. The budget is the feature."""
    return df.join(known.select(key).distinct(), key, "left_anti").orderBy(*order).limit(budget)


def mark_within_budget(df: DataFrame, known: DataFrame, key: str, order: list[Column], budget: int, row: str | None = None) -> DataFrame:
    """All rows, with ``chosen``: whether the budget reaches them. ``row`` names the rows' own key, by default ``key``."""
    row = row or key
    chosen = budget_antijoin(df, known, key, order, budget).select(row).distinct().withColumn("__in", F.lit(True))
    return df.join(F.broadcast(chosen), row, "left").withColumn("chosen", F.coalesce("__in", F.lit(False))).drop("__in")


def unique_or_null(df: DataFrame, other: DataFrame, key: Column, other_key: Column, value: str, out: str) -> DataFrame:
    """Add ``out``: the value of the one row of ``other`` with this key; null where there is none or more than one."""
    single = other.select(other_key.alias("__k"), F.col(value).alias("__v")).where("__k IS NOT NULL").groupBy("__k").agg(F.min("__v").alias("__v"), F.count(F.lit(1)).alias("__n"))
    single = single.where("__n = 1").select("__k", F.col("__v").alias(out))
    keyed = df.withColumn("__j", key)
    found = keyed.where("__j IS NOT NULL").join(single, F.col("__j") == F.col("__k"), "left").drop("__j", "__k")
    return found.unionByName(keyed.where("__j IS NULL").drop("__j").withColumn(out, F.lit(None).cast(dict(other.dtypes)[value])))


def suffix_match(paths: DataFrame, targets: DataFrame, path: str, target: str, value: str) -> DataFrame:
    """(path, value) where exactly one target ends in '/' + path, compared in composed Unicode form.

    The suffixes of each target are generated, so that the join is an equality on the whole path, not on its last segment, which is often the same.
    """
    left = paths.select(path).where(F.col(path).isNotNull()).distinct().withColumn("__p", nfc(F.col(path)))
    t = targets.where(F.col(target).isNotNull()).select(nfc(F.col(target)).alias("__t"), F.col(value).alias("__v"))
    parts = F.split("__t", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    t = t.where(F.contains("__t", F.lit("/"))).select(F.explode(suffixes).alias("__p"), "__v")
    found = t.groupBy("__p").agg(F.min("__v").alias(value), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return left.join(found, "__p", "left").select(path, value)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """The composed form."""
    return s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def same_file(path: Column, other: Column) -> Column:
    """Whether a path names the other one's end, whole segments only, without regard to case, Unicode form and kind of slash. Give columns
    of ``nfc_casefold`` values."""
    slashes = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", "")
    return (slashes(path) == slashes(other)) | slashes(other).endswith(F.concat(F.lit("/"), slashes(path)))


def longest_prefix_owner(names: DataFrame, owners: DataFrame, folder: str, name: str, stem: str) -> DataFrame:
    """(folder, name, owner): the owner in the same folder with the longest stem that, with one of '. - _ blank' behind it, begins
    the name; a sole owner of a folder owns all. Candidate prefixes are generated from the name, so that the join is an equality."""
    o = owners.select(folder, F.col(stem).alias("__stem")).distinct()
    sole = o.groupBy(folder).agg(F.count(F.lit(1)).alias("__n"), F.min("__stem").alias("__sole"))
    cut = F.filter(F.sequence(F.lit(2), F.length(name)), lambda i: F.substring(F.col(name), i, F.lit(1)).isin(".", "-", "_", " "))
    prefixes = names.where(F.length(name) > 1).withColumn("__stem", F.explode(F.transform(cut, lambda i: F.substring(F.col(name), F.lit(1), i - 1))))
    best = prefixes.join(o, [folder, "__stem"]).groupBy(folder, name).agg(F.max_by("__stem", F.length("__stem")).alias("__best"))
    joined = names.join(best, [folder, name], "left").join(sole, folder, "left")
    return joined.select(folder, name, F.when(F.col("__n") == 1, F.col("__sole")).otherwise(F.col("__best")).alias("owner"))


def resolve_by(df: DataFrame, *attempts: Column, out: str) -> DataFrame:
    """The first attempt that found something."""
    return df.withColumn(out, F.coalesce(*attempts))


def held_by_other(df: DataFrame, remote: str, own: str) -> DataFrame:
    """Rows whose remote id another row of theirs holds too."""
    held = df.where(F.col(remote).isNotNull()).groupBy(remote).agg(F.count_distinct(own).alias("__n"))
    return df.join(held.where("__n > 1").select(remote), remote, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, group: str, key: str) -> DataFrame:
    """Per group, whether all of its keys are known to ``other`` (an empty group is): group, n_missing, subset."""
    missing = df.join(other.select(group, key).distinct(), [group, key], "left_anti").groupBy(group).agg(F.count_distinct(key).alias("n_missing"))
    return df.select(group).distinct().join(missing, group, "left").select(group, F.coalesce("n_missing", F.lit(0)).cast("bigint").alias("n_missing"), F.col("n_missing").isNull().alias("subset"))


def unanimous(df: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """Add ``<value>_all``: a group's only distinct non-blank value, else null, and ``<value>_first``: its first one in order."""
    v = F.nullif(F.trim(F.col(value)), F.lit(""))
    facts = df.groupBy(*group).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.min_by(v, F.struct(*order)).alias("__any"), F.min(F.when(v.isNotNull(), F.struct(*order, v.alias("__v"))))["__v"].alias("__first"))
    facts = facts.select(*group, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).alias(f"{value}_all"), F.col("__first").alias(f"{value}_first"))
    return df.join(facts, group, "left")


def single_value(df: DataFrame, group: list[str], value: str, otherwise: Column) -> DataFrame:
    """Per group its only distinct non-blank value, else ``otherwise`` (an aggregate expression)."""
    v = F.nullif(F.col(value), F.lit(""))
    return df.groupBy(*group).agg(F.when(F.min(v) == F.max(v), F.min(v)).otherwise(otherwise).alias(value))


def first_with_upgrade(df: DataFrame, keys: list[str], order: str, extra: str) -> DataFrame:
    """Distinct keys in order of first appearance, each with its first non-null ``extra``: keys, first_pos, extra."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_pos"), F.min(F.when(F.col(extra).isNotNull(), F.struct(order, extra)))[extra].alias(extra))


def repeated_numbers(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Numbers that more than one range of a group covers: group, number, n_ranges. Inverted and null ranges cover nothing."""
    ok = df.where(F.col(low) <= F.col(high))
    wide = ok.select(group, F.explode(F.sequence(low, high)).alias("number"))
    return wide.groupBy(group, "number").agg(F.count(F.lit(1)).alias("n_ranges")).where("n_ranges > 1")


def duplicate_flags(df: DataFrame, *keys: Column) -> DataFrame:
    """Add ``is_duplicate``: another row has the same value of one of the keys; null keys never match.

    Counts are aggregated and joined back, so that a hot value costs no window partition.
    """
    n, all_rows = len(keys), df.withColumns({f"__k{i}": key for i, key in enumerate(keys)}).withColumn("is_duplicate", F.lit(False))
    for i in range(n):
        k = f"__k{i}"
        # Rows without the key go round the join, so that no partition collects them.
        keyed = all_rows.where(F.col(k).isNotNull())
        counts = keyed.groupBy(k).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        marked = keyed.join(counts, k, "left").withColumn("is_duplicate", F.col("is_duplicate") | F.col("__n").isNotNull()).drop("__n")
        all_rows = marked.unionByName(all_rows.where(F.col(k).isNull()))
    return all_rows.drop(*[f"__k{i}" for i in range(n)])


def content_claims(df: DataFrame, path: str, content: Column, order: list[str]) -> DataFrame:
    """Same path and bytes share a name; other bytes of the path get the next suffix, in the order in which they are first claimed: path,
    digest, claim_no, claimed.

    Claims are first brought to one row a path and digest, before the window by path; numbering needs the path's distinct digests in one
    order, which the window sorts with spilling.
    """
    d = df.select(F.col(path), F.sha2(content.cast("binary"), 256).alias("digest"), F.struct(*order).alias("__first")).groupBy(path, "digest").agg(F.min("__first").alias("__first"))
    no = F.row_number().over(Window.partitionBy(path).orderBy("__first", "digest"))
    return d.select(path, "digest", no.alias("claim_no")).withColumn("claimed", F.when(F.col("claim_no") == 1, F.col(path)).otherwise(F.concat_ws("-", path, F.col("claim_no").cast("string"))))


def heaviest(df: DataFrame, group: list[str], value: str, weight: Column, share: float) -> DataFrame:
    """Per group the value with the greatest weight (ties: the smallest value), if it has at least that share of all; else null."""
    w = df.groupBy(*group, value).agg(F.sum(weight).alias("__w"))
    best = w.groupBy(*group).agg(F.max(F.struct(F.col("__w"))).alias("__m"), F.sum("__w").alias("__t"), F.min(F.struct((-F.col("__w")).alias("w"), F.col(value).alias("v"))).alias("__b"))
    return best.select(*group, F.when(-F.col("__b.w") >= F.col("__t") * share, F.col("__b.v")).alias(value), (-F.col("__b.w")).alias("weight"), F.col("__t").alias("total"))


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value: key, n_values, values in order, joined by ', '."""
    d = df.select(key, value).distinct().where(F.col(value).isNotNull())
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.array_sort(F.collect_list(value)), ", ").alias("all_values")).where("n_values > 1")


def elect(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """One survivor per group by several keys; ``order`` says where nulls go and must end in a unique key.

    Catalyst turns rank = 1 into a group limit before the shuffle, so that a hot group sends one row a task.
    """
    return first_by_key(df, group, order)


def preferred(df: DataFrame, group: list[str], kind: str, preference: list[str], order: list[str]) -> DataFrame:
    """Per group the first row of the most preferred kind; other kinds never win. One mergeable aggregate."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(kind))
    rest = [c for c in df.columns if c not in group]
    best = df.where(rank > 0).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(rank, *order)).alias("__b"))
    return best.select(*group, *[F.col(f"__b.{c}").alias(c) for c in rest])


def dispositions(*rules: tuple[str, Column], otherwise: str = "kept") -> Column:
    """The name of the first rule that holds; a rule that is unknown does not hold."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out.otherwise(otherwise)


def counts_by_state(df: DataFrame, state: str, states: list[str], unknown: str = "unknown") -> DataFrame:
    """state, n: the rows of each named state, 0 included, and of all others, null too, under ``unknown``."""
    known = F.col(state).isin(*states)
    counts = [F.count_if(F.col(state) == s).alias(f"__{i}") for i, s in enumerate(states)]
    one = df.agg(*counts, F.count_if(~F.coalesce(known, F.lit(False))).alias("__u"))
    rows = [F.struct(F.lit(s).alias("state"), F.col(f"__{i}").alias("n")) for i, s in enumerate(states)]
    return one.select(F.explode(F.array(*rows, F.struct(F.lit(unknown).alias("state"), F.col("__u").alias("n")))).alias("r")).select("r.state", "r.n")


def large_rows(df: DataFrame, group: str, size: str, factor: float) -> DataFrame:
    """Per group its median size and how many rows reach ``factor`` times it; null sizes count in neither."""
    med = df.groupBy(group).agg(F.median(size).alias("median_size"))
    return df.join(med, group).groupBy(group, "median_size").agg(F.count_if(F.col(size) >= factor * F.col("median_size")).alias("n_large"))


def number_range_title(df: DataFrame, group: str, low: str, high: Column, stem: Column) -> DataFrame:
    """Per group '<stem> <least>-<greatest>' over its numbers and range ends; one number stands alone; null without a number."""
    g = df.groupBy(group).agg(F.min(low).alias("__lo"), F.max(F.coalesce(high, F.col(low))).alias("__hi"), F.any_value(stem).alias("__stem"))
    shown = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo").cast("string")).otherwise(F.concat("__lo", F.lit("-"), "__hi"))
    return g.select(group, F.concat("__stem", F.lit(" "), shown).alias("title"))


def newest_not_after(now: Column, *stamps: Column) -> Column:
    """The newest of the timestamps; nulls are skipped, and none or one in the future gives ``now``."""
    newest = F.greatest(*stamps) if len(stamps) > 1 else stamps[0]
    return F.when(newest.isNull() | (newest > now), now).otherwise(newest)


def full_outer_state(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Key, before, after and state (added, removed, changed, same), nulls compared as values."""
    b = before.select(key, F.col(value).alias("before_value"), F.lit(True).alias("__b"))
    a = after.select(key, F.col(value).alias("after_value"), F.lit(True).alias("__a"))
    j = b.join(a, key, "full")
    state = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(F.col("before_value").eqNullSafe(F.col("after_value")), "same").otherwise("changed")
    return j.select(key, "before_value", "after_value", state.alias("state"))


def _fold(x: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold())


@F.pandas_udf(ArrayType(StringType()))
def folded_difference(left: pd.Series, minus: pd.Series) -> pd.Series:
    """The elements of an array whose composed and case-folded form is in none of the others; order, spelling and repeats are kept, nulls
    fall away, and a null array to take from is null; a null array to take away is empty."""
    drop = [set() if m is None else {_fold(x) for x in m if x is not None} for m in minus]
    return pd.Series([None if v is None else [x for x in v if x is not None and _fold(x) not in d] for v, d in zip(left, drop)])


@F.pandas_udf(ArrayType(StringType()))
def folded_distinct(values: pd.Series) -> pd.Series:
    """Array elements distinct by their composed and case-folded form; the first spelling stays, nulls fall away."""

    def once(v: list[str]) -> list[str]:
        first: dict[str, str] = {}
        for x in v:
            if x is not None:
                first.setdefault(_fold(x), x)
        return list(first.values())

    return values.map(once, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def folded_set(values: pd.Series) -> pd.Series:
    """The composed and case-folded elements, distinct and sorted; a null array is empty, nulls fall away."""
    return pd.Series([sorted({_fold(x) for x in v if x is not None}) if v is not None else [] for v in values])
