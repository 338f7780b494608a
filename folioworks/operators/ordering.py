"""Positional operators: slot-preserving sort, splicing, ranges to the next mark, nearest and last marks, runs.

Windows are always partitioned by a document or another bounded unit. Ties are broken by the position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_sort(df: DataFrame, doc: str, pos: str, zone: Column, number: Column, sorted_zone: int) -> DataFrame:
    """Add ``new_pos`` (from 1): zones in order; inside ``sorted_zone`` the rows with a number are sorted by (number, pos) and put
    into the places that such rows held, all others keep their places."""
    slotted = (zone == sorted_zone) & number.isNotNull()
    d = df.withColumns({"__z": zone, "__s": slotted})
    d = d.withColumn("__place", F.row_number().over(Window.partitionBy(doc).orderBy("__z", pos)))
    d = d.withColumn("__k", F.row_number().over(Window.partitionBy(doc, "__s").orderBy(F.when(F.col("__s"), number).asc_nulls_last(), pos)))
    # The k-th smallest number takes the k-th of the slotted places.
    slots = d.where("__s").select(F.col(doc).alias("__doc"), F.row_number().over(Window.partitionBy(doc).orderBy("__place")).alias("__slot"), F.col("__place").alias("__to"))
    taken = F.col("__s") & d[doc].eqNullSafe(F.col("__doc")) & (F.col("__k") == F.col("__slot"))
    return d.join(slots, taken, "left").withColumn("new_pos", F.coalesce("__to", "__place")).drop("__z", "__s", "__place", "__k", "__doc", "__slot", "__to")


def splice_order(df: DataFrame, doc: str, auto_pos: str, stored_pos: str, nav_pos: str | None = None) -> DataFrame:
    """Add ``new_pos`` (from 1): rows with a stored position come in its order, ties in the automatic order; each other row goes directly
    behind the nearest earlier stored row of the automatic order, else to the front. The others are put in one by one in the order of
    ``nav_pos`` (the present order; by default the automatic one), so of several behind one anchor the later one comes first."""
    before = Window.partitionBy(doc).orderBy(auto_pos).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col(stored_pos).isNotNull(), F.struct(F.col(stored_pos).alias("s"), F.col(auto_pos).alias("a")))
    d = df.withColumn("__own", own).withColumn("__anchor", F.coalesce("__own", F.last("__own", ignorenulls=True).over(before)))
    order = Window.partitionBy(doc).orderBy(F.asc_nulls_first("__anchor"), F.when(F.col("__own").isNotNull(), 0).otherwise(1), F.desc(nav_pos or auto_pos))
    return d.withColumn("new_pos", F.row_number().over(order)).drop("__own", "__anchor")


def zoned_order(df: DataFrame, doc: str, nav_pos: str, zone: Column, number: Column, key: str, stored: Column, sorted_zone: int = 2) -> DataFrame:
    """Add ``new_pos``: the automatic order, and inside ``sorted_zone`` the stored order of keys merged with it.

    ``stored`` is an array of keys per row of a document (the same on all of its rows). An order that names a key twice says nothing and is
    ignored, and so is a missing or empty one; rows of other zones keep their automatic place whatever the order says.
    """
    d = slot_sort(df.withColumns({"__zone": zone, "__number": number}), doc, nav_pos, F.col("__zone"), F.col("__number"), sorted_zone).withColumnRenamed("new_pos", "__auto")
    usable = F.size(stored) == F.size(F.array_distinct(stored))
    at = F.when(usable & (F.col("__zone") == sorted_zone), F.nullif(F.array_position(stored, F.col(key)), F.lit(0)))
    d = d.withColumn("__at", at).withColumn("__merged", F.coalesce(F.size(stored) > 0, F.lit(False)) & F.coalesce(usable, F.lit(False)) & (F.col("__zone") == sorted_zone))
    whole = d.where(~F.col("__merged")).withColumn("new_pos", F.col("__auto"))
    merged = splice_order(d.where("__merged"), doc, "__auto", "__at", nav_pos)
    # The merged rows fill the places their zone has in the automatic order, which are neighbours.
    first = d.where("__merged").groupBy(F.col(doc).alias("__doc")).agg((F.min("__auto") - 1).alias("__before"))
    merged = merged.join(first, merged[doc].eqNullSafe(F.col("__doc"))).withColumn("new_pos", F.col("new_pos") + F.col("__before")).drop("__doc", "__before")
    return whole.unionByName(merged).drop("__zone", "__number", "__auto", "__at", "__merged")


def stored_order(text: Column) -> Column:
    """A stored order of keys from its JSON list; empty for anything else and for an order that names a key twice."""
    parsed = F.from_json(text, "array<string>")
    none = F.array().cast("array<string>")
    return F.when(F.trim(text).startswith("[") & (F.size(parsed) == F.size(F.array_distinct(parsed))), parsed).otherwise(none)


def ranges_to_next(df: DataFrame, doc: str, start: str, order: list[str], last: Column) -> DataFrame:
    """Add ``range_end``: the start of the next row, or ``last`` for the last one. Equal starts give an empty range."""
    w = Window.partitionBy(doc).orderBy(start, *order)
    return df.withColumn("range_end", F.coalesce(F.lead(start).over(w), last))


def midpoint_ranges(df: DataFrame, doc: str, mark: str) -> DataFrame:
    """Add ``low`` and ``high``: half way to the neighbouring marks, 0 and 1 at the ends."""
    w = Window.partitionBy(doc).orderBy(mark)
    low = F.coalesce((F.lag(mark).over(w) + F.col(mark)) / 2, F.lit(0.0))
    high = F.coalesce((F.lead(mark).over(w) + F.col(mark)) / 2, F.lit(1.0))
    return df.withColumns({"low": low, "high": high})


def last_at_or_before(points: DataFrame, marks: DataFrame, doc: str, at: str, start: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every point with the last mark of its document that starts at or before it, null before the first.

    One union and one running last value instead of an inequality join, so that the work is linear in both tables. ``bucket``, a
    non-decreasing function of the place, cuts a document that may hold many rows: each bucket is walked by itself, and the
    last value of the buckets before comes from a table of one row a bucket.
    """
    p = points.withColumns({"__at": F.col(at), "__kind": F.lit(1), "__v": F.lit(None).cast(dict(marks.dtypes)[value])})
    m = marks.select(F.col(doc), F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__v"))
    both = p.unionByName(m, allowMissingColumns=True)
    both = both.withColumn("__bucket", bucket(F.col("__at")) if bucket else F.lit(0))
    w = Window.partitionBy(doc, "__bucket").orderBy("__at", "__kind", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).where("__kind = 1")
    if bucket:
        own = F.max(F.when(F.col("__kind") == 0, F.struct("__at", "__v")))["__v"]
        ends = both.groupBy(doc, "__bucket").agg(own.alias("__end"))
        before = Window.partitionBy(doc).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col(doc).alias("__doc"), F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(before).alias("__carry"))
        walked = walked.join(carried, walked[doc].eqNullSafe(F.col("__doc")) & F.col("__bucket").eqNullSafe(F.col("__b")), "left")
        walked = walked.withColumn("__last", F.coalesce("__last", "__carry"))
    return walked.withColumn(value, F.col("__last")).drop("__at", "__kind", "__v", "__bucket", "__last", "__doc", "__b", "__carry")


def nearest_mark(points: DataFrame, marks: DataFrame, doc: str, at: str, mark: str, key: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every point with the nearest mark of its document; of two equally near ones the lower. Linear, and cut by ``bucket`` as above:
    the marks next to a bucket's ends come from a table of one row a bucket."""
    kind = dict(marks.dtypes)[mark]
    b = bucket or (lambda c: F.lit(0))
    p = points.withColumns({"__at": F.col(at), "__m": F.lit(None).cast(kind), "__p": F.lit(True)})
    m = marks.where(F.col(mark).isNotNull()).select(F.col(doc), F.col(mark).alias("__at"), F.col(mark).alias("__m")).distinct()
    both = p.unionByName(m, allowMissingColumns=True).withColumn("__b", b(F.col("__at")))
    asc = Window.partitionBy(doc, "__b").orderBy("__at", F.asc_nulls_last("__m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    desc = Window.partitionBy(doc, "__b").orderBy(F.desc("__at"), F.asc_nulls_last("__m")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"__lo": F.last("__m", ignorenulls=True).over(asc), "__hi": F.last("__m", ignorenulls=True).over(desc)}).where("__p")
    if bucket:
        ends = m.unionByName(points.select(F.col(doc), F.col(at).alias("__at")), allowMissingColumns=True).groupBy(F.col(doc).alias("__doc"), b(F.col("__at")).alias("__bb")).agg(F.min("__m").alias("__min"), F.max("__m").alias("__max"))
        near = Window.partitionBy("__doc").orderBy("__bb")
        ends = ends.select("__doc", "__bb", F.last("__max", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, -1)).alias("__below"), F.first("__min", ignorenulls=True).over(near.rowsBetween(1, Window.unboundedFollowing)).alias("__above"))
        both = both.join(ends, both[doc].eqNullSafe(F.col("__doc")) & F.col("__b").eqNullSafe(F.col("__bb")), "left")
        both = both.withColumns({"__lo": F.coalesce("__lo", "__below"), "__hi": F.coalesce("__hi", "__above")}).drop("__doc", "__bb", "__below", "__above")
    near = F.when(F.col("__hi").isNull() | (F.col("__at") - F.col("__lo") <= F.col("__hi") - F.col("__at")), F.col("__lo")).otherwise(F.coalesce("__hi", "__lo"))
    return both.withColumn("nearest", near).drop("__at", "__m", "__p", "__b", "__lo", "__hi")


def place_in_span(start: Column, share: Column, span: Column, last: Column) -> Column:
    """start + share of the span, rounded half to even and kept within start and last."""
    return F.least(last, F.greatest(start, start + F.bround(share * span, 0).cast("bigint")))


def runs_by_heading(df: DataFrame, doc: str, pos: str, is_heading: Column, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``run``: how many headings stand at or before the row; 0 before the first.

    ``bucket``, a non-decreasing function of the place, cuts a document that may hold many rows; the headings of the buckets before
    come from a table of one row a bucket.
    """
    d = df.withColumn("__h", F.coalesce(is_heading, F.lit(False)).cast("int")).withColumn("__b", bucket(F.col(pos)) if bucket else F.lit(0))
    w = Window.partitionBy(doc, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("run", F.sum("__h").over(w))
    if bucket:
        before = Window.partitionBy("__doc").orderBy("__bb").rowsBetween(Window.unboundedPreceding, -1)
        carried = d.groupBy(F.col(doc).alias("__doc"), F.col("__b").alias("__bb")).agg(F.sum("__h").alias("__n"))
        carried = carried.select("__doc", "__bb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__carry"))
        d = d.join(carried, d[doc].eqNullSafe(F.col("__doc")) & F.col("__b").eqNullSafe(F.col("__bb")), "left")
        d = d.withColumn("run", F.col("run") + F.col("__carry")).drop("__doc", "__bb", "__carry")
    return d.drop("__h", "__b")


def moved_count(df: DataFrame, doc: str, before: str, after: str) -> DataFrame:
    """Per document how many rows stand elsewhere."""
    return df.groupBy(doc).agg(F.count_if(F.col(before) != F.col(after)).alias("n_moved"), F.count(F.lit(1)).alias("n_rows"))


def common_directory(df: DataFrame, group: str, path: str) -> DataFrame:
    """Per group the longest directory that all paths share, with a trailing slash; '' if none.

    The least and the greatest path bound all others, so two mergeable aggregates suffice.
    """
    ends = df.groupBy(group).agg(F.min(path).alias("__lo"), F.max(path).alias("__hi"))
    parts = lambda c: F.slice(F.split(F.col(c), "/"), 1, F.size(F.split(F.col(c), "/")) - 1)
    lo, hi = parts("__lo"), parts("__hi")
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lo), F.lit(1))), lambda i: F.slice(lo, F.lit(1), i) == F.slice(hi, F.lit(1), i))
    n = F.when(F.size(lo) > 0, F.coalesce(F.array_max(same), F.lit(0))).otherwise(0)
    return ends.select(group, F.when(n > 0, F.concat(F.array_join(F.slice(lo, F.lit(1), n), "/"), F.lit("/"))).otherwise("").alias("directory"))
