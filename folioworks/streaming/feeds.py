"""Change feeds: markers, first-seen streams, remembered values with an expiry. Batch forms beside the streaming ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes_since(df: DataFrame, ts: str, marker: Column) -> DataFrame:
    """Rows newer than the marker. A null marker is a first look: it gives no rows, only a baseline."""
    return df.where(F.col(ts) > marker)


def next_marker(df: DataFrame, ts: str, marker: Column, epoch: Column) -> DataFrame:
    """The marker to remember: the newest time stamp, never behind the old marker; ``epoch`` where there is nothing yet."""
    return df.agg(F.max(ts).alias("__m")).select(F.coalesce(F.greatest(F.col("__m"), marker), epoch).alias("marker"))


def page_feed(df: DataFrame, page: str, ts: str, marker: Column) -> DataFrame:
    """All rows of every page whose newest row is newer than the marker."""
    fresh = df.groupBy(page).agg(F.max(ts).alias("__m")).where(F.coalesce(F.col("__m") > marker, F.lit(False))).select(page)
    return df.join(fresh, page, "left_semi")


def within_weeks(df: DataFrame, ts: str, now: Column, weeks: int) -> DataFrame:
    """Rows not older than so many weeks before ``now``; rows without a time stamp are kept."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= now - F.make_interval(weeks=F.lit(weeks))))


def first_seen(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """A stream without repeats of a key within the watermark delay. The time column may be without a zone; it is read as UTC."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, ts: str, delay: str, width: str, by: list[str]) -> DataFrame:
    """Counts per time window; late rows within the delay are counted, later ones are not, and rows without a time stand in no window."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def suppress_echoes(stream: DataFrame, key: str, value: str, ts: str, ttl_ms: int) -> DataFrame:
    """Rows whose value differs from the one remembered for their key; what was remembered counts no more after ``ttl_ms``.

    Age is measured between the rows' own times, and a batch is walked in their order (ties by value), so that a replay gives the same
    rows. One small state row a key. A row without a time is as old as the newest one seen; a null value is a value.
    """
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, last, seen = state.get if state.exists else (False, None, 0)
        rows = pd.concat(list(frames)).sort_values(["__us", value], kind="stable", na_position="last")
        out = []
        for v, us in zip(rows[value], rows["__us"]):
            v, us = None if pd.isna(v) else v, seen if pd.isna(us) else int(us)
            if not known or v != last or us - seen > ttl_ms * 1000:
                out.append((k[0], v, us))
            known, last, seen = True, v, max(seen, us)
        state.update((known, last, seen))
        if out:
            yield pd.DataFrame(out, columns=[key, value, "at_us"])

    slim = stream.select(key, F.col(value).cast("string").alias(value), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    return slim.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} string, at_us long", "known boolean, last string, seen long", "append", "NoTimeout")


def run_available(stream: DataFrame, folder: str, latest_by: list[str] | None = None) -> DataFrame:
    """Drive a stream through all that is there now; the result is a table in ``folder``, which all executors share.

    Without ``latest_by`` finished rows are appended. With it the stream runs in update mode, so that windows that are still
    open when the input ends are given too; of each key the row of the last batch counts. A batch that is run again replaces itself.
    """
    spark, schema, out = stream.sparkSession, stream.schema, f"{folder}/rows"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/part_{number}")

    writer = stream.writeStream.outputMode("update" if latest_by else "append").foreachBatch(keep)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("recursiveFileLookup", "true").schema(schema.add("__batch", "long")).parquet(out)
    if not latest_by:
        return rows.drop("__batch")
    rest = [c for c in stream.columns if c not in latest_by]
    return rows.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), "__batch").alias("__r")).select(*latest_by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def route(handlers: dict[str, Callable[[DataFrame], None]], event: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each handler the rows of its event."""

    def run(batch: DataFrame, _epoch: int) -> None:
        batch.persist()
        try:
            for name, handle in handlers.items():
                handle(batch.where(F.col(event) == name))
        finally:
            batch.unpersist()

    return run
