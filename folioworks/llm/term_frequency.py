"""How often every distinct term occurs, and in how many records, by heavy-light aggregation.

A sketch over all rows proposes the heavy terms (a bounded list). Their counts come from exact local counter arrays: each
partition adds up one array of counters, and only those arrays are combined. What is not heavy, and so has no hot key,
is shuffled by term once. The union of both tables has every term. The choice of heavy terms only moves work; counts are exact.

Records may span rows: a record's heavy terms are a bit set of fixed size, joined by bitwise or over the record's rows.

Defined results: null fields and empty values add nothing; terms of rows with a null record id count as occurrences, not as
records; repeated rows count again as occurrences; a tie with a threshold is neither rare (needs fewer) nor common (needs more).
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.session import materialize

#: Heavy terms per field, and the counters of the sketch that proposes them.
HEAVY = 128
SKETCH_ITEMS = 4096
_WORDS = HEAVY // 64


def canonical_term(text: str) -> str:
    """Character references resolved, case-folded, composed, white space of any kind as single blanks."""
    t = html.unescape(text)
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
    return " ".join(t.split())


def canonical_terms(df: DataFrame, array_col: str) -> DataFrame:
    """Replace ``array_col`` by its values' canonical terms; each batch is dictionary-coded, so each spelling is folded once."""
    at = df.columns.index(array_col)
    cache: dict[str, str | None] = {}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            flat = col.flatten().dictionary_encode()
            folded = []
            for s in flat.dictionary.to_pylist():
                if s not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[s] = canonical_term(s) or None
                folded.append(cache[s])
            terms = pa.array(folded, pa.string()).take(flat.indices)
            sizes = np.diff(np.asarray(col.offsets))
            sizes[np.asarray(col.is_null())] = 0
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), terms)
            yield pa.RecordBatch.from_arrays([lists if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(fold, df.schema)


def heavy_terms(df: DataFrame, field_col: str, array_col: str) -> dict[str, list[str]]:
    """At most HEAVY likely frequent terms a field, from one mergeable sketch over all rows."""
    flat = df.select(field_col, F.explode_outer(array_col).alias("__t")).where(F.col("__t").isNotNull())
    top = flat.groupBy(field_col).agg(F.expr(f"approx_top_k(__t, {HEAVY}, {SKETCH_ITEMS})").alias("top")).collect()
    return {r[0]: sorted(x["item"] for x in r["top"] if x["item"] is not None) for r in top}


def term_counts(df: DataFrame, field_col: str, record_col: str, array_col: str, label: str = "terms") -> DataFrame:
    """Every term of every field: field_name, term, n_occurrences, n_records, and total_records of the field.

    ``array_col`` holds a row's canonical terms. Rows of one record may stand anywhere.
    """
    spark = df.sparkSession
    rows = materialize(df.select(F.col(field_col).alias("field_name"), F.col(record_col).cast("long").alias("record"), F.col(array_col).alias("terms")), label)
    heavy = heavy_terms(rows, "field_name", "terms")
    index = {f: {t: i for i, t in enumerate(ts)} for f, ts in heavy.items()}

    def split_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row: the bit set of its heavy terms, its light terms, and at the partition's end the occurrence counters."""
        counters: dict[str, np.ndarray] = {}
        for b in batches:
            fields, records, col = b.column(0).to_pylist(), b.column(1), b.column(2)
            flat = col.flatten().dictionary_encode()
            sizes = np.diff(np.asarray(col.offsets))
            sizes[np.asarray(col.is_null())] = 0
            owner = np.repeat(np.arange(b.num_rows), sizes)
            words = flat.dictionary.to_pylist()
            codes = np.asarray(flat.indices.fill_null(-1))
            bits = np.zeros((b.num_rows, HEAVY), dtype=bool)
            light = codes >= 0
            kinds = np.array(fields, dtype=object)
            for f in dict.fromkeys(fields):
                to = np.array([index.get(f, {}).get(w, -1) for w in words] + [-1])
                own = (kinds == f)[owner]
                at = np.where(own, to[codes], -1)
                hit = at >= 0
                bits[owner[hit], at[hit]] = True
                counters[f] = counters.get(f, np.zeros(HEAVY, dtype=np.int64)) + np.bincount(at[hit], minlength=HEAVY)
                light &= ~hit
            packed = np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(b.num_rows, _WORDS)
            rest = flat.dictionary.take(pa.array(codes[light], pa.int32())) if len(words) else pa.array([], pa.string())
            counts = np.bincount(owner[light], minlength=b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32")), rest.cast(pa.string()))
            mats = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), _WORDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), records, mats, lists, pa.nulls(b.num_rows, pa.list_(pa.int64()))], names=["field_name", "record", "words", "light", "counters"])
        for f, c in counters.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([f]), pa.array([None], pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.string())), pa.array([c.tolist()], pa.list_(pa.int64()))],
                names=["field_name", "record", "words", "light", "counters"],
            )

    parted = materialize(rows.mapInArrow(split_heavy, "field_name string, record long, words array<long>, light array<string>, counters array<long>"), label + "-split")

    # Light terms: one shuffle, by term, which serves both aggregations. None of them is hot, as the heavy ones are out.
    light = (
        parted.select("field_name", "record", F.explode_outer("light").alias("term"))
        .where(F.col("term").isNotNull())
        .repartition("field_name", "term")
        .groupBy("field_name", "term", "record")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("field_name", "term")
        .agg(F.sum("n").alias("n_occurrences"), F.count("record").alias("n_records"))
    )

    # Heavy terms by record: bit sets joined by or, then one counter array a partition. Records without a heavy term are among them, as
    # they too are records.
    sets = parted.where(F.col("words").isNotNull() & F.col("record").isNotNull())
    sets = sets.groupBy("field_name", "record").agg(*[F.bit_or(F.col("words")[i]).alias(f"w{i}") for i in range(_WORDS)])

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            kinds = np.array(b.column(0).to_pylist(), dtype=object)
            words = np.stack([np.asarray(b.column(2 + i)) for i in range(_WORDS)], axis=1)
            for f in dict.fromkeys(kinds.tolist()):
                own = np.ascontiguousarray(words[kinds == f]).view(np.uint8)
                bits = np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                total[f] = total.get(f, np.zeros(HEAVY + 1, dtype=np.int64)) + np.append(bits, len(own))
        for f, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([c.tolist()], pa.list_(pa.int64()))], names=["field_name", "counters"])

    by_record = sets.mapInArrow(count_bits, "field_name string, counters array<long>")
    by_record = by_record.select("field_name", F.posexplode("counters").alias("i", "n")).groupBy("field_name", "i").agg(F.sum("n").alias("n_records"))
    by_row = parted.where(F.col("counters").isNotNull()).select("field_name", F.posexplode("counters").alias("i", "n"))
    by_row = by_row.groupBy("field_name", "i").agg(F.sum("n").alias("n_occurrences"))
    # All of these have at most (HEAVY + 1) rows a field.
    names = spark.createDataFrame([(f, i, t) for f, ts in heavy.items() for i, t in enumerate(ts)], "field_name string, i int, term string")
    by_record = spark.createDataFrame(by_record.collect(), by_record.schema)
    totals = by_record.where(F.col("i") == HEAVY).select("field_name", F.col("n_records").alias("total_records"))
    heavy_table = (
        names.join(by_row, ["field_name", "i"])
        .join(by_record, ["field_name", "i"], "left")
        .select("field_name", "term", "n_occurrences", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"))
    )
    union = light.unionByName(heavy_table.where(F.col("n_occurrences") > 0))
    return union.join(totals, "field_name", "left").withColumn("total_records", F.coalesce("total_records", F.lit(0)).cast("long"))


def mark_terms(counts: DataFrame, rare_below: int = 5, common_above: float = 0.05) -> DataFrame:
    """Add ``mark``: 'rare' in fewer than ``rare_below`` records, 'common' in more than that share of all, else null."""
    return counts.withColumn(
        "mark",
        F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.col("total_records") * common_above, "common"),
    )
