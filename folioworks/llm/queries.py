"""The queries of the operators in this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.container_packing import container_fill, pack_documents, tokenizer_path
from folioworks.llm.entity_matching import CONFIDENT, LEAST_TITLE, match_entities
from folioworks.llm.eval_leakage import clean_documents, leaked_passages
from folioworks.llm.language_segments import labelled_sample, language_segments, train_profiles
from folioworks.llm.term_frequency import canonical_terms, mark_terms, term_counts
from folioworks.operators.packed_fields import with_packed_values
from folioworks.session import table


def _p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "stories").select(F.lit("tags").alias("field_name"), F.col("story_id").alias("record"), F.col("tags").alias("value"))
    cats = table(spark, sf_dir, "story_meta").select(F.lit("category").alias("field_name"), F.col("meta_id").alias("record"), F.col("category").alias("value"))
    split = with_packed_values(tags.unionByName(cats), "value", "terms").select("field_name", "record", "terms")
    return mark_terms(term_counts(canonical_terms(split, "terms"), "field_name", "record", "terms"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its counts."""
    return _p1_counts(spark, sf_dir).select("field_name", "term", "n_occurrences", "n_records", "mark")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs of library books and reported works with their confidence."""
    books = with_packed_values(table(spark, sf_dir, "library_books"), "tags", "tag_list").select(
        F.col("book_key").alias("key"), "title", "author", "site", F.col("summary").alias("text"), F.col("release_year").alias("year"), F.col("tag_list").alias("tags"), (F.col("pages_count") * 300).alias("size")
    )
    year = F.regexp_extract("datepublished", r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    works = with_packed_values(table(spark, sf_dir, "story_meta"), "eroticatags", "tag_list").select(
        F.col("meta_id").alias("key"), "title", "author", "site", F.col("description").alias("text"), year.alias("year"), F.col("tag_list").alias("tags"), F.col("numwords").alias("size")
    )
    return match_entities(books, works).select(F.col("left_key").alias("book_key"), F.col("right_key").alias("meta_id"), "title", "author", "site", "year", "tags", "length", "text", "score", "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).where((F.col("confidence") >= CONFIDENT) & (F.col("title") >= LEAST_TITLE)).select("book_key", "meta_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document went into which container, sized in tokens of byte_bpe_50k."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), tokenizer_path())


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return container_fill(p6_containers(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its length and place."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole, that remain once every leaking row is removed."""
    return clean_documents(table(spark, sf_dir, "documents"), p7_matches(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents whose label is missing, names no language or another than most words are in, or that have several."""
    wrong = ~F.col("label_lang").eqNullSafe(F.col("main_lang"))
    return p8_segments(spark, sf_dir).where(wrong | (F.col("n_segments") > 1)).select("doc_id", "seg_no", "seg_lang")


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document."""
    docs = table(spark, sf_dir, "documents")
    return language_segments(docs, train_profiles([], labelled_sample(docs)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
