"""Queries of the subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import boilerplate, canonical, encoding, language, names, packing, splitting
from tesseral.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found_cuts(table(spark, sf_dir, "document_chunks", "doc_id", "text"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all chunk texts, with the chunk's section_hierarchy; copies of a row count once."""
    chunks = table(spark, sf_dir, "document_chunks", "doc_id", "text", "section_hierarchy").distinct()
    pieces = splitting.split_oversized(chunks)
    return pieces.select("doc_id", "piece_index", "pieces", F.col("piece_start").alias("start_char"), F.col("piece_end").alias("end_char"), "section_hierarchy", F.col("piece_text").alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, document_id, host, site, title and content of the pages of both tables."""
    names = table(spark, sf_dir, "sources", "source", "host", "source_name")
    columns = ["document_id", "title", "source", "metadata", "content"]
    parsed = table(spark, sf_dir, "parsed_documents", *columns).withColumn("tbl", F.lit("parsed_documents"))
    given = table(spark, sf_dir, "input_documents", "input_type", *columns).where("input_type = 'text'").drop("input_type").withColumn("tbl", F.lit("input_documents"))
    pages = parsed.unionByName(given).join(names, "source", "left")
    return pages.select("tbl", "document_id", F.coalesce("host", "source").alias("host"), F.coalesce(F.col("metadata")["publisher"], F.col("source_name")).alias("site"), "title", "content")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(_pages(spark, sf_dir), ["tbl", "document_id"])


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page; null where a page has none."""
    return boilerplate.main_body(_pages(spark, sf_dir), ["tbl", "document_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions", "mention_id", "dimension_name", "category")
    return canonical.found_entries(mentions, table(spark, sf_dir, "category_ref"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions", "mention_id", "dimension_name", "text").where("dimension_name in ('person', 'organization')")
    return names.linked_pairs(mentions.selectExpr("mention_id id", "dimension_name kind", "text"))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each named mention with its entity and the number of mentions linked to it; no pairs are listed."""
    mentions = table(spark, sf_dir, "mentions", "mention_id", "dimension_name", "text").where("dimension_name in ('person', 'organization')")
    return names.name_members(mentions.selectExpr("mention_id id", "dimension_name kind", "text"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encoding.token_counts(table(spark, sf_dir, "documents", "doc_id", "text")))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_containers(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found_languages(table(spark, sf_dir, "documents", "doc_id", "lang", "text"))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of all documents with language and confidence."""
    return language.language_segments(table(spark, sf_dir, "documents", "doc_id", "lang", "text"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_bodies": p2_bodies, "p3_found": p3_found, "p6_found": p6_found, "p6_members": p6_members, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p9_found": p9_found, "p9_segments": p9_segments}


def oracle_sql() -> dict[str, str]:
    return {}
