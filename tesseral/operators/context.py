"""Memory carried along a document's chunks, as window frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C


def chunk_keys(rows: DataFrame) -> DataFrame:
    """(document_id, chunk_index) of the chunks named by rows (doc_id, document_id)."""
    index = F.regexp_extract("doc_id", r"_chunk_(\d+)$", 1)
    return rows.where("doc_id is not null and document_id is not null").where(index != "").select("document_id", index.cast("int").alias("chunk_index")).distinct()


def memory(mentions: DataFrame, last: int = 10, chunks: DataFrame | None = None) -> DataFrame:
    """(document_id, dimension_name, chunk_index, seen, refs): what chunks before this one left: the last mentions of each dimension.

    Mentions are folded into one array a chunk first; a chunk's frame then spans earlier chunks, never its own.
    chunks: (doc_id, document_id) of all chunks; each has a row for every dimension of its document then, also where
    it has no mention of its own.  Without it, rows are those of chunks that mention the dimension.
    """
    index = F.regexp_extract("doc_id", r"_chunk_(\d+)$", 1)
    m = mentions.where("doc_id is not null and document_id is not null and text is not null").where(index != "").select("document_id", "dimension_name", index.cast("int").alias("chunk_index"), "mention_id", "text").distinct()
    per = m.groupBy("document_id", "dimension_name", "chunk_index").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("mention_id", "text")))), 1, last).alias("own"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("document_id", "dimension_name").orderBy("chunk_index")
    upto = w.rowsBetween(1 - last, 0)  # `last` chunks hold at least `last` mentions, if there are as many
    left = per.select("document_id", "dimension_name", "chunk_index", F.slice(F.flatten(F.reverse(F.collect_list("own").over(upto))), 1, last).alias("left"), F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"))
    if chunks is not None:
        every = chunk_keys(chunks.select("doc_id", "document_id").unionByName(mentions.select("doc_id", "document_id")))
        left = every.join(per.select("document_id", "dimension_name").distinct(), "document_id").join(left, ["document_id", "dimension_name", "chunk_index"], "left")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    refs = F.coalesce(F.last("left", ignorenulls=True).over(before), F.array().cast("array<struct<mention_id:bigint,text:string>>"))
    seen = F.coalesce(F.last("total", ignorenulls=True).over(before), F.lit(0).cast("long"))
    return left.select("document_id", "dimension_name", "chunk_index", seen.alias("seen"), F.array_join(F.transform(F.reverse(refs), lambda x: x["text"]), "; ").alias("refs"))


def anchor_dates(mentions: DataFrame, published: DataFrame) -> DataFrame:
    """(document_id, chunk_index, anchor): the latest dated mention of an earlier chunk, else the document's own date."""
    index = F.regexp_extract("doc_id", r"_chunk_(\d+)$", 1)
    m = mentions.where("doc_id is not null and document_id is not null").where(index != "").select("document_id", index.cast("int").alias("chunk_index"), F.when(F.col("dimension_name") == "temporal", C.iso_date("normalized")).alias("d"), "mention_id")
    per = m.groupBy("document_id", "chunk_index").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("mention_id"))).alias("d"))
    w = W.partitionBy("document_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    out = per.select("document_id", "chunk_index", F.last("d", ignorenulls=True).over(w).alias("d"))
    own = published.groupBy("document_id").agg(F.min(C.iso_date("date")).alias("own"))
    return out.join(own, "document_id", "left").select("document_id", "chunk_index", F.date_format(F.coalesce("d", "own"), "yyyy-MM-dd").alias("anchor"))


def prompt_lines(memory_rows: DataFrame, last: int = 5) -> DataFrame:
    """(document_id, chunk_index, prompt): the last references of each dimension as one text, dimensions in order."""
    refs = F.split("refs", "; ")
    shown = F.array_join(F.slice(refs, F.greatest(F.size(refs) - last + 1, F.lit(1)), last), ", ")
    line = F.when(F.col("refs") != "", F.concat(F.col("dimension_name"), F.lit(": "), shown))
    g = memory_rows.select("document_id", "chunk_index", F.struct("dimension_name", line.alias("line")).alias("l")).groupBy("document_id", "chunk_index")
    return g.agg(F.array_sort(F.collect_list("l")).alias("ls")).select("document_id", "chunk_index", F.array_join(F.array_compact(F.transform("ls", lambda x: x["line"])), "\n").alias("prompt"))
