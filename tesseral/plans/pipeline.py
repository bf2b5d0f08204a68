"""The document pipeline with plug-ins for what models do: parse, chunk, extract, resolve, analyse."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.operators import analysis, text

MENTIONS = "doc_id string, document_id string, dimension_name string, text string, confidence double, normalized string, category string"


class Extractor(Protocol):
    """Mentions (dimension, text, confidence, normalized, category) of a text; run in tasks, so it must be picklable."""

    def __call__(self, text: str, metadata: dict) -> list[tuple[str, str, float, str | None, str | None]]: ...


class Generator(Protocol):
    def __call__(self, question: str, context: str) -> str: ...


def rule_extractor(text: str, metadata: dict) -> list[tuple[str, str, float, str | None, str | None]]:
    """Dates in ISO form and places after a preposition: a deterministic stand-in for a model."""
    out = [("temporal", m, 0.95, m, None) for m in re.findall(r"\b\d{4}-\d{2}-\d{2}\b", text)]
    return out + [("spatial", m, 0.95, None, None) for m in re.findall(r"\b(?:in|at|near|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)", text)]


def first_sentence(question: str, context: str) -> str:
    """The stand-in for a generator."""
    return context.split(".")[0] + "." if context else ""


def chunks_of(documents: DataFrame, limit: int = 2000, overlap: int = 200, strategy: str = "sliding") -> DataFrame:
    """Chunks of (document_id, content) with ids <document_id>_chunk_<n>."""
    c = text.chunked(documents, "document_id", "content", limit, overlap, strategy)
    return c.withColumn("doc_id", F.concat_ws("_", "document_id", F.lit("chunk"), F.col("chunk_index").cast("string")))


def extracted(chunks: DataFrame, extractor: Extractor = rule_extractor, least: int = 10) -> DataFrame:
    """Mentions of chunks (doc_id, document_id, text); a text the extractor fails on gives one row with dimension "error"."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, doc, t in zip(b["doc_id"], b["document_id"], b["text"]):
                try:
                    rows += [(d, doc, *m) for m in extractor(t, {"document_id": doc})]
                except Exception as e:  # one text must not end the task
                    rows.append((d, doc, "error", str(e), 0.0, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "document_id", "dimension_name", "text", "confidence", "normalized", "category"])

    return chunks.where(F.char_length("text") >= least).select("doc_id", "document_id", "text").mapInPandas(run, MENTIONS)


def answered(questions: DataFrame, generator: Generator = first_sentence) -> DataFrame:
    """(question_id, answer, citations) for (question_id, question, context)."""

    @F.pandas_udf("string")
    def answer(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([generator(x or "", y or "") for x, y in zip(q, c)])

    a = F.regexp_replace(answer("question", "context"), r"(?i)^(?:the answer is|answer)\s*:?\s*", "")
    return questions.select("question_id", a.alias("answer")).withColumn("citations", F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[Document\s+(\d+)\]"), F.lit(1))))


def run(documents: DataFrame, extractor: Extractor = rule_extractor) -> dict[str, DataFrame]:
    """Chunks, mentions and statistics of documents (document_id, content)."""
    chunks = chunks_of(documents)
    mentions = extracted(chunks, extractor)
    return {"chunks": chunks, "mentions": mentions, "timeline": analysis.temporal_timeline(mentions), "co_occurrence": analysis.cross_dimensional(mentions, F.col("text"))}
