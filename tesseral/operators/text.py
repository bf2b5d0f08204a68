"""Generators and scalar text operators: chunkers, page and table parsing, JSON in free text, keywords."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C

CHUNK = "chunk_index int, total_chunks int, start_char int, end_char int, text string"
SKIPPED = frozenset("script style nav footer header noscript template".split())
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol blockquote main".split())


def sliding_windows(text: str, limit: int, overlap: int, look_back: int = 200) -> list[tuple[int, int]]:
    """Windows of at most limit, ended at the last dot or line end of the trailing look_back, each starting overlap before the end."""
    if overlap + look_back >= limit:
        look_back = max(0, limit - overlap - 1)
    out, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            cut = max(text.rfind(".", end - look_back, end), text.rfind("\n", end - look_back, end))
            if cut > start:
                end = cut + 1
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def paragraph_groups(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Runs of paragraphs that fit the limit; a longer paragraph falls back to windows."""
    spans, at = [], 0
    for part in re.split(r"(\n\n+)", text):
        if part.strip():
            spans.append((at, at + len(part)))
        at += len(part)
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if b - a > limit:
            out += [(a + s, a + e) for s, e in sliding_windows(text[a:b], limit, overlap)]
        elif out and b - out[-1][0] <= limit and out[-1][1] <= a and out[-1][1] - out[-1][0] <= limit and not (out[-1][1] - out[-1][0] == limit):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


STRATEGIES = {"sliding": sliding_windows, "paragraph": paragraph_groups, "semantic": paragraph_groups}


def chunked(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200, strategy: str = "sliding") -> DataFrame:
    """key, chunk_index, total_chunks, start_char, end_char, text: chunks of every text; null and empty texts have none.

    Offsets come from Python for texts over the limit only; slices are taken in the JVM.
    """
    find = STRATEGIES[strategy]

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e} for s, e in find(t, limit, overlap)] for t in texts])

    t, n = F.col(text), F.char_length(F.col(text))
    rows = df.select(key, text).where(n > 0)
    whole = F.array(F.struct(F.lit(0).alias("s"), n.cast("int").alias("e"))).cast("array<struct<s:int,e:int>>")
    both = rows.where(n <= limit).withColumn("w", whole).unionByName(rows.where(n > limit).withColumn("w", spans(t)))
    out = both.select(key, text, F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "x"))
    return out.select(key, "chunk_index", "total_chunks", F.col("x.s").alias("start_char"), F.col("x.e").alias("end_char"), F.substring(F.col(text), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("text"))


def element_chunks(sections: DataFrame, key: str = "document_id", limit: int = 1500) -> DataFrame:
    """key, chunk_index, section_hierarchy, text from (key, pos, type, level, text): a chunk begins at each title or table,
    and where the limit is met; the hierarchy is the stack of titles."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, stack, part, size, path = [], [], [], 0, ""

        def close():
            nonlocal part, size
            if part:
                out.append((path, "\n\n".join(part)))
            part, size = [], 0

        for kind, level, text in zip(pdf["type"], pdf["level"], pdf["text"]):
            if not text or not str(text).strip():
                continue
            if kind in ("title", "table") or size >= limit:
                close()
            if kind == "title":
                level = int(level) if level == level and level is not None else 1
                stack = [x for x in stack if x[0] < level] + [(level, text)]
            path = " > ".join(x[1] for x in stack)
            part.append(text)
            size += len(text)
        close()
        return pd.DataFrame([(pdf[key].iloc[0], i, p, t) for i, (p, t) in enumerate(out)], columns=[key, "chunk_index", "section_hierarchy", "text"])

    return sections.groupBy(key).applyInPandas(build, f"{key} string, chunk_index int, section_hierarchy string, text string")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.h1, self.out, self.skip, self.inside = "", "", [], 0, []

    def handle_starttag(self, tag, attrs):
        self.inside.append(tag)
        self.skip += tag in SKIPPED
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside and (last := self.inside.pop()) != tag:
                self.skip -= last in SKIPPED
            self.skip -= tag in SKIPPED
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        elif not self.skip:
            if "h1" in self.inside:
                self.h1 += data
            self.out.append(data)


def parse_html(html: str) -> tuple[str, str]:
    """Title (or first heading) and text of a page, a line for each block; navigation, scripts and the like left out."""
    p = _Page()
    p.feed(html)
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
    return " ".join((p.title or p.h1).split()), "\n".join(x for x in lines if x)


def parsed_pages(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, content, error: rows whose page can't be parsed carry the error and null content."""
    rows = df.select(key, html)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b[key], b[html]):
                try:
                    out.append((k, *(parse_html(h) if h is not None else (None, None)), None if h is not None else "no page"))
                except Exception as e:  # a page must not end the task
                    out.append((k, None, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "title", "content", "error"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, title string, content string, error string")


def json_in_text(text: str | None) -> str | None:
    """The last balanced JSON object or array in a text, code fences and thoughts aside; None if there is none."""
    if not text:
        return None
    s = re.sub(r"(?s)<think>.*?</think>", "", text)
    decoder, found, at = json.JSONDecoder(), None, 0
    while (m := re.compile(r"[{\[]").search(s, at)) is not None:
        try:
            value, end = decoder.raw_decode(s, m.start())
            found, at = json.dumps(value, ensure_ascii=False), end
        except ValueError:
            at = m.start() + 1
    return found


def json_column(c):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(json_in_text)

    return run(c)


def keywords(df: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """(key, keyword, n, rank): the most frequent words of each text, ties by first place; a text's words stay in its own row's group."""
    w = df.where(F.col(text).isNotNull()).select(key, F.posexplode(C.words(text)).alias("pos", "keyword")).where(~F.col("keyword").isin(*C.STOP_WORDS))
    n = w.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = W.partitionBy(key).orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "keyword", "n", "rank")
