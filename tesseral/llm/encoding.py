"""Encoding a corpus with a public byte-level BPE tokenizer (problem 7).

Method: overlapping chunk encoding.  Texts over CHUNK characters are cut in the JVM into chunks that overlap by
OVERLAP, so that one very long text is encoded by many tasks.  Each chunk is pre-tokenised and its pre-tokens are
encoded; two neighbours are stitched at the first position in their overlap where both have a pre-token boundary:
from there on they agree, since pre-tokenisation looks ahead only.  Where no boundary resynchronises (an unbroken
run over the whole overlap) the chunk is joined with the next one, two, four and so on, each time pre-tokenised once.  Shorter texts are encoded where they lie,
without a shuffle.  Decoding concatenates the raw bytes of the ids.

Defined results: an empty and a null text give an empty list; special-token strings are ordinary text; repeated
rows are encoded alike.  The vocabulary file is a parameter, read by the driver and broadcast (under 1 MB).
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TESSERAL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
CHUNK, OVERLAP = 4096, 256
LOOKAHEAD = 4  # a boundary this far from a chunk's end doesn't depend on what follows the chunk
MAX_VOCABULARY_BYTES = 16_000_000
# Fixed value: the byte-level BPE family's pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))


@lru_cache(2)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file exceeds the bound for broadcasts")
    return spark.sparkContext.broadcast(data)


@lru_cache(1)
def other_classes() -> tuple[tuple[int, int, str], ...]:
    """Ranges of characters that the tokenizer's own engine puts in another class than this one's Unicode tables do.

    Found by asking it for the letters and the numbers among all characters; the sign stands in for a range's class
    when cutting.  Found once by the driver, which sends them to the tasks.
    """
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
    theirs, ours = {}, {}
    for c in "LN":
        probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{c}}}+", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs[c], ours[c] = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(rf"\p{{{c}}}", every))
    out: list[tuple[int, int, str]] = []
    for x in sorted((theirs["L"] ^ ours["L"]) | (theirs["N"] ^ ours["N"])):
        sign = "x" if x in theirs["L"] else "0" if x in theirs["N"] else "."
        if out and out[-1][1] == ord(x) - 1 and out[-1][2] == sign:
            out[-1] = (out[-1][0], ord(x), sign)
        else:
            out.append((ord(x), ord(x), sign))
    return tuple(out)


@lru_cache(2)
def _substitutes(ranges: tuple[tuple[int, int, str], ...]) -> tuple[re.Pattern | None, dict[int, str]]:
    odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b, _ in ranges)
    return (re.compile(f"[{odd}]") if odd else None), {i: sign for a, b, sign in ranges for i in range(a, b + 1)}


def pre_tokens(text: str, ranges: tuple[tuple[int, int, str], ...] | None = None) -> list[str]:
    """The pieces that the tokenizer encodes by themselves, cut where its own pre-tokeniser cuts."""
    if not text.isascii():
        odd, table = _substitutes(other_classes() if ranges is None else ranges)
        if odd is not None and odd.search(text):
            out, at = [], 0
            for p in _SPLIT.findall(text.translate(table)):
                out.append(text[at : at + len(p)])
                at += len(p)
            return out
    return _SPLIT.findall(text)


def encode_chunk(enc, text: str, cache: dict[str, list[int]], ranges: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the pre-tokens, the place of each one's first id, and the ids."""
    starts, first, ids, at = [], [], [], 0
    for p in pre_tokens(text, ranges):
        got = cache.get(p)
        if got is None:
            got = enc.encode_ordinary(p)
            if len(cache) < 200_000:
                cache[p] = got
        starts.append(at)
        first.append(len(ids))
        ids += got
        at += len(p)
    return np.asarray(starts, np.int64), np.asarray(first, np.int64), np.asarray(ids, np.int32)


def stitch(enc, chunks: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], step: int, ranges: tuple | None = None) -> list[int]:
    """The ids of a text from its chunks (text, starts, first, ids), the i-th beginning at i * step."""
    out: list[np.ndarray] = []
    base, (text, starts, first, ids), begin = 0, chunks[0], 0  # begin: start within the current chunk that is settled
    i, grow = 1, 1
    while i < len(chunks):
        nxt, at = chunks[i], i * step
        mine, theirs = starts + base, nxt[1] + at
        ok = (mine >= max(at, base + begin)) & (mine <= base + len(text) - LOOKAHEAD)
        common = np.intersect1d(mine[ok], theirs, assume_unique=True)
        if len(common):
            q = int(common[0])
            a, b = np.searchsorted(mine, base + begin), np.searchsorted(mine, q)
            out.append(ids[(first[a] if a < len(first) else len(ids)) : (first[b] if b < len(first) else len(ids))])
            base, (text, starts, first, ids), begin = at, nxt, q - at
            i, grow = i + 1, 1
        else:  # no resynchronisation: joined with twice as many chunks as the last time, so the work stays linear
            more, end = [text[begin:]], base + len(text)
            for j in range(i, min(i + grow, len(chunks))):
                more.append(chunks[j][0][end - j * step :])
                end = j * step + len(chunks[j][0])
            base, begin, text = base + begin, 0, "".join(more)
            starts, first, ids = encode_chunk(enc, text, {}, ranges)
            i, grow = i + grow, grow * 2
    a = np.searchsorted(starts, begin)
    out.append(ids[(first[a] if a < len(first) else len(ids)) :])
    return np.concatenate(out).tolist()


def _encode_short(vocabulary: Broadcast, key: str, text: str, what):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "out": [what(enc.encode_ordinary(t)) if isinstance(t, str) and t else what([]) for t in b[text]]})

    return run


def _encode(docs: DataFrame, key: str, text: str, path: str, chunk: int, overlap: int, what, kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary, classes = read_vocabulary(spark, path), other_classes()  # some hundred ranges
    rows, size = docs.select(key, text), F.coalesce(F.char_length(F.col(text)), F.lit(0))
    key_type = rows.schema[key].dataType.simpleString()
    short = rows.where(size <= chunk + overlap).mapInPandas(_encode_short(vocabulary, key, text, what), f"`{key}` {key_type}, out {kind}")
    # a copy of a row, or two rows under one key, stay apart: the row's own number is part of the chunk's key
    long = rows.where(size > chunk + overlap).withColumn("__row", F.monotonically_increasing_id())
    at = F.explode(F.sequence(F.lit(0), ((F.char_length(F.col(text)) - 1 - overlap) / chunk).cast("int")))
    pieces = long.withColumn("__i", at).select(key, "__row", "__i", F.substring(F.col(text), F.col("__i") * chunk + 1, F.lit(chunk + overlap)).alias("__t"))
    pieces = pieces.repartition("__row", "__i")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, cache = encoder(vocabulary.value), {}
        for b in batches:
            done = [encode_chunk(enc, t, cache, classes) for t in b["__t"]]
            yield b.assign(starts=[d[0] for d in done], first=[d[1] for d in done], ids=[d[2] for d in done])

    def join(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("__i")
        ids = stitch(encoder(vocabulary.value), list(zip(b["__t"], b["starts"], b["first"], b["ids"])), chunk, classes)
        return pd.DataFrame({key: [b[key].iloc[0]], "out": [what(ids)]})

    encoded = pieces.mapInPandas(encode, f"`{key}` {key_type}, __row long, __i int, __t string, starts array<long>, first array<long>, ids array<int>")
    stitched = encoded.groupBy("__row").applyInPandas(join, f"`{key}` {key_type}, out {kind}")
    return short.unionByName(stitched)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens."""
    return _encode(docs, key, text, path, chunk, overlap, list, "array<int>").select(key, F.col("out").alias("ids"))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, tokens): the number of ids of every row's text; the ids stay in the tasks."""
    return _encode(docs, key, text, path, CHUNK, OVERLAP, len, "long").select(key, F.col("out").alias("tokens"))


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(key, text): the raw bytes of the ids concatenated, as UTF-8; null ids give null."""
    vocabulary = read_vocabulary(encoded.sparkSession, path)
    rows = encoded.select(key, ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [None if x is None else enc.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in b[ids]]})

    return rows.mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
