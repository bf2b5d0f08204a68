"""Splitting oversized texts at natural boundaries (problem 1).

Method: pointer doubling.  Every boundary of a text (paragraph, sentence and word starts, and the points of
forced cuts inside unbroken runs) is joined to its farthest legal successor: the last paragraph start within
reach, else the last sentence start, else the last word start, else the reach itself, where the reach is the
limit less the overlap.  The successor table is then squared again and again; the nodes reached from 0 with
tables of 1, 2, 4, ... steps are all cuts of the greedy walk, found for all texts of an Arrow batch at once in
log2(longest walk) array operations.  Each text is a unit of its own, so nothing is shuffled.

Defined results: null, empty, blank and short texts (at most the limit) have no cut and stay one piece (null
and empty texts: no piece); repeated rows are cut alike; positions count code points.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150

# Abbreviations whose dot never ends a sentence, since a name, number or clause follows them.
OPEN_ABBREVIATIONS = frozenset(
    "i.e e.g cf sec fig figs vol no nos pp p ref refs approx ca dr prof mr mrs ms mx st mt ft rev hon gen col capt lt sgt "
    "vs viz eq eqs ch chap art para ed eds dept tel ext z.b d.h u.a bzw vgl nr abs bd sr sra dra av ul im dhr mevr bijv".split()
)
# Abbreviations that may stand at a sentence's end; their dot counts where a capital follows.
FINAL_ABBREVIATIONS = frozenset("a.m p.m u.n u.s u.k e.u etc al inc ltd co corp jr usw ff".split())

_RUN = re.compile(r"\s+(?=\S)")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_END = re.compile(r"[.!?…。！？]+[\"'”’»«›)\]}]*$")
_OPENERS = "\"'“„‘«‹([{¿¡-"


def _ends_sentence(text: str, at: int, after: int) -> bool:
    """Whether the text before position at, with a start at after, ends a sentence."""
    last = text[at - 1]
    if last not in ".!?…。！？\"'”’»«›)]}":
        return False
    tail = text[max(0, at - 48) : at]
    found = _END.search(tail)
    if not found:
        return False
    if found.group(0)[0] != "." or found.group(0) != ".":  # "!", "?", "...", or closed by a quote or bracket
        return True
    head = tail[: found.start()]
    cut = max((head.rfind(c) for c in " \n\t\r\xa0"), default=-1)
    token, at_line_start = head[cut + 1 :].lstrip(_OPENERS), cut < 0 and at <= 48 or cut >= 0 and head[cut] == "\n" or not head[: cut + 1].strip()
    if not token:
        return True
    low = token.lower()
    if low in OPEN_ABBREVIATIONS or (len(token) == 1 and token.isalpha() and token.isupper()):
        return False
    if low in FINAL_ABBREVIATIONS or re.fullmatch(r"(?:\w\.)+\w", token):
        nxt = text[after : after + 2].lstrip(_OPENERS)[:1]
        return nxt.isupper()
    return not (token.isdigit() and at_line_start)  # "2. Methods": a number at the start of a line


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all word starts but 0, and their rank: 3 paragraph, 2 sentence, 1 word."""
    pos, rank = [], []
    for m in _RUN.finditer(text):
        a, b = m.span()
        breaks = 0
        if b - a > 1 or text[a] not in " \t\xa0":
            breaks = len(_BREAK.findall(text, a, b))
        if breaks >= 2 or (breaks and a == 0):
            rank.append(3)
        elif breaks or (a and _ends_sentence(text, a, b)):
            rank.append(2)
        else:
            rank.append(1)
        pos.append(b)
    return np.asarray(pos, np.int64), np.asarray(rank, np.int8)


def _last_within(starts: np.ndarray, nodes: np.ndarray, reach: int) -> np.ndarray:
    """For each node the last start in (node, node + reach], or -1."""
    if not len(starts):
        return np.full(len(nodes), -1, np.int64)
    k = np.searchsorted(starts, nodes + reach, "right") - 1
    best = starts[np.maximum(k, 0)]
    return np.where((k >= 0) & (best > nodes), best, -1)


def batch_cuts(texts: list[str | None], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[int]]:
    """The cuts of each text, by pointer doubling over the boundaries of all of them."""
    own = limit - overlap
    if own <= 0:
        raise ValueError("the overlap must be smaller than the limit")
    out: list[list[int]] = [[] for _ in texts]
    long = [i for i, t in enumerate(texts) if isinstance(t, str) and len(t) > limit]
    if not long:
        return out
    base, ends, at, starts, ranks = [], [], 0, [], []
    for i in long:
        p, r = boundaries(texts[i])
        base.append(at)
        ends.append(at + len(texts[i]))
        starts.append(p + at)
        ranks.append(r)
        at = ends[-1] + 2 * own + 2  # no window reaches the next text
    base, ends = np.asarray(base), np.asarray(ends)
    word, rank = np.concatenate(starts), np.concatenate(ranks)
    nodes = np.union1d(word, base)
    # forced cuts: from a node whose next start, or text end, lies beyond reach
    end_of = ends[np.searchsorted(base, nodes, "right") - 1]
    k = np.searchsorted(word, nodes, "right")
    nxt = np.where(k < len(word), word[np.minimum(k, len(word) - 1)] if len(word) else 0, end_of) if len(word) else end_of
    gap = np.minimum(nxt, end_of) - nodes
    n = np.maximum((gap - 1) // own, 0)
    if n.sum():
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        nodes = np.union1d(nodes, np.repeat(nodes, n) + step * own)
    end_of = ends[np.searchsorted(base, nodes, "right") - 1]
    best = nodes + own
    for level in (1, 2, 3):  # a higher rank takes precedence over a farther lower one
        found = _last_within(word[rank >= level], nodes, own)
        best = np.where(found >= 0, found, best)
    to = np.searchsorted(nodes, best)
    to = np.where(end_of - nodes > own, np.minimum(to, len(nodes) - 1), np.arange(len(nodes)))  # the last piece: to itself
    reached = np.searchsorted(nodes, base)
    while True:
        more = np.union1d(reached, to[reached])
        if len(more) == len(reached):
            break
        reached, to = more, to[to]
    cuts = np.setdiff1d(nodes[reached], base)
    owner = np.searchsorted(base, cuts, "right") - 1
    for c, o in zip(cuts.tolist(), owner.tolist()):
        out[long[o]].append(c - int(base[o]))
    return out


def cut_positions(text: Column | str, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<int>: the cuts of a text; empty where nothing is to be cut, null texts included."""

    @F.pandas_udf("array<int>")
    def cuts(s: pd.Series) -> pd.Series:
        return pd.Series(batch_cuts(s.tolist(), limit, overlap), index=s.index, dtype=object)

    return cuts(text)


def _oversized(df: DataFrame, text: str, limit: int) -> DataFrame:
    # the length test runs in the JVM, so that only texts over the limit travel to Python
    return df.where(F.char_length(F.col(text)) > limit)


def found_cuts(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, cut_at): each place where a text over the limit is divided; copies of a row count once."""
    cuts = _oversized(df.select(key, text), text, limit).select(key, F.explode(cut_positions(text, limit, overlap)).alias("cut_at"))
    return cuts.select(key, F.col("cut_at").cast("long").alias("cut_at")).distinct()


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All columns of df with piece_index, pieces, piece_text, piece_start, piece_end: one row for each piece.

    A piece is the slice [piece_start, piece_end) of the text, at most limit long.  Its first characters repeat
    up to overlap characters of the piece before, from a word start on (inside an unbroken run: exactly overlap).
    Slices are taken in the JVM; Python only sees the texts over the limit and returns positions.
    Rows with a null or empty text give no piece.  Columns of those names in df are replaced.
    """
    own = [c for c in df.columns if c not in ("piece_index", "pieces", "piece_text", "piece_start", "piece_end")]
    size, none = F.char_length(F.col(text)), F.array().cast("array<int>")
    rows = df.select(*own).where(size > 0)
    long = rows.where(size > limit).withColumn("__cuts", cut_positions(text, limit, overlap))
    rows = rows.where(size <= limit).withColumn("__cuts", none).unionByName(long)
    bounds = F.concat(F.array(F.lit(0)), F.col("__cuts"), F.array(size.cast("int")))
    rows = rows.withColumn("__b", bounds).withColumn("pieces", F.size("__b") - 1)
    rows = rows.select(*own, "pieces", "__b", F.posexplode(F.slice("__b", 1, F.size("__b") - 1)).alias("piece_index", "__own"))
    end = F.element_at("__b", F.col("piece_index") + 2)
    lead = F.substring(F.col(text), F.greatest(F.col("__own") - overlap, F.lit(0)) + 1, F.least(F.col("__own"), F.lit(overlap)))
    skip = F.when(F.col("__own") == 0, 0).otherwise(F.char_length(F.regexp_extract(lead, r"(?Us)^\S*\s+(?=\S)", 0)))
    start = F.when(F.col("__own") == 0, 0).otherwise(F.greatest(F.col("__own") - overlap, F.lit(0)) + skip)
    rows = rows.withColumn("piece_start", start.cast("int")).withColumn("piece_end", end)
    rows = rows.withColumn("piece_text", F.substring(F.col(text), F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")))
    return rows.select(*own, "piece_index", "pieces", "piece_start", "piece_end", "piece_text")
