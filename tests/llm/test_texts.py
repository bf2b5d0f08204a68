"""Splitting, encoding and packing against brute force and exact round trips."""

import bisect
import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesseral.llm import encoding, packing, splitting

LETTERS = st.text(alphabet="abAB .!?\n\r\t\"'é中🔥0", max_size=400)


def greedy(text, limit, overlap):
    own, s, out = limit - overlap, 0, []
    if len(text) <= limit:
        return out
    pos, rank = splitting.boundaries(text)
    while len(text) - s > own:
        for level in (3, 2, 1):
            z = [p for p, r in zip(pos.tolist(), rank.tolist()) if s < p <= s + own and r >= level]
            if z:
                s = z[-1]
                break
        else:
            s += own
        out.append(s)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=5), st.integers(2, 60), st.integers(0, 30))
def test_doubling_equals_the_greedy_walk(texts, limit, overlap):
    overlap = min(overlap, limit - 1)
    assert splitting.batch_cuts([*texts, None, ""], limit, overlap) == [*[greedy(t, limit, overlap) for t in texts], [], []]


def test_boundaries():
    def ranks(t):
        p, r = splitting.boundaries(t)
        return {t[a:].split()[0]: int(b) for a, b in zip(p, r)}

    got = ranks('He met Dr. Smith (e.g. at St. Ives, No. 3) at 9.30 a.m. on Monday. "Was it so?" Yes.\nLine two.\n \nPara J. R. Moe saw file_v2.1.txt rise 3.7 m in Sec. 5.5. End')
    assert {k: got[k] for k in ("Smith", "at", "Ives,", "on", "Moe", "m", "5.5.")} == {"Smith": 1, "at": 1, "Ives,": 1, "on": 1, "Moe": 1, "m": 1, "5.5.": 1}
    assert got['"Was'] == got["Yes."] == got["Line"] == got["End"] == 2 and got["Para"] == 3
    assert ranks("2. Methods were used. Then")["Methods"] == 1 and ranks("a b.)  Next")["Next"] == 2


def test_pieces(spark):
    long = ("word " * 50 + ".\n\n") * 20
    rows = [("a", long, "x"), ("a", long, "x"), ("b", "short", None), ("c", None, None), ("d", "", None), ("e", "z" * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, piece_index string")
    got = splitting.split_oversized(df).collect()
    by = {}
    for r in got:
        assert len(r["piece_text"]) <= 1500
        by.setdefault(r["doc_id"], {})[r["piece_index"]] = r
    assert set(by) == {"a", "b", "e"} and len(by["b"]) == 1
    for key, text in (("a", long), ("e", "z" * 4000)):
        ps = [by[key][i] for i in sorted(by[key])]
        cuts = [0, *greedy(text, 1500, 150), len(text)]
        assert [p["piece_end"] for p in ps] == cuts[1:]
        for p, c in zip(ps, cuts):
            assert c - 150 <= p["piece_start"] <= c and p["piece_text"] == text[p["piece_start"] : p["piece_end"]]
    found = splitting.found_cuts(df.select("doc_id", "text"))
    assert {tuple(r) for r in found.collect()} == {("a", c) for c in greedy(long, 1500, 150)} | {("e", c) for c in greedy("z" * 4000, 1500, 150)}
    assert splitting.split_oversized(df.limit(0)).count() == 0


needs_vocabulary = pytest.mark.skipif(not os.path.exists(encoding.VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab AB'st\n 0é中🔥\x1c　<|end", max_size=300), st.integers(5, 40), st.integers(4, 20))
def test_stitching_is_exact(text, chunk, overlap):
    enc = encoding.encoder(open(encoding.VOCABULARY, "rb").read())
    if len(text) <= chunk + overlap:
        return
    parts = [text[i * chunk : i * chunk + chunk + overlap] for i in range((len(text) - 1 - overlap) // chunk + 1)]
    assert encoding.stitch(enc, [(p, *encoding.encode_chunk(enc, p, {})) for p in parts], chunk) == enc.encode_ordinary(text)


@needs_vocabulary
def test_corpus_round_trip(spark):
    texts = {1: "Hello <|endoftext|> world", 2: None, 3: "", 4: "Länge 🔥 " * 300, 5: "a" * 2000, 6: " \n\n ", 7: "Hello <|endoftext|> world"}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, ids string")
    enc = encoding.encoder(open(encoding.VOCABULARY, "rb").read())
    for chunk, overlap in ((4096, 256), (100, 20)):
        out = encoding.encode_corpus(df, chunk=chunk, overlap=overlap)
        got = {r["doc_id"]: r["ids"] for r in out.collect()}
        assert got == {k: enc.encode_ordinary(v) if v else [] for k, v in texts.items()}
    assert {r["doc_id"]: r["text"] for r in encoding.decode_corpus(out).collect()} == {k: v or "" for k, v in texts.items()}
    assert encoding.encode_corpus(df.limit(0)).count() == 0


def one_by_one(sizes, capacity):
    bins, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(bins, s)
        r = bins.pop(i) if i < len(bins) else capacity
        n += r == capacity
        if r > s:
            bisect.insort(bins, r - s)
    return n, Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=150), st.sampled_from([50, 64, 100]))
def test_plan_equals_placing_one_by_one(sizes, capacity):
    fill = Counter()
    for s, _, n, first, each in packing.plan(Counter(sizes), capacity):
        for j in range(n):
            fill[first + j // each] += s
    opened = sum(1 for _ in fill)
    assert sum(fill.values()) == sum(sizes) and all(v <= capacity for v in fill.values())
    assert Counter(capacity - v for v in fill.values() if v < capacity) == one_by_one(sizes, capacity)[1]
    assert opened == len(fill)


def test_containers(spark):
    sizes = [(i, n) for i, n in enumerate([2048, 5000, 1000, 1000, 48, 1, None, 0, -3] + [300] * 500)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    rows = packing.pack(df).collect()
    used, parts = Counter(), {}
    for r in rows:
        used[r["container_id"]] += r["n_tokens"]
        parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert {k: sum(n for _, n in v) for k, v in parts.items()} == {i: n for i, n in sizes if n and n > 0}
    assert all(len(v) == 1 for k, v in parts.items() if dict(sizes)[k] <= 2048)
    assert sorted(parts[1]) == [(0, 2048), (2048, 2048), (4096, 904)]
    again = {tuple(r) for r in packing.pack(df.repartition(7)).collect()}
    assert again == {tuple(r) for r in rows}
    report = packing.packing_report(packing.pack(df)).first()
    assert report["containers"] == len(used) and report["least"] <= report["containers"]
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.packing_report(packing.pack(df.where(F.lit(False)))).first()["containers"] == 0


@needs_vocabulary
def test_pre_tokenisers_agree_on_every_character():
    """The chunks' pre-tokeniser cuts as the tokenizer's own does, whatever class a character is of."""
    enc = encoding.encoder(open(encoding.VOCABULARY, "rb").read())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    for at in range(0, len(every), 4096):
        block = every[at : at + 4096]
        for glue in ("a", "'s"):
            text = glue.join(block)
            assert encoding.encode_chunk(enc, text, {})[2].tolist() == enc.encode_ordinary(text), (hex(ord(block[0])), glue)


@needs_vocabulary
def test_unbroken_run_is_joined_once():
    """The characters pre-tokenised for a run over many chunks stay within a small multiple of its length."""
    enc, step, overlap = encoding.encoder(open(encoding.VOCABULARY, "rb").read()), 64, 16
    text = "start " + "ab" * 4000 + " end of it"
    parts = [text[i * step : i * step + step + overlap] for i in range((len(text) - 1 - overlap) // step + 1)]
    seen, plain = [], encoding.encode_chunk
    chunks = [(p, *plain(enc, p, {})) for p in parts]
    encoding.encode_chunk = lambda e, t, c, r=None: (seen.append(len(t)), plain(e, t, c, r))[1]
    try:
        assert encoding.stitch(enc, chunks, step) == enc.encode_ordinary(text)
    finally:
        encoding.encode_chunk = plain
    assert sum(seen) < 4 * len(text)
