"""Queries against the whole of their tables, on small data."""

import datetime as dt
import itertools
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesseral.functions import columns as C
from tesseral.operators import clusters, context, discovery

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_inverted_file_recall_on_the_table(spark):
    found, exact = ({(r["query_id"], r["doc_id"]) for r in entry.queries()[n](spark, DATA).collect()} for n in ("ivf_top", "dense_top"))
    assert len(found & exact) >= 0.9 * len(exact)


def test_stories_against_all_pairs(spark):
    cols = "mention_id long, doc_id string, dimension_name string, text string, category string, normalized string"
    rng = np.random.default_rng(4)
    rows = [(i, f"c{rng.integers(30)}", "spatial", f"t{rng.integers(12)}", None, None) for i in range(60)]
    rows += [(100 + i, f"c{rng.integers(30)}", "temporal", None, None, f"2022-{rng.integers(1, 5):02}-{rng.integers(1, 29):02}") for i in range(24)]
    rows += [(200 + i, d, "spatial", "only this", None, None) for i, d in enumerate(("same1", "same2", "same3"))]
    rows += [(300, "late1", "temporal", None, None, "2030-01-01"), (301, "late2", "temporal", None, None, "2030-01-07"), (302, "late3", "temporal", None, None, "2030-01-14")]
    m = spark.createDataFrame(rows, cols)
    sets, first = defaultdict(set), {}
    for _, d, dim, t, _, n in rows:
        sets[d] |= {f"{dim}:{t}"} if t else set()
        if n:
            first[d] = min(first.get(d, dt.date.max), dt.date.fromisoformat(n))
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        overlap = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
        days = abs((first[a] - first[b]).days) if a in first and b in first else None
        score = 0.6 * overlap * (overlap >= 0.3) + (0.4 * max(0, 1 - days / 7) if days is not None else 0)
        if score > 0:
            want[a, b] = round(score, 6)
    edges = clusters.story_edges(m)
    assert {(r["a"], r["b"]): pytest.approx(r["score"], abs=1e-6) for r in edges.collect()} == want
    assert want["late1", "late2"] and ("late2", "late3") not in want and want["same1", "same3"] == 0.6
    arcs = clusters.story_arcs(edges, m).collect()
    assert {"same1": 3, "late1": 2}.items() <= {r["component"]: r["chunks"] for r in arcs}.items()
    assert sum(r["edges"] for r in arcs) == len(want) and sum(r["chunks"] for r in arcs) == len({x for e in want for x in e})


def test_memory_of_every_chunk(spark):
    """Against chunks walked in order, as the reference updates its memory."""
    chunks = [(f"{d}_chunk_{i}", d) for d, n in (("x", 15), ("y", 3), ("none", 2)) for i in range(n)]
    said = [(1, "x", 0, "temporal", "t0"), (2, "x", 0, "spatial", "s0"), (3, "x", 2, "temporal", "t2"), (4, "y", 1, "person", "p1")] + [(10 + i, "x", 3 + i % 5, "temporal", f"u{i}") for i in range(20)]
    m = spark.createDataFrame([(i, f"{d}_chunk_{c}", d, dim, t) for i, d, c, dim, t in said], "mention_id long, doc_id string, document_id string, dimension_name string, text string")
    want = {}
    for d, n in (("x", 15), ("y", 3)):
        for dim in {s[3] for s in said if s[1] == d}:
            kept, seen = [], 0
            for c in range(n):
                want[d, dim, c] = (seen, "; ".join(kept))
                new = [t for _, *k, t in sorted(said) if k == [d, c, dim]]
                kept, seen = (kept + new)[-10:], seen + len(new)
    got = context.memory(m, chunks=spark.createDataFrame(chunks, "doc_id string, document_id string")).collect()
    assert {(r["document_id"], r["dimension_name"], r["chunk_index"]): (r["seen"], r["refs"]) for r in got} == want


def test_every_chunk_has_a_prompt(spark):
    rows = entry.queries()["prompt_lines"](spark, DATA).select(F.concat_ws("_chunk_", "document_id", "chunk_index").alias("doc_id"), "prompt")
    chunks = spark.read.parquet(f"{DATA}/document_chunks.parquet").select("doc_id").distinct()
    assert chunks.join(rows, "doc_id", "left_anti").count() == 0 and rows.count() == rows.select("doc_id").distinct().count()


def test_co_occurrence_of_all_dimensions(spark):
    seen = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/mentions.parquet").select("document_id", "dimension_name", "category", "text").collect():
        value = (r["category"] or "").strip(" ").lower() or (r["text"] or "").strip(" ").lower()
        if r["document_id"] and r["dimension_name"] and value:
            seen[r["document_id"]].add((r["dimension_name"], value))
    want = Counter((*a, *b) for s in seen.values() for a in s for b in s if a[0] < b[0])
    got = {tuple(r[:4]): r["documents"] for r in entry.queries()["cross_dimensional_all"](spark, SMALL).select("dim_a", "value_a", "dim_b", "value_b", "documents").collect()}
    assert got == want and {"spatial", "temporal"} <= {k[2] for k in got}


def test_sparse_searches_take_the_titles(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "title", "text").collect()
    split = lambda x: [w for w in re.split(r"[ \t\n\x0b\f\r]+", (x or "").lower()) if w]
    texts = {r["doc_id"]: Counter(split(r["text"])) for r in docs if r["text"] is not None}
    asked = {r["doc_id"]: split(r["title"]) for r in docs if r["doc_id"] % 20 == 0 and r["title"]}
    mean = sum(sum(c.values()) for c in texts.values()) / len(texts)
    df = Counter(t for c in texts.values() for t in c)  # the floor is a quarter of the mean over the corpus, not over the terms asked
    idf = {t: math.log((len(texts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    want = {(q, i): sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in ts if t in c) for q, ts in asked.items() for i, c in texts.items() if any(t in c for t in ts)}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in entry.queries()["bm25_scores_all"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    for name in ("bm25_top_all", "packed_context", "multi_hop"):
        assert {r["query_id"] for r in entry.queries()[name](spark, SMALL).select("query_id").distinct().collect()} == {q for q, _ in want}


def test_every_temporal_mention_is_resolved(spark):
    m = spark.read.parquet(f"{DATA}/mentions.parquet").where("dimension_name = 'temporal' and text is not null").select("mention_id", "document_id").dropDuplicates(["mention_id"])
    rows = {r["mention_id"]: r for r in entry.queries()["resolved_mentions"](spark, DATA).collect()}
    assert rows.keys() == {r["mention_id"] for r in m.collect()}
    weeks = [r for r in rows.values() if r["text"].strip().lower() == "last week" and r["anchor"]]
    assert weeks and all(r["resolved"] == str(dt.date.fromisoformat(r["anchor"]) - dt.timedelta(7)) for r in weeks)
    dates = spark.read.parquet(f"{DATA}/parsed_documents.parquet").where(C.iso_date("date").isNull() & F.col("date").rlike("[a-z] 20[0-9]{2}$")).select("document_id").distinct()
    assert any(rows[r["mention_id"]]["anchor"] for r in m.join(dates, "document_id").collect())


def test_previews_are_of_the_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "title", "text").collect()
    got = {r["doc_id"]: r["preview"] for r in entry.queries()["previews"](spark, SMALL).collect()}
    assert got.keys() == {r["doc_id"] for r in docs}
    long = [r for r in docs if r["text"] and re.fullmatch(r"\w[^.!?]{40}", r["text"][:41], re.S)]
    assert long and all(got[r["doc_id"]][:41] == r["text"][:41] for r in long)
    assert max(len(x or "") for x in got.values()) <= 203


def test_titles_as_they_are(spark):
    rows = entry.queries()["title_kinds"](spark, DATA).collect()
    assert all(" ".join(r["title"].split()).rstrip("?") == " ".join(r["query"].split()) for r in rows)
    assert len(rows) == len({r["title"] for r in rows}) and all(r["kind"] != "temporal" and not r["years"] for r in rows if re.fullmatch("[A-Za-z ,]+", r["title"]) and "when" not in r["title"].lower())


def test_directions_from_every_place(spark):
    ids = {r["place_id"] for r in spark.read.parquet(f"{SMALL}/gazetteer.parquet").select("place_id").collect()}
    rows = {r["place_id"]: r for r in entry.queries()["directions_all"](spark, SMALL).collect()}
    assert rows.keys() == {i for i in ids if i + 1 in ids}
    known = {r["place_id"]: r for r in entry.queries()["directions"](spark, SMALL).collect()}
    assert known and all(rows[i] == r for i, r in known.items())


def test_schema_of_the_mentions(spark):
    seen = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/mentions.parquet").where("category is not null").select("source", "category").distinct().collect():
        seen[r["category"].strip(" ").lower()].add(r["source"] or "")
    order, chosen, want = {s: i for i, s in enumerate(sorted(set().union(*seen.values())))}, [], {}
    for n in sorted(seen, key=lambda n: (min(order[s] for s in seen[n]), n)):
        want[n] = next((c for c in chosen if discovery.ratio(c, n) >= 0.85), n)
        chosen += [n] if want[n] == n else []
    got = entry.queries()["merged_schema"](spark, SMALL).collect()
    assert {r["name"]: r["canonical"] for r in got} == want and {r["name"]: r["clusters"] for r in got} == {n: len(x) for n, x in seen.items()}
