import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.functions import columns as C
from tesseral.functions.strings import abbreviates, fold, osa, unleet
from tesseral.operators import analysis, clusters, discovery, metrics, retrieval, text
from tesseral.operators.lookup import join_back


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_answers(spark):
    f = lambda a, b: tuple(one(spark, C.token_f1(F.lit(a), F.lit(b))))
    assert one(spark, C.normalise_answer(F.lit("Hello, World!"))) == "hello world"
    assert one(spark, C.normalise_answer(F.lit("a cat and an elephant"))) == "cat and elephant"
    assert one(spark, C.normalise_answer(F.lit("the cat"))) == "cat"
    assert f("hello world", "hello universe") == (0.5, 0.5, 0.5)
    assert f("", "hello world") == f("hello world", "") == (0, 0, 0)
    assert f("", "") == (1, 1, 1)
    assert one(spark, C.answer_coverage(F.lit("diabetes insulin"), F.lit("The patient has diabetes"))) == 0.5
    assert one(spark, C.answer_coverage(F.lit(""), F.lit("x"))) == 1.0


def test_relative_phrases(spark):
    rows = [("yesterday", "2022-03-14"), ("on Monday", "2022-03-14"), ("last month", "2022-02-13"), ("2022-01-01", "2022-01-01"), ("soon", None), (None, None)]
    df = spark.createDataFrame([(p, dt.date(2022, 3, 15), w) for p, w in rows], "p string, d date, w string")
    assert df.where(~C.resolve_relative("p", "d").eqNullSafe(F.col("w"))).count() == 0


def test_geometry(spark):
    assert abs(one(spark, C.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) - 111.19) < 0.01
    assert one(spark, C.direction(C.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(5.0)))) == "E"
    assert one(spark, C.direction(F.lit(359.0))) == "N"


def test_islands(spark):
    t = dt.datetime(2022, 1, 1)
    rows = [(1, t), (2, t + dt.timedelta(hours=24)), (3, t + dt.timedelta(hours=48, seconds=1)), (4, None)]
    got = clusters.temporal_islands(spark.createDataFrame(rows, "id long, ts timestamp"), "ts", "id").collect()
    assert {r["key"] for r in got} == {1, 2} and len({r["cluster"] for r in got}) == 1
    assert clusters.temporal_islands(spark.createDataFrame([], "id long, ts timestamp"), "ts", "id").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_islands_do_not_depend_on_ranges(spark, parts):
    rng = np.random.default_rng(7)
    hours = np.sort(rng.uniform(0, 3000, 120))
    t = dt.datetime(2022, 1, 1)
    df = spark.createDataFrame([(i, t + dt.timedelta(hours=float(h))) for i, h in enumerate(hours)], "id long, ts timestamp")
    want, run = {}, 0
    for i in range(len(hours)):
        run += i > 0 and hours[i] - hours[i - 1] > 24
        want[i] = run
    size = {r: sum(v == r for v in want.values()) for r in want.values()}
    got = {r["key"]: r["cluster"] for r in clusters.temporal_islands(df, "ts", "id", parts=parts).collect()}
    assert set(got) == {i for i, r in want.items() if size[r] >= 2}
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len({want[i] for i in got})


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    chain = rng.permutation(60).tolist()
    edges = [(chain[i], chain[i + 1]) for i in range(59)] + [(100, 101), (101, 102), (300, 300)] + [(int(a) + 400, int(b) + 400) for a, b in rng.integers(0, 60, (35, 2))]
    got = {r["node"]: r["component"] for r in clusters.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    alone = {n for n in want if all(n not in e for e in edges if e[0] != e[1])}
    assert got == {n: c for n, c in want.items() if n not in alone}


@pytest.mark.parametrize("least,dims,seed", [(2, 2, 1), (4, 2, 3), (4, 3, 5), (12, 2, 8)])
def test_density(spark, least, dims, seed):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, 0.4, (60, dims)), rng.normal(5, 0.5, (60, dims)), rng.uniform(-3, 8, (60, dims)), np.full((4, dims), 20.0), np.zeros((2, dims))])
    names = ["x", "y", "z"][:dims]
    rows = [(i, *map(float, r)) for i, r in enumerate(p)] + [(999, None, *[1.0] * (dims - 1))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["key"]: r["cluster"] for r in clusters.density_clusters(df, "id", names, 0.6, least).collect()}
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.36
    core = [i for i in range(len(p)) if near[i].sum() >= least]
    assert set(got) == {i for i in range(len(p)) if any(near[i][c] for c in core)}
    root = {i: i for i in core}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in core:
        for j in core:
            if near[i][j]:
                root[find(i)] = find(j)
    assert len({(got[i], find(i)) for i in core}) == len({got[i] for i in core}) == len({find(i) for i in core})
    for i in set(got) - set(core):
        assert got[i] in {got[c] for c in core if near[i][c]}


def test_bursts(spark):
    t = dt.datetime(2022, 1, 1)
    rows = [(t + dt.timedelta(days=d, hours=h),) for d, n in enumerate([1] * 9 + [10]) for h in range(n)]
    r = analysis.bursts(spark.createDataFrame(rows, "ts timestamp")).collect()
    assert len(r) == 1 and r[0]["events"] == 10 and abs(r[0]["threshold"] - 7.592) < 1e-3 and abs(r[0]["intensity"] - 2.846) < 1e-3


def test_fusion_and_hybrid(spark):
    rank = spark.createDataFrame([("x", 1, 1, 1), ("x", 1, 2, 2), ("y", 1, 2, 1), ("y", 1, 3, 2)], "ranker string, query_id long, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.reciprocal_rank_fusion(rank).collect()}
    assert got == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6), 3: round(1 / 62, 6)}
    s = "query_id long, doc_id long, score double"
    d, p = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)], s), spark.createDataFrame([(1, 1, 0.0), (1, 2, 2.0), (1, 3, 1.0)], s)
    assert {r["doc_id"]: r["score"] for r in retrieval.hybrid(d, p).collect()} == {1: 0.65, 2: 0.675, 3: 0.175}


def test_dense_and_index_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 600)] + rng.normal(size=(600, 16)) * 0.4
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9999, None)], "doc_id long, embedding array<float>")
    q = df.where("doc_id % 20 = 0 and embedding is not null").select(F.col("doc_id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["doc_id"]) for r in retrieval.dense_top_k(df, q, 10).collect()}
    s = v.astype(np.float32) @ v[::20].astype(np.float32).T
    want = {(20 * j, int(i)) for j in range(30) for i in np.argsort(-s[:, j])[:10]}
    assert len(exact & want) >= 0.99 * len(want)
    found = {(r["query_id"], r["doc_id"]) for r in retrieval.InvertedFileIndex(df.where("embedding is not null")).search(q, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    assert retrieval.dense_top_k(df.limit(0), q, 10).count() == 0 and retrieval.dense_top_k(df, q.limit(0), 10).count() == 0


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, 1, "a" * 150), (1, 2, "b" * 300), (1, 3, "c" * 10), (1, 4, None)], "query_id long, rank int, text string")
    assert retrieval.pack_context(rows, budget=400).first()["context"] == "a" * 150 + "\n\n" + "b" * 248


def test_story_edge(spark):
    cols = "mention_id long, doc_id string, dimension_name string, text string, category string, normalized string"
    rows = [(1, "a", "spatial", "Perth", None, None), (2, "a", "spatial", "Broome", None, None), (3, "b", "spatial", "perth", None, None), (4, "a", "temporal", None, None, "2022-01-01"), (5, "b", "temporal", None, None, "2022-01-04"), (6, None, "spatial", "Perth", None, None)]
    r = clusters.story_edges(spark.createDataFrame(rows, cols)).collect()
    assert len(r) == 1 and r[0]["overlap"] == 0.5 and r[0]["days"] == 3 and r[0]["score"] == round(0.3 + 0.4 * (1 - 3 / 7), 6)


def test_windows_and_paragraphs(spark):
    t = ("x" * 99 + ".") * 20
    spans = text.sliding_windows(t, 500, 50)
    assert spans[0] == (0, 500) and spans[-1][1] == 2000 and all(b - a <= 500 for a, b in spans) and all(spans[i + 1][0] == spans[i][1] - 50 for i in range(len(spans) - 1))
    assert all(b - a <= 30 for a, b in text.sliding_windows("y" * 1000, 30, 29))
    p = "\n\n".join(["word " * 20] * 5)
    assert all(b - a <= 250 for a, b in text.paragraph_groups(p, 250, 20))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, t), (4, t)], "k long, text string")
    got = text.chunked(df, "k", "text", 500, 50).collect()
    assert {r["k"] for r in got} == {3, 4}


def test_pages_and_json(spark):
    html = "<html><head><title> A  page </title><script>x</script></head><body><nav>menu</nav><p>One &amp; two</p><p>three</p></body></html>"
    assert text.parse_html(html) == ("A page", "One & two\nthree")
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "k long, html string")
    got = {r["k"]: r for r in text.parsed_pages(df, "k", "html").collect()}
    assert got[1]["content"] == "One & two\nthree" and got[2]["error"] == "no page" and got[3]["content"] == ""
    assert text.json_in_text('x {"a": 1} and ```json\n{"b": [2]}\n``` {broken') == '{"b": [2]}' and text.json_in_text("none") is None and text.json_in_text(None) is None


def test_join_back_with_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [("gone", 1)], "k string, i int")
    known = spark.createDataFrame([("hot", 3000, "H")] + [(f"k{i}", 1, f"v{i}") for i in range(50)], "k string, n long, v string")
    got = join_back(rows, known, ["k"], ["v"]).groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in got} == {"H": 3000} | {f"v{i}": 1 for i in range(50)}


def test_extraction_and_latency(spark):
    k = "d string, t string"
    r = metrics.extraction_counts(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], k), spark.createDataFrame([("a", "x"), ("b", "z")], k), ["d", "t"]).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1) and r["precision"] == round(1 / 3, 6)
    e = metrics.extraction_counts(spark.createDataFrame([], k), spark.createDataFrame([], k), ["d", "t"]).first()
    assert (e["tp"], e["f1"]) == (0, 0.0)
    assert metrics.overhead(10, 11) == pytest.approx(10) and metrics.overhead(0, 1) == 0.0
    lat = metrics.latency(spark.createDataFrame([(1.0, 0.5), (3.0, None), (None, 1.0)], "total_duration_seconds double, gpu_hours double")).first()
    assert lat["runs"] == 2 and lat["p50"] == 2000 and lat["deviation"] == 1000


def test_schema(spark):
    names = spark.createDataFrame([(1, "drug"), (2, "drugs"), (3, "Disease"), (3, "disease ")], "cluster long, name string")
    got = {r["name"]: r["canonical"] for r in discovery.merged_schema(names).collect()}
    assert got == {"drug": "drug", "drugs": "drug", "disease": "disease"}
    e = spark.createDataFrame([("apple", "product", {"dimension": "x", "maker": "y"}), ("banana", "product", {"dimension": "x"})], "entity string, dimension string, fields map<string,string>")
    assert {r["field"] for r in discovery.derived_dimensions(e, 0.6).collect()} == {"dimension"}


def test_strings():
    assert osa("flood", "folod") == 1 and osa("abc", "abc") == 0 and osa("kitten", "sitting") == 3 and osa("aaaa", "bbbb", 1) == 2
    assert fold("Größe​ É") == "grosse e" and unleet("sp0kesperson") == "spokesperson" and unleet("2024") == "2024"
    assert abbreviates("rsrch", "research") and not abbreviates("xr", "research") and not abbreviates("research", "research")
    assert math.isclose(1, 1)


def test_stage_tables_can_be_cleared(spark):
    from tesseral.session import clear, materialise

    df = materialise(spark.range(5).toDF("x"), "t")
    assert df.count() == 5
    clear(spark)
    assert materialise(spark.range(3).toDF("x"), "t").count() == 3
