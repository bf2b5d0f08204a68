"""Three-stage retrieval, answers, questions, record formats, fuzzy categories and batches on small frames."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tesseral.functions import questions as Q
from tesseral.functions import records
from tesseral.operators import answers, discovery, filters, retrieval, stories

DOCS = "doc_id long, embedding array<double>, text string"
ASKED = "query_id long, embedding array<double>, query string"


def corpus(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], "The river rose. Crews closed the bridge."), (2, [0.9, 0.1], "Measles cases were confirmed."), (3, [0.0, 1.0], "The bridge is open."), (4, [0.8, 0.2], None), (5, [0.7, 0.0], "")], DOCS)
    return docs, spark.createDataFrame([(1, [1.0, 0.0], "Who closed the bridge?"), (2, [0.0, 1.0], "")], ASKED)


def test_three_stages(spark):
    docs, asked = corpus(spark)
    got = answers.three_stage(docs, asked, (4, 3, 2)).where("query_id = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2] and got[0]["score"] == pytest.approx(2 / 3, abs=1e-6)
    dense = answers.three_stage(docs, asked, (2, 2, 2), sparse=False, rerank=False).where("query_id = 1").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in dense] == [(1, 1.0), (2, 0.9)]
    keep = docs.where("doc_id = 3")
    assert {r["doc_id"] for r in answers.three_stage(docs, asked, keep=keep).where("query_id = 1").collect()} == {3}
    assert {r["doc_id"] for r in answers.three_stage(docs, asked, keep=keep, mode="postfilter").where("query_id = 1").collect()} == {3}
    boosted = answers.three_stage(docs, asked, keep=keep, mode="boost", boost=5.0, rerank=False).where("query_id = 1 and rank = 1").first()
    assert boosted["doc_id"] == 3
    empty = answers.three_stage(docs, asked, keep=docs.limit(0))  # a filter that meets nothing searches all
    assert empty.where("query_id = 1").count() == 5
    assert answers.three_stage(docs.limit(0), asked).count() == 0 and answers.three_stage(docs, asked.limit(0)).count() == 0


def test_answers(spark):
    docs, asked = corpus(spark)
    got = {r["query_id"]: r for r in answers.answers(answers.three_stage(docs, asked), docs, asked).collect()}
    assert got[1]["answer"] == "Crews closed the bridge." and got[1]["prompt"].endswith("Question: Who closed the bridge?\nAnswer:")
    none = answers.answers(answers.three_stage(docs.limit(0), asked), docs, asked).collect()
    assert len(none) == 2 and all(r["answer"] is None and r["used"] == 0 for r in none)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_questions(spark):
    assert one(spark, Q.entities(F.lit("Did the Mayor of Paris, or Ann's Team, meet in  2022?"))) == ["Anns", "Mayor", "Paris", "Team"]
    assert one(spark, Q.sub_questions(F.lit("When did the town that flooded in May rebuild?"))) == ["What town flooded in May rebuild?", "When did the town that flooded in May rebuild?"]
    assert one(spark, Q.sub_questions(F.lit("Where is it?"))) == ["Where is it?"]
    q = F.lit("What happened in Perth during Q3 of 2021?")
    assert (one(spark, Q.suggested_year(q)), one(spark, Q.suggested_quarter(q)), one(spark, Q.suggested_region(q))) == (2021, None, "Perth")
    assert one(spark, Q.suggested_quarter(F.lit("Sales in Q3"))) == 3 and one(spark, Q.entities(F.lit(""))) == []
    assert tuple(one(spark, Q.time_range(F.lit("open from 11:00am to 7:30 pm daily")))) == ("11:00", "19:30")
    assert tuple(one(spark, Q.time_range(F.lit("12am - 12pm")))) == ("00:00", "12:00")
    assert one(spark, Q.time_range(F.lit("2022-03-15"))) is None and one(spark, Q.time_range(F.lit("27:00 to 28:00"))) is None
    assert one(spark, Q.ascii_text(F.lit("café — naïve"))) == "cafe  naive" and one(spark, Q.yes_no_kind(F.lit(1))) == "yes_no"


def test_record_formats(spark):
    hotpot = spark.createDataFrame([("a", "Is it?", "Yes", [("T", 1)], [("T", ["s0", "s1"]), ("U", ["u0"])]), ("b", "Lost?", "x", [("T", 9)], [("T", ["s0"])])], "_id string, question string, answer string, supporting_facts array<struct<title:string,idx:int>>, context array<struct<title:string,sentences:array<string>>>")
    (r,) = records.normalised(hotpot, "hotpotqa").collect()
    assert r["original_id"] == "a" and r["question_type"] == "yes_no" and [tuple(x) for x in r["supporting_facts"]] == [("wikipedia", "T", "s1")] and [x["contents"] for x in r["retrieval_contexts"]] == ["s0s1", "u0"]
    musique = spark.createDataFrame([("m", "Who?", "A", ["B"], [("P", "p"), ("Q", "q")], [(1,), (0,)])], "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string>>, question_decomposition array<struct<paragraph_support_idx:int>>")
    (r,) = records.normalised(musique, "musique").collect()
    assert r["answer_labels"] == ["A", "B"] and [x["title"] for x in r["supporting_facts"]] == ["Q", "P"]
    popqa = spark.createDataFrame([(1, "S?", "Subj", "occupation", "Poet", '["poet", "writer"]'), (2, "N?", None, "p", "o", "[]")], "id long, question string, subj string, prop string, obj string, possible_answers string")
    (r,) = records.normalised(popqa, "popqa").collect()
    assert r["answer_labels"] == ["poet", "writer"] and r["supporting_facts"][0]["title"] == "Subj"
    trivia = spark.createDataFrame([("t", "Q?", ["a"], ["Page"], ["S"], ["found"])], "question_id string, question string, aliases array<string>, page_titles array<string>, search_titles array<string>, search_contexts array<string>")
    assert [x["type"] for x in records.normalised(trivia, "triviaqa").first()["retrieval_contexts"]] == ["wikipedia", "BingSearch"]
    web = spark.createDataFrame([("http://x/en/New_York", "Q?", ["a", "b"])], "url string, question string, answers array<string>")
    assert records.normalised(web, "webqa").first()["supporting_facts"][0]["title"] == "New York"
    choice = spark.createDataFrame([("c", "Q?", {"A": "one", "B": "two"}, "B"), ("d", "Q?", {"A": "one"}, "C")], "id string, question string, options map<string,string>, answer string")
    assert [r["answer_labels"] for r in records.normalised(choice, "mirage").collect()] == [["two"]]
    assert records.normalised(choice.limit(0), "mirage").count() == 0
    with pytest.raises(ValueError):
        records.normalised(choice, "other")


def test_fuzzy_categories_equal_brute_force(spark):
    names, values = ["flood", "bushfire", "storm surge", "fire"], ["Flod", "bush fire", "firre", "storm", "  ", None, "xyz", "FIRE"]
    got = {r["category"]: r["match"] for r in filters.fuzzy_categories(spark.createDataFrame([("e", v) for v in values] + [("none", "flood")], "dimension_name string, category string"), [("e", n) for n in names]).where("dimension_name = 'e'").collect()}
    want = {}
    for v in values:
        if v and v.strip():
            ranked = [(SequenceMatcher(None, v.strip().lower(), n).ratio(), n) for n in sorted(names)]
            best = max(ranked, key=lambda x: x[0])
            want[v] = best[1] if best[0] >= 0.8 else None
    assert got == want


def test_batches(spark):
    df = spark.createDataFrame([(100,), (500,), (2000,), (40,), (151,)], "size long")
    got = {r["size"]: (r["first_batch"], r["batches"], r["threshold"]) for r in discovery.batch_plan(df).collect()}
    assert got == {100: (50, 2, 0.3), 500: (50, 10, 0.9), 2000: (150, 38, 0.9), 40: (50, 1, 0.3), 151: (50, 4, 0.6)}


def test_story_of_one_arc(spark):
    rows = [(1, "x", "d1", "temporal", "t", "2022-01-05", None, None, None), (2, "x", "d2", "temporal", "t", "2022-01-01", None, None, None), (3, "x", "d1", "spatial", "Here", None, None, 1.0, 2.0), (4, "x", "d3", "spatial", "", None, None, 0.0, 0.0), (5, "x", None, "temporal", None, None, "c", None, None)]
    m = spark.createDataFrame(rows, "mention_id long, arc string, doc_id string, dimension_name string, text string, normalized string, category string, latitude double, longitude double")
    assert tuple(stories.temporal_span(m).first()) == ("x", "2022-01-01", "2022-01-05", 4, 2)
    assert stories.spatial_span(m).first()["places"] == 1 and stories.neighbour_gaps(m).first()["max_gap"] == 4
    assert [(r["doc_id"], r["place"]) for r in stories.progression(m).orderBy("step").collect()] == [("d2", "Unknown"), ("d1", "Here"), ("d3", "Unknown")]
    for f in (stories.key_entities, stories.key_dimensions, stories.temporal_span, stories.spatial_span, stories.neighbour_gaps, stories.progression):
        assert f(m.limit(0)).count() == 0


def test_score_does_not_depend_on_the_batch(spark):
    docs = spark.createDataFrame([(1, "the river the flood"), (2, "the bridge"), (3, "the the levee"), (4, "")], "doc_id long, text string")
    alone = spark.createDataFrame([(1, "the river")], "query_id long, query string")
    more = alone.unionByName(spark.createDataFrame([(2, "levee bridge nothing")], "query_id long, query string"))
    key = lambda df: {tuple(r) for r in df.where("query_id = 1").collect()}
    assert key(retrieval.bm25(docs, alone)) == key(retrieval.bm25(docs, more)) != set()
