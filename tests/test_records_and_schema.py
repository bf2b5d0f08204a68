import pytest
from pyspark.sql import functions as F

from tesseral.functions import places, records
from tesseral.plans import schema


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_places(spark):
    v = lambda s: one(spark, places.city_of_venue(F.lit(s)))
    assert v("Perth International Airport") == "Perth" and v("Broome's Hospital, WA") == "Broome" and v("Stadium") is None
    r = lambda s: one(spark, places.region_in_context(F.lit(s)))
    assert r("hit Broome, Western Australia.") == "Western Australia" and r("a storm near Perth today") == "Perth" and r("nothing") is None
    assert one(spark, places.search_query(F.lit("Broome"), F.lit("Kimberley"))) == "Broome, Kimberley" and one(spark, places.search_query(F.lit("Perth, WA"), F.lit("wa"))) == "Perth, WA"
    same = lambda a, b: one(spark, places.same_place(F.lit(a), F.lit(b)))
    assert same("Perth", "perth, WA") and same("north west cape", "cape north") and not same("Perth", "Broome") and not same("", "Perth")
    assert one(spark, places.same_time(F.lit("2022-03-15T00:00:00Z"), F.lit("2022-03-15")))
    assert one(spark, places.feature_kind(F.create_map(F.lit("amenity"), F.lit("cafe"), F.lit("place"), F.lit("town")))) == "town"
    pts = F.array(F.struct(F.lit(0.0).alias("latitude"), F.lit(1.0).alias("longitude")))
    assert abs(one(spark, places.mean_distance(F.lit(0.0), F.lit(0.0), pts)) - 111.19) < 0.01
    assert one(spark, places.cache_key(F.lit(1.23456), F.lit(2.0), 100.0)) == "1.2346_2.0000_100.0"


def test_records(spark):
    df = spark.createDataFrame([(["Yes"], [("t", 1)], [("t", ["a", "b"])]), (["x"], [("u", 0)], [("t", ["a"])]), (["x"], [("t", 5)], [("t", ["a"])])], "labels array<string>, facts array<struct<title:string,idx:int>>, ctx array<struct<title:string,sentences:array<string>>>")
    got = df.select(records.question_kind("labels").alias("k"), records.supporting_sentences("facts", "ctx").alias("s")).collect()
    assert [r["k"] for r in got] == ["yes_no", "undefined", "undefined"] and got[0]["s"][0]["contents"] == "b" and got[1]["s"] is None and got[2]["s"] is None
    options = F.create_map(F.lit("A"), F.lit("one"), F.lit("B"), F.lit("two"))
    assert one(spark, records.choice_answer(options, F.lit(" b"))) == "two" and one(spark, records.choice_answer(options, F.lit("D"))) is None
    assert one(spark, records.chosen_letter(F.lit("the answer is (c)."))) == "C" and one(spark, records.chosen_letter(F.lit("none"))) is None
    assert one(spark, records.byte_range(F.lit("é<b>x</b>"), F.lit(2), F.lit(6))) == "<b>x"
    assert one(spark, records.joined_title(F.lit("Why?"), F.lit("So."))) == "Why? So." and one(spark, records.joined_title(F.lit("T"), F.lit("b"))) == "T. b" and one(spark, records.joined_title(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, records.title_of_url(F.lit("http://x/Some_Title"))) == "Some Title"
    r = spark.createDataFrame([([("t", "same")], [("u", "same"), ("v", "other"), ("w", " ")]), (None, None)], "supporting array<struct<title:string,contents:string>>, contexts array<struct<title:string,contents:string>>")
    assert records.corpus_of_records(r).count() == 2


def test_schema(spark):
    assert schema.snake_case("Event Type") == schema.snake_case("eventType") == "event_type" and schema.pascal_case("event_type") == "EventType"
    assert schema.merged({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 3}, "l": [2]}) == {"a": {"b": 3, "c": 2}, "l": [2]}
    d = schema.dimensions_of({"drug": {"hierarchy": ["name", "class"]}, "old": {"hierarchy": ["x"], "enabled": False}})
    assert set(d) == {"temporal", "spatial", "drug"} and d["temporal"].kind == "normalized" and d["drug"].kind == "categorical"
    with pytest.raises(ValueError):
        schema.dimensions_of({"drug": {"hierarchy": []}})
    df = spark.createDataFrame([('{"drug": [{"text": "aspirin", "name": "aspirin", "extra": 1}], "other": []}',), ("broken",)], "raw string")
    got = schema.parsed_extractions(df, "raw", d).collect()
    assert got[0]["entities"]["drug"][0]["name"] == "aspirin" and "extra" not in got[0]["entities"]["drug"][0].asDict()
    p = spark.createDataFrame([("Drug", 0.9), ("New One", 0.8), ("new one", 0.9), ("weak", 0.1)], "name string, confidence double")
    assert {r["name"] for r in schema.accepted_proposals(p, ["drug"]).collect()} == {"new_one"}
