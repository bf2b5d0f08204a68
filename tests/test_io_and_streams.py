import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tesseral.plans import pipeline
from tesseral.sources import readers, sinks
from tesseral.streaming import incremental


def test_readers(spark, tmp_path):
    p = tmp_path / "corpus.jsonl"
    p.write_text('{"doc_id": "a", "title": "T", "contents": "text", "metadata": {"k": "v"}}\n\n{"contents": "no id"}\n{"doc_id": "c", "contents": ""}\n')
    got = readers.corpus(spark, str(p)).collect()
    assert len(got) == 2 and any(r["doc_id"].startswith("doc_") for r in got)
    assert readers.corpus(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "index.json").write_text(json.dumps({"2022": ["a", "b"], "2023": []}))
    assert readers.inverted_index(spark, str(tmp_path / "index.json"), "temporal").count() == 2
    (tmp_path / "a_note.txt").write_bytes("caf\xe9".encode("latin-1"))
    assert readers.files(spark, str(tmp_path / "a_note.txt")).first()["content"] == "café"
    assert readers.newest_file(spark, str(tmp_path / "*.jsonl")).first()["path"].endswith("corpus.jsonl")
    (tmp_path / "x.xml").write_text("<a><sec><title>S</title><p>one</p><p>two</p></sec></a>")
    assert readers.xml_sections(spark, str(tmp_path / "x.xml")).first()["paragraphs"] == ["one", "two"]
    urls = spark.createDataFrame([("https://h.example/a",), (None,)], "url string")
    assert readers.from_urls(urls).where("url is null" if False else "true").count() == 2
    texts = readers.from_texts(spark.createDataFrame([("x" * 60,), ("",), (None,)], "text string")).collect()
    assert len(texts) == 1 and texts[0]["title"].endswith("...")
    assert readers.union_existing(spark, {"a": str(p), "b": str(tmp_path / "no")}, readers.CORPUS).where("tag = 'a'").count() >= 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], {"a": "b"})], "i int, xs array<int>, m map<string,string>")
    sinks.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["i", "xs_json", "m_json"]
    sinks.append_new(df.select("i"), str(tmp_path / "t"), ["i"])
    sinks.append_new(spark.createDataFrame([(1,), (2,)], "i int"), str(tmp_path / "t"), ["i"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.jsonl(df, str(tmp_path / "j"))
    sinks.parquet(df, str(tmp_path / "p"), ["i"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_pipeline_and_generator(spark):
    docs = spark.createDataFrame([("d1", "The storm hit near Perth on 2022-03-20 and later in Broome."), ("d2", None), ("d3", "tiny")], "document_id string, content string")
    out = pipeline.run(docs)
    got = {(r["dimension_name"], r["text"]) for r in out["mentions"].collect()}
    assert ("temporal", "2022-03-20") in got and ("spatial", "Perth") in got and ("spatial", "Broome") in got

    def broken(text, metadata):
        raise ValueError("no model")

    assert {r["dimension_name"] for r in pipeline.extracted(out["chunks"], broken).collect()} == {"error"}
    q = spark.createDataFrame([(1, "q", "Answer: first [Document 2]. Second."), (2, None, None)], "question_id long, question string, context string")
    got = {r["question_id"]: r for r in pipeline.answered(q).collect()}
    assert got[1]["citations"] == ["2"] and got[2]["answer"] == ""


def test_ingest_resumes(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    schema = "id long, ts timestamp"
    spark.createDataFrame([(1, datetime.fromisoformat("2024-01-01")), (1, datetime.fromisoformat("2024-01-01")), (2, datetime.fromisoformat("2024-01-02"))], schema).write.parquet(src)
    assert incremental.ingest(incremental.stream(spark, src, schema), sink, cp, ["id"]).awaitTermination(60)
    spark.createDataFrame([(2, datetime.fromisoformat("2024-01-02")), (3, datetime.fromisoformat("2024-01-03"))], schema).write.mode("append").parquet(src)
    assert incremental.ingest(incremental.stream(spark, src, schema), sink, cp, ["id"]).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windowed_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, datetime.fromisoformat("2024-01-01") + timedelta(hours=i)) for i in range(120)]
    spark.createDataFrame(rows, "id long, ts timestamp").write.parquet(src)
    q = incremental.windowed_counts(incremental.stream(spark, src, "id long, ts timestamp"), late="1 hour").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r["events"] for r in spark.table("daily").collect()} == {24}


def test_carried_memory(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "document_id string, chunk_index int, texts array<string>"
    spark.createDataFrame([("d", 1, ["b"]), ("d", 0, ["a"]), ("d", 2, ["c", None])], schema).coalesce(1).write.parquet(src)
    q = incremental.carried_memory(incremental.stream(spark, src, schema)).writeStream.format("memory").queryName("mem").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:  # a stream with timeouts has no end of its own
        for _ in range(60):
            got = {r["chunk_index"]: r["refs"] for r in spark.table("mem").where(F.col("document_id") == "d").collect()}
            if len(got) == 3:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert got == {0: "", 1: "a", 2: "a; b"}
