"""Readers of corpora, indexes, timings and schemas; each with a fixed schema, so no file is read to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "doc_id string, title string, contents string, metadata map<string,string>"
CHUNK = (
    "doc_id string, chunk_index int, total_chunks int, text string, word_count int, char_count int, document_id string, document_title string, document_metadata map<string,string>, "
    "start_char int, end_char int, previous_chunk_summary string, section_hierarchy string, element_types array<string>, keywords array<string>, preview string"
)
TIMING = "doc_id string, timestamp string, total_duration_seconds double, num_gpus int, gpu_hours double, components map<string,struct<duration_seconds:double,components:map<string,double>>>"
QUESTION = "id string, question string, answer_labels array<string>, question_type string, metadata map<string,string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones are null rows; a missing path gives no rows."""
    df = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return df.limit(limit) if limit is not None else df


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Documents (doc_id, title, contents, metadata) with text; a missing id is made of the content."""
    df = jsonl(spark, path, CORPUS).where(F.length("contents") > 0)
    df = df.withColumn("doc_id", F.coalesce("doc_id", F.concat(F.lit("doc_"), F.substring(F.md5("contents"), 1, 12))))
    return df.limit(limit) if limit is not None else df


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, CHUNK)


def timings(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, TIMING)


def newest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified): the newest file of a pattern."""
    f = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return f.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modified")).where("path is not null")


def inverted_index(spark: SparkSession, path: str, dim: str) -> DataFrame:
    """(dim, kind, key, doc_id) of a JSON object {key: [ids]}; a missing file gives no postings."""
    if not exists(spark, path):
        return spark.createDataFrame([], "dim string, kind string, key string, doc_id string")
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return m.select(F.explode("m").alias("key", "ids")).select(F.lit(dim).alias("dim"), F.lit("label").alias("kind"), "key", F.explode("ids").alias("doc_id"))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """(document_id, title, content): text files as documents, UTF-8 where valid, else Latin-1."""
    f = spark.read.format("binaryFile").load(pattern)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    content = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return f.select(F.concat(F.lit("file_"), name).alias("document_id"), F.initcap(F.regexp_replace(name, r"[_-]+", " ")).alias("title"), content.alias("content"))


def xml_sections(spark: SparkSession, path: str, row_tag: str = "sec") -> DataFrame:
    """(title, paragraphs) of XML sections."""
    df = spark.read.format("xml").option("rowTag", row_tag).schema("title string, p array<string>").load(path)
    return df.select("title", F.coalesce("p", F.array().cast("array<string>")).alias("paragraphs"))


def union_existing(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """All existing files of {tag: path} with their tag; missing ones are skipped."""
    out = spark.createDataFrame([], schema).withColumn("tag", F.lit(None).cast("string"))
    for tag, path in sorted(paths.items()):
        if exists(spark, path):
            out = out.unionByName(jsonl(spark, path, schema).withColumn("tag", F.lit(tag)))
    return out


def from_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """(document_id, title, input_type, content): addresses as input documents; ids are stable, a whole hash of the address each."""
    host = F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit("unknown"))
    return df.select(F.concat(F.lit("url_"), host, F.lit("_"), F.lower(F.hex(F.xxhash64(url)))).alias("document_id"), F.col(url).alias("title"), F.lit("url").alias("input_type"), F.col(url).alias("content"))


def from_texts(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.trim(F.col(text))
    title = F.when(F.char_length(t) > 50, F.concat(F.substring(t, 1, 50), F.lit("..."))).otherwise(t)
    return df.where(t != "").select(F.concat(F.lit("text_"), F.substring(F.md5(text), 1, 12)).alias("document_id"), title.alias("title"), F.lit("text").alias("input_type"), F.col(text).alias("content"))
