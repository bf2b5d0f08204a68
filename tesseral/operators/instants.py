"""Normalising mixed notations of times through a dictionary of distinct values (problem 5).

Method: the distinct (raw, time zone, date order) values are parsed once each, exhaustively, into a dictionary
table; the table is persisted and extended incrementally (only values it lacks are parsed), and joined back to
the rows.  Values that cannot name a time (null, blank, without a digit, durations) are left out before that by
JVM expressions.  The join back is safe against hot values: those with over a thousandth of all rows, at most a
thousand by construction, are broadcast; the rest is an ordinary shuffled join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions.instants import parse_instant
from tesseral.operators.lookup import join_back
from tesseral.session import materialise, shared_dir
from tesseral.sources.tables import table

KEY = ["raw", "time_zone", "date_order"]
DICTIONARY = "raw string, time_zone string, date_order string, n long, utc string"


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["utc"] = [parse_instant(r, z or None, o or None) for r, z, o in zip(b["raw"], b["time_zone"], b["date_order"])]
        yield b[[*KEY, "n", "utc"]]


def instant_dictionary(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary (raw, time_zone, date_order, n, utc) for all values of rows, persisted at path.

    A dictionary already there is kept and extended by the values it lacks; n counts the rows of the present run, 0 for
    values that only earlier runs had, so hot values are judged by the rows at hand.  Null zones and orders are stored as "".  Without a path a new one in the shared folder.
    """
    spark = rows.sparkSession
    fresh = path is None
    path = path or f"{shared_dir(spark).rstrip('/')}/instants/{uuid.uuid4().hex}"
    values = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    lacking, present = values, None
    if not fresh:
        present = values = materialise(values, "values")
        lacking = values
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            lacking = values.join(spark.read.schema(DICTIONARY).parquet(path), KEY, "left_anti")
    lacking.mapInPandas(_parse_batches, DICTIONARY).write.mode("append").parquet(path)
    known = spark.read.schema(DICTIONARY).parquet(path)
    return known if present is None else materialise(known.drop("n").dropDuplicates(KEY).join(present, KEY, "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("n"), "utc"), "known")


def normalise_instants(df: DataFrame, raw: str, zone: str, order: str, ids: list[str], path: str | None = None) -> DataFrame:
    """(ids..., utc) for each row of df whose value names a time or date; exact copies of a row count once.

    A time is YYYY-MM-DDTHH:MM:SS.ffffffZ, a date without time of day YYYY-MM-DD.  Rows with null, blank, word,
    duration or impossible values give no row; a null zone is UTC, a null order dmy; an empty df an empty result.
    """
    text = F.col(raw)
    rows = df.select(*ids, text.alias("raw"), F.coalesce(F.col(zone), F.lit("")).alias("time_zone"), F.coalesce(F.col(order), F.lit("")).alias("date_order"))
    rows = rows.where(F.col("raw").rlike(r"(?U)\d[^\d]*\d") & ~F.col("raw").rlike(r"^\s*-?P[\dT]"))
    known = instant_dictionary(rows, path)
    return join_back(rows, known, KEY, ["utc"]).where("utc is not null").select(*ids, "utc").distinct()


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, raw, time_zone, date_order) of the three tables that hold times as text."""
    zones = table(spark, sf_dir, "sources", "source", "time_zone", "date_order")
    parts = [
        table(spark, sf_dir, "mentions", "mention_id", "dimension_name", "source", "normalized").where("dimension_name = 'temporal'").selectExpr("'mentions' tbl", "mention_id row_id", "source", "normalized raw"),
        table(spark, sf_dir, "timings", "timing_id", "source", "timestamp").selectExpr("'timings' tbl", "timing_id row_id", "source", "timestamp raw"),
        table(spark, sf_dir, "parsed_documents", "page_id", "source", "date").selectExpr("'parsed_documents' tbl", "page_id row_id", "source", "date raw"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("raw is not null")
    return rows.join(zones, "source", "left")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_instants(time_texts(spark, sf_dir), "raw", "time_zone", "date_order", ["tbl", "row_id"])
