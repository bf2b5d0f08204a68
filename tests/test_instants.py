import pytest
from pyspark.sql import functions as F

from tesseral.functions.instants import parse_instant
from tesseral.operators.instants import instant_dictionary, normalise_instants

CASES = [
    ("2024-12-27T24:00", "Europe/Berlin", None, "2024-12-27T23:00:00.000000Z"),
    ("2023-W07-5T13:36", None, None, "2023-02-17T13:36:00.000000Z"),
    ("2023-06-18T04:11:02.123456789Z", None, None, "2023-06-18T04:11:02.123456Z"),
    ("2023-04-08 06:14:14,735", None, None, "2023-04-08T06:14:14.735000Z"),
    ("20230528T040920Z", None, None, "2023-05-28T04:09:20.000000Z"),
    ("2022-11-25T18:38:31+08", "Asia/Tokyo", None, "2022-11-25T10:38:31.000000Z"),
    ("2022-06-06T17:49:29-03:00[America/Sao_Paulo]", None, None, "2022-06-06T20:49:29.000000Z"),
    ("Fri, 29 Nov 2024 22:48:49 -0300", None, None, "2024-11-30T01:48:49.000000Z"),
    ("Nov 7, 2021 1:00:10 am EDT", "America/New_York", None, "2021-11-07T05:00:10.000000Z"),
    ("Dec 26, 2024 6:07:23 pm BRT", "America/Sao_Paulo", None, "2024-12-26T21:07:23.000000Z"),
    ("14 Dec 2024 05:15 UTC-5", None, None, "2024-12-14T10:15:00.000000Z"),
    ("27.12.2024 04:05 Uhr", "Europe/Berlin", None, "2024-12-27T03:05:00.000000Z"),
    ("03/07/2022 3:26 PM", None, "dmy", "2022-07-03T15:26:00.000000Z"),
    ("03/07/2022 3:26 PM", None, "mdy", "2022-03-07T15:26:00.000000Z"),
    ("8/6/24 12:10 AM", None, "dmy", "2024-06-08T00:10:00.000000Z"),
    ("1734465956", None, None, "2024-12-17T20:05:56.000000Z"),
    ("1734465956.0", None, None, "2024-12-17T20:05:56.000000Z"),
    ("1729985992123", None, None, "2024-10-26T23:39:52.123000Z"),
    ("2021-03-14T02:30:00", "America/New_York", None, "2021-03-14T07:30:00.000000Z"),  # skipped: forward by the gap
    ("2021-11-07T01:30:00", "America/New_York", None, "2021-11-07T05:30:00.000000Z"),  # repeated: the first
    ("2023-10-10/2023-10-20", None, None, "2023-10-10"),
    ("2022-02-03T21:48:10/2022-02-04T02:48:10Z", "Asia/Tokyo", None, "2022-02-03T12:48:10.000000Z"),
    ("2024", None, None, "2024-01-01"), ("2022-07", None, None, "2022-07-01"), ("20231221", None, None, "2023-12-21"),
    ("18. März 2023", None, None, "2023-03-18"), ("19 août 2021", None, None, "2021-08-19"), ("12 de septiembre de 2024", None, None, "2024-09-12"),
    ("Wed 24 May 2023", None, None, "2023-05-24"), ("May 28, 2023", None, None, "2023-05-28"), ("  2024-02-29 ", None, None, "2024-02-29"),
    (None, None, None, None), ("", None, None, None), ("  ", None, None, None), ("P1Y2M", None, None, None), ("PT45M", None, None, None), ("yesterday", None, None, None),
    ("2023-02-29", None, None, None), ("2023-13-01T00:00:00", None, None, None), ("31/04/2023 09:15", None, "dmy", None), ("25:61", None, None, None), ("0000-00-00 00:00:00", None, None, None), ("9" * 5000, None, None, None),
]


@pytest.mark.parametrize("raw,zone,order,want", CASES)
def test_notations(raw, zone, order, want):
    assert parse_instant(raw, zone, order) == want


def test_rows_nulls_copies_and_clashing_names(spark):
    rows = [(i % 50, "2024", None, None, "x") for i in range(200)] + [(900, None, None, None, "x"), (901, "2022-01-02T03:04:05", "Asia/Tokyo", "dmy", "x"), (901, "2022-01-02T03:04:05", "Asia/Tokyo", "dmy", "x")]
    df = spark.createDataFrame(rows, "id long, value string, zone string, ord string, utc string")
    got = {tuple(r) for r in normalise_instants(df, "value", "zone", "ord", ["id"]).collect()}
    assert got == {(i, "2024-01-01") for i in range(50)} | {(901, "2022-01-01T18:04:05.000000Z")}
    assert normalise_instants(df.limit(0), "value", "zone", "ord", ["id"]).count() == 0


def test_dictionary_is_extended(spark, tmp_path):
    path = f"file://{tmp_path}/dictionary"
    key = "raw string, time_zone string, date_order string"
    instant_dictionary(spark.createDataFrame([("2024", "", ""), ("2023", "", "")], key), path)
    known = instant_dictionary(spark.createDataFrame([("2024", "", ""), ("2022", "", "")], key), path)
    assert sorted(r["raw"] for r in known.collect()) == ["2022", "2023", "2024"]
    assert known.where(F.col("raw") == "2024").first()["n"] == 1
    again = instant_dictionary(spark.createDataFrame([("2022", "", "")] * 5, key), path)
    assert {r["raw"]: r["n"] for r in again.collect()} == {"2022": 5, "2023": 0, "2024": 0}


def test_full_width_digits_and_long_values(spark):
    """No value is left out for its digits' width or its length."""
    rows = [(1, "２０２３-０１-０５"), (2, "2023-01-05" + " " * 400), (3, "2023-01-05T10:00:00." + "1" * 300 + "Z"), (4, "word " * 100), (5, "7 " * 5000)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "id long, value string, zone string, ord string")
    got = {tuple(r) for r in normalise_instants(df, "value", "zone", "ord", ["id"]).collect()}
    assert got == {(1, "2023-01-05"), (2, "2023-01-05"), (3, "2023-01-05T10:00:00.111111Z")}
