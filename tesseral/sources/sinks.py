"""Writers: parquet with native nesting or flattened, JSON lines, CSV, and map features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, named with _json."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f"{f.name}_json") if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat(df).write.mode(mode).option("header", True).csv(path)


def previews(df: DataFrame, text: str = "text", limit: int = 500) -> DataFrame:
    return df.withColumn(text, F.substring(text, 1, limit))


def geojson(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """GeoJSON text sequences: one feature a line, so a file of any size is written by many tasks."""
    features.select(F.col("feature").alias("value")).write.mode(mode).text(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys the stored table lacks: the resume of an interrupted run."""
    from tesseral.sources.readers import exists

    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    df.write.mode("append").parquet(path)
