"""Joining a dictionary of distinct values back to rows in which a few values may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
FEW_ROWS = 100_000  # rows that a join may broadcast


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for a join that broadcasts neither side, unless at most FEW_ROWS rows were counted.

    Spark sizes a stored table by its compressed files, and what an explode or a kernel makes of it by little else, so
    a table of many times the driver's room may pass for one under spark.sql.autoBroadcastJoinThreshold.
    """
    return df if rows is not None and rows <= FEW_ROWS else df.hint("merge")


def join_back(rows: DataFrame, known: DataFrame, keys: list[str], columns: list[str], count: str = "n") -> DataFrame:
    """rows with columns of known, one row of known at most for each key; rows without one are dropped.

    known must be stored (it is read three times) and count has the rows of each key.  Keys with over a
    HOT_KEYS-th of all rows, so at most HOT_KEYS of them, are broadcast; all other keys meet in a shuffled join
    once there are over FEW_ROWS of them.
    """
    total, values = known.agg(F.coalesce(F.sum(count), F.lit(0)), F.count(F.lit(1))).first()
    hot = F.col(count) > max(total // HOT_KEYS, 1000)
    few = F.broadcast(known.where(hot).select(*keys, *columns, F.lit(True).alias("__hot")))
    marked = rows.drop(*columns).join(few, keys, "left")
    done = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot is null").drop("__hot", *columns).join(shuffled(known.where(~hot).select(*keys, *columns), values), keys)
    return done.unionByName(rest)
