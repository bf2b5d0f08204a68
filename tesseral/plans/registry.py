"""Query and oracle registries of the core; the entry module adds those of the optional subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesseral.operators.instants import p5_found
from tesseral.operators.near import p4_found
from tesseral.plans import more_oracle, oracle
from tesseral.plans.core_queries import QUERIES
from tesseral.plans.more_queries import QUERIES as MORE

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p4_found": p4_found, "p5_found": p5_found} | {f.__name__: f for f in [*QUERIES, *MORE]}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | more_oracle.MORE
