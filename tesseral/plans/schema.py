"""Schemas of dimensions: configuration, merging, and the struct types built of them.  Plain values on the driver."""

from __future__ import annotations

import copy
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"string": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "float": T.DoubleType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "enum": T.StringType()}
MANDATORY = {"temporal": ("normalized", ["timestamp", "date", "month", "year"]), "spatial": ("geocoded", ["location", "city", "state", "country"])}


def snake_case(name: str) -> str:
    return re.sub(r"[\s_-]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name).strip()).lower()


def pascal_case(name: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in re.split(r"[\s_-]+", name) if w)


@dataclass
class Dimension:
    name: str
    kind: str = "categorical"
    hierarchy: list[str] = field(default_factory=list)
    values: dict[str, list[str]] = field(default_factory=dict)
    enabled: bool = True

    def struct(self) -> T.StructType:
        """text, confidence, and a field for each level."""
        levels = [T.StructField(snake_case(h), T.StringType()) for h in self.hierarchy]
        extra = {"normalized": [T.StructField("normalized", T.StringType())], "geocoded": [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]}.get(self.kind, [])
        return T.StructType([T.StructField("text", T.StringType(), False), T.StructField("confidence", T.DoubleType()), *levels, *extra])


def kind_of(name: str, hierarchy: list[str]) -> str:
    """normalized for times, geocoded for places, else categorical."""
    low = {snake_case(x) for x in [name, *hierarchy]}
    if low & {"temporal", "time", "date", "timestamp"}:
        return "normalized"
    return "geocoded" if low & {"spatial", "location", "latitude", "longitude"} else "categorical"


def merged(base: dict, override: dict) -> dict:
    """Deep merge; values of the override win, lists are replaced."""
    out = copy.deepcopy(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def dimensions_of(config: dict) -> dict[str, Dimension]:
    """Enabled dimensions of a configuration {name: {hierarchy, kind, values, enabled}}, with time and place unless they are disabled."""
    out = {}
    for name, d in {**{k: {} for k in MANDATORY}, **config}.items():
        d = d or {}
        kind, levels = MANDATORY.get(name, (None, []))
        hierarchy = list(d.get("hierarchy") or levels)
        if d.get("enabled", True):
            if name not in MANDATORY and not [h for h in hierarchy if h.strip()]:
                raise ValueError(f"dimension {name} has no levels")
            out[name] = Dimension(name, d.get("kind") or kind or kind_of(name, hierarchy), hierarchy, dict(d.get("values") or {}))
    if not out:
        raise ValueError("no dimension is enabled")
    return out


def entities_type(dimensions: dict[str, Dimension]) -> T.StructType:
    """The struct of an extraction: an array of each dimension's struct."""
    return T.StructType([T.StructField(n, T.ArrayType(d.struct())) for n, d in sorted(dimensions.items())])


def parsed_extractions(df: DataFrame, column: str, dimensions: dict[str, Dimension]) -> DataFrame:
    """df with entities of a JSON column, only what the schema has; broken JSON gives null."""
    return df.withColumn("entities", F.from_json(column, entities_type(dimensions)))


def accepted_proposals(proposed: DataFrame, known: list[str], least: float = 0.7) -> DataFrame:
    """Proposed dimensions (name, confidence) that are new and confident enough, by their normal name."""
    name = F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_"))
    p = proposed.where(F.col("confidence") >= least).select(name.alias("name"), "confidence").groupBy("name").agg(F.max("confidence").alias("confidence"))
    return p.where(~F.col("name").isin(*[snake_case(k) for k in known]) if known else F.lit(True))
