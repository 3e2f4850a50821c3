"""Entities filled up from resolvers: what each knows of the entities it answers for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Resolver:
    """Answers where `answers` holds, with properties, a confidence and maybe a label."""

    answers: Column
    properties: dict[str, str]
    confidence: float
    label: str | None = None


def enrich(entities: DataFrame, resolvers: list[Resolver]) -> DataFrame:
    """Entities with properties (map of strings), label and confidence after each resolver in turn.

    A resolver's properties fill vacant keys only and its label a missing one;
    confidence becomes the mean of both. `enriched` tells whether anything was
    filled: where nothing was, all stays as it came. Null properties are empty.
    """
    out = entities.withColumns({"properties": F.coalesce("properties", F.create_map().cast("map<string,string>")), "_p": F.coalesce("properties", F.create_map().cast("map<string,string>")), "_l": F.col("label"), "_c": F.col("confidence"), "enriched": F.lit(False)})
    for r in resolvers:
        answers = F.coalesce(r.answers, F.lit(False))
        known = F.create_map(*[F.lit(x) for pair in r.properties.items() for x in pair])
        vacant = F.map_filter(known, lambda k, v: ~F.map_contains_key(F.col("_p"), k))
        label = F.lit(r.label).cast("string")
        filled = (F.size(vacant) > 0) | (F.col("_l").isNull() & label.isNotNull())
        new = {"_p": F.map_concat("_p", vacant), "_l": F.coalesce("_l", label), "_c": (F.col("_c") + r.confidence) / 2}
        out = out.withColumns({k: F.when(answers, v).otherwise(F.col(k)) for k, v in new.items()} | {"enriched": F.col("enriched") | (answers & filled)})
    keep = {"properties": "_p", "label": "_l", "confidence": "_c"}
    return out.withColumns({k: F.when(F.col("enriched"), F.col(v)).otherwise(F.col(k)) for k, v in keep.items()}).drop("_p", "_l", "_c")
