"""Shape checks and inference over quads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.closure import reach
from quarry.sources.quads import RDF

_CASTS = {"integer": "bigint", "decimal": "decimal(38,18)", "boolean": "boolean", "dateTime": "timestamp", "date": "date", "double": "double"}


@dataclass(frozen=True)
class Property:
    """What a shape asks of the values of a predicate."""

    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    node_kind: str | None = None
    value_class: str | None = None


def lexical(value: Column, datatype: str) -> Column:
    """Whether value can be read as the named XML Schema type."""
    return value.try_cast(_CASTS[datatype]).isNotNull() if datatype in _CASTS else F.lit(True)


def subclasses(quads: DataFrame) -> DataFrame:
    """sub, super: the reflexive and transitive closure of rdfs:subClassOf."""
    edges = quads.where(F.col("p") == "http://www.w3.org/2000/01/rdf-schema#subClassOf").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    far = reach(edges, edges.select(F.col("src").alias("start"))).select(F.col("start").alias("sub"), F.col("node").alias("super"))
    every = edges.select(F.explode(F.array("src", "dst")).alias("sub")).distinct().select("sub", F.col("sub").alias("super"))
    return far.unionByName(every).distinct()


def validate(quads: DataFrame, target: str, properties: list[Property]) -> DataFrame:
    """s, path, problem: what the instances of a class, or of one below it, break.

    Counts of all properties come from one grouping of the instances' quads.
    """
    types = quads.where(F.col("p") == RDF + "type").select("s", F.col("o").alias("cls"))
    below = subclasses(quads)
    inside = types.join(below.where(F.col("super") == target), types["cls"] == below["sub"], "left_semi").unionByName(types.where(F.col("cls") == target)).select("s").distinct()
    values = inside.join(quads.where(F.col("p").isin(*{q.path for q in properties})), "s", "left")
    counts = values.groupBy("s").agg(*[F.count(F.when(F.col("p") == q.path, 1)).alias(f"n{i}") for i, q in enumerate(properties)])
    broken = [F.when(F.col(f"n{i}") < (q.min_count or 0), F.struct(F.lit(q.path).alias("path"), F.lit("minCount").alias("problem"))) for i, q in enumerate(properties)]
    broken += [F.when(F.col(f"n{i}") > q.max_count, F.struct(F.lit(q.path).alias("path"), F.lit("maxCount").alias("problem"))) for i, q in enumerate(properties) if q.max_count is not None]
    out = counts.select("s", F.explode(F.array(*broken)).alias("x")).where("x is not null").select("s", "x.path", "x.problem")
    for q in properties:
        of = values.where(F.col("p") == q.path)
        checks = [(q.datatype, "datatype", lambda q=q: lexical(F.col("o"), q.datatype)), (q.pattern, "pattern", lambda q=q: F.col("o").rlike(q.pattern)), (q.one_of, "in", lambda q=q: F.col("o").isin(*q.one_of)), (q.node_kind, "nodeKind", lambda q=q: F.col("o_kind") == q.node_kind)]
        for wanted, problem, test in checks:
            if wanted:
                out = out.unionByName(of.where(~test()).select("s", "p").select("s", F.col("p").alias("path"), F.lit(problem).alias("problem")))
        if q.value_class:
            good = types.join(below.where(F.col("super") == q.value_class), types["cls"] == below["sub"], "left_semi").unionByName(types.where(F.col("cls") == q.value_class)).select(F.col("s").alias("o"))
            out = out.unionByName(of.join(good, "o", "left_anti").select("s", F.col("p").alias("path"), F.lit("class").alias("problem")))
    return out.distinct()


def chain(quads: DataFrame, steps: list[str], implied: str) -> DataFrame:
    """s, p, o that a chain of predicates implies: p1 o p2 o ... => implied."""
    out = quads.where(F.col("p") == steps[0]).select("s", F.col("o").alias("at"))
    for p in steps[1:]:
        out = out.join(quads.where(F.col("p") == p).select(F.col("s").alias("at"), F.col("o").alias("to")), "at").select("s", F.col("to").alias("at"))
    return out.select("s", F.lit(implied).alias("p"), F.col("at").alias("o")).distinct()


def duplicate_keys(quads: DataFrame, keys: list[str]) -> DataFrame:
    """cls, p, o, n: values of key predicates that more than one instance of a class has."""
    types = quads.where(F.col("p") == RDF + "type").select("s", F.col("o").alias("cls"))
    return quads.where(F.col("p").isin(*keys)).join(types, "s").groupBy("cls", "p", "o").agg(F.countDistinct("s").alias("n")).where("n > 1")
