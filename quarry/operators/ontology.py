"""What an ontology in quads says: its shapes, its classes, and where it contradicts itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.quads import RDF

OWL = "http://www.w3.org/2002/07/owl#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SHACL = "http://www.w3.org/ns/shacl#"

#: Kinds of a property that exclude each other.
OPPOSITES = (("SymmetricProperty", "AsymmetricProperty"), ("ReflexiveProperty", "IrreflexiveProperty"))


def contradictions(quads: DataFrame) -> DataFrame:
    """kind, s, o: classes both equivalent to and disjoint with another, and properties of two kinds that exclude each other (o null).

    Each check groups the few quads it needs once, with a flag for each side,
    so that no side is joined with itself; repeated quads count once.
    """
    both = lambda col, a, b: (F.max(F.when(F.col(col) == OWL + a, 1)) + F.max(F.when(F.col(col) == OWL + b, 1))) == 2
    pairs = quads.where(F.col("p").isin(OWL + "equivalentClass", OWL + "disjointWith")).groupBy("s", "o").agg(both("p", "equivalentClass", "disjointWith").alias("hit"))
    kinds = quads.where((F.col("p") == RDF + "type") & F.col("o").isin(*[OWL + k for two in OPPOSITES for k in two]))
    flags = kinds.groupBy("s").agg(F.array(*[F.when(both("o", a, b), F.lit(a)) for a, b in OPPOSITES]).alias("hits"))
    props = flags.select(F.explode("hits").alias("kind"), "s", F.lit(None).cast("string").alias("o")).where("kind is not null")
    return pairs.where("hit").select(F.lit("equivalentClass").alias("kind"), "s", "o").unionByName(props)


def classes(quads: DataFrame, prefix: str) -> DataFrame:
    """cls, label: classes whose name begins with prefix and each of their labels, the name itself where there is none."""
    found = quads.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Class") & F.col("s").startswith(prefix)).select(F.col("s").alias("cls")).distinct()
    labels = quads.where(F.col("p") == RDFS + "label").select(F.col("s").alias("cls"), F.col("o").alias("label"))
    return found.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label")).distinct()


def shapes(quads: DataFrame) -> DataFrame:
    """shape, target, path, datatype, cls, min_count, max_count: a row for each property of each node shape.

    Blank nodes are taken within their graph (g). A property without a path is
    left out; of several values of a facet the smallest counts; a count that is
    no number is null. What is said twice counts once before sides meet, so that
    repeated quads of a shape make no pairs.
    """
    of = lambda name: quads.where(F.col("p") == SHACL + name)
    nodes = quads.where((F.col("p") == RDF + "type") & (F.col("o") == SHACL + "NodeShape")).select("g", "s").distinct()
    targets = of("targetClass").select("g", "s", F.col("o").alias("target")).distinct()
    held = of("property").select("g", "s", F.col("o").alias("property")).distinct()
    facet = lambda name: F.min(F.when(F.col("p") == SHACL + name, F.col("o")))
    facets = quads.where(F.col("p").isin(*[SHACL + n for n in ("path", "datatype", "class", "minCount", "maxCount")])).groupBy("g", F.col("s").alias("property"))
    facets = facets.agg(facet("path").alias("path"), facet("datatype").alias("datatype"), facet("class").alias("cls"), facet("minCount").try_cast("int").alias("min_count"), facet("maxCount").try_cast("int").alias("max_count")).where("path is not null")
    rows = nodes.join(targets, ["g", "s"]).join(held, ["g", "s"]).join(facets, ["g", "property"])
    return rows.select(F.col("s").alias("shape"), "target", "path", "datatype", "cls", "min_count", "max_count").distinct()
