"""What entities of a domain must have, what follows from what they have, and classes that must lie under others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.closure import reach
from quarry.operators.stage import stored
from quarry.sources.quads import RDF

OWL, SUBCLASS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#subClassOf"

# The properties that entities of each domain must have, by type, in the order in which they are missed.
REQUIRED = {
    "supply_chain": {"ProductBatch": ["hasBatchID", "originFarm"], "ProcessingActivity": ["processingDate"], "TransportActivity": ["transportDate"], "QualityCheck": ["qualityCheckDate"], "Supplier": ["supplierName"]},
    "healthcare": {"PatientRecord": ["hasPatientID"], "Treatment": ["procedureDate"], "MedicalDevice": ["medicalDeviceSerial"], "HealthcareProvider": ["healthcareProviderName"], "ClinicalTrial": ["clinicalTrialID"], "Medication": ["medicationName"]},
    "pharmaceutical": {"DrugBatch": ["hasDrugID", "hasBatchNumber"], "ClinicalTrial": ["clinicalTrialID"], "RegulatoryApproval": ["regulatoryBody"], "ManufacturingProcess": ["manufacturingDate"], "QualityControl": ["qcDate"], "PharmaceuticalIngredient": ["activeIngredient"]},
}
# What two properties of one entity let conclude.
CONCLUSIONS = {("producedBy", "locatedAt"): "InferredLocation", ("inputTo", "outputOf"): "InferredProcessChain"}


def missing_property(domain: Column, kind: Column, properties: Column, required: dict[str, dict[str, list[str]]] = REQUIRED) -> Column:
    """The first property that an entity of a domain and type must have and has not; null if it has all or none are asked for."""
    needed = F.create_map(*[x for d, kinds in required.items() for k, names in kinds.items() for x in (F.lit(f"{d}\n{k}"), F.array(*map(F.lit, names)))])
    asked = F.coalesce(needed[F.concat_ws("\n", domain, kind)], F.array().cast("array<string>"))
    has = F.coalesce(F.map_keys(properties), F.array().cast("array<string>"))
    return F.get(F.filter(asked, lambda n: ~F.array_contains(has, n)), F.lit(0))


def first_problem(properties: Column, validators: dict[str, list[tuple[str, Callable[[Column], Column]]]]) -> Column:
    """`property: reason` of the first value that a validator finds wrong, null if there is none.

    validators: for each property its reasons, each with a condition of the value
    that holds where it is wrong. A property that is not there has no problem.
    """
    out = F.when(F.lit(False), F.lit(""))
    for name, checks in validators.items():
        for reason, wrong in checks:
            out = out.when(properties[name].isNotNull() & wrong(properties[name]), F.lit(f"{name}: {reason}"))
    return out


def conclusions(properties: Column, rules: dict[tuple[str, str], str] = CONCLUSIONS) -> Column:
    """What follows of an entity's properties, as an array of relationships."""
    return F.array_compact(F.array(*[F.when(F.map_contains_key(properties, a) & F.map_contains_key(properties, b), F.lit(name)) for (a, b), name in rules.items()]))


def with_known_types(quads: DataFrame, known: list[str], type_of: str = RDF + "type") -> DataFrame:
    """g, known: of each named graph whether any subject has one of the known types."""
    hit = (F.col("p") == type_of) & F.col("o").isin(*known)
    return quads.where("g is not null").groupBy("g").agg(F.max(hit).alias("known"))


def outside_core(classes: DataFrame, subclass_edges: DataFrame, core: list[str]) -> DataFrame:
    """cls: classes (one column, cls) that lie under none of the core classes, whatever the number of steps.

    subclass_edges: sub, super. Followed from the core down, so that only what
    lies under it is joined, once for each core class.
    """
    spark = classes.sparkSession
    down = subclass_edges.select(F.col("super").alias("src"), F.col("sub").alias("dst"))
    under = reach(down, spark.createDataFrame([(c,) for c in core], "start string")).select(F.col("node").alias("cls")).distinct()
    return classes.select("cls").distinct().where(~F.col("cls").isin(*core)).join(under, "cls", "left_anti")


def qualified_violations(quads: DataFrame, type_of: str = RDF + "type") -> DataFrame:
    """s, class, property, filler, kind, wanted, found: instances with too few or too many fillers of a class.

    Restrictions come from the quads: a class under a restriction on a property
    with a filler class and a qualifiedCardinality, or its min or max. Instances
    and fillers count by their classes and all those above. Every instance is
    checked, also one without fillers; a filler counts once, under its name.
    """
    facts = {"onProperty": "property", "onClass": "filler", "qualifiedCardinality": "exactly", "minQualifiedCardinality": "min", "maxQualifiedCardinality": "max"}
    told = stored(quads.where(F.col("p").isin(SUBCLASS, *[OWL + n for n in facts])))  # the ontology: the quads of the instances are not read for it in each round
    parts = told.where(F.col("p") != SUBCLASS).groupBy(F.col("s").alias("restriction")).agg(*[F.min(F.when(F.col("p") == OWL + n, F.col("o"))).alias(c) for n, c in facts.items()])
    bounds = F.array_compact(F.array(*[F.when(F.col(k).try_cast("long").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).try_cast("long").alias("wanted"))) for k in ("exactly", "min", "max")]))
    rules = parts.where("property is not null and filler is not null").select("restriction", "property", "filler", F.explode(bounds).alias("b")).select("restriction", "property", "filler", "b.*")
    edges = told.where(F.col("p") == SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
    up = stored(reach(edges, edges.select(F.col("src").alias("start")).distinct()).select(F.col("start").alias("sub"), F.col("node").alias("above")))
    rules = stored(rules.join(edges.select(F.col("src").alias("class"), F.col("dst").alias("restriction")), "restriction").drop("restriction").distinct())
    # only what a restriction asks of counts: instances and fillers are lifted to those classes alone, and shuffled once
    asked = rules.select(F.explode(F.array("class", "filler")).alias("above")).distinct()
    lift = stored(up.join(asked, "above", "left_semi").unionByName(asked.select(F.col("above").alias("sub"), "above")).distinct())
    typed = quads.where(F.col("p") == type_of).select("s", F.col("o").alias("sub"))
    lifted = lambda side: typed.join(lift.join(rules.select(F.col(side).alias("above")).distinct(), "above", "left_semi"), "sub").select("s", F.col("above").alias(side)).repartition("s").distinct()
    bound = lifted("class").join(rules, "class")
    fillers = quads.join(rules.select(F.col("property").alias("p")).distinct(), "p", "left_semi").select("s", F.col("p").alias("property"), "o").repartition("o").distinct()
    counted = fillers.join(lifted("filler").withColumnRenamed("s", "o"), "o").groupBy("s", "property", "filler").agg(F.count(F.lit(1)).alias("found"))
    checked = bound.join(counted, ["s", "property", "filler"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    wrong = F.when(F.col("kind") == "exactly", F.col("found") != F.col("wanted")).when(F.col("kind") == "min", F.col("found") < F.col("wanted")).otherwise(F.col("found") > F.col("wanted"))
    return checked.where(wrong).select("s", "class", "property", "filler", "kind", "wanted", "found")
