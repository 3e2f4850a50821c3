"""Registry files as one normalized record, and records as quads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.strings import first_filled, midnight, safe_identifier, slug
from quarry.sources.quads import RDF, as_quads

VERSION = "1.0"


def _record(df: DataFrame, source: str, domain: str, kind: str, key: Column, name: Column, owner: Column, date: Column, second: list[tuple[str, Column]], attributes: dict[str, Column]) -> DataFrame:
    """Rows in the normalized form; those without a key are left out."""
    others = F.filter(F.array(*[F.struct(F.lit(t).alias("type"), c.cast("string").alias("value")) for t, c in second]), lambda x: x["value"].isNotNull())
    made = F.map_filter(F.create_map(*[x for k, c in attributes.items() for x in (F.lit(k), c.cast("string"))]), lambda k, v: v.isNotNull())
    out = df.select(
        F.lit(VERSION).alias("schema_version"),
        F.concat(F.lit(f"{source}-"), safe_identifier(key)).alias("record_id"),
        F.lit(source).alias("source_id"),
        F.lit(domain).alias("domain"),
        F.lit(kind).alias("record_type"),
        F.struct(name.alias("name"), owner.alias("participant"), slug(owner).alias("participant_id"), midnight(date).alias("recorded_at")).alias("core"),
        F.struct(key.alias("primary"), others.alias("secondary")).alias("identifiers"),
        made.alias("attributes"),
    )
    return out.where(F.col("identifiers.primary").isNotNull())


def _c(name: str) -> Column:
    return F.col(name).cast("string")


def drugs(df: DataFrame) -> DataFrame:
    """Drug listings (results of the file's array): product_ndc, generic_name, brand_name, labeler_name, ..."""
    return _record(df, "drug-ndc", "pharmaceutical", "drug", first_filled(_c("product_ndc")), first_filled(_c("brand_name"), _c("generic_name")), first_filled(_c("labeler_name")), _c("marketing_start_date"), [("generic_name", first_filled(_c("generic_name")))], {"dosage_form": _c("dosage_form"), "expires": midnight(_c("listing_expiration_date"))})


def shortages(df: DataFrame) -> DataFrame:
    return _record(df, "drug-shortage", "pharmaceutical", "shortage", first_filled(_c("package_ndc")), first_filled(_c("proprietary_name"), _c("generic_name")), first_filled(_c("company_name")), first_filled(_c("update_date"), _c("initial_posting_date")), [("generic_name", first_filled(_c("generic_name")))], {"status": _c("status"), "reason": _c("shortage_reason"), "availability": _c("availability")})


def devices(df: DataFrame) -> DataFrame:
    return _record(df, "device-registry", "healthcare", "device", first_filled(_c("PrimaryDI")), first_filled(_c("BrandName"), _c("DeviceDescription")), first_filled(_c("CompanyName")), _c("PublishDate"), [("record_key", first_filled(_c("PublicDeviceRecordKey"))), ("model", first_filled(_c("VersionModelNumber")))], {"description": _c("DeviceDescription")})


def foods(df: DataFrame) -> DataFrame:
    return _record(df, "food-central", "food", "food", first_filled(_c("fdcId")), first_filled(_c("description")), first_filled(_c("brandOwner"), F.lit("unknown")), _c("publicationDate"), [("gtin", first_filled(_c("gtinUpc")))], {"data_type": _c("dataType"), "class": _c("foodClass")})


def arrays_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The elements of several arrays of structs of one row as rows; arrays that are not there are empty."""
    there = [n for n in names if n in df.columns]
    out = None
    for n in there:
        part = df.select(F.explode(n).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"none of {names} is there")
    return out


def record_quads(records: DataFrame, base: str = "urn:record:") -> DataFrame:
    """A participant, an entity and an activity for each record."""
    item, who, act = F.concat(F.lit(base), "record_id"), F.concat(F.lit(base + "participant:"), "core.participant_id"), F.concat(F.lit(base), "record_id", F.lit(":recorded"))
    graph = F.concat(F.lit(base + "graph:"), "record_id")
    prov = "http://www.w3.org/ns/prov#"
    entity = as_quads(records, item, {RDF + "type": (F.lit(prov + "Entity"), "iri", None), prov + "label": (F.col("core.name"), "literal", None), prov + "wasAttributedTo": (F.when(F.col("core.participant_id").isNotNull(), who), "iri", None), prov + "wasGeneratedBy": (act, "iri", None)}, graph)
    agent = as_quads(records.where("core.participant_id is not null"), who, {RDF + "type": (F.lit(prov + "Agent"), "iri", None), prov + "label": (F.col("core.participant"), "literal", None)}, graph)
    activity = as_quads(records, act, {RDF + "type": (F.lit(prov + "Activity"), "iri", None), prov + "endedAtTime": (F.col("core.recorded_at"), "literal", "http://www.w3.org/2001/XMLSchema#dateTime")}, graph)
    return entity.unionByName(agent).unionByName(activity).dropDuplicates()


def scale_chain(spark, batches: int, hops: int = 3) -> DataFrame:
    """A generated supply chain as rows: quantity 50 + 7 i mod 175, then 98 and 95 hundredths of it."""
    factor = F.element_at(F.array(F.lit(1.0), F.lit(0.98), F.lit(0.95)), F.col("hop").cast("int") + 1)
    rows = spark.range(batches).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0), F.lit(hops - 1))).alias("hop"))
    return rows.select("batch", "hop", (F.col("batch") * hops + F.col("hop")).alias("tx"), F.round((50 + (7 * F.col("batch")) % 175) * factor, 4).alias("quantity"), (F.col("batch") % 20).alias("producer"), F.when(F.col("hop") < hops - 1, F.col("batch") * hops + F.col("hop") + 1).alias("next_tx"))
