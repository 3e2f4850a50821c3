"""Field rules, ontology checks, enrichment, event documents and repair plans, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fields
from quarry.operators import ontology
from quarry.operators.enrich import Resolver, enrich
from quarry.plans.quads import _VALID, chain_verdicts
from quarry.plans.tables import table
from quarry.sources.epcis import event_jsonld, event_turtle
from quarry.sources.quads import RDF


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _quads(df: DataFrame, *rows: tuple) -> DataFrame:
    """g, s, p, o from a row each of s, p, o columns; rows with a null are left out."""
    made = [F.struct(F.lit("urn:g").alias("g"), s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in rows]
    return df.select(F.explode(F.array(*made)).alias("q")).select("q.*").where("s is not null and p is not null and o is not null")


def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a form of four fields: of each field the first rule its value breaks, null if it keeps all."""
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 9 == 0, F.lit(None)).when(key % 7 == 0, F.lit("  ")).when(key % 5 == 0, F.col("c_name")).otherwise(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@mail.org"))).alias("email"),
        F.when(key % 6 == 0, F.lit("ab")).when(key % 11 == 0, F.repeat("c_mktsegment", F.lit(5))).when(key % 4 == 0, F.col("c_name")).otherwise(F.lower("c_mktsegment")).alias("user"),
        F.when(key % 3 == 0, F.concat(F.lit("b"), key)).when(key % 8 != 0, F.concat(F.lit("LOT"), key)).alias("batch"),
        F.when(key % 3 == 0, F.concat(F.lit("urn:c:"), key)).when(key % 4 == 0, F.concat(F.lit("http://a b"), key)).when(key % 10 == 1, F.lit("urn:x';drop")).otherwise(F.concat(F.lit("https://c.org/"), key)).alias("uri"),
    )
    e, u, b, i = (F.col(x) for x in ("email", "user", "batch", "uri"))
    return c.select(
        "c_custkey",
        fields.first_broken(required=fields.required(e), email=fields.unlike(e, fields.EMAIL)).alias("email"),
        fields.first_broken(required=fields.required(u), min=fields.shorter(u, 3), max=fields.longer(u, 32), username=fields.unlike(u, fields.USERNAME)).alias("user"),
        fields.first_broken(batch_id=fields.unlike(b, fields.BATCH_ID)).alias("batch"),
        fields.first_broken(injection=fields.injected(i), uri=fields.unlike(i, fields.URI)).alias("uri"),
    )


def date_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from each item's shipping on, asked for on the last day of 1997, by what is wrong with them."""
    key, day = F.col("l_orderkey"), F.col("l_shipdate").cast("date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    start = F.when(key % 13 == 0, F.lit("1997-02-30")).when(key % 17 == 0, F.lit("97-1-1")).otherwise(text(day))
    end = F.when(key % 19 == 0, F.lit(None)).when(key % 5 == 0, text(F.date_sub(day, 1))).when(key % 3 == 0, text(F.date_add(day, 731))).otherwise(text(F.date_add(day, 730)))
    found = fields.range_problem(start, end, F.lit("1997-12-31").cast("date"))
    return table(spark, sf_dir, "lineitem").groupBy(F.coalesce(found, F.lit("none")).alias("problem")).agg(_n())


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names to eight shards by hash, by first letter and by both."""
    p = table(spark, sf_dir, "part")
    name = F.col("p_name")
    return p.groupBy(fields.hash_shard(name, 8).alias("hash"), fields.range_shard(name, 8).alias("range"), fields.composite_shard(name, 8).alias("composite")).agg(_n())


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as axioms of classes and customers as kinds of properties: where these contradict each other."""
    key, c = F.col("p_partkey"), F.col("c_custkey")
    cls = lambda n: F.concat(F.lit("urn:class/"), n)
    pairs = _quads(table(spark, sf_dir, "part"), (cls(key % 40), F.when(key % 3 == 0, ontology.OWL + "equivalentClass").otherwise(ontology.OWL + "disjointWith"), cls(F.col("p_size") % 9)))
    kind = F.when(c % 7 == 0, "SymmetricProperty").when(c % 7 == 1, "AsymmetricProperty").when(c % 7 == 2, "ReflexiveProperty").when(c % 7 == 3, "IrreflexiveProperty").otherwise("FunctionalProperty")
    kinds = _quads(table(spark, sf_dir, "customer"), (F.concat(F.lit("urn:property/"), F.col("c_nationkey"), F.lit("-"), "c_mktsegment"), F.lit(RDF + "type"), F.concat(F.lit(ontology.OWL), kind)))
    return ontology.contradictions(pairs.unionByName(kinds))


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of parts as classes, some with labels: those of one prefix."""
    key = F.col("p_partkey")
    cls = F.concat(F.when(key % 2 == 0, F.lit("urn:core#")).otherwise(F.lit("urn:other#")), F.col("p_size"))
    quads = _quads(table(spark, sf_dir, "part"), (cls, F.lit(RDF + "type"), F.lit(ontology.OWL + "Class")), (F.when(F.col("p_size") % 3 == 0, cls), F.lit(ontology.RDFS + "label"), F.col("p_brand")))
    return ontology.classes(quads, "urn:core#")


def shape_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as property shapes of their nations' node shapes: the shapes read from these quads."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    sh = ontology.SHACL
    shape, prop = F.concat(F.lit("urn:shape/"), nation), F.concat(F.lit("_:p"), key)
    rows = [
        (F.when(nation % 5 != 0, shape), F.lit(RDF + "type"), F.lit(sh + "NodeShape")),
        (shape, F.lit(sh + "targetClass"), F.concat(F.lit("urn:core#N"), nation)),
        (shape, F.lit(sh + "property"), prop),
        (F.when(key % 11 != 0, prop), F.lit(sh + "path"), F.concat(F.lit("urn:core#p"), key)),
        (F.when(key % 2 == 0, prop), F.lit(sh + "datatype"), F.lit("xsd:decimal")),
        (F.when(key % 4 == 1, prop), F.lit(sh + "class"), F.lit("urn:core#Batch")),
        (prop, F.lit(sh + "minCount"), F.when(key % 3 == 0, "1").when(key % 3 == 1, "one")),
        (prop, F.lit(sh + "maxCount"), F.when(key % 7 == 0, (key % 5).cast("string"))),
    ]
    return ontology.shapes(_quads(table(spark, sf_dir, "supplier"), *rows))


def enriched_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities, filled up by a resolver of places and one of companies."""
    key = F.col("c_custkey")
    kind = F.when(key % 4 == 0, "Location").when(key % 4 == 1, "Farmer").when(key % 4 == 2, "Manufacturer").otherwise("Auditor")
    props = F.when(key % 3 == 0, F.create_map(F.lit("industry"), F.lower("c_mktsegment"), F.lit("country"), F.col("c_nationkey").cast("string"))).when(key % 3 == 1, F.create_map(F.lit("founded"), (1900 + key % 100).cast("string")))
    e = table(spark, sf_dir, "customer").select(F.when(key % 20 == 3, F.concat(F.lit("urn:geo/"), key)).otherwise(F.concat(F.lit("urn:c/"), key)).alias("uri"), kind.alias("kind"), F.when(key % 5 != 0, F.col("c_name")).alias("label"), props.alias("properties"), ((key % 10) / 10).alias("confidence"))
    # What the two resolvers say.
    places = Resolver((F.col("kind") == "Location") | F.col("uri").contains("geo"), {"country": "Unknown", "latitude": "0.0", "longitude": "0.0"}, 0.7, "Geographic Location")
    companies = Resolver(F.col("kind").isin("Manufacturer", "Farmer"), {"industry": "Agriculture", "founded": "Unknown"}, 0.6)
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("properties"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), " ")
    return enrich(e, [places, companies]).select("uri", "label", flat.alias("properties"), F.round("confidence", 9).alias("confidence"), "enriched")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Turtle and as JSON-LD."""
    key = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "AggregationEvent").when(F.col("event_type") == "purchase", "TransactionEvent").otherwise("ObjectEvent")
    given = {
        "eventTime": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "action": F.when(key % 3 == 0, "ADD").when(key % 3 == 1, "OBSERVE"),
        "readPoint": F.concat(F.lit("urn:user:"), "user_id"),
        "disposition": F.when(key % 10 == 0, 'a "damaged" \\ one'),
        "batchNumber": F.concat(F.lit("B"), key % 97),
        "milkVolume": F.when(key % 2 == 0, key % 50),
    }
    name = F.concat(F.lit("urn:event/"), key)
    return table(spark, sf_dir, "events").select("event_id", event_turtle(name, kind, given).alias("turtle"), event_jsonld(name, kind, given).alias("jsonld"))


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would mend each faulty block; nothing is changed.

    Data that are not the graph's come from it again, a wrong hash is counted
    anew, a broken link set to the block before; then the later blocks of the
    chain (`follow`) are hashed anew, too.
    """
    v = chain_verdicts(spark, sf_dir).where("verdict != 'valid'")
    action = F.when(F.col("verdict") == "data", "restore data from the graph").when(F.col("verdict") == "hash", "count the hash anew").otherwise("link to the block before")
    return v.select("event_id", "verdict", action.alias("action"), (F.col("size") - F.col("index") - 1).cast("long").alias("follow"))


# The patterns once more, as what the SQL goes by.
_EMAIL, _USER, _BATCH = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", r"^[a-zA-Z0-9_-]{3,32}$", r"^[A-Z0-9]{3,20}$"
_URI = r"^https?://[^\s/$.?#].[^\s]*$|^[a-zA-Z][a-zA-Z0-9+.-]*:[^\s]*$"
_BAD = r"""regexp_matches(uri, '(?i)(union|select|insert|update|delete|drop|create|alter|exec|execute)') OR regexp_matches(uri, '(?i)(script|javascript|vbscript|onload|onerror)') OR regexp_matches(uri, '[''";]')"""
_HEAD = "@prefix epcis: <https://ref.gs1.org/epcis/> .\n@prefix milk: <urn:milk#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n\n<"
_CONTEXT = '{"@context":["https://ref.gs1.org/standards/epcis/2.0.0/epcis-context.jsonld",{"milk":"urn:milk#"}],"@id":"urn:event/'
_DAMAGED = 'a \\"damaged\\" \\\\ one'

QUERIES = {
    "field_rules": (field_rules, f"""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' WHEN c_custkey % 5 = 0 THEN c_name ELSE replace(c_name, '#', '.') || '@mail.org' END AS email,
          CASE WHEN c_custkey % 6 = 0 THEN 'ab' WHEN c_custkey % 11 = 0 THEN repeat(c_mktsegment, 5) WHEN c_custkey % 4 = 0 THEN c_name ELSE lower(c_mktsegment) END AS usr, CASE WHEN c_custkey % 3 = 0 THEN 'b' || c_custkey WHEN c_custkey % 8 <> 0 THEN 'LOT' || c_custkey END AS batch,
          CASE WHEN c_custkey % 3 = 0 THEN 'urn:c:' || c_custkey WHEN c_custkey % 4 = 0 THEN 'http://a b' || c_custkey WHEN c_custkey % 10 = 1 THEN 'urn:x'';drop' ELSE 'https://c.org/' || c_custkey END AS uri FROM customer)
        SELECT c_custkey, CASE WHEN email IS NULL OR trim(email) = '' THEN 'required' WHEN NOT regexp_matches(email, '{_EMAIL}') THEN 'email' END AS email,
          CASE WHEN usr IS NULL OR trim(usr) = '' THEN 'required' WHEN strlen(usr) < 3 THEN 'min' WHEN strlen(usr) > 32 THEN 'max' WHEN NOT regexp_matches(usr, '{_USER}') THEN 'username' END AS user,
          CASE WHEN NOT regexp_matches(batch, '{_BATCH}') THEN 'batch_id' END AS batch, CASE WHEN {_BAD} THEN 'injection' WHEN NOT regexp_matches(uri, '{_URI}') THEN 'uri' END AS uri FROM c"""),
    "date_problems": (date_problems, """WITH t AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem), r AS (SELECT CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN NULL ELSE d END AS a,
          CASE WHEN k % 19 = 0 THEN NULL WHEN k % 5 = 0 THEN d - 1 WHEN k % 3 = 0 THEN d + 731 ELSE d + 730 END AS b FROM t)
        SELECT CASE WHEN a IS NULL THEN 'start' WHEN b IS NULL THEN 'end' WHEN a > b THEN 'order' WHEN a - DATE '1997-12-31' > 365 THEN 'future' WHEN DATE '1997-12-31' - b > 1825 THEN 'past' WHEN b - a > 730 THEN 'span' ELSE 'none' END AS problem, count(*) AS n FROM r GROUP BY 1"""),
    "shards": (shards, """WITH p AS (SELECT ('0x' || md5(p_name)[1:8])::BIGINT % 8 AS hash, CAST(greatest(least((ascii(p_name) - 97) // 3, 7), 0) AS BIGINT) AS range FROM part)
        SELECT hash, range, (hash + range) % 8 AS composite, count(*) AS n FROM p GROUP BY 1, 2"""),
    "contradictions": (contradictions, """WITH a AS (SELECT DISTINCT 'urn:class/' || p_partkey % 40 AS s, 'urn:class/' || p_size % 9 AS o, p_partkey % 3 = 0 AS same FROM part),
          k AS (SELECT DISTINCT 'urn:property/' || c_nationkey || '-' || c_mktsegment AS s, c_custkey % 7 AS t FROM customer)
        SELECT 'equivalentClass' AS kind, x.s, x.o FROM a x JOIN a y ON x.s = y.s AND x.o = y.o WHERE x.same AND NOT y.same
        UNION ALL SELECT 'SymmetricProperty', x.s, NULL FROM k x JOIN k y ON x.s = y.s WHERE x.t = 0 AND y.t = 1 UNION ALL SELECT 'ReflexiveProperty', x.s, NULL FROM k x JOIN k y ON x.s = y.s WHERE x.t = 2 AND y.t = 3"""),
    "class_list": (class_list, """SELECT DISTINCT 'urn:core#' || p_size AS cls, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'urn:core#' || p_size END AS label FROM part WHERE p_partkey % 2 = 0"""),
    "shape_list": (shape_list, """SELECT 'urn:shape/' || s_nationkey AS shape, 'urn:core#N' || s_nationkey AS target, 'urn:core#p' || s_suppkey AS path, CASE WHEN s_suppkey % 2 = 0 THEN 'xsd:decimal' END AS datatype, CASE WHEN s_suppkey % 4 = 1 THEN 'urn:core#Batch' END AS cls,
          CASE WHEN s_suppkey % 3 = 0 THEN 1 END AS min_count, CAST(CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey % 5 END AS INTEGER) AS max_count FROM supplier WHERE s_nationkey % 5 <> 0 AND s_suppkey % 11 <> 0"""),
    "enriched_entities": (enriched_entities, """WITH e AS (SELECT CASE WHEN c_custkey % 20 = 3 THEN 'urn:geo/' ELSE 'urn:c/' END || c_custkey AS uri, c_custkey % 4 = 0 OR c_custkey % 20 = 3 AS place, c_custkey % 4 IN (1, 2) AS company, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS label,
          CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) END AS industry, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS country, CASE WHEN c_custkey % 3 = 1 THEN 1900 + c_custkey % 100 END AS founded, (c_custkey % 10) / 10.0::DOUBLE AS c FROM customer)
        SELECT uri, CASE WHEN place THEN coalesce(label, 'Geographic Location') ELSE label END AS label, concat_ws(' ', CASE WHEN place OR country IS NOT NULL THEN 'country=' || coalesce(country::VARCHAR, 'Unknown') END, CASE WHEN company OR founded IS NOT NULL THEN 'founded=' || coalesce(founded::VARCHAR, 'Unknown') END,
          CASE WHEN company OR industry IS NOT NULL THEN 'industry=' || coalesce(industry, 'Agriculture') END, CASE WHEN place THEN 'latitude=0.0 longitude=0.0' END) AS properties, round(CASE WHEN place THEN (c + 0.7::DOUBLE) / 2 WHEN company THEN (c + 0.6::DOUBLE) / 2 ELSE c END, 9) AS confidence, place OR company AS enriched FROM e"""),
    "event_documents": (event_documents, f"""WITH e AS (SELECT event_id AS i, CASE event_type WHEN 'click' THEN 'AggregationEvent' WHEN 'purchase' THEN 'TransactionEvent' ELSE 'ObjectEvent' END AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS made_at, CASE event_id % 3 WHEN 0 THEN 'ADD' WHEN 1 THEN 'OBSERVE' END AS act, user_id AS u FROM events)
        SELECT i AS event_id, '{_HEAD}urn:event/' || i || '>\n' || concat_ws(' ;\n', '    a epcis:' || kind, '    epcis:eventTime "' || made_at || '"', '    epcis:action "' || act || '"', '    epcis:readPoint <urn:user:' || u || '>', CASE WHEN i % 10 = 0 THEN '    epcis:disposition "{_DAMAGED}"' END,
          '    milk:batchNumber "B' || i % 97 || '"', CASE WHEN i % 2 = 0 THEN '    milk:milkVolume "' || i % 50 || '"^^xsd:decimal' END) || ' .\n' AS turtle,
          '{_CONTEXT}' || concat_ws(',', i || '"', '"@type":"' || kind || '"', '"epcis:eventTime":"' || made_at || '"', '"epcis:action":"' || act || '"', '"epcis:readPoint":"urn:user:' || u || '"', CASE WHEN i % 10 = 0 THEN '"epcis:disposition":"{_DAMAGED}"' END,
          '"milk:batchNumber":"B' || i % 97 || '"', CASE WHEN i % 2 = 0 THEN '"epcis:milkVolume":"' || i % 50 || '"' END) || '}}' AS jsonld FROM e"""),
    "repair_plan": (repair_plan, f"""WITH {_VALID}, s AS (SELECT user_id, run, count(*) AS size FROM v GROUP BY 1, 2)
        SELECT event_id, verdict, CASE verdict WHEN 'data' THEN 'restore data from the graph' WHEN 'hash' THEN 'count the hash anew' ELSE 'link to the block before' END AS action, size - index - 1 AS follow FROM v JOIN s USING (user_id, run) WHERE verdict <> 'valid'"""),
}
