"""The knowledge graph of the items of orders, and records merged from linked entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.knowledge import ACTIVITY, AGENT, BATCH, PROVENANCE, SUPPLY, Kind, edges, entities, items_json, property_nodes, temporal_edges
from quarry.operators.linking import grouped, merged_records
from quarry.plans.quads import _CHAIN, chain
from quarry.plans.tables import table

_KINDS = [
    Kind(("urn:core#Batch",), {"urn:core#batchId": "batchId", "urn:core#shipDate": "producedAt"}, BATCH),
    Kind(("urn:core#Product",), {}, AGENT),
    Kind(("urn:core#Activity",), {"urn:core#shipDate": "recordedAt"}, ACTIVITY, labelled=False),
]
_flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of orders as entities, with properties and how sure they are."""
    found = entities(chain(spark, sf_dir), _KINDS, "urn:rdf#type", "urn:core#label")
    return found.select("uri", "kind", "label", _flat("properties").alias("properties"), "confidence")


def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of provenance and supply, and of time within an order, counted by kind and sureness."""
    q = chain(spark, sf_dir)
    every = edges(q, {"urn:core#producedBy": PROVENANCE, "urn:core#location": SUPPLY}).unionByName(temporal_edges(q, "urn:core#shipDate", "urn:core#precedes"))
    return every.groupBy("p", "confidence").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.min("at").alias("first"), F.max("at").alias("last"))


def kg_property_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the property graph by their types: how many, their properties, their links out."""
    rows = property_nodes(chain(spark, sf_dir), "urn:rdf#type")
    size = F.aggregate(F.map_values("properties"), F.lit(0), lambda a, x: a + F.size(x))
    return rows.groupBy(F.array_join("types", " ").alias("types")).agg(F.count(F.lit(1)).alias("nodes"), F.sum(size).alias("properties"), F.sum(F.size("links")).alias("links"))


def kg_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's part of the graph as JSON, as its hash."""
    return items_json(chain(spark, sf_dir), "urn:rdf#type").select("item", F.sha2("graph", 256).alias("graph_sha256"))


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as entities, those with names alike merged into one record each with the properties of all."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("block"), F.col("p_name").alias("name"))
    key = F.col("p_partkey")
    entries = F.filter(F.array(F.struct(F.lit("price").alias("key"), F.when(key % 3 == 0, F.format_string("%.2f", "p_retailprice")).alias("value")), F.struct(F.lit("size").alias("key"), F.when(key % 2 == 0, F.col("p_size").cast("string")).alias("value"))), lambda e: e["value"].isNotNull())
    made = p.select(key.alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"), F.map_from_entries(entries).alias("properties"), ((key % 10) / 10.0).alias("confidence"))
    whole = merged_records(made, grouped(rows, 0.8))
    return whole.select("id", "kind", "label", _flat("properties").alias("properties"), F.round("confidence", 9).alias("confidence"), "members")


_ENTITIES = f"""WITH {_CHAIN}, t AS (SELECT DISTINCT s, o FROM q WHERE p = 'urn:rdf#type'), v AS (SELECT s, min(o) FILTER (p = 'urn:core#batchId') AS b, min(o) FILTER (p = 'urn:core#shipDate') AS d, min(o) FILTER (p = 'urn:core#label') AS l FROM q GROUP BY 1)
    SELECT t.s AS uri, replace(t.o, 'urn:core#', '') AS kind, CASE WHEN t.o <> 'urn:core#Activity' THEN l END AS label, CASE t.o WHEN 'urn:core#Batch' THEN 'batchId=' || b || ' producedAt=' || d WHEN 'urn:core#Activity' THEN 'recordedAt=' || d ELSE '' END AS properties,
    (CASE t.o WHEN 'urn:core#Product' THEN 0.95 ELSE 0.9 END)::DOUBLE AS confidence FROM t JOIN v ON v.s = t.s"""
_SIMILAR = """p AS (SELECT p_partkey AS id, p_brand || '|' || p_type AS block, lower(p_name) AS n FROM part),
    s AS (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.block = y.block AND x.id < y.id WHERE 1 - levenshtein(x.n, y.n)::DOUBLE / greatest(strlen(x.n), strlen(y.n)) >= 0.8)"""

QUERIES = {
    "kg_entities": (kg_entities, _ENTITIES),
    "kg_edges": (kg_edges, f"""WITH {_CHAIN}, a AS (SELECT DISTINCT s AS src, p, o AS dst, (CASE p WHEN 'urn:core#producedBy' THEN 0.95 ELSE 0.9 END)::DOUBLE AS confidence, NULL AS time FROM q WHERE p IN ('urn:core#producedBy', 'urn:core#location')
          UNION ALL SELECT x.s, 'urn:core#precedes', y.s, 0.8::DOUBLE, min(y.o) FROM q x JOIN q y ON x.g = y.g AND x.p = 'urn:core#shipDate' AND y.p = 'urn:core#shipDate' AND x.o < y.o AND x.s <> y.s GROUP BY 1, 3)
        SELECT p, confidence, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, min(time) AS first, max(time) AS last FROM a GROUP BY 1, 2"""),
    "kg_property_graph": (kg_property_graph, f"""WITH {_CHAIN}, l AS (SELECT DISTINCT s, p, o FROM q WHERE o_kind <> 'literal' AND p <> 'urn:rdf#type'), ids AS (SELECT s FROM q UNION SELECT o FROM l),
          t AS (SELECT s, string_agg(DISTINCT replace(o, 'urn:core#', ''), ' ' ORDER BY replace(o, 'urn:core#', '')) AS types FROM q WHERE p = 'urn:rdf#type' GROUP BY 1), v AS (SELECT s, count(DISTINCT (p, o)) AS n FROM q WHERE o_kind = 'literal' GROUP BY 1), c AS (SELECT s, count(*) AS n FROM l GROUP BY 1)
        SELECT coalesce(types, '') AS types, count(*) AS nodes, CAST(sum(coalesce(v.n, 0)) AS BIGINT) AS properties, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS links FROM ids LEFT JOIN t ON t.s = ids.s LEFT JOIN v ON v.s = ids.s LEFT JOIN c ON c.s = ids.s GROUP BY 1"""),
    "kg_items": (kg_items, f"""WITH {_CHAIN}, n AS (SELECT s, regexp_extract(p, '[^#/]*$') AS name, min(o) AS o FROM q WHERE o_kind = 'literal' AND s LIKE 'urn:item%' GROUP BY 1, 2), v AS (SELECT s, string_agg('"' || name || '":"' || o || '"', ',' ORDER BY name) AS v FROM n GROUP BY 1),
          l AS (SELECT DISTINCT s, regexp_extract(p, '[^#/]*$') AS name, o FROM q WHERE o_kind <> 'literal' AND s LIKE 'urn:item%'),
          e AS (SELECT s, string_agg('{{"source":"' || s || '","target":"' || o || '","label":"' || name || '"}}', ',' ORDER BY o, name) AS e FROM l GROUP BY 1), m AS (SELECT s, string_agg(DISTINCT '{{"id":"' || o || '","properties":{{}}}}', ',' ORDER BY '{{"id":"' || o || '","properties":{{}}}}') AS m FROM l GROUP BY 1)
        SELECT e.s AS item, sha256('{{"nodes":[{{"id":"' || e.s || '","properties":{{' || v || '}}}},' || m || '],"edges":[' || e || ']}}') AS graph_sha256 FROM e JOIN v ON v.s = e.s JOIN m ON m.s = e.s"""),
    "merged_entities": (merged_entities, f"""WITH RECURSIVE {_SIMILAR}, e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), r AS (SELECT id, id AS node FROM p UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a),
          g AS (SELECT id, min(node) AS entity FROM r GROUP BY 1), m AS (SELECT g.entity, t.*, p_partkey % 10 / 10.0::DOUBLE AS c FROM g JOIN part t ON p_partkey = id)
        SELECT arg_min(p_partkey, (-c, p_partkey)) AS id, arg_min(p_type, (-c, p_partkey)) AS kind, arg_min(p_name, (-c, p_partkey)) AS label,
          concat_ws(' ', 'price=' || arg_min(format('{{:.2f}}', p_retailprice), (-c, p_partkey)) FILTER (p_partkey % 3 = 0), 'size=' || arg_min(p_size::VARCHAR, (-c, p_partkey)) FILTER (p_partkey % 2 = 0)) AS properties, round(avg(c), 9) AS confidence, count(*) AS members FROM m GROUP BY entity"""),
}
