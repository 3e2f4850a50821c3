"""Filters, joins, set operations and pages: what graph patterns come down to over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.closure import bounded_paths, reach
from quarry.operators.pointers import depths
from quarry.operators.stage import stored
from quarry.plans.tables import table


def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand", "p_type")


def bgp_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of a transaction: its product, producer and order, which must all be there."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_brand", "s_name", "o_orderstatus")


def _next_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order and the customer's next one."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"))


def multi_hop_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order, the next, and the one after that, where they exist: two leads over one shuffle, not joins."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.lead("o_orderkey", 1).over(w).alias("hop1"), F.lead("o_orderkey", 2).over(w).alias("hop2"))


def optional_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their open orders of high value: the condition belongs to the optional side."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000 and o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


def not_exists_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a product has a return among its transactions."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey").distinct()
    return table(spark, sf_dir, "part").join(r, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("l_partkey").isNotNull().alias("has_return"))


def union_distinct_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers, of suppliers, and of a region, without repeats."""
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    c = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return a.unionByName(b).unionByName(c).distinct()


def same_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers of one nation. Pairs are the result here; the nation with most suppliers bounds them."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = s.select(F.col("s_suppkey").alias("other"), F.col("s_nationkey").alias("n"))
    return s.join(t, (F.col("s_nationkey") == F.col("n")) & (F.col("s_suppkey") < F.col("other"))).select("s_suppkey", "other")


def values_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("FRANCE",), ("CHINA",), ("PERU",), ("NATION_3",), ("NATION_7",)], "name string")
    return table(spark, sf_dir, "nation").join(F.broadcast(names), F.col("n_name") == F.col("name")).select("n_nationkey", "n_name")


def ask_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice > 100000").limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))


def construct_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that follow from a chain: a customer is located in the region of its nation."""
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("urn:customer:"), "c_custkey").alias("s"), F.lit("urn:locatedIn").alias("p"), F.concat(F.lit("urn:region:"), "r_regionkey").alias("o"))


def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").rlike("^(STANDARD|SMALL)")).select("p_partkey", "p_type")


def contains_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("ring") & F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_name")


def string_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are kept as text compare as text."""
    return table(spark, sf_dir, "part").where(F.col("p_size").cast("string") > F.lit("22")).select("p_partkey", "p_size")


def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.col("l_shipdate") - F.col("o_orderdate") > F.expr("INTERVAL '90' DAY")).select("l_orderkey", "l_linenumber")


def precedes_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user and day, how many pairs of events lie one before the other.

    Pairs with a strict order are all pairs less those of equal time, so counts say it and no pairs are made.
    """
    same = table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts").agg(F.count(F.lit(1)).alias("k"))
    pairs = same.groupBy("user_id", "day").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("pairs"))
    return pairs.where("pairs > 0")


def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of 20 products by name, and the number of pages."""
    p = table(spark, sf_dir, "part")
    pages = p.agg(F.ceil(F.count(F.lit(1)) / 20).alias("total_pages"))
    page = p.orderBy("p_name", "p_partkey").offset(20).limit(20).select("p_partkey", "p_name")
    return page.crossJoin(F.broadcast(pages))  # one row


def top_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def path_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order that has a next one, how many orders derive from it, over any number of steps."""
    links = stored(_next_orders(spark, sf_dir).select(F.col("src").alias("node"), F.col("dst").alias("next")))
    if not links.groupBy("node").count().where("count > 1").isEmpty():  # rows that repeat an order's key: it has several next ones
        e = links.where("next is not null").select(F.col("node").alias("src"), F.col("next").alias("dst"))
        return reach(e, e.select(F.col("src").alias("start"))).groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("deepest"))
    # with one next order at most, as many derive from an order as it is deep: no pairs are formed
    return depths(links).where("depth > 0").select(F.col("node").alias("start"), F.col("depth").alias("n"), F.col("depth").cast("int").alias("deepest"))


def path_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of up to three steps from every order, with their nodes."""
    e = _next_orders(spark, sf_dir).where("dst is not null").select("src", "dst")
    found = bounded_paths(e, e.select(F.col("src").alias("start")).distinct(), 3)
    return found.select("start", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("nodes"), "steps")


_NEXT = """nxt AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)"""

QUERIES = {
    "entity_lookup": (entity_lookup, "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey = 42"),
    "bgp_star": (bgp_star, """SELECT l_orderkey, l_linenumber, p_brand, s_name, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49"""),
    "multi_hop_optional": (multi_hop_optional, f"""WITH {_NEXT} SELECT a.src AS order_key, a.dst AS hop1, b.dst AS hop2 FROM nxt a LEFT JOIN nxt b ON a.dst = b.src"""),
    "optional_filtered": (optional_filtered, """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 AND o_orderstatus = 'O'"""),
    "not_exists_required": (not_exists_required, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "semi_exists": (semi_exists, "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS has_return FROM part"),
    "union_distinct_related": (union_distinct_related, """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000
        UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1"""),
    "same_participant": (same_participant, "SELECT a.s_suppkey, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "values_inline": (values_inline, "SELECT n_nationkey, n_name FROM nation JOIN (VALUES ('FRANCE'), ('CHINA'), ('PERU'), ('NATION_3'), ('NATION_7')) v(name) ON n_name = name"),
    "ask_exists": (ask_exists, "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS answer"),
    "construct_chain": (construct_chain, """SELECT 'urn:customer:' || c_custkey AS s, 'urn:locatedIn' AS p, 'urn:region:' || r_regionkey AS o FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "regex_filter": (regex_filter, "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(STANDARD|SMALL)')"),
    "contains_filter": (contains_filter, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND starts_with(p_brand, 'Brand#1')"),
    "string_compare": (string_compare, "SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) > '22'"),
    "duration_filter": (duration_filter, "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 90 DAY"),
    "precedes_theta": (precedes_theta, """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id FROM events)
        SELECT a.user_id, a.day, count(*) AS pairs FROM e a JOIN e b ON a.user_id = b.user_id AND a.day = b.day AND a.ts < b.ts GROUP BY 1, 2"""),
    "pagination": (pagination, "SELECT p_partkey, p_name, (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM part) AS total_pages FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20"),
    "top_desc": (top_desc, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "path_plus": (path_plus, """WITH later AS (SELECT o_orderkey AS start, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS n FROM orders)
        SELECT start, n, n AS deepest FROM later WHERE n > 0"""),
    "path_bounded": (path_bounded, f"""WITH RECURSIVE {_NEXT}, e AS (SELECT src, dst FROM nxt WHERE dst IS NOT NULL),
        r AS (SELECT src AS start, dst, src || '>' || dst AS nodes, 1 AS steps FROM e
              UNION ALL SELECT r.start, e.dst, r.nodes || '>' || e.dst, r.steps + 1 FROM r JOIN e ON r.dst = e.src WHERE r.steps < 3)
        SELECT start, nodes, steps FROM r"""),
}
