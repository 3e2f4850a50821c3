"""Validation, policies, linking and clean-up of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.strings import edit_similarity, phonetic, safe_identifier, sanitized, slug, token_jaccard
from quarry.operators.linking import grouped, linked_pairs
from quarry.plans.tables import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_brand", "p_type").alias("block"), F.col("p_name").alias("name"))


def entity_linking_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names alike by edits, of all sizes, compared within brand and type."""
    return linked_pairs(_parts(spark, sf_dir), 0.8).select("a", "b", F.round("similarity", 9).alias("similarity"))


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of products of all sizes that pairs alike by 0.8 join, over one another, too."""
    return grouped(_parts(spark, sf_dir), 0.8)


def phonetic_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", phonetic(F.col("p_name")).alias("code"))


def jaccard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(token_jaccard(F.col("p_name"), F.lit("small red ring")), 9).alias("likeness"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like vector 0: a fixed query set of one against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.where("vec_id = 0").select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q")))
    cosine = F.when((F.size("v") != F.size("q")) | (norm == 0), 0.0).otherwise(dot(F.col("v"), F.col("q")) / norm)
    return e.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one product of a brand and type has."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one and the same text, by its hash."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def datatype_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose property k is no whole number below 50."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.try_cast(k, "bigint").alias("k") if hasattr(F, "try_cast") else k.try_cast("bigint").alias("k")).where("k is null or k >= 50")


def sanitize_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "pages").select("page_id", sanitized(F.col("html")).alias("clean"))
    return clean.select("page_id", F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").alias("n_chars"))


#: Classes of content by words, in the order in which they are tried.
CLASSES = [("Restricted", ["password", "secret", "api_key"]), ("Confidential", ["@", "phone"]), ("Internal", ["license", "copyright"])]


def content_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    rules = [F.when(F.array_contains(F.array(*[text.contains(w) for w in words]), True), F.lit(name)) for name, words in CLASSES]
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(*rules, F.lit("Public")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", slug(F.col("c_name")).alias("slug"), safe_identifier(F.col("c_name")).alias("identifier"), F.right("c_name", F.lit(8)).alias("serial"))


_SAN = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(html, '<[^>]*(?:>|\z)|>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')), '[\t\r\n \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"""
_ALL_PAIRS = """p AS (SELECT p_partkey AS id, p_brand || '|' || p_type AS block, p_name AS name FROM part),
    s AS (SELECT a.id AS a, b.id AS b, 1 - levenshtein(lower(a.name), lower(b.name))::DOUBLE / greatest(strlen(a.name), strlen(b.name)) AS similarity FROM p a JOIN p b ON a.block = b.block AND a.id < b.id)"""

QUERIES = {
    "phonetic_codes": (phonetic_codes, r"""WITH n AS (SELECT DISTINCT p_name, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS l FROM part),
        c AS (SELECT p_name, l, translate(l, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000000') AS d FROM n),
        r AS (SELECT p_name, l, list_reduce([x for x, i in string_split(d, '') if i = 1 OR x <> string_split(d, '')[i - 1]], lambda a, b: a || b) AS r FROM c)
        SELECT p_name, CASE WHEN l = '' THEN '0000' ELSE (l[1] || replace(r[2:], '0', '') || '000')[1:4] END AS code FROM r"""),
    "cosine_topk": (cosine_topk, """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine
        FROM embeddings WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 10"""),
    "key_uniqueness": (key_uniqueness, "SELECT p_brand, p_type, p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "duplicate_texts": (duplicate_texts, "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "datatype_check": (datatype_check, "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE k IS NULL OR k >= 50"),
    "sanitize_html": (sanitize_html, f"SELECT page_id, sha256({_SAN}) AS clean_sha256, CAST(length({_SAN}) AS INTEGER) AS n_chars FROM pages"),
    "content_classification": (content_classification, """SELECT CASE WHEN regexp_matches(lower(text), 'password|secret|api_key') THEN 'Restricted' WHEN regexp_matches(lower(text), '@|phone') THEN 'Confidential'
        WHEN regexp_matches(lower(text), 'license|copyright') THEN 'Internal' ELSE 'Public' END AS class, count(*) AS n FROM documents GROUP BY 1"""),
    "identifiers": (identifiers, """SELECT c_custkey, replace(replace(lower(c_name), ' ', '-'), '.', '') AS slug, regexp_replace(c_name, '[^A-Za-z0-9_-]+', '-', 'g') AS identifier, right(c_name, 8) AS serial FROM customer"""),
    "entity_linking_pairs": (entity_linking_pairs, f"WITH {_ALL_PAIRS} SELECT a, b, round(similarity, 9) AS similarity FROM s WHERE similarity >= 0.8"),
    "entity_groups": (entity_groups, f"""WITH RECURSIVE {_ALL_PAIRS}, e AS (SELECT a, b FROM s WHERE similarity >= 0.8 UNION ALL SELECT b, a FROM s WHERE similarity >= 0.8),
        r AS (SELECT id, id AS node FROM p UNION SELECT r.id, e.b FROM r JOIN e ON r.node = e.a)
        SELECT id, min(node) AS entity FROM r GROUP BY id"""),
    "jaccard_names": (jaccard_names, """WITH w AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS x FROM part)
        SELECT p_partkey, round(len(list_intersect(x, ['small', 'red', 'ring']))::DOUBLE / (len(x) + 3 - len(list_intersect(x, ['small', 'red', 'ring']))), 9) AS likeness FROM w"""),
}
