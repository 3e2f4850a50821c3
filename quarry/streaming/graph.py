"""Tables that follow a stream of quads batch by batch, and can take any batch again: the knowledge graph and the state root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.knowledge import LABEL, RDF_TYPE, Kind, edges, entities
from quarry.operators.ledger import merkle_root


def _part(path: str, table: str, batch: int) -> str:
    return f"{path}/{table}/batch={batch}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _until(spark: SparkSession, path: str, table: str, schema: str, batch: int | None = None) -> DataFrame:
    """All batches of a table, up to one if given; empty where there are none yet."""
    if not _exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{table}")
    return rows if batch is None else rows.where(F.col("batch") <= batch)


_QUADS = "g string, s string, p string, o string"
_ENTITIES = "uri string, kind string, label string, properties map<string,string>, confidence double"


class GraphFollower:
    """What foreachBatch calls to keep a knowledge graph up to date under path.

    Every batch has a folder of its own in each table, which a batch that comes
    again writes over, so that restarts change nothing. Only subjects of the
    batch are built anew, from all their quads up to it; of an entity the row of
    the latest batch counts.
    """

    def __init__(self, path: str, kinds: list[Kind], predicates: dict[str, float], type_of: str = RDF_TYPE, label: str = LABEL):
        self.path, self.kinds, self.predicates, self.type_of, self.label = path, kinds, predicates, type_of, label

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("g", "s", "p", "o").distinct().write.mode("overwrite").parquet(_part(self.path, "quads", number))
        quads = _until(spark, self.path, "quads", _QUADS, number)
        new = quads.where(F.col("batch") == number)
        touched = quads.join(new.select("s").distinct(), "s", "left_semi").select("g", "s", "p", "o").distinct()
        before = self.entities(spark, number - 1).select("uri", "kind")
        entities(touched, self.kinds, self.type_of, self.label).write.mode("overwrite").parquet(_part(self.path, "entities", number))
        made = _until(spark, self.path, "entities", _ENTITIES, number).where(F.col("batch") == number)
        fresh = made.join(before, ["uri", "kind"], "left_anti").agg(F.count(F.lit(1)).alias("new_entities"))
        added = edges(new, self.predicates).join(edges(quads.where(F.col("batch") < number), self.predicates), ["src", "p", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("new_edges"))
        fresh.crossJoin(added).write.mode("overwrite").parquet(_part(self.path, "reports", number))  # a row each

    def entities(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The entities as of a batch, or of the last one."""
        rows = _until(spark, self.path, "entities", _ENTITIES, batch)
        latest = F.row_number().over(W.partitionBy("uri", "kind").orderBy(F.desc("batch")))
        return rows.withColumn("latest", latest).where("latest = 1").select("uri", "kind", "label", "properties", "confidence")

    def edges(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        return edges(_until(spark, self.path, "quads", _QUADS, batch), self.predicates)

    def reports(self, spark: SparkSession) -> DataFrame:
        """batch, new_entities, new_edges."""
        return _until(spark, self.path, "reports", "new_entities long, new_edges long").select("batch", "new_entities", "new_edges")


class RootFollower:
    """What foreachBatch calls to keep the Merkle root of all leaves so far (column hash) under path.

    A leaf is hashed once, when it comes; what a batch adds is in a folder of its
    own. As leaves are paired in sorted order, a new one moves all behind it: each
    batch pairs anew over the kept hashes, in as many rounds as their number has
    binary digits.
    """

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self.leaves(spark, number - 1)
        batch.select("hash").where("hash is not null").distinct().join(before, "hash", "left_anti").write.mode("overwrite").parquet(_part(self.path, "leaves", number))
        merkle_root(self.leaves(spark, number)).write.mode("overwrite").parquet(_part(self.path, "roots", number))

    def leaves(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        return _until(spark, self.path, "leaves", "hash string", batch).select("hash")

    def roots(self, spark: SparkSession) -> DataFrame:
        """batch, root."""
        return _until(spark, self.path, "roots", "root string").select("batch", "root")


def follow(stream: DataFrame, follower, checkpoint: str):
    """A writer of the stream that hands each batch to follower; start() it, or use it with a trigger."""
    return stream.writeStream.foreachBatch(follower).option("checkpointLocation", checkpoint)
