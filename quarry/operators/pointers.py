"""Linked lists and chains by pointer doubling: logarithmically many joins, whatever the length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.stage import stored


def _numbered(links: DataFrame) -> DataFrame:
    """node, id, to: a number for each node, and that of the next one, null where that is none; stored.

    Names may be long (hashes): they are shuffled here and where results take
    them back, but not in the rounds, which go by numbers.
    """
    ids = stored(links.select("node", "next").where("node is not null").withColumn("id", F.monotonically_increasing_id()))
    return stored(ids.join(ids.select(F.col("node").alias("next"), F.col("id").alias("to")), "next", "left").select("node", "id", "to"))


def _depths(ids: DataFrame) -> DataFrame:
    """id, at, over, depth: where each node's pointer ends, whether that is the end of its chain, and how many links lead there."""
    none = F.col("to").isNull()  # a pointer to what is no node has arrived where it stands
    now = stored(ids.select("id", F.coalesce("to", "id").alias("at"), none.alias("over"), F.when(none, 0).otherwise(1).cast("long").alias("depth")))
    for _ in range(now.count().bit_length() + 1):
        open_ = now.where("not over")
        if open_.isEmpty():
            break
        target = now.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("over").alias("last"), F.col("depth").alias("more"))
        moved = open_.join(target, "at").select("id", F.col("to").alias("at"), F.col("last").alias("over"), (F.col("depth") + F.col("more")).alias("depth"))
        now = stored(now.where("over").unionByName(moved))
    return now


def depths(links: DataFrame) -> DataFrame:
    """node, root, depth, cyclic: how many links lead from each node to the last one, and which that is.

    links: node, next; a node has one row at most, next is null or no node at the
    end of a chain. root is the last node itself. Nodes on a cycle, or from which
    one is reached, have cyclic true and no root or depth. Chains may share their
    ends. Each round joins every node to where its pointer points, so pointers
    span twice as many links; rows whose pointer has arrived take no more part.
    """
    ids = _numbered(links)
    ended = _depths(ids).withColumn("end", F.when(F.col("over"), F.col("at")))
    roots = ids.where("to is null").select(F.col("id").alias("end"), F.col("node").alias("root"))
    return ended.join(ids.select("id", "node"), "id").join(roots, "end", "left").select("node", "root", F.when(F.col("over"), F.col("depth")).alias("depth"), (~F.col("over")).alias("cyclic"))


def members(links: DataFrame, heads: DataFrame) -> DataFrame:
    """head, node, position: the nodes that follow each head, from the head itself at 0.

    links as in depths(), heads: one column, head. Heads that lead into a cycle
    are left out. Of nodes that hang together, none of which follows two others,
    a head's are those of its end that lie as deep as it or less: one join.
    Where ends are shared, what is known of a head doubles with every round:
    nodes at less than 2**k are joined to what lies 2**k further on.
    """
    ids = _numbered(links)
    sound = stored(_depths(ids).where("over").select("id", F.col("at").alias("end"), "depth"))
    shared = stored(ids.where("to is not null").groupBy("to").count().where("count > 1").select(F.col("to").alias("id")).join(sound, "id").select("end").distinct())
    mine = stored(heads.select(F.col("head").alias("node")).where("node is not null").distinct().join(ids, "node").select("id").join(sound, "id").select(F.col("id").alias("head"), "end", F.col("depth").alias("top")))
    plain = sound.join(shared, "end", "left_anti").join(mine, "end").where("depth <= top").select("head", "id", (F.col("top") - F.col("depth")).alias("position"))
    found = stored(mine.join(shared, "end", "left_semi").select("head", F.col("head").alias("id"), F.lit(0).cast("long").alias("position")))
    jump = stored(ids.where("to is not null").join(sound.join(shared, "end", "left_semi").select("id"), "id").select("id", "to"))
    step = 1
    while not jump.isEmpty():
        found = stored(found.unionByName(found.join(jump, "id").select("head", F.col("to").alias("id"), (F.col("position") + step).alias("position"))))
        jump = stored(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("end")), "to").select("id", F.col("end").alias("to")))
        step *= 2
    names = ids.select("id", "node")
    return plain.unionByName(found).join(names, "id").join(names.select(F.col("id").alias("head"), F.col("node").alias("name")), "head").select(F.col("name").alias("head"), "node", "position")
