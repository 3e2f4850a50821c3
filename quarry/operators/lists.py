"""RDF lists and the keys of classes that are given as lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.pointers import members
from quarry.operators.stage import stored

# The terms of lists and keys.
FIRST = "http://www.w3.org/1999/02/22-rdf-syntax-ns#first"
REST = "http://www.w3.org/1999/02/22-rdf-syntax-ns#rest"
NIL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil"
HAS_KEY = "http://www.w3.org/2002/07/owl#hasKey"


def list_items(quads: DataFrame, heads: DataFrame) -> DataFrame:
    """head, position, item: what the lists that begin at heads (one column, head) hold, in order.

    quads: s, p, o. Lists may share their ends; a list that runs into itself has
    no items; a node with several values counts with the smallest rest and with
    each of its firsts.
    """
    rest = stored(quads.where((F.col("p") == REST) & (F.col("o") != NIL)).groupBy("s").agg(F.min("o").alias("next")))
    first = quads.where(F.col("p") == FIRST).select(F.col("s").alias("node"), F.col("o").alias("item")).distinct()
    nodes = first.select("node").distinct().join(rest.withColumnRenamed("s", "node"), "node", "full")
    return members(nodes, heads).join(first, "node").select("head", "position", "item")


def class_keys(quads: DataFrame) -> DataFrame:
    """class, list, position, property: the properties that together identify the instances of a class, by owl:hasKey."""
    keys = quads.where(F.col("p") == HAS_KEY).select(F.col("s").alias("class"), F.col("o").alias("list")).distinct()
    return keys.join(list_items(quads, keys.select(F.col("list").alias("head"))).withColumnRenamed("head", "list"), "list").select("class", "list", "position", F.col("item").alias("property"))


def _followed(quads: Iterable[tuple]) -> list[tuple]:
    """class, list, position, property of the keys among one graph's quads (s, p, o), as class_keys() has them."""
    rest, first, keys, more = {}, {}, {}, {}
    for s, p, o in quads:
        if p == FIRST:
            if first.setdefault(s, o) != o:
                more.setdefault(s, {first[s]: None})[o] = None
        elif p == REST:
            if o is not None and o != NIL and (s not in rest or o < rest[s]):
                rest[s] = o
        elif p == HAS_KEY:
            keys[s, o] = None
    out = []
    for name, head in keys:
        node, position, start, most = head, 0, len(out), len(first) + len(rest)
        while node is not None and (node in first or node in rest) and position <= most:
            if node in more:
                out += [(name, head, position, item) for item in more[node]]
            elif node in first:
                out.append((name, head, position, first[node]))
            node, position = rest.get(node), position + 1
        if position > most:  # more steps than nodes: the list runs into itself
            del out[start:]
    return out


def class_keys_by_graph(quads: DataFrame, graph: str) -> DataFrame:
    """class_keys() of quads whose lists keep to their graph, as blank nodes do; graph is the column that tells graphs apart.

    The quads of a graph must lie in one partition (as after repartition(graph)):
    lists are followed there, with no shuffle and no rounds. A graph is held in
    one task's memory, so graphs should be of block size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last graph so far: its rest may be in the next batch
        for batch in batches:
            names, *terms = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            out, at = [], 0
            for end in [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]:
                if held and held[0] != names[at]:
                    out += _followed(held[1])
                    held = []
                rows = list(zip(*(t[at:end].tolist() for t in terms)))
                held, at = [names[at], held[1] + rows if held else rows], end
            if out:
                yield _rows(out)
        yield _rows(_followed(held[1]) if held else [])

    rows = quads.where(F.col("p").isin(FIRST, REST, HAS_KEY)).sortWithinPartitions(graph).select(F.col(graph).cast("string"), "s", "p", "o")
    return rows.mapInArrow(run, "class string, list string, position long, property string")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 4
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["class", "list", "position", "property"])


def key_violations(quads: DataFrame) -> DataFrame:
    """class, list, a, b: instances of a class that agree in all the properties of one of its keys, b each and a the smallest.

    An instance counts with the smallest value of each property and only if it
    has them all. Instances meet under a hash of their values, so that no pair
    of a large group is formed.
    """
    keys = stored(class_keys(quads))
    size = keys.groupBy("class", "list").agg(F.countDistinct("property").alias("n"))
    typed = quads.where(F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type").select("s", F.col("o").alias("class")).distinct()
    values = quads.select("s", F.col("p").alias("property"), "o").join(keys.select("class", "list", "property").distinct(), "property").groupBy("class", "list", "s", "property").agg(F.min("o").alias("o"))
    whole = values.groupBy("class", "list", "s").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("property", "o"))).alias("values")).join(size, ["class", "list", "n"]).join(typed, ["class", "s"], "left_semi")
    hashed = whole.select("class", "list", "s", F.sha2(F.to_json("values"), 256).alias("h"))
    least = hashed.groupBy("class", "list", "h").agg(F.min("s").alias("a"))
    return hashed.join(least, ["class", "list", "h"]).where("s <> a").select("class", "list", "a", F.col("s").alias("b"))
