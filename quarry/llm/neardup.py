"""Embedding near-duplicates by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import components, discard, read, written

THRESHOLD = 0.93
#: Vectors of a tile, about.
TILE = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length as int8, their scales, and bounds of the length of what rounding left off."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, lost


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y (unit length, double) have a cosine of threshold or more: a boolean matrix.

    With x = x' + e and y = y' + f, where x' and y' are the int8 forms,
    |xy - x'y'| <= |e| |y| + |x'| |f| <= |e| + (1 + |e|) |f|. Only pairs whose int8
    product comes within that of the threshold are computed in double precision.
    """
    qx, sx, ex = quantised(x)
    qy, sy, ey = quantised(y)
    # sums of products of int8 stay below 2**24 for up to 1040 numbers a vector, so float32 holds them exactly
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    near = (qx.astype(kind) @ qy.astype(kind).T).astype(np.float64) * sx[:, None] * sy
    near += ex[:, None] + (1 + ex[:, None]) * ey
    out = near >= threshold - 1e-9
    i, j = np.nonzero(out)
    for low in range(0, len(i), 1 << 16):
        a, b = i[low : low + (1 << 16)], j[low : low + (1 << 16)]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return out


def _spanning(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> set[tuple[int, int]]:
    """Pairs that connect the ids that the links of a tile connect: each id with the smallest that it reaches."""
    i, j = np.nonzero(found)
    a, b = left[i], right[j]
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return {(int(ids[k]), int(ids[m])) for k, m in enumerate(low) if k != m}


def comparable(vector: Column) -> Column:
    """Whether a vector links with others: not null, no null, NaN or infinite number, not all zero."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """id_col, n_links and component_id of every vector; links join equal labels at a cosine of threshold or more.

    Vectors of a null label, or that are not comparable(), have no links and are
    their own component; vectors of different length do not link. Equal vectors
    are one node, so a group of copies forms no pairs. Rows that repeat an id
    count as vectors of their own. Rows with a null id link, and count in no minimum.

    The nodes of a label are dealt into tiles by hash; each pair of tiles is one
    group of two tiles' size, whatever the size of the label.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", comparable(F.col("v")) & F.col("label").isNotNull())
    # -0.0 and 0.0 are one number to a cosine and two to a group
    key = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    node_id = F.xxhash64("label", "v")
    good = rows.where("ok").withColumn("v", key)
    nodes = written(good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = nodes.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"]).withColumn("tile", F.pmod(node_id, F.col("tiles")).cast("int"))
    pair = lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"))
    spread = dealt.select("label", "dim", "node", "n", "v", "tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair)).alias("p")).select("label", "dim", "p.i", "p.j", "tile", "node", "n", "v")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, n, at = (table.column(c).to_numpy() for c in ("node", "n", "tile"))
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        x = x / np.abs(x).max(axis=1)[:, None]  # no overflow in the squares
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = at == low, at == high
        degree = np.zeros(len(node), dtype=np.int64)
        pairs: set[tuple[int, int]] = set()
        if left.any() and right.any():
            found = linked(x[left], x[right], threshold)
            if low == high:
                np.fill_diagonal(found, False)
            degree[left] += found @ n[right]
            if low != high:
                degree[right] += n[left] @ found
            pairs = _spanning(found, node[left], node[right])
        some = np.flatnonzero(degree)
        a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"node": pa.concat_arrays([pa.array(node[some]), none(len(a))]), "links": pa.concat_arrays([pa.array(degree[some]), none(len(a))]), "a": pa.concat_arrays([none(len(some)), pa.array(a)]), "b": pa.concat_arrays([none(len(some)), pa.array(b)])})

    met = written(spread.groupBy("label", "dim", "i", "j").applyInArrow(run, "node long, links long, a long, b long"))
    degree = met.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    group = components(met.where("a is not null").select("a", "b")).withColumnRenamed("node", "g_node")
    full = nodes.join(degree, "node", "left").join(group, F.col("node") == F.col("g_node"), "left").select("label", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("g"))
    lowest = full.groupBy("g").agg(F.min("low").alias("component_id"))
    of = written(full.join(lowest, "g").select("label", "v", "n_links", "component_id"))
    discard(met)
    discard(nodes)
    out = good.join(of, ["label", "v"]).select("id", "n_links", "component_id").unionByName(rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    found = near_duplicates(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op2_embedding_neardup": op2_embedding_neardup}
