"""Chains of blocks put together again from their hashes, whatever order, gaps and forks they come with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.pointers import depths, members
from quarry.operators.stage import stored

ZEROS = "0" * 64


def hash_chain(blocks: DataFrame, chain: str, index: str, digest) -> DataFrame:
    """blocks with previous and hash: each block's hash takes in the one before it in its chain.

    digest(block, previous) gives the hash as a column, of a struct of the block's
    columns. A chain is folded in one row, as its hashes follow from one another.
    """
    columns = [c for c in blocks.columns if c != chain]
    rows = F.array_sort(F.collect_list(F.struct(index, *[c for c in columns if c != index])))
    start = F.struct(F.lit(ZEROS).alias("last"), F.array().cast("array<struct<previous:string,hash:string>>").alias("all"))
    step = lambda a, b: (lambda h: F.struct(h.alias("last"), F.concat(a["all"], F.array(F.struct(a["last"].alias("previous"), h.alias("hash")))).alias("all")))(digest(b, a["last"]))
    folded = blocks.groupBy(chain).agg(rows.alias("rows")).select(chain, F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step)["all"].alias("made"))).alias("x"))
    return folded.select(chain, *[F.col("x.rows")[c].alias(c) for c in columns], F.col("x.made.previous").alias("previous"), F.col("x.made.hash").alias("hash"))


def reconstructed(blocks: DataFrame, chain: str = "chain", genesis: str = ZEROS) -> DataFrame:
    """chain, hash, height, status of each block: where it stands once the chain is put together by previous hashes alone.

    blocks: chain, hash, previous. main: on the longest way from a genesis block
    (of equal ones that with the smallest last hash); fork: on another way from
    one; orphan: the way back ends at a block that is missing; cycle: it has no
    end. height counts from the end of the way back, null on a cycle. Rows that
    repeat a hash are one block, with the smallest of their previous hashes;
    blocks without a hash are left out.
    """
    node = lambda c: F.concat_ws("\n", chain, c)
    one = stored(blocks.where(F.col("hash").isNotNull()).groupBy(chain, "hash").agg(F.min("previous").alias("previous")))
    first = F.coalesce(F.col("previous") == genesis, F.lit(True))
    links = stored(one.select(node("hash").alias("node"), F.when(~first, node("previous")).alias("next")))
    placed = depths(links).join(one.select(chain, "hash", node("hash").alias("node"), first.alias("first")), "node")
    roots = placed.where("first").select(F.col("node").alias("root"), F.lit(True).alias("sound"))
    placed = stored(placed.join(roots, "root", "left").select(chain, "hash", "node", "depth", "cyclic", F.coalesce("sound", F.lit(False)).alias("sound")))
    tips = placed.where("sound").groupBy(chain).agg(F.min_by("node", F.struct(-F.col("depth"), "hash")).alias("head"))
    main = members(links, tips).select("node", F.lit(True).alias("main"))
    status = F.when(F.col("cyclic"), "cycle").when(~F.col("sound"), "orphan").when(F.col("main"), "main").otherwise("fork")
    return placed.join(main, "node", "left").select(chain, "hash", F.col("depth").alias("height"), status.alias("status"))


def _placed(blocks: list[tuple], genesis: str) -> list[tuple]:
    """height and status of each of one chain's blocks (hash, previous), as reconstructed() has them."""
    back, done = {}, {}  # done: links to the end of the way back, and whether that is a genesis block; None on a cycle
    for h, p in blocks:
        if h is not None and (back.get(h) is None or p is not None and p < back[h]):
            back[h] = p
    first = lambda h: back[h] is None or back[h] == genesis
    for h in back:
        way, on = [], set()
        while h not in done and h not in on:
            way.append(h)
            on.add(h)
            if first(h) or back[h] not in back:
                done[h] = (0, first(h))
            else:
                h = back[h]
        end = done.get(h)
        for x in reversed(way):
            if x not in done:
                end = end and (end[0] + 1, end[1])
                done[x] = end
    tip = min(((-d[0], h) for h, d in done.items() if d and d[1]), default=None)
    main, h = set(), tip and tip[1]
    while tip and h not in main:
        main.add(h)
        h = h if first(h) else back[h]
    told = {h: (None, "cycle") if d is None else (d[0], "orphan" if not d[1] else "main" if h in main else "fork") for h, d in done.items()}
    return [told.get(h, (None, None)) for h, _ in blocks]


def _audited_in_place(blocks: DataFrame, chain: str, genesis: str) -> DataFrame:
    """blocks with height and status, of chains whose blocks follow one another in a partition."""

    def told(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables)
        names, hashes, previous = (table[c].cast(pa.string()).to_pylist() for c in (chain, "hash", "previous"))
        out, at = [], 0
        for end in range(1, len(names) + 1):
            if end == len(names) or names[end] != names[at]:
                out += _placed(list(zip(hashes[at:end], previous[at:end])), genesis) if names[at] is not None else [(None, None)] * (end - at)
                at = end
        heights, status = zip(*out)
        yield from table.append_column("height", pa.array(heights, pa.int64())).append_column("status", pa.array(status, pa.string())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # the last chain so far: its rest may be in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = table[chain].cast(pa.string()).to_numpy(zero_copy_only=False)
            if not len(names):
                continue
            starts = (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()
            if held and names[0] != last:
                starts = [0, *starts]
            if starts:
                whole = [*held, *([table.slice(0, starts[-1])] if starts[-1] else [])]
                yield from told(whole)
                held = []
            held.append(table.slice(starts[-1] if starts else 0))
            last = names[-1]
        if held:
            yield from told(held)

    return blocks.mapInArrow(run, blocks.withColumns({"height": F.lit(None).cast("long"), "status": F.lit(None).cast("string")}).schema)


def audited(blocks: DataFrame, digest: Column, chain: str = "chain", index: str = "index", genesis: str = ZEROS, in_place: bool = False) -> DataFrame:
    """blocks with height, status and fault: what of each block does not fit first.

    With in_place, the blocks of a chain must follow one another in a partition,
    as hash_chain() leaves them: each chain is put together there, in memory,
    with no shuffle and no rounds.

    digest gives the hash that the block's columns should have. Faults: hash (it
    has another), place (on the main way, but not at its index), then the status
    where that is not main; none is null.
    """
    rows = _audited_in_place(blocks, chain, genesis) if in_place else blocks.join(reconstructed(blocks, chain, genesis), [chain, "hash"], "left")
    fault = F.when(F.coalesce(digest != F.col("hash"), F.lit(True)), "hash").when((F.col("status") == "main") & (F.col("height") != F.col(index)), "place").when(F.col("status") != "main", F.col("status"))
    return rows.withColumn("fault", fault)


def completeness(audit: DataFrame, chain: str = "chain", index: str = "index") -> DataFrame:
    """Of each chain: blocks, how many are on the main way, forks, orphans, on cycles, with a wrong hash, missing indices, and whether it is whole."""
    n = lambda c: F.count(F.when(c, 1))
    counts = audit.groupBy(chain).agg(F.count(F.lit(1)).alias("blocks"), n(F.col("status") == "main").alias("main"), n(F.col("status") == "fork").alias("forks"), n(F.col("status") == "orphan").alias("orphans"), n(F.col("status") == "cycle").alias("cycles"), n(F.col("fault") == "hash").alias("corrupted"), (F.max(index) + 1 - F.countDistinct(index)).alias("missing"))
    return counts.withColumn("whole", (F.col("blocks") == F.col("main")) & (F.col("corrupted") == 0) & (F.col("missing") == 0))
