"""Streams of ledger events: counts by time, and blocks put in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def of_types(events: DataFrame, types: list[str]) -> DataFrame:
    """What a subscriber to some types of event sees."""
    return events.where(F.col("event_type").isin(*types))


def rates(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of time; windows close when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def in_order(blocks: DataFrame, remember: int | None = None) -> DataFrame:
    """Blocks of each chain in order of index, whatever order they come in.

    blocks: chain, index, timestamp, hash. Emits chain, index, timestamp, hash,
    action: append for the next block; conflict for another hash at an index that
    is there (the earlier timestamp wins, and is emitted). Repeats are dropped.
    Blocks that come too early are kept in the state until the gap is filled.
    With remember, only so many of a chain's last blocks are kept to tell
    conflicts by; what comes for an earlier index is dropped, and the state does
    not grow with the chain.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, pending, done = state.get if state.exists else (0, [], [])
        held = {row[0]: tuple(row) for row in pending}
        kept = {row[0]: tuple(row) for row in done}
        out = []
        for batch in batches:
            for index, stamp, hash_ in zip(batch["index"].tolist(), batch["timestamp"].tolist(), batch["hash"].tolist()):
                if remember is not None and index < following - remember:
                    continue
                where = kept if index < following else held
                old = where.get(index)
                if old is None:
                    where[index] = (index, stamp, hash_)
                elif old[2] != hash_ and stamp < old[1]:
                    where[index] = (index, stamp, hash_)
                    if where is kept:
                        out.append((key[0], index, stamp, hash_, "conflict"))
        while following in held:
            kept[following] = held.pop(following)
            out.append((key[0], *kept[following], "append"))
            following += 1
        if remember is not None:
            kept = {i: row for i, row in kept.items() if i >= following - remember}
        state.update((following, [tuple(r) for r in held.values()], [tuple(r) for r in kept.values()]))
        yield pd.DataFrame(out, columns=["chain", "index", "timestamp", "hash", "action"])

    row = "struct<index: long, timestamp: string, hash: string>"
    return blocks.groupBy("chain").applyInPandasWithState(run, "chain string, index long, timestamp string, hash string, action string", f"following long, pending array<{row}>, done array<{row}>", "append", GroupStateTimeout.NoTimeout)
