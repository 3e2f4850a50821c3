"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.chunks import PieceEncoder, slices
from quarry.llm.common import read, text_or_empty, written

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
#: Parts that the ranks of one length are counted in, so that no length meets in one task.
RANK_PARTS = 64


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    # its normalizer and pattern never join what a blank or a line end parts
    return PieceEncoder(lambda text: made.encode_batch_fast([text], add_special_tokens=False)[0].ids, glue=False, apart=" \x00 ", fold=True)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The ids of every whole text and then end_id, cut into pieces of capacity ids, the last one shorter.

    Returns id_col, piece int, start long, length long, ids binary (unsigned
    32-bit, little-endian). A null text is an empty one: one piece with end_id.
    Repeated or null ids of documents are kept as they are.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                bounds, ids = encoder(part.column("text"))
                n = np.diff(bounds) + 1
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                of = np.repeat(np.arange(len(n)), pieces := -(-n // capacity))
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[of] - start)
                cuts = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces follow one another in ids
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])], ["id", "piece", "start", "length", "ids"])

    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("id", id_col)


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Returns runs (length, rank from, rank below, first sequence, items a
    sequence, first offset): the item of rank r in a run goes to sequence
    first + (r - from) // items, at offset + length * ((r - from) % items).
    At most a few runs for each length, whatever the counts are.
    """
    room: list[int] = []  # what is free, ascending; of each, sequences [first, how many]
    open_: dict[int, list[list[int]]] = {}
    runs, new = [], 0

    def add(free: int, first: int, many: int) -> None:
        if free > 0 and many > 0:
            if free not in open_:
                bisect.insort(room, free)
            open_.setdefault(free, []).append([first, many])

    for length, left in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"plan: length {length} is not between 1 and {capacity}")
        rank = 0
        while left:
            at = bisect.bisect_left(room, length)
            if at < len(room):
                free = room[at]
                first, many = open_[free].pop()
                if not open_[free]:
                    del open_[free]
                    room.pop(at)
            else:
                free, first, many = capacity, new, -(-left // (capacity // length))
                new += many
            items = free // length
            full, rest = min(many, left // items), 0
            if full < many:
                rest = left - full * items if full * items < left else 0
            taken = full * items + rest
            runs.append((length, rank, rank + taken, first, items, capacity - free))
            rank, left = rank + taken, left - taken
            add(free - items * length, first, full)
            if rest:
                add(free - rest * length, first + full, 1)
            add(free, first + full + (rest > 0), many - full - (rest > 0))
    return runs


def pack(pieces: DataFrame, keys: list[str], length_col: str = "length", capacity: int = CAPACITY, parts: int = RANK_PARTS) -> DataFrame:
    """pieces with sequence_id long and offset long: best fit by length into sequences of capacity.

    Every row keeps its columns. keys order the rows of a length; rows that
    agree in them are kept, in either order. Lengths must be from 1 to capacity.
    pieces is read three times and should be a written table. The driver gets
    the histogram: at most capacity rows.
    """
    spark = pieces.sparkSession
    # runs are sorted by length, so equal pieces always get the same ranks from the same table
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    rows = pieces.withColumn("_part", part)
    counts = rows.groupBy(F.col(length_col).alias("_length"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts)
    histogram = [(int(r[0]), int(r[1])) for r in counts.groupBy("_length").agg(F.sum("_n")).collect()]
    runs = spark.createDataFrame(plan(histogram, capacity), "_length long, _from long, _below long, _first long, _items long, _offset long")
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("_length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_length", "_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_row", F.row_number().over(W.partitionBy(length_col, "_part").orderBy(*keys)) - 1)
    # both tables have at most capacity * parts and a few times capacity rows
    placed = ranked.join(F.broadcast(before), (F.col(length_col) == before["_length"]) & (ranked["_part"] == before["_part"])).select(*pieces.columns, (F.col("_row") + F.col("_before")).alias("_rank"))
    step = F.col("_rank") - F.col("_from")
    at = placed.join(F.broadcast(runs), (F.col(length_col) == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_below")))
    return at.select(*[placed[c] for c in pieces.columns], (F.col("_first") + F.floor(step / F.col("_items"))).cast("long").alias("sequence_id"), (F.col("_offset") + F.col(length_col) * F.pmod(step, F.col("_items"))).cast("long").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 4096 tokens, and the place of each in a sequence."""
    pieces = token_pieces(read(spark, sf_dir, "documents"))
    lengths = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(lengths, ["doc_id", "piece"])


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
