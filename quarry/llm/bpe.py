"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chunks import PieceEncoder, slices
from quarry.llm.common import read, text_or_empty

RANKS = "byte_bpe_50k.tiktoken"


def byte_to_char() -> list[str]:
    """The visible character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges of lower rank leave of token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """A tokenizer of the tokenizers library with the ranks at path, bytes written as characters."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_to_char()
    shown = {t: "".join(char[b] for b in t) for t in ranks}
    merges = [tuple("".join(char[b] for b in part) for part in _last_merge(t, r, ranks)) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1]
    made = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, cache_capacity=0))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return made


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> PieceEncoder:
    made = tokenizer(path, pattern)
    return PieceEncoder(lambda text: made.encode_batch_fast([text], add_special_tokens=False)[0].ids, glue=True, apart="\n")


def _lists(bounds: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns id_col, ids array<int>, and with offsets starts and ends, arrays of
    the places in code points that each token covers (a token that holds a part
    of a character covers all of it). A null text is encoded as an empty one; an
    empty text has no ids. Ids may be null or repeat; other columns are left out.
    """
    path = path or public_tokenizers.path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                found = made.encode_batch(part.column("text").to_pylist(), add_special_tokens=False)
                bounds = np.concatenate([[0], np.cumsum([len(e.ids) for e in found])])
                ids = np.array([i for e in found for i in e.ids], dtype=np.int32)
                places = np.array([o for e in found for o in e.offsets], dtype=np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(bounds, ids), _lists(bounds, places[:, 0].copy()), _lists(bounds, places[:, 1].copy())], ["id", "ids", "starts", "ends"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(*encoder(part.column("text")))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    out = rows.mapInArrow(whole, f"id {kind}, ids array<int>, starts array<int>, ends array<int>") if offsets else rows.mapInArrow(pieces, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """The bytes of every sequence of ids, from the table that maps ids to bytes.

    Returns id_col, bytes binary and text: the bytes as UTF-8, where parts of a
    character that the sequence splits or cuts off become U+FFFD. Null ids are
    empty. An id that is unknown or null raises an error.
    """
    path = path or public_tokenizers.path(RANKS)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(path)
        place = np.full(max(ranks.values()) + 1, -1, dtype=np.int64)
        size = np.zeros(len(place), dtype=np.int64)
        table = np.frombuffer(b"".join(ranks), dtype=np.uint8)
        at = 0
        for token, rank in ranks.items():
            place[rank], size[rank] = at, len(token)
            at += len(token)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column("ids")
                ids = lists.flatten()
                if ids.null_count:
                    raise ValueError("decode: null among ids")
                ids = ids.to_numpy().astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(place) or (place[ids] < 0).any()):
                    raise ValueError("decode: unknown id")
                length = size[ids]
                end = np.cumsum(length)
                total = int(end[-1]) if len(end) else 0
                data = table[np.arange(total) + np.repeat(place[ids] - (end - length), length)]
                n = np.array([0 if v is None else v for v in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
                bounds = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])], ["id", "bytes"])

    out = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary")
    return out.select(F.col("id").alias(id_col), "bytes")


def as_text(decoded: DataFrame, bytes_col: str = "bytes") -> DataFrame:
    """decoded with text: the bytes as UTF-8, each broken part of a character as U+FFFD."""
    return decoded.withColumn("text", F.make_valid_utf8(F.col(bytes_col).cast("string")))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that they decode to, as digests."""
    ids = encode(read(spark, sf_dir, "documents"))
    with_ids = ids.select(F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256")).alias("doc"), "ids")
    return decode(with_ids, id_col="doc").select("doc.doc_id", "doc.n_tokens", "doc.ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe_round_trip": op3_bpe_round_trip}
