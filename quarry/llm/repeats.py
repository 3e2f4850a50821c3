"""Repeated byte strings across documents, removed by suffix arrays over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, fresh, read, settle, text_or_empty, with_row_keys, written
from quarry.llm.suffix import suffix_array

#: Bytes of a string that must not repeat, and of the grams that choose its shard.
LENGTH, GRAM = 100, 24
#: Bits of the filter that tells which grams repeat: so many for each, up to a most (32 MB). A full filter costs time, not results.
FILTER_EACH, FILTER_MOST = 16, 1 << 28
#: Bytes of a shard that are sorted at a time; contexts of one gram beyond which its windows are grouped instead.
SHARD_BYTES, CROWD = 800_000, 4_000
#: Bytes of a text that anchors are looked for at a time.
BLOCK = 1 << 19

_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) ^ (x >> np.uint64(31))


class Anchors:
    """Which gram stands for each string of length bytes: that of the smallest hash, the leftmost of equal ones.

    It depends on the string alone, so equal strings have equal grams. Strings in
    a row with one and the same gram are a context.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK + length, np.uint64(_ODD))])
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(BLOCK + length, np.uint64(pow(_ODD, -1, 1 << 64)))])
        self.value = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

    def __call__(self, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Gram hash, context hash, first string and number of strings of each context."""
        out = []
        for low in range(0, max(0, len(data) - self.length + 1), BLOCK):
            block = data[low : low + BLOCK + self.length - 1]
            total = np.empty(len(block) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(self.value[block] * self.power[: len(block)], out=total[1:])
            grams = len(block) - self.gram + 1
            h = _mix((total[self.gram :] - total[:grams]) * self.inverse[:grams])
            # smallest of each width grams, from minima to the left and right within blocks of width
            place = np.uint64((1 << 20) - 1)
            v = (h & ~place) | np.arange(grams, dtype=np.uint64)
            padded = np.full(-(-grams // self.width) * self.width, ~np.uint64(0))
            padded[:grams] = v
            rows = padded.reshape(-1, self.width)
            right = np.minimum.accumulate(rows, axis=1).ravel()
            left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            strings = len(block) - self.length + 1
            at = (np.minimum(left[:strings], right[self.width - 1 : self.width - 1 + strings]) & place).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            many = np.diff(np.r_[first, strings])
            context = _mix((total[first + many + self.length - 1] - total[first]) * self.inverse[first] + many.astype(np.uint64))
            out.append((h[at[first]], context, first + low, many))
        return out


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes a bitmap has."""
    slot = hashes & np.uint64(64 * len(bits) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _anchor_rows(docs: DataFrame, length: int, gram: int, keep: np.ndarray | None, full: bool, skip: np.ndarray | None = None) -> DataFrame:
    """h, and with full also c, d, lo, many, of all contexts of docs (d, text) whose gram keep lets through, but for ids that skip has."""
    sent = docs.sparkSession.sparkContext.broadcast((keep, skip))
    names = ["h", "c", "d", "lo", "many"] if full else ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (bits, left_out) = Anchors(length, gram), sent.value

        def out(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*held)], names)

        for batch in batches:
            ids, texts = batch.column("d").to_numpy(zero_copy_only=False), batch.column("text")
            gone = _in(left_out, batch.column("x").to_numpy().view(np.uint64)) if left_out is not None else np.zeros(len(ids), dtype=bool)
            held, rows = [], 0
            for i, text in enumerate(texts):
                if gone[i]:
                    continue
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8) if len(text.as_py()) >= length // 4 else np.zeros(0, np.uint8)
                for h, c, lo, many in anchors(data):
                    if bits is not None:
                        ok = _in(bits, h)
                        h, c, lo, many = h[ok], c[ok], lo[ok], many[ok]
                    held.append((h, c, np.full(len(h), ids[i]), lo, many) if full else (h,))
                    rows += len(h)
                if rows > 200_000:
                    yield out(held)
                    held, rows = [], 0
            if rows:
                yield out(held)

    return docs.select("d", "text", F.xxhash64("d").alias("x")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _filter_of(repeated: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in repeated (column h, a written table), sized by their number."""
    size, most = 1 << 12, min(FILTER_MOST, FILTER_EACH * repeated.count())
    while size < most:
        size *= 2
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    words = repeated.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits


def _perhaps(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """d, text of the rows of docs whose id the bitmap has."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(sent.value, batch.column("x").to_numpy().view(np.uint64)))).select(["d", "text"])

    return docs.select("d", "text", F.xxhash64("d").alias("x")).mapInArrow(run, "d long, text string")


def shard_repeats(contexts: list[bytes], many: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, from, below): strings that an earlier context has too, or the same one further left.

    contexts are in the order of their places. Of each, the first many[i] strings
    of length bytes count.
    """
    size = np.array([len(c) for c in contexts])
    text = np.insert(np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.uint16) + 1, np.cumsum(size), 0)
    start = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(contexts), dtype=np.int32), size + 1)
    place = np.arange(len(text), dtype=np.int32) - start.astype(np.int32)[of]
    order = suffix_array(text, length)
    order = order[place[order] < many[of[order]]]  # strings that lie in their context
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in range(length):
        live = np.flatnonzero(same)
        same[live] = text[order[1:][live] + k] == text[order[:-1][live] + k]
    group = np.cumsum(np.r_[True, ~same]) - 1 if len(order) else order
    first = np.full(int(group[-1]) + 1 if len(order) else 0, len(text))
    np.minimum.at(first, group, order)  # positions in text follow the order of places
    later = np.zeros(len(text) + 1, dtype=bool)
    later[order[first[group] < order]] = True
    low, high = np.flatnonzero(later[:-1] & ~np.r_[False, later[:-2]]), np.flatnonzero(later[:-1] & ~later[1:]) + 1
    return [(int(of[a]), int(place[a]), int(place[a] + b - a)) for a, b in zip(low, high)]


def _shards(rows: DataFrame, length: int) -> DataFrame:
    """d, low, high: bytes of repeated strings. rows: h, d, lo, many, k, context, all k contexts of a gram together.

    A shard is sorted before a gram whose contexts may not fit in as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            # a context alone with its gram can only repeat itself, in which case the gram is there twice
            rows = sorted(rows, key=lambda r: (r[1], r[2]))
            found = shard_repeats([r[4] for r in rows], np.array([r[3] for r in rows]), length) if len(rows) > 1 else []
            cols = zip(*[(rows[i][1], rows[i][2] + a, rows[i][2] + b + length - 1) for i, a, b in found]) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["d", "low", "high"])

        for batch in batches:
            for *row, k in zip(*(batch.column(c).to_pylist() for c in ("h", "d", "lo", "many", "context", "k"))):
                if held and row[0] != held[-1][0] and size + k * 2 * length > SHARD_BYTES:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield done(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "d long, low long, high long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, low, high: byte ranges whose strings of length bytes all start earlier, too; ranges may overlap.

    Earlier is a smaller id, or the same id and a smaller place. Ids must be
    whole numbers that no two rows share; rows with a null id are left out.

    Every string is in the shard of its gram (Anchors), so equal strings meet.
    Only contexts whose gram occurs again go on; equal contexts are grouped, and
    all but the first are repeats; different contexts of a gram are compared by a
    suffix array of the shard. Grams with more than CROWD different contexts have
    the strings themselves grouped, which no number of them overloads.
    """
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), text_or_empty(text_col).alias("text"))
    copies = whole.groupBy(F.sha2("text", 256).alias("s")).agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(whole.select("d", F.sha2("text", 256).alias("s"), F.octet_length("text").cast("long").alias("bytes")).join(copies, "s").where("d > first").select("d", "bytes"))
    # most texts are surely no copies, which a bitmap of the copies' ids tells where they lie; the others are told apart by a join
    copied = _filter_of(copies.select(F.xxhash64("d").alias("h")))
    told = written(_perhaps(whole, copied).join(copies.select("d"), "d", "left_anti"))

    def anchored(keep: np.ndarray | None, full: bool) -> DataFrame:
        return _anchor_rows(whole, length, gram, keep, full, copied).unionByName(_anchor_rows(told, length, gram, keep, full))

    seen = written(anchored(None, False).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    keep = _filter_of(seen)
    discard(seen)
    settle(docs.sparkSession)
    contexts = written(anchored(keep, True))
    discard(told)
    settle(docs.sparkSession)
    firsts = written(contexts.groupBy("h", "c").agg(F.min(F.struct("d", "lo", "many")).alias("at"), F.count(F.lit(1)).alias("n")).select("h", "c", "at.*", "n"))
    again = contexts.join(firsts.where("n > 1").select("h", "c", F.col("d").alias("fd"), F.col("lo").alias("fl")), ["h", "c"]).where("d > fd or (d = fd and lo > fl)")
    again = written(again.select("d", F.col("lo").alias("low"), (F.col("lo") + F.col("many") + (length - 1)).alias("high")))
    discard(contexts)
    settle(docs.sparkSession)
    spans = [copies.where(F.col("bytes") >= length).select("d", F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high")), again]

    different = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    to_cut = firsts.join(different, "h").groupBy("d").agg(F.collect_list(F.struct("h", "lo", "many", "k")).alias("cuts"))
    cuts = whole.join(to_cut, "d").select("d", F.encode("text", "UTF-8").alias("data"), F.explode("cuts").alias("x"))
    cut = written(cuts.select("x.h", "d", "x.lo", "x.many", "x.k", F.substring("data", F.col("x.lo").cast("int") + 1, (F.col("x.many") + (length - 1)).cast("int")).alias("context")))
    discard(firsts)
    settle(docs.sparkSession)
    spans.append(_shards(cut.where(F.col("k") <= CROWD).select("h", "d", "lo", "many", "k", "context"), length))
    strings = cut.where(F.col("k") > CROWD).select("d", "lo", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("many").cast("int")), lambda i: F.substring(F.col("context"), i, F.lit(length)))).alias("o", "string")).select("d", (F.col("lo") + F.col("o")).alias("low"), "string")
    earliest = strings.groupBy("string").agg(F.min(F.struct("d", "low")).alias("at"))
    spans.append(strings.join(earliest, "string").where("d > at.d or (d = at.d and low > at.low)").select("d", "low", (F.col("low") + length).alias("high")))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    out = written(out)
    for table in (again, copies, cut):
        discard(table)
    settle(docs.sparkSession)
    return out


_OUT = "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"


def _without(whole_chars: bool):
    """A function of a text and its spans: what is left of the text's bytes, and counts."""

    @F.arrow_udf(_OUT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans_of in batches:
            out = []
            for text, spans in zip(texts.cast(pa.binary()), spans_of):
                text, kept, end, runs, gone = text.as_py(), [], 0, 0, 0
                for span in spans.as_py() or ():
                    low, high = span["low"], min(span["high"], len(text))
                    if whole_chars:
                        while low < high and text[low] & 0xC0 == 0x80:
                            low += 1
                        while low < high < len(text) and text[high] & 0xC0 == 0x80:
                            high -= 1
                    if high <= low:
                        continue
                    if low > end or not runs:
                        kept.append(text[end:low])
                        runs += 1
                        gone += high - low
                        end = high
                    elif high > end:
                        gone += high - end
                        end = high
                out.append((b"".join([*kept, text[end:]]), len(text), gone, runs))
            kept, *counts = zip(*out) if out else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], ["kept", "n_bytes", "n_removed", "n_spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, whole_chars: bool = False) -> DataFrame:
    """docs, and kept binary: the bytes of each text outside its repeated spans; n_bytes, n_removed, n_spans long.

    A null text is an empty one. Every row stays, with all its columns, but for
    those of the four names, which give way. Rows that repeat an id are documents
    of their own, one after another; a row with a null id loses nothing. With
    whole_chars a span that begins or ends inside a character leaves it whole.
    """
    d, key, found, out = fresh(docs, "d"), fresh(docs, "key"), fresh(docs, "spans"), fresh(docs, "out")
    keyed = with_row_keys(docs, id_col, key)
    some = keyed.select(F.when(F.col(id_col).isNotNull(), F.col(key)).alias("d"), F.col(text_col).alias("text"))
    spans = repeated_spans(some, "d", "text", length, gram).groupBy(F.col("d").alias(d)).agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias(found))
    rows = keyed.join(spans, F.col(key) == F.col(d), "left").withColumn(out, _without(whole_chars)(text_or_empty(text_col), F.col(found)))
    return rows.select(*[c for c in docs.columns if c.lower() not in ("kept", "n_bytes", "n_removed", "n_spans")], f"{out}.*")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated strings of 100 bytes."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_array_dedup": op7_suffix_array_dedup}
