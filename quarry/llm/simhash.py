"""SimHash near-duplicates by meeting in the middle of the Hamming ball."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.chunks import slices
from quarry.llm.common import components, discard, fresh, lower_ascii, read, settle, text_or_empty, with_row_keys, written
from quarry.llm.repeats import _filter_of, _in

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 3, 3
#: Jaccard similarity times ten of two near texts, counters that shingles are counted in, and rarest shingles under which a set first meets the smallest.
TENTHS, COUNTERS, LEADS = 8, 1 << 16, 2
#: Classes of shingles by which candidates are told apart before their sets travel.
CLASSES = 2048
#: Sets under a shingle of their prefixes beyond which they do not meet there, but under parts of their shingles.
CROWD = 8
#: Steps in which candidates meet their sets of shingles, so that only a part of the pairs carries them at a time.
STEPS = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Shingles that are hashed and counted at a time.
_STRIDE = 1 << 15


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' XXH64; 0 without words."""
    return _majority(_hashes(text, shingle, seed))


def _hashes(text: str, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, _STRIDE at a time; nothing without words."""
    words = _WORD.findall(text)
    n = max(1, len(words) - shingle + 1) if words else 0
    for low in range(0, n, _STRIDE):
        high = min(n, low + _STRIDE)
        part = words[low : high + shingle - 1]
        joined = map(" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [" ".join(words)]
        yield np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), dtype="<u8", count=high - low)


def _majority(hashes: Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id_col and bits, the 64-bit SimHash as a signed long, of every whole text with A to Z lower-cased.

    Null and blank texts get 0. Texts of fewer words than a shingle are one shingle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bits = np.array([simhash(t, shingle, seed) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bits.view(np.int64))], ["id", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), lower_ascii(text_or_empty(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, bits long").withColumnRenamed("id", id_col)


def _block_masks(blocks: int) -> list[int]:
    cut = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(bits: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Rows block, key, bits: for each block of the 64 bits, bits without it, and all variants of that within one bit.

    Half of radius 3 is 1.5, and balls of radius 2 would be 2081 rows each. So a
    block is left out and the rest emits its ball of radius 1. Of two
    fingerprints that differ in 1 to 3 bits either some block has exactly one of
    them, and the rests are within 2, so their balls meet; or one block has them
    all, and the rests are equal.
    """
    made = []
    for block, mask in enumerate(_block_masks(blocks)):
        rest = ~mask & ((1 << 64) - 1)
        flips = [0] + [_signed(1 << i) for i in range(64) if rest >> i & 1]
        base = F.col("bits").bitwiseAND(F.lit(_signed(rest)))
        made += [F.struct(F.lit(block).alias("block"), base.bitwiseXOR(F.lit(f)).alias("key")) for f in flips]
    return bits.select("bits", F.explode(F.array(*made)).alias("v")).select("v.block", "v.key", "bits")


def bucket_links(bits: np.ndarray, mask: int, key: int, sweep: int = 1024) -> list[tuple[int, int]]:
    """Links that join all that is within 3 bits among the fingerprints of one bucket, without forming all pairs.

    Those alike in the block are within 2 of one another: a star holds them.
    Contents of the block that differ in one bit have all their members within
    3: their heads link. Members whose rest is the key itself link where their
    contents are within 3. Contents are looked up by flipping bits where there
    are more than sweep of them, and compared by sweeps otherwise.
    """
    block = bits & np.uint64(mask)
    order = np.argsort(block, kind="stable")
    bits, block = bits[order], block[order]
    first = np.r_[True, block[1:] != block[:-1]]
    heads = np.flatnonzero(first)
    out = [(int(a), int(b)) for a, b in zip(bits[~first], bits[heads[np.cumsum(first)[~first] - 1]])]
    if len(heads) > 1:
        exact = bits[(bits & ~np.uint64(mask)) == np.uint64(key)]
        for some, reach in ((bits[heads], 1), (exact, 3)):
            out += _close(some, mask, reach, sweep)
    return out


def _close(bits: np.ndarray, mask: int, reach: int, sweep: int) -> list[tuple[int, int]]:
    """Pairs, in both orders or one, whose contents of the block differ in 1 to reach bits; contents are distinct."""
    block, out = bits & np.uint64(mask), []
    if len(bits) <= sweep:
        for i in range(1, len(bits)):
            near = np.flatnonzero(np.bitwise_count(block[:i] ^ block[i]) <= reach)
            out += [(int(bits[i]), int(bits[j])) for j in near]
        return out
    order = np.argsort(block)
    block, bits = block[order], bits[order]
    single = [1 << i for i in range(64) if mask >> i & 1]
    flips = {a | b | c for a in single for b in (single if reach > 1 else [a]) for c in (single if reach > 2 else [a])}
    for f in flips:
        want = block ^ np.uint64(f)
        at = np.minimum(np.searchsorted(block, want), len(block) - 1)
        out += [(int(a), int(b)) for a, b in zip(bits[block[at] == want], bits[at[block[at] == want]]) if a > b]
    return out


def links(bits: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Links a, b (a > b as unsigned numbers) that connect all distinct fingerprints within 3 bits, and no others.

    bits: one column, bits. Every link is within 3; of the links inside a bucket
    only those are returned that hold its members together.
    """
    masks = _block_masks(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def done(block: np.ndarray, key: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            bits = bits.view(np.uint64)
            new = np.r_[True, (block[1:] != block[:-1]) | (key[1:] != key[:-1])]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, len(bits)])
            two = start[size == 2]
            two = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= RADIUS]
            found = {(int(max(a, b)), int(min(a, b))) for a, b in zip(bits[two], bits[two + 1])}
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                found.update((max(a, b), min(a, b)) for a, b in bucket_links(bits[s : s + n], masks[block[s]], int(key[s : s + 1].view(np.uint64)[0])))
            pairs = np.array(sorted(found), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.r_[k, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)] for k, c in zip(kept, ("block", "key", "bits"))]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            kept = [c[cut:] for c in cols]
            if cut:
                yield done(*(c[:cut] for c in cols))
        if len(kept[0]):
            yield done(*kept)

    met = variants(bits, blocks).repartition("block", "key").sortWithinPartitions("block", "key")
    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id_col, bits and component_id: the smallest id that is reachable over fingerprints within 3 bits.

    Every row of docs is returned. Equal fingerprints are one node. Rows with a
    null id keep it, and count in no minimum; a group of them alone has a null
    component_id. Texts without words have fingerprint 0 and link like others.
    """
    bits = written(fingerprints(docs, id_col, text_col, shingle))
    nodes = written(bits.groupBy("bits").agg(F.min(id_col).alias("low")))
    found = components(links(nodes.select("bits")))
    joined = nodes.join(found, F.col("bits") == F.col("node"), "left").select("bits", "low", F.coalesce("component", "bits").alias("group"))
    lowest = joined.groupBy("group").agg(F.min("low").alias("component_id"))
    of = written(joined.join(lowest, "group").select("bits", "component_id"))
    discard(nodes)
    return bits.join(of, "bits").select(id_col, "bits", "component_id")


def _shingle_set(text: str, shingle: int) -> tuple[np.ndarray, int]:
    """The different hashes of a text's shingles, sorted, and its SimHash."""
    found = list(_hashes(text, shingle, SEED))
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *found])), _majority(found)


def _set_hash(keys: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(keys.tobytes(), SEED))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), lower_ascii(text_or_empty()).alias("text"))


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, schema: str, columns: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """What columns makes of the shingle sets of docs whose ids wanted (low, a written table) has, and of a few others.

    A bitmap of the ids tells them where they lie, so that no text is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select(F.xxhash64("low").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in(sent.value, batch.column("x").to_numpy().view(np.uint64))))
            for part in slices(batch, "text"):
                made = columns([_shingle_set(t, shingle)[0] for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(made, [c.split()[0] for c in schema.split(", ")])

    return _texts(docs).withColumn("x", F.xxhash64("id")).mapInArrow(run, schema)


def _rarity(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each counter of shingles, how far its count is above the middle one, in powers of two. COUNTERS numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    for h in _hashes(t, shingle, SEED):
                        np.add.at(count, (h & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["k", "n"])

    count = np.zeros(COUNTERS, dtype=np.int64)
    sums = _texts(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    count[sums.column("k").to_numpy()] = sums.column("n").to_numpy()
    return np.log2(np.maximum(1, count / max(1.0, float(np.median(count))))).astype(np.uint8)


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """id, s, bits, n, prefix: the hash of a text's shingle set, its SimHash, the set's size and its rarest shingles.

    Of two sets that share JACCARD of their shingles or more, the prefixes share
    one: n - ceil(0.8 n) + 1 shingles in one order, rarest first.
    """
    rare = _rarity(docs, shingle)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, bits, n, prefix = [], [], [], []
                for t in part.column("text").to_pylist():
                    keys, b = _shingle_set(t, shingle)
                    need = len(keys) - -(-len(keys) * TENTHS // 10) + 1 if len(keys) else 0
                    order = np.argsort(rare[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    s.append(_set_hash(keys))
                    bits.append(_signed(b))
                    n.append(len(keys))
                    prefix.append(keys[order[:need]].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s, pa.int64()), pa.array(bits, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "s", "bits", "n", "prefix"])

    return _texts(docs).mapInArrow(run, f"id {kind}, s long, bits long, n long, prefix array<long>")


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of pairs (a, b: hashes of sets) whose sets have a Jaccard similarity of 0.8 or more."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    wanted = written(sets.join(pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s", "left_semi").select("s", "low"))

    def columns(keys: list[np.ndarray]) -> list[pa.Array]:
        odd = [np.packbits(np.bincount((k & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES) & 1).view(np.int64) for k in keys]
        return [pa.array([_set_hash(k) for k in keys], pa.int64()), pa.array([k.view(np.int64) for k in keys], pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))]

    # an id may have several texts
    full = written(_sets_of(docs, wanted, shingle, "s long, keys array<long>, odd array<long>", columns).join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"]))
    settle(docs.sparkSession)
    # each class of shingles that is odd in one set only needs a shingle that only one of them has
    odd = lambda to, o, n: full.select(F.col("s").alias(to), F.col("odd").alias(o), F.size("keys").alias(n))
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
    near = written(pairs.join(odd("a", "x", "n"), "a").join(odd("b", "y", "m"), "b").where(differ * (10 + TENTHS) <= (10 - TENTHS) * (F.col("n") + F.col("m"))).select("a", "b"))
    few = written(full.select("s", "keys").join(near.select(F.explode(F.array("a", "b")).alias("s")).distinct(), "s", "left_semi"))
    for t in (pairs, full):
        discard(t)
    pairs, full = near, few
    settle(docs.sparkSession)
    both = F.size(F.array_intersect("x", "y"))
    parts = []
    for step in range(STEPS):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(STEPS)) == step)
        x = full.where(F.pmod(F.xxhash64("s"), F.lit(STEPS)) == step).select(F.col("s").alias("a"), F.col("keys").alias("x"))
        y = full.join(some.select(F.col("b").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("b"), F.col("keys").alias("y"))
        parts.append(written(some.join(x, "a").join(y, "b").where(both * (10 + TENTHS) >= TENTHS * (F.size("x") + F.size("y"))).select("a", "b")))
        settle(docs.sparkSession)
    out = written(reduce(DataFrame.unionByName, parts))
    for t in (pairs, wanted, full, *parts):
        discard(t)
    settle(docs.sparkSession)
    return out


def _fits(a: str, b: str) -> Column:
    """Whether sets with a first common shingle at these places may be alike: their sizes, and what is left of both."""
    A, B = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    n, m = A("n"), B("n")
    left = F.least(n - A("pos"), m - B("pos"))
    return (10 * n >= TENTHS * m) & (10 * m >= TENTHS * n) & ((10 + TENTHS) * left >= TENTHS * (n + m))


def _bounds(most: int = 1 << 40) -> np.ndarray:
    """Smallest sizes of levels: sets that may be alike are of one level or of two in a row."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 10 // TENTHS + 1)
    return np.array(out)


_LEVELS = _bounds()


def part_keys(keys: np.ndarray) -> np.ndarray:
    """64-bit keys of which two sets of shingles with a Jaccard similarity of 0.8 or more share one.

    Such sets of n and m shingles differ in (n + m) / 9 at most. Where a level's
    shingles are dealt to more parts than its sets may differ in, some parts are
    equal; a key stands for all shingles of a part. A set is in its own level,
    and in the next if sets of that may be alike. Parts without shingles have no
    key: a set with so many of them that two may be equal in no others has the
    keys of its prefix, by hash, which two such sets share one of.
    """
    out, n = [np.zeros(0, np.uint64)], len(keys)
    own = int(np.searchsorted(_LEVELS, n, side="right")) - 1
    for level in (own, own + 1) if n else ():
        if level > own and 10 * n < TENTHS * int(_LEVELS[level]):
            continue
        differ = 2 * (int(_LEVELS[level + 1]) - 1) * (10 - TENTHS) // (10 + TENTHS)
        parts = differ + differ // 8 + 2
        of = (keys >> np.uint64(16)) % np.uint64(parts)
        order = np.argsort(of, kind="stable")
        of = of[order]
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        tag = np.uint64(level << 44)
        out.append((np.add.reduceat(keys[order], start) ^ tag ^ of[start]) * np.uint64(0x9E3779B97F4A7C15))
        if parts - len(start) >= parts - differ:
            out.append((keys[: n - -(-n * TENTHS // 10) + 1] ^ tag ^ np.uint64(1 << 43)) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(out)


def _shared(rows: DataFrame) -> DataFrame:
    """Those of rows (key, g and others) whose key two groups have, and many: the rows of the key."""
    of = Window.partitionBy("key")
    told = rows.withColumns({"many": F.count(F.lit(1)).over(of), "lo": F.min("g").over(of), "hi": F.max("g").over(of)})
    return written(told.where("lo <> hi").drop("lo", "hi"))


def _met(rows: DataFrame, fits: Column | None = None) -> DataFrame:
    """Pairs a, b of rows (s, n, g, key) with a key in common, in different groups, of sizes that may be alike."""
    n, m = F.col("x.n"), F.col("y.n")
    sizes = (10 * n >= TENTHS * m) & (10 * m >= TENTHS * n)
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.s") < F.col("y.s")) & (F.col("x.g") != F.col("y.g"))
    return rows.alias("x").join(rows.alias("y"), apart & (sizes if fits is None else fits)).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))


def _crowded(docs: DataFrame, crowd: DataFrame, shingle: int) -> DataFrame:
    """Rows s, n, g, key: the sets in crowd (s, low, g) under the parts of their shingles."""

    def columns(sets: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([_set_hash(k) for k in sets], pa.int64()), pa.array([len(k) for k in sets], pa.int64()), pa.array([part_keys(k).view(np.int64) for k in sets], pa.list_(pa.int64()))]

    return _sets_of(docs, crowd, shingle, "s long, n long, keys array<long>", columns).join(crowd.select("s", "g"), "s").select("s", "n", "g", F.explode("keys").alias("key"))


def near_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and component_id: the smallest id reachable over shingle sets with a Jaccard similarity of 0.8 or more.

    Near texts are often more than 3 bits of SimHash apart, so fingerprints only
    settle what they can: sets with equal fingerprints or linked ones, and sets
    that share a rarest shingle with the smallest such set, are compared first.
    Only sets that are still in different groups then meet under the shingles of
    their prefixes, where all that are near do. Sets that share such a shingle
    with more than CROWD meet under parts of their shingles instead, of which near
    sets have one in common and others seldom do. Every link is verified.
    """
    spark = docs.sparkSession
    rows = written(_profiles(docs, shingle))
    settle(spark)
    sets = written(rows.groupBy("s").agg(F.min("id").alias("low"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    texts = written(rows.select("id", "s"))
    discard(rows)
    heads = written(sets.groupBy("bits").agg(F.min("s").alias("head")))
    settle(spark)
    met = links(heads.select("bits")).join(heads.select(F.col("bits").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("bits").alias("b"), F.col("head").alias("y")), "b")
    alike = sets.join(heads, "bits").select(F.col("s").alias("a"), F.col("head").alias("b")).unionByName(met.select(F.col("x").alias("a"), F.col("y").alias("b")))
    lead = sets.select("s", "n", F.posexplode(F.slice("prefix", 1, LEADS)).alias("pos", "key"))
    first = lead.groupBy("key").agg(F.min(F.struct("s", "n", "pos")).alias("f")).select("key", "f.*")
    led = lead.alias("x").join(first.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.s") != F.col("y.s")) & _fits("x", "y")).select(F.col("x.s").alias("a"), F.col("y.s").alias("b"))
    settled = _verified(docs, sets, alike.unionByName(led), shingle)
    groups = components(settled)
    open_ = written(sets.join(groups, F.col("s") == F.col("node"), "left").select("s", "low", "n", F.coalesce("component", "s").alias("g"), "prefix"))
    lows = written(sets.select("s", "low"))
    discard(sets)
    settle(spark)
    shared = _shared(open_.select("s", "n", "g", F.posexplode("prefix").alias("pos", "key")))
    settle(spark)
    crowd = written(open_.select("s", "low", "g").join(shared.where(F.col("many") > CROWD).select("s").distinct(), "s", "left_semi"))
    parts = _shared(_crowded(docs, crowd, shingle))
    settle(spark)
    more = _met(shared.where(F.col("many") <= CROWD), _fits("x", "y")).unionByName(_met(parts))
    found = components(settled.unionByName(_verified(docs, lows, more, shingle)))
    joined = lows.join(found, F.col("s") == F.col("node"), "left").select("s", "low", F.coalesce("component", "s").alias("g"))
    of = written(joined.join(joined.groupBy("g").agg(F.min("low").alias("component_id")), "g").select("s", "component_id"))
    for t in (lows, heads, open_, settled, shared, crowd, parts):
        discard(t)
    return texts.join(of, "s").select(F.col("id").alias("doc_id"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, with the columns that it came with.

    Near are texts whose sets of shingles have a Jaccard similarity of 0.8 or
    more. Texts without words are alike. Rows with a null doc_id are kept. Rows
    that repeat an id are documents of their own, one after another.
    """
    key, gone = fresh(docs, "key"), fresh(docs, "gone")
    keyed = with_row_keys(docs, "doc_id", key)
    found = near_sets(keyed.where("doc_id is not null").select(F.col(key).alias("doc_id"), "text"), shingle)
    later = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return keyed.join(later, F.col("doc_id").isNotNull() & (F.col(key) == F.col(gone)), "left_anti").select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
