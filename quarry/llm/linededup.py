"""Near-duplicate lines by an exact set-similarity join: DataFrame functions only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, fresh, literal_longs, read, settle, text_or_empty, with_row_keys, written

#: Jaccard similarity times ten of two lines that match: whole numbers keep the bounds exact.
TENTHS = 8
#: Counters that the words of the corpus are counted in. What they tell, 4 bits each, goes to every task.
COUNTERS = 1 << 18
#: Of the neighbours among a set's rarest words, the pairs under which it first meets the earliest line.
LEADS = 4
#: Times 64 classes of words by which candidates are told apart before their words travel; a power of two.
PARITIES = 4
#: Words above which a line's 64 classes are told apart as 128: more words than that fill 64 classes, which then tell nothing.
LONG = 64
#: Words below which two different sets never match: 3 of 4 words are too few.
LEAST = 4
#: Bits of the filter of places, at most and for each place.
FILTER_BITS, BITS_EACH = 1 << 22, 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz    "


def _folded(line: Column) -> Column:
    """A to Z lower-cased, white space but the line end as blanks. Of plain ASCII lower() does the same and costs less."""
    return F.when(line.rlike("^[\\x20-\\x7e]*$"), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _words(folded: Column) -> Column:
    return F.array_remove(F.split(folded, " "), "")


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, l, line: the lines of every text as they stand, counted from 0."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("l", "line"))


def with_words(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with words: 64-bit hashes of the different words of a line, which tell words apart."""
    return lines.withColumn("words", F.array_distinct(F.transform(_words(_folded(F.col(line_col))), lambda w: F.xxhash64(w))))


def _short(words: Column) -> Column:
    """32 bits of each word, as numbers: they bring lines together; what meets is compared in full later on."""
    return F.transform(words, lambda w: F.shiftright(w, 32).cast("int"))


def rarity(shorts: DataFrame) -> list[int]:
    """For each counter of words, how far its count is above the middle one, in powers of two: 0 is rare, 15 the most.

    Counts the lines that words are in, over all lines. COUNTERS numbers come to the driver.
    """
    slot = F.col("w").bitwiseAND(F.lit(COUNTERS - 1))
    found = shorts.select(F.explode("shorts").alias("w")).groupBy(slot.alias("k")).count().toArrow()  # numbers, not a quarter of a million rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[found.column("k").to_numpy()] = found.column("count").to_numpy()
    middle = float(np.median(counts)) or 1.0
    return np.clip(np.frexp(np.floor(counts / middle))[1] - 1, 0, 15).tolist()


def by_rarity(shorts: Column, rare: list[int], most: Column) -> Column:
    """The rarest words, as many as most, rarest first: an order that is one for all lines, by the rarity of the word's counter and then by hash."""
    table = literal_longs(np.array(rare, dtype=np.int64).reshape(-1, 16) @ (1 << 4 * np.arange(16, dtype=np.int64)))  # 4 bits each

    def key(w: Column) -> Column:
        sixteen = F.get(table, F.shiftright(w.bitwiseAND(F.lit(COUNTERS - 1)), 4))
        of = F.call_function("shiftright", sixteen, F.shiftleft(w.bitwiseAND(F.lit(15)), 2)).bitwiseAND(F.lit(15))
        return F.shiftleft(of, 32).bitwiseOR(w.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)))

    return F.transform(F.slice(F.sort_array(F.transform(shorts, key)), 1, most), lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))


def _overlap(n: Column, m: Column) -> Column:
    """Words that sets of n and m words must share to match: 8 (n + m) / 18, rounded up."""
    return F.floor((TENTHS * (n + m) + 10 + TENTHS - 1) / (10 + TENTHS))


def _may_match(a: str, b: str) -> Column:
    """Whether b may match the earlier a on their first common word: order, length, position, and words that differ.

    size holds how many words a set has, above 32 bits of the word's place in
    it; it is negative where the set needs no match any more, which b then fails.
    sig holds for each of 64 classes of words whether their number is odd: each
    class that differs needs a word that only one of the two has. half is the same
    of every second class of 128, null for short lines. All conditions
    are on both sides, so that a table joined with itself is shuffled once.
    """
    A, B = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    n, m = F.abs(F.shiftright(A("size"), 32)), F.shiftright(B("size"), 32)
    pos = lambda c: c("size").bitwiseAND(F.lit((1 << 32) - 1))
    earlier = (A("d") < B("d")) | ((A("d") == B("d")) & (A("l") < B("l")))
    length = (10 * n >= TENTHS * m) & (10 * m >= TENTHS * n)
    position = F.least(n - pos(A), m - pos(B)) >= _overlap(n, m)
    differ = F.bit_count(A("sig").bitwiseXOR(B("sig"))) * (10 + TENTHS) <= (10 - TENTHS) * (n + m)
    other, halves = A("sig").bitwiseXOR(B("sig")), A("half").bitwiseXOR(B("half"))
    long = (F.bit_count(halves) + F.bit_count(other.bitwiseXOR(halves))) * (10 + TENTHS) <= (10 - TENTHS) * (n + m)
    return length & differ & F.coalesce(long, F.lit(True)) & position & earlier


def _parity(words: Column, k: int) -> Column:
    """Of 64 classes of words, the k-th 64 of them, whether the number of words is odd."""
    mine = lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(PARITIES - 1)) == k
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: F.when(mine(w), s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63)).cast("int")))).otherwise(s))


def _slots(d: Column, l: Column, bits: int) -> Column:
    return F.xxhash64(d, l).bitwiseAND(F.lit(bits - 1))


def _filter_of(places: DataFrame) -> tuple[int, Column]:
    """A bitmap of the places d, l, sized by their number up to FILTER_BITS; beyond that it lets more through, which costs time, not results."""
    bits = 64
    most = min(FILTER_BITS, BITS_EACH * places.count())
    while bits < most:
        bits *= 2
    slot = _slots(F.col("d"), F.col("l"), bits)
    words = places.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bits, literal_longs(table.tolist())


def later_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """d, l of all lines that match an earlier line: Jaccard similarity of their word sets 0.8 or more.

    Earlier is a smaller id, or the same id and a smaller line number; every line
    of the input counts as an earlier one, whether it is removed itself or not.
    Words are runs without ASCII white space, A to Z lower-cased. Lines of fewer
    than min_words different words, and texts with a null id, match nothing.
    No two rows may share an id: dedup_lines() gives them keys.

    Lines with equal sets are one set, at its first place. A set of n words is
    met under its n - ceil(0.8 n) + 1 rarest words by all others, but first, under
    a few pairs of them, by the earliest line there: most of a large group of variants
    is settled by that, and need not meet the others. Only lines that may match
    are read again, for their words.
    """
    spark = docs.sparkSession
    lines = with_words(split_lines(docs, id_col, text_col))
    parity = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63)).cast("int"))))
    half = F.when(F.size("words") > LONG, F.aggregate("words", F.lit(0).cast("bigint"), lambda s, w: F.when(w.bitwiseAND(F.lit(64)) != 0, s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(F.lit(63)).cast("int")))).otherwise(s)))
    ordered = F.sort_array("words")
    # lines without words are left out after the write: a filter before it would compute the words twice
    full = written(lines.select("d", "l", F.size("words").alias("n"), F.xxhash64(ordered).alias("s1"), F.xxhash64(F.lit(1), ordered).alias("s2"), parity.alias("sig"), half.alias("half"), _short(F.col("words")).alias("shorts")))
    rare = rarity(full)
    slim = full.where(F.col("n") >= max(1, min_words))
    prefix = by_rarity(F.col("shorts"), rare, F.col("n") - F.ceil(F.col("n") * TENTHS / 10).cast("int") + 1)
    sets = written(slim.withColumn("prefix", prefix).groupBy("s1", "s2").agg(F.min(F.struct("d", "l")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("half").alias("half"), F.first("prefix").alias("prefix")))
    places = written(slim.select("d", "l", "s1", "s2"))
    discard(full)
    settle(spark)
    enough = sets.where(F.col("n") >= LEAST)

    def by_word(table: DataFrame, words: Column, n: Column) -> DataFrame:
        found = table.select("d", "l", n.cast("long").alias("n"), "sig", "half", F.posexplode(words).alias("pos", "word"))
        return found.select("word", "d", "l", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("size"), "sig", "half")

    # a word that only one variant has breaks two of a set's pairs, and lines that have nothing else in common seldom share one
    pairs_of = F.transform(F.slice("prefix", 2, F.size("prefix")), lambda w, i: F.xxhash64(F.get("prefix", i), w))
    leading = enough.select("at.*", "n", "sig", "half", F.explode(F.slice(F.sort_array(pairs_of), 1, LEADS)).alias("word"))
    met = leading.select("word", "d", "l", F.shiftleft(F.col("n").cast("long"), 32).alias("size"), "sig", "half")  # pairs have no place
    lead = met.groupBy("word").agg(F.min(F.struct("d", "l", "size", "sig", "half")).alias("first")).select("word", "first.*")
    ends = [F.col("b.d").alias("d"), F.col("b.l").alias("l"), F.col("a.d").alias("ad"), F.col("a.l").alias("al")]
    same = F.col("a.word") == F.col("b.word")

    def verified(pairs: DataFrame) -> DataFrame:
        """d, l of the pairs' lines whose sets do match. A line meets the likeliest of its candidates first, all others only if that fails."""
        pairs = written(pairs.distinct())
        settle(spark)
        wanted = written(pairs.select("d", "l").unionByName(pairs.select(F.col("ad").alias("d"), F.col("al").alias("l"))).distinct())
        bits, table = _filter_of(wanted)
        slot = _slots(F.col("d"), F.col("l"), bits)
        there = F.call_function("shiftright", F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        perhaps = split_lines(docs.select(id_col, text_col), id_col, text_col).where(there)
        some = perhaps.join(wanted, ["d", "l"], "left_semi").dropDuplicates(["d", "l"])
        sets_ = written(with_words(some).select("d", "l", F.col("words").alias("set"), F.array(*[_parity(F.col("words"), k) for k in range(PARITIES)]).alias("odd")))
        settle(spark)
        odd = lambda d, l, to: sets_.select(F.col("d").alias(d), F.col("l").alias(l), "odd", F.size("set").alias("n")).withColumnsRenamed({"odd": f"{to}_odd", "n": f"{to}_n"})
        differ = sum((F.bit_count(F.col("a_odd")[k].bitwiseXOR(F.col("b_odd")[k])) for k in range(1, PARITIES)), F.bit_count(F.col("a_odd")[0].bitwiseXOR(F.col("b_odd")[0])))
        near = written(pairs.join(odd("ad", "al", "a"), ["ad", "al"]).join(odd("d", "l", "b"), ["d", "l"]).where(differ * (10 + TENTHS) <= (10 - TENTHS) * (F.col("a_n") + F.col("b_n"))).select("d", "l", "ad", "al", differ.alias("differ")))
        discard(pairs)
        pairs = near
        settle(spark)
        a, b = sets_.select(F.col("d").alias("ad"), F.col("l").alias("al"), F.col("set").alias("a_set")), sets_.withColumnRenamed("set", "b_set")
        both = F.size(F.array_intersect("a_set", "b_set"))

        def matching(some: DataFrame) -> DataFrame:
            return written(some.join(a, ["ad", "al"]).join(b, ["d", "l"]).where(both >= _overlap(F.size("a_set"), F.size("b_set"))).select("d", "l").distinct())

        first = written(pairs.groupBy("d", "l").agg(F.min(F.struct("differ", "ad", "al")).alias("best")).select("d", "l", "best.ad", "best.al"))
        at_once = matching(first)
        settle(spark)
        later = matching(pairs.join(at_once, ["d", "l"], "left_anti").join(first, ["d", "l", "ad", "al"], "left_anti"))
        for t in (pairs, wanted, sets_, first):
            discard(t)
        settle(spark)
        return at_once.unionByName(later)

    settled = verified(met.alias("b").join(lead.alias("a"), same & _may_match("a", "b")).select(*ends))
    known = settled.join(places, ["d", "l"]).select("s1", "s2", F.lit(True).alias("settled")).dropDuplicates(["s1", "s2"])
    rest = written(enough.join(known, ["s1", "s2"], "left").select("at.*", F.when(F.col("settled"), -F.col("n")).otherwise(F.col("n")).alias("n"), "sig", "half", "prefix"))
    # lines after the first with an equal set match it; a first line may match one with another set
    later = written(places.join(sets.select("s1", "s2", "at"), ["s1", "s2"]).where((F.col("d") > F.col("at.d")) | ((F.col("d") == F.col("at.d")) & (F.col("l") > F.col("at.l")))).select("d", "l"))
    for t in (sets, places):
        discard(t)
    settle(spark)
    each = by_word(rest, F.col("prefix"), F.col("n"))
    more = verified(each.alias("b").join(each.alias("a"), same & _may_match("a", "b")).select(*ends))
    discard(rest)
    return later.unionByName(settled).unionByName(more)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """docs with the lines gone that match an earlier line; every row stays, and all other columns.

    A row that loses lines has the rest joined by line ends; n_removed tells how
    many (a column of docs with that name gives way). A text that loses all is
    empty. A null text stays null, and so does the text of a row without an id.
    Rows that repeat an id are documents of their own, one after another.
    """
    d, key, gone, split, n = fresh(docs, "d"), fresh(docs, "key"), fresh(docs, "gone"), fresh(docs, "split"), "n_removed"
    keyed = with_row_keys(docs, id_col, key)
    some = keyed.select(F.when(F.col(id_col).isNotNull(), F.col(key)).alias("d"), F.col(text_col).alias("text"))
    found = later_matches(some, "d", "text", min_words).groupBy(F.col("d").alias(d)).agg(F.collect_set("l").alias(gone))
    # a projection of its own, so that a text is split once and not once for each line
    joined = keyed.join(found, F.col(key) == F.col(d), "left").select(*docs.columns, gone, F.when(F.col(gone).isNotNull(), F.split(text_col, "\n")).alias(split))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    left = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() != n]
    return joined.select(*left, F.coalesce(F.size(gone), F.lit(0)).alias(n))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier one, as digests."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
