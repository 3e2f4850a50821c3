"""Document fingerprints by winnowing: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import partitions, read, text_or_empty

#: Words of a gram, and grams of a window: any run of GRAM + WINDOW - 1 equal words leaves a common mark.
GRAM, WINDOW = 5, 4
#: Bits of a mark that hold the place of its gram.
PLACE = 24


def with_marks(df: DataFrame, text_col: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """df with out: the marks of a text, in order, as array<long>.

    The grams are all runs of gram words (of a shorter text: the whole), hashed
    from their words' hashes. From every window of grams the smallest is marked,
    of equal ones the rightmost; a text of fewer grams is one window. A mark holds
    40 bits of the hash above 24 bits of the place (from the left, modulo 2**24);
    mark_hash() and mark_place() take it apart. A text without words, or null, has
    no marks. Each step is a projection of its own, so that no array is computed
    again inside a loop over another.
    """
    last = (1 << PLACE) - 1
    keep = df.columns
    blanks = F.translate(text_or_empty(text_col), "\t\n\x0b\x0c\r", "     ")  # a split at a plain blank costs less than at a pattern
    step = df.withColumn("_w", F.transform(F.array_remove(F.split(blanks, " "), ""), lambda w: F.xxhash64(w)))
    size = F.size("_w")
    grams = F.when(size == 0, F.array().cast("array<bigint>")).when(size < gram, F.array(F.xxhash64("_w"))).otherwise(F.transform(F.sequence(F.lit(0), size - gram), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(gram)])))
    step = step.select(*keep, grams.alias("_g"))
    # the complement of the place: of equal hashes the smallest is the rightmost
    step = step.select(*keep, F.transform("_g", lambda g, i: g.bitwiseAND(F.lit(~last)).bitwiseOR(F.lit(last) - F.pmod(i, F.lit(last + 1)))).alias("_v"))
    n = F.size("_v")
    least = F.when(n <= window, F.when(n > 0, F.array(F.array_min("_v"))).otherwise(F.col("_v"))).otherwise(F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get("_v", i + k) for k in range(window)])))
    return step.select(*keep, F.array_distinct(least).alias(out))


def mark_hash(mark: Column) -> Column:
    return F.shiftright(mark, PLACE)


def mark_place(mark: Column) -> Column:
    return F.lit((1 << PLACE) - 1) - mark.bitwiseAND(F.lit((1 << PLACE) - 1))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _hashes(marks: str) -> Column:
    return F.array_distinct(F.transform(marks, mark_hash))


def _digest(marks: str) -> Column:
    return F.sha2(F.array_join(F.col(marks).cast("array<string>"), " "), 256)


def winnow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """id_col and marks: array<struct<hash bigint, place int>> of every whole text."""
    found = with_marks(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "_marks", gram, window)
    return found.select(id_col, F.transform("_marks", lambda m: F.struct(mark_hash(m).alias("hash"), mark_place(m).cast("int").alias("place"))).alias("marks"))


def with_next(docs: DataFrame, id_col: str, order: list[Column], carried: list[str], parts: int) -> DataFrame:
    """docs with next_<c> for each c of carried, from the row that follows by descending id; after the last comes the first.

    Ids are cut into parts ranges of about as many rows. The first row of each
    range also goes, as a guest, to the end of the range before it, so the
    windows need no row of another range. Rows with a null id come last; ties
    follow order.
    """
    cuts = docs.agg(F.percentile_approx(id_col, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    cut = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(id_col))) if cuts else F.lit(0)
    rows = docs.withColumn("_range", F.coalesce(cut, F.lit(0))).withColumn("_guest", F.lit(0))
    there = sorted((r[0] for r in rows.select("_range").distinct().collect()), reverse=True)  # parts at most
    if not there:
        return rows.select(*docs.columns, *[F.col(c).alias(f"next_{c}") for c in carried])
    to = {r: there[i - 1] for i, r in enumerate(there)}
    where = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])
    # the first of each range: its highest id is found by id alone, then its rows are ranked
    top = rows.groupBy("_range").agg(F.max(id_col).alias("_top"))
    firsts = rows.join(F.broadcast(top.withColumnRenamed("_range", "_r")), (F.col("_range") == F.col("_r")) & F.col(id_col).eqNullSafe(F.col("_top")))
    firsts = firsts.withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy(*order))).where("_n = 1").select(*docs.columns, where[F.col("_range")].alias("_range"), F.lit(1).alias("_guest"))
    at = W.partitionBy("_range").orderBy("_guest", F.col(id_col).desc_nulls_last(), *order)
    return rows.unionByName(firsts).select(*docs.columns, "_guest", *[F.lead(c).over(at).alias(f"next_{c}") for c in carried]).where("_guest = 0").drop("_guest")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    # only texts move; the marks of the next text are computed again where it arrives
    near = with_next(docs, "doc_id", [F.xxhash64("text")], ["text"], partitions(spark))
    n, cut = F.length("text"), F.floor(F.length("text") / 3)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut.cast("int")))
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    rows = with_marks(rows, "text", "marks").select("doc_id", "n_chars", "edited", "next_text", _digest("marks").alias("fingerprint"), _hashes("marks").alias("own"))
    rows = with_marks(rows, "next_text", "marks").select("doc_id", "n_chars", "edited", "fingerprint", "own", likeness(F.col("own"), _hashes("marks")).alias("near_next"))
    rows = with_marks(rows, "edited", "marks")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", _digest("marks").alias("edited_fingerprint"), likeness(F.col("own"), _hashes("marks")).alias("near_edited"), "near_next")


QUERIES = {"op1_winnowing": op1_winnowing}
