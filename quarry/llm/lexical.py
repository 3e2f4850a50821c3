"""Ranked lexical search: a whole query set against all documents, candidates cut by stored impacts and scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.chunks import slices
from quarry.llm.common import discard, read, text_or_empty, written
from quarry.llm.words import as_bytes, fold_table

TOP = 10
#: Bytes of item texts that are searched for at a time: what the driver and every task hold of the items is bounded by it.
BLOCK_BYTES = 4_000_000
#: Cells (documents times items) that a task scores at a time.
CELLS = 2_000_000

_WORD = fold_table()


def item_terms(text: bytes) -> list[bytes]:
    """The different terms of a text: runs of ASCII letters (lower-cased), digits and other characters than ASCII."""
    return list(dict.fromkeys(text.translate(_WORD).split()))


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n, terms, tfs of each document with a term: n counts all its terms, terms (ascending) and tfs those of vocabulary.

    row is this table's own key, so that documents that repeat an id stay apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                n, bounds, terms, tfs = [], [0], [], []
                for text in as_bytes(part.column("text")):
                    words = text.translate(_WORD).split()
                    n.append(len(words))
                    found = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                    terms += [t for t, _ in found]
                    tfs += [c for _, c in found]
                    bounds.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                out = pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), pa.array(n, pa.int64()), *lists], ["row", "id", "n", "terms", "tfs"])
                yield out.filter(pa.array(np.array(n) > 0))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, id long, n long, terms array<int>, tfs array<int>")


class Saturation:
    """(1000000000 * tf) div (1000 * tf + 8 * m) of postings, where m = 10 + (90 * n * N) div L: what a term's weight is multiplied by."""

    def __init__(self, documents: int, length: int):
        self.documents, self.length = documents, length

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document in the batch, term and factor of each posting, by document and term."""
        lists = batch.column("terms")
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), size)
        m = 10 + (90 * batch.column("n").to_numpy() * self.documents) // self.length
        tf = batch.column("tfs").flatten().to_numpy().astype(np.int64)
        return doc, lists.flatten().to_numpy().astype(np.int64), (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


def term_bounds(indexed: DataFrame, saturation: Saturation, top: int = TOP) -> DataFrame:
    """term, df, most, kth of each term: its documents, its largest factor and the top-th largest one (0 where it has fewer).

    Tasks count and keep the best of each term before they hand on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        count = np.zeros(0, dtype=np.int64)
        for batch in batches:
            _, term, factor = saturation(batch)
            if not len(term):
                continue
            if (size := int(term.max()) + 1) > len(count):
                count = np.r_[count, np.zeros(size - len(count), dtype=np.int64)]
            count[:size] += np.bincount(term, minlength=size)
            held_t, held_f = np.r_[held_t, term], np.r_[held_f, factor]
            order = np.lexsort((-held_f, held_t))
            held_t, held_f = held_t[order], held_f[order]
            start = np.flatnonzero(np.r_[True, held_t[1:] != held_t[:-1]])
            rank = np.arange(len(held_t)) - np.repeat(start, np.diff(np.r_[start, len(held_t)]))
            held_t, held_f = held_t[rank < top], held_f[rank < top]
        first = np.r_[True, held_t[1:] != held_t[:-1]] if len(held_t) else np.zeros(0, dtype=bool)
        yield pa.RecordBatch.from_arrays([pa.array(held_t), pa.array(held_f), pa.array(np.where(first, count[held_t] if len(count) else 0, 0))], ["term", "factor", "df"])

    best = written(indexed.select("n", "terms", "tfs").mapInArrow(run, "term long, factor long, df long"))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("factor")))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("term").agg(F.max("factor").alias("most"), F.coalesce(F.max(F.when(F.col("rank") == top, F.col("factor"))), F.lit(0)).alias("kth"))
    out = written(best.groupBy("term").agg(F.sum("df").alias("df")).join(ranked, "term"))
    discard(best)
    return out


class Plan:
    """The terms of a block of items with their bounds, and how a task searches with them.

    Of each item the terms lie by their largest impact, ascending, with the sums
    up to each: a document that holds only terms up to one scores at most that
    sum. With a floor under an item's kth score, terms whose sum stays below it
    bring no candidates.
    """

    def __init__(self, items: list[list[int]], weight: np.ndarray, most: np.ndarray, kth: np.ndarray, top: int):
        self.top, self.weight, n = top, weight, len(items)
        size = np.array([len(i) for i in items], dtype=np.int64)
        item, term = np.repeat(np.arange(n), size), np.fromiter((t for i in items for t in i), dtype=np.int64, count=int(size.sum()))
        order = np.lexsort((term, (weight * most)[term], item))
        self.item, self.term = item[order], term[order]
        self.start = np.r_[0, np.cumsum(size)]
        sums = np.cumsum(np.r_[0, (weight * most)[self.term]])
        self.sum = sums[1:] - sums[self.start[:-1]][self.item]
        #: the k documents with the largest impacts of one term score that much at least
        self.floor = np.zeros(n, dtype=np.int64)
        np.maximum.at(self.floor, self.item, (weight * kth)[self.term])
        self.by_term = np.argsort(self.term, kind="stable")

    def candidates(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and exact score of all that reach the floors; postings by document and term."""
        n, terms = len(self.start) - 1, len(self.weight)
        essential = self.sum >= floor[self.item]
        others = np.bincount(self.item[~essential], minlength=n)  # of each item the first ones
        rest = np.where(others > 0, self.sum[np.maximum(0, self.start[:-1] + others - 1)], 0)
        entry = self.by_term[essential[self.by_term]]
        at = np.searchsorted(self.term[entry], np.arange(terms + 1))
        partial = np.zeros(docs * n, dtype=np.int64)
        many = (at[1:] - at[:-1])[term]
        which = np.repeat(at[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        np.add.at(partial, np.repeat(doc * n, many) + self.item[entry[which]], np.repeat(impact, many))
        cell = np.flatnonzero(partial)
        score = partial[cell]
        d, i = np.divmod(cell, n)
        hopeful = score + rest[i] >= floor[i]
        d, i, score = d[hopeful], i[hopeful], score[hopeful]
        # the terms that brought no candidates count as well
        many = others[i]
        pair = np.repeat(np.arange(len(d)), many)
        t = self.term[np.repeat(self.start[i], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        key = doc * terms + term
        want = d[pair] * terms + t
        found = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        if len(key):
            np.add.at(score, pair, np.where(key[found] == want, impact[found], 0))
        good = (score >= floor[i]) & (score > 0)
        return d[good], i[good], score[good]

    def search(self, saturation: Saturation):
        """A function for mapInArrow over the index: of each partition, the best of each item."""
        n, step = len(self.start) - 1, max(1, CELLS // max(1, len(self.start) - 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor = self.floor.copy()
            held = [np.zeros(0, dtype=np.int64)] * 5  # item, score, id missing, id, row
            for whole in batches:
                for begin in range(0, whole.num_rows, step):
                    batch = whole.slice(begin, step)
                    doc, term, factor = saturation(batch)
                    d, i, score = self.candidates(doc, term, self.weight[term] * factor, batch.num_rows, floor)
                    if not len(d):
                        continue
                    ids = batch.column("id")
                    missing = ids.is_null().to_numpy(zero_copy_only=False)[d].astype(np.int64)
                    ids, row = ids.fill_null(0).to_numpy()[d], batch.column("row").to_numpy()[d]
                    held = [np.r_[a, b] for a, b in zip(held, (i, score, missing, ids, row))]
                    order = np.lexsort((held[4], held[3], held[2], -held[1], held[0]))
                    held = [h[order] for h in held]
                    start = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
                    rank = np.arange(len(held[0])) - np.repeat(start, np.diff(np.r_[start, len(held[0])]))
                    last = rank == self.top - 1
                    floor[held[0][last]] = np.maximum(floor[held[0][last]], held[1][last])  # what was found raises the floor
                    held = [h[rank < self.top] for h in held]
            item, score, missing, ids, row = held
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=missing.astype(bool)), pa.array(score), pa.array(row)], ["item", "id", "score", "row"])

        return run


def _block(docs: DataFrame, items: list[tuple], item_type: str, id_col: str, text_col: str, top: int) -> DataFrame | None:
    """The best documents of the items of a block, as a written table."""
    spark = docs.sparkSession
    texts = [item_terms((text or "").encode()) for _, text in items]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    indexed = written(index(docs, vocabulary, id_col, text_col))
    size = indexed.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    if not vocabulary or not size["documents"]:
        discard(indexed)
        return None
    saturation = Saturation(size["documents"], size["length"])
    df, most, kth = (np.zeros(len(vocabulary), dtype=np.int64) for _ in range(3))
    stored = term_bounds(indexed, saturation, top)
    for r in stored.collect():  # at most the block's terms
        df[r["term"]], most[r["term"]], kth[r["term"]] = r["df"], r["most"], r["kth"]
    weight = np.array([math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    plan = Plan([[vocabulary[w] for w in t] for t in texts], weight, most, kth, top)
    found = indexed.mapInArrow(plan.search(saturation), "item long, id long, score long, row long")
    best = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(items)], f"item long, item_id {item_type}")
    ranked = found.withColumn("rank", best).where(F.col("rank") <= top).join(F.broadcast(names), "item")  # a block's items
    out = written(ranked.select("item_id", "rank", F.col("id").alias(id_col), "score"))
    discard(stored)
    discard(indexed)
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_col, rank int, id_col long, score long: of each row of items the `top` documents with the highest scores above 0.

    Each row of docs is a document, each row of items an item, also where they
    repeat an id. A null text has no terms: such an item has no rows, such a
    document does not count. Of equal scores the smaller id comes first, a null
    id last. Items are dealt to blocks of about block_bytes of text; each block
    reads all documents once and their index twice.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    rows = written(items.select(F.col(item_col).alias("item"), text_or_empty(item_text).alias("text"), F.monotonically_increasing_id().alias("at")))
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = []
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == k).select("item", "text")
        block = [tuple(r) for r in part.collect()]  # about block_bytes
        one = _block(docs, block, kind, id_col, text_col, top) if block else None
        found += [one] if one is not None else []
    discard(rows)
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("item_id", item_col)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every item of benchmark."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    s AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
    c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM s),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY 1),
    x AS (SELECT item_id, r, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term), c GROUP BY 1, 2, 3)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": _SQL}
