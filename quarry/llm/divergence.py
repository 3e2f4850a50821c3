"""How far the words of sources lie apart: heavy terms in dense tiles, light ones by pairs of postings."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.chunks import slices
from quarry.llm.common import discard, read, text_or_empty, written
from quarry.llm.words import as_bytes, fold_table

#: A term is kept by a language if so many of its documents hold it.
LEAST_DOCUMENTS = 30
#: Added to each count; shares are in parts of SCALE.
PRIOR = 5
SCALE = 1_000_000_000
#: Ranks of the part `term`.
TOP = 50
#: Terms of a tile and sources of a block: a tile's matrix has at most so many cells for each of two blocks.
TILE_TERMS = 2048
BLOCK = 128
#: A term is heavy if at least this part of the language's sources hold it.
HEAVY = 1 / 4
#: Terms of all groups that a task counts before it hands them on.
HELD_TERMS = 400_000

_LETTERS = fold_table(digits=False)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n: occurrences of each term that at least `least` documents of its language hold.

    Terms are runs of ASCII letters, lower-cased, and of other characters than
    ASCII. Nulls in any of the three columns count as empty; each row is a
    document. Tasks count before they hand on, and what is left meets by
    language and term: a common term has a row for each source and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        within: dict[tuple, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in counts.items():
                if c:
                    n = len(c)
                    # both counters got the same terms, though not in the same order
                    documents = np.fromiter(map(within[lang, source].__getitem__, c), dtype=np.int64, count=n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, dtype=np.int32))), pa.array([source]).take(pa.array(np.zeros(n, dtype=np.int32))), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(np.fromiter(c.values(), dtype=np.int64, count=n)), pa.array(documents)], ["lang", "source", "term", "n", "documents"])
            counts.clear()
            within.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), as_bytes(part.column("text"))):
                    terms = text.translate(_LETTERS).split()
                    counts[lang, source].update(terms)
                    within[lang, source].update(set(terms))
                if sum(map(len, counts.values())) > HELD_TERMS:
                    yield from out()
        yield from out()

    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    rows = rows.mapInArrow(run, "lang string, source string, term string, n long, documents long").repartition("lang", "term")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))  # where the rows lie
    return rows.withColumn("all", F.sum("documents").over(W.partitionBy("lang", "term"))).where(F.col("all") >= least).select("lang", "source", "term", "n")


def share(count: Column, total: Column, kept: Column, prior: int = PRIOR) -> Column:
    """1 + floor(SCALE * (count + prior) / (total + prior * kept)), exact up to counts of 9e13; 0 without terms."""
    x, m = F.lit(100_000) * (count + prior), F.nullif(total + prior * kept, F.lit(0))
    step = F.lit(SCALE // 100_000)
    return F.coalesce(1 + step * _div(x, m) + _div(step * (x % m), m), F.lit(0)).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _tile(rows: pa.Table) -> pa.Table:
    """Of two blocks of sources and a tile of terms: the sums of |p - q| for each pair of sources, a of the lower block.

    rows: lang, low, high, term (null: a source's own row), block, at (the
    source's number), p (in its own row: its share of a term it lacks), heavy,
    size (in a source's own row: the kept terms of the tile, held here or not).
    """
    lang, low, high = (rows.column(c)[0].as_py() for c in ("lang", "low", "high"))
    of = {c: rows.column(c).to_numpy() for c in ("block", "at", "p", "heavy")}
    is_source = rows.column("term").is_null().to_numpy()
    at = np.unique(of["at"][is_source])
    zero = np.zeros(len(at), dtype=np.int64)
    zero[np.searchsorted(at, of["at"][is_source])] = of["p"][is_source]
    block = np.zeros(len(at), dtype=np.int64)
    block[np.searchsorted(at, of["at"][is_source])] = of["block"][is_source]
    posting = ~is_source
    terms, term = np.unique(rows.column("term").filter(pa.array(posting)).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
    source, p, heavy = np.searchsorted(at, of["at"][posting]), of["p"][posting].astype(np.int64), of["heavy"][posting].astype(bool)
    total = np.zeros((len(at), len(at)), dtype=np.int64)
    # heavy: a row for each source, with its share of every heavy term of the tile
    _, column = np.unique(term[heavy], return_inverse=True)
    dense = np.repeat(zero[:, None], column.max() + 1 if len(column) else 0, axis=1)
    dense[source[heavy], column] = p[heavy]
    for i in range(len(at)):
        total[i] += np.abs(dense - dense[i]).sum(axis=1)
    # light, and what only sources of other blocks hold: as if no source had any, then what changes for each posting, then for each pair of postings of a term
    light = ~heavy
    lt, ls, lp = term[light], source[light], p[light]
    apart = np.abs(zero[:, None] - zero)
    total += (int(rows.column("size").to_numpy()[is_source][0]) - dense.shape[1]) * apart
    if len(lt):
        order = np.argsort(ls, kind="stable")
        s, q = ls[order], lp[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        change = np.zeros_like(total)
        for j in range(len(at)):
            change[s[first], j] = np.add.reduceat(np.abs(q - zero[j]) - apart[s, j], first)
        total += change + change.T
        order = np.lexsort((ls, lt))
        t, s, q = lt[order], ls[order], lp[order]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        after = np.repeat(np.r_[start[1:], len(t)], np.diff(np.r_[start, len(t)])) - np.arange(len(t)) - 1
        step = 1
        while (left := np.flatnonzero(after >= step)).size:  # each posting with the one `step` further on: fewer than the light share of sources
            a, b = s[left], s[left + step]
            x, y = q[left], q[left + step]
            more = np.abs(x - y) - np.abs(x - zero[b]) - np.abs(zero[a] - y) + apart[a, b]
            np.add.at(total, (a, b), more)
            np.add.at(total, (b, a), more)
            step += 1
    a, b = np.nonzero((block[:, None] == low) & (block == high) & (at[:, None] != at))
    return pa.table({"lang": pa.array([lang]).take(pa.array(np.zeros(len(a), dtype=np.int32))), "a": at[a], "b": at[b], "value": total[a, b]})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP, prior: int = PRIOR) -> DataFrame:
    """lang, source, part, item, value long, rank int: see term_counts() for the terms.

    Part `pair`: for each source of a language and each other one, the sum over
    all kept terms of what their shares differ by. Part `term`: the `top` terms
    that a source holds and has more of than the language, with the difference.
    A share is 1 + floor(SCALE * (n + prior) / (N + prior * V)) of a source's n
    occurrences, N those of all V kept terms. Sources without terms take part;
    without kept terms all differences are 0. No documents, no rows.
    """
    rows = docs.select(text_or_empty(lang_col).alias("lang"), text_or_empty(source_col).alias("source"), text_or_empty(text_col).alias("text"))
    kept = written(term_counts(rows, least=least))
    terms = written(kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("holders")))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    sources = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sources = sources.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "v")], number.cast("long").alias("at"), F.count(F.lit(1)).over(W.partitionBy("lang")).alias("sources"))
    zero = share(F.lit(0).cast("long"), F.col("total"), F.col("v"), prior)
    tiles, blocks = F.greatest(F.ceil(F.col("v") / TILE_TERMS), F.lit(1)), F.ceil(F.col("sources") / BLOCK)
    sources = written(sources.withColumns({"zero": zero, "tiles": tiles, "blocks": blocks, "block": F.floor(F.col("at") / BLOCK)}))
    each = kept.join(sources, ["lang", "source"]).join(terms, ["lang", "term"])
    each = each.withColumns({"p": share(F.col("n"), F.col("total"), F.col("v"), prior), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("v"), prior)})

    with_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    columns = ["lang", "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term", "block", "at", "p", "heavy", "size"]
    tile = F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile")
    postings = each.select("*", tile, with_block.alias("other"), (F.col("holders") >= F.col("sources") * HEAVY).alias("heavy"), F.lit(0).cast("long").alias("size")).select(*columns)
    sizes = terms.join(langs.select("lang", F.ceil(F.col("v") / TILE_TERMS).alias("tiles")), "lang").groupBy("lang", tile).agg(F.count(F.lit(1)).alias("size"))
    own = sources.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")).join(sizes, ["lang", "tile"], "left")
    own = own.select("lang", "tile", "block", "at", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), F.lit(False).alias("heavy"), F.coalesce("size", F.lit(0)).alias("size"), with_block.alias("other")).select(*columns)
    parts = postings.unionByName(own).groupBy("lang", "tile", "low", "high").applyInArrow(_tile, "lang string, a long, b long, value long")
    # a pair within a block comes in both orders, one of two blocks in the order of the blocks
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    size = F.floor(F.col("a") / BLOCK) < F.floor(F.col("b") / BLOCK)
    ends = F.explode(F.when(size, F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b"))))
    names = sources.select("lang", "at", "source")
    pairs = sums.select("lang", "value", ends.alias("e")).select("lang", "value", F.col("e.a").alias("at"), F.col("e.b").alias("to"))
    pairs = pairs.join(names, ["lang", "at"]).join(names.select("lang", F.col("at").alias("to"), F.col("source").alias("item")), ["lang", "to"])
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    above = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", rank).where(F.col("rank") <= top)
    out = written(pairs.unionByName(above))
    for table in (kept, terms, sources):
        discard(table)
    return out


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language of documents against the others, and the terms that set it apart."""
    return divergence(read(spark, sf_dir, "documents"))


_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
    l AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM k GROUP BY 1),
    g AS (SELECT DISTINCT lang, source FROM d),
    o AS (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY 1, 2, 3),
    z AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM o GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + 1000000000 * (coalesce(o.c, 0) + 5) // (coalesce(z.n, 0) + 5 * l.v) AS p, 1 + 1000000000 * (k.c + 5) // (l.n + 5 * l.v) AS q
        FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN z ON z.lang = g.lang AND z.source = g.source LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
    a AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
    b AS (SELECT x.lang, x.source, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source)
    SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM b
    UNION ALL SELECT lang, source, 'term', term, p - q, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank FROM p WHERE c > 0 AND p > q QUALIFY rank <= 50"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": _SQL}
