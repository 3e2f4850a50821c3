"""Language-model scores by prediction by partial matching over bytes: of whole texts, or of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chunks import slices
from quarry.llm.common import discard, read, settle, text_or_empty, written

#: Longest context in symbols; the start of a word counts as one.
ORDER = 5
#: Symbols: bytes 0 to 255, and 256 for the end of a word (in a context: its start).
EDGE, SYMBOLS, BITS = 256, 257, 9
#: Bytes of text of a bucket of documents, and words of a bucket of the vocabulary, about.
BUCKET_BYTES, BUCKET_WORDS = 12_000_000, 100_000
#: Last symbols of a context by which contexts are dealt to groups, and bytes of text for each group. Tables of shorter contexts go to every task.
NEAR, GROUP_BYTES = 3, 8_000_000
#: Bytes of text whose symbols are held at a time: some 100 bytes of numbers for each.
AT_A_TIME = 1_000_000


def _plain(texts: pa.Array) -> pa.Array:
    """A to Z lower-cased, and words joined by one blank."""
    texts = pc.ascii_lower(texts)
    for blank in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, blank, " ")
    bounds, words = _words(texts)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")


def _with_plain(table: pa.Table) -> pa.Table:
    at = table.schema.get_field_index("text")
    return table.set_column(at, "text", pa.chunked_array([_plain(c) for c in table.column(at).chunks], pa.string()))


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each text's words, and the words."""
    lists = pc.split_pattern(texts, " ")
    there = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(there)])[lists.offsets.to_numpy()], lists.values.filter(pa.array(there))


def _pieces(table: pa.Table, step: int = 512) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=step)


def keys(words: pa.Array, order: int = ORDER) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each word (a word's bytes, then its end) the place of its last symbol + 1, and for each order the keys of all symbols.

    A key holds the order, the context and the symbol; it is -1 where the word
    has begun too late for a context of that order.
    """
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8).astype(np.int64)
    end = np.cumsum(size + 1)
    symbol = np.insert(data, np.cumsum(size), EDGE)  # an end after each word
    at = np.arange(len(symbol)) - np.repeat(end - size - 1, size + 1)
    out, context = [symbol], np.zeros(len(symbol), dtype=np.int64)
    for k in range(1, order + 1):
        before = np.r_[np.full(min(k, len(symbol)), EDGE), symbol[: max(0, len(symbol) - k)]]  # before a word stands an end
        context = context | before << BITS * (k - 1)
        out.append(np.where(at + 1 >= k, (np.int64(k) << BITS * (order + 1)) | context << BITS | symbol, -1))
    return end, out


def _counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


def trie(vocabulary: DataFrame, order: int = ORDER) -> DataFrame:
    """Edges of the context trie: key, n. vocabulary: word, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            end, found = keys(batch.column("word"), order)
            n = np.repeat(batch.column("c").to_numpy(), np.diff(np.r_[0, end]))
            key = np.concatenate(found)
            held.append([key[key >= 0], np.tile(n, order + 1)[key >= 0]])
            if len(held) >= 8:
                held = [list(_counted(*(np.concatenate([h[i] for h in held]) for i in (0, 1))))]
                if len(held[0][0]) > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["key", "n"])
                    held = []
        if held:
            key, n = _counted(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return vocabulary.where("c > 0").select("word", "c").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _level(key: Column, order: int) -> Column:
    return F.shiftright(key, BITS * (order + 1))


def _cut(key: Column, to: int, order: int) -> Column:
    """key with its context cut to its last symbols, to of them."""
    return key.bitwiseAND(F.lit((1 << BITS * (to + 1)) - 1)) + F.lit(to << BITS * (order + 1))


def code_lengths(queries: DataFrame, edges: DataFrame, order: int = ORDER) -> DataFrame:
    """key and lp, the log10 probability of each key's symbol after its context.

    The longest known context gives its symbols n / (T + D), T being the count of
    all and D the number of different ones, and the escape the rest. A shorter
    context then leaves out what the longer one had seen (symbol exclusion); it
    has seen all of that, too. After the empty context the rest of the symbols
    is equally likely.
    """
    context = F.shiftright("key", BITS)
    level = _level(F.col("key"), order)
    # what a context's symbols count in the next shorter context
    upper = edges.select("key", F.coalesce(*[F.when(level == k, _cut(F.col("key"), k - 1, order)) for k in range(1, order + 1)]).alias("short")).where("short is not null")
    taken = upper.join(edges.select(F.col("key").alias("short"), F.col("n").alias("m")), "short").groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("m").alias("x"))
    nodes = edges.groupBy(context.alias("context")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).join(taken, "context", "left")
    cuts = F.array(*[F.when(level >= k, _cut(F.col("key"), k, order)) for k in range(order + 1)])
    chain = queries.select("key", F.explode(cuts).alias("k")).where("k is not null").withColumn("context", F.shiftright("k", BITS))
    met = chain.join(nodes, "context").join(edges.withColumnRenamed("key", "k"), "k", "left").groupBy("key").agg(F.collect_list(F.struct((-_level(F.col("k"), order)).alias("level"), "n", "t", "d", "x")).alias("levels"))
    zero = F.struct(F.lit(0.0).alias("lp"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("d"), F.lit(False).alias("done"))

    def fold(s: Column, e: Column) -> Column:
        d = e["d"] - s["d"]
        total = (e["t"] - s["x"] + d).cast("double")
        lp = F.when(s["done"], s["lp"]).when(e["n"].isNotNull(), s["lp"] + F.log10(e["n"] / total)).when(d > 0, s["lp"] + F.log10(d / total)).otherwise(s["lp"])
        return F.struct(lp.alias("lp"), F.when(s["done"], s["x"]).otherwise(F.coalesce(e["x"], F.lit(0))).alias("x"), F.when(s["done"], s["d"]).otherwise(e["d"]).alias("d"), (s["done"] | e["n"].isNotNull()).alias("done"))

    last = lambda s: F.when(s["done"], s["lp"]).otherwise(s["lp"] - F.log10((SYMBOLS - s["d"]).cast("double")))
    known = met.select("key", F.aggregate(F.array_sort("levels"), zero, fold, last).alias("lp"))
    return queries.join(known, "key", "left").select("key", F.coalesce("lp", F.lit(-float(np.log10(SYMBOLS)))).alias("lp"))


def word_scores(vocabulary: DataFrame, order: int = ORDER) -> DataFrame:
    """word, c and lp: the log10 probability of each word, its end included, under the trie of the words with c > 0.

    vocabulary: word and c, a written table; the word '' is the end of a text.
    """
    spark = vocabulary.sparkSession
    edges = written(trie(vocabulary, order))
    many = max(1, vocabulary.count() // BUCKET_WORDS)
    bucketed = vocabulary.withColumn("vb", F.pmod(F.xxhash64("word"), F.lit(many)).cast("int"))

    def longest(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        end, found = keys(words, order)
        key = found[0]
        for k in found[1:]:
            key = np.where(k >= 0, k, key)
        return end, key

    def asked(table: pa.Table) -> pa.Table:
        found = [np.unique(longest(b.column("word"))[1]) for b in _pieces(table, 20_000)]
        key = np.unique(np.concatenate(found))
        return pa.table({"vb": pa.array(np.full(len(key), table.column("vb")[0].as_py(), dtype=np.int32)), "key": pa.array(key)})

    queries = written(bucketed.groupBy("vb").applyInArrow(asked, "vb int, key long"))
    scored = written(code_lengths(queries.select("key").distinct(), edges, order))
    settle(spark)

    def summed(words: pa.Table, values: pa.Table) -> pa.Table:
        by = np.argsort(key := values.column("key").to_numpy())
        key, lp = key[by], values.column("lp").to_numpy()[by]
        out = [lp[:0]]
        for b in _pieces(words, 20_000):
            end, ask = longest(b.column("word"))
            total = np.r_[0.0, np.cumsum(lp[np.searchsorted(key, ask)])][np.r_[0, end]]
            out.append(np.diff(total))
        return pa.table({"word": words.column("word"), "c": words.column("c"), "lp": pa.array(np.concatenate(out))})

    values = queries.join(scored, "key").select("vb", "key", "lp")
    out = written(bucketed.groupBy("vb").cogroup(values.groupBy("vb")).applyInArrow(summed, "word string, c long, lp double"))
    for t in (edges, queries, scored):
        discard(t)
    return out


def longest_keys(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each text (its bytes, then its end) the place of its first symbol, and of each symbol the key with its longest context.

    A context reaches back over words, up to the start of the text, which is a symbol.
    """
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), dtype=np.uint8).astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    symbol = np.insert(data, np.cumsum(size), EDGE)  # an end after each text
    left = np.arange(1, len(symbol) + 1) - np.repeat(start, size + 1)  # symbols before, the start included
    padded = np.r_[np.full(order, EDGE), symbol]
    key = symbol | np.minimum(left, order) << BITS * (order + 1)
    for k in range(1, order + 1):
        key |= np.where(left >= k, padded[order - k : len(padded) - k], 0) << BITS * k
    return start, key


def _shorter(key: np.ndarray, to: int, order: int) -> np.ndarray:
    return key & ((1 << BITS * (to + 1)) - 1) | to << BITS * (order + 1)


def _level_of(key: np.ndarray, n: np.ndarray, to: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of contexts of to symbols, and their counts, from longest keys."""
    some = (n > 0) & (key >> BITS * (order + 1) >= to)
    return _counted(_shorter(key[some], to, order), n[some])


def _find(sorted_: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of want in sorted_, and whether they are there."""
    if not len(sorted_):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)
    return at, sorted_[at] == want


def key_scores(key: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> np.ndarray:
    """The log10 probability of each longest key's symbol: the rule of code_lengths(). levels: edges and counts, by length of context."""
    lp, x, d, done = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key), bool)
    for k in range(order, -1, -1):
        edge, n = levels[k]
        if not len(edge):
            continue
        context, of, sizes = np.unique(edge >> BITS, return_inverse=True, return_counts=True)
        taken = np.zeros(len(edge))
        if k:
            at, there = _find(levels[k - 1][0], _shorter(edge, k - 1, order))
            taken = levels[k - 1][1][at] * there
        t, seen = np.bincount(of, n), np.bincount(of, taken)
        here = np.flatnonzero(~done & (key >> BITS * (order + 1) >= k))
        asked = _shorter(key[here], k, order)
        at, known = _find(context, asked >> BITS)
        here, asked, at = here[known], asked[known], at[known]
        place, hit = _find(edge, asked)
        new = sizes[at] - d[here]
        total = t[at] - x[here] + new
        part = np.where(hit, n[place], new)
        lp[here] += np.where(part > 0, np.log10(np.maximum(part, 1) / np.maximum(total, 1)), 0.0)
        x[here], d[here], done[here] = seen[at], sizes[at], hit
    return np.where(done, lp, lp - np.log10(SYMBOLS - d))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, across: bool = False) -> DataFrame:
    """Scores of every whole text by a model of the texts for which learn holds.

    With across the model is one of whole texts: words joined by one blank, each
    byte and the end under the bytes before it, over word ends. Else it is one of
    words, each by itself, and their order counts for nothing.

    Returns id_col, n_tokens, n_known, train_tokens long, base_score, score
    double. A text is its words, A to Z lower-cased, and an end; score is the
    log10 probability that prediction by partial matching gives it, base_score
    the one of add-one counts of words. Null texts are empty: only the end.
    Where learn is null a text is not learned. Repeated rows are scored each.

    No vocabulary is held whole: buckets of documents ask for their distinct
    words, the answers are joined by word, and go back to the bucket.
    """
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_or_empty(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    many = max(1, size // BUCKET_BYTES)
    groups, near = max(1, size // GROUP_BYTES), min(NEAR, order)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", F.length("text")), F.lit(many)).cast("int"))

    def distinct(table: pa.Table) -> pa.Table:
        table, parts = _with_plain(table), []
        for b in _pieces(table.select(["learn", "text"])):
            bounds, words = _words(b.column("text"))
            of = np.repeat(b.column("learn").to_numpy(zero_copy_only=False), np.diff(bounds)).astype(np.int64)
            coded = words.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            parts.append(pa.table({"word": coded.dictionary, "c": pa.array(np.bincount(code, of, len(coded.dictionary)).astype(np.int64))}))
        parts.append(pa.table({"word": pa.array([""]), "c": pa.array([pc.sum(pc.cast(table.column("learn"), pa.int64())).as_py()], pa.int64())}))
        all_ = pa.concat_tables(parts).group_by("word").aggregate([("c", "sum")])
        found = pa.table({"word": all_.column("word"), "c": all_.column("c_sum")})
        if across:
            found = pa.concat_tables([found, symbols(table)], promote_options="default")
        else:
            found = pa.concat_tables([found, packed.empty_table()], promote_options="default")
        return found.add_column(0, "bucket", pa.array(np.full(len(found), table.column("bucket")[0].as_py(), dtype=np.int32)))

    packed = pa.schema([("g", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def bucket_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bucket's longest keys in order, their counts in learned texts, and their places by group of contexts, with the bounds of the groups."""
        key, n = [], []
        for b in _pieces(table.select(["learn", "text"])):
            for part in slices(b, "text", AT_A_TIME):
                start, ask = longest_keys(part.column("text"), order)
                coded = pa.array(ask).dictionary_encode()
                learned = np.repeat(part.column("learn").to_numpy(zero_copy_only=False), np.diff(np.r_[start, len(ask)])).astype(np.int8)
                key.append(coded.dictionary.to_numpy())
                n.append(np.bincount(coded.indices.to_numpy(), learned, len(coded.dictionary)).astype(np.int64))
        key, n = _counted(np.concatenate(key), np.concatenate(n))
        g = (((key >> BITS & (1 << BITS * near) - 1) * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % groups
        by = np.argsort(g, kind="stable")
        return key, n, by, np.searchsorted(g[by], np.arange(groups + 1))

    def symbols(table: pa.Table) -> pa.Table:
        """A row for each group of contexts, and one (-1) of short contexts' edges. Counts of a bucket fit in 32 bits."""
        key, n, by, cut = bucket_keys(table)
        low = [_level_of(key, n, k, order) for k in range(near)]
        rows_ = [(-1, np.concatenate([k for k, _ in low]), np.concatenate([c for _, c in low]))] + [(i, key[by[p:q]], n[by[p:q]]) for i, (p, q) in enumerate(zip(cut, cut[1:])) if p < q]
        return pa.table({"g": [i for i, _, _ in rows_], "keys": [k.tobytes() for _, k, _ in rows_], "n": [c.astype(np.int32).tobytes() for _, _, c in rows_]}, schema=packed)

    asked = written(rows.groupBy("bucket").applyInArrow(distinct, "bucket int, word string, c long, g int, keys binary, n binary"))
    asked_words, asked_keys = asked.where("word is not null"), asked.where("g >= 0").select("bucket", "g", "keys", "n")
    settle(spark)
    vocabulary = written(asked_words.groupBy("word").agg(F.sum("c").alias("c")))
    settle(spark)
    totals = vocabulary.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    n_all, n_words = totals[0] or 0, totals[1]
    words = vocabulary.withColumn("lp", F.lit(0.0)) if across else word_scores(vocabulary, order)
    settle(spark)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int32).astype(np.int64))], ["key", "n"])

    def short_levels() -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges of contexts shorter than near: as many as there are different byte sequences of near bytes."""
        found = asked.where("g = -1").select("keys", "n").mapInArrow(unpacked, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        key, n = (found.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
        return [(key[at], n[at]) for at in (key >> BITS * (order + 1) == k for k in range(near))]

    def answered() -> DataFrame:
        short = spark.sparkContext.broadcast(short_levels())

        def answer(table: pa.Table) -> pa.Table:
            buckets, gs, keys_, ns = (table.column(c).to_pylist() for c in ("bucket", "g", "keys", "n"))
            keys_ = [np.frombuffer(k, np.int64) for k in keys_]
            key, n = _counted(np.concatenate(keys_), np.concatenate([np.frombuffer(c, np.int32) for c in ns]).astype(np.int64))
            lp = key_scores(key, short.value + [_level_of(key, n, k, order) for k in range(near, order + 1)], order)
            # a bucket knows its keys; the 7 figures of 32 bits are enough for logarithms of single bytes
            return pa.table({"bucket": pa.array(buckets, pa.int32()), "g": pa.array(gs, pa.int32()), "lps": pa.array([lp[np.searchsorted(key, k)].astype(np.float32).tobytes() for k in keys_], pa.binary())})

        return written(asked_keys.groupBy("g").applyInArrow(answer, "bucket int, g int, lps binary"))

    def finish(docs_: pa.Table, values: pa.Table) -> pa.Table:
        docs_ = _with_plain(docs_)
        replies = values.filter(pc.is_valid(values.column("g")))
        values = values.filter(pc.is_valid(values.column("word"))).combine_chunks()
        if across:
            key, _, by, cut = bucket_keys(docs_)
            key_lp = np.empty(len(key))
            for g, lps in zip(replies.column("g").to_pylist(), replies.column("lps").to_pylist()):
                key_lp[by[cut[g] : cut[g + 1]]] = np.frombuffer(lps, np.float32)
            del by, cut
        del replies

        def sequence(texts: pa.Array) -> np.ndarray:
            start, ask = longest_keys(texts, order)
            coded = pa.array(ask).dictionary_encode()
            return np.add.reduceat(key_lp[np.searchsorted(key, coded.dictionary.to_numpy())][coded.indices.to_numpy()], start)

        known_words = values.column("word").combine_chunks() if len(values) else pa.array([], pa.string())
        c, lp = values.column("c").to_numpy(), values.column("lp").to_numpy()
        base = np.log10((c + 1) / (n_all + n_words + 1))
        end = pc.index_in(pa.scalar(""), value_set=known_words).as_py() if len(values) else None
        out = []
        for b in _pieces(docs_.select(["id", "text"])):
            bounds, found = _words(b.column("text"))
            at = pc.index_in(found, value_set=known_words).to_numpy(zero_copy_only=False)
            n = np.diff(bounds)
            total = lambda x, at=at, bounds=bounds: np.diff(np.r_[0, np.cumsum(x[at])][bounds]) + x[end]
            out.append(pa.table({"id": b.column("id"), "n_tokens": pa.array(n + 1), "n_known": pa.array(total((c > 0).astype(np.int64))), "base_score": pa.array(total(base)), "score": pa.array(np.concatenate([sequence(p.column("text")) for p in slices(b, "text", AT_A_TIME)]) if across else total(lp))}))
        return pa.concat_tables(out)

    values = written(asked_words.select("bucket", "word").join(words, "word").select("bucket", "word", "c", "lp"))
    replies = answered() if across else None
    for t in (asked, vocabulary) if across else (asked, vocabulary, words):
        discard(t)
    settle(spark)
    values = values.withColumns({"g": F.lit(None).cast("int"), "lps": F.lit(None).cast("binary")})
    if across:
        values = values.unionByName(replies, allowMissingColumns=True)
    out = rows.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(finish, f"id {id_kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def op8_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 of the id mod 7 is not 2."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = score(read(spark, sf_dir, "documents"), ~held, across=True)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_ppm_score": op8_ppm_score}
