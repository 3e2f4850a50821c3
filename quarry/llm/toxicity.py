"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.chunks import text_slices
from quarry.llm.common import lower_ascii, read, text_or_empty

#: Documents of each class that the model is fitted on, at most, with their whole texts; all others are scored only.
DOCS_PER_CLASS = 1200
#: Rows of the table of subword vectors, and the numbers in each.
BUCKETS, WIDTH = 1 << 17, 4
#: Characters of a subword; words of a bag, of which the next one begins half a bag further on.
GRAMS, BAG = (3, 5), 12
#: Documents that a subword must be in to be learned.
MIN_SEEN = 8
#: Steps and rate over all bags; rounds, steps and rate over the highest bags; those of a document that is not toxic.
FIRST, ROUNDS, LATER, HARD = (40, 0.05), 12, (4, 0.03), 3
#: Pull of all vectors towards zero, so that a subword of few documents counts little.
DECAY, SEED = 3e-5, 7

_WORD = re.compile(r"\w+")
_REMEMBERED = 200_000


def subwords(word: str) -> list[int]:
    """Buckets of a word: the word in angle brackets and its runs of 3 to 5 characters."""
    full = f"<{word}>"
    found = [zlib.crc32(full.encode()) % BUCKETS]
    for n in range(GRAMS[0], GRAMS[1] + 1):
        found += [zlib.crc32(full[i : i + n].encode()) % BUCKETS for i in range(len(full) - n + 1)]
    return found


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many words each text has, codes of all words one after the other, and the words."""
    code: dict[str, int] = {}
    found = [np.fromiter((code.setdefault(w, len(code)) for w in _WORD.findall(t)), dtype=np.int32) for t in texts]
    return np.array([len(f) for f in found], dtype=np.int64), np.concatenate([*found, np.zeros(0, np.int32)]), list(code)


def _bags(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n words: the document of each bag, and where the bag's words begin and end.

    Bags overlap by half, so BAG / 2 + 1 words in a row are in one bag together
    wherever they stand. A text has one bag at least.
    """
    half = BAG // 2
    bags = np.maximum(1, -(-n // half) - 1)
    doc = np.repeat(np.arange(len(n)), bags)
    low = (np.arange(len(doc)) - np.repeat(np.cumsum(bags) - bags, bags)) * half
    base = np.repeat(np.cumsum(n) - n, bags)
    return doc, base + low, base + np.minimum(low + BAG, n[doc])


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after the other."""
    n = high - low
    return np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n numbers of x each, one range after the other; empty ranges give 0."""
    return np.diff(np.r_[0.0, np.cumsum(x, dtype=np.float64)][np.r_[0, np.cumsum(n)]])


class Model:
    """What scoring needs: since the softmax is linear, a number for each bucket, and one to add."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias


class _Trainer:
    """Subword vectors and softmax in training, over the bags of all documents."""

    def __init__(self, texts: list[str], y: np.ndarray, seed: int):
        n, self.words, vocabulary = _coded(texts)
        self.doc, self.low, self.high = _bags(n)
        word_doc = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(vocabulary)) + self.words)
        docs_of_word = np.bincount(word_doc % max(1, len(vocabulary)), minlength=len(vocabulary))
        grams = [np.array(subwords(w), dtype=np.int32) for w in vocabulary]
        self.size = np.array([len(g) for g in grams], dtype=np.int64)
        bucket = np.concatenate(grams)
        seen = np.bincount(bucket, np.repeat(docs_of_word, self.size), BUCKETS)
        self.used = np.flatnonzero(seen >= MIN_SEEN)  # a subword of fewer documents tells nothing; its vector is zero
        code = np.full(BUCKETS, -1, dtype=np.int32)
        code[self.used] = np.arange(len(self.used))
        keep = code[bucket] >= 0
        self.known = _sums(keep, self.size).astype(np.int64)  # subwords of each word that are learned
        self.gram = code[bucket[keep]]
        self.first = np.cumsum(self.known) - self.known
        self.weight = np.where(y > 0, 0.4 / y.sum(), 0.6 / (len(y) - y.sum()))
        self.y = y
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (WIDTH, len(self.used)))
        self.soft = rng.normal(0, 0.5, (WIDTH, 2))
        self.bias = np.zeros(2)

    def logits(self) -> np.ndarray:
        """Of every bag, for label 1 against 0."""
        slope = (self.soft[:, 1] - self.soft[:, 0]) @ self.table
        of_word = _sums(slope[self.gram], self.known) / self.size
        total = np.r_[0.0, np.cumsum(of_word[self.words])]
        return (total[self.high] - total[self.low]) / np.maximum(1, self.high - self.low) + self.bias[1] - self.bias[0]

    def steps(self, bags: np.ndarray, many: int, rate: float) -> None:
        """Gradient steps (Adam) over some bags; the bags of a document share its weight."""
        n = self.high[bags] - self.low[bags]
        words, at = np.unique(self.words[_spread(self.low[bags], self.high[bags])], return_inverse=True)
        known, size = self.known[words], self.size[words]
        rows, gram = np.unique(self.gram[_spread(self.first[words], self.first[words] + known)], return_inverse=True)
        by = np.argsort(gram, kind="stable").astype(np.int32)
        gram, gram_word, uses = gram.astype(np.int32), np.repeat(np.arange(len(words), dtype=np.int32), known)[by], np.bincount(gram, minlength=len(rows))
        many_words = np.maximum(1, n)
        weight = (self.weight / np.maximum(1, np.bincount(self.doc[bags], minlength=len(self.y))))[self.doc[bags]]
        y = self.y[self.doc[bags]]
        table = self.table[:, rows]
        params = (table, self.soft, self.bias)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        for step in range(1, many + 1):
            bag = np.stack([_sums((_sums(t[gram], known) / size)[at], n) / many_words for t in table], axis=1)
            logit = bag @ self.soft + self.bias
            p = 1 / (1 + np.exp(np.clip(logit[:, 0] - logit[:, 1], -500, 500)))
            slope = (weight * (p - y))[:, None] * np.array([-1.0, 1.0])
            of_bag = (slope @ self.soft.T).T / many_words
            of_word = [np.bincount(at, np.repeat(g, n), len(words)) / size for g in of_bag]
            grads = (np.stack([_sums(g[gram_word], uses) for g in of_word]) + DECAY * table, bag.T @ slope + 1e-4 * self.soft, slope.sum(axis=0))
            for p_, g, m in zip(params, grads, moments):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                p_ -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
        self.table[:, rows] = table


def fit(texts: list[str], labels: list[int], seed: int = SEED) -> Model:
    """Subword vectors and the softmax over the mean of a bag's word vectors, trained together.

    A label holds for a document; which of its bags shows it is not known. The
    first steps take the label for all bags; after that a document stands for
    the bags that score highest: one of a toxic document, HARD of another. Without
    labels of both classes the model scores every text by the share of label 1.
    """
    y = np.asarray(labels, dtype=np.float64)
    share = float((y.sum() + 0.5) / (len(y) + 2))
    if len(set(labels)) < 2 or not any(map(_WORD.search, texts)):
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share))))
    made = _Trainer(texts, y, seed)
    first = np.flatnonzero(np.r_[True, np.diff(made.doc) > 0])
    within = np.arange(len(made.doc)) - first[made.doc]
    made.steps(np.flatnonzero(within % 2 == 0), *FIRST)  # every second bag: no word counts twice
    for _ in range(ROUNDS):
        order = np.lexsort((-made.logits(), made.doc))
        rank = np.arange(len(order)) - first[made.doc[order]]
        made.steps(order[rank < np.where(y[made.doc[order]] > 0, 1, HARD)], *LATER)
    value = np.zeros(BUCKETS, dtype=np.float32)
    value[made.used] = (made.soft[:, 1] - made.soft[:, 0]) @ made.table
    return Model(value, float(made.bias[1] - made.bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS, fold_out: int | None = 0) -> DataFrame:
    """Labelled texts: of each class at most per_class documents, those with the smallest hash of the id.

    fold_out leaves out the ids whose crc32 as text has that remainder by 5.
    Null labels are no labels; a document with labels of both classes counts as
    toxic. Rows that repeat an id are one document each.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if fold_out is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != fold_out)
    known = known.withColumn("mix", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("mix", "doc_id").limit(per_class).unionByName(known.where("toxic = 0").orderBy("mix", "doc_id").limit(per_class))
    # at most twice per_class ids
    return docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")


def train(docs: DataFrame, labels: DataFrame, per_class: int = DOCS_PER_CLASS) -> Model:
    """The model of a bounded sample of the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    rows = sorted(training_rows(docs, labels, per_class).select("doc_id", lower_ascii(F.col("text")), "toxic").collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def scorer(model: Model, spark: SparkSession):
    """A function of a column of texts: the probability of label 1, that of the bag that is likeliest to show it.

    Whole texts are scored, and only they go to Python and only scores come back.
    A null text is an empty one; a text without words has one empty bag, whose
    score is that of the bias.
    """
    sent = spark.sparkContext.broadcast((model.value, model.bias))

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        value, bias = sent.value
        known: dict[str, float] = {}
        for batch in batches:
            out = [np.zeros(0)]
            for part in text_slices(batch):
                n, words, vocabulary = _coded(pc.ascii_lower(part).to_pylist())
                doc, low, high = _bags(n)
                new = [w for w in vocabulary if w not in known]
                if len(known) + len(new) > _REMEMBERED:
                    known.clear()
                    new = vocabulary
                if new:
                    grams = [subwords(w) for w in new]
                    size = np.array([len(g) for g in grams])
                    total = np.add.reduceat(value[np.fromiter(chain.from_iterable(grams), dtype=np.int64)].astype(np.float64), np.cumsum(size) - size)
                    known.update(zip(new, (total / size).tolist()))
                of_word = np.fromiter((known[w] for w in vocabulary), dtype=np.float64, count=len(vocabulary))
                run_sum = np.r_[0.0, np.cumsum(of_word[words])]
                bag = (run_sum[high] - run_sum[low]) / np.maximum(1, high - low)
                top = np.full(len(n), -np.inf)
                np.maximum.at(top, doc, bag)
                out.append(1 / (1 + np.exp(-np.clip(top + bias, -500, 500))))
            yield pa.array(np.concatenate(out))

    return lambda text: run(text_or_empty(text) if isinstance(text, str) else text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, one row for each of docs: see scorer()."""
    return docs.select(id_col, scorer(model, docs.sparkSession)(text_col).alias("score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below threshold, with all the columns that they came with."""
    return docs.where(scorer(train(docs, labels), docs.sparkSession)("text") < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labelled rows outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
