"""Static embeddings: word vectors from co-occurrence, texts as weighted means of them, and the cosines of both."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine, dot
from ..operators.relational import written


def neighbours(docs: DataFrame, words: str, window: int) -> DataFrame:
    """(word, context, n): how often a word stands within so many places of another, counted in both directions."""
    near = F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.transform(F.array(*(F.lit(d) for d in range(-window, window + 1) if d)), lambda d: F.struct(F.get(words, i).alias("word"), F.when(i + d >= 0, F.get(words, i + d)).alias("context")))))
    rows = docs.where(F.size(words) > 1).select(F.explode_outer(near).alias("p")).where("p.context is not null")
    return rows.groupBy("p.word", "p.context").agg(F.count(F.lit(1)).alias("n"))


def ppmi_vectors(docs: DataFrame, words: str, size: int = 64, window: int = 2) -> DataFrame:
    """(word, vector): positive pointwise mutual information of each word with the `size` most frequent words (of equal ones the first by name)."""
    counts = docs.select(F.explode_outer(words).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    # size rows, whatever the input.
    best = counts.orderBy(F.desc("c"), "word").limit(size).select("word").collect()
    names = [r["word"] for r in best]
    if not names:
        return counts.select("word", F.array().cast("array<double>").alias("vector"))
    pairs = written(neighbours(docs, words, window))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of_word = pairs.groupBy("word").agg(F.sum("n").alias("nw"), *(F.sum(F.when(F.col("context") == c, F.col("n"))).alias(f"n{i}") for i, c in enumerate(names)))
    of_context = {r["context"]: r["n"] for r in pairs.where(F.col("context").isin(names)).groupBy("context").agg(F.sum("n").alias("n")).collect()}
    cell = lambda i, c: F.coalesce(F.greatest(F.lit(0.0), F.log(F.col(f"n{i}") * float(total) / (F.col("nw") * float(of_context.get(c, 1))))), F.lit(0.0))
    return of_word.select("word", F.array(*(cell(i, c) for i, c in enumerate(names))).alias("vector"))


def word_weights(docs: DataFrame, words: str, smooth: float = 1e-3) -> DataFrame:
    """(word, weight): smooth / (smooth + a word's share of all words): frequent words weigh little."""
    counts = docs.select(F.explode_outer(words).alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("word", (smooth / (smooth + F.col("c") / F.col("all"))).alias("weight"))


def text_vectors(docs: DataFrame, key: str, words: str, vectors: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """(key, vector): the mean of a text's word vectors by weight over its words that have one; texts without any have no row. Words are counted before the join."""
    counts = docs.select(F.col(key).alias("__k"), F.explode_outer(words).alias("word")).where("word is not null").groupBy("__k", "word").agg(F.count(F.lit(1)).alias("c"))
    held = counts.join(vectors, "word").join(weights, "word")
    sums = held.groupBy("__k").agg(F.sum("c").alias("c"), *(F.sum(F.col("c") * F.col("weight") * F.get("vector", F.lit(i))).alias(f"s{i}") for i in range(size)))
    return sums.select(F.col("__k").alias(key), F.array(*(F.col(f"s{i}") / F.col("c") for i in range(size))).alias("vector"))


def _literal(v: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def common_direction(rows: DataFrame, vector: str, size: int, rounds: int = 4) -> np.ndarray:
    """The direction that most of all vectors' length lies along, by power iteration from their mean. A round is one aggregate; size numbers reach the driver."""

    def summed(weight: Column) -> np.ndarray:
        sums = rows.agg(*(F.sum(weight * F.get(vector, F.lit(i))).alias(f"s{i}") for i in range(size))).first()
        v = np.array([x or 0.0 for x in sums])
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    u = summed(F.lit(1.0))
    for _ in range(rounds):
        if u.any():
            u = summed(dot(F.col(vector), _literal(u)))
    return u


def without_direction(vector: Column, u: np.ndarray) -> Column:
    along = _literal(u)
    return F.zip_with(vector, along, lambda x, y: x - y * dot(vector, along)) if len(u) else vector


@dataclass
class StaticEmbeddings:
    """Fitted by `fit` on docs(words): word vectors of `size` numbers (or given ones), word weights, and the direction that all texts share.

    Vectors that come from elsewhere, as (word, vector), take the place of the trained ones.
    """

    size: int = 64
    window: int = 2
    smooth: float = 1e-3
    vectors: DataFrame | None = field(default=None, repr=False)
    weights: DataFrame | None = field(default=None, repr=False)
    direction: np.ndarray | None = field(default=None, repr=False)

    def fit(self, docs: DataFrame, key: str, words: str) -> StaticEmbeddings:
        if self.vectors is None:
            self.vectors = written(ppmi_vectors(docs, words, self.size, self.window))
        self.weights = written(word_weights(docs, words, self.smooth))
        self.direction = common_direction(written(self._means(docs, key, words)), "vector", self.size)
        return self

    def _means(self, docs: DataFrame, key: str, words: str) -> DataFrame:
        return text_vectors(docs, key, words, self.vectors, self.weights, self.size)

    def transform(self, docs: DataFrame, key: str, words: str) -> DataFrame:
        """(key, vector): texts without the common direction."""
        means = written(self._means(docs, key, words))
        return means.select(key, without_direction(F.col("vector"), self.direction).alias("vector"))

    def text_similarity(self, texts: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
        """(a, b, score) of pairs(a, b) of keys, with texts as transform gives them; null where one has no vector, or one of zeros."""
        a, b = texts.select(F.col(key).alias("a"), F.col("vector").alias("x")), texts.select(F.col(key).alias("b"), F.col("vector").alias("y"))
        return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", cosine(F.col("x"), F.col("y")).alias("score"))

    def word_similarity(self, pairs: DataFrame) -> DataFrame:
        """(a, b, score) of pairs(a, b) of words; null where one has no vector, or one of zeros."""
        return self.text_similarity(self.vectors, "word", pairs)
