"""Topic models: coherence over sliding windows, topics of each word, and a sweep over numbers of topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import written

#: Starts of windows that are compared in one group.
STRETCH = 256
TINY = 1e-12


def window_starts(docs: DataFrame, key: str, words: str, topics: DataFrame, window: int) -> DataFrame:
    """(doc, topic, term, s, e): disjoint runs of the starts of windows of so many words that hold a term of topics(topic, term). A shorter text is one window."""
    rows = docs.where(F.size(words) > 0).select(F.col(key).alias("doc"), (F.greatest(F.size(words) - window, F.lit(0))).alias("last"), F.posexplode(words).alias("p", "term"))
    held = rows.join(topics.select("topic", "term").distinct(), "term")
    starts = held.select("doc", "topic", "term", F.greatest(F.col("p") - window + 1, F.lit(0)).alias("s"), F.least("p", "last").alias("e"))
    before = F.max("e").over(Window.partitionBy("doc", "topic", "term").orderBy("e", "s").rowsBetween(Window.unboundedPreceding, -1))
    return starts.withColumn("s", F.greatest(F.col("s"), F.coalesce(before + 1, F.lit(0)))).where("s <= e")


def window_counts(docs: DataFrame, key: str, words: str, topics: DataFrame, window: int) -> DataFrame:
    """(topic, a, b, n): windows that hold both terms of a topic, a = b for those that hold one.

    Runs are cut into stretches of a text, and meet only within theirs, so that a long text is many small groups.
    """
    runs = window_starts(docs, key, words, topics, window)
    cut = runs.select("doc", "topic", "term", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / STRETCH), F.floor(F.col("e") / STRETCH))).alias("x"))
    cut = cut.select("doc", "topic", "x", "term", F.greatest(F.col("s"), F.col("x") * STRETCH).alias("s"), F.least(F.col("e"), (F.col("x") + 1) * STRETCH - 1).alias("e"))
    one = cut.select("doc", "topic", "x", F.col("term").alias("a"), F.col("s").alias("sa"), F.col("e").alias("ea"))
    two = cut.select("doc", "topic", "x", F.col("term").alias("b"), F.col("s").alias("sb"), F.col("e").alias("eb"))
    both = one.join(two, ["doc", "topic", "x"]).where("a <= b and sa <= eb and sb <= ea")
    return both.groupBy("topic", "a", "b").agg(F.sum(F.least("ea", "eb") - F.greatest("sa", "sb") + 1).alias("n"))


def window_coherence(docs: DataFrame, key: str, words: str, topics: DataFrame, window: int = 110) -> DataFrame:
    """(topic, coherence) of topics(topic, term): the mean over a topic's terms of the cosine between a term's normalised mutual information with all terms, in windows of so many words, and the sum of these vectors. Keys of docs should not repeat."""
    docs = docs.select(key, words)
    total = docs.where(F.size(words) > 0).agg(F.coalesce(F.sum(F.greatest(F.size(words) - window + 1, F.lit(1))), F.lit(0)).alias("n")).first()["n"]
    counts = written(window_counts(docs, key, words, topics, window))
    terms = topics.select("topic", "term").distinct()
    # A topic has few terms: all ordered pairs of them.
    pairs = terms.select("topic", F.col("term").alias("a")).join(terms.select("topic", F.col("term").alias("b")), "topic")
    single = counts.where("a = b").select("topic", F.col("a").alias("term"), "n")
    rows = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    rows = rows.join(counts.select("topic", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("n").alias("nab")), ["topic", "lo", "hi"], "left")
    rows = rows.join(single.select("topic", F.col("term").alias("a"), F.col("n").alias("na")), ["topic", "a"], "left").join(single.select("topic", F.col("term").alias("b"), F.col("n").alias("nb")), ["topic", "b"], "left")
    p = F.coalesce("nab", F.lit(0)) / float(max(total, 1)) + TINY
    npmi = F.log(p / (F.col("na") / float(max(total, 1)) * F.col("nb") / float(max(total, 1)))) / -F.log(p)
    cells = rows.select("topic", "a", "b", F.coalesce(F.when((F.col("na") > 0) & (F.col("nb") > 0), npmi), F.lit(0.0)).alias("x"))
    sums = cells.groupBy("topic", "b").agg(F.sum("x").alias("y"))
    each = cells.join(sums, ["topic", "b"]).groupBy("topic", "a").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("y") ** 2))).alias("c"))
    return each.groupBy("topic").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("coherence"))


def word_topics(counts: DataFrame, key: str, shares: DataFrame, phi: DataFrame, least: float = 0.01) -> DataFrame:
    """(key, word, topic, weight, rank) of counts(key, word, n), shares(key, topic, p) and phi(topic, word, weight): how many of a word's occurrences in a text are each topic's, the most first; parts under `least` are left out."""
    rows = counts.join(shares, key).join(phi.select("topic", "word", F.col("weight").alias("__phi")), ["topic", "word"])
    rows = rows.withColumn("__x", F.col("p") * F.col("__phi")).withColumn("weight", F.col("n") * F.try_divide(F.col("__x"), F.sum("__x").over(Window.partitionBy(key, "word"))))
    rank = F.row_number().over(Window.partitionBy(key, "word").orderBy(F.desc("weight"), "topic"))
    return rows.where(F.col("weight") >= least).withColumn("rank", rank).select(key, "word", "topic", "weight", "rank")


@dataclass
class Topics:
    """LDA over docs(key, words): `fit` gives a model of k topics, `sweep` the best of several k by coherence."""

    k: int = 22
    iterations: int = 20
    min_df: float = 2.0
    seed: int = 100
    top: int = 10
    window: int = 110
    vocabulary: list[str] = field(default_factory=list, repr=False)
    model: object = field(default=None, repr=False)
    vectors: object = field(default=None, repr=False)

    def fit(self, docs: DataFrame, words: str) -> Topics:
        from pyspark.ml.clustering import LDA
        from pyspark.ml.feature import CountVectorizer

        self.vectors = CountVectorizer(inputCol=words, outputCol="__features", minDF=self.min_df).fit(docs)
        self.vocabulary = self.vectors.vocabulary
        self.model = LDA(k=self.k, maxIter=self.iterations, seed=self.seed, featuresCol="__features").fit(self.vectors.transform(docs))
        return self

    def terms(self) -> DataFrame:
        """(topic, rank, term, weight) of the heaviest terms."""
        rows = self.model.describeTopics(self.top).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
        return rows.select("topic", "rank", F.get(F.array(*map(F.lit, self.vocabulary)), F.col("x.termIndices")).alias("term"), F.col("x.termWeights").alias("weight"))

    def phi(self) -> DataFrame:
        """(topic, word, weight): each topic's weights add up to 1."""
        rows = self.model.describeTopics(len(self.vocabulary)).select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("x"))
        return rows.select("topic", F.get(F.array(*map(F.lit, self.vocabulary)), F.col("x.termIndices")).alias("word"), F.col("x.termWeights").alias("weight"))

    def shares(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, topic, p)."""
        from pyspark.ml.functions import vector_to_array

        rows = self.model.transform(self.vectors.transform(docs)).select(key, vector_to_array("topicDistribution").alias("d"))
        return rows.select(key, F.posexplode("d").alias("topic", "p"))

    def perplexity(self, docs: DataFrame) -> float:
        """An upper bound of the logarithm of perplexity per word."""
        return self.model.logPerplexity(self.vectors.transform(docs))

    def coherence(self, docs: DataFrame, key: str, words: str) -> float:
        """The mean coherence of all topics."""
        return window_coherence(docs, key, words, self.terms(), self.window).agg(F.avg("coherence")).first()[0]

    def word_topics(self, docs: DataFrame, key: str, words: str, least: float = 0.01) -> DataFrame:
        counts = docs.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
        return word_topics(counts, key, self.shares(docs, key), self.phi(), least)

    def sweep(self, docs: DataFrame, key: str, words: str, ks: list[int]) -> tuple[Topics, list[tuple[int, float, float]]]:
        """(the model of greatest coherence, of equal ones of fewest topics; (k, coherence, perplexity) of each k)."""
        docs, tried = written(docs.select(key, words)), []
        for k in ks:
            model = Topics(k, self.iterations, self.min_df, self.seed, self.top, self.window).fit(docs, words)
            tried.append((model, (k, model.coherence(docs, key, words), model.perplexity(docs))))
        best = max(tried, key=lambda t: (t[1][1], -t[1][0]))[0]
        return best, [t[1] for t in tried]
