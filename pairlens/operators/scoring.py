"""Overlap of item lists, term weights, phrases, optimal assignment and confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.similarity import SCALES, cosine
from .relational import exploded, global_places, running_total, sample_rows, seeded, with_groups, written
from .stats import group_quantiles, quantile_knots


def word_shares(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds out: a map from each distinct word of a list to its share of them."""
    df = _runs(df, words, "__w")
    return df.withColumn(out, F.map_from_arrays("__w_items", F.transform("__w_counts", lambda c: c / F.size(words)))).drop("__w_items", "__w_counts")


def _runs(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds out_items and out_counts: the distinct items of a list, sorted, and how often each occurs. The list is sorted once."""
    items = F.sort_array(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    df = df.withColumn(f"{out}_all", items)
    place = F.sequence(F.lit(0), F.size(f"{out}_all") - 1)
    starts = F.filter(place, lambda i: (i == 0) | (F.get(f"{out}_all", i) != F.get(f"{out}_all", i - 1)))
    df = df.withColumn(f"{out}_starts", F.when(F.size(f"{out}_all") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice(f"{out}_starts", F.lit(2), F.size(f"{out}_starts")), F.array(F.size(f"{out}_all")))
    made = {f"{out}_items": F.transform(f"{out}_starts", lambda i: F.get(f"{out}_all", i)), f"{out}_counts": F.when(F.size(f"{out}_all") > 0, F.zip_with(f"{out}_starts", ends, lambda a, b: b - a)).otherwise(F.array().cast("array<int>"))}
    return df.withColumns(made).drop(f"{out}_all", f"{out}_starts")


def left_overlap(df: DataFrame, key: str, left: str, right: str, scale: str = "sqrt", keep: Sequence[str] = ()) -> DataFrame:
    """(key, score, n_elem, and columns to keep): how much of the left list's weight the right list covers.

    Counts are scaled and divided by their side's mean, where the right mean is over items of the left
    list alone; the score is 1 less the mean lack over distinct left items. An empty side scores 0.
    Each row is judged by itself, in array functions: no shuffle.
    """
    f = SCALES[scale]
    rows = _runs(_runs(df.select(key, *keep, F.col(left).alias("__left"), F.col(right).alias("__right")), "__left", "__l"), "__right", "__r")
    # The right counts as a lambda's own variable: as a column Spark moved what makes them into the lambda, for each left item anew.
    found = F.get(F.transform(F.array(F.map_from_arrays("__r_items", "__r_counts")), lambda m: F.transform("__l_items", lambda x: F.try_element_at(m, x))), F.lit(0))
    rows = rows.select(key, *keep, F.transform("__l_counts", f).alias("__l"), F.transform(found, lambda c: F.when(c.isNotNull(), f(c))).alias("__r"))
    mean = lambda a: F.try_divide(F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x), F.size(F.filter(a, lambda x: x.isNotNull())))
    rows = rows.select(key, *keep, "__l", "__r", mean("__l").alias("__lm"), mean("__r").alias("__rm"))
    lack = F.zip_with("__l", "__r", lambda a, b: F.greatest(F.lit(0.0), a / F.col("__lm") - F.coalesce(F.try_divide(b, F.col("__rm")), F.lit(0.0))))
    score = 1 - F.aggregate(lack, F.lit(0.0), lambda s, x: s + x) / F.size("__l")
    none = (F.size("__l") == 0) | F.col("__rm").isNull()
    return rows.select(key, *keep, F.when(none, 0.0).otherwise(score).alias("score"), F.size("__l").cast("long").alias("n_elem"))


def tf_idf(docs: DataFrame, key: str, words: str, min_df: float = 0.0) -> DataFrame:
    """(key, term, weight) in long form: counts times ln((1 + n) / (1 + df)) + 1, each document at length 1."""
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    tf = exploded(docs, [key], words, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") >= min_df * F.col("__n"))
    weighted = tf.join(df, "term").select(key, "term", (F.col("tf") * (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def pair_cosine(weights: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(a, b, score) for pairs(a, b) of documents in long form; pairs without a common term score 0."""
    left = weights.select(F.col(key).alias("a"), "term", F.col("weight").alias("wa"))
    right = weights.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb"))
    found = pairs.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def phrases(docs: DataFrame, words: str, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """(a, b, n, score): neighbours whose score (n - min_count) * vocabulary / (count a * count b) is over the threshold.

    Pairs of words and, with an empty second word, words alone are counted in one pass over the texts. Only frequent pairs meet
    the words' counts.
    """
    size = F.size(words)
    neighbours = F.arrays_zip(F.slice(words, F.lit(1), F.greatest(size - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(size - 1, F.lit(0))))
    alone = F.arrays_zip(F.col(words), F.array_repeat(F.lit(""), size))
    both = F.concat(*(x.cast("array<struct<a: string, b: string>>") for x in (alone, neighbours)))
    counts = docs.select(F.explode_outer(both).alias("p")).where("p is not null").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(f"b = '' or n >= {min_count}")
    counts = written(counts)
    one = counts.where("b = ''").select(F.col("a").alias("w"), F.col("n").alias("c"))
    vocabulary = one.agg(F.count(F.lit(1)).alias("v"))
    pairs = counts.where("b <> ''")
    scored = pairs.join(one.select(F.col("w").alias("a"), F.col("c").alias("ca")), "a").join(one.select(F.col("w").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(vocabulary))
    return scored.select("a", "b", "n", ((F.col("n") - min_count) * F.col("v") / (F.col("ca") * F.col("cb"))).alias("score")).where(F.col("score") > threshold)


def join_phrases(docs: DataFrame, key: str, words: str, found: DataFrame, out: str = "phrases") -> DataFrame:
    """(key, out): the words with the pairs of found(a, b) joined by an underscore, from the left, a word in one pair at most."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    near = F.arrays_zip(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest)).cast("array<struct<a: string, b: string>>")
    pairs = docs.select(key, F.posexplode_outer(near).alias("at", "p")).where("p is not null").select(key, "at", "p.a", "p.b")
    hits = pairs.join(found.select("a", "b").distinct(), ["a", "b"]).groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list("at")).alias("__hits"))
    rows = docs.select(key, words).join(hits, F.col(key) == F.col("__k"), "left")
    # From the left: a pair counts if the one before it did not take its first word.
    taken = F.aggregate(F.coalesce("__hits", F.array().cast("array<int>")), F.array().cast("array<int>"), lambda acc, i: F.when((F.size(acc) == 0) | (F.element_at(acc, -1) < i - 1), F.concat(acc, F.array(i))).otherwise(acc))
    rows = rows.select(key, words, taken.alias("__t"))
    joined = F.transform(words, lambda w, i: F.when(F.array_contains("__t", i), F.concat(w, F.lit("_"), F.get(words, i + 1))).when(F.array_contains("__t", i - 1), F.lit(None)).otherwise(w))
    return rows.select(key, F.filter(joined, lambda x: x.isNotNull()).alias(out))


def with_phrases(docs: DataFrame, key: str, words: str, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """(key, words): the words and, after them, the new joined pairs and triples of a text."""
    two = join_phrases(docs, key, words, phrases(docs.select(words), words, min_count, threshold))
    three = join_phrases(two, key, "phrases", phrases(two.select("phrases"), "phrases", min_count, threshold), "triples")
    new = lambda c: F.filter(c, lambda x: F.contains(x, F.lit("_")) & ~F.array_contains(words, x))
    return docs.select(key, words).join(two, key).join(three, key).select(key, F.concat(F.col(words), F.array_distinct(F.concat(new("phrases"), new("triples")))).alias(words))


def bag_of_words(docs: DataFrame, key: str, words: str, dictionary: DataFrame) -> DataFrame:
    """(key, term, n) of terms that a dictionary(term, ...) holds."""
    counts = exploded(docs, [key], words, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(dictionary.select("term"), "term", "left_semi").select(key, "term", "n")


def tf_idf_log2(docs: DataFrame, key: str, words: str) -> DataFrame:
    """(key, term, weight): counts times log2(n / df), each document at length 1; terms of every document weigh nothing and are left out."""
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    tf = exploded(docs, [key], words, "term").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df < __n")
    raw = tf.join(df, "term").select(key, "term", (F.col("tf") * F.log2(F.col("__n") / F.col("df"))).alias("w"))
    # A window, which spills, instead of a join of all terms with sums of the same terms.
    return raw.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy(key)))).alias("weight")).where(F.col(key).isNotNull())


def prune_dictionary(docs: DataFrame, key: str, words: str, no_below: int = 20, no_above: float = 0.4, keep: list[str] = ()) -> DataFrame:
    """(term, df): terms in at least no_below documents and at most a share no_above of them, and those to keep."""
    n = docs.agg(F.count(F.lit(1)).alias("__n"))
    df = exploded(docs, [key], F.array_distinct(words), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    fine = (F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("__n"))
    return df.crossJoin(F.broadcast(n)).where(fine | F.col("term").isin(list(keep)) if keep else fine).select("term", "df")


def average_word_scores(df: DataFrame, group: str, scores: str, digits: int = 9) -> DataFrame:
    """(group, word, average, percentile): sum of a word's scores by the group's rows, rounded; the share of words strictly below, in percent.

    Different averages are counted first, and those are ranked, by ranges of their order, not words group by group.
    """
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    # explode alone would have Spark make the scores a second time, to see whether there are any.
    words = df.select(group, F.explode_outer(scores).alias("word", "s")).where("word is not null").groupBy(group, "word").agg(F.sum("s").alias("s"))
    # Written once: it feeds the counts and the result.
    out = written(words.join(rows, group).select(group, "word", F.round(F.col("s") / F.col("__n"), digits).alias("average")))
    counts = out.groupBy(group, "average").agg(F.count(F.lit(1)).alias("__c"))
    placed = running_total(counts, [F.col(group), F.col("average")], "__c", "__b")
    ends = placed.groupBy(F.col(group).alias("__e")).agg(F.min("__b").alias("__first"), F.sum("__c").alias("__all"))
    ranks = with_groups(placed, ends, group, "__e").select(group, "average", ((F.col("__b") - F.col("__first")) * 100.0 / F.col("__all")).alias("percentile"))
    return out.join(ranks, [group, "average"]).select(group, "word", "average", "percentile")


def topic_word_scores(topics: DataFrame, phi: DataFrame, key: str) -> DataFrame:
    """(key, word, score) of topics(key, topic, p) and phi(topic, word, weight): a word's weight in the last of a document's topics that has it, times that topic's share.

    A share or weight over 1 keeps its fraction; both are rounded to 7 digits.
    """
    short = lambda c: F.round(F.when(F.col(c) > 1, F.col(c) - F.floor(c)).otherwise(F.col(c)), 7)
    rows = topics.select(key, "topic", short("p").alias("p")).join(phi.select("topic", "word", short("weight").alias("weight")), "topic")
    return rows.groupBy(key, "word").agg(F.max_by(F.col("p") * F.col("weight"), "topic").alias("score"))


def coherence(docs: DataFrame, words: str, topics: DataFrame) -> DataFrame:
    """(topic, coherence) of topics(topic, term): the mean over pairs of a topic's terms of the normalised pointwise mutual information of their being in one document."""
    n = docs.count()
    terms = topics.select("term").distinct()
    held = docs.select(F.monotonically_increasing_id().alias("__d"), F.array_distinct(words).alias("__w")).select("__d", F.explode("__w").alias("term")).join(F.broadcast(terms), "term")
    single = held.groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    pairs = topics.alias("x").join(topics.alias("y"), F.col("x.topic") == F.col("y.topic")).where("x.term < y.term").select("x.topic", F.col("x.term").alias("a"), F.col("y.term").alias("b"))
    wanted = F.broadcast(pairs.select("a", "b").distinct())
    listed = held.groupBy("__d").agg(F.array_sort(F.collect_list("term")).alias("l"))
    both = listed.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b").join(wanted, ["a", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("ab"))
    rows = pairs.join(both, ["a", "b"], "left").join(single.select(F.col("term").alias("a"), F.col("c").alias("ca")), "a", "left").join(single.select(F.col("term").alias("b"), F.col("c").alias("cb")), "b", "left")
    p = (F.coalesce("ab", F.lit(0)) + 1e-12) / n
    npmi = F.try_divide(F.log(p / (F.col("ca") / n * F.col("cb") / n)), -F.log(p))
    return rows.groupBy("topic").agg(F.avg(F.coalesce(npmi, F.lit(0.0))).alias("coherence"))


def assign_many(cost: np.ndarray) -> np.ndarray:
    """The columns of each grid's rows of least total cost, of grids with no more rows than columns, by shortest augmenting paths with potentials, all grids at once."""
    grids, n, m = cost.shape
    u, v, owner = np.zeros((grids, n + 1)), np.zeros((grids, m + 1)), np.zeros((grids, m + 1), int)
    for i in range(1, n + 1):
        owner[:, 0], at = i, np.zeros(grids, int)
        least, way, used = np.full((grids, m + 1), np.inf), np.zeros((grids, m + 1), int), np.zeros((grids, m + 1), bool)
        on = np.arange(grids)
        while len(on):
            used[on, at[on]] = True
            row, taken, near = owner[on, at[on]], used[on], least[on]
            slack = cost[on, row - 1] - u[on, row][:, None] - v[on, 1:]
            better = (slack < near[:, 1:]) & ~taken[:, 1:]
            near[:, 1:] = np.where(better, slack, near[:, 1:])
            way[on, 1:] = np.where(better, at[on][:, None], way[on, 1:])
            to = np.argmin(np.where(taken[:, 1:], np.inf, near[:, 1:]), axis=1) + 1
            step = near[np.arange(len(on)), to]
            k, j = np.nonzero(taken)
            u[on[k], owner[on[k], j]] += step[k]
            v[on] -= np.where(taken, step[:, None], 0)
            least[on] = np.where(taken, near, near - step[:, None])
            at[on] = to
            on = on[owner[on, to] > 0]
        on = np.arange(grids)
        while len(on):
            before = way[on, at[on]]
            owner[on, at[on]] = owner[on, before]
            at[on] = before
            on = on[before > 0]
    out = np.zeros((grids, n), int)
    k, j = np.nonzero(owner[:, 1:])
    out[k, owner[k, j + 1] - 1] = j
    return out


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The rows' columns of least total cost."""
    flipped = cost.shape[0] > cost.shape[1]
    to = assign_many((cost.T if flipped else cost)[None])[0]
    return sorted((int(b), a) if flipped else (a, int(b)) for a, b in enumerate(to))


def _places(key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, size): the place of each rank among the different ones of its key, and how many these are; keys are 0, 1, ..."""
    every, place = np.unique(key * (int(rank.max()) + 1) + rank, return_inverse=True)
    size = np.bincount(every // (int(rank.max()) + 1))
    return place - (np.cumsum(size) - size)[key], size


#: Pairs of a task of optimal_assignment, which may be more where one key has more; pairs whose keys are matched together, and cells of their grids at once.
ROWS, HELD, GRIDS = 1 << 19, 1 << 18, 1 << 20


def _matched(rows: pd.DataFrame) -> pd.DataFrame:
    """(k, l, r, s): the matchings of whole keys, rows of a key together; keys whose grids have the same sides go through one pass. Pairs without a score count 0."""
    k, l, r = rows.k.to_numpy(), rows.l.to_numpy(), rows.r.to_numpy()
    score = np.nan_to_num(rows.s.to_numpy(float))
    key = np.cumsum(np.append(0, np.diff(k) != 0))
    (a, n), (b, m) = (_places(key, pd.factorize(x, sort=True)[0]) for x in (l, r))
    rows_of = np.bincount(key)
    of_key, first, out = np.lexsort((m, n)), np.cumsum(rows_of) - rows_of, []
    ends = np.append(np.flatnonzero(np.diff(n[of_key]) | np.diff(m[of_key])) + 1, len(of_key))
    for start, end in zip(np.append(0, ends[:-1]), ends):
        h, w = int(n[of_key[start]]), int(m[of_key[start]])
        step = max(1, GRIDS // (h * w))
        for at in range(start, end, step):
            keys = of_key[at : min(at + step, end)]
            count = rows_of[keys]
            mine = np.repeat(first[keys] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            grid, which, some = np.zeros((len(keys), h, w)), np.repeat(np.arange(len(keys)), count), np.zeros((len(keys), h + w), np.int64)
            grid[which, a[mine], b[mine]] = score[mine]
            # A row that holds each item, for its name.
            some[which, a[mine]], some[which, h + b[mine]] = mine, mine
            to = assign_many(-(grid.transpose(0, 2, 1) if h > w else grid))
            i, j = np.repeat(np.arange(len(keys)), min(h, w)), np.tile(np.arange(min(h, w)), len(keys))
            x, y = (to.ravel(), j) if h > w else (j, to.ravel())
            out.append(pd.DataFrame({"k": k[first[keys[i]]], "l": l[some[i, x]], "r": r[some[i, h + y]], "s": grid[i, x, y]}))
    return pd.concat(out)


def optimal_assignment(df: DataFrame, key: str, left: str, right: str, score: str) -> DataFrame:
    """(key, left, right, score): the matching of left and right items of greatest total mean score in each group.

    A task goes through many keys, some at once, and holds their grids, or one key's; for lists of very many
    items with scores by distance see sorted_assignment.
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r"), F.col(score).cast("double").alias("s"))
    rows = rows.where("k is not null and l is not null and r is not null")
    # So many tasks that one has ROWS of the pairs, or one key, whatever there is of them all.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    mean = rows.repartition(parts, "k").groupBy("k", "l", "r").agg(F.avg("s").alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        wait = HELD
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < wait:
                continue
            every = pd.concat(held)
            # The last key may go on in the next batch.
            last = int(np.searchsorted(every.k.to_numpy(), every.k.iloc[-1]))
            if last:
                yield _matched(every.iloc[:last])
            held = [every.iloc[last:]]
            wait = max(HELD, 2 * len(held[0]))
        if sum(map(len, held)):
            yield _matched(pd.concat(held))

    return mean.sortWithinPartitions("k").mapInPandas(run, "k long, l string, r string, s double")


def sorted_assignment(left: DataFrame, right: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """(key, left, right, a, b): the matching of each key's left and right items (key, item, value) whose values lie nearest in total, for any cost that grows ever faster, or evenly, with their distance.

    That is the least with the least, and so on. Items are numbered by ranges of the order of all keys, so that
    no key is one task's work. Both sides of a key should have as many items; what is over has no partner.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias(f"{name}k"), F.col(item).alias(f"{name}i"), F.col(value).cast("double").alias(f"{name}v"))
        placed = global_places(rows, [F.col(f"{name}k"), F.col(f"{name}v"), F.col(f"{name}i")], f"{name}p")
        first = placed.groupBy(F.col(f"{name}k").alias(f"{name}f")).agg(F.min(f"{name}p").alias(f"{name}0"))
        return placed.join(first, F.col(f"{name}k") == F.col(f"{name}f")).withColumn(f"{name}p", F.col(f"{name}p") - F.col(f"{name}0"))

    a, b = numbered(left, "a"), numbered(right, "b")
    both = a.join(b, (F.col("ak") == F.col("bk")) & (F.col("ap") == F.col("bp")))
    return both.select(F.col("ak").alias(key), F.col("ai").alias("left"), F.col("bi").alias("right"), F.col("av").alias("a"), F.col("bv").alias("b"))


def logistic_confidence(actual: np.ndarray, shuffled: np.ndarray, at: float, rounds: int = 50) -> float:
    """P(actual) at a score, from a balanced one-variable logistic fit by Newton steps with a unit ridge on the slope."""
    x = np.concatenate([actual, shuffled])
    y = np.concatenate([np.ones(len(actual)), np.zeros(len(shuffled))])
    weight = np.where(y == 1, len(y) / (2 * max(len(actual), 1)), len(y) / (2 * max(len(shuffled), 1)))
    z, w = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (weight * (p - y)) + np.array([w[0], 0])
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1e-9])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    p = float(1 / (1 + np.exp(-(w[0] * at + w[1]))))
    return p if p == p else 0.0


def assigned_quantile(base: DataFrame, key: str, assigned: DataFrame, score: str, q: float) -> DataFrame:
    """(key, score): the linear quantile q of each key's assigned scores, 0 without any."""
    values = assigned.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(score)).alias("__v"))
    place = F.lit(q) * (F.size("__v") - 1)
    low, high = F.get("__v", F.floor(place).cast("int")), F.get("__v", F.ceil(place).cast("int"))
    held = values.select("__k", (low + (high - low) * (place - F.floor(place))).alias("__s"))
    return base.select(key).join(held, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("__s", F.lit(0.0)).alias("score"))


#: Rounds of a permutation, the prime below which its hashes stay, and what these multiply by.
ROUNDS, PRIME, FACTORS = 16, 2147483647, (48271, 69621)


def _hashed(x: Column) -> Column:
    """A number below PRIME that every part of x decides."""
    for f, bits in zip(FACTORS, (15, 13)):
        x = x % PRIME * f % PRIME
        x = x.bitwiseXOR(F.shiftright(x, bits))
    return x


def permuted_place(place: Column, n: Column, seed: Column) -> Column:
    """The place below n to which the seed's permutation sends a place: each round draws a partner place, and both change places or both stay."""

    def turn(x: Column, i: Column) -> Column:
        drawn = F.struct(_hashed(seed * 1009 + i * 7919 + 17).alias("a"), _hashed(seed * 9176 + i * 613 + 5).alias("b"))
        both = F.transform(F.array(drawn), lambda d: F.struct(F.pmod(d["a"] * PRIME + d["b"] - x, n).alias("y"), d["b"].alias("b")))
        return F.get(F.transform(both, lambda p: F.when((_hashed(F.greatest(x, p["y"]) + p["b"]) / 32).cast("long") % 2 == 1, p["y"]).otherwise(x)), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), place, turn)


def dealt_rights(df: DataFrame, key: str, left: list[str], right: str, seeds: Column) -> DataFrame:
    """(key, left, right, seed): for each of an array of seeds the right column dealt anew. Rows are numbered once by ranges of their keys, which must differ; where a seed sends each is computed."""
    placed = written(global_places(df.select(key, *left, right), [F.col(key)], "__p"))
    n = F.lit(placed.count()).cast("long")
    rows = placed.select(key, *left, "__p", F.explode(seeds.cast("array<long>")).alias("seed"))
    given = placed.select(F.col("__p").alias("__q"), right)
    return rows.withColumn("__from", permuted_place(F.col("__p"), n, F.col("seed"))).join(given, F.col("__from") == F.col("__q")).select(key, *left, right, "seed")


def shuffled_right(df: DataFrame, key: str, right: str, seed: int) -> DataFrame:
    """(key, right) with the right column dealt anew by a seeded permutation of the rows' places in the order of the keys, which must differ."""
    return dealt_rights(df, key, [], right, F.array(F.lit(seed))).select(key, right)


def permutations(df: DataFrame, key: str, left: str, right: str, times: int, scale: str = "sqrt") -> DataFrame:
    """(key, seed, score, n_elem): overlaps with the right column shuffled, once for each seed from 0. One numbering and one join serve all seeds."""
    dealt = dealt_rights(df, key, [left], right, F.sequence(F.lit(0), F.lit(times - 1)))
    return left_overlap(dealt, key, left, right, scale, ["seed"])


def random_right(df: DataFrame, key: str, right: str, n: int) -> DataFrame:
    """(right): n rows at most of the right column, in an order drawn by n + 3."""
    return sample_rows(df.select(key, right), n, [key], n + 3).select(right)


def left_by_sample(df: DataFrame, key: str, left: str, sample: DataFrame, right: str) -> DataFrame:
    """(key, scores): the cosines of each row's left vector with a sample of right ones. The sample has a stated number of rows and is broadcast."""
    held = sample.agg(F.collect_list(right).alias("__s"))
    return df.crossJoin(F.broadcast(held)).select(key, F.transform("__s", lambda v: F.coalesce(cosine(F.col(left), v), F.lit(0.0))).alias("scores"))


def _l1_least(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The new w of each problem that makes g (v - w) + (v - w) h (v - w) / 2 + |v0| + |v1| least: of the candidates with each weight above, below or at 0, the best."""
    a, b, c = h[:, 0], h[:, 1], h[:, 2]
    best, value = w.copy(), np.full(len(w), np.inf)
    signs = (-1, 0, 1)
    for s0 in signs:
        for s1 in signs:
            r0, r1 = a * w[:, 0] + b * w[:, 1] - g[:, 0] - s0, b * w[:, 0] + c * w[:, 1] - g[:, 1] - s1
            det = a * c - b * b
            with np.errstate(divide="ignore", invalid="ignore"):
                v0 = (c * r0 - b * r1) / det if s0 and s1 else r0 / a if s0 else np.zeros(len(w))
                v1 = (a * r1 - b * r0) / det if s0 and s1 else r1 / c if s1 else np.zeros(len(w))
            v = np.stack([v0, v1], 1)
            d = v - w
            cost = (g * d).sum(1) + (a * d[:, 0] ** 2 + 2 * b * d[:, 0] * d[:, 1] + c * d[:, 1] ** 2) / 2 + np.abs(v).sum(1)
            better = np.isfinite(cost) & (v0 * s0 >= 0) & (v1 * s1 >= 0) & (cost < value)
            best[better], value[better] = v[better], cost[better]
    return best


def l1_newton(sums: Callable[[np.ndarray], np.ndarray], n: int, rounds: int = 60, near: float = 1e-9) -> np.ndarray:
    """(slope, intercept) of n balanced logistic fits with a unit penalty on the size of both, together, by proximal Newton steps.

    sums(w) gives for each problem its loss, the two parts of the gradient and the three of the curvature at
    its w. A step that does not lessen a problem's cost is halved, until nothing moves.
    """
    w, step, target = np.zeros((n, 2)), np.ones(n), np.zeros((n, 2))
    cost, direction = np.full(n, np.inf), np.zeros((n, 2))
    trial = w.copy()
    for _ in range(rounds):
        s = sums(trial)
        now = s[:, 0] + np.abs(trial).sum(1)
        fine = now <= cost + 1e-12 * np.abs(cost).clip(1) if np.isfinite(cost).any() else np.ones(n, bool)
        w[fine], cost[fine] = trial[fine], now[fine]
        # A bit of curvature keeps problems whose scores are all alike solvable.
        curve = s[fine, 3:] + np.array([1e-9, 0, 1e-9])
        target[fine] = _l1_least(s[fine, 1:3], curve, w[fine])
        step = np.where(fine, 1.0, step / 2)
        direction = target - w
        if not (np.abs(direction) * step[:, None] > near).any():
            break
        trial = w + step[:, None] * direction
    return w


def _logistic_sums(z: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of each row's problem, for scores z."""
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    loss = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    off, bend = weight * (p - y), weight * p * (1 - p)
    return np.stack([(weight * loss).sum(-1), (off * x).sum(-1), off.sum(-1), (bend * x * x).sum(-1), (bend * x).sum(-1), bend.sum(-1)], -1)


def l1_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, intercept) of the balanced logistic fit with a unit penalty on the size of both."""
    weight = np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    return tuple(l1_newton(lambda w: _logistic_sums(w[:, :1] * x + w[:, 1:], x, y, weight), 1, rounds)[0].tolist())


def bucket_fits(rows: DataFrame, bucket: str, x: str, y: str, least: int) -> DataFrame:
    """(n_elem, slope, intercept): l1_logistic of rows(bucket, x, y of 0 or 1) for each bucket with at least so many rows of 1 and any of 0.

    Equal rows are counted once. Each round is one aggregate over all buckets; six sums of each bucket reach
    the driver, where buckets are sizes below a percentile.
    """
    spark = rows.sparkSession
    counts = written(rows.groupBy(F.col(bucket).cast("long").alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy("b").agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("zeros")).where(f"ones >= {least} and zeros > 0").orderBy("b").collect()
    at = {r["b"]: i for i, r in enumerate(sizes)}
    balance = [((r["ones"] + r["zeros"]) / (2 * r["ones"]), (r["ones"] + r["zeros"]) / (2 * r["zeros"])) for r in sizes]

    def sums(w: np.ndarray) -> np.ndarray:
        now = spark.createDataFrame([(b, float(w[i, 0]), float(w[i, 1]), *balance[i]) for b, i in at.items()], "wb long, slope double, intercept double, one double, zero double")
        # Buckets are few and their rows many: these stay in their tasks.
        held = counts.join(F.broadcast(now), F.col("b") == F.col("wb")).withColumn("z", F.col("slope") * F.col("x") + F.col("intercept"))
        p, weight = 1 / (1 + F.exp(-F.col("z"))), F.col("c") * F.when(F.col("y") == 1, F.col("one")).otherwise(F.col("zero"))
        loss = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
        held = held.select("b", "x", weight.alias("w"), loss.alias("loss"), (p - F.col("y")).alias("off"), (p * (1 - p)).alias("bend"))
        parts = ("w * loss", "w * off * x", "w * off", "w * bend * x * x", "w * bend * x", "w * bend")
        out = np.zeros((len(at), 6))
        for r in held.groupBy("b").agg(*(F.sum(F.expr(e)).alias(f"s{i}") for i, e in enumerate(parts))).collect():
            out[at[r["b"]]] = [r[f"s{i}"] for i in range(6)]
        return out

    w = l1_newton(sums, len(at)) if at else np.zeros((0, 2))
    return spark.createDataFrame([(b, float(w[i, 0]), float(w[i, 1])) for b, i in at.items()], "n_elem long, slope double, intercept double")


def overlap_confidence(actual: DataFrame, shuffled: DataFrame, least: int = 100) -> DataFrame:
    """(n_elem, slope, intercept): for each left size of actual(n_elem, score) a logistic fit of actual against shuffled scores times the size.

    Sizes from the 97.5th percentile on are one bucket; buckets of under `least` rows have none. See bucket_fits and bucket_confidence.
    """
    # Both are written: a filter of the sizes would otherwise be moved to where these are made, and make them item by item.
    actual, shuffled = written(actual.select("n_elem", "score")), written(shuffled.select("n_elem", "score"))
    limit = int(quantile_knots(actual, "n_elem", 41)[39]) if actual.head(1) else 0
    both = actual.withColumn("y", F.lit(1)).union(shuffled.withColumn("y", F.lit(0)))
    rows = both.select(F.least(F.col("n_elem"), F.lit(max(limit, 1))).alias("b"), (F.col("score") * F.col("n_elem")).alias("x"), "y")
    return bucket_fits(rows.where("b > 0"), "b", "x", "y", least)


def bucket_confidence(scored: DataFrame, key: str, fits: DataFrame, compat: bool = False) -> DataFrame:
    """(key, score, confidence) of scored(key, score, n_elem): 2 times the greater of the two probabilities, less 1, by the fit of the nearest bucket not over the row's size; 0 without one.

    With compat the fit takes the score alone, though it was made for the score times the size. Buckets are a few dozen rows, broadcast.
    """
    held = fits.agg(F.sort_array(F.collect_list(F.struct("n_elem", "slope", "intercept"))).alias("__f"))
    mine = F.element_at(F.filter("__f", lambda f: f["n_elem"] <= F.col("n_elem")), -1)
    rows = scored.crossJoin(F.broadcast(held)).withColumn("__m", F.when(F.size(F.filter("__f", lambda f: f["n_elem"] <= F.col("n_elem"))) > 0, mine))
    x = F.col("score") if compat else F.col("score") * F.col("n_elem")
    p = 1 / (1 + F.exp(-(F.col("__m.slope") * x + F.col("__m.intercept"))))
    return rows.select(key, "score", F.coalesce(2 * F.greatest(p, 1 - p) - 1, F.lit(0.0)).alias("confidence"))


#: Scores that are fitted at once.
CELLS = 1 << 18


def row_confidence(df: DataFrame, key: str, score: str, randoms: str, trained: list[float]) -> DataFrame:
    """(key, confidence): the probability that a row's score is one of the trained ones and not of its own random ones, by a logistic fit for each row; 0 for null and NaN.

    trained stands for the distribution of all scores: its quantile knots, a bounded number. The rows of a
    batch are fitted together.
    """
    kind = df.schema[key].dataType
    base = np.array(trained, float)

    def fitted(scores: list[float], lists: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(r) for r in lists])
        x = np.zeros((len(lists), len(base) + size.max()))
        x[:, : len(base)] = base
        held = np.arange(x.shape[1] - len(base)) < size[:, None]
        x[:, len(base) :][held] = np.concatenate(lists)
        y = np.zeros(x.shape[1])
        y[: len(base)] = 1
        every = (len(base) + size)[:, None]
        weight = np.concatenate([np.broadcast_to(every / (2 * max(len(base), 1)), (len(lists), len(base))), np.where(held, every / (2 * size[:, None]), 0.0)], 1)
        w = l1_newton(lambda w: _logistic_sums(w[:, :1] * x + w[:, 1:], x, y, weight), len(lists))
        return 1 / (1 + np.exp(-(w[:, 0] * np.array(scores) + w[:, 1])))

    def run(batches):
        for pdf in batches:
            conf = np.zeros(len(pdf))
            lists = [None if s is None or s != s or r is None or not len(r) else np.asarray(r, float) for s, r in zip(pdf[score], pdf[randoms])]
            todo = [i for i, r in enumerate(lists) if r is not None]
            while todo:
                part, todo = todo[: (n := max(1, CELLS // (len(base) + max(len(lists[i]) for i in todo))))], todo[n:]
                conf[part] = fitted([pdf[score].iloc[i] for i in part], [lists[i] for i in part])
            yield pd.DataFrame({key: pdf[key], "confidence": conf})

    return df.select(key, score, randoms).mapInPandas(run, StructType([StructField(key, kind), StructField("confidence", DoubleType())]))


def top_above_percentile(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """Rows whose value, rounded to 3 digits, is strictly over the group's percentile of rounded values."""
    rows = df.withColumn("__v", F.round(value, 3))
    limits = group_quantiles(rows, group, "__v", [share]).select(F.col(group).alias("__g"), F.col("q_0").alias("__c"))
    return rows.join(limits, F.col(group) == F.col("__g")).where("__v > __c").drop("__v", "__g", "__c")


def one_hot(values: Column, kinds: list[str]) -> dict[str, Column]:
    return {f"is_{k}": (values == k).cast("int") for k in kinds}
