"""Counts, agreement, histograms, quantile maps and tests."""

from __future__ import annotations

import math
import statistics
import time
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType

from .relational import global_places, running_total, seeded, with_groups, written


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share, rank), the most frequent first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    ranked = global_places(counts, [F.desc("n"), F.col("value")], "rank")
    return ranked.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("__all")).alias("share"), (F.col("rank") + 1).alias("rank"))


def crosstab(df: DataFrame, pred: str, label: str, labels: list | None = None) -> DataFrame:
    """(pred, label, n) for every pair of labels, zero where none."""
    counts = df.groupBy(F.col(pred).alias("pred"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    one = spark.createDataFrame([(x,) for x in labels], "v int") if labels else counts.select(F.col("pred").alias("v")).union(counts.select("label")).distinct()
    # Labels are few: a grid of their pairs, whatever the rows.
    grid = one.select(F.col("v").alias("pred")).crossJoin(one.select(F.col("v").alias("label")))
    return grid.join(counts, ["pred", "label"], "left").select("pred", "label", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(df: DataFrame, pred: Column, label: Column) -> DataFrame:
    """n, n_correct, exact, half (one off counts half) and gauss (one and two off count by a bell curve)."""
    d = F.abs(pred - label)
    share = lambda c: F.sum(c) / F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((d == 0).cast("long")).alias("n_correct"),
        share((d == 0).cast("double")).alias("exact"),
        share(F.when(d == 0, 1.0).when(d == 1, 0.5).otherwise(0.0)).alias("half"),
        share(F.when(d <= 2, F.exp(-d * d / 2.0)).otherwise(0.0)).alias("gauss"),
    )


def histogram(df: DataFrame, group: str, value: str, bins: int = 16) -> DataFrame:
    """(group, bin, n, density): unit bins centred on 0, 1, ...; values outside are left out."""
    rows = df.select(F.col(group).alias("grp"), F.floor(F.col(value) + 0.5).cast("int").alias("bin")).where(f"bin >= 0 and bin < {bins}")
    counts = rows.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("grp", "bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).alias("density"))


def cdf_distance(hist: DataFrame, bins: int = 16) -> DataFrame:
    """(a, b, distance): the sum over bins of the difference of cumulative shares, for each pair of groups a < b."""
    spine = hist.select("grp").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = spine.join(hist.select("grp", "bin", "density"), ["grp", "bin"], "left").fillna(0.0, ["density"])
    cdf = full.withColumn("cdf", F.sum("density").over(Window.partitionBy("grp").orderBy("bin")))
    left, right = cdf.select(F.col("grp").alias("a"), "bin", F.col("cdf").alias("ca")), cdf.select(F.col("grp").alias("b"), "bin", F.col("cdf").alias("cb"))
    return left.join(right, "bin").where("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("ca") - F.col("cb"))).alias("distance"))


#: Knots of a quantile map, at most.
KNOTS = 1000


def quantile_knots(df: DataFrame, value: str, knots: int | None = None) -> list[float]:
    """Linear percentiles of a column at equal steps from 0 to 1, exact: min(KNOTS, rows) of them, or as many as given.

    Distinct values are counted and put in ranges of their order; only those at a wanted place come to the driver,
    two for each knot. Nulls and NaN do not count; without any value there are no knots.
    """
    counts = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranged = written(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("c").alias("n")).orderBy("part").collect()  # one row for each range
    n = sum(r["n"] for r in sizes)
    if not n:
        return []
    k = min(KNOTS, n) if knots is None else knots
    if k == 1 or n == 1:
        return [ranged.agg(F.min("v")).first()[0]] * k
    before, firsts = 0, []
    for r in sizes:
        firsts.append((r["part"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(firsts, "p int, offset long")
    rows = ranged.join(F.broadcast(offsets), F.col("part") == F.col("p"))
    rows = rows.withColumn("b", F.col("offset") + F.sum("c").over(Window.partitionBy("part").orderBy("v")) - F.col("c"))
    # Knot i lies at place i (n - 1) / (k - 1): which knots have their lower and upper neighbour among the places b to b + c - 1?
    last = f"(b + c - 1) * {k - 1}L"
    low = f"sequence((b * {k - 1}L + {n - 2}L) div {n - 1}L, ((b + c) * {k - 1}L - 1) div {n - 1}L)"
    high = f"sequence(if(b = 0, 0L, (b - 1) * {k - 1}L div {n - 1}L + 1), {last} div {n - 1}L)"
    wanted = lambda seq, ok, name: rows.where(ok).select(F.explode(F.expr(seq)).alias("i"), "v", F.lit(name).alias("side"))
    has_low = f"(b * {k - 1}L + {n - 2}L) div {n - 1}L <= ((b + c) * {k - 1}L - 1) div {n - 1}L"
    has_high = f"if(b = 0, 0L, (b - 1) * {k - 1}L div {n - 1}L + 1) <= {last} div {n - 1}L"
    found = wanted(low, has_low, 0).union(wanted(high, has_high, 1)).where(f"i < {k}").collect()
    ends = [[0.0, 0.0] for _ in range(k)]
    for r in found:
        ends[r["i"]][r["side"]] = r["v"]
    part = lambda i: (i * (n - 1) % (k - 1)) / (k - 1)
    return [lo + (hi - lo) * part(i) for i, (lo, hi) in enumerate(ends)]


def quantile_place(value: Column, knots: list[float]) -> Column:
    """The value's place among knots as a share: 0 at or below the least, else 1 at or above the greatest, the middle of equal knots; null for null, NaN or no knots."""
    if not knots:
        return F.lit(None).cast("double")
    x = np.array(knots, float)
    p = np.linspace(0, 1, len(x)) if len(x) > 1 else np.array([0.5])

    @F.pandas_udf(DoubleType())
    def place(v: pd.Series) -> pd.Series:
        v = v.to_numpy(float)
        out = 0.5 * (np.interp(v, x, p) - np.interp(-v, -x[::-1], -p[::-1]))
        # Where all knots are equal, the lower end counts.
        out[v >= x[-1]] = 1.0
        out[v <= x[0]] = 0.0
        return pd.Series(out).where(~np.isnan(v), None)

    return place(value.cast("double"))


def quantile_map(df: DataFrame, value: str, out: str, knots: int | None = None) -> DataFrame:
    """Adds out: the value's place between the column's own percentiles; see quantile_knots and quantile_place."""
    return df.withColumn(out, quantile_place(F.col(value), quantile_knots(df, value, knots)))


def group_quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, q_0, q_1, ...): linear percentiles of each group, exact. Distinct values are counted, and numbered by ranges of the order of group and value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running_total(counts, [F.col("__g"), F.col("__v")], "__c", "__b")
    ends = placed.groupBy(F.col("__g").alias("__h")).agg(F.sum("__c").alias("__n"), F.min("__b").alias("__first"))
    rows = with_groups(placed, ends, "__g", "__h")
    b = F.col("__b") - F.col("__first")
    at = lambda place: F.max(F.when((b <= place) & (place < b + F.col("__c")), F.col("__v")))
    picked, made = [], []
    for k, s in enumerate(shares):
        place = F.lit(s) * (F.col("__n") - 1)
        picked += [at(F.floor(place)).alias(f"__lo{k}"), at(F.ceil(place)).alias(f"__hi{k}"), F.max(place - F.floor(place)).alias(f"__part{k}")]
        made.append((F.col(f"__lo{k}") + (F.col(f"__hi{k}") - F.col(f"__lo{k}")) * F.col(f"__part{k}")).alias(f"q_{k}"))
    return rows.groupBy("__g").agg(*picked).select(F.col("__g").alias(group), *made)


def rater_variance(df: DataFrame, item: str, rating: str) -> DataFrame:
    """(var, n, fraction, cdf): sample variance of an item's ratings, rounded to 3 digits."""
    var = df.groupBy(item).agg(F.var_samp(rating).alias("v")).where("v is not null").select(F.round("v", 3).alias("var"))
    counts = var.groupBy("var").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("fraction", share).withColumn("cdf", F.sum("fraction").over(Window.orderBy("var")))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-30, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_tail(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x = dof / (dof + t * t)
    if x >= 1:
        return 1.0
    a, b = dof / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def paired_t_tests(df: DataFrame, group: str, value: str, key: str, seed: int = 123) -> DataFrame:
    """(a, b, n, t, p) for all ordered pairs of groups, each cut to the smaller size by a seeded order of a key without repeats and paired by place in it.

    Groups are few; rows are numbered by ranges of their order, not group by group in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("grp"), F.col(value).alias("value"), seeded(seed, key).alias("o"), F.col(key).alias("id"))
    placed = global_places(rows, [F.col("grp"), F.col("o"), F.col("id")], "at")
    first = placed.groupBy(F.col("grp").alias("g")).agg(F.min("at").alias("first"))
    rows = with_groups(placed, first, "grp", "g").select("grp", "value", (F.col("at") - F.col("first")).alias("rn"))
    left, right = rows.select(F.col("grp").alias("a"), "rn", F.col("value").alias("x")), rows.select(F.col("grp").alias("b"), "rn", F.col("value").alias("y"))
    d = F.col("x") - F.col("y")
    pairs = left.join(right, "rn").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    stats = pairs.select("a", "b", "n", F.try_divide("m", F.col("s") / F.sqrt("n")).alias("t"))

    def tails(batches):
        for pdf in batches:
            pdf["p"] = [t_tail(t, n - 1) if n > 1 and t == t else None for t, n in zip(pdf.t, pdf.n)]
            yield pdf

    return stats.mapInPandas(tails, "a string, b string, n long, t double, p double")


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The power transform of any numbers."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: Column) -> Column:
    """The power transform of positive numbers."""
    return F.when(F.abs(lam) < 1e-9, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def _power_of(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """box_cox of arrays."""
    none = np.abs(lam) < 1e-9
    if not none.any():
        return (np.power(x, lam) - 1) / lam
    return np.where(none, np.log(x), (np.power(x, lam) - 1) / np.where(none, 1.0, lam))


def _power_of_any(x: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """yeo_johnson of arrays."""
    up, out = x >= 0, np.empty(len(x))
    out[up], out[~up] = _power_of(x[up] + 1, lam[up]), -_power_of(1 - x[~up], 2 - lam[~up])
    return out


#: A transform, the same of arrays, what a value adds to the logarithm of its slope for each unit of lambda over 1, and the values it takes.
TRANSFORMS = {
    "yeo_johnson": (yeo_johnson, _power_of_any, lambda x: np.sign(x) * np.log1p(np.abs(x)), lambda x: F.lit(True)),
    "box_cox": (box_cox, _power_of, np.log, lambda x: x > 0),
}
#: First share of the central places on either side of the middle, and by how much it widens.
CENTRAL, WIDER = 0.34, 0.025


def central_values(df: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(groups, rows): groups(id, grp), and rows(id, v, w), the distinct values at the central places of each group's order with how many of those places each holds.

    The places widen until they hold two different values; groups without have no rows. Values are counted, and
    numbered by ranges of the order of all groups; a group's rows are never brought together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    placed = written(running_total(counts, [F.col("grp"), F.col("v")], "c", "b"))
    groups = written(placed.groupBy("grp").agg(F.min("b").alias("first"), F.sum("c").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    middle = F.when(F.col("n") % 2 == 1, F.bround(F.col("n") / 2, 0)).otherwise((F.col("n") + 1) / 2)
    share, tries = CENTRAL, []
    while True:
        reach = F.bround(F.lit(share) * middle, 0)
        tries.append(F.struct((F.col("first") + F.greatest(F.lit(0), F.ceil(middle - reach)).cast("long")).alias("lo"), (F.col("first") + F.least(F.col("n") - 1, F.floor(middle + reach) + 1).cast("long")).alias("hi")))
        if share >= 1:
            break
        share += WIDER
    # Places are made once for each group, not for each row.
    ends = groups.select("id", "grp", F.array(*tries).alias("tries"))
    first = with_groups(placed, ends.select("id", F.col("grp").alias("g"), F.col("tries")[0]["lo"].alias("at")), "grp", "g")
    # One row for each group: the places of the value at its first try's lower end. Tries widen: the first that leaves these places holds two values.
    held = first.where((F.col("b") <= F.col("at")) & (F.col("at") < F.col("b") + F.col("c"))).select(F.col("id").alias("i"), F.col("b").alias("start"), (F.col("b") + F.col("c")).alias("end"))
    fit = F.get(F.filter("tries", lambda t: (t["lo"] < F.col("start")) | (t["hi"] >= F.col("end"))), F.lit(0))
    fits = ends.join(held, F.col("id") == F.col("i")).select("id", F.col("grp").alias("g"), fit.alias("t")).where("t is not null").select("id", "g", "t.lo", "t.hi")
    w = F.least(F.col("b") + F.col("c"), F.col("hi") + 1) - F.greatest("b", "lo")
    rows = with_groups(placed, fits, "grp", "g").where(w > 0).select("id", "v", w.alias("w"))
    # The central ranges hold all of these: dealt anew, as each row will be worked on for many lambdas.
    return groups.select("id", "grp"), written(rows.repartition("v", "id"))


def _moments(rows: DataFrame, groups: DataFrame, steps: list[float], transform: str) -> DataFrame:
    """(g, lam, mean, sd, likely) of rows(id, v, w) for each lambda `at` + step of groups(g, low, at): sums that can be merged, of the transform less its value at the group's least.

    Each Arrow batch is added up by group and lambda in numpy, and Spark adds up the batches.
    """
    _, power, slope, _ = TRANSFORMS[transform]

    def added(batches):
        for pdf in batches:
            v, w = pdf.v.to_numpy(), pdf.w.to_numpy(float)
            ids, first, which = np.unique(pdf.id.to_numpy(), return_index=True, return_inverse=True)
            total = lambda x: np.bincount(which, x, len(ids))
            at, low = pdf["at"].to_numpy()[first], pdf.low.to_numpy()[first]
            lams = [at + step for step in steps]
            zeros = [power(low, lam) for lam in lams]
            sums, squares = [], []
            for lam, zero in zip(lams, zeros):
                y = power(v, lam[which]) - zero[which]
                s = w * y
                sums.append(total(s))
                squares.append(total(s * y))
            n, slopes = (np.tile(total(x), len(steps)) for x in (w, w * slope(v)))
            yield pd.DataFrame({"g": np.tile(ids, len(steps)), "lam": np.concatenate(lams), "n": n, "s": np.concatenate(sums), "q": np.concatenate(squares), "slope": slopes, "zero": np.concatenate(zeros)})

    each = with_groups(rows, groups, "id", "g").select("id", "v", "w", "low", "at").mapInPandas(added, "g long, lam double, n double, s double, q double, slope double, zero double")
    sums = each.groupBy("g", "lam").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q", "slope")), F.max("zero").alias("zero"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-300))
    return sums.select("g", "lam", (mean + F.col("zero")).alias("mean"), F.sqrt(var).alias("sd"), (-F.col("n") / 2 * F.log(var) + (F.col("lam") - 1) * F.col("slope")).alias("likely"))


def fitted_power(rows: DataFrame, lows: DataFrame, transform: str = "yeo_johnson", refine: int = 3) -> DataFrame:
    """(g, lam, mean, sd): for each group of rows(id, v, w) and lows(g, low) the likeliest lambda of -2, -1.9, ... 4, then of ever finer steps around it, and the moments there. Each round is one aggregate."""
    best = lambda m: written(m.groupBy("g").agg(F.max_by(F.struct("lam", "mean", "sd"), F.struct("likely", -F.abs("lam"))).alias("b")).select("g", "b.lam", "b.mean", "b.sd"))
    found = best(_moments(rows, lows.withColumn("at", F.lit(0.0)), [round(i / 10 - 2, 1) for i in range(61)], transform))
    for k in range(refine):
        near = lows.join(found.select(F.col("g").alias("h"), F.col("lam").alias("at")), F.col("g") == F.col("h")).select("g", "low", "at")
        found = best(_moments(rows, near, [i * 10.0 ** -(k + 2) for i in range(-10, 11)], transform))
    return found


def sigma_ranges(df: DataFrame, group: str, value: str, k: float = 1.0, transform: str = "yeo_johnson", lam: float | None = None, refine: int = 3) -> DataFrame:
    """(grp, low, high): the range of the central values within k sigmas after a power transform, to one digit.

    The lambda is given or the likeliest, see fitted_power. Box-Cox takes positive values alone. Nulls do not
    count, a group of one value has no range, a null group is one.
    """
    power, *_, takes = TRANSFORMS[transform]
    groups, rows = central_values(df.where(takes(F.col(value).cast("double"))), group, value)
    lows = written(rows.groupBy(F.col("id").alias("g")).agg(F.min("v").alias("low")))
    if lam is None:
        fit = fitted_power(rows, lows, transform, refine)
    else:
        fit = _moments(rows, lows.withColumn("at", F.lit(0.0)), [float(lam)], transform)
    z = F.abs(power(F.col("v"), F.col("lam")) - F.col("mean")) / F.col("sd")
    kept = with_groups(rows, fit.select("g", "lam", "mean", "sd"), "id", "g").where(z <= k)
    ends = kept.groupBy("g").agg(F.round(F.min("v"), 1).alias("low"), F.round(F.max("v"), 1).alias("high"))
    return with_groups(ends, groups, "g", "id").select("grp", "low", "high")


def range_text(low: Column, high: Column) -> Column:
    """A range as text, '' without one."""
    return F.coalesce(F.concat_ws(" - ", F.when(high.isNotNull(), low.cast("string")), F.when(low.isNotNull(), high.cast("string"))), F.lit(""))


def rater_table(df: DataFrame, item: str, rater: str, rating: str, raters: list[str]) -> DataFrame:
    """One row for each item, one column for each rater with its mean rating."""
    return df.groupBy(item).pivot(rater, raters).agg(F.avg(rating))


def rater_crosstabs(df: DataFrame, item: str, rater: str, rating: str) -> DataFrame:
    """(a, b, rating_a, rating_b, n): how two raters, a before b, rated the same items."""
    one = df.select(item, F.col(rater).alias("a"), F.col(rating).alias("rating_a"))
    two = df.select(item, F.col(rater).alias("b"), F.col(rating).alias("rating_b"))
    return one.join(two, item).where("a < b").groupBy("a", "b", "rating_a", "rating_b").agg(F.count(F.lit(1)).alias("n"))


def agreed_items(df: DataFrame, item: str, rating: str, below: float = 1.0) -> DataFrame:
    """(item, variance): items with two ratings at least whose sample variance is less than `below`; whole numbers are compared exactly."""
    whole = isinstance(df.schema[rating].dataType, IntegralType)
    x = F.col(rating).cast("decimal(19,0)" if whole else "double")
    sums = df.where(x.isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("__n"), F.sum(x).alias("__s"), F.sum(x * x).alias("__q"))
    spread, pairs = F.col("__n") * F.col("__q") - F.col("__s") * F.col("__s"), F.col("__n") * (F.col("__n") - 1)
    limit = F.lit(Decimal(str(below))) if whole else F.lit(below)
    return sums.where((F.col("__n") > 1) & (spread < limit * pairs)).select(item, (spread.cast("double") / pairs).alias("variance"))


def list_stats(scores: Column) -> dict[str, Column]:
    """Least, greatest and mean of a list; null without scores."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return {"least": F.array_min(scores), "greatest": F.array_max(scores), "mean": F.try_divide(total, F.size(scores))}


def evaluate(df: DataFrame, predict, label: str, labels: list[int]) -> tuple[DataFrame, DataFrame]:
    """(crosstab, agreement) of predict(df), a column, with a label column."""
    rows = df.withColumn("__pred", predict(df))
    return crosstab(rows, "__pred", label, labels), agreement(rows, F.col("__pred"), F.col(label))


def latency(run, rows: list, clock=time.perf_counter) -> dict[str, float]:
    """Mean, median, least and greatest milliseconds of run(row), one call for each row, on the driver."""
    took = []
    for r in rows:
        began = clock()
        run(r)
        took.append((clock() - began) * 1000)
    return {"mean": statistics.mean(took), "median": statistics.median(took), "min": min(took), "max": max(took)}
