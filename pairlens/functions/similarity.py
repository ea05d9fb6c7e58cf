"""Similarity of strings, sets and vectors as Column functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def levenshtein_factor(a: Column, b: Column) -> Column:
    """(longer length - edits) / longer length; null for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.try_divide((longest - F.levenshtein(a, b)).cast("double"), longest)


def _codes(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one row each, and their lengths."""
    size = texts.str.len().to_numpy(np.int64)
    out = np.zeros((len(texts), max(int(size.max(initial=0)), 1)), np.uint32)
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = joined
    return out, size


def _common_runs(a: pd.Series, b: pd.Series) -> list[str]:
    """The longest common substring of each pair, by the usual table, a row of it at a time for all pairs."""
    (x, n), (y, m) = _codes(a), _codes(b)
    x, y = np.where(np.arange(x.shape[1]) < n[:, None], x, 0xFFFFFFFF), np.where(np.arange(y.shape[1]) < m[:, None], y, 0xFFFFFFFE)
    run = np.zeros((len(x), y.shape[1] + 1), np.int32)
    best, end = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        run[:, 1:] = np.where(y == x[:, i : i + 1], run[:, :-1] + 1, 0)
        now = run.max(axis=1)
        longer = now > best
        best[longer], end[longer] = now[longer], i + 1
    return [t[e - k : e] for t, e, k in zip(a, end, best)]


#: Cells of the table that are worked on at once.
CELLS = 1 << 22


@F.pandas_udf(StringType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest substring of both; of equal lengths the first in a; null for a null. Pairs of like lengths are compared together."""
    out = pd.Series([None] * len(a), dtype=object)
    held = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
    if not len(held):
        return out
    size = a.iloc[held].str.len().to_numpy(np.int64) << 32 | b.iloc[held].str.len().to_numpy(np.int64)
    held = held[np.argsort(size, kind="stable")]
    at = 0
    while at < len(held):
        width = int(b.iloc[held[at]].__len__()) + 1
        part = held[at : at + max(1, CELLS // width)]
        widest = int(b.iloc[part].str.len().max()) + 1
        part = part[: max(1, CELLS // widest)]
        out.iloc[part] = _common_runs(a.iloc[part], b.iloc[part])
        at += len(part)
    return out


def substring_factor(substring: Column, a: Column, b: Column) -> Column:
    """The common substring's share of the shorter text; null for an empty one."""
    return F.try_divide(F.length(substring).cast("double"), F.least(F.length(a), F.length(b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


#: Scaling functions of counts.
SCALES = {"sqrt": F.sqrt, "identity": lambda c: c.cast("double"), "fourth_root": lambda c: F.pow(c, F.lit(0.25)), "one_hot": lambda c: F.when(c > 1e-3, 1.0).otherwise(0.0)}


def quantile_class(quantile: Column, confidence: Column, thresholds: tuple[float, ...] = (0.1, 0.3, 0.7, 0.9)) -> Column:
    """1 + thresholds at or below the quantile; 1 for a null or NaN quantile or confidence up to 0.01."""
    steps = sum(((F.lit(t) <= quantile).cast("int") for t in thresholds), F.lit(1))
    return F.when(quantile.isNull() | F.isnan(quantile) | (confidence <= 0.01), 1).otherwise(steps)


def threshold_bucket(score: Column) -> Column:
    """Fifths as 1 to 5; the inner edges themselves fall to 5."""
    out = F.when((score >= 0) & (score < 0.2), 1)
    for k, (lo, hi) in enumerate(((0.2, 0.4), (0.4, 0.6), (0.6, 0.8)), 2):
        out = out.when((score > lo) & (score < hi), k)
    return out.otherwise(5)


def composite(parts: list[tuple[Column, Column, float]]) -> tuple[Column, Column]:
    """(score, confidence) of (quantile, confidence, importance) parts: weights are roots of confidence times importance, set to sum to 1."""
    total = sum(i for _, _, i in parts)
    floored = [F.greatest(c, F.lit(1e-5)) for _, c, _ in parts]
    raw = [F.pow(c * (i / total), F.lit(1.0 if i / total == 1 else 0.5)) for c, (_, _, i) in zip(floored, parts)]
    norm = F.greatest(sum(raw[1:], raw[0]), F.lit(1e-5))
    score = [w / norm * q for w, (q, _, _) in zip(raw, parts)]
    return sum(score[1:], score[0]), sum(floored[1:], floored[0]) / len(parts)


def importance_grid(n: int, steps: int = 20) -> list[tuple[float, ...]]:
    """Every tuple of n importances, multiples of 1 / steps, that sum to 1."""
    def rest(n: int, left: int) -> list[tuple[float, ...]]:
        return [(left / steps,)] if n == 1 else [(k / steps, *r) for k in range(left + 1) for r in rest(n - 1, left - k)]

    return rest(n, steps)


def bayes(b_given_a: Column, a: Column, b: Column) -> Column:
    """P(a given b)."""
    return F.try_divide(b_given_a * a, b)


def votes(*flags: Column, least: int = 3) -> Column:
    """Whether at least so many voters say yes; a null is no vote."""
    return sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0)) >= least


def update_importance(values: list[float], index: int, value: float) -> list[float]:
    """Set one importance and scale the others so that all sum to 1."""
    others = sum(v for i, v in enumerate(values) if i != index)
    out = [value if i == index else (v * (1 - value) / others if others else 0.0) for i, v in enumerate(values)]
    total = sum(out)
    return [v / total for v in out]


def generation_score(exact: Column, chains: Column, pool: Column, n_skills: Column, decay: float = 1.0, compat: bool = True) -> Column:
    """(exact + sum of exp(-decay * generation)) / skills; generation is the 1-based place of a chain's first element in pool. With compat an unmatched chain counts in full."""

    def gen(chain: Column) -> Column:
        return F.coalesce(F.array_min(F.filter(F.transform(chain, lambda x, i: F.when(F.array_contains(pool, x), i + 1)), lambda x: x.isNotNull())), F.lit(0))

    def credit(chain: Column) -> Column:
        g = gen(chain)
        return F.exp(-F.lit(decay) * g) if compat else F.when(g > 0, F.exp(-F.lit(decay) * g)).otherwise(0.0)

    partial = F.aggregate(F.transform(chains, credit), F.lit(0.0), lambda s, x: s + x)
    return F.when(n_skills > 0, (exact + partial) / n_skills).otherwise(0.0)
