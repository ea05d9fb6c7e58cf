"""Pairs of two large sides: all cosines by tiles, and texts whose pairs below a threshold are never made."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.similarity import longest_common_substring
from .relational import written

#: Least and greatest number of rows of a tile on either side, blocks of a side between them, scores that a task has in hand, and those it gives away at once.
TILE, WIDEST, BLOCKS, CELLS, GIVEN = 1024, 16384, 8, 1 << 22, 1 << 18


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _tiles(left: DataFrame, right: DataFrame, key: str, vector: str, tile: int | None) -> GroupedData:
    """(k, v, second) of both sides by pairs of their blocks (i, j); second says that a row is one of right."""
    if left.schema[vector].dataType != right.schema[vector].dataType:
        left, right = (df.withColumn(vector, F.col(vector).cast("array<double>")) for df in (left, right))

    def side(df: DataFrame, blocks: int, others: int, mine: str, other: str, flag: bool) -> DataFrame:
        # Sent as they are: a task makes doubles of them.
        rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
        return rows.select("k", "v", F.pmod(F.xxhash64("k"), F.lit(blocks)).alias(mine), F.lit(flag).alias("second"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    def blocks_of(df: DataFrame) -> int:
        rows = df.count()
        return max(1, -(-rows // (tile or min(WIDEST, max(TILE, -(-rows // BLOCKS))))))

    n, m = blocks_of(left), blocks_of(right)
    return side(left, n, m, "i", "j", False).unionByName(side(right, m, n, "j", "i", True)).groupBy("i", "j")


def _scores(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left keys, right keys in order, scores) of a tile, so many cells at once, or one left row."""
    pdf = pd.concat(batches)
    a, b = pdf[~pdf.second], pdf[pdf.second].sort_values("k")
    if not len(a) or not len(b):
        return
    second, rights, step = _unit(np.stack(b.v.to_numpy()).astype(float)).T, b.k.to_numpy(), max(1, cells // len(b))
    for at in range(0, len(a), step):
        yield a.k.to_numpy()[at : at + step], rights, _unit(np.stack(a.v.to_numpy()[at : at + step]).astype(float)) @ second


def cosine_matrix(left: DataFrame, right: DataFrame, key: str, vector: str, top: int | None = None, tile: int | None = None) -> DataFrame:
    """(left, right, score): the cosine of every row of left with every row of right, both (key, vector) with vectors of one length.

    Rows of each side are dealt to blocks, and each pair of blocks is one task's matrix product, some left rows
    at a time. A row is sent once for each block of the other side: blocks are wide, see TILE, where no tile is
    given. With top only the best so many of each left row stay (of equal ones the smaller right key), first in each tile and
    then of all tiles. Keys should not repeat. A vector that is null or holds a null is left out; one of zeros
    has cosine 0. Without top there are as many rows as cells, and a task holds GIVEN of them; for their sums see cosine_sums.
    """
    schema = StructType([StructField("left", left.schema[key].dataType), StructField("right", right.schema[key].dataType), StructField("score", DoubleType())])

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lefts, rights, scores in _scores(batches, GIVEN if top is None else CELLS):
            if top is None or top >= len(rights):
                yield pd.DataFrame({"left": np.repeat(lefts, len(rights)), "right": np.tile(rights, len(lefts)), "score": scores.ravel()})
                continue
            if np.isnan(scores).any():
                best = np.argsort(-scores, axis=1, kind="stable")[:, :top]
                yield pd.DataFrame({"left": np.repeat(lefts, top), "right": rights[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()})
                continue
            # All that reach the score of the last of the best: of equal ones there may be more.
            least = np.partition(scores, -top, axis=1)[:, -top]
            i, j = np.nonzero(scores >= least[:, None])
            yield pd.DataFrame({"left": lefts[i], "right": rights[j], "score": scores[i, j]}).sort_values(["left", "score", "right"], ascending=[True, False, True]).groupby("left", sort=False).head(top)

    cells = _tiles(left, right, key, vector, tile).applyInPandas(product, schema)
    if top is None:
        return cells
    place = F.row_number().over(Window.partitionBy("left").orderBy(F.desc("score"), "right"))
    return cells.withColumn("__n", place).where(F.col("__n") <= top).drop("__n")


def cosine_sums(left: DataFrame, right: DataFrame, key: str, vector: str, tile: int | None = None) -> DataFrame:
    """(left, cells, total, least): how many cells each left row has in cosine_matrix, their sum and the least of them.

    A tile gives one row for each of its left rows, so that cells never leave the task that makes them.
    """
    schema = StructType([StructField("left", left.schema[key].dataType), StructField("cells", LongType()), StructField("total", DoubleType()), StructField("least", DoubleType())])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lefts, rights, scores in _scores(batches, CELLS):
            # The least as Spark has it, where NaN is above all numbers.
            yield pd.DataFrame({"left": lefts, "cells": len(rights), "total": scores.sum(axis=1), "least": np.fmin.reduce(scores, axis=1)})

    tiles = _tiles(left, right, key, vector, tile).applyInPandas(sums, schema)
    return tiles.groupBy("left").agg(F.sum("cells").alias("cells"), F.sum("total").alias("total"), F.min("least").alias("least"))


def grams(text: Column, q: int) -> Column:
    """(gram, at) of each run of q code points of a text with q - 1 marks before and after it."""
    pad = F.lit("\0" * (q - 1))
    full = F.concat(pad, text, pad)
    return F.transform(F.sequence(F.lit(1), F.length(full) - q + 1), lambda i: F.struct(F.substring(full, i, F.lit(q)).alias("gram"), i.alias("at")))


#: Edits up to which pairs are found by what is left of a text without some code points, of the whole text or of a half; beyond them by rare grams.
WHOLE, HALVES = 2, 5


@lru_cache(maxsize=1024)
def _cuts(size: int, least: float) -> list[tuple[str, str, int, int, int]]:
    """(kind, role, start, stop, n): the parts of a text of a size, and how many of their code points go; two texts that are near enough, the longer one within HALVES edits, have what is left of a part of one kind in common.

    For each length that the longer text can have: within WHOLE edits both hold the same code points in order, all of the
    longer one but so many. Within HALVES the one's first half is so near a beginning of the other, or the second half an
    end, that half of the edits, rounded down, lead from one to the other.
    """
    out = set()
    for longest in range(size, int(size / least) + 2):
        edits = int(longest * (1 - least) + 1e-9)
        if longest - edits > size or edits > HALVES:
            continue
        if edits <= WHOLE:
            out.add(("", "", 0, size, size - longest + edits))
            continue
        half, some = longest // 2, edits // 2
        for end, long in (("<", half), (">", longest - half)):
            cut = lambda n: (0, n) if end == "<" else (max(size - n, 0), size)  # noqa: B023, E731
            for more in range(-some, some + 1):
                # The parts have long and long + more code points, and share all of the larger one but `some`.
                both = max(long, long + more) - some
                kind = f"{end}{longest}{more:+}"
                if longest == size:
                    out.add((kind, "a", *cut(long), long - both))
                if long + more <= size:
                    out.add((kind, "b", *cut(long + more), long + more - both))
    return sorted(x for x in out if x[4] <= x[3] - x[2])


@lru_cache(maxsize=1024)
def _kept(size: int, n: int) -> np.ndarray:
    return np.array(list(combinations(range(size), size - n)), int).reshape(-1, size - n)


#: Keys or pairs that a task makes at once.
STEP = 1 << 18


def _remains(texts: list[str], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, role, hash of kind and what is left), each once for a text, all texts of a size together. Roles are 0, or 1 and 2 for the longer text's half and the other's."""
    sizes, factor = np.array([len(t) for t in texts]), np.uint64(0x9E3779B97F4A7C15)
    for size in np.unique(sizes):
        cuts = _cuts(int(size), least)
        of_size = np.flatnonzero(sizes == size)
        step = max(1, STEP // max((len(_kept(stop - start, n)) for _, _, start, stop, n in cuts), default=1))
        for at in range(0, len(of_size), step):
            mine = of_size[at : at + step]
            codes = np.array([texts[i] for i in mine], f"U{size}").view(np.uint32).reshape(len(mine), size).astype(np.uint64)
            for kind, role, start, stop, n in cuts:
                kept = _kept(stop - start, n) + start
                h = np.full((len(mine), len(kept)), int.from_bytes(blake2b(kind.encode(), digest_size=8).digest()), np.uint64)
                for place in kept.T:
                    h = (h ^ codes[:, place]) * factor
                    h ^= h >> np.uint64(29)
                h.sort(axis=1)
                once = np.ones(h.shape, bool)
                once[:, 1:] = h[:, 1:] != h[:, :-1]
                yield np.repeat(mine, once.sum(axis=1)), np.full(int(once.sum()), " ab".index(role or " "), np.int8), h[once].view(np.int64)


def _edits(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, most: int) -> np.ndarray:
    """The edits between texts in columns of code points, of their sizes, if they are `most` or fewer; else some larger number."""
    over, pairs = most + 1, a.shape[1]
    row = [np.full(pairs, min(j, over), np.int8) for j in range(len(b) + 1)]
    out = np.where(sizes_a == 0, np.minimum(sizes_b, over), over).astype(np.int8)
    for i in range(1, len(a) + 1):
        before, row = row, [np.full(pairs, min(i, over), np.int8)] + [None] * len(b)
        beyond = np.full(pairs, over, np.int8)
        for j in range(1, len(b) + 1):
            if abs(i - j) > most:
                row[j] = beyond
                continue
            best = before[j - 1] + (a[i - 1] != b[j - 1])
            np.minimum(best, np.minimum(before[j], row[j - 1]) + np.int8(1), out=best)
            row[j] = np.minimum(best, np.int8(over), out=best)
        here = np.flatnonzero(sizes_a == i)
        for j in np.unique(sizes_b[here]):
            at = here[sizes_b[here] == j]
            out[at] = row[j][at]
    return out


def _near(texts: pa.Array, side: np.ndarray, role: np.ndarray, key: np.ndarray, least: float, one_side: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, edits) of the texts near enough among those of equal keys, which stand in the order of keys, roles and sides."""
    # Most keys are one text's alone.
    start = np.append(True, np.diff(key) != 0)
    met = ~(start & np.append(start[1:], True))
    if not met.any():
        return
    texts, side, role, key = texts.filter(pa.array(met)), side[met], role[met], key[met]
    words = texts.dictionary_encode()
    at, names = words.indices.to_numpy(), words.dictionary
    held = names.to_pylist()
    size = np.array([len(t) for t in held])
    codes = np.array(held, f"U{size.max()}").view(np.uint32).reshape(len(held), -1)
    codes = np.ascontiguousarray((codes.astype(np.uint8) if codes.max() < 256 else codes).T)
    rank = np.empty(len(held), int)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(held))
    # Roles: the longer text's half meets the other's beginning or end, whichever side it is on; whole texts have none.
    part = 8 * np.cumsum(np.append(0, np.diff(key) != 0)) + 2 * role + side
    place = np.arange(len(key))
    wanted = np.where(role == 2, -1, part + 2 * (role == 1) + (0 if one_side else 1 - 2 * side))
    if not one_side:
        wanted[(role == 0) & (side == 1)] = -1
    begin, end = np.searchsorted(part, wanted), np.searchsorted(part, wanted, "right")
    if one_side:
        begin = np.where(role == 0, place + 1, begin)
    others, first = end - begin, 0
    total = np.cumsum(others)
    while first < len(key):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + STEP, "right")))
        n = others[first:stop]
        i = np.repeat(place[first:stop], n)
        j = np.repeat(begin[first:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = stop
        fine = at[i] != at[j]
        i, j = i[fine], j[fine]
        turned = rank[at[i]] > rank[at[j]] if one_side else side[i] > side[j]
        a, b = np.where(turned, at[j], at[i]), np.where(turned, at[i], at[j])
        most = np.floor(np.maximum(size[a], size[b]) * (1 - least) + 1e-9).astype(int)
        fine = np.abs(size[a] - size[b]) <= most
        a, b, most = a[fine], b[fine], most[fine]
        if not len(a):
            continue
        pair = np.unique(a.astype(np.int64) * len(held) + b)
        a, b = pair // len(held), pair % len(held)
        most = np.floor(np.maximum(size[a], size[b]) * (1 - least) + 1e-9).astype(int)
        edits = _edits(codes[: size[a].max()][:, a], codes[: size[b].max()][:, b], size[a], size[b], int(most.max()))
        fine = edits <= most
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a[fine])), names.take(pa.array(b[fine])), pa.array(edits[fine].astype(np.int32))], ["a", "b", "edits"])


def _pairs_by_remains(texts: DataFrame, least: float, one_side: bool) -> DataFrame:
    """(a, b, edits): pairs of texts(t, side) near enough of which the longer one is within HALVES edits, some of them more than once."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, side = batch.column("t"), batch.column("side")
            for of, role, h in _remains(t.to_pylist(), least):
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([t.take(of), side.take(of), pa.array(role), pa.array(h)], ["t", "side", "role", "h"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wait = [], 0, STEP

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from _near(table["t"].combine_chunks(), *(table[c].to_numpy().astype(int) for c in ("side", "role", "h")), least, one_side)

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < wait:
                continue
            table = pa.Table.from_batches(held)
            # The last key may go on in the next batch.
            h = table["h"].to_numpy()
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield from done(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
            rows -= last
            wait = max(STEP, 2 * rows)
        if rows:
            yield from done(pa.Table.from_batches(held))

    # Dealt by number, as a few MB of texts become many keys and pairs, which tasks laid together by their input would make alone.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = texts.repartition(parts, "t").mapInArrow(keys_of, "t string, side int, role byte, h long")
    return made.repartition(parts, "h").sortWithinPartitions("h", "role", "side").mapInArrow(met, "a string, b string, edits int")


def _met(keys: DataFrame, key: str, one_side: bool) -> DataFrame:
    """keys(t, side, role, key) of the left with those of the right, or with themselves where a < b."""
    a, b = (keys.where(F.lit(one_side) | (F.col("side") == i)).select(F.col("t").alias(n), F.col("role").alias(f"r{n}"), key) for i, n in enumerate("ab"))
    return a.join(b, key).where((F.col("a") < F.col("b")) if one_side else (F.col("a") != F.col("b")))


def _pairs_by_grams(texts: DataFrame, least: float, one_side: bool, q: int) -> DataFrame:
    """(a, b): candidates of texts(t, side) that share one of their rarest grams."""
    rows = texts.select("t", "side", F.explode(grams(F.col("t"), q)).alias("g")).select("t", "side", "g.gram", "g.at")
    nth = F.row_number().over(Window.partitionBy("t", "side", "gram").orderBy("at"))
    rows = rows.withColumn("gram", F.concat_ws("\1", "gram", nth.cast("string")))
    common = rows.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.join(common, F.col("gram") == F.col("g")).withColumn("place", F.row_number().over(Window.partitionBy("t", "side").orderBy("n", "gram")))
    # So many of a text's rarest grams hold one that any text near enough has among its own.
    lead = ranked.where(F.col("place") <= F.floor(F.length("t") * (q * (1 - least)) + 1e-9) + 1).select("t", "side", "gram")
    return _met(lead.withColumn("role", F.lit("")), "gram", one_side).select("a", "b")


def similar_texts(left: DataFrame, right: DataFrame | None, text: str, least: float, q: int = 2) -> DataFrame:
    """(a, b, edits, factor): different texts of left and right, or of left alone with a < b, whose edits leave a share of at least `least` of the longer one.

    Only pairs that share something are made and then measured. Short texts, such as words, share what is left of them
    without a few code points: see _cuts. Of longer ones two so near share one of their rarest grams of q code points,
    equal grams of a text counted apart. Places are no filter, as a gram that goes moves the number of those after it.
    least must be over 1 - 1 / q. Equal texts of a side count once, and empty and null ones not at all.
    """
    if not 1 - 1 / q < least <= 1:
        raise ValueError("least must be over 1 - 1 / q, and 1 at most")

    def listed(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.col(text).alias("t"), F.lit(side).alias("side")).where("t <> ''").distinct()

    texts = written(listed(left, 0) if right is None else listed(left, 0).union(listed(right, 1)))
    most = lambda size: F.floor(size * (1 - least) + 1e-9)
    found = _pairs_by_remains(texts, least, right is None).distinct()
    longest = F.greatest(F.length("a"), F.length("b"))
    # Texts that have more edits, or may be so near one that has.
    far = texts.where(most(F.length("t") / least + 1) > HALVES)
    if not far.isEmpty():
        others = _pairs_by_grams(far, least, right is None, q).where(F.abs(F.length("a") - F.length("b")) <= most(longest)).distinct()
        found = found.union(others.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= most(longest))).distinct()
    return found.select("a", "b", "edits", ((longest - F.col("edits")) / longest).alias("factor"))


def common_substring_pairs(left: DataFrame, right: DataFrame | None, text: str, least: int) -> DataFrame:
    """(a, b, substr, substr_len): the longest common substring of each pair of texts of left and right, or of left alone with a < b, that share at least so many code points in a row.

    Pairs are made by the runs of that length that both hold, so that those that share less are never made.
    Equal texts of a side count once.
    """
    def runs(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(text).alias(name)).where(F.length(name) >= least).distinct()
        return rows.select(name, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - least + 1), lambda i: F.substring(F.col(name), i, F.lit(least))))).alias("run"))

    pairs = runs(left, "a").join(runs(left if right is None else right, "b"), "run")
    pairs = (pairs.where("a < b") if right is None else pairs).select("a", "b").distinct()
    out = pairs.withColumn("substr", longest_common_substring(F.col("a"), F.col("b")))
    return out.withColumn("substr_len", F.length("substr").cast("long"))
