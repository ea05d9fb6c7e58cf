"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The texts of a source are laid end to end in a seeded order and cut into blocks of equally many words.
Blocks are seats: they go to the sources one after another by the highest quotient target / (2 k + 1)
for the k-th seat, and each output shard takes the next equal run of seats, so that every source has a
whole quota in every shard. A source fills its seats lap by lap: each lap goes through its blocks in
a seeded order of its own, so that no block is taken twice before all were taken once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, table, trimmed

#: Weights of the sources in the order of their names, repeated; share of all words that is mixed; laps at most.
WEIGHTS, SHARE, LAPS = (3.0, 1.0, 2.0), 1.5, 2
#: Words of a block at most, and blocks that the smallest target is to have at least; shards of the mix.
BLOCK, FINE, SHARDS = 1024, 500, 16
SEED = 20240311
#: Divisors tried at once, and seats that may be left to rank by quotient.
TRIED, LEFT = 64, 4096
#: Blocks in hand at once.
CHUNK = 1 << 20

SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """How many maximal runs without ASCII white space; 0 for null. Each run and the space before it become one letter, which keeps long texts cheap."""
    marks = F.regexp_replace(text, rf"[{SPACE}]*+[^{SPACE}]++", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(" \t\n\x0b\x0c\r"))), F.lit(0)).cast("long")


def _ranged(df: DataFrame, part: str, *order: Column) -> DataFrame:
    """df in ranges of an order, written, with the number of the range. The order of rows is settled by what is written."""
    return cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def source_weights(sizes: DataFrame, weights: Sequence[float] | dict = WEIGHTS) -> DataFrame:
    """(source, source_size, rank, weight) of sizes(source, size): sources by code point from rank 0, null last. weights: repeated along the ranks, or by name (without one: 0)."""
    order = F.col("source").asc_nulls_last()
    sums = _ranged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "part", order)
    # One row for each range.
    before = sums.groupBy(F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("c")).select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"))
    rows = sums.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).join(before, F.col("part") == F.col("p"))
    rows = rows.select("source", "source_size", (F.col("before") + F.col("place")).alias("rank"))
    if isinstance(weights, dict):
        named = F.create_map(*(F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v)))) if any(k is not None for k in weights) else F.lit(None).cast("map<string,double>")
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(F.try_element_at(named, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    else:
        weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    return cut(rows.withColumn("weight", weight))


def with_targets(sources: DataFrame, share: float = SHARE, laps: int = LAPS) -> DataFrame:
    """Adds target to sources(source_size, weight, ...): words by weight, none above `laps` times the source's size; the excess is shared out anew until none is above."""
    size, limit = F.col("source_size"), F.col("source_size") * laps
    held, level = -1, 0.0
    while True:
        full = F.col("weight") * level > limit
        row = sources.agg(
            F.sum(size).alias("all"),
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if row["n"] == held or not row["weight"]:
            break
        # As many words as the sources that are not full have to take, by their weight.
        held, level = row["n"], (share * (row["all"] or 0) - row["held"]) / row["weight"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double")))


def _seats(target: Column, most: Column, divisor: Column) -> Column:
    """Seats whose quotient target / (k + 1/2) is at or over the divisor, `most` at most."""
    return F.when(target <= 0, F.lit(0)).when(divisor <= 0, most).otherwise(F.least(most, F.floor(F.least(target / divisor + 0.5, most + 1.0)))).cast("long")


def block_words(sources: DataFrame) -> int:
    """Words of a block for sources(target, ...): BLOCK, or fewer so that the smallest target is FINE blocks."""
    least = sources.where("target >= 1").agg(F.min("target")).first()[0]
    return max(1, min(BLOCK, int(least or 1) // FINE))


def with_quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, laps: int = LAPS) -> DataFrame:
    """Adds blocks (of the source) and quotas (seats in shards 0 to i, for each i) to sources(rank, source_size, target, ...).

    The divisor that gives a house its number of seats is enclosed by trying many at once; the few seats
    between the two ends are ranked by quotient, equal ones by rank. What reaches the driver are sums by
    shard and divisor.
    """
    sources = cut(sources.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long")))
    most = F.col("blocks") * laps
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    houses = [round(total / block) * (i + 1) // shards for i in range(shards)]
    low, high = [0.0] * shards, [float("inf")] * shards  # low gives as many seats or more, high as many or fewer
    tried = [[0.0, *(total / h * 2.0**j for j in range(-TRIED // 2, TRIED // 2))] if h else [] for h in houses]
    while any(tried):
        flat = [(i, d) for i, ds in enumerate(tried) for d in ds]
        each = sources.select("target", most.alias("m"), F.posexplode(F.array(*(F.lit(d) for _, d in flat))).alias("at", "d"))
        found = {r["at"]: r["n"] for r in each.groupBy("at").agg(F.sum(_seats(F.col("target"), F.col("m"), F.col("d"))).alias("n")).collect()}
        given = [{d: found[at] for at, (j, d) in enumerate(flat) if j == i} for i in range(shards)]
        for i, seats in enumerate(given):
            if seats:
                low[i] = max((d for d, n in seats.items() if n >= houses[i]), default=low[i])
                # Where a divisor gives the very number, no seat is left to rank.
                high[i] = low[i] if seats.get(low[i]) == houses[i] else min((d for d, n in seats.items() if n <= houses[i] and d > low[i]), default=high[i])
        tried = [
            [] if not seats or high[i] == low[i] or high[i] == float("inf") or seats[low[i]] - seats[high[i]] <= LEFT or np.nextafter(low[i], high[i]) >= high[i]
            else [low[i], high[i], *np.linspace(low[i], high[i], TRIED)[1:-1].tolist()]
            for i, seats in enumerate(given)
        ]
    ends = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(h).alias("house"), _seats(F.col("target"), most, F.lit(a) if h else F.lit(float("inf"))).alias("a"), _seats(F.col("target"), most, F.lit(b)).alias("b")) for i, (h, a, b) in enumerate(zip(houses, low, high))))
    rows = sources.withColumn("ends", ends)
    sure = rows.agg(*(F.sum(F.get("ends", F.lit(i))["b"]).alias(f"b{i}") for i in range(shards))).first()
    left = F.array(*(F.lit(h - (sure[f"b{i}"] or 0)).cast("long") for i, h in enumerate(houses)))
    open_seats = rows.select("rank", "target", F.explode("ends").alias("e")).where("e.a > e.b").select("rank", F.col("e.i").alias("i"), F.explode(F.sequence("e.b", F.col("e.a") - 1)).alias("k"), "target")
    place = F.row_number().over(Window.partitionBy("i").orderBy((F.col("target") / (F.col("k") + 0.5)).desc(), "rank", "k"))
    won = open_seats.withColumn("place", place).where(F.col("place") <= F.get(left, F.col("i"))).groupBy("rank", "i").agg(F.count(F.lit(1)).alias("c"))
    won = won.groupBy(F.col("rank").alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("won"))
    quotas = F.transform("ends", lambda e: e["b"] + F.coalesce(F.try_element_at("won", e["i"]), F.lit(0)))
    return cut(rows.join(won, F.col("rank") == F.col("r"), "left").withColumn("quotas", quotas).drop("ends", "won", "r"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits with every bit changed by every other (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Numbers x below n, each mapped by the permutation of 0 to n - 1 that its key draws (swap-or-not)."""
    x, n = x.astype(np.int64), n.astype(np.int64)
    for i in range(rounds):
        k = _mixed(key + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        other = (k % n.astype(np.uint64)).astype(np.int64) - x
        other += n * (other < 0)
        bit = _mixed(np.maximum(x, other).astype(np.uint64) ^ k) & np.uint64(1)
        x = np.where(bit == 1, other, x)
    return x


def lap_keys(seed: int, rank: np.ndarray, lap: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(rank.astype(np.uint64) + np.uint64(seed)) + lap.astype(np.uint64))


PIECES = "array<struct<shard: int, seat: long, lap: int, first: long, words: long>>"


def _taker(block: int, seed: int, laps: int, pieces: bool) -> Callable:
    """Rows (..., size, start, rank, blocks, quotas) to the first columns with taken, and pieces if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            size, start, rank, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "start", "rank", "blocks"))
            quotas = np.maximum.accumulate(batch.column("quotas").flatten().to_numpy().reshape(batch.num_rows, -1), axis=1)
            first = start // block
            ends = np.cumsum(np.where(size > 0, (start + size - 1) // block - first + 1, 0))
            taken, parts = np.zeros(batch.num_rows, np.int64), []
            for at in range(0, int(ends[-1]) if len(ends) else 0, CHUNK):
                flat = np.arange(at, min(at + CHUNK, int(ends[-1])))
                row = np.searchsorted(ends, flat, "right")
                number = first[row] + flat - (ends[row - 1] * (row > 0))
                begins, stops = np.maximum(start[row], number * block), np.minimum(start[row] + size[row], (number + 1) * block)
                for lap in range(laps):
                    # A lap that is filled whole needs its order only to say which shard a block goes to.
                    full = quotas[row, -1] >= (lap + 1) * blocks[row]
                    seat = np.full(len(row), -1)
                    todo = np.flatnonzero((quotas[row, -1] > lap * blocks[row]) & (pieces | ~full))
                    seat[todo] = lap * blocks[row[todo]] + permuted(number[todo], blocks[row[todo]], lap_keys(seed, rank[row[todo]], np.full(len(todo), lap)))
                    held = full | ((seat >= 0) & (seat < quotas[row, -1]))
                    np.add.at(taken, row[held], (stops - begins)[held])
                    if pieces:
                        r = row[held]
                        parts.append((r, (quotas[r] <= seat[held, None]).sum(1), seat[held], np.full(len(r), lap), (begins - start[row])[held], (stops - begins)[held]))
            kept = [c for c in batch.schema.names if c not in ("start", "rank", "blocks", "quotas")]
            arrays, names = [*(batch.column(c) for c in kept), pa.array(taken)], [*kept, "taken"]
            if pieces:
                r, *cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 6
                order = np.argsort(r, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=batch.num_rows))])
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                inner = pa.StructArray.from_arrays([pa.array(c[order], t) for c, t in zip(cols, types)], names=["shard", "seat", "lap", "first", "words"])
                arrays, names = [*arrays, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], [*names, "pieces"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def mix(docs: DataFrame, weights: Sequence[float] | dict = WEIGHTS, share: float = SHARE, laps: int = LAPS, block: int | None = None, shards: int = SHARDS, seed: int = SEED, pieces: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """What a mix takes of each row of docs(doc_id, source, text, ...).

    Returns doc_id, size (words), source_size (words of its source), target (words that its source is to
    give) and taken (words that are taken, repeats counted: at most `laps` times the size); with pieces
    also the runs of words taken, as shard, seat, lap, first word and words; and the columns to keep. A source
    comes within two blocks of its target; without a size given, see block_words. A null text has no words, null sources are one source,
    repeated rows are rows of their own, an empty table gives no rows, other columns are ignored. The
    same rows and seed give the same mix on any number of partitions.
    """
    kept = [F.col(c) for c in keep if c not in ("doc_id", "source")]
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *kept))
    sources = cut(with_targets(source_weights(sized, weights), share, laps))
    block = block or block_words(sources)
    sources = with_quotas(sources, block, shards, laps)
    order = [F.col("source").asc_nulls_last(), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), F.col("size")]
    p = free_prefix(sized)
    # Equal rows may change places: a number parts them, so that no range has to hold all copies of one.
    rows = _ranged(sized.withColumn(f"{p}copy", F.monotonically_increasing_id()), f"{p}part", *order, F.col(f"{p}copy"))
    each = rows.groupBy(F.col(f"{p}part").alias("p"), F.col("source").alias("s")).agg(F.sum("size").alias("words"))
    base = F.sum("words").over(Window.partitionBy("s").orderBy("p")) - F.col("words")  # a row for each range that a source lies in
    each = each.withColumn("base", base).join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    within = F.sum("size").over(Window.partitionBy(f"{p}part", "source").orderBy(*order, f"{p}copy").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn(f"{p}within", within).join(each, (F.col(f"{p}part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rows = rows.select("doc_id", "size", "source_size", "target", *kept, (F.col("base") + F.col(f"{p}within")).alias("start"), "rank", "blocks", "quotas")
    kinds = {**dict(docs.dtypes), "size": "long", "source_size": "long", "target": "double"}
    out = [c for c in rows.columns if c not in ("start", "rank", "blocks", "quotas")]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out) + ", taken long" + (f", pieces {PIECES}" if pieces else "")
    return rows.mapInArrow(_taker(block, seed, laps, pieces), schema)


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """(shard, seat, doc_id, first, text): the mix of docs(doc_id, source, text, ...) itself, one row for each run of words, joined by single spaces; see mix."""
    rows = cut(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id()))
    plan = mix(rows, pieces=True, keep=["row"], **how).where("taken > 0").select(F.col("row").alias("r"), "pieces")
    words = F.split(F.trim(F.regexp_replace("text", f"[{SPACE}]+", " ")), " ")
    joined = rows.join(plan, F.col("row") == F.col("r")).select("doc_id", words.alias("w"), F.explode("pieces").alias("p"))
    return joined.select("p.shard", "p.seat", "doc_id", "p.first", F.array_join(F.slice("w", (F.col("p.first") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("text"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
