"""What the operators of this package share: cutting lineage, table access and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return a frame that reads it back, see written: a lost executor does not lose the data."""
    return written(df)


#: Bytes of text that a Python worker has in hand at once; at least one text.
CHUNK = 1 << 20


def byte_chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts as UTF-8) for runs of up to CHUNK bytes of an Arrow column of strings; null is as empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHUNK:
            yield start, _raw(column.slice(start, i - start))
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, _raw(column.slice(start))


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last, memory that a reused worker would keep from it goes back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call, and needs none
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _state(edges: DataFrame) -> tuple:
    """Two numbers that change when the set of edges does."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("x"),
    ).first()
    return row["n"], row["x"]


#: A filter of WORDS longs (1 MB), whatever the input, says which hashes may be in a set.
WORDS = 1 << 17


def bits_of(hashes: DataFrame, column: str = "h") -> DataFrame:
    """One row, one array of WORDS longs: a bit is set if a hash of the column has its place."""
    place = f"({column} & {WORDS * 64 - 1})"
    held = hashes.selectExpr(f"shiftright({place}, 6) as w", f"shiftleft(1L, cast({place} & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b")).union(held).groupBy("w").agg(F.bit_or("b").alias("b"))
    return cut(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x.b).alias("bits")))


def may_hold(bits: DataFrame, column: str) -> Column:
    """Whether the hash in column may be in the set that bits_of made; never false for one that is."""
    word = F.get(bits.scalar(), F.expr(f"cast(shiftright({column} & {WORDS * 64 - 1}, 6) as int)"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")) != 0


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column name of df begins with, in any case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs, as (node, component).

    component is the smallest node that can be reached. Alternates large-star and small-star steps
    until nothing changes, which takes a number of rounds logarithmic in the longest path. Each step
    is an aggregation that combines before the shuffle and an inner join that can be split, so a hub
    with very many edges does not land in one task. Edges with a null end or equal ends are ignored.
    No edges give no rows. The steps go on until nothing changes, however many that takes.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(now.where("a is not null and b is not null and a <> b").distinct())
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large["a"] == low["k"]).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        now = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
