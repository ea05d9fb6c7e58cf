"""Keyed projections, joins with an explicit policy for what does not match, lookup and top-k."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keyed_map(df: DataFrame, fn: Callable[..., Column | tuple], keys: list[str] | dict) -> DataFrame:
    """Apply fn to columns. A list replaces in place; a dict appends: {in: out}, {(a, b): out} or {in: (o1, o2)}."""
    if isinstance(keys, list):
        return df.withColumns({k: fn(F.col(k)) for k in keys})
    made: dict[str, Column] = {}
    for source, target in keys.items():
        value = fn(*(F.col(c) for c in (source if isinstance(source, tuple) else (source,))))
        made |= dict(zip(target, value)) if isinstance(target, tuple) else {target: value}
    return df.withColumns(made)


def branches(df: DataFrame, parts: dict[str, dict[str, Column]], keep: list[str] = ()) -> DataFrame:
    """Side by side: each branch's columns named branch__column, in one projection."""
    return df.select(*keep, *(c.alias(f"{b}__{n}") for b, cols in parts.items() for n, c in cols.items()))


def left_join_of(left: DataFrame, right: DataFrame, key: list[str], left_name: str, right_name: str) -> DataFrame:
    """Two pipelines' results side by side, columns named name__column, every row of the left."""
    a = left.select(*key, *(F.col(c).alias(f"{left_name}__{c}") for c in left.columns if c not in key))
    b = right.select(*key, *(F.col(c).alias(f"{right_name}__{c}") for c in right.columns if c not in key))
    return a.join(b, key, "left")


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows in an order drawn by the seed and the key, the same on any number of partitions. Spark keeps n rows for each task, no more."""
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def seeded(seed: int, *key: str) -> Column:
    """What puts rows in a random order that the seed and the key decide."""
    return F.md5(F.concat_ws(":", F.lit(seed), *key).cast("binary"))


def sample_for_pairs(df: DataFrame, max_pairs: int, key: list[str], seed: int = 0) -> DataFrame:
    """As many rows as have up to max_pairs pairs: the root of twice the number, rounded up, less one."""
    return sample_rows(df, max(0, math.ceil(math.sqrt(2 * max_pairs)) - 1), key, seed)


def sort_versions(df: DataFrame, version: str) -> DataFrame:
    """Rows whose version is three numbers, by patch, minor and major number, the greatest first."""
    parts = F.split(version, r"\.")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")
    return df.where(F.col(version).rlike(r"^\d+\.\d+\.\d+$")).orderBy(number(2).desc(), number(1).desc(), number(0).desc())


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], "left")


def map_items(df: DataFrame, key: str, items: str, dimension: DataFrame, source: str, target: str, unmatched: str, any_case: bool = False) -> DataFrame:
    """(key, items): each list mapped through dimension(source, target), sorted.

    unmatched: `drop` leaves out items without a match, `blank` keeps them as '', `source` keeps them
    as they are. An empty list gives [] under `drop`, else ['']. A target that is a list adds its items.
    any_case: items and sources match in any case.
    """
    case = F.lower if any_case else F.col
    listed = dimension.schema[target].dataType.typeName() == "array"
    rows = df.select(key, F.explode_outer(items).alias("__item"))
    found = rows.join(dimension.select(case(source).alias("__s"), F.col(target).alias("__t")), case("__item") == F.col("__s"), "left")
    blank, own = F.lit(""), F.coalesce("__item", F.lit(""))
    if listed:
        blank, own = F.array(blank), F.array(own)
    value = {"drop": F.col("__t"), "blank": F.coalesce("__t", blank), "source": F.coalesce("__t", own)}[unmatched]
    gathered = F.collect_list(value)
    return found.groupBy(key).agg(F.array_sort(F.flatten(gathered) if listed else gathered).alias(items))


def exploded(df: DataFrame, keep: list[str], items: Column | str, name: str) -> DataFrame:
    """The columns to keep and, as name, each item of a list that is not null.

    A plain explode has Spark add a filter for lists that hold something, below the projection that makes them:
    what is costly to make would be made twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def drop_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur once."""
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, keys, "left_semi")


def sub_phrases(words: Column) -> Column:
    """All runs of words, joined by spaces."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " ")))
    return F.when(n > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def longest_only(hits: DataFrame, key: list[str]) -> DataFrame:
    """(key, values) of hits(key, __p, __v): values of the phrases __p that hold a word which no later, longer one has, sorted."""
    ordered = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct(F.size(F.split("__p", " ")).alias("w"), F.length("__p").alias("l"), F.col("__p").alias("p"), F.col("__v").alias("v")))).alias("h"))
    words = lambda x: F.split(x["p"], " ")
    later = lambda i: F.flatten(F.transform(F.slice("h", i + 2, F.size("h")), words))
    kept = F.filter("h", lambda x, i: F.size(F.array_except(words(x), later(i))) > 0)
    return ordered.select(*key, F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["v"]))).alias("values"))


def longest_phrases(df: DataFrame, key: str, title: str, dictionary: DataFrame, phrase: str, value: str) -> DataFrame:
    """(key, values): dictionary values of the longest phrases of a title; a phrase whose words all lie in longer matches is left out."""
    rows = df.select(key, F.explode(sub_phrases(F.split(F.lower(title), " "))).alias("__p"))
    # Never the broadcast that Spark plans by the size of a compressed file: a title's phrases are many times its bytes.
    hits = rows.join(dictionary.select(F.col(phrase).alias("__d"), F.col(value).alias("__v")).hint("merge"), F.col("__p") == F.col("__d")).select(key, "__p", "__v")
    return longest_only(hits, [key])


def map_in_file_order(df: DataFrame, key: str, items: str, mapping: DataFrame) -> DataFrame:
    """(key, values): values of mapping(ordinal, key, value) whose key is among the row's items (lower case, trimmed), in the mapping's order; a key's last value at its first place."""
    # Combined before the shuffle, as a key may have very many lines.
    m = mapping.groupBy(F.lower(F.trim("key")).alias("mk")).agg(F.min("ordinal").alias("first"), F.max(F.struct("ordinal", "value")).alias("last")).where("first is not null").select("mk", "first", "last.value")
    rows = df.select(key, F.explode(F.array_distinct(F.transform(items, lambda x: F.lower(F.trim(x))))).alias("__i"))
    found = rows.join(m, F.col("__i") == F.col("mk")).where("value <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("first", "value"))).alias("v"))
    return found.select(key, F.col("v.value").alias("values"))


def split_groups(df: DataFrame, group: list[str], n: int) -> DataFrame:
    """Adds split: the group's place among all groups, modulo n. Groups are ranked on their distinct keys, not on all rows."""
    keys = df.select(*group).distinct()
    ranked = global_places(keys, [F.col(g) for g in group], "split")
    return df.join(ranked.withColumn("split", F.col("split") % n), group)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without that setting a local session gets a temporary folder; a cluster, where such a folder would not be shared, gets an error."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairlens-"))
    held = context._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else context.getConf().get("spark.checkpoint.dir")


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor loses nothing of it. Spark removes the files with the frame if its cleaner is told to."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Groups whose rows every task is sent, at most.
GROUPS = 1 << 16


def with_groups(rows: DataFrame, groups: DataFrame, key: str, group_key: str) -> DataFrame:
    """rows joined with groups, one row for each group. Groups are written and counted: up to GROUPS are broadcast, so that the rows of a large group stay in many tasks; more are joined by key."""
    groups = written(groups)
    few = groups.count() <= GROUPS
    return rows.join(F.broadcast(groups) if few else groups, F.col(key).eqNullSafe(F.col(group_key)))


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the total of value over the rows before, in the order of all rows.

    Rows are dealt to ranges of the order and added up range by range, after the totals of the ranges
    before: no task sorts more than its range. The order should have no ties. See written.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.sum(value).alias("__n"))
    # One row for each range.
    before = sizes.select(F.col("__part").alias("__q"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    placed = ranged.withColumn("__at", within).join(F.broadcast(before), F.col("__part") == F.col("__q"))
    return placed.withColumn(out, F.col("__before") + F.col("__at")).drop("__part", "__q", "__before", "__at")


def global_places(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds out: each row's place from 0 in the order of all rows; see running_total."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).drop("__one")


def outer_by_key(frames: dict[str, DataFrame], key: str, value: str, suffix: str, missing: str = "") -> DataFrame:
    """(key, name_suffix, ...): the value column of each frame(key, value) side by side, every key of any of them, `missing` where a frame has none. Chained full outer joins."""
    parts = [df.select(key, F.col(value).alias(f"{name}_{suffix}")) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), parts).fillna(missing)


def n_splits(rows: int, n_jobs: int, chunk: float, least: int, cores: int) -> int:
    """Chunks for a frame of so many rows: a whole chunk counts rows, a fraction counts chunks for each job."""
    jobs = cores + 1 + n_jobs if n_jobs < 0 else n_jobs
    splits = jobs if chunk == 1 else -(-jobs // chunk) if chunk < 1 else -(-rows // chunk)
    if rows / max(splits, 1) <= least:
        splits = -(-rows // least)
    return max(1, int(splits))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
