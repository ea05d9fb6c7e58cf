"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the rows with a seeded hash into buckets small enough for one task's memory. Pass 2
shuffles each bucket by Fisher-Yates, whose draws are hashes of the seed, the bucket and the step, and
deals the rows out. Position in the whole order modulo the number of shards is the shard, so the counts
of two shards differ by one at most (law `rows`). The same rows and seed give the same order on any
number of partitions, and again in a task that is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, table

SHARDS = 16
#: Rows of a bucket on average: an array of so many digests (some tens of bytes each) is one task's unit.
BUCKET_ROWS = 1024
#: Copies of a row that are numbered at once.
RUN = 1 << 16
SEED = 20240229


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1) and text_crc32 (of null as of empty) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def _fisher_yates(n: Column, bucket: Column, seed: int) -> Column:
    """The numbers 0 to n - 1 in an order drawn by the seed and the bucket: number i goes to a random place up to i, and what was there to the end."""

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        moved = F.concat(F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.get(order, j)))
        return F.when(j == i, F.concat(order, F.array(i))).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def _first_places(sizes: DataFrame, buckets: int) -> DataFrame:
    """(b, first): how many rows come before each bucket(bucket, n). Running sums over runs of buckets, then over the runs: no task has more than about the square root of their number."""
    run = F.floor(F.col("bucket") / F.lit(max(1, int(buckets**0.5)))).alias("run")
    each = sizes.select("bucket", "n", run)
    runs = each.groupBy(F.col("run").alias("r")).agg(F.sum("n").alias("m"))
    runs = runs.select("r", (F.sum("m").over(Window.orderBy("r")) - F.col("m")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("run").orderBy("bucket")) - F.col("n")
    return each.withColumn("within", within).join(runs, F.col("run") == F.col("r")).select(F.col("bucket").alias("b"), (F.col("before") + F.col("within")).alias("first"))


def assign_slots(docs: DataFrame, n_shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, seed: int = SEED, copies: bool = False) -> DataFrame:
    """A shard and a slot for every row of docs(doc_id, text, ...).

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot (gapless from 0 in its shard) and
    grown_shard (null: this law has none); with copies also copy, the number from 1 among equal rows. Equal rows are counted before the shuffle and dealt out as
    numbered copies, so that a text or doc_id that holds a third of all rows spreads evenly over the
    buckets. The order depends on the rows and the seeds alone, not on partitions. Null doc_ids and
    texts are rows like any other; an empty table gives no rows; other columns are ignored.
    """
    counted = digests(docs).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    buckets = max(1, -(-docs.count() // bucket_rows))
    one = F.lit(1).cast("long")
    few = counted.where(F.col("n") <= RUN).withColumn("copy", F.explode(F.sequence(one, "n")))
    # Copies by the million are numbered run by run, and runs are dealt out to tasks.
    runs = counted.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}")))).repartition("doc_id", "size", "text_crc32", "run")
    many = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("n"), (F.col("run") + 1) * RUN)))).drop("run")
    numbered = few.union(many)
    scattered = numbered.select(
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32", "copy"), F.lit(buckets)).alias("bucket"),
        F.struct("doc_id", "size", "text_crc32", "copy").alias("row"),
    )
    # A bucket's rows are put in a fixed order first: what a task collects comes in any order.
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    order = _fisher_yates(F.size("rows"), F.col("bucket"), seed)
    shuffled = gathered.select("bucket", F.transform(order, lambda i: F.get("rows", i)).alias("rows"))
    first = _first_places(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), buckets)
    dealt = shuffled.join(first, F.col("bucket") == F.col("b")).select("first", F.posexplode("rows").alias("at", "row"))
    place = F.col("first") + F.col("at")
    return dealt.select(
        "row.doc_id",
        "row.size",
        "row.text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(place / F.lit(n_shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *(["row.copy"] if copies else []),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> None:
    """Write docs(doc_id, text, ...) with all their columns as Parquet folders shard=0.., rows in slot order within a file.

    Adds the columns shard and slot; where docs has one of these names already, both added ones get a
    prefix of underscores. Rows are matched with their slots by digest and copy number. Copies are numbered within each input
    partition, after the copies in partitions before it, so that a row that fills a third of the table is
    no single task's work. Null texts stay null; an empty table writes no files of rows.
    """
    p = free_prefix(docs)
    taken = {c.lower() for c in docs.columns}
    shard, slot = ("shard", "slot") if not taken & {"shard", "slot"} else (f"{p}shard", f"{p}slot")
    key = ["doc_id", "size", "text_crc32"]
    own = [f"{p}{k}" for k in key]
    text = F.coalesce(F.col("text"), F.lit(""))
    made = {own[0]: F.col("doc_id"), own[1]: (F.octet_length(text) + 1).cast("long"), own[2]: F.crc32(text.cast("binary")).cast("long"), f"{p}part": F.spark_partition_id()}
    # Written once: the partitions that copies are numbered in must stay as they are.
    rows = cut(docs.withColumns(made))
    held = rows.groupBy(*own, f"{p}part").agg(F.count(F.lit(1)).alias("c"))
    held = held.select(*(F.col(c).alias(f"{p}h{i}") for i, c in enumerate([*own, f"{p}part"])), (F.sum("c").over(Window.partitionBy(*own).orderBy(f"{p}part")) - F.col("c")).alias(f"{p}before"))
    rows = rows.withColumn(f"{p}n", F.row_number().over(Window.partitionBy(*own, f"{p}part").orderBy(F.lit(0))))
    same = lambda *names: [F.col(a).eqNullSafe(F.col(b)) for a, b in names]
    rows = rows.join(held, same((own[0], f"{p}h0"), (own[1], f"{p}h1"), (own[2], f"{p}h2"), (f"{p}part", f"{p}h3")))
    rows = rows.withColumn(f"{p}n", F.col(f"{p}n") + F.col(f"{p}before"))
    # The numbered copies come out of assign_slots as dealt: the k-th by shard and slot takes the k-th copy.
    slots = assign_slots(docs, n_shards, bucket_rows, seed, copies=True)
    slots = slots.select(*(F.col(k).alias(f"{p}s{i}") for i, k in enumerate([*key, "copy"])), F.col("shard").alias(f"{p}shard_"), F.col("slot").alias(f"{p}slot_"))
    dealt = rows.join(slots, same((own[0], f"{p}s0"), (own[1], f"{p}s1"), (own[2], f"{p}s2"), (f"{p}n", f"{p}s3")))
    dealt = dealt.repartitionByRange(f"{p}shard_", f"{p}slot_").sortWithinPartitions(f"{p}shard_", f"{p}slot_")
    dealt.select(*docs.columns, F.col(f"{p}shard_").alias(shard), F.col(f"{p}slot_").alias(slot)).write.partitionBy(shard).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_slots(table(spark, sf_dir, "documents"))
