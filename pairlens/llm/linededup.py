"""Line dedup by a log-template tree, with DataFrame functions only.

A line is parsed to a leaf of a tree of fixed depth: its number of tokens, then its first DEPTH
tokens, where a token with a digit counts as a variable field. The different lines of a leaf are then
sorted into templates, group by group: a place whose token most lines of the group share is constant,
any other is a variable field, and a line belongs to the template if at least SIMILAR of its tokens
agree with constants. The others are parted by their token at the place with the fewest different
ones, and so on until no group can be parted: lines that share no token beyond the group's constants
are templates of their own. A template that occurs in two documents or more is recurring: its first
occurrence (smallest doc_id, then place) stays, all others are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bits_of, cut, free_prefix, may_hold, table

#: Leading tokens that lead to a leaf; share of agreeing tokens.
DEPTH, SIMILAR = 4, 0.7
#: What stands for a variable field.
FIELD = "<*>"
#: White space but for single spaces; a token with a digit, where only spaces and newlines are left.
_GAP = r"[\x20\t\x0B-\x0D]{2,}|[\t\x0B-\x0D]"
_DIGITS = r"(?<![^\x20\n])[^\x20\n0-9]*+[0-9][^\x20\n]*+"


def _masked(raw: Column) -> Column:
    """A line with its fields masked; one of nothing but fields stays as it is, for then no constant tells it from others."""
    masked = F.regexp_replace(raw, _DIGITS, FIELD)
    only = F.trim(F.replace(masked, F.lit(FIELD), F.lit(""))) == ""
    return F.trim(F.when(raw.rlike("[0-9]"), F.when(only, raw).otherwise(masked)).otherwise(raw))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, th, pos, line, n, leaf, lh, lv): each line that is not blank, with fields masked, its leaf and its own hashes."""
    # Patterns run only where they can match: over a text for rare white space, over a line for digits.
    odd = F.lit(False)
    for c in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains("text", F.lit(c))
    text = F.when(odd, F.regexp_replace("text", _GAP, " ")).otherwise(F.col("text"))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.posexplode(F.transform(F.split(text, "\n"), _masked)).alias("pos", "line"))
    # In bytes: a space is one in UTF-8.
    rows = rows.where("line <> ''").withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return rows.select("id", "th", "pos", "line", "n", F.xxhash64("n", F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line", "n").alias("lh"), F.xxhash64(F.lit(1), "line").alias("lv"))


def _templates(lines: DataFrame) -> DataFrame | None:
    """(lh, lv, template) of the lines(key, lh, lv, n, tokens), each once, that belong to a template with others; key is the leaf.

    All counts are by (key, place, token) or (key, place) and combine before the shuffle. A hot leaf's
    different lines meet its one row of constants in one task, each once.
    """
    found, active = None, cut(lines)
    while active.head(1):
        counts = active.select("key", F.posexplode("tokens").alias("at", "token")).groupBy("key", "at", "token").agg(F.count(F.lit(1)).alias("c"))
        places = counts.groupBy("key", "at").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("d"), F.max(F.struct("c", "token")).alias("top"))
        constants = F.collect_list(F.struct("at", F.when(F.expr("2 * top.c > m"), F.col("top.token")).alias("token")))
        part = F.min(F.when(F.expr("d > 1 and d < m"), F.struct("d", "at")))
        groups = places.groupBy(F.col("key").alias("gk")).agg(F.max("m").alias("m"), F.transform(F.sort_array(constants), lambda x: x["token"]).alias("constants"), part.alias("part"))
        agreeing = F.size(F.filter(F.zip_with("tokens", "constants", lambda a, b: a == b), lambda x: x))
        judged = active.join(groups.where("m > 1"), F.col("key") == F.col("gk"))
        judged = cut(judged.select("*", (agreeing >= SIMILAR * F.col("n")).alias("fits")).drop("gk", "m", "constants"))
        fitting = judged.where("fits").select("lh", "lv", F.col("key").alias("template"))
        found = fitting if found is None else found.union(fitting)
        rest = judged.where("not fits and part is not null")
        active = rest.select(F.xxhash64("key", "part.at", F.get("tokens", F.col("part.at"))).alias("key"), "lh", "lv", "n", "tokens")
    return found


def _recurring(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(rh, rv, keep): hashes of recurring lines, and the occurrence that stays."""
    exact = cut(lines.groupBy("leaf", "lh", "lv").agg(F.max("id").alias("hi"), F.min(F.struct("id", "th", "pos")).alias("first")))
    leaves = exact.groupBy("leaf").agg(F.count(F.lit(1)).alias("m"), F.min("first.id").alias("lo"), F.max("hi").alias("hi"))
    # Most lines are alone in their leaf: a filter keeps nearly all of them out of what follows. One too many does no harm.
    mixed = bits_of(leaves.where("m > 1 and lo <> hi"), "leaf")
    several = may_hold(mixed, "leaf")
    plain = exact.where(~several).where("first.id <> hi").select("lh", "lv", F.col("first").alias("keep"))
    some = exact.where(several)
    # Each line is parsed again in one document that holds it.
    holding = bits_of(some.select(F.col("first.th").alias("th")), "th")
    again = _lines(docs.where(may_hold(holding, "xxhash64(text)"))).where(several)
    again = again.groupBy("leaf", "lh", "lv", "n").agg(F.min("line").alias("line"))
    found = _templates(again.select(F.col("leaf").alias("key"), "lh", "lv", "n", F.transform(F.split("line", " "), lambda x: F.xxhash64(x)).alias("tokens")))
    if found is None:
        return plain.select(F.col("lh").alias("rh"), F.col("lv").alias("rv"), "keep")
    found = found.select(F.col("lh").alias("fh"), F.col("lv").alias("fv"), "template")
    own = F.struct(F.col("template").isNotNull().alias("general"), F.coalesce("template", "lh").alias("a"), F.when(F.col("template").isNull(), F.col("lv")).otherwise(0).alias("b"))
    named = cut(some.join(found, (F.col("lh") == F.col("fh")) & (F.col("lv") == F.col("fv")), "left").select("lh", "lv", "hi", "first", own.alias("own")))
    recurring = named.groupBy(F.col("own").alias("ro")).agg(F.min("first").alias("keep"), F.max("hi").alias("rhi")).where("keep.id <> rhi")
    return plain.union(named.join(recurring, F.col("own") == F.col("ro")).select("lh", "lv", "keep")).select(F.col("lh").alias("rh"), F.col("lv").alias("rv"), "keep")


def _dropped(docs: DataFrame) -> DataFrame:
    """(id, th, drop): for each document that loses lines, by id and text hash, their places."""
    lines = cut(_lines(docs).drop("line", "n"))
    recurring = cut(_recurring(docs, lines))
    # A line that a third of all documents hold: an inner join, whose large partitions Spark splits.
    some = lines.where(may_hold(bits_of(recurring, "rh"), "lh")).select("id", "th", "pos", "lh", "lv")
    found = some.join(recurring, (F.col("lh") == F.col("rh")) & (F.col("lv") == F.col("rv"))).where(F.struct("id", "th", "pos") != F.col("keep"))
    return cut(found.groupBy("id", "th").agg(F.array_distinct(F.collect_list("pos")).alias("drop")))


def drop_recurring_lines(docs: DataFrame, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...), all columns, without the later occurrences of recurring lines.

    n_lines and n_dropped name columns to add: a text's number of lines, and of those dropped.
    Every row stays; a text whose lines all go becomes empty. Lines end at a newline; blank ones always
    stay, and so do texts with a null doc_id, which count for nothing. A null text stays null, with no
    lines. Rows with one doc_id are one document; equal rows lose the same lines. Other columns are kept as they are.
    Lines are told apart by 128 bits of hashes.
    """
    p = free_prefix(docs)
    drops = _dropped(docs.select("doc_id", "text")).toDF(f"{p}id", f"{p}th", f"{p}drop")
    parts = F.split("text", "\n")

    def made(rows: DataFrame, drop: Column) -> DataFrame:
        kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(drop, i)), "\n")
        text = F.when(drop.isNull(), F.col("text")).otherwise(kept)
        numbers = [F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long").alias(n) for x, n in ((parts, n_lines), (drop, n_dropped)) if n]
        return rows.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), *numbers)

    # Texts that lose nothing are not shuffled, but for a few that the filter lets through.
    maybe = F.coalesce(may_hold(bits_of(drops.select(F.col(f"{p}th").alias("h")), "h"), "xxhash64(text)"), F.lit(False))
    joined = docs.where(maybe).join(drops, (F.col("doc_id") == F.col(f"{p}id")) & (F.xxhash64("text") == F.col(f"{p}th")), "left")
    return made(docs.where(~maybe), F.lit(None).cast("array<int>")).union(made(joined, F.col(f"{p}drop")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_lines", "n_dropped")
