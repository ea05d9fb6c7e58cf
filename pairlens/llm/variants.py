"""Spelling variants: words one edit apart, found by an Aho-Corasick automaton over halves.

One edit leaves one half of a word whole: its first half still opens the other word, or its second half
still ends it. Automaton shards hold the halves of every word. All words are scanned; a hit counts if it
lies where that half must lie and the lengths are compatible, and what is left of both words must then
be one edit apart. A word meets the shards that can hold a half of it, by the length of the word whose
half it is and by that half's outer letters; keys with very many words are joined in blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LETTERS = r"A-Za-zÀ-ÿ"
#: Code points of a word, and its occurrences, at least.
LENGTH, TIMES = 5, 3
#: One run in so many is damaged, as its checksum decides.
DAMAGED = 97
#: Code points of a text that are split into runs at once.
PIECE = 1 << 16
#: Words whose halves a shard holds on average, and words of one key beyond which it is joined in blocks.
SHARD, BLOCK = 1 << 14, 1 << 12
#: Outer letters of a half that choose a shard.
LEAD = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of docs(doc_id, text): each maximal run of letters, A-Z in lower case. Long texts are taken in pieces that end after a run."""
    pieces = F.regexp_extract_all("text", F.lit(rf"[\s\S]{{{PIECE}}}[{LETTERS}]*+|[\s\S]+"), F.lit(0))
    rows = docs.select("doc_id", F.explode(F.when(F.length("text") <= PIECE, F.array("text")).otherwise(pieces)).alias("piece"))
    found = F.regexp_extract_all(F.translate("piece", UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))
    return rows.select("doc_id", F.explode(found).alias("run"))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where its checksum says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n) of words with so many code points and occurrences, at least."""
    words = runs(docs).select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _half(word: Column, size: Column, kind: str) -> Column:
    """The outer letters of the half of kind that a word of so many code points has."""
    lead = F.least(size - F.floor(size / 2) if kind == ">" else F.floor(size / 2), F.lit(LEAD)).cast("int")
    return F.substring(word, F.length(word) - lead + 1, lead) if kind == ">" else F.substring(word, F.lit(1), lead)


def _roles(words: DataFrame) -> DataFrame:
    """(key, word, n, own): each word under the keys of its own halves (own), and under those of halves that shorter or longer words may have in it."""
    size = F.length("word")
    made = [
        F.struct(F.concat(F.lit(kind), (size + d).cast("string"), F.lit(":"), _half(F.col("word"), size + d, kind)).alias("key"), F.lit(d == 0).alias("own"))
        for kind in "<>"
        for d in (-1, 0, 1)
    ]
    return words.select("word", "n", F.explode(F.array(*made)).alias("r")).select("r.key", "word", "n", "r.own")


def _dealt(roles: DataFrame, shards: int, block: int) -> DataFrame:
    """(shard, tag, word, n, held, scanned): rows of one tag meet. A key with over `block` rows has a tag for each pair of its blocks."""
    many = roles.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block).select(F.col("key").alias("k"), F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    rows = roles.join(many, F.col("key") == F.col("k"), "left").withColumn("mine", F.pmod(F.hash("word"), F.col("blocks")))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    meet = lambda i, j, held, scanned: F.struct(i.alias("i"), j.alias("j"), held.alias("held"), scanned.alias("scanned"))
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    scan = F.transform(others, lambda i: meet(i, F.col("mine"), F.col("own") & (i == F.col("mine")), yes))
    hold = F.transform(F.filter(others, lambda j: F.col("own") & (j != F.col("mine"))), lambda j: meet(F.col("mine"), j, yes, no))
    each = F.when(F.col("blocks").isNull(), F.array(meet(zero, zero, F.col("own"), yes))).otherwise(F.concat(scan, hold))
    rows = rows.select("key", "word", "n", F.explode(each).alias("m"))
    tag = F.concat_ws("|", "key", F.col("m.i").cast("string"), F.col("m.j").cast("string"))
    return rows.select(F.pmod(F.xxhash64(tag), F.lit(shards)).alias("shard"), tag.alias("tag"), "word", "n", "m.held", "m.scanned")


def _short(s: str) -> set[str]:
    return {s[:i] + s[i + 1 :] for i in range(len(s))}


def _blank(s: str) -> list[str]:
    return [f"{s[:i]}\0{s[i + 1 :]}" for i in range(len(s))]


class Shard:
    """Halves of words, each in the group of a tag. A tag names the side of the half and the length of the words."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        # By tag, half and what is left of the word: as it is, one code point shorter, or with one blanked out.
        self.rests: dict[tuple, list[tuple[str, int]]] = defaultdict(list)

    def hold(self, tag: str, word: str, n: int) -> None:
        cut_at = len(word) // 2
        half, rest = (word[cut_at:], word[:cut_at]) if tag[0] == ">" else (word[:cut_at], word[cut_at:])
        self.automaton.add_word(half, half)
        for form in (rest, *_short(rest), *_blank(rest)):
            self.rests[tag, half, len(form) - len(rest), form].append((word, n))

    def near(self, tag: str, word: str) -> Iterator[tuple[str, int]]:
        """(word, n) of the tag's words that are one edit from this one and have their half in it."""
        after, size = tag[0] == ">", int(tag[1 : tag.index(":")])
        want, more = size - size // 2 if after else size // 2, size - len(word)
        for end, half in self.automaton.iter(word):
            if len(half) != want or end + 1 != (len(word) if after else want):
                continue
            rest = word[: len(word) - want] if after else word[want:]
            # The other word is longer: one of its code points goes; shorter: one of this word's; as long: one is replaced.
            forms = [(-1, rest)] if more == 1 else [(0, s) for s in _short(rest)] if more == -1 else [(0, s) for s in _blank(rest)]
            for shift, form in forms:
                for other, n in self.rests.get((tag, half, shift, form), ()):
                    # What both halves find is taken from the first half alone.
                    if other != word and not (after and word.startswith(other[: size // 2])):
                        yield other, n


def _found(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    shard = Shard()
    for tag, word, n in zip(*(rows[rows.held][c] for c in ("tag", "word", "n"))):
        shard.hold(tag, word, n)
    out = []
    if len(shard.automaton):
        shard.automaton.make_automaton()
        for tag, word in zip(*(rows[rows.scanned][c] for c in ("tag", "word"))):
            near = list(shard.near(tag, word))
            if near:
                n, form = min((-n, other) for other, n in near)
                out.append((word, len(near), -n, form))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form_n, form) of words(word, n): how many words are one edit away, and the most frequent of them (of equal ones the first by code point)."""
    shards = max(1, -(-2 * words.count() // shard))
    dealt = _dealt(_roles(words), shards, block)
    found = dealt.groupBy("shard").applyInPandas(_found, "word string, n_near long, form_n long, form string")
    both = words.selectExpr("word", "n", "0L as n_near", "null as best").unionByName(found.selectExpr("word", "null as n", "n_near", "struct(-form_n as m, form as form) as best"), allowMissingColumns=True)
    out = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links(word, form) without cycles: where following the links ends. Each round doubles how far a word sees."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        step = cut(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").head(1):
            return now


def spelling_variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, ratio: int = 2, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Words of docs(doc_id, text, ...) with the word that each is a variant of.

    Returns word, form (its most frequent near word, if that occurs `ratio` times as often at least; else
    null), root (the last form that forms lead to; the word itself without any), n, n_near (near words) and
    form_n. A null text has no words; a null doc_id counts as an empty one; repeated rows count as often as
    they occur; an empty table gives no rows; other columns are ignored. Forms grow in frequency, so that
    they never lead in a circle.
    """
    words = cut(vocabulary(docs.select("doc_id", "text"), length, times))
    near = near_words(words, shard, block)
    fits = F.col("form_n") >= ratio * F.col("n")
    near = cut(near.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(near.where("form is not null")).select(F.col("word").alias("w"), F.col("root").alias("end"))
    out = near.join(ends, F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def _nibbles() -> list[int]:
    """What the checksum adds for each half of a byte."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


#: Near words as equal words with one code point blanked out or left out.
SQL = f"""
with t as (select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
r as materialized (select doc_id, run, count(*) as m from t group by all),
b as (select doc_id, run, m, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c:
  case when unicode(c) < 128 then [unicode(c) & 15, unicode(c) >> 4] else [(192 | (unicode(c) >> 6)) & 15, 12, unicode(c) & 15, 8 | ((unicode(c) >> 4) & 3)] end)) as nibbles from r),
h as (select run, m, xor(4294967295, list_reduce(list_transform(nibbles, lambda x: x::bigint), lambda c, x: xor(({_nibbles()})[(xor(c, x) & 15) + 1]::bigint, c >> 4), 4294967295::bigint)) as h from b),
w as (select case when h % {DAMAGED} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, m from h),
v as materialized (select word, sum(m)::bigint as n from w where length(word) >= {LENGTH} group by word having sum(m) >= {TIMES}),
p as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
k as (select distinct word, n, substr(word, 1, (i - 1)::int) || chr(1) || substr(word, (i + 1)::int) as blank, substr(word, 1, (i - 1)::int) || substr(word, (i + 1)::int) as short from p),
e as (select a.word, b.word as other, b.n as m from k a join k b on a.blank = b.blank and a.word <> b.word
  union select k.word, v.word, v.n from k join v on k.short = v.word
  union select v.word, k.word, k.n from k join v on k.short = v.word),
f as (select word, count(*) as n_near, min({{'a': -m, 'b': other}}) as best from e group by word),
g as materialized (select v.word, v.n, coalesce(f.n_near, 0) as n_near, case when -f.best.a >= 2 * v.n then f.best.b end as form, case when -f.best.a >= 2 * v.n then -f.best.a end as form_n from v left join f on v.word = f.word),
d as (with recursive z as (select word, word as root from g union all select z.word, g.form from z join g on z.root = g.word where g.form is not null)
  select z.word, z.root from z join g on z.root = g.word where g.form is null)
select g.word, g.form, d.root, g.n, g.n_near, g.form_n from g join d on g.word = d.word
"""
