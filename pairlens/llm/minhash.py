"""Near-duplicates by bottom-k sketches from one hash function.

1. A text's sketch is the k smallest hashes of its shingle set. Texts with equal sets are one node.
2. Inverted lists of retained values. Of a sketch only its rarest values are listed: two sketches that
   share `need` values share one of their k - need + 1 rarest, whatever the rest is.
3. In each list every node is compared with the list's leader, the one with most values that are
   common there: the k smallest values of both sketches together estimate the similarity, and what
   passes is verified on full sets. Links give components.
4. Only nodes of one list that are still in different components can add a link that matters. They
   are all compared by union sketch; long lists in blocks of bounded size, which name the nodes that
   some pair let through. Blocks of the full sets of these then verify every such pair, in the least
   list that both are in, and give a link for each two components that they join.

A link is lost only if its two sketches share under `need` of k values though the similarity is at
least the threshold: with k = 32, need = 12 and 0.8, below 3 in 10^8 for a pair right at 0.8, less
above. Sets of up to k * 0.8 elements are compared whole, without any loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, components, cut, free_prefix, table, trimmed
from .wordhash import WHITE, mix, sets

K, NEED = 32, 12
#: The threshold as a fraction.
NUM, DEN = 4, 5
#: Nodes of a block of sketches; nodes of a list that is compared in one row; values of a block of full sets, at least one set.
BLOCK, SHORT, VALUES = 1024, 24, 1 << 19
#: Candidates of a node that are verified at once.
STEP = 64
#: A filter of 2 ** FILTER_BITS bits (8 MB) is sent to the tasks.
FILTER_BITS = 26


def _sketcher(w: int, full: bool, bits: Broadcast | None = None) -> Callable:
    """(id, text) batches to (id, n, node, values): the k smallest values, or all; with bits only nodes that may be in the filter, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.int64) if bits else None
        seen: set[int] = set()
        for batch in trimmed(batches):
            for at, texts in byte_chunks(batch.column(1)):
                values, offsets = sets(texts, WHITE, w)
                n = np.diff(offsets)
                filled = np.flatnonzero(n)
                node = np.zeros(len(n), np.uint64)
                if len(filled):
                    node[filled] = mix(np.add.reduceat(mix(values.view(np.uint64)), offsets[filled]) + n[filled].astype(np.uint64))
                ids, hashes = (batch.column(i).slice(at, len(texts)) for i in (0, 2))
                if held is not None:
                    low = (node & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    maybe = (n > 0) & ((held[low >> 6] >> (low & 63)) & 1 == 1)
                    keep = np.array([i for i in np.flatnonzero(maybe) if node[i] not in seen and not seen.add(node[i])], np.int64)
                    size = n[keep]
                    ends = np.concatenate([[0], np.cumsum(size)])
                    values = values[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(offsets[:-1][keep], size)]
                    offsets, n, node, ids, hashes = ends, size, node[keep], ids.take(pa.array(keep)), hashes.take(pa.array(keep))
                if not full:
                    size = np.minimum(n, K)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    values = values[np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(offsets[:-1], size)]
                    offsets = ends
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int64()), pa.array(node.view(np.int64), pa.int64(), mask=n == 0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64())), hashes],
                    names=["id", "n", "node", "vals", "text_hash"],
                )

    return run


_SCHEMA = "id long, n long, node long, vals array<long>, text_hash long"


def _near_in_size(a: Column, b: Column) -> Column:
    return (a * DEN >= b * NUM) & (b * DEN >= a * NUM)


def _enough(both: Column, union: Column, capped: Column) -> Column:
    """Whether an estimate from a union sketch can still be a link."""
    return F.when(capped, both >= NEED).otherwise(both * DEN >= union * NUM)


def _by_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves a chance."""
    left = sketches.select(F.col("node").alias("a"), F.col("sk").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("sk").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.where(_enough(both, F.size(union), F.size(union) >= K)).select("a", "b")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) that the full sets confirm. full: node, n, vals."""
    left = full.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("vals").alias("va"))
    right = full.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("vals").alias("vb"))
    both = F.size(F.array_intersect("va", "vb"))
    return pairs.join(left, "a").join(right, "b").where(both * DEN >= (F.col("na") + F.col("nb") - both) * NUM).select("a", "b")


def _union_estimates(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch r against rows of sketches x, absent values as the largest long: values in both among the union's k smallest, and the union's size up to k."""
    none = np.iinfo(np.int64).max
    m = np.sort(np.concatenate([x, np.broadcast_to(r, (len(x), len(r)))], axis=1), axis=1)
    held = m != none
    again = np.zeros_like(held)
    again[:, 1:] = (m[:, 1:] == m[:, :-1]) & held[:, 1:]
    rank = np.cumsum(held & ~again, axis=1)
    return (again & (rank <= K)).sum(axis=1), np.minimum(rank[:, -1], K)


def _matrix(sketches: list) -> np.ndarray:
    sk = np.full((len(sketches), K), np.iinfo(np.int64).max, np.int64)
    for i, s in enumerate(sketches):
        sk[i, : len(s)] = s
    return sk


def _passing(i: int, others: np.ndarray, sk: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of others that size and union sketch leave a chance with node i, and their estimates."""
    fit = others[(n[others] * DEN >= n[i] * NUM) & (n[i] * DEN >= n[others] * NUM)]
    if not len(fit):
        return fit, np.zeros(0)
    both, union = _union_estimates(sk[fit], sk[i])
    good = np.where(union >= K, both >= NEED, both * DEN >= union * NUM)
    return fit[good], (both / union)[good]


def _compare_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short lists, one a row, to the pairs of nodes in different components that pass."""
    for batch in trimmed(batches):
        lists = batch.column(0)
        at = lists.offsets.to_numpy()
        items = lists.values
        node, n, c = (items.field(i).to_numpy() for i in range(3))
        sk = _matrix(items.field(3).to_numpy(zero_copy_only=False))
        a, b = [], []
        for lo, hi in zip(at[:-1], at[1:]):
            for i in range(lo, hi - 1):
                later = np.arange(i + 1, hi)
                good, _ = _passing(i, later[c[later] != c[i]], sk, n)
                a.append(np.minimum(node[good], node[i]))
                b.append(np.maximum(node[good], node[i]))
        none = [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a + none)), pa.array(np.concatenate(b + none))], names=["a", "b"])


def _compare_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sketches of a block of a list against a block of those outside its largest component: the nodes of pairs that pass."""
    sk = _matrix(list(pdf.sk))
    n, c, far = pdf.n.to_numpy(), pdf.c.to_numpy(), pdf.far.to_numpy()
    own, held = np.flatnonzero(~far), np.zeros(len(pdf), bool)
    for i in np.flatnonzero(far):
        good, _ = _passing(i, own[c[own] != c[i]], sk, n)
        held[good] = True
        held[i] |= len(good) > 0
    return pdf.loc[held, ["v", "node"]].drop_duplicates()


def _verify_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Full sets of a block of a list against those of a block outside its largest component: links that join components, one for each two."""
    v, node, n, far = pdf.v.iloc[0], pdf.node.to_numpy(), pdf.n.to_numpy(), pdf.far.to_numpy()
    sk = _matrix([x[:K] for x in pdf.vals])
    listed = np.concatenate(pdf.listed.to_list())
    listed_at = np.concatenate([[0], np.cumsum([len(x) for x in pdf.listed])])
    known, ids = np.unique(np.concatenate(pdf.vals.to_list()), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    marks = np.zeros(len(known), bool)
    _, c = np.unique(pdf.c.to_numpy(), return_inverse=True)
    own, out = np.flatnonzero(~far), []
    for i in np.flatnonzero(far):
        # A pair is verified in the least list that both are in.
        mine = listed[listed_at[i] : listed_at[i + 1]]
        earlier = np.add.reduceat(np.isin(listed, mine[mine < v]), listed_at[:-1]) > 0
        good, likely = _passing(i, own[(c[own] != c[i]) & ~earlier[own]], sk, n)
        good = good[np.argsort(-likely, kind="stable")]
        marks[ids[at[i] : at[i + 1]]] = True
        while len(good):
            now, good = good[:STEP], good[STEP:]
            both = np.array([np.count_nonzero(marks[ids[at[j] : at[j + 1]]]) for j in now])
            for j in now[both * DEN >= (n[now] + n[i] - both) * NUM]:
                if c[j] != c[i]:
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    c[c == c[j]] = c[i]
            good = good[c[good] != c[i]]
        marks[ids[at[i] : at[i + 1]]] = False
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _lists(classes: DataFrame) -> DataFrame:
    """(v, node, n, g): the inverted lists of the rarest retained values; g of the node's values are about as common as v or more."""
    held = classes.select("node", "n", F.explode("sk").alias("v"))
    common = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = held.join(common, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("m"))
    retained = F.least(F.col("n"), F.lit(K))
    # Two sets of n elements or more that link share at least 0.8 n; beyond what sketches hold whole, `need` of the sketches' values.
    overlap = F.ceil(F.col("n") * NUM / DEN)
    overlap = F.when(F.col("n") * DEN > K * NUM, F.least(overlap, F.lit(NEED))).otherwise(overlap)
    # A value that only this node has can't be shared, but counts as one of the rarest.
    take = F.greatest(F.lit(0), retained - overlap + 1 - (retained - F.size("m"))).cast("int")
    listed = F.transform(F.slice("m", F.lit(1), take), lambda x: F.struct(x.v.alias("v"), F.size(F.filter("m", lambda y: y.df * 2 >= x.df)).alias("g")))
    return ranked.select("node", "n", F.explode(listed).alias("x")).select("x.v", "node", "n", "x.g")


def _blocks(side: DataFrame, size: str) -> DataFrame:
    """side(v, node, n, c, far, size, ...) dealt to blocks (v, x, y): all nodes of a list by x against those far from its largest component by y."""
    total = side.groupBy(F.col("v").alias("tv")).agg(F.ceil(F.sum(size)).cast("int").alias("xs"), F.ceil(F.sum(F.when(F.col("far"), F.col(size)))).cast("int").alias("ys"))
    side = side.join(total.where("ys > 0"), F.col("v") == F.col("tv"))
    side = side.withColumn("far", F.explode(F.when(F.col("far"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    x, y = F.pmod(F.xxhash64("node"), F.col("xs")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    to = F.when(F.col("far"), F.transform(every(F.col("xs")), lambda b: F.struct(b.alias("x"), y.alias("y")))).otherwise(F.transform(every(F.col("ys")), lambda b: F.struct(x.alias("x"), b.alias("y"))))
    return side.select("*", F.explode(to).alias("u")).select("*", "u.x", "u.y").drop("u", "tv", "xs", "ys", size)


def _rest(docs: DataFrame, words: int, lists: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of one list in different components, enough to join all that links join."""
    lab = labels.select(F.col("node").alias("ln"), F.col("component").alias("lc"))
    m = lists.join(lab, F.col("node") == F.col("ln"), "left").select("v", "node", "n", F.coalesce("lc", "node").alias("c"))
    counts = m.groupBy("v", "c").agg(F.count(F.lit(1)).alias("k"))
    stats = counts.groupBy(F.col("v").alias("lv")).agg(F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("top"), F.count(F.lit(1)).alias("parts"))
    stats = stats.where("parts > 1").select("lv", "all", F.col("top.c").alias("main"))
    m = m.join(stats, F.col("v") == F.col("lv")).select("v", "node", "n", "c", "all", (F.col("c") != F.col("main")).alias("far"))
    m = cut(m)
    sketched = sketches.select(F.col("node").alias("sn"), "sk")
    short = m.where(F.col("all") <= SHORT).join(sketched, F.col("node") == F.col("sn"))
    short = short.groupBy("v").agg(F.collect_list(F.struct("node", "n", "c", "sk")).alias("g")).select("g")
    pairs = cut(short.mapInArrow(_compare_short, "a long, b long").distinct())
    long = m.where(F.col("all") > SHORT).withColumn("part", F.lit(1 / BLOCK)).drop("all")
    # Dealt out by block, not by list: the joins by list before may then be split.
    side = _blocks(long, "part").join(sketched, F.col("node") == F.col("sn"))
    held = cut(side.repartition("v", "x", "y").groupBy("v", "x", "y").applyInPandas(_compare_block, "v long, node long").distinct())
    full = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("pn")).union(held.select("node")).distinct(), words)
    listed = lists.groupBy(F.col("node").alias("on")).agg(F.sort_array(F.collect_list("v")).alias("listed"))
    held = held.select(F.col("v").alias("hv"), F.col("node").alias("hn"))
    side = long.drop("part").join(held, (F.col("v") == F.col("hv")) & (F.col("node") == F.col("hn"))).drop("hv", "hn")
    side = _blocks(side.withColumn("part", F.col("n") / VALUES), "part").join(listed, F.col("node") == F.col("on"))
    side = side.join(full.select(F.col("node").alias("fn"), "vals"), F.col("node") == F.col("fn")).drop("on", "fn")
    return _verified(pairs, full).union(side.repartition("v", "x", "y").groupBy("v", "x", "y").applyInPandas(_verify_block, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """Components of near-copies among docs(doc_id, text, ...), similarity of word shingle sets 0.8 or more.

    Words are runs without ASCII white space, A-Z taken as a-z; a set holds the distinct shingles of
    `words` words, or all words as one where there are fewer. One row for each row: doc_id, n_shingles,
    component_id (smallest doc_id that links reach), kept (doc_id is component_id), text_hash. Texts that are
    null, empty or white space alone have no shingles and link with nothing. A null doc_id takes part with its
    text but is never the smallest; where a component has none but null ids, component_id is null and
    kept is true. Repeated rows share a component; other columns are ignored.
    """
    made = cut(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(_sketcher(words, False), _SCHEMA))
    # Equal sets have equal sketches: any will do.
    classes = cut(made.where("n > 0").groupBy("node", "n").agg(F.first("vals").alias("sk"), F.min("id").alias("id")))
    sketches = classes.select("node", "sk")
    lists = cut(_lists(classes))
    lead = lists.groupBy(F.col("v").alias("lv")).agg(F.max(F.struct("g", F.xxhash64("v", "node").alias("h"), F.col("node").alias("node"), F.col("n").alias("n"))).alias("lead"))
    star = lists.join(lead, F.col("v") == F.col("lv")).where((F.col("node") != F.col("lead.node")) & _near_in_size(F.col("n"), F.col("lead.n")))
    star = star.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
    first = cut(_by_sketch(star, sketches))
    full = _full_sets(docs, first.select(F.explode(F.array("a", "b")).alias("pn")).distinct(), words)
    links = cut(_verified(first, full))
    more = cut(_rest(docs, words, lists, components(links), sketches))
    labels = components(links.union(more))
    named = made.where("n > 0").groupBy("node").agg(F.min("id").alias("id"))
    lab = labels.select(F.col("node").alias("ln"), F.col("component").alias("lc"))
    named = named.join(lab, F.col("node") == F.col("ln"), "left").select("node", "id", F.coalesce("lc", "node").alias("c"))
    least = named.groupBy(F.col("c").alias("gc")).agg(F.min("id").alias("component_id"))
    named = named.join(least, F.col("c") == F.col("gc")).select(F.col("node").alias("nn"), "component_id")
    rows = made.select("id", "n", "node", "text_hash").join(named, F.col("node") == F.col("nn"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs(doc_id, text, ...), all columns, with one document of each component: see near_duplicates.

    Rows with a null doc_id stay, and so do null, empty and wordless texts, which link with nothing. Equal
    rows of a kept document all stay. An empty table gives no rows; other columns, whatever their names, are kept.
    """
    p = free_prefix(docs)
    gone = near_duplicates(docs.select("doc_id", "text"), words).where("not kept").select(F.col("doc_id").alias(f"{p}gone"), F.col("text_hash").alias(f"{p}hash")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(f"{p}gone")) & (F.xxhash64("text") == F.col(f"{p}hash")), "left_anti")


def _filter_bits(nodes: DataFrame) -> bytes:
    """One bit for each value of the lowest FILTER_BITS bits of a node: set if some node has it. 2 ** FILTER_BITS / 8 bytes, whatever the input."""
    low = f"(pn & {(1 << FILTER_BITS) - 1})"
    rows = nodes.selectExpr(f"shiftright({low}, 6) as w", f"shiftleft(1L, cast({low} & 63 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows.w.to_numpy()] = rows.b.to_numpy()
    return bits.tobytes()


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, vals) of nodes(pn), once each.

    Sets are made again from the texts. A filter of fixed size, sent to all tasks, keeps nearly all
    others from being shuffled; the semi join then decides.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(nodes))
    held = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(_sketcher(words, True, bits), _SCHEMA)
    return cut(held.join(nodes, F.col("node") == F.col("pn"), "left_semi").dropDuplicates(["node"]).select("node", "n", "vals"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2).drop("text_hash")


#: All pairs, and components by following links to smaller ids.
SQL = r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when coalesce(len(w), 0) = 0 then [] when len(w) = 1 then [w[1]] else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from w),
n as materialized (select doc_id, count(*) as n from s group by 1),
p as materialized (select a.doc_id as a, b.doc_id as b, count(*) as inter from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * inter >= 80 * (x.n + y.n - inter)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as c from documents union select e.a, r.c from r join e on e.b = r.a where r.c < e.a),
m as (select a, min(c) as c from r group by 1)
select m.a as doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, m.a = m.c as kept from m left join n on n.doc_id = m.a"""
