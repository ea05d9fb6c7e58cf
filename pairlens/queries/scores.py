"""Overlap, cosine, quantile, composite and term-weight queries."""

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import scoring, stats
from ..operators.relational import written
from ..sources import table
from .base import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _words():
    return F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")


_SQL_WORDS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", _words().alias("w"))
    a, b = c.where("turn % 2 = 0"), c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("r"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("w").alias("l"), "r")


_OVERLAP = f"""
with c as (select conv_id, turn, {_SQL_WORDS} as w from conversations),
p as (select a.conv_id || '-' || a.turn as id, a.w as l, b.w as r from c a join c b on a.conv_id = b.conv_id and a.turn + 1 = b.turn where a.turn % 2 = 0),
l as (select id, i, sqrt(count(*)) as v from (select id, unnest(l) as i from p) group by 1, 2),
r as (select id, i, sqrt(count(*)) as v from (select id, unnest(r) as i from p) group by 1, 2),
j as (select l.id, l.v / avg(l.v) over (partition by l.id) as lv, r.v / avg(r.v) over (partition by l.id) as rv, r.v as rr from l left join r on l.id = r.id and l.i = r.i),
s as (select id, case when count(rr) = 0 then 0.0 else 1 - avg(greatest(0.0, lv - coalesce(rv, 0))) end as score, count(*) as n_elem from j group by id)
select p.id, round(coalesce(s.score, 0.0), 6) as score, coalesce(s.n_elem, 0) as n_elem from p left join s on p.id = s.id"""


@R.add(_OVERLAP)
def overlap_turns(spark, d):
    return scoring.left_overlap(_turns(spark, d), "id", "l", "r").select("id", F.round("score", 6).alias("score"), "n_elem")


def _scaled_overlap(scale: str, sql: str) -> None:
    """The overlap with another scaling of counts."""

    def run(spark, d):
        return scoring.left_overlap(_turns(spark, d), "id", "l", "r", scale).select("id", F.round("score", 6).alias("score"), "n_elem")

    QUERIES[f"overlap_{scale}"], SQL[f"overlap_{scale}"] = run, _OVERLAP.replace("sqrt(count(*))", sql)


for _name, _sql in (("identity", "count(*)::double"), ("fourth_root", "pow(count(*), 0.25)"), ("one_hot", "1.0::double")):
    _scaled_overlap(_name, _sql)


@R.add("""select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as score
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    right = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(right, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@R.add("""with e as (select label, vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings),
m as (select label, i, avg(x) as x from e group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from m group by 1)
select a.label as a, b.label as b, round(sum(a.x * b.x) / min(na.n) / min(nb.n), 6) as score from m a join m b on a.i = b.i and a.label <= b.label join n na on na.label = a.label join n nb on nb.label = b.label group by 1, 2""")
def cosine_label_matrix(spark, d):
    m = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    a, b = v.select(F.col("label").alias("a"), F.col("v").alias("va")), v.select(F.col("label").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", F.round(S.cosine(F.col("va"), F.col("vb")), 6).alias("score"))


@R.add("""with q as (select embedding::double[] as q from embeddings where vec_id = 0)
select vec_id, round(sqrt(greatest(0, list_dot_product(embedding::double[], embedding::double[]) + list_dot_product(q, q) - 2 * list_dot_product(embedding::double[], q))), 4) as distance from embeddings, q order by distance, vec_id limit 5""")
def nearest5(spark, d):
    e = table(spark, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q")))
    return e.crossJoin(q).select("vec_id", F.round(S.euclidean(F.col("embedding"), F.col("q")), 4).alias("distance")).orderBy("distance", "vec_id").limit(5)


def _place_sql(source: str, key: str, value: str) -> str:
    """Common table expressions ending in placed(key, v, q): the value's place among min(1000, n) percentiles, with the middle of equal knots."""
    return f"""src as (select {key} as k, ({value})::double as v from {source}), sorted as (select list_sort(list(v)) as s, count(v) as n, least(1000, count(v)) as m from src),
knots as (select m, [s[((i * (n - 1)) // (m - 1))::int + 1] + (s[least(n, (i * (n - 1)) // (m - 1) + 2)::int] - s[((i * (n - 1)) // (m - 1))::int + 1]) * ((i * (n - 1)) % (m - 1)) / (m - 1)::double for i in range(m)] as x from sorted),
ks as (select unnest(x) as x, generate_subscripts(x, 1) - 1 as i, m from knots), vs as (select distinct v from src),
lo as (select vs.v, max(i) as f, arg_max(x, i) as fx, any_value(m) as m from vs join ks on ks.x <= vs.v group by 1), hi as (select vs.v, min(i) as g, arg_min(x, i) as gx from vs join ks on ks.x >= vs.v group by 1),
ends as (select min(x) as least_x, max(x) as most_x from ks),
placed as (select k, src.v, case when src.v <= least_x then 0.0 when src.v >= most_x then 1.0 when fx = gx then (f + g) / 2.0 / (m - 1) else (f + (src.v - fx) / (gx - fx)) / (m - 1) end as q from src join lo on lo.v = src.v join hi on hi.v = src.v, ends)"""


@R.add(f"with {_place_sql('customer', 'c_custkey', 'c_acctbal')} select k as c_custkey, round(q, 6) as q, 1 + (q >= .1)::int + (q >= .3)::int + (q >= .7)::int + (q >= .9)::int as class from placed")
def quantile_class(spark, d):
    out = stats.quantile_map(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v")), "v", "q")
    return out.select("c_custkey", F.round("q", 6).alias("q"), S.quantile_class(F.col("q"), F.lit(1.0)).alias("class"))


@R.add(f"with {_place_sql('lineitem', 'concat(l_orderkey, chr(45), l_linenumber)', 'l_quantity')} select v as quantity, round(avg(q), 6) as q, count(*) as n from placed group by 1")
def quantile_ties(spark, d):
    out = stats.quantile_map(table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity")), "quantity", "q")
    return out.groupBy("quantity").agg(F.round(F.avg("q"), 6).alias("q"), F.count(F.lit(1)).alias("n"))


@R.add("""with x as (select o_custkey, count(*) as n, sum(o_totalprice) as t from orders group by 1), y as (select o_custkey, least(1.0, n / 20.0) as q1, least(1.0, t / 5e6) as q2, 0.5 as c1, least(1.0, n / 30.0) as c2 from x),
w as (select *, sqrt(greatest(c1, 1e-5) * 0.25) as w1, sqrt(greatest(c2, 1e-5) * 0.75) as w2 from y)
select o_custkey, round((w1 * q1 + w2 * q2) / greatest(w1 + w2, 1e-5), 6) as score, round((greatest(c1, 1e-5) + greatest(c2, 1e-5)) / 2, 6) as confidence from w""")
def composite_score(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("double")).alias("t"))
    one = lambda c: F.least(F.lit(1.0), c)
    score, confidence = S.composite([(one(F.col("n") / 20.0), F.lit(0.5), 1.0), (one(F.col("t") / 5e6), one(F.col("n") / 30.0), 3.0)])
    return x.select("o_custkey", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"))


_COMPOSITE_SQL = """(select o_custkey, (w1 * q1 + w2 * q2) / greatest(w1 + w2, 1e-5) as score from (select *, sqrt(greatest(c1, 1e-5) * 0.25) as w1, sqrt(greatest(c2, 1e-5) * 0.75) as w2
from (select o_custkey, least(1.0, n / 20.0) as q1, least(1.0, t / 5e6) as q2, 0.5 as c1, least(1.0, n / 30.0) as c2 from (select o_custkey, count(*) as n, sum(o_totalprice) as t from orders group by 1))))"""


@R.add(f"with {_place_sql(_COMPOSITE_SQL, 'o_custkey', 'round(score, 6)')} select k as o_custkey, round(q, 4) as qtile from placed")
def composite_quantile(spark, d):
    return stats.quantile_map(composite_score(spark, d), "score", "q").select("o_custkey", F.round("q", 4).alias("qtile"))


@R.add("""with g as (select i / 20.0 as a, j / 20.0 as b, (20 - i - j) / 20.0 as c from range(21) t(i), range(21) u(j) where i + j <= 20), x as (select quality, toxic, doc_id % 7 / 7.0 as q, doc_id % 3 / 2.0 as r from labels),
w as (select a, b, c, sqrt(a) as wa, sqrt(0.5 * b) as wb, sqrt(0.25 * c) as wc from g), p as (select a, b, c, quality, case when a = 1 then toxic when b = 1 then q when c = 1 then r else (wa * toxic + wb * q + wc * r) / (wa + wb + wc) end as s from x, w),
k as (select a, b, c, avg(case abs((round(s, 9) >= .5)::int - quality) when 0 then 1.0 when 1 then exp(-.5) else 0.0 end) as gauss from p group by 1, 2, 3)
select round(a, 2) as a, round(b, 2) as b, round(c, 2) as c, round(gauss, 6) as gauss, round(gauss, 6) = (select max(round(gauss, 6)) from k) as best from k""")
def importance_grid(spark, d):
    rows = table(spark, d, "labels").select("quality", F.col("toxic").cast("double").alias("t"), (F.col("doc_id") % 7 / 7.0).alias("q"), (F.col("doc_id") % 3 / 2.0).alias("r"))
    # One pass: the grid is a list of 231 settings, each a column's worth of sums.
    grid = S.importance_grid(3)

    def gauss(w: tuple):
        one = next((c for c, x in zip("tqr", w) if x == 1), None)
        diff = F.abs((F.round(F.col(one) if one else _weighted(w), 9) >= 0.5).cast("int") - F.col("quality"))
        return F.avg(F.when(diff == 0, 1.0).when(diff == 1, F.exp(F.lit(-0.5))).otherwise(0.0))

    def _weighted(w: tuple):
        parts = [(F.sqrt(F.lit(c * i)), F.col(n)) for c, i, n in zip((1.0, 0.5, 0.25), w, "tqr")]
        return sum((a * b for a, b in parts[1:]), parts[0][0] * parts[0][1]) / sum((a for a, _ in parts[1:]), parts[0][0])

    sums = rows.agg(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(w, "abc")), F.round(gauss(w), 6).alias("gauss")) for w in grid)).alias("g"))
    best = F.array_max(F.transform("g", lambda x: x["gauss"]))
    return sums.select(F.explode("g").alias("x"), best.alias("top")).select(*(F.round(f"x.{n}", 2).alias(n) for n in "abc"), "x.gauss", (F.col("x.gauss") == F.col("top")).alias("best"))


_TFIDF = f"""with d as (select item_id as id, {_SQL_WORDS} as w from benchmark), n as (select count(*) as n from d),
tf as (select id, t, count(*) as tf from (select id, unnest(w) as t from d) group by 1, 2), df as (select t, count(*) as df from tf group by 1),
w as (select id, tf.t, tf * (ln((1 + n) / (1.0 + df)) + 1) as w from tf join df on tf.t = df.t, n), z as (select id, sqrt(sum(w * w)) as z from w group by 1), v as (select w.id, t, w / z as w from w join z on w.id = z.id)
"""


@R.add(_TFIDF + "select d.id as a, d.id + 1 as b, round(coalesce(sum(x.w * y.w), 0), 6) as score from d join d e on e.id = d.id + 1 left join v x on x.id = d.id left join v y on y.id = e.id and y.t = x.t group by 1, 2")
def tfidf_pairs(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), _words().alias("w"))
    pairs = b.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).join(b.select(F.col("id").alias("b")), "b", "left_semi")
    return scoring.pair_cosine(scoring.tf_idf(b, "id", "w"), "id", pairs).select("a", "b", F.round("score", 6).alias("score"))


@R.add(f"""with d as (select {_SQL_WORDS} as w from documents), one as (select w, count(*) as c from (select unnest(w) as w from d) group by 1), v as (select count(*) as v from one),
p as (select a, b, count(*) as n from (select unnest(w[:-2]) as a, unnest(w[2:]) as b from d where len(w) > 1) group by 1, 2 having count(*) >= 5)
select p.a, p.b, p.n, round((p.n - 5) * v / (x.c * y.c)::double, 6) as score from p join one x on x.w = p.a join one y on y.w = p.b, v where (p.n - 5) * v / (x.c * y.c)::double > 10""")
def phrase_bigrams(spark, d):
    out = scoring.phrases(table(spark, d, "documents").select(_words().alias("w")), "w")
    return out.select("a", "b", "n", F.round("score", 6).alias("score"))


@R.add(f"""with d as (select doc_id, {_SQL_WORDS} as w from documents) select t as term, count(*) as df from (select doc_id, unnest(list_distinct(w)) as t from d) group by 1 having count(*) >= 20 and count(*) <= 0.4 * (select count(*) from d)""")
def dict_prune(spark, d):
    return scoring.prune_dictionary(table(spark, d, "documents").select("doc_id", _words().alias("w")), "doc_id", "w")


@R.add(f"""with d as (select role, {_SQL_WORDS} as w from conversations), n as (select role, count(*) as n from d group by 1),
s as (select role, w, sum(1.0 / len) as s from (select role, unnest(w) as w, len(w) as len from d) group by 1, 2), a as (select s.role, w as word, round(s / n, 9) as average from s join n on s.role = n.role)
select role, word, round(average, 6) as average, round((rank() over (partition by role order by average) - 1) * 100.0 / count(*) over (partition by role), 6) as percentile from a""")
def word_avg_percentile(spark, d):
    c = table(spark, d, "conversations").select("role", _words().alias("w"))
    out = scoring.average_word_scores(scoring.word_shares(c, "w", "scores"), "role", "scores")
    return out.select("role", "word", F.round("average", 6).alias("average"), F.round("percentile", 6).alias("percentile"))


@R.add("""with u as (select user_id, list_distinct(list(event_type)) as s from events group by 1), r as (select list_distinct(list(event_type)) as j from events where event_id % 2 = 0)
select user_id, array_to_string(list_sort(list_intersect(s, j)), ',') as found, array_to_string(list_sort(list_filter(j, lambda x: not list_contains(s, x))), ',') as missing from u, r""")
def found_missing_skills(spark, d):
    e = table(spark, d, "events")
    u = e.groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    r = F.broadcast(e.where("event_id % 2 = 0").agg(F.collect_set("event_type").alias("j")))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return u.crossJoin(r).select("user_id", join(F.array_intersect("s", "j")).alias("found"), join(F.array_except("j", "s")).alias("missing"))


def _generation(compat: bool):
    def run(spark, d):
        p = table(spark, d, "part").select("p_partkey", F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("c"), F.array(F.concat(F.lit("Brand#"), (F.col("p_partkey") % 5 + 1).cast("string"), F.lit("1")), (F.col("p_partkey") % 50).cast("string")).alias("pool"))
        return p.select("p_partkey", F.round(S.generation_score(F.lit(1), F.array("c"), F.col("pool"), F.lit(2), 1.0, compat), 6).alias("score"))

    return run


def _generation_sql(none: str) -> str:
    return f"""with p as (select p_partkey, [p_brand, p_type, p_size::varchar] as c, ['Brand#' || (p_partkey % 5 + 1) || '1', (p_partkey % 50)::varchar] as pool from part),
g as (select p_partkey, case when list_contains(pool, c[1]) then 1 when list_contains(pool, c[2]) then 2 when list_contains(pool, c[3]) then 3 else 0 end as g from p)
select p_partkey, round((1 + case when g = 0 then {none} else exp(-g) end) / 2, 6) as score from g"""


QUERIES["generation_decay"], SQL["generation_decay"] = _generation(True), _generation_sql("1.0")
QUERIES["generation_decay_strict"], SQL["generation_decay_strict"] = _generation(False), _generation_sql("0.0")


_ASSIGNED = """with o as (select o_custkey as k, o_totalprice::double / 1e5 as x, ((o_orderkey * 7919) % 1000) / 200.0 as y from orders),
a as (select k, x, row_number() over (partition by k order by x) as r from o), b as (select k, y, row_number() over (partition by k order by y) as r from o)
"""


def _order_pairs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 1e5).alias("x"), ((F.col("o_orderkey") * 7919) % 1000 / 200.0).alias("y"))
    a, b = o.select("k", F.col("id").alias("a"), "x"), o.select("k", F.col("id").alias("b"), "y")
    return a.join(b, "k").select("k", "a", "b", (-((F.col("x") - F.col("y")) ** 2)).alias("s"))


@R.add(_ASSIGNED + "select a.k, count(*) as n, round(sum(-(x - y) * (x - y)), 4) as total from a join b on a.k = b.k and a.r = b.r group by 1")
def assign_optimal(spark, d):
    """The least sum of squares between two lists is that of both in order, which is what the SQL adds up."""
    best = scoring.optimal_assignment(_order_pairs(spark, d), "k", "a", "b", "s")
    return best.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 4).alias("total"))


@R.add(_ASSIGNED + "select a.k, count(*) as n, round(sum(-(x - y) * (x - y)), 4) as total from a join b on a.k = b.k and a.r = b.r group by 1")
def assign_sorted(spark, d):
    """The same matching by the order of both lists, without pairs."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("double") / 1e5).alias("x"), ((F.col("o_orderkey") * 7919) % 1000 / 200.0).alias("y"))
    best = scoring.sorted_assignment(o.select("k", "id", F.col("x").alias("v")), o.select("k", "id", F.col("y").alias("v")), "k", "id", "v")
    return best.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(-((F.col("a") - F.col("b")) ** 2)), 4).alias("total"))


@R.add("select c.c_custkey, round(coalesce(quantile_cont(o.o_totalprice::double, .8), 0.0), 4) as score from customer c left join orders o on o.o_custkey = c.c_custkey group by 1")
def assigned_quantile(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("double").alias("s"))
    return scoring.assigned_quantile(table(spark, d, "customer"), "c_custkey", o, "s", 0.8).select("c_custkey", F.round("score", 4).alias("score"))


def _sql_hashed(x: str) -> str:
    for f, bits in zip(scoring.FACTORS, (15, 13)):
        x = f"list_transform([(({x}) % {scoring.PRIME} * {f} % {scoring.PRIME})::bigint], lambda u: xor(u, u >> {bits}))[1]"
    return x


#: Where the permutation of seed s sends place p below n.
_SQL_PERMUTED = (
    f"list_reduce([z::bigint for z in range({scoring.ROUNDS})], lambda x, i: list_transform([{{{{'y': (({_sql_hashed('{s} * 1009 + i * 7919 + 17')}::bigint * {scoring.PRIME} + {_sql_hashed('{s} * 9176 + i * 613 + 5')} - x) % {{n}} + {{n}}) % {{n}}, 'b': {_sql_hashed('{s} * 9176 + i * 613 + 5')}}}}}],"
    f" lambda q: case when ({_sql_hashed('greatest(x, q.y) + q.b')} // 32) % 2 = 1 then q.y else x end)[1], {{p}}::bigint)"
)


@R.add(f"""with c as (select conv_id, turn, {_SQL_WORDS} as w from conversations), p as (select a.conv_id || '-' || a.turn as id, b.w as r from c a join c b on a.conv_id = b.conv_id and a.turn + 1 = b.turn where a.turn % 2 = 0),
x as (select id, r, row_number() over (order by id) - 1 as n, count(*) over () as m from p), y as (select id, {_SQL_PERMUTED.format(p='n', n='m', s='1')} as f from x) select y.id, md5(array_to_string(x.r, ' ')) as dealt from y join x on x.n = y.f""")
def shuffled_right(spark, d):
    out = scoring.shuffled_right(_turns(spark, d).select("id", "r"), "id", "r", 1)
    return out.select("id", F.md5(F.array_join("r", " ").cast("binary")).alias("dealt"))


@R.add("select vec_id from (select vec_id from embeddings order by md5('13:' || vec_id), vec_id limit 10)")
def random_sample(spark, d):
    return scoring.random_right(table(spark, d, "embeddings"), "vec_id", "vec_id", 10)


@R.add("""with s as (select embedding::double[] as r from embeddings order by md5('8:' || vec_id), vec_id limit 5)
select vec_id, round(max(list_dot_product(e.embedding::double[], r) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) / sqrt(list_dot_product(r, r))), 6) as best from embeddings e, s group by 1""")
def sampled_cosines(spark, d):
    e = table(spark, d, "embeddings")
    out = scoring.left_by_sample(e, "vec_id", "embedding", scoring.random_right(e, "vec_id", "embedding", 5), "embedding")
    return out.select("vec_id", F.round(F.array_max("scores"), 6).alias("best"))


@R.add()
def shuffle_confidence(spark, d):
    t = _turns(spark, d)
    sizes = lambda x: x.select("id", "score", F.ceil(F.col("n_elem") / 50).cast("long").alias("n_elem"))
    # Written once: it feeds the percentile, the fits and the result.
    actual = written(sizes(scoring.left_overlap(t, "id", "l", "r")))
    null = scoring.permutations(t, "id", "l", "r", 2)
    fits = scoring.overlap_confidence(actual, sizes(null), least=20)
    return scoring.bucket_confidence(actual, "id", fits).select("id", F.round("confidence", 6).alias("confidence"))


@R.add(f"""with d as (select doc_id, {_SQL_WORDS} as w from documents), n as (select count(*) as n from d), tf as (select doc_id, t, count(*) as tf from (select doc_id, unnest(w) as t from d) group by 1, 2),
df as (select t, count(*) as df from tf group by 1), w as (select doc_id, tf.t, tf * log2(n / df::double) as w from tf join df on tf.t = df.t, n where df < n), z as (select doc_id, sqrt(sum(w * w)) as z from w group by 1)
select w.doc_id, round(sum(w.w / z), 5) as total, count(*) as terms from w join z on w.doc_id = z.doc_id group by 1""")
def tfidf_log2(spark, d):
    out = scoring.tf_idf_log2(table(spark, d, "documents").select("doc_id", _words().alias("w")), "doc_id", "w")
    return out.groupBy("doc_id").agg(F.round(F.sum("weight"), 5).alias("total"), F.count(F.lit(1)).alias("terms"))


@R.add(f"""with d as (select doc_id, {_SQL_WORDS} as w from documents), k as (select t from (select doc_id, unnest(list_distinct(w)) as t from d) group by 1 having count(*) >= 20 and count(*) <= 0.4 * (select count(*) from d))
select doc_id, t as term, count(*) as n from (select doc_id, unnest(w) as t from d) semi join k using (t) group by 1, 2""")
def bag_of_words(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _words().alias("w"))
    return scoring.bag_of_words(docs, "doc_id", "w", scoring.prune_dictionary(docs, "doc_id", "w"))


def _sql_joined(source: str, out: str) -> str:
    """Tables ending in out(id, w): source's words with frequent neighbours joined, from the left: of a run of pairs every other one."""
    return f"""{out}_p as materialized (select id, w, unnest(range(1, len(w) + 1)) as i from {source}), {out}_c as materialized (select w[i] as a, count(*) as c from {out}_p group by 1),
{out}_n as (select w[i] as a, w[i + 1] as b, count(*) as n from {out}_p where i < len(w) group by 1, 2 having count(*) >= 3),
{out}_f as materialized (select n.a, n.b from {out}_n n join {out}_c x on x.a = n.a join {out}_c y on y.a = n.b where (n.n - 3) * (select count(*) from {out}_c) / (x.c * y.c)::double > 10),
{out}_h as (select id, i, i - row_number() over (partition by id order by i) as run from {out}_p join {out}_f on w[i] = a and w[i + 1] = b where i < len(w)),
{out}_t as materialized (select id, i from (select id, i, (i - min(i) over (partition by id, run)) % 2 as odd from {out}_h) where odd = 0),
{out} as materialized (select p.id, coalesce(list(case when t.i is not null then p.w[p.i] || '_' || p.w[p.i + 1] else p.w[p.i] end order by p.i) filter (where q.i is null), []) as w from {out}_p p left join {out}_t t on t.id = p.id and t.i = p.i left join {out}_t q on q.id = p.id and q.i = p.i - 1 group by p.id)"""


@R.add(f"""with d as materialized (select item_id as id, {_SQL_WORDS} as w from benchmark), {_sql_joined('d', 'two')}, {_sql_joined('two', 'three')}
select d.id as item_id, len(d.w) as words, array_to_string(list_sort(list_distinct(list_filter(list_concat(two.w, three.w), lambda x: contains(x, '_') and not list_contains(d.w, x)))), ' ') as phrases from d join two on two.id = d.id join three on three.id = d.id""")
def phrase_texts(spark, d):
    """The joined pairs and triples that a text's words are given."""
    b = table(spark, d, "benchmark").select("item_id", _words().alias("w"))
    out = scoring.with_phrases(b, "item_id", "w", 3).join(b.select(F.col("item_id").alias("i"), F.size("w").cast("long").alias("words")), F.col("item_id") == F.col("i"))
    added = F.slice("w", (F.col("words") + 1).cast("int"), F.greatest((F.size("w") - F.col("words")).cast("int"), F.lit(0)))
    return out.select("item_id", "words", F.array_join(F.array_sort(added), " ").alias("phrases"))


@R.add("""with e as (select event_id, (event_id % 4)::int as t1, (event_id % 7)::int as t2, event_type as w, value from events), tp as (select event_id, unnest([t1, t2 + 4]) as topic, unnest([1.25, 0.5]) as p from e),
phi as (select (event_id % 11)::int as topic, event_type as word, avg(value) / 10 as weight from events group by 1, 2), sh as (select topic, word, round(case when weight > 1 then weight - floor(weight) else weight end, 7) as weight from phi)
select event_id, word, round(arg_max(case when p > 1 then p - floor(p) else p end * weight, topic), 6) as score from tp join sh using (topic) group by 1, 2""")
def topic_scores(spark, d):
    e = table(spark, d, "events")
    topics = e.select("event_id", F.explode(F.array(F.struct((F.col("event_id") % 4).cast("int").alias("topic"), F.lit(1.25).alias("p")), F.struct((F.col("event_id") % 7 + 4).cast("int").alias("topic"), F.lit(0.5).alias("p")))).alias("x")).select("event_id", "x.topic", "x.p")
    phi = e.groupBy((F.col("event_id") % 11).cast("int").alias("topic"), F.col("event_type").alias("word")).agg((F.avg("value") / 10).alias("weight"))
    return scoring.topic_word_scores(topics, phi, "event_id").select("event_id", "word", F.round("score", 6).alias("score"))


@R.add("select event_id, round((value / 100) * 0.25 / nullif(value / 50, 0), 6) as p, (value > 50)::int + (event_id % 2 = 0)::int + (event_id % 3 = 0)::int + (user_id % 2 = 0)::int + (user_id % 5 = 0)::int >= 3 as vote from events")
def bayes_and_votes(spark, d):
    e, v = table(spark, d, "events"), F.col("value")
    flags = (v > 50, F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.col("user_id") % 2 == 0, F.col("user_id") % 5 == 0)
    return e.select("event_id", F.round(S.bayes(v / 100, F.lit(0.25), v / 50), 6).alias("p"), S.votes(*flags).alias("vote"))


@R.add("with v as (select vec_id, [list_dot_product(embedding::double[], embedding::double[]) / 64, vec_id % 11 / 10.0, vec_id % 6 / 5.0] as s from embeddings) select vec_id, round(list_min(s), 6) as least, round(list_max(s), 6) as greatest, round(list_avg(s), 6) as mean, case when s[3] >= 0 and s[3] < .2 then 1 when s[3] > .2 and s[3] < .4 then 2 when s[3] > .4 and s[3] < .6 then 3 when s[3] > .6 and s[3] < .8 then 4 else 5 end as fifth from v")
def score_lists(spark, d):
    x = F.col("embedding").cast("array<double>")
    e = table(spark, d, "embeddings").select("vec_id", F.array(S.dot(x, x) / 64, F.col("vec_id") % 11 / 10.0, F.col("vec_id") % 6 / 5.0).alias("s"))
    return e.select("vec_id", *(F.round(c, 6).alias(n) for n, c in stats.list_stats(F.col("s")).items()), S.threshold_bucket(F.get("s", F.lit(2))).alias("fifth"))


@R.add()
def w2v_similarity(spark, d):
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    b = table(spark, d, "benchmark").select("item_id", _words().alias("w"))
    model = Word2Vec(vectorSize=500, windowSize=25, minCount=1, stepSize=0.01, seed=7, inputCol="w", outputCol="v").fit(b)
    v = model.getVectors().select("word", vector_to_array("vector").alias("v"))
    # All pairs of neighbouring words, 0 where one has no vector.
    at = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))
    pairs = b.where("size(w) > 1").select(F.explode(at).alias("p")).select("p.a", "p.b").distinct()
    left, right = v.select(F.col("word").alias("a"), F.col("v").alias("x")), v.select(F.col("word").alias("b"), F.col("v").alias("y"))
    return pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce(S.cosine(F.col("x"), F.col("y")), F.lit(0.0)).alias("score"))


def _topics(spark, d, k: int = 22):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    b = table(spark, d, "benchmark").select("item_id", _words().alias("w"))
    cv = CountVectorizer(inputCol="w", outputCol="features", minDF=2.0).fit(b)
    lda = LDA(k=k, maxIter=20, seed=100).fit(cv.transform(b))
    vocabulary = F.array(*map(F.lit, cv.vocabulary))
    rows = lda.describeTopics(10).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    return b, rows.select("topic", "rank", F.get(vocabulary, F.col("x.termIndices")).alias("term"), F.col("x.termWeights").alias("weight"))


@R.add()
def lda_topics(spark, d):
    return _topics(spark, d)[1]


@R.add()
def topic_coherence(spark, d):
    b, topics = _topics(spark, d)
    return scoring.coherence(b, "w", topics.select("topic", "term"))
