"""Counts, histograms, agreement, correlation, coverage and thresholds."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import years_from_text
from ..operators import stats
from ..sources import table
from .base import Registry

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("select event_type as value, count(*) as n, round(count(*) / sum(count(*)) over ()::double, 6) as share, row_number() over (order by count(*) desc, event_type) as rank from events group by 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type").select("value", "n", F.round("share", 6).alias("share"), F.col("rank").cast("long").alias("rank"))


@R.add("""with l as (select unnest([0, 1]) as v), g as (select a.v as pred, b.v as label from l a, l b) select g.pred, g.label, count(x.doc_id) as n from g left join labels x on x.toxic = g.pred and x.quality = g.label group by 1, 2""")
def xtab(spark, d):
    return stats.crosstab(table(spark, d, "labels"), "toxic", "quality", [0, 1])


@R.add("""with x as (select abs(l_linenumber - (l_quantity::int % 7 + 1)) as d from lineitem) select count(*) as n, sum((d = 0)::int)::bigint as n_correct, round(avg((d = 0)::int), 6) as exact, round(avg(case d when 0 then 1 when 1 then .5 else 0 end), 6) as half, round(avg(case when d <= 2 then exp(-d * d / 2.0) else 0 end), 6) as gauss from x""")
def agreement(spark, d):
    out = stats.agreement(table(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_quantity").cast("int") % 7 + 1)
    return out.select("n", "n_correct", *(F.round(c, 6).alias(c) for c in ("exact", "half", "gauss")))


@R.add("""with p as (select user_id, var_samp(value) as v from events group by 1), c as (select round(v, 0) as var, count(*) as n from p where v is not null group by 1)
select var, n, round(n / sum(n) over ()::double, 6) as fraction, round(sum(n) over (order by var) / sum(n) over ()::double, 6) as cdf from c""")
def rater_pivot(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.var_samp("value").alias("v")).where("v is not null")
    c = v.groupBy(F.round("v", 0).alias("var")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("var", "n", F.round(F.col("n") / total, 6).alias("fraction"), F.round(F.sum("n").over(Window.orderBy("var")) / total, 6).alias("cdf"))


_HIST = "with h as (select event_type as grp, floor(value / 10 + .5)::int as bin, count(*) as n from events where floor(value / 10 + .5) between 0 and 15 group by 1, 2), e as (select grp, bin, n, n / sum(n) over (partition by grp)::double as density from h)"


def _hist(spark, d):
    return stats.histogram(table(spark, d, "events").select("event_type", (F.col("value") / 10).alias("v")), "event_type", "v")


@R.add(_HIST + " select grp, bin, n, round(density, 6) as density from e")
def histogram(spark, d):
    return _hist(spark, d).select("grp", "bin", "n", F.round("density", 6).alias("density"))


@R.add(_HIST + """, s as (select g.grp, b.bin, coalesce(e.density, 0) as x from (select distinct grp from e) g cross join (select unnest(range(16))::int as bin) b left join e on e.grp = g.grp and e.bin = b.bin),
c as (select grp, bin, sum(x) over (partition by grp order by bin) as c from s) select a.grp as a, b.grp as b, round(sum(abs(a.c - b.c)), 6) as distance from c a join c b on a.bin = b.bin and a.grp < b.grp group by 1, 2""")
def hist_cdf_distance(spark, d):
    return stats.cdf_distance(_hist(spark, d)).select("a", "b", F.round("distance", 6).alias("distance"))


@R.add("select event_type, round(quantile_cont(value, .25), 6) as q1, round(quantile_cont(value, .5), 6) as med, round(quantile_cont(value, .75), 6) as q3, round(quantile_cont(value, .25), 1) || ' - ' || round(quantile_cont(value, .75), 1) as middle from events group by 1")
def iqr_by_group(spark, d):
    out = stats.group_quantiles(table(spark, d, "events"), "event_type", "value", [0.25, 0.5, 0.75])
    return out.select("event_type", *(F.round(f"q_{k}", 6).alias(n) for k, n in enumerate(("q1", "med", "q3"))), stats.range_text(F.round("q_0", 1), F.round("q_2", 1)).alias("middle"))


@R.add("select round(corr(l_quantity, l_extendedprice), 6) as quantity_price, round(corr(l_quantity, l_discount), 6) as quantity_discount, round(corr(l_extendedprice, l_tax), 6) as price_tax from lineitem")
def corr_matrix(spark, d):
    c = lambda a, b, n: F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(n)
    return table(spark, d, "lineitem").agg(c("l_quantity", "l_extendedprice", "quantity_price"), c("l_quantity", "l_discount", "quantity_discount"), c("l_extendedprice", "l_tax", "price_tax"))


@R.add("select k as event_type, round(corr(value, (event_type = k)::int), 6) + 0.0 as r from events, (select distinct event_type as k from events) group by 1")
def onehot_corr(spark, d):
    e = table(spark, d, "events")
    kinds = F.broadcast(e.select(F.col("event_type").alias("k")).distinct())
    return e.crossJoin(kinds).groupBy(F.col("k").alias("event_type")).agg((F.round(F.corr("value", (F.col("event_type") == F.col("k")).cast("double")), 6) + F.lit(0.0)).alias("r"))


@R.add("select c_custkey, round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as x from customer")
def min_max_scale(spark, d):
    c = table(spark, d, "customer")
    ends = F.broadcast(c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")))
    return c.crossJoin(ends).select("c_custkey", F.round((F.col("c_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("x"))


@R.add("select source, round(avg((n_chars > 1000)::int) * 100, 6) as long_share, round(avg((text is not null)::int) * 100, 6) as held from documents group by 1")
def coverage(spark, d):
    share = lambda c: F.round(F.avg(c.cast("int")) * 100, 6)
    return table(spark, d, "documents").groupBy("source").agg(share(F.col("n_chars") > 1000).alias("long_share"), share(F.col("text").isNotNull()).alias("held"))


@R.add("select floor(l_extendedprice / 5000)::int as bin, count(*) as n, round(avg(l_discount), 6) as m from lineitem group by 1")
def binned_mean(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("m"))


@R.add("with c as (select l_linenumber as label, count(*) as n from lineitem group by 1), s as (select label, round(sum(n) over (order by label) / sum(n) over ()::double, 6) as threshold from c) select * from s where label < (select max(label) from c)")
def label_thresholds(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    s = c.select("label", F.round(F.sum("n").over(Window.orderBy("label")) / F.sum("n").over(w), 6).alias("threshold"), F.max("label").over(w).alias("top"))
    return s.where("label < top").select("label", "threshold")


@R.add("""with x as (select event_id, case when value < 5 then null else least(greatest(value / 12, -1), 25) end as a, (props::json ->> 'k')::double as k from events), y as (select event_id, coalesce(a, k / 4) as a, coalesce(k / 4, a) as b from x)
select event_id, round((a + b) / 2, 6) as years, (a >= b)::int as meets, round(a - b, 6) as diff from y""")
def experience_merge(spark, d):
    k = F.get_json_object("props", "$.k").cast("double") / 4
    a = F.when(F.col("value") >= 5, F.least(F.greatest(F.col("value") / 12, F.lit(-1.0)), F.lit(25.0)))
    y = table(spark, d, "events").select("event_id", F.coalesce(a, k).alias("a"), F.coalesce(k, a).alias("b"))
    return y.select("event_id", F.round((F.col("a") + F.col("b")) / 2, 6).alias("years"), (F.col("a") >= F.col("b")).cast("int").alias("meets"), F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@R.add("""with t as (select event_id, case when value < 20 then 'NOT FOUND' else floor(value)::int::varchar end as a, case when event_id % 3 = 0 then 'NOT FOUND' else (event_id % 300)::varchar end as b from events),
n as (select event_id, replace(a, 'NOT FOUND', '-1')::double as a, replace(b, 'NOT FOUND', '-12')::double / 12 as b from t), c as (select event_id, nullif(greatest(-1, least(25, a)), -1) as a, nullif(greatest(-1, least(15, b)), -1) as b from n),
f as (select event_id, coalesce(a, b) as a, coalesce(b, a) as b from c) select event_id, round(a, 6) as a, round(b, 6) as b, round((a + b) / 2, 6) as years from f""")
def experience_text(spark, d):
    """Years of experience from two texts that may say NOT FOUND, one of them in months."""
    e = table(spark, d, "events")
    a = F.when(F.col("value") < 20, "NOT FOUND").otherwise(F.floor("value").cast("string"))
    b = F.when(F.col("event_id") % 3 == 0, "NOT FOUND").otherwise((F.col("event_id") % 300).cast("string"))
    c = e.select("event_id", years_from_text(a, 25).alias("x"), years_from_text(b, 15, 12).alias("y"))
    f = c.select("event_id", F.coalesce("x", "y").alias("a"), F.coalesce("y", "x").alias("b"))
    return f.select("event_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round((F.col("a") + F.col("b")) / 2, 6).alias("years"))


@R.add("select l_returnflag, l_linestatus, sum(l_quantity)::double as sum_qty, round(avg(l_extendedprice), 4) as avg_price, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2")
def group_mean(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("double")).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@R.add("""with r as (select event_type as g, value as v, row_number() over (partition by event_type order by md5('123:' || event_id), event_id) as n from events where value is not null)
select x.g as a, y.g as b, count(*) as n, round(avg(x.v - y.v) / (stddev_samp(x.v - y.v) / sqrt(count(*))), 6) as t from r x join r y on x.n = y.n and x.g <> y.g group by 1, 2""")
def t_tests(spark, d):
    return stats.paired_t_tests(table(spark, d, "events"), "event_type", "value", "event_id").select("a", "b", "n", F.round("t", 6).alias("t"))


@R.add()
def t_test_tails(spark, d):
    return stats.paired_t_tests(table(spark, d, "events"), "event_type", "value", "event_id").select("a", "b", "p")


@R.add("select user_id, round(avg(value) filter (where event_type = 'click'), 6) as click, round(avg(value) filter (where event_type = 'view'), 6) as view from events group by 1")
def rater_table(spark, d):
    out = stats.rater_table(table(spark, d, "events"), "user_id", "event_type", "value", ["click", "view"])
    return out.select("user_id", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@R.add("with r as (select distinct l_orderkey as k, l_returnflag as f, (max(l_quantity) over (partition by l_orderkey, l_returnflag))::int // 10 as q from lineitem) select x.f as a, y.f as b, x.q as rating_a, y.q as rating_b, count(*) as n from r x join r y on x.k = y.k and x.f < y.f group by 1, 2, 3, 4")
def rater_crosstabs(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.floor(F.max("l_quantity").cast("int") / 10).cast("int").alias("q"))
    return stats.rater_crosstabs(r, "l_orderkey", "l_returnflag", "q")


@R.add("with s as (select l_orderkey, count(l_linenumber) as n, sum(l_linenumber) as s, sum(l_linenumber * l_linenumber) as q from lineitem group by 1) select l_orderkey, round((n * q - s * s) / (n * (n - 1))::double, 6) as variance from s where n > 1 and n * q - s * s < n * (n - 1)")
def agreed_items(spark, d):
    return stats.agreed_items(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", F.round("variance", 6).alias("variance"))


_EVALUATED = "with x as (select l_linenumber as label, least(7, greatest(1, l_quantity::int % 9)) as pred from lineitem)"


def _evaluated(spark, d):
    predict = lambda df: F.least(F.lit(7), F.greatest(F.lit(1), F.col("l_quantity").cast("int") % 9))
    return stats.evaluate(table(spark, d, "lineitem"), predict, "l_linenumber", list(range(1, 8)))


@R.add(_EVALUATED + ", g as (select a.v::int as pred, b.v::int as label from range(1, 8) a(v), range(1, 8) b(v)) select g.pred, g.label, count(x.label) as n from g left join x on x.pred = g.pred and x.label = g.label group by 1, 2")
def evaluated_crosstab(spark, d):
    return _evaluated(spark, d)[0]


@R.add(_EVALUATED + " select count(*) as n, sum((pred = label)::int)::bigint as n_correct, round(avg((pred = label)::int), 6) as exact, round(avg(case abs(pred - label) when 0 then 1 when 1 then .5 else 0 end), 6) as half, round(avg(case when abs(pred - label) <= 2 then exp(-(pred - label) * (pred - label) / 2.0) else 0 end), 6) as gauss from x")
def evaluated_agreement(spark, d):
    return _evaluated(spark, d)[1].select("n", "n_correct", *(F.round(c, 6).alias(c) for c in ("exact", "half", "gauss")))


def _sql_power(transform: str, x: str, lam: str) -> str:
    if transform == "box_cox":
        return f"case when abs({lam}) < 1e-9 then ln({x}) else (pow({x}, {lam}) - 1) / {lam} end"
    up = f"case when abs({lam}) < 1e-9 then ln(1 + {x}) else (pow({x} + 1, {lam}) - 1) / {lam} end"
    return f"case when {x} >= 0 then {up} else case when abs({lam} - 2) < 1e-9 then -ln(1 - {x}) else -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) end end"


def _sigma_sql(transform: str, source: str, k: float, lam: float | None = None, refine: int = 1) -> str:
    """source: a select of g and v."""
    log = "ln(v)" if transform == "box_cox" else "sign(v) * ln(1 + abs(v))"
    fits = f"select g, lam, avg(y) as mean, stddev_pop(y) as sd, -count(*) / 2.0 * ln(var_pop(y)) + (lam - 1) * sum({log}) as likely from (select g, v, lam, {_sql_power(transform, 'v', 'lam')} as y from {{rows}}) group by g, lam"
    best = "select g, arg_max(lam, likely) as lam, arg_max(mean, likely) as mean, arg_max(sd, likely) as sd from ({fits}) group by g"
    parts = [
        f"src as ({source})",
        "o as (select g, v, row_number() over (partition by g order by v) - 1 as p, count(*) over (partition by g) as n from src where v is not null)",
        "m as (select *, case when n % 2 = 1 then round_even(n / 2.0, 0) else (n + 1) / 2.0 end as mid from o)",
        "sh as (select 0.34::double + j * 0.025::double as s, j from range(28) t(j))",
        "e as (select distinct g, n, j, greatest(0, ceil(mid - round_even(s * mid, 0)))::bigint as lo, least(n - 1, floor(mid + round_even(s * mid, 0)) + 1)::bigint as hi from m, sh)",
        "f as (select e.g, e.j, e.lo, e.hi from e join o a on a.g = e.g and a.p = e.lo join o b on b.g = e.g and b.p = e.hi where b.v > a.v qualify row_number() over (partition by e.g order by e.j) = 1)",
        "c as materialized (select o.g, o.v from o join f on o.g = f.g and o.p between f.lo and f.hi)",
    ]
    if lam is None:
        parts.append(f"l0 as materialized ({best.format(fits=fits.format(rows='c, (select round(i / 10 - 2, 1)::double as lam from range(61) t(i))'))})")
        for i in range(refine):
            near = f"(select c.g, c.v, l.lam + j * {10.0 ** -(i + 2)}::double as lam from c join l{i} l on c.g = l.g, range(-10, 11) t(j))"
            parts.append(f"l{i + 1} as materialized ({best.format(fits=fits.format(rows=near))})")
        last = f"l{refine}"
    else:
        parts.append(f"l as ({fits.format(rows=f'c, (select {lam}::double as lam)')})")
        last = "l"
    return f"with {', '.join(parts)} select c.g as grp, round(min(v), 1) as low, round(max(v), 1) as high from c join {last} l on c.g = l.g where abs({_sql_power(transform, 'v', 'lam')} - mean) / sd <= {k} group by c.g"


@R.add(_sigma_sql("yeo_johnson", "select event_type as g, value as v from events", 1.0))
def sigma_ranges(spark, d):
    return stats.sigma_ranges(table(spark, d, "events"), "event_type", "value")


@R.add(_sigma_sql("box_cox", "select l_returnflag as g, l_extendedprice::double as v from lineitem where l_extendedprice > 0", 1.0))
def box_cox_ranges(spark, d):
    return stats.sigma_ranges(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", transform="box_cox")


@R.add(_sigma_sql("yeo_johnson", "select l_linestatus || l_returnflag as g, (l_quantity - 25)::double as v from lineitem", 1.3, 0.5).replace("round(min(v), 1) as low, round(max(v), 1) as high", "round(min(v), 1) || ' - ' || round(max(v), 1) as years"))
def sigma_ranges_fixed(spark, d):
    """A given lambda, three sigmas cut to 1.3, the range as text."""
    rows = table(spark, d, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("flags"), (F.col("l_quantity") - 25).alias("v"))
    return stats.sigma_ranges(rows, "flags", "v", 1.3, lam=0.5).select("grp", stats.range_text(F.col("low"), F.col("high")).alias("years"))


@R.add("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2")
def windowed_counts(spark, d):
    from ..streaming import windowed_counts as counts

    return counts(table(spark, d, "events")).withColumns({"total": F.round("total", 6), "start": F.date_format("start", "yyyy-MM-dd HH:mm:ss")})
