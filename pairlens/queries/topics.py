"""Coherence and per-word topics on given topics, and what a trained model gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..models import topics as T
from ..sources import table
from .base import Registry
from .scores import _SQL_WORDS, _words

R = Registry()
QUERIES, SQL = R.queries, R.sql

WINDOW, TOP = 12, 6


@R.add(f"""with d as materialized (select conv_id * 1000 + turn as id, {_SQL_WORDS} as w from conversations), t as materialized (select id, len(w) as len, unnest(w) as w, generate_subscripts(w, 1) - 1 as p from d),
c as (select w, count(*) as n from t where length(w) > 3 group by 1), g as materialized (select ascii(w) - 97 as topic, w as term from c qualify row_number() over (partition by ascii(w) order by n desc, w) <= {TOP}),
tot as (select sum(greatest(1, len(w) - {WINDOW} + 1)) as n from d where len(w) > 0),
h as materialized (select distinct t.id, g.topic, g.term, s from t join g on t.w = g.term, lateral (select unnest(range(greatest(0, p - {WINDOW} + 1), least(p, greatest(0, t.len - {WINDOW})) + 1)) as s)),
n1 as (select topic, term, count(*) as n from h group by 1, 2), n2 as (select x.topic, x.term as a, y.term as b, count(*) as n from h x join h y on x.id = y.id and x.topic = y.topic and x.s = y.s group by 1, 2, 3),
q as (select x.topic, x.term as a, y.term as b, coalesce(n2.n, 0) / tot.n::double + 1e-12 as p, nx.n / tot.n::double as pa, ny.n / tot.n::double as pb from g x join g y on x.topic = y.topic cross join tot join n1 nx on nx.topic = x.topic and nx.term = x.term join n1 ny on ny.topic = y.topic and ny.term = y.term left join n2 on n2.topic = x.topic and n2.a = x.term and n2.b = y.term),
m as (select topic, a, b, ln(p / (pa * pb)) / -ln(p) as x from q), s as (select topic, b, sum(x) as y from m group by 1, 2),
e as (select m.topic, m.a, sum(m.x * s.y) / (sqrt(sum(m.x * m.x)) * sqrt(sum(s.y * s.y))) as c from m join s on m.topic = s.topic and m.b = s.b group by 1, 2)
select topic, round(avg(c), 5) as coherence from e group by 1""")
def window_coherence(spark, d):
    """Coherence of the most frequent longer words by first letter, in windows."""
    docs = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), _words().alias("w"))
    counts = docs.select(F.explode_outer("w").alias("term")).where("length(term) > 3").groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("topic", F.ascii("term") - 97)
    given = counts.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term"))).where(f"r <= {TOP}").select("topic", "term")
    return T.window_coherence(docs, "id", "w", given, WINDOW).select("topic", F.round("coherence", 5).alias("coherence"))


@R.add("""with n as (select user_id as k, event_type as word, count(*) as n from events group by 1, 2), s as (select distinct user_id as k, unnest([0, 1, 2]) as topic from events), t as (select k, topic, (1 + (k + topic) % 5) / 10.0 as p from s),
phi as (select (event_id % 3)::int as topic, event_type as word, count(*) / sum(count(*)) over (partition by (event_id % 3)::int)::double as phi from events group by 1, 2),
x as (select n.k, n.word, t.topic, n * p * phi / sum(p * phi) over (partition by n.k, n.word) as weight from n join t using (k) join phi on phi.topic = t.topic and phi.word = n.word)
select k, word, topic, round(weight, 5) as weight, row_number() over (partition by k, word order by weight desc, topic) as rank from x where weight >= 0.3""")
def word_topics(spark, d):
    """How many of a word's occurrences each of three given topics accounts for."""
    e = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("word"), (F.col("event_id") % 3).cast("int").alias("topic"))
    counts = e.groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    shares = e.select("k").distinct().select("k", F.explode(F.array(*map(F.lit, range(3)))).alias("topic")).withColumn("p", (1 + (F.col("k") + F.col("topic")) % 5) / 10.0)
    phi = e.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("topic"))).drop("n")
    return T.word_topics(counts, "k", shares, phi, 0.3).withColumn("weight", F.round("weight", 5)).withColumn("rank", F.col("rank").cast("long"))


def _docs(spark, d):
    return table(spark, d, "benchmark").select("item_id", _words().alias("w"))


@R.add()
def topic_sweep(spark, d):
    """Coherence and perplexity for several numbers of topics."""
    best, tried = T.Topics(iterations=5, window=20).sweep(_docs(spark, d), "item_id", "w", [2, 4, 8])
    return spark.createDataFrame([(k, c, p, k == best.k) for k, c, p in tried], "k int, coherence double, perplexity double, best boolean")


@R.add()
def trained_word_topics(spark, d):
    return T.Topics(4, 5).fit(_docs(spark, d), "w").word_topics(_docs(spark, d), "item_id", "w")
