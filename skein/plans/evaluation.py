"""Retrieval metrics and statistics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import evaluation as E
from skein.sources.tables import load
from skein.workspace import union

from .registry import registry

QUERIES, ORACLES, query = registry()

_RUN = """run AS (SELECT o_custkey AS case_id, o_orderkey % 40 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
 gold AS (SELECT DISTINCT o_custkey AS case_id, o_orderkey % 40 AS item FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT DISTINCT o_custkey, (o_orderkey + 7) % 40 FROM orders WHERE o_orderstatus = 'F')"""


def _run(spark, sf):
    from pyspark.sql import Window

    o = load(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    results = o.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 40).alias("item"), place.cast("long").alias("rank"))
    a = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 40).alias("item"))
    b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), ((F.col("o_orderkey") + 7) % 40).alias("item"))
    return results, union(a, b).distinct()


@query(f"""WITH {_RUN}, f AS (SELECT case_id, item, min(rank) AS rank FROM run GROUP BY 1, 2)
 SELECT g.case_id, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS recall_at_5, round(avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS recall_at_20
 FROM gold g LEFT JOIN f ON g.case_id = f.case_id AND g.item = f.item GROUP BY g.case_id""")
def recall_at_k(spark, sf):
    return E.recall_at(*_run(spark, sf), [5, 20])


@query(f"""WITH {_RUN}, f AS (SELECT case_id, item, min(rank) AS rank FROM run GROUP BY 1, 2), n AS (SELECT case_id, count(*) AS n FROM gold GROUP BY 1),
 h AS (SELECT f.case_id, max(1.0::DOUBLE / rank) AS mrr, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM f JOIN gold g ON f.case_id = g.case_id AND f.item = g.item GROUP BY 1)
 SELECT n.case_id, round(coalesce(mrr, 0), 9) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 0), 9) AS ndcg FROM n LEFT JOIN h ON n.case_id = h.case_id""")
def mrr_ndcg(spark, sf):
    return E.mrr_ndcg(*_run(spark, sf))


@query("""WITH run AS (SELECT o_custkey AS case_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
 judged AS (SELECT o_custkey AS case_id, o_orderkey AS item, o_orderkey % 3 = 0 AS relevant FROM orders WHERE o_orderkey % 5 <> 0),
 s AS (SELECT case_id, rank, relevant, coalesce(sum(CASE WHEN relevant THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM run JOIN judged USING (case_id, item) WHERE rank <= 20),
 z AS (SELECT case_id, count(*) FILTER (relevant) AS r, count(*) FILTER (NOT relevant) AS n FROM judged GROUP BY case_id),
 t AS (SELECT s.case_id, sum(greatest(1 - least(bad, r)::DOUBLE / greatest(least(r, n), 1), 0)) AS v FROM s JOIN z ON s.case_id = z.case_id WHERE relevant GROUP BY s.case_id)
 SELECT z.case_id, round(coalesce(v / r, 0), 9) AS bpref FROM z LEFT JOIN t ON z.case_id = t.case_id WHERE r > 0""")
def bpref(spark, sf):
    from pyspark.sql import Window

    o = load(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    run = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), place.alias("rank"))
    return E.bpref(run, o.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 3 == 0).alias("relevant")))


@query("""WITH r AS (SELECT o_custkey AS case_id, o_orderpriority AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
 s AS (SELECT *, row_number() OVER (PARTITION BY case_id, path ORDER BY rank) > 1 AS seen FROM r) SELECT case_id, round(avg(CASE WHEN seen THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS redundancy FROM s WHERE rank <= 10 GROUP BY case_id""")
def redundancy(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return E.redundancy(load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("path"), place.alias("rank")), 10)


@query("""WITH t AS (SELECT event_type AS metric, round(avg(value) / 10000.0::DOUBLE, 9) AS p FROM events GROUP BY 1),
 r AS (SELECT metric, p, least(1.0::DOUBLE, p * (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1)) AS raw FROM t),
 a AS (SELECT metric, p, round(max(raw) OVER (ORDER BY p, metric ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM r) SELECT *, adjusted <= 0.05 AS rejected FROM a""")
def holm(spark, sf):
    tests = load(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value") / 10000.0, 9).alias("p"))
    return E.holm(tests)


@query()
def bootstrap_ci(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return E.bootstrap(e, "event_type", "value")


@query()
def permutation_test(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("id"), (F.col("value") - 50).alias("delta"))
    return E.permutation(e)


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return E.percentiles(load(spark, sf, "events"), "event_type", "value")


@query("""SELECT event_type, CAST(count(*) FILTER (value <= 1) AS BIGINT) AS le_0, CAST(count(*) FILTER (value <= 10) AS BIGINT) AS le_1, CAST(count(*) FILTER (value <= 100) AS BIGINT) AS le_2, CAST(count(*) AS BIGINT) AS le_inf, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def histogram_cumulative(spark, sf):
    return E.cumulative_histogram(load(spark, sf, "events"), "event_type", "value", [1.0, 10.0, 100.0])


@query("""SELECT l_returnflag, CAST(count(*) FILTER (l_linestatus = 'F') AS BIGINT) AS "F", CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS "O" FROM lineitem GROUP BY l_returnflag""")
def confusion_matrix(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return rows.na.fill(0)


@query("""SELECT user_id, CAST(count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS BIGINT) AS viewed, CAST(count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS BIGINT) AS bought, CAST(count(DISTINCT event_type) AS BIGINT) AS stages FROM events GROUP BY user_id""")
def funnel(spark, sf):
    stage = lambda k: F.countDistinct(F.when(F.col("event_type") == k, F.col("event_id")))
    return load(spark, sf, "events").groupBy("user_id").agg(stage("view").alias("viewed"), stage("purchase").alias("bought"), F.countDistinct("event_type").alias("stages"))


@query("""WITH p AS (SELECT o_custkey AS case_id, o_orderkey % 40 AS item, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS systems FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 20 GROUP BY 1, 2)
 SELECT * FROM p WHERE item % 2 = 1""")
def adjudication(spark, sf):
    from pyspark.sql import Window

    o = load(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    run = o.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 40).alias("item"), F.col("o_orderstatus").alias("system"), place.alias("rank"))
    return E.adjudication_queue(run, run.where("item % 2 = 0"))


@query("""WITH p AS (SELECT event_type, user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY 1, 2)
 SELECT event_type, CAST(count(b - a) AS BIGINT) AS n, round(avg(b - a), 9) AS delta, round(avg(b - a) / stddev_samp(b - a), 9) AS effect FROM p GROUP BY event_type""")
def paired_effect(spark, sf):
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    mean = lambda test: F.avg(F.when(test, F.col("value")))
    return E.paired_effect(load(spark, sf, "events").groupBy("event_type", "user_id").agg(mean(half).alias("base"), mean(~half).alias("candidate")), "event_type")


@query("""WITH v AS (SELECT l_orderkey % 2 = 1 AS late, avg(l_discount) AS discount, avg(l_tax) AS tax, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1),
 u AS (SELECT late, 'discount' AS metric, discount AS value FROM v UNION ALL SELECT late, 'tax', tax FROM v UNION ALL SELECT late, 'quantity', quantity FROM v)
 SELECT a.metric, round(a.value, 9) AS base, round(b.value, 9) AS candidate, CASE WHEN a.metric = 'tax' THEN round(b.value, 9) - round(a.value, 9) ELSE round(a.value, 9) - round(b.value, 9) END <= 0.0001 AS passed
 FROM u a JOIN u b ON a.metric = b.metric AND NOT a.late AND b.late""")
def guardrails(spark, sf):
    names = ("discount", "tax", "quantity")
    rows = load(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 2 == 1).alias("late")).agg(*[F.round(F.avg(f"l_{n}"), 9).alias(n) for n in names])
    rows = rows.unpivot(["late"], list(names), "metric", "value")
    return E.guardrails(rows.where("NOT late").drop("late"), rows.where("late").drop("late"), ["tax"], 0.0001)


@query(f"""WITH {_RUN}, r AS (SELECT DISTINCT case_id, item, 'by_price' AS route FROM run WHERE rank <= 5
 UNION SELECT case_id, item, 'by_date' FROM (SELECT o_custkey AS case_id, o_orderkey % 40 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5),
 h AS (SELECT case_id, item, route, count(*) OVER (PARTITION BY case_id, item) AS n FROM r JOIN gold USING (case_id, item))
 SELECT route, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (n = 1) AS BIGINT) AS only FROM h GROUP BY route""")
def marginal_utility(spark, sf):
    from pyspark.sql import Window

    run, gold = _run(spark, sf)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    late = load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 40).alias("item"), place.alias("rank"))
    top = lambda rows, route: rows.where("rank <= 5").select("case_id", "item", F.lit(route).alias("route"))
    return E.marginal_utility(union(top(run, "by_price"), top(late, "by_date")), gold)


@query(f"""WITH {_RUN}, r AS (SELECT DISTINCT case_id, item FROM run), g AS (SELECT DISTINCT case_id, item, 1 AS good FROM gold), w AS (SELECT case_id, count(*) AS wanted FROM g GROUP BY 1),
 s AS (SELECT r.case_id, r.item, good, z FROM r LEFT JOIN g USING (case_id, item), unnest(range(5)) AS t(z)),
 p AS (SELECT *, row_number() OVER (PARTITION BY case_id, z ORDER BY md5('7:' || z || ':' || case_id || ':' || item), item) AS place FROM s),
 e AS (SELECT case_id, z, coalesce(1.0::DOUBLE / min(place) FILTER (good = 1), 0) AS mrr, sum(CASE WHEN good = 1 AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM unnest(range(1, CAST(least(wanted, 10) + 1 AS BIGINT))) AS u(i)) AS ndcg FROM p JOIN w USING (case_id) GROUP BY case_id, z, wanted),
 c AS (SELECT case_id, avg(mrr) AS a, stddev_pop(mrr) AS b, avg(ndcg) AS c, stddev_pop(ndcg) AS d FROM e GROUP BY 1)
 SELECT 'mrr' AS metric, round(avg(a), 6) AS mean, round(avg(b), 6) AS spread, count(*) AS cases FROM c UNION ALL SELECT 'ndcg', round(avg(c), 6), round(avg(d), 6), count(*) FROM c""")
def position_sensitivity(spark, sf):
    from skein.operators import metrics

    run, gold = _run(spark, sf)
    return metrics.position_sensitivity(run, gold, 5, "7")
