"""Metrics of ranked line ranges: customers stand for cases, their orders for gold and results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.operators.graphs import owners
from skein.sources.tables import load

from .registry import registry

QUERIES, ORACLES, query = registry()

_TABLES = """cases AS (SELECT c_custkey AS case_id, c_custkey % 11 = 0 AS no_context FROM customer),
 ord AS (SELECT o_orderkey AS k, o_custkey AS case_id, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
 gold AS (SELECT case_id, k AS unit, 'f' || k % 9 AS path, k * 3 % 500 AS s, k * 3 % 500 + 15 AS e FROM ord WHERE o_orderpriority = '1-URGENT'),
 files AS (SELECT DISTINCT case_id, 'f' || k % 9 AS path FROM ord WHERE o_orderstatus = 'F' AND k % 3 = 0),
 judged AS (SELECT DISTINCT case_id, 'f' || k % 9 AS path FROM ord WHERE k % 4 = 0),
 res AS (SELECT case_id, rank, k, 'f' || (k + 2) % 9 AS path, k * 7 % 500 AS s, k * 7 % 500 + k % 30 AS e, 's' || k % 5 AS symbol, k % 6 <> 0 AS verified FROM ord WHERE k % 13 <> 0 AND rank <= 20)"""


class _Tables:
    def __init__(self, spark, sf):
        k = F.col("k")
        path = lambda n: F.concat(F.lit("f"), (n % 9).cast("string"))
        rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
        self.cases = load(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 11 == 0).alias("no_context"))
        o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("case_id"), "o_orderpriority", "o_orderstatus", rank.cast("long").alias("rank"))
        self.orders = o
        self.gold = o.where("o_orderpriority = '1-URGENT'").select("case_id", k.alias("unit"), path(k).alias("path"), (k * 3 % 500).alias("start"), (k * 3 % 500 + 15).alias("end"))
        self.files = o.where("o_orderstatus = 'F' AND k % 3 = 0").select("case_id", path(k).alias("path")).distinct()
        self.judged = o.where("k % 4 = 0").select("case_id", path(k).alias("path")).distinct()
        # results are rows of a ranking of 20; which of them cite something is part of the data
        shown = o.where("k % 13 <> 0 AND rank <= 20")
        self.results = shown.select("case_id", "rank", "k", path(k + 2).alias("path"), (k * 7 % 500).alias("start"), (k * 7 % 500 + k % 30).alias("end"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("symbol"), (k % 6 != 0).alias("verified"))


@query(f"""WITH {_TABLES}, p AS (SELECT case_id, path FROM files UNION SELECT case_id, path FROM gold),
 per AS (SELECT c.case_id, no_context, (SELECT count(*) FROM gold g WHERE g.case_id = c.case_id) AS units,
  (SELECT count(*) FROM gold g WHERE g.case_id = c.case_id AND EXISTS (SELECT 1 FROM res r WHERE r.case_id = g.case_id AND r.path = g.path AND g.s <= r.e AND r.s <= g.e)) AS met,
  (SELECT count(*) FROM p WHERE p.case_id = c.case_id) AS paths, (SELECT count(*) FROM p WHERE p.case_id = c.case_id AND EXISTS (SELECT 1 FROM res r WHERE r.case_id = p.case_id AND r.path = p.path)) AS found,
  (SELECT count(*) FROM res r WHERE r.case_id = c.case_id) AS n,
  (SELECT count(*) FROM res r WHERE r.case_id = c.case_id AND (case_id, path) NOT IN (SELECT case_id, path FROM p UNION SELECT case_id, path FROM judged)) AS unknown,
  (SELECT count(*) FROM res r WHERE r.case_id = c.case_id AND (case_id, path) IN (SELECT case_id, path FROM judged) AND (case_id, path) NOT IN (SELECT case_id, path FROM p)) AS decoys,
  (SELECT coalesce(sum(e - s + 1), 0) FROM res r WHERE r.case_id = c.case_id) AS lines, (SELECT avg(CASE WHEN verified THEN 1.0 ELSE 0.0 END::DOUBLE) FROM res r WHERE r.case_id = c.case_id) AS cited,
  (SELECT coalesce(sum(least(g.e, r.e) - greatest(g.s, r.s) + 1), 0) FROM gold g JOIN res r ON g.case_id = r.case_id AND g.path = r.path AND g.s <= r.e AND r.s <= g.e WHERE g.case_id = c.case_id) AS shared,
  (SELECT coalesce(sum(e - s + 1), 0) FROM res r WHERE r.case_id = c.case_id AND (case_id, path) IN (SELECT case_id, path FROM files)) AS whole FROM cases c),
 z AS (SELECT *, CASE WHEN paths > 0 THEN found / paths WHEN no_context AND n = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fr FROM per)
 SELECT case_id, round(CASE WHEN no_context THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN units > 0 THEN met / units ELSE fr END::DOUBLE, 9) AS recall, round(fr, 9) AS file_recall,
  CASE WHEN paths > 0 THEN (found = paths)::INT ELSE (n = 0)::INT END::DOUBLE AS file_success, CASE WHEN paths > 0 THEN (found > 0)::INT ELSE (no_context AND n = 0)::INT END::DOUBLE AS file_hit,
  round(CASE WHEN n = 0 OR no_context THEN 0.0 ELSE unknown / n END::DOUBLE, 9) AS unjudged_rate, round(CASE WHEN n = 0 THEN 0.0 WHEN no_context THEN 1.0 ELSE decoys / n END::DOUBLE, 9) AS decoy_rate,
  round(CASE WHEN lines > 0 THEN least(1.0, CASE WHEN units > 0 THEN shared ELSE whole END / lines) ELSE no_context::INT END::DOUBLE, 9) AS line_density, round(coalesce(cited, 1.0), 9) AS citation_correctness FROM z""")
def range_metrics(spark, sf):
    t = _Tables(spark, sf)
    return M.range_metrics(t.cases, t.gold, t.files, t.judged, t.results)


@query(f"""WITH {_TABLES}, g AS (SELECT DISTINCT case_id, 's' || k % 7 AS symbol FROM ord WHERE o_orderstatus = 'O')
 SELECT case_id, round(avg(CASE WHEN (case_id, symbol) IN (SELECT case_id, symbol FROM res) THEN 1.0 ELSE 0.0 END::DOUBLE), 9) AS symbol_recall FROM g GROUP BY case_id""")
def symbol_recall(spark, sf):
    t = _Tables(spark, sf)
    return M.symbol_recall(t.orders.where("o_orderstatus = 'O'").select("case_id", F.concat(F.lit("s"), (F.col("k") % 7).cast("string")).alias("symbol")), t.results)


@query(f"""WITH {_TABLES}, facts AS (SELECT case_id, k AS fact FROM ord WHERE k % 2 = 0), ev AS (SELECT case_id, k AS fact, 'f' || k % 9 AS path, k * 3 % 500 AS s, k * 3 % 500 + 40 AS e FROM ord WHERE k % 4 = 0),
 f AS (SELECT *, EXISTS (SELECT 1 FROM ev WHERE ev.case_id = facts.case_id AND ev.fact = facts.fact) AS located, EXISTS (SELECT 1 FROM ev JOIN res r ON r.case_id = ev.case_id AND r.path = ev.path AND ev.s <= r.e AND r.s <= ev.e WHERE ev.case_id = facts.case_id AND ev.fact = facts.fact) AS ranged,
  EXISTS (SELECT 1 FROM res r WHERE r.case_id = facts.case_id AND r.symbol = 's' || fact % 5 AND EXISTS (SELECT 1 FROM ev WHERE ev.case_id = facts.case_id AND ev.fact = facts.fact AND ev.path = r.path)) AS scoped,
  EXISTS (SELECT 1 FROM res r WHERE r.case_id = facts.case_id AND r.symbol = 's' || fact % 5) AS named FROM facts)
 SELECT case_id, round(count(*) FILTER (located AND (ranged OR scoped)) / nullif(count(*) FILTER (located), 0), 9) AS supported, CAST(count(*) FILTER (NOT located) AS BIGINT) AS undecidable, round(count(*) FILTER (ranged OR named) / count(*), 9) AS legacy FROM f GROUP BY case_id""")
def claim_support(spark, sf):
    t, k = _Tables(spark, sf), F.col("k")
    facts = t.orders.where("k % 2 = 0").select("case_id", k.alias("fact"))
    evidence = t.orders.where("k % 4 = 0").select("case_id", k.alias("fact"), F.concat(F.lit("f"), (k % 9).cast("string")).alias("path"), (k * 3 % 500).alias("start"), (k * 3 % 500 + 40).alias("end"))
    symbols = facts.withColumn("symbol", F.concat(F.lit("s"), (F.col("fact") % 5).cast("string")))
    return M.claim_support(facts, evidence, symbols, t.results)


@query(f"""WITH {_TABLES}, roots AS (SELECT * FROM (VALUES ('', 'all'), ('f1', 'one'), ('f2', 'two'), ('f3', 'two'), ('f10', 'ten')) v(root, package)),
 own AS (SELECT DISTINCT path, first_value(package) OVER (PARTITION BY path ORDER BY length(root) DESC) AS component FROM (SELECT DISTINCT path FROM res) JOIN roots ON root = '' OR path = root OR starts_with(path, root || '/')),
 want AS (SELECT DISTINCT case_id, CASE k % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'two' ELSE 'ten' END AS component FROM ord WHERE o_orderstatus = 'F'),
 f AS (SELECT case_id, component, min(rank) AS rank FROM res JOIN own USING (path) GROUP BY 1, 2)
 SELECT case_id, round(count(*) FILTER (rank <= 3) / count(*), 9) AS component_recall_at_3, round(count(*) FILTER (rank <= 5) / count(*), 9) AS component_recall_at_5, round(count(*) FILTER (rank <= 20) / count(*), 9) AS component_recall_at_20,
  round(coalesce(1 / min(rank), 0), 9) AS component_mrr FROM want LEFT JOIN f USING (case_id, component) GROUP BY case_id""")
def component_metrics(spark, sf):
    t = _Tables(spark, sf)
    roots = spark.createDataFrame([("", "all"), ("f1", "one"), ("f2", "two"), ("f3", "two"), ("f10", "ten")], "root string, package string")
    owned = owners(t.results.select("path").distinct(), roots).withColumnRenamed("package", "component")
    name = F.when(F.col("k") % 3 == 0, "one").when(F.col("k") % 3 == 1, "two").otherwise("ten")
    gold = t.orders.where("o_orderstatus = 'F'").select("case_id", name.alias("component"))
    return M.component_metrics(gold, t.results.join(owned, "path").select("case_id", "rank", "component"), [3, 5, 20])


@query("""WITH c AS (SELECT c_custkey // 3 AS cluster, c_custkey % 4 = 0 AS abstained, (c_custkey // 3) % 5 = 0 AS no_context, CASE c_custkey % 4 WHEN 0 THEN 'abstained' WHEN 1 THEN 'weak_witness' ELSE 'answered' END AS state, c_acctbal <= 5000 AS fits FROM customer),
 m AS (SELECT cluster, avg(abstained::INT) AS p, avg(no_context::INT) AS y, avg((abstained = no_context)::INT) AS a, avg((state = 'answered')::INT) AS s1, avg((state = 'weak_witness')::INT) AS s2, avg((state = 'abstained')::INT) AS s3, avg(fits::INT) AS b FROM c GROUP BY 1)
 SELECT CAST(count(*) AS BIGINT) AS clusters, round(sum(p * y) / sum(p), 9) AS no_context_precision, round(sum((1 - p) * y) / sum(y), 9) AS false_positive_rate, round(avg(a), 9) AS accuracy, round(avg(s1), 9) AS answered,
  round(avg(s2), 9) AS weak_witness, round(avg(s3), 9) AS abstained_share, round(avg(b), 9) AS compliant FROM m""")
def abstention_metrics(spark, sf):
    k = F.col("c_custkey")
    state = F.when(k % 4 == 0, "abstained").when(k % 4 == 1, "weak_witness").otherwise("answered")
    cluster = F.floor(k / 3)
    c = load(spark, sf, "customer").select(k.alias("case_id"), cluster.alias("cluster"), (k % 4 == 0).alias("abstained"), (cluster % 5 == 0).alias("no_context"), state.alias("state"), F.col("c_acctbal").alias("tokens"), F.lit(5000.0).alias("budget"))
    return M.abstention(c)


_VALUES = "v AS (SELECT event_type AS metric, user_id // 4 AS cluster, value, CASE user_id % 3 WHEN 0 THEN 'trace' ELSE 'impact' END AS intent, list_filter(['even', 'late'], lambda x: CASE x WHEN 'even' THEN user_id % 2 = 0 ELSE ts >= TIMESTAMP '2024-01-20' END) AS tags FROM events)"


def _values(spark, sf):
    u = F.col("user_id")
    tags = F.array_compact(F.array(F.when(u % 2 == 0, "even"), F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), "late")))
    return load(spark, sf, "events").select(F.col("event_type").alias("metric"), F.floor(u / 4).alias("cluster"), "value", F.when(u % 3 == 0, "trace").otherwise("impact").alias("intent"), tags.alias("tags"))


@query(f"""WITH {_VALUES}, g AS (SELECT metric, cluster, value, 'all' AS grp FROM v UNION ALL SELECT metric, cluster, value, 'intent/' || intent FROM v UNION ALL SELECT metric, cluster, value, 'tag/' || unnest(tags) FROM v),
 c AS (SELECT grp, metric, cluster, avg(value) AS m FROM g GROUP BY ALL) SELECT grp, metric, CAST(count(*) AS BIGINT) AS clusters, round(avg(m), 9) AS mean FROM c GROUP BY 1, 2""")
def grouped_means(spark, sf):
    return M.grouped_means(_values(spark, sf))


@query("""WITH p AS (SELECT o_orderpriority AS i, CASE WHEN o_orderkey % 4 = 0 THEN '3-MEDIUM' WHEN o_orderkey % 4 = 1 THEN 'none' ELSE o_orderpriority END AS j FROM orders), n AS (SELECT DISTINCT i AS intent FROM p UNION SELECT DISTINCT j FROM p)
 SELECT intent, round((SELECT avg((i = j)::INT) FROM p WHERE i = intent), 9) AS recall, round((SELECT avg((i = j)::INT) FROM p WHERE j = intent), 9) AS precision FROM n""")
def intent_scores(spark, sf):
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "3-MEDIUM").when(k == 1, "none").otherwise(F.col("o_orderpriority"))
    return M.intent_scores(load(spark, sf, "orders").select(F.col("o_orderpriority").alias("intent"), said.alias("predicted")))


@query("""WITH d AS (SELECT event_type, user_id // 4 AS cluster, avg(value) - 50 AS delta FROM events GROUP BY 1, 2)
 SELECT event_type, CAST(count(*) AS BIGINT) AS n, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(delta) / sqrt(count(*)), 6) AS mde FROM d GROUP BY 1""")
def detectable_effects(spark, sf):
    rows = load(spark, sf, "events").select("event_type", F.floor(F.col("user_id") / 4).alias("cluster"), "value")
    return M.detectable(M.collapsed(rows, ["event_type"]).select("event_type", (F.col("value") - 50).alias("delta")), "event_type")


@query(f"""WITH {_TABLES}, i AS (SELECT case_id, rank, k, dense_rank() OVER (PARTITION BY case_id ORDER BY rank // 3) AS place FROM res) SELECT case_id, k, CAST(place AS BIGINT) AS place FROM i WHERE place <= 3""")
def first_items(spark, sf):
    """An item of this table cites the results of up to three places."""
    rows = _Tables(spark, sf).results.select("case_id", "k", F.floor(F.col("rank") / 3).alias("item"))
    return M.first_items(rows, 3).select("case_id", "k", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey AS case_id, CAST(CASE WHEN c_custkey % 3 <> 0 THEN coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END, (SELECT sum(o_orderkey % 100) FROM orders WHERE o_custkey = c_custkey)) END AS BIGINT) AS tokens FROM customer""")
def spent_tokens(spark, sf):
    k = F.col("c_custkey")
    packs = load(spark, sf, "customer").select(k.alias("case_id"), F.when(k % 3 != 0, "context").otherwise("search").alias("kind"), F.when(k % 2 == 0, k * 10).alias("used"))
    return M.spent_tokens(packs, load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 100).alias("tokens")))


_ROUTES = "r AS (SELECT o_custkey AS case_id, o_orderkey % 30 AS item, o_orderstatus AS route, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders)"


@query(f"""WITH {_ROUTES}, e AS (SELECT case_id, item, min(rank) AS rank, count(DISTINCT route) AS n, min(route) AS one FROM r GROUP BY 1, 2)
 SELECT x.route, case_id, item, row_number() OVER (PARTITION BY x.route, case_id ORDER BY rank, item) AS rank FROM e, (SELECT DISTINCT route FROM r) x WHERE NOT (n = 1 AND one = x.route)""")
def route_ablation(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    return M.ablated(load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 30).alias("item"), F.col("o_orderstatus").alias("route"), rank.alias("rank")))


@query("""WITH r AS (SELECT o_custkey AS case_id, o_orderstatus AS variant, o_orderkey % 12 AS item, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank FROM orders),
 t AS (SELECT DISTINCT case_id, variant, item FROM r WHERE rank <= 5), n AS (SELECT case_id, variant, count(*) AS n FROM t GROUP BY 1, 2),
 p AS (SELECT a.case_id, a.variant AS v, b.variant AS w, a.n + b.n AS total, (SELECT count(*) FROM t x JOIN t y ON x.case_id = y.case_id AND x.item = y.item WHERE x.case_id = a.case_id AND x.variant = a.variant AND y.variant = b.variant) AS shared FROM n a JOIN n b ON a.case_id = b.case_id AND a.variant < b.variant)
 SELECT case_id, CAST(count(*) AS BIGINT) AS pairs, round(avg(shared / (total - shared)), 9) AS agreement FROM p GROUP BY 1""")
def variant_agreement(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_totalprice", "o_orderkey"))
    return M.agreement(load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("variant"), (F.col("o_orderkey") % 12).alias("item"), rank.alias("rank")), 5)


@query("""WITH j AS (SELECT o_custkey AS case_id, o_orderkey % 40 AS item, max(o_orderstatus) = 'P' AS relevant FROM orders GROUP BY 1, 2), d AS (SELECT o_custkey AS case_id, o_orderkey % 55 AS item, max(o_orderpriority) = '5-LOW' AS relevant FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
 SELECT coalesce(d.case_id, j.case_id) AS case_id, coalesce(d.item, j.item) AS item, coalesce(d.relevant, j.relevant) AS relevant FROM j FULL JOIN d ON j.case_id = d.case_id AND j.item = d.item""")
def applied_judgments(spark, sf):
    o = load(spark, sf, "orders").withColumn("case_id", F.col("o_custkey"))
    old = o.groupBy("case_id", (F.col("o_orderkey") % 40).alias("item")).agg((F.max("o_orderstatus") == "P").alias("relevant"))
    new = o.where("o_orderkey % 2 = 0").groupBy("case_id", (F.col("o_orderkey") % 55).alias("item")).agg((F.max("o_orderpriority") == "5-LOW").alias("relevant"))
    return M.judged_with(old, new)


@query("""WITH g AS (SELECT o_custkey AS case_id, o_orderkey % 300 AS path, o_orderkey % 50 AS s, o_orderkey % 50 + o_orderkey % 7 - 1 AS e FROM orders), f AS (SELECT c_custkey AS path, 20 + c_custkey % 40 AS lines FROM customer WHERE c_custkey < 250),
 b AS (SELECT case_id, CASE WHEN lines IS NULL THEN 'missing_path' WHEN s < 1 OR e < s OR e > lines THEN 'bad_range' END AS problem FROM g LEFT JOIN f USING (path)),
 q AS (SELECT c_custkey AS case_id, count(*) OVER w AS n, min(c_custkey) OVER w AS first FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 100)))
 SELECT DISTINCT case_id, problem FROM b WHERE problem IS NOT NULL UNION SELECT case_id, 'duplicate_query' FROM q WHERE n > 1 AND case_id <> first""")
def dataset_lint(spark, sf):
    k, c = F.col("o_orderkey"), load(spark, sf, "customer")
    gold = load(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), (k % 300).alias("path"), (k % 50).alias("start"), (k % 50 + k % 7 - 1).alias("end"))
    files = c.where("c_custkey < 250").select(F.col("c_custkey").alias("path"), (20 + F.col("c_custkey") % 40).alias("lines"))
    cases = c.select(F.col("c_custkey").alias("case_id"), F.concat_ws("|", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100)).alias("query"))
    return M.dataset_lint(cases, gold, files)


@query("""WITH a AS (SELECT o_orderkey AS case_id, md5(o_orderstatus) AS d FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS case_id, md5(CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END) AS d FROM orders WHERE o_orderkey % 11 <> 0)
 SELECT * FROM (SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'missing' WHEN a.d <> b.d THEN 'changed' END AS change FROM a FULL JOIN b ON a.case_id = b.case_id) WHERE change IS NOT NULL""")
def replay_audit(spark, sf):
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(k.alias("case_id"), "o_orderstatus")
    again = o.where("case_id % 11 <> 0").select("case_id", F.md5(F.when(F.col("case_id") % 10 == 3, "X").otherwise(F.col("o_orderstatus"))).alias("digest"))
    return M.replay_audit(o.where("case_id % 7 <> 0").select("case_id", F.md5("o_orderstatus").alias("digest")), again, 1)


@query("""SELECT 'requests_total{label="' || event_type || '"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type""")
def metrics_lines(spark, sf):
    rows = load(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value"))
    return M.exposition(rows.withColumn("name", F.lit("requests_total")))
