"""Query intents, look-alike probes, patches, merges and verdicts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import queries as Q
from skein.functions import text as T
from skein.operators import evidence, history, snapshots
from skein.sources.tables import load

from .registry import registry

QUERIES, ORACLES, query = registry()

#: Query texts by the remainder of a part's key.
_TAILS = (
    "why was it added", "what breaks if it changes", "commit_snapshot", "trace its lifecycle", "error while parsing", "SnapshotId src/lib.rs",
    "where is open_file defined", "subsystem boundary", "follow taint", "a line break", "who wrote the last commits", "why is it slow",
)
_ASKED = "SELECT p_partkey, p_name || ' ' || CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAILS)) + " END AS q FROM part"


def _asked(spark, sf):
    tails = F.array(*map(F.lit, _TAILS))
    return load(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.get(tails, (F.col("p_partkey") % 12).cast("int"))).alias("q"))


@query(rf"""WITH a AS ({_ASKED}), t AS (SELECT *, list_filter(string_split_regex(q, '\s+'), lambda x: x <> '') AS w, ' ' || array_to_string(string_split_regex(lower(q), '[^a-z0-9_]+'), '  ') || ' ' AS l FROM a),
 c AS (SELECT *, len(list_filter(w, lambda x: contains(x, '_') OR contains(x, '::') OR regexp_matches(x, '[a-z][A-Z]') OR regexp_matches(x, '^.+\.[A-Za-z0-9]{{1,5}}$'))) AS n FROM t)
 SELECT p_partkey, CASE WHEN regexp_matches(l, ' taints? ') THEN 'precise_dataflow'
 WHEN regexp_matches(l, ' (history|commit|commits|committed|blame) ') OR regexp_matches(l, ' why ') AND regexp_matches(l, ' (added|changed|introduced|removed|deprecated|renamed|deleted|modified|reverted) ') THEN 'history'
 WHEN regexp_matches(l, ' (impact|affected) ') OR regexp_matches(l, ' breaks? ') AND regexp_matches(l, ' (if|when) ') THEN 'impact' WHEN regexp_matches(l, ' (traces?|lifecycle) ') THEN 'trace'
 WHEN regexp_matches(l, ' (architecture|subsystem|boundary|responsibility) ') THEN 'architecture' WHEN regexp_matches(l, ' (bug|fails?|failure|error|broken|occasionally) ') THEN 'issue_localization'
 WHEN 2 * n >= len(w) OR n > 0 AND (contains(lower(q), 'where is') OR regexp_matches(l, ' (defined|definition|references|implemented|decided) ')) THEN 'exact_entity' ELSE 'natural_language_behavior' END AS intent FROM c""")
def query_intents(spark, sf):
    return _asked(spark, sf).select("p_partkey", Q.intent(F.col("q")).alias("intent"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
 SELECT p_partkey, len(list_filter(range(1, len(w) + 1), lambda i: len(list_filter(range(i, len(w) + 1), lambda j: array_to_string(w[i:j], '') = 'redwidget')) > 0)) > 0 AS witness FROM p""")
def name_witnesses(spark, sf):
    return load(spark, sf, "part").select("p_partkey", Q.name_witness(F.col("p_name"), "Red_Widget").alias("witness"))


@query("""WITH v AS (SELECT DISTINCT unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS s FROM benchmark), s AS (SELECT s, length(s) AS n FROM v WHERE s <> ''),
 p AS (SELECT s AS symbol, 'pluralize' AS op, s || 's' AS probe FROM s UNION ALL SELECT s, 'truncate', CASE WHEN n > 2 THEN left(s, n - 1) ELSE s || 'x' END FROM s
 UNION ALL SELECT s, 'double-last', s || right(s, 1) FROM s UNION ALL SELECT s, 'swap-last', CASE WHEN n > 2 THEN left(s, n - 2) || right(s, 1) || s[n - 1] ELSE s || 'x' END FROM s)
 SELECT * FROM p WHERE probe NOT IN (SELECT s FROM s)""")
def near_misses(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("symbol")).where("symbol <> ''").distinct()
    return words.select("symbol", F.inline(Q.perturbations(F.col("symbol")))).join(words.withColumnRenamed("symbol", "probe"), "probe", "left_anti").select("symbol", "op", "probe")


@query("""WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS s, text[1:2000] AS piece FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, e, text[e + 1:e + 2000] FROM (SELECT doc_id, text, s + k AS e FROM (SELECT doc_id, text, s, CASE WHEN s + length(piece) < length(text) AND cut > 1000 THEN cut ELSE length(piece) END AS k
 FROM (SELECT *, CASE WHEN contains(piece, chr(10)) THEN length(piece) - instr(reverse(piece), chr(10)) + 1 ELSE 0 END AS cut FROM c))) WHERE e < length(text))
 SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(s + CASE WHEN s + length(piece) < length(text) AND cut > 1000 THEN cut ELSE length(piece) END AS BIGINT) AS "end"
 FROM (SELECT *, CASE WHEN contains(piece, chr(10)) THEN length(piece) - instr(reverse(piece), chr(10)) + 1 ELSE 0 END AS cut FROM c)""")
def chunk_ranges(spark, sf):
    parts = load(spark, sf, "documents").select("doc_id", F.explode(T.chunk_bounds(F.col("text"), 2000)).alias("c"))
    return parts.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 s AS (SELECT *, CASE (doc_id + n) % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '+' END AS sign FROM l),
 m AS (SELECT *, 9 + count(*) FILTER (sign <> '+') OVER w AS old, 19 + count(*) FILTER (sign <> '-') OVER w AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM m WHERE sign <> ' ' AND regexp_matches(content, 'th[ae]'))
 SELECT CAST(doc_id % 7 AS VARCHAR) AS "commit", CAST(doc_id AS VARCHAR) AS path, sign, CAST(CASE sign WHEN '-' THEN old ELSE new END AS BIGINT) AS line, content FROM f WHERE place <= 32""")
def diff_grep(spark, sf):
    signs = F.array(F.lit(" "), F.lit("-"), F.lit("+"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.get(signs, ((F.col("doc_id") + i + 1) % 3).cast("int")), x))
    body = F.array_join(F.concat(F.array(F.lit("@@ -10,9 +20,9 @@")), lines), "\n")
    d = load(spark, sf, "documents").where("text IS NOT NULL")
    return history.diff_grep(d.select((F.col("doc_id") % 7).cast("string").alias("commit"), F.col("doc_id").cast("string").alias("path"), body.alias("patch")), "th[ae]")


@query("""WITH o AS (SELECT o_custkey AS id, min(o_orderpriority) AS e FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1), i AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS id, o_orderkey AS n, o_orderstatus || o_orderkey AS e FROM orders)
 SELECT id, arg_max(e, n) AS evidence FROM (SELECT id, -1 AS n, e FROM o UNION ALL SELECT id, n, e FROM i) WHERE id IN (SELECT id FROM o) GROUP BY id UNION ALL SELECT id, string_agg(e, '|' ORDER BY n) FROM i WHERE id NOT IN (SELECT id FROM o) GROUP BY id""")
def merged_relations(spark, sf):
    o, c, k = load(spark, sf, "orders"), F.col("o_custkey"), F.col("o_orderkey")
    old = o.where(c % 3 == 0).groupBy(c.alias("id")).agg(F.array(F.min("o_orderpriority")).alias("evidence"))
    new = o.select(F.when(k % 2 == 0, c).otherwise(-c).alias("id"), k.alias("n"), F.array(F.concat("o_orderstatus", k.cast("string"))).alias("evidence"))
    return history.merge_relations(old, new).select("id", F.array_join("evidence", "|").alias("evidence"))


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS item, o_orderstatus = 'F' AS topical, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
 s AS (SELECT *, row_number() OVER (PARTITION BY q, topical ORDER BY rank) AS slot FROM r), m AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS better FROM s WHERE topical AND slot <= 4)
 SELECT q, item, CAST(rank AS BIGINT) AS rank FROM s WHERE NOT (topical AND slot <= 4) UNION ALL SELECT m.q, m.item, CAST(t.rank AS BIGINT) FROM m JOIN m t ON m.q = t.q AND m.better = t.slot""")
def rerank_slots(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("q").orderBy("o_orderdate", "item")).cast("long")
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), (F.col("o_orderstatus") == "F").alias("topical"), F.col("o_totalprice").alias("score"), "o_orderdate")
    return history.rerank_in_place(o.withColumn("rank", rank), "q", "item", "topical", "score", 4)


@query("""WITH h AS (SELECT o_custkey AS q, bool_or(o_orderstatus = 'F') AS strict FROM orders GROUP BY 1)
 SELECT c_custkey AS query_id, CASE WHEN c_acctbal < 0 OR q IS NULL THEN 'abstained' WHEN NOT strict THEN 'weak_witness' ELSE 'answered' END AS state FROM customer LEFT JOIN h ON c_custkey = q""")
def verdict_states(spark, sf):
    gates = load(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_acctbal") < 0).alias("abstain"))
    hits = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderstatus") == "F").alias("strict"))
    return evidence.verdicts(hits, gates)


@query("""SELECT c_custkey AS view_id, CASE WHEN c_mktsegment <> 'BUILDING' AND state NOT IN ('unavailable', 'failed') THEN 'stale' ELSE state END AS state
 FROM (SELECT *, CASE c_nationkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'partial' WHEN 2 THEN 'unavailable' ELSE 'failed' END AS state FROM customer)""")
def view_staleness(spark, sf):
    states = F.array(*map(F.lit, ("ready", "partial", "unavailable", "failed")))
    views = load(spark, sf, "customer").select(F.col("c_custkey").alias("view_id"), F.col("c_mktsegment").alias("snapshot_id"), F.get(states, (F.col("c_nationkey") % 4).cast("int")).alias("state"))
    return snapshots.stale_views(views, "BUILDING").select("view_id", "state")


_COMMITS = "c AS (SELECT o_orderkey AS k, 'commit' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS commit, o_orderdate AS ts, CASE WHEN o_orderkey % 10 > 0 THEN 1 END AS parent, o_orderpriority || chr(10) || o_orderstatus AS message FROM orders)"


def _commits(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("commit"), F.lpad(k.cast("string"), 8, "0"))
    o = load(spark, sf, "orders")
    return o.select(name.alias("commit"), F.when(k % 10 > 0, 1).alias("parent"), F.unix_timestamp("o_orderdate").alias("ts"), F.concat_ws("\n", "o_orderpriority", "o_orderstatus").alias("message"))


@query(f"""WITH {_COMMITS}, t AS (SELECT * FROM c ORDER BY ts DESC, commit LIMIT 512) SELECT DISTINCT commit, CAST(epoch(ts) AS BIGINT) AS ts, 'p' || l_partkey AS path FROM t JOIN lineitem ON l_orderkey = k WHERE parent IS NOT NULL""")
def newest_changes(spark, sf):
    name = F.concat(F.lit("commit"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"))
    changes = load(spark, sf, "lineitem").select(name.alias("commit"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path")).distinct()
    return history.newest_changes(changes, _commits(spark, sf))


@query(f"""WITH {_COMMITS} SELECT string_agg(left(commit, 12) || ' ' || split_part(message, chr(10), 1), chr(10) ORDER BY ts DESC, commit) AS summary FROM (SELECT * FROM c ORDER BY ts DESC, commit LIMIT 40)""")
def history_summary(spark, sf):
    return history.history_summary(_commits(spark, sf), 40)


def _edited(spark, sf):
    """Texts of four lines, the second of which is another one after the commit."""
    p, k = load(spark, sf, "part"), F.col("p_partkey").cast("string")
    lines = lambda mid: F.concat_ws("\n", F.concat(F.lit("head "), k), mid, F.lit("}"), F.concat(F.lit("tail "), k))
    return p.select(F.concat(F.lit("k"), (F.col("p_partkey") % 9).cast("string")).alias("commit"), F.concat(F.lit("p"), k).alias("path"), lines(F.col("p_name")).alias("before"), lines(F.concat(F.lit("  new "), "p_type")).alias("after"))


@query("""SELECT 'k' || p_partkey % 9 AS commit, 'p' || p_partkey AS path, 1::INT AS hunks, 1::INT AS added, 1::INT AS removed, '@@ -1,4 +1,4 @@' || chr(10) || ' head ' || p_partkey || chr(10) || '-' || p_name || chr(10) || '+  new ' || p_type || chr(10) || ' }' || chr(10) || ' tail ' || p_partkey AS patch FROM part""")
def text_diffs(spark, sf):
    return history.text_diffs(_edited(spark, sf))


@query("""SELECT 'k' || p_partkey % 9 AS commit, CAST(p_partkey % 9 AS BIGINT) AS ts, count(*) AS files, left('message ' || p_partkey % 9 || chr(10) || chr(10) || string_agg('p' || p_partkey || chr(10) || '-' || p_name || chr(10) || '+new ' || p_type, chr(10) || chr(10) ORDER BY 'p' || p_partkey), 16384) AS body FROM part GROUP BY p_partkey % 9""")
def commit_documents(spark, sf):
    commits = spark.range(9).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("commit"), F.col("id").alias("ts"), F.concat(F.lit("message "), F.col("id").cast("string")).alias("message"))
    return history.commit_documents(commits, history.text_diffs(_edited(spark, sf)))


@query("""SELECT source || '/' || doc_id AS path, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS reused FROM documents""")
def parse_reuse(spark, sf):
    d = load(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("digest"), F.col("lang").alias("language"), "doc_id")
    done = d.where("doc_id % 3 <> 0").withColumn("version", F.when(F.col("doc_id") % 5 == 0, "1").otherwise("2"))
    return history.reused_units(d, done, "2").select("path", "reused")


@query("""WITH a AS (SELECT l_partkey AS k, l_returnflag AS f, l_tax, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 3 <> 0),
 b AS (SELECT l_partkey AS k, l_returnflag AS f, l_tax, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 3 <> 1),
 d AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.f, b.f) AS f, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.l_quantity <> b.l_quantity OR a.l_tax <> b.l_tax THEN 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.f = b.f AND a.n = b.n)
 SELECT k, f, change, total, total > 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY k, f) AS p, count(*) OVER (PARTITION BY change) AS total FROM d WHERE change IS NOT NULL) WHERE p <= 500""")
def architecture_diff(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("f"), "l_tax", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    head = l.where("l_orderkey % 3 <> 1").withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return snapshots.architecture_diff(l.where("l_orderkey % 3 <> 0"), head, ["k", "f"], ["l_quantity", "l_tax"], "id")


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 ELSE o_orderkey - 1 END AS p FROM orders), w AS (SELECT max(k) AS k, CAST(0 AS BIGINT) AS n FROM c
 UNION ALL SELECT p, n + 1 FROM w JOIN c USING (k) WHERE n < 511 AND p >= 0) SELECT CAST(k AS VARCHAR) AS "commit", n FROM w""")
def first_parent_way(spark, sf):
    """Every fifth commit is a merge, whose first parent lies three back."""
    return history.first_parents(*_graph(spark, sf)).select("commit", "n")


def _graph(spark, sf):
    k = F.col("o_orderkey")
    back = lambda n: (k - n).cast("string")
    parents = F.when(k % 5 == 0, F.filter(F.array(F.when(k > 2, back(3)), back(1)), lambda x: x.isNotNull())).otherwise(F.array(back(1)))
    o = load(spark, sf, "orders")
    rows = o.select(k.cast("string").alias("commit"), F.when(k > 0, parents).otherwise(F.array().cast("array<string>")).alias("parents"))
    return rows, str(o.agg(F.max("o_orderkey")).first()[0])


@query("""WITH RECURSIVE c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 3 ELSE o_orderkey - 1 END AS p FROM orders), w AS (SELECT max(k) AS k, CAST(0 AS BIGINT) AS n FROM c
 UNION ALL SELECT p, n + 1 FROM w JOIN c USING (k) WHERE n < 511 AND p >= 0), x AS (SELECT w.k, n, p FROM w JOIN c USING (k) WHERE p >= 0), t AS (SELECT DISTINCT l_orderkey AS k, l_partkey % 50 AS f, CASE WHEN l_partkey % 50 < 25 THEN 0 ELSE l_orderkey % 3 END AS d FROM lineitem),
 a AS (SELECT x.k, n, f, d FROM x JOIN t USING (k)), b AS (SELECT x.k, n, f, d FROM x JOIN t ON t.k = p)
 SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS "commit", coalesce(a.n, b.n) AS n, 'f' || coalesce(a.f, b.f) AS path, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.f = b.f WHERE a.d IS DISTINCT FROM b.d""")
def changed_along(spark, sf):
    f = F.col("l_partkey") % 50
    trees = load(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), F.concat(F.lit("f"), f.cast("string")).alias("path"), F.when(f < 25, 0).otherwise(F.col("l_orderkey") % 3).alias("digest")).distinct()
    return history.changed_along(trees, history.first_parents(*_graph(spark, sf)))
