"""Plans, gates, witnesses and packs: customers stand for queries, their orders for hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import queries as Q
from skein.operators import evidence as E
from skein.sources.tables import load

from .history import _ASKED, _asked
from .lookups import _ENT, _REL, entities, pick, relations
from .registry import registry

QUERIES, ORACLES, query = registry()

_PLAN = "(VALUES ('exact_entity', 'exact,lexical', NULL, 'definition'), ('natural_language_behavior', 'exact,lexical,dense,structural', 'opportunistic', 'mention'), ('issue_localization', 'exact,lexical,dense,structural', 'opportunistic', 'mention'), ('precise_dataflow', 'exact,lexical,structural', 'dataflow', 'relation'), ('trace', 'exact,lexical,dense,structural', 'outgoing', 'relation'), ('impact', 'exact,lexical,structural', 'incoming', 'relation'), ('architecture', 'lexical,knowledge', NULL, 'relation'), ('history', 'history,diff,lexical', NULL, 'history')) v(intent, routes, policy, required)"


@query(f"""WITH a AS ({_ASKED}), i AS (SELECT p_partkey AS query_id, CASE p_partkey % 12 WHEN 0 THEN 'history' WHEN 1 THEN 'impact' WHEN 3 THEN 'trace' WHEN 4 THEN 'issue_localization' WHEN 5 THEN 'exact_entity' WHEN 6 THEN 'exact_entity' WHEN 7 THEN 'architecture' WHEN 8 THEN 'precise_dataflow' WHEN 10 THEN 'history' ELSE 'natural_language_behavior' END AS intent FROM a)
 SELECT query_id, routes, policy, required FROM i JOIN (SELECT * FROM {_PLAN}) p USING (intent)""")
def query_plans(spark, sf):
    """Plans of the intents that query texts have; every text here says plainly what it is about."""
    asked = _asked(spark, sf).select(F.col("p_partkey").alias("query_id"), Q.intent(F.col("q")).alias("intent"))
    return E.planned(asked).select("query_id", F.array_join("routes", ",").alias("routes"), "policy", "required")


@query("""WITH w AS (SELECT o_custkey AS q, max((o_orderkey % 6 = 0)::INT) AS d, max(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE 0 END) AS e, max((o_orderkey % 7 = 0)::INT) AS h FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
 SELECT c_custkey AS query_id, CASE WHEN c_nationkey % 4 = 0 AND d = 0 AND c_custkey % 9 > 0 THEN 'definition' WHEN c_nationkey % 4 = 1 AND e = 0 AND c_custkey % 9 > 0 THEN 'relation' WHEN c_nationkey % 4 = 2 AND h = 0 THEN 'history' END AS gate FROM customer LEFT JOIN w ON c_custkey = q""")
def witness_gates(spark, sf):
    k = F.col("o_orderkey")
    queries = load(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), pick(F.col("c_nationkey") % 4, "definition", "relation", "history", "mention").alias("required"), (F.col("c_custkey") % 9 == 0).alias("temporal"))
    seen = load(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("query_id"), k.alias("term"), (k % 6 == 0).cast("int").alias("defined"), F.when(k % 5 == 0, k % 3).otherwise(0).alias("edges"), (k % 7 == 0).cast("int").alias("history"))
    return E.witness_gates(queries, seen)


@query(f"""WITH {_ENT}, {_REL}, terms AS (SELECT unnest(['red', 'widget', 'redwidget', 'ring', 'nothing']) AS term), nm AS (SELECT DISTINCT term, id FROM terms JOIN ent ON list_contains(string_split(name, '_'), term) OR replace(name, '_', '') = term),
 dd AS (SELECT term, id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY id) AS n FROM nm) WHERE n <= 8), mm AS (SELECT DISTINCT term, path FROM terms JOIN ent ON contains(path, term)), mp AS (SELECT term, path FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY path) AS n FROM mm) WHERE n <= 5),
 ed AS (SELECT term, kind, count(*) AS n FROM dd JOIN rel ON rel.src = dd.id GROUP BY 1, 2), hh AS (SELECT term, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM terms JOIN documents ON contains(text, term)) WHERE n <= 8)
 SELECT term, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM dd WHERE dd.term = terms.term), '') AS defined, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM mp WHERE mp.term = terms.term), '') AS mentions, CAST(coalesce((SELECT sum(n) FROM ed WHERE ed.term = terms.term), 0) AS BIGINT) AS edges,
 coalesce((SELECT string_agg(kind, ',' ORDER BY kind) FROM ed WHERE ed.term = terms.term), '') AS kinds, coalesce((SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM hh WHERE hh.term = terms.term), '') AS history FROM terms""")
def witness_reports(spark, sf):
    terms = spark.createDataFrame([(t,) for t in ("red", "widget", "redwidget", "ring", "nothing")], "term string")
    e, few = entities(spark, sf), F.broadcast(terms)  # five rows
    parts = e.select(F.col("id").alias("entity_id"), F.explode(F.concat(F.split("name", "_"), F.array(F.replace("name", F.lit("_"), F.lit(""))))).alias("term"))
    named = parts.join(few, "term")
    mentions = e.select("path").join(few, F.contains("path", "term"))
    history = load(spark, sf, "documents").select("doc_id", "text").join(few, F.contains("text", "term"))
    got = E.witness_report(terms, named, mentions, relations(spark, sf).select("src", "kind"), history.select("term", "doc_id"))
    return got.select("term", "edges", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("defined", "mentions", "kinds", "history")])


_HITS = """h AS (SELECT o_custkey AS q, 't' || o_orderkey % 4 AS term, 'f' || o_orderkey % 3 AS path, CASE WHEN o_orderkey % 5 > 0 THEN 'e' || o_orderkey % 3 || '/' || o_orderkey % 2 END AS entity, CASE o_orderkey % 3 WHEN 0 THEN 'prose' ELSE 'code' END AS class, o_orderkey % 3 = 2 AS test FROM orders WHERE o_orderstatus = 'O'),
 ub AS (SELECT q, path, max(n) AS n FROM (SELECT q, path, entity, count(DISTINCT term) AS n FROM h WHERE entity IS NOT NULL GROUP BY ALL) WHERE n > 1 GROUP BY 1, 2),
 wb AS (SELECT q, path, count(DISTINCT term) AS n, max(class) AS class, bool_and(test) AS test FROM h GROUP BY 1, 2 HAVING count(DISTINCT term) > 1),
 art AS (SELECT wb.q, wb.path, coalesce(ub.n, wb.n) AS terms, class, CASE WHEN ub.n IS NULL THEN 'file' ELSE 'entity' END AS scope, test FROM wb LEFT JOIN ub ON wb.q = ub.q AND wb.path = ub.path)"""


def _artifacts(spark, sf):
    k = F.col("o_orderkey")
    s = lambda n: n.cast("string")
    unit = F.when(k % 5 > 0, F.concat(F.lit("e"), s(k % 3), F.lit("/"), s(k % 2)))
    rows = load(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("t"), s(k % 4)).alias("term"), F.concat(F.lit("f"), s(k % 3)).alias("path"), unit.alias("entity_id"), pick(k % 3, "prose", "code", "code").alias("class"), (k % 3 == 2).alias("test"))
    return E.binding_artifacts(rows, 10)


@query(f"WITH {_HITS} SELECT q AS query_id, path, terms, class, scope, test FROM art")
def binding_artifacts(spark, sf):
    return _artifacts(spark, sf)


@query(f"""WITH {_HITS}, b AS (SELECT q, bool_or(class = 'code' AND scope = 'entity' AND NOT test) AS good, bool_or(class = 'code' AND scope = 'entity' AND test) AS t, bool_or(class = 'code') AS c FROM art GROUP BY 1),
 k AS (SELECT c_custkey AS q, c_custkey % 4 AS undef, c_custkey % 3 AS terms, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 ELSE 0 END AS gaps, c_custkey % 2 AS edgeless, c_nationkey % 2 = 0 AS rel FROM customer)
 SELECT k.q AS query_id, concat_ws(',', CASE WHEN undef > 0 THEN 'undefined_subject' END, CASE WHEN terms >= 2 AND NOT coalesce(good, FALSE) THEN CASE WHEN good IS NULL THEN 'unbound' WHEN t THEN 'test_only' WHEN c THEN 'file_scope' ELSE 'prose_only' END END,
  CASE WHEN terms > 0 AND gaps = terms THEN 'no_hit_carries_terms' END, CASE WHEN rel AND edgeless > 0 THEN 'edgeless_subject' END) AS reasons FROM k LEFT JOIN b ON k.q = b.q""")
def weak_reasons(spark, sf):
    k = F.col("c_custkey")
    claims = load(spark, sf, "customer").select(k.alias("query_id"), (k % 4).alias("undefined"), (k % 3).alias("terms"), F.when(k % 5 == 0, k % 3).otherwise(0).alias("gaps"), (k % 2).alias("edgeless"), F.when(F.col("c_nationkey") % 2 == 0, "relation").otherwise("mention").alias("required"))
    return E.weak_reasons(claims, _artifacts(spark, sf)).select("query_id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH c AS (SELECT o_custkey AS q, o_orderkey % 6 AS o, 't' || o_orderkey % 7 AS term, CASE WHEN o_orderkey % 4 > 0 THEN 'd' || o_orderkey % 3 END AS dir, 'p' || o_orderkey % 5 AS path FROM orders),
 x AS (SELECT q, o, term, CASE o WHEN 0 THEN 'type:commit ' || term WHEN 1 THEN 'type:diff ' || term WHEN 2 THEN 'path:' || dir || ' ' || term WHEN 3 THEN coalesce('path:' || dir || ' ' || term, term) WHEN 5 THEN 'path:' || path || ' ' || term ELSE term END AS query FROM c),
 m AS (SELECT q, query, min(o) AS o, arg_min(term, o) AS term FROM x WHERE query IS NOT NULL GROUP BY 1, 2)
 SELECT * FROM (SELECT q AS query_id, query, 'r' || o AS reason, row_number() OVER (PARTITION BY q ORDER BY o, term, query) AS place FROM m) WHERE place <= 6""")
def drill_downs(spark, sf):
    k = F.col("o_orderkey")
    s = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    rows = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), pick(k % 6, "commit", "diff", "mention", "gap", "edgeless", "file").alias("kind"), s("t", 7).alias("term"), F.when(k % 4 > 0, s("d", 3)).alias("dir"), s("p", 5).alias("path"), s("r", 6).alias("reason"))
    return E.drill_downs(rows)


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS d, o_orderstatus || ' ' || o_orderpriority AS snippet, o_orderkey % 3 > 0 AS placed, o_orderkey % 4 < 2 AS shipped FROM orders), t AS (SELECT c_custkey AS q, unnest(['urgent', 'low', 'p 5']) AS term FROM customer),
 z AS (SELECT t.q, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.q = t.q AND shipped AND contains(lower(snippet), term))) AS delivered FROM t GROUP BY 1)
 SELECT h.q AS query_id, CAST(count(*) FILTER (shipped) AS BIGINT) AS included, CAST(count(*) FILTER (NOT shipped) AS BIGINT) AS omitted, CAST(max(delivered) AS BIGINT) AS delivered, CAST(3 - max(delivered) AS BIGINT) AS missing,
 CASE WHEN bool_or(shipped AND placed) THEN 'not_verified' ELSE 'no_source_evidence' END AS witness FROM h JOIN z ON h.q = z.q GROUP BY h.q""")
def delivery_reports(spark, sf):
    k = F.col("o_orderkey")
    hits = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), k.alias("doc_id"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("snippet"), F.when(k % 3 > 0, "p").alias("path"))
    terms = load(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(*map(F.lit, ("urgent", "LOW", "P 5")))).alias("term"))
    return E.delivery(hits, hits.where("doc_id % 4 < 2").select("query_id", "doc_id"), terms)


_PACKED = """h AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey AS d, CASE o_orderkey % 9 WHEN 0 THEN 'test' WHEN 1 THEN 'history' WHEN 2 THEN 'knowledge' WHEN 3 THEN 'caller' WHEN 4 THEN 'contract' WHEN 5 THEN 'config' ELSE 'target' END AS role,
  CASE WHEN o_orderkey % 9 = 5 THEN 'a.toml' WHEN o_orderkey % 4 > 0 THEN 'f' || o_orderkey % 2 END AS path, o_orderkey % 5 AS span, 'e' || o_orderkey % 3 AS entity, 40 + o_orderkey % 90 AS tokens FROM orders),
 ro AS (SELECT * FROM (VALUES ('test', 1), ('contract', 2), ('caller', 3), ('config', 4), ('history', 5), ('knowledge', 6)) v(role, o)),
 tr AS (SELECT q, d, path, span, entity, tokens, row_number() OVER (PARTITION BY q ORDER BY p, o) AS n FROM (SELECT h.*, 0 AS p, o FROM (SELECT *, row_number() OVER (PARTITION BY q, role ORDER BY rank) AS f FROM h) h JOIN ro USING (role) WHERE f = 1 UNION ALL BY NAME SELECT h.*, 1 AS p, rank AS o FROM h)),
 st AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS n, CAST(50 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS spans, CAST([] AS VARCHAR[]) AS files, CAST([] AS VARCHAR[]) AS ents, CAST(NULL AS BIGINT) AS d, CAST(NULL AS VARCHAR) AS why FROM tr
  UNION ALL SELECT q, n, CASE WHEN why IS NULL THEN used + tokens ELSE used END, CASE WHEN why IS NULL THEN list_append(ids, d) ELSE ids END, CASE WHEN why IS NULL AND path IS NOT NULL THEN list_append(spans, path || '/' || span) ELSE spans END,
   CASE WHEN why IS NULL AND path IS NOT NULL THEN list_append(files, path) ELSE files END, CASE WHEN why IS NULL THEN list_append(ents, entity) ELSE ents END, d, why FROM (
   SELECT tr.q, tr.n, st.used, st.ids, st.spans, st.files, st.ents, tr.d, tr.path, tr.span, tr.entity, tr.tokens, CASE WHEN list_contains(st.ids, tr.d) THEN 'taken' WHEN tr.path IS NOT NULL AND list_contains(st.spans, tr.path || '/' || tr.span) THEN 'duplicate_range'
    WHEN tr.path IS NOT NULL AND len(list_filter(st.files, lambda x: x = tr.path)) >= 4 THEN 'file_cap' WHEN tr.path IS NULL AND list_contains(st.ents, tr.entity) THEN 'duplicate_entity' WHEN st.used + tr.tokens > 600 THEN 'budget' END AS why FROM st JOIN tr ON tr.q = st.q AND tr.n = st.n + 1))"""


@query(f"""WITH RECURSIVE {_PACKED}, ok AS (SELECT q, d, n FROM st WHERE d IS NOT NULL AND why IS NULL)
 SELECT q AS query_id, d AS doc_id, row_number() OVER (PARTITION BY q ORDER BY n) AS place, CAST(NULL AS VARCHAR) AS reason FROM ok UNION ALL
 SELECT q, d, NULL, arg_max(why, n) FROM st WHERE why IS NOT NULL AND why <> 'taken' AND (q, d) NOT IN (SELECT q, d FROM ok) GROUP BY q, d""")
def context_packs(spark, sf):
    k = F.col("o_orderkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    representation = pick(k % 9, "test_behavior", "commit_summary", "knowledge_page", "signature", "signature", "chunk", "chunk", "chunk", "chunk")
    route = F.when(k % 9 == 3, "structural").otherwise("lexical")
    path = F.when(k % 9 == 5, "a.toml").when(k % 4 > 0, F.concat(F.lit("f"), (k % 2).cast("string")))
    hits = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), rank.cast("long").alias("rank"), k.alias("doc_id"), E.context_role(representation, route, path).alias("role"), path.alias("path"),
        (k % 5).cast("string").alias("span"), F.concat(F.lit("e"), (k % 3).cast("string")).alias("entity_id"), (40 + k % 90).alias("tokens"),
    )
    return E.context_pack(hits, 600, orientation=50)
