"""Pages, federation, variants, patterns and occurrences over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import reports as R
from skein.sources.tables import load

from .lookups import _ENT, entities
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""WITH f AS (SELECT source || '/' || doc_id AS path, lang, n_chars FROM documents), g AS (SELECT *, split_part(path, '/', 1) AS grp FROM f UNION ALL SELECT *, '(all)' FROM f),
 l AS (SELECT grp, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS languages FROM (SELECT grp, lang, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1), e AS (SELECT grp, string_agg(path, ',' ORDER BY path) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY path) AS n FROM g) WHERE n <= 16 GROUP BY 1)
 SELECT g.grp, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS lines, any_value(languages) AS languages, any_value(evidence) AS evidence FROM g JOIN l ON g.grp = l.grp JOIN e ON g.grp = e.grp GROUP BY g.grp""")
def knowledge_pages(spark, sf):
    d = load(spark, sf, "documents")
    return R.knowledge_pages(d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("lines")))


def _federation(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("doc_id"))
    states = o.select("repo").distinct().withColumn("state", F.when(F.col("repo").startswith("4"), "timeout").when(F.col("repo").startswith("2"), "failed").otherwise("ok"))
    return o.withColumn("rank", F.struct((-F.col("p")).alias("p"), "doc_id")).drop("p"), states


@query("""WITH h AS (SELECT o_orderpriority AS repo, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE left(o_orderpriority, 1) NOT IN ('2', '4')) SELECT repo, doc_id, place FROM h ORDER BY place, repo LIMIT 40""")
def federated_hits(spark, sf):
    return R.federated(*_federation(spark, sf), 40)


@query("""SELECT DISTINCT o_orderpriority AS repo, CASE left(o_orderpriority, 1) WHEN '4' THEN 'timeout' ELSE 'failed' END AS state FROM orders WHERE left(o_orderpriority, 1) IN ('2', '4') ORDER BY repo""")
def degraded_repositories(spark, sf):
    return R.degraded(_federation(spark, sf)[1])


@query("""SELECT p_partkey AS doc_id, 'Source: ' || CASE WHEN p_partkey % 3 = 0 THEN 'no direct source range' ELSE 'f' || p_partkey % 50 || ':' || p_size || '-' || p_size + 4 || ' bytes ' || p_size * 9 || '..' || p_size * 20 END || chr(10) || 'Route: lexical; routes: lexical, dense' || chr(10) || 'Evidence:' || chr(10) || p_name AS body FROM part""")
def rendered_hits(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    path = F.when(k % 3 > 0, F.concat(F.lit("f"), (k % 50).cast("string")))
    rows = load(spark, sf, "part").select(k.alias("doc_id"), path.alias("path"), s.alias("start_line"), (s + 4).alias("end_line"), (s * 9).alias("start_byte"), (s * 20).alias("end_byte"), F.lit("lexical").alias("route"), F.array(F.lit("lexical"), F.lit("dense")).alias("routes"), F.col("p_name").alias("snippet"))
    return R.rendered(rows)


@query("""WITH c AS (SELECT p_partkey AS k, p_name || ' in the ' || p_type AS q, p_partkey % 4 = 0 AS blank, list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type) AS w FROM part),
 v AS (SELECT k, q, 'verbose' AS kind, 'please help me understand: ' || q || '?' AS t FROM c UNION ALL SELECT k, q, 'assertive', 'I''m certain this exists in the codebase: ' || q FROM c UNION ALL SELECT k, q, 'hedged', 'not sure this exists, but if it does: ' || q FROM c
  UNION ALL SELECT k, q, 'keyword-scramble', (SELECT string_agg(x, ' ' ORDER BY md5(x || ':' || i)) FROM (SELECT unnest(w) AS x, unnest([0, 1, 2]) AS i)) FROM c WHERE NOT blank)
 SELECT k || '::var-' || kind AS case_id, k AS derived_from, kind, t AS query FROM v WHERE t <> q""")
def query_variants(spark, sf):
    k = F.col("p_partkey")
    return R.query_variants(load(spark, sf, "part").select(k.alias("case_id"), F.concat("p_name", F.lit(" in the "), "p_type").alias("query"), (k % 4 == 0).alias("no_context")))


@query("""SELECT 'f' || p_partkey AS path, CAST(1 AS BIGINT) AS place, replace(p_name, ' ', '.') || '.lock( ).unwrap()' AS match FROM part WHERE p_partkey % 3 <> 0""")
def structural_matches(spark, sf):
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("let a = "), F.replace("p_name", F.lit(" "), F.lit(".")), F.when(F.col("p_partkey") % 3 == 0, ".lock().expect(1);").otherwise(".lock( ).unwrap();"))
    return R.structural_matches(load(spark, sf, "part").select(F.concat(F.lit("f"), k).alias("path"), body.alias("text")), "$A.lock().unwrap()")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'case:no (file:src/f' || p_partkey || '\\.rs or ' || replace(p_name, ' ', '_') || ' or fooBar)' END AS q FROM part""")
def code_search_queries(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("why src/f"), k.cast("string"), F.lit(".rs and "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" fooBar, fooBar?"))).otherwise(F.lit("why is it slow"))
    return load(spark, sf, "part").select("p_partkey", R.code_search_query(text).alias("q"))


@query("""WITH r AS (SELECT o_custkey % 20 AS owner, o_orderkey AS id, o_orderkey * 7 % 3000 AS s, o_orderkey * 7 % 3000 + 300 AS e FROM orders), oc AS (SELECT o_custkey % 20 AS owner, o_orderkey * 11 % 3000 AS pos, CASE WHEN o_orderkey % 6 = 0 THEN 'local ' ELSE 'g ' END || o_orderkey % 41 AS symbol, o_orderkey % 5 = 0 AS def FROM orders),
 un AS (SELECT owner, pos, arg_min(id, (e - s) * 10000000 + id) AS unit FROM (SELECT DISTINCT owner, pos FROM oc) p JOIN r USING (owner) WHERE s <= pos AND pos < e GROUP BY 1, 2),
 j AS (SELECT oc.*, unit, CASE WHEN starts_with(symbol, 'local ') THEN owner || '|' || symbol ELSE symbol END AS key FROM oc JOIN un USING (owner, pos)), d AS (SELECT key, unit AS dst FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY owner, pos, unit) AS n FROM j WHERE def) WHERE n = 1)
 SELECT unit AS src, dst, count(*) AS uses FROM j JOIN d USING (key) WHERE NOT def AND unit <> dst GROUP BY 1, 2""")
def occurrence_edges(spark, sf):
    o, k = load(spark, sf, "orders"), F.col("o_orderkey")
    ranges = o.select((F.col("o_custkey") % 20).alias("path"), k.alias("range_id"), (k * 7 % 3000).alias("start"), (k * 7 % 3000 + 300).alias("end"))
    symbol = F.concat(F.when(k % 6 == 0, "local ").otherwise("g "), (k % 41).cast("string"))
    return R.occurrence_edges(o.select((F.col("o_custkey") % 20).alias("path"), (k * 11 % 3000).alias("at"), symbol.alias("symbol"), (k % 5 == 0).alias("is_definition")), ranges)


@query("""WITH t AS (SELECT doc_id, sha256(text) AS h, source FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT h FROM t WHERE source IN ('src1', 'src2')) SELECT 'ready' AS state, CAST(count(c.h) AS BIGINT) AS reused, CAST(count(*) - count(c.h) AS BIGINT) AS embedded FROM t LEFT JOIN c ON t.h = c.h""")
def dense_view(spark, sf):
    d = load(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("digest"), T.tokens(F.col("text")).alias("words"))
    cache = d.where(F.col("source").isin("src1", "src2")).select("digest").distinct().withColumn("vector", F.array(F.lit(1.0)))
    return R.dense_view(d.drop("source"), cache, 64)[1]


@query("""WITH o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS origin FROM orders WHERE o_orderstatus = 'F') SELECT origin, CAST(count(*) FILTER (o.id IS NULL) AS BIGINT) AS added, CAST(count(o.id) AS BIGINT) AS replaced FROM n LEFT JOIN o ON n.id = o.id GROUP BY 1""")
def provider_ingest(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("origin"), "o_orderstatus")
    return R.ingested(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'F'"))


@query(f"WITH {_ENT} SELECT CASE kind WHEN 'function' THEN 'fn' WHEN 'method' THEN 'fn' ELSE 'other' END AS role, string_agg(name, ', ' ORDER BY name, id) AS names, count(*) AS n FROM ent GROUP BY 1")
def entity_roles(spark, sf):
    e = entities(spark, sf)
    role = F.when(F.col("kind").isin("function", "method"), "fn").otherwise("other")
    rows = e.groupBy(role.alias("role")).agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("x"), F.count("*").alias("n"))
    return rows.select("role", F.array_join("x.name", ", ").alias("names"), "n")


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN octet_length(encode('aé' || p_name)) ELSE 3 END AS BIGINT) AS narrow, CAST(CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 1 END AS BIGINT) AS wide FROM part")
def column_bytes(spark, sf):
    k = F.col("p_partkey")
    narrow = R.column_to_byte(F.concat(F.lit("aé"), "p_name"), F.when(k % 3 == 0, 999).otherwise(3))
    wide = R.column_to_byte(F.concat(F.lit("a😀"), "p_name"), F.when(k % 2 == 0, 3).otherwise(1), utf16=True)
    return load(spark, sf, "part").select("p_partkey", narrow.alias("narrow"), wide.alias("wide"))
