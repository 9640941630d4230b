"""Lookups, states and hit filters: parts stand for entities, order lines for relations, orders for snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lookups as L
from skein.sources.tables import load

from .registry import registry

QUERIES, ORACLES, query = registry()

_ENT = """ent AS (SELECT p_partkey AS k, 'e' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'document' END AS kind, replace(p_name, ' ', '_') AS name,
 'src/f' || p_partkey % 50 || '/' || replace(p_name, ' ', '/') || '.rs' AS path, CASE p_partkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'go' END AS language FROM part)"""
_REL = """rel AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'e' || l_partkey AS src, 'e' || (l_partkey * 7 + l_linenumber) % 200 AS dst, CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' WHEN 2 THEN 'tests' ELSE 'imports' END AS kind,
 CASE l_suppkey % 5 WHEN 0 THEN 'compiler' WHEN 1 THEN 'scip' WHEN 2 THEN 'syntax' WHEN 3 THEN 'derived' ELSE 'inferred' END AS origin, round(1 - l_discount * 5, 6) AS confidence FROM lineitem)"""


def pick(number, *names):
    out = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        out = F.when(number == i, name).otherwise(out)
    return out


def entities(spark, sf):
    k, p = F.col("p_partkey"), load(spark, sf, "part")
    path = F.concat(F.lit("src/f"), (k % 50).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".rs"))
    return p.select(
        k.alias("k"), F.concat(F.lit("e"), k.cast("string")).alias("id"), pick(F.col("p_size") % 4, "function", "method", "struct", "document").alias("kind"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), path.alias("path"), pick(k % 3, "rust", "python", "go").alias("language"),
    )


def relations(spark, sf):
    l, n = load(spark, sf, "lineitem"), F.col("l_linenumber")
    e = lambda x: F.concat(F.lit("e"), x.cast("string"))
    return l.select(
        (F.col("l_orderkey") * 10 + n).alias("id"), e(F.col("l_partkey")).alias("src"), e((F.col("l_partkey") * 7 + n) % 200).alias("dst"), pick(n % 4, "calls", "references", "tests", "imports").alias("kind"),
        pick(F.col("l_suppkey") % 5, "compiler", "scip", "syntax", "derived", "inferred").alias("origin"), F.round(1 - F.col("l_discount") * 5, 6).alias("confidence"),
    )


@query(f"WITH {_ENT} SELECT id, name FROM ent WHERE kind = 'struct' ORDER BY id")
def entities_by_kind(spark, sf):
    return entities(spark, sf).where("kind = 'struct'").orderBy("id").select("id", "name")


@query(f"WITH {_ENT}, w AS (SELECT 'e' || l_partkey AS id, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT id, ordinal, name FROM w JOIN ent USING (id)")
def entities_by_ids(spark, sf):
    ids = load(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return L.by_ids(entities(spark, sf).select("id", "name"), ids, "id")


@query("SELECT p_partkey AS region_id, p_partkey * 3 % 400 AS start_line, p_partkey * 3 % 400 + p_size AS end_line FROM part WHERE p_partkey % 50 = 7 ORDER BY start_line, region_id")
def regions_of_path(spark, sf):
    k = F.col("p_partkey")
    rows = load(spark, sf, "part").select(k.alias("region_id"), (k % 50).alias("path"), (k * 3 % 400).alias("start_line"), (k * 3 % 400 + F.col("p_size")).alias("end_line"))
    return rows.where("path = 7").orderBy("start_line", "region_id").drop("path")


@query(f"WITH {_REL} SELECT id, src, dst, confidence FROM rel WHERE kind = 'tests' ORDER BY confidence DESC, id LIMIT 400")
def relations_by_kind(spark, sf):
    return L.relations_by_kind(relations(spark, sf), "tests", 400).select("id", "src", "dst", "confidence")


@query("SELECT source || '/' || doc_id AS path, lang AS language, CAST(octet_length(encode(text)) AS BIGINT) AS byte_count FROM documents ORDER BY path")
def source_files(spark, sf):
    d = load(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("byte_count")).orderBy("path")


@query("""SELECT o_custkey AS repository_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'P'""")
def snapshots_newest_first(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("complete"))
    return L.newest(o).select("repository_id", "id", "place")


@query("""SELECT n_regionkey AS snapshot_id, string_agg(n_name || '=' || CASE n_nationkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'partial' ELSE 'failed' END, ',' ORDER BY n_name) AS views FROM nation GROUP BY 1""")
def view_manifest(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_regionkey").alias("snapshot_id"), F.col("n_name").alias("kind"), pick(F.col("n_nationkey") % 3, "ready", "partial", "failed").alias("state"))
    entry = F.transform(F.array_sort(F.map_entries("views")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return L.manifest(n).select("snapshot_id", F.array_join(entry, ",").alias("views"))


_SERVED = """ptr AS (SELECT c_custkey AS repository_id, c_custkey * 9 AS snapshot_id FROM customer), snap AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS complete FROM orders),
 served AS (SELECT repository_id, snapshot_id, coalesce(complete, FALSE) AS complete FROM ptr LEFT JOIN snap ON snapshot_id = id)"""


def _served(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("repository_id"), (F.col("c_custkey") * 9).alias("snapshot_id"))
    return L.serving(c, load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("complete")))


@query(f"WITH {_SERVED} SELECT * FROM served")
def serving_pointers(spark, sf):
    return _served(spark, sf)


@query(f"""WITH {_SERVED} SELECT c_custkey AS repository_id, CASE WHEN snapshot_id IS NULL THEN 'missing' WHEN snapshot_id = c_custkey * 9 + c_custkey % 2 THEN 'fresh' ELSE 'stale' END AS state FROM customer LEFT JOIN served ON c_custkey = repository_id AND complete""")
def freshness(spark, sf):
    k = F.col("c_custkey")
    return L.fresh_snapshot(_served(spark, sf), load(spark, sf, "customer").select(k.alias("repository_id"), (k * 9 + k % 2).alias("scanned_id")))


@query("""WITH b AS (SELECT sha256(text) AS digest, max(octet_length(encode(text))) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT sha256(text) AS digest FROM documents WHERE source IN ('src1', 'src2', 'src3'))
 SELECT count(k.digest) AS kept, count(*) - count(k.digest) AS deleted, CAST(coalesce(sum(size) FILTER (k.digest IS NULL), 0) AS BIGINT) AS freed_bytes FROM b LEFT JOIN k ON b.digest = k.digest""")
def retained_blobs(spark, sf):
    from skein.sources.tables import blobs

    d = load(spark, sf, "documents")
    return L.retain(blobs(d, "text"), d.where(F.col("source").isin("src1", "src2", "src3")).select(F.sha2("text", 256).alias("digest")))


def _bytes(first: str, last: str, most: int) -> str:
    """SQL of characters and their bytes, and of what the bytes from ``first`` to ``last`` show: half characters as replacements."""
    return f"""c AS (SELECT doc_id, unnest(string_split(text[1:{most}], '')) AS c, generate_subscripts(string_split(text[1:{most}], ''), 1) AS i FROM documents WHERE text IS NOT NULL),
 o AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM c), p AS (SELECT *, e - strlen(c) AS b, {first} AS s, {last} AS t FROM o),
 x AS (SELECT doc_id, string_agg(CASE WHEN b >= s AND e <= t THEN c WHEN b < s AND e > s THEN repeat(chr(65533), CAST(least(e, t) - s AS BIGINT)) WHEN b >= s AND b < t AND e > t THEN chr(65533) ELSE '' END, '' ORDER BY i) AS shown FROM p GROUP BY doc_id)"""


@query(f"""WITH {_bytes("doc_id % 40", "doc_id % 40 + 60", 110)} SELECT d.doc_id, coalesce(shown, '') AS slice FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id WHERE text IS NOT NULL""")
def source_slices(spark, sf):
    d, start = load(spark, sf, "documents").where("text IS NOT NULL"), F.col("doc_id") % 40
    return d.select("doc_id", L.source_slice(F.col("text"), start, start + 60).alias("slice"))


@query("""WITH d AS (SELECT doc_id AS id, lang, text, regexp_full_match(text[1:60], '[\\x00-\\x7F]*') AS plain FROM documents) SELECT id, CASE WHEN id % 2 = 0 OR NOT plain THEN upper(lang) ELSE text[6:30] END AS body FROM d""")
def materialised_documents(spark, sf):
    d = load(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    plain = F.substring("text", 1, 60).rlike("\\A[\\x00-\\x7F]*\\z")
    kind = F.when((F.col("doc_id") % 2 == 0) | ~plain, "whole/1").otherwise("slice/2")
    docs = d.select(F.col("doc_id").alias("id"), path.alias("path"), kind.alias("generated_by"), F.lit(5).alias("start"), F.lit(30).alias("end"))
    return L.materialised(docs, d.select(path.alias("path"), "text"), d.select(F.col("doc_id").alias("id"), F.upper("lang").alias("text")))


@query(f"""WITH {_bytes("0", "900", 900)} SELECT d.doc_id AS path, CASE WHEN strlen(text) > 900 THEN shown ELSE text END AS content, strlen(text) > 900 AS truncated, FALSE AS "binary" FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id WHERE text IS NOT NULL""")
def file_contents(spark, sf):
    d = load(spark, sf, "documents").where("text IS NOT NULL")
    return L.file_content(d.select(F.col("doc_id").alias("path"), "text"), 900)


@query(f"WITH {_REL} SELECT CAST(count(*) FILTER (kind = 'calls' AND origin = 'compiler') AS BIGINT) AS compiled_calls, CAST(count(*) FILTER (kind = 'tests') AS BIGINT) AS tests, CAST(count(*) FILTER (origin = 'inferred') AS BIGINT) AS inferred FROM rel")
def conditional_counts(spark, sf):
    test = {"compiled_calls": "kind = 'calls' AND origin = 'compiler'", "tests": "kind = 'tests'", "inferred": "origin = 'inferred'"}
    return relations(spark, sf).agg(*[F.count_if(F.expr(t)).alias(n) for n, t in test.items()])


@query("SELECT lang AS language, count(*) AS files, CAST(count(*) FILTER (n_chars > 500) AS BIGINT) AS parsed, round(avg((n_chars > 500)::INT), 9) AS ratio FROM documents GROUP BY 1")
def syntax_coverage(spark, sf):
    return L.coverage(load(spark, sf, "documents").select(F.col("lang").alias("language"), (F.col("n_chars") > 500).alias("parsed")))


@query("""SELECT 'c' || c_custkey AS snapshot_id, unnest(['symbols', 'graph', 'dataflow', 'knowledge']) AS kind, unnest([CASE WHEN c_acctbal / 10000 >= 0.99 THEN 'ready' ELSE 'partial' END, CASE WHEN c_nationkey % 4 > 0 AND c_custkey % 4 = c_nationkey % 4 THEN 'ready' ELSE 'partial' END, 'unavailable', 'partial']) AS state FROM customer""")
def view_states(spark, sf):
    c = load(spark, sf, "customer")
    return L.view_states(c.select(F.concat(F.lit("c"), "c_custkey").alias("snapshot_id"), (F.col("c_acctbal") / 10000).alias("coverage"), (F.col("c_nationkey") % 4).alias("providers"), (F.col("c_custkey") % 4).alias("ready")))


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey % 5 AS s, CASE o_orderkey % 7 WHEN 0 THEN 'symbols' WHEN 1 THEN 'lexical' WHEN 2 THEN 'dense' WHEN 3 THEN 'graph' WHEN 4 THEN 'knowledge' ELSE 'history' END AS kind FROM orders),
 v AS (SELECT s, kind, CASE (s + length(kind)) % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' WHEN 2 THEN 'stale' ELSE 'partial' END AS state FROM (SELECT unnest([0, 1, 2, 3]) AS s), (SELECT unnest(['symbols', 'lexical', 'dense', 'graph', 'history']) AS kind)),
 j AS (SELECT q, r.kind, coalesce(state IN ('ready', 'partial', 'stale'), FALSE) AS good FROM r LEFT JOIN v ON r.s = v.s AND r.kind = v.kind)
 SELECT q AS query_id, array_to_string(list_sort(coalesce(list(DISTINCT kind) FILTER (NOT good), [])), ',') AS missing, bool_and(good) AS ran FROM j GROUP BY q""")
def missing_views(spark, sf):
    k = F.col("o_orderkey")
    routes = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (k % 5).alias("snapshot_id"), pick(k % 7, "exact", "lexical", "dense", "structural", "knowledge", "history", "diff").alias("route"))
    names = ("symbols", "lexical", "dense", "graph", "history")
    views = spark.range(4).select(F.col("id").alias("snapshot_id"), F.explode(F.array(*map(F.lit, names))).alias("kind"))
    views = views.withColumn("state", pick((F.col("snapshot_id") + F.length("kind")) % 4, "ready", "failed", "stale", "partial"))
    return L.missing_views(routes, views).select("query_id", F.array_join("missing", ",").alias("missing"), "ran")


@query(f"""WITH {_REL}, k AS (SELECT src, string_agg(kind, ',' ORDER BY first) AS kinds FROM (SELECT src, kind, min(id) AS first FROM rel GROUP BY 1, 2) GROUP BY 1)
 SELECT rel.src, CAST(count(*) FILTER (origin IN ('compiler', 'scip', 'lsp')) AS BIGINT) AS precise, CAST(count(*) FILTER (origin = 'syntax') AS BIGINT) AS syntactic, CAST(count(*) FILTER (origin = 'derived') AS BIGINT) AS derived,
 CAST(count(*) FILTER (origin = 'inferred') AS BIGINT) AS inferred, max(kinds) AS kinds FROM rel JOIN k ON rel.src = k.src GROUP BY rel.src""")
def relation_provenance(spark, sf):
    return L.provenance(relations(spark, sf), "src")


@query(f"""WITH {_ENT}, h AS (SELECT o_orderkey AS id, 'e' || o_orderkey % 200 AS entity_id, CASE WHEN o_orderkey % 3 > 0 THEN 'src/f' || o_orderkey % 9 END AS path, ['lib/' || o_custkey % 5, 'src/f' || o_custkey % 9] AS evidence FROM orders)
 SELECT h.id FROM h WHERE (coalesce(starts_with(path, 'src/f4'), FALSE) OR len(list_filter(evidence, lambda p: starts_with(p, 'src/f4'))) > 0) AND entity_id IN (SELECT id FROM ent WHERE language = 'python')""")
def filtered_hits(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = lambda n: F.concat(F.lit("src/f"), (n % 9).cast("string"))
    hits = load(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("e"), (k % 200).cast("string")).alias("entity_id"), F.when(k % 3 > 0, f(k)).alias("path"), F.array(F.concat(F.lit("lib/"), (c % 5).cast("string")), f(c)).alias("evidence"))
    return L.matching_hits(hits, entities(spark, sf).select(F.col("id").alias("entity_id"), "language"), "src/f4", "Python").select("id")


@query(f"""WITH {_ENT} SELECT id, (contains(lower(path), 'test') OR contains(lower(path), 'spec') OR name IN ('test', 'tests') OR list_has_any(string_split('f::' || replace(name, '_', '::'), '::'), ['test', 'tests', 'testing'])) AS test, list_has_any(string_split(path, '/'), ['tests', 'test', '__tests__', 'spec', 'widget']) AND NOT contains(path, 'widget') AS test_path,
 kind IN ('struct', 'function', 'method') AS scope FROM ent""")
def entity_predicates(spark, sf):
    e, name = entities(spark, sf), F.col("name")
    qualified = F.concat(F.lit("f::"), F.replace("name", F.lit("_"), F.lit("::")))
    return e.select("id", L.is_test_entity(T.is_test(F.col("path"), name), qualified).alias("test"), L.is_test_path(F.col("path")).alias("test_path"), F.col("kind").isin(*L.CODE_SCOPES).alias("scope"))


@query("""SELECT o_custkey AS k, min(o_orderkey) AS id, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def first_seen(spark, sf):
    return L.first_seen(load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "k", "id")


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey % 20 AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), t AS (SELECT * FROM h WHERE rank <= 3),
 f AS (SELECT q, path, min(rank) AS r FROM t GROUP BY 1, 2), g AS (SELECT q, path // 5 AS pkg, min(rank) AS r FROM t WHERE path < 15 GROUP BY 1, 2)
 SELECT f.q AS query_id, string_agg(path, ',' ORDER BY r) AS paths, coalesce((SELECT string_agg(pkg, ',' ORDER BY r) FROM g WHERE g.q = f.q), '') AS packages FROM f GROUP BY f.q""")
def head_paths(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    fused = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 20).alias("path"), rank.alias("rank"))
    owned = spark.range(15).select(F.col("id").alias("path"), F.floor(F.col("id") / 5).alias("package"))
    return L.head_paths(fused, owned).select("query_id", F.array_join("paths", ",").alias("paths"), F.array_join("packages", ",").alias("packages"))


@query("""WITH p AS (SELECT o_custkey AS q, o_orderkey AS id, o_orderstatus = 'F' AS named, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
 SELECT q, id, named, turn FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n, named DESC) AS turn FROM p WHERE n <= 12) WHERE turn <= 12""")
def two_lanes(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("named"), "o_totalprice")
    return L.two_lanes(o, "q", "named", [F.desc("o_totalprice"), F.col("id")]).drop("o_totalprice")


@query("""WITH h AS (SELECT 'e' || o_orderkey % 30 AS e, 'r' || o_orderkey % 70 AS r, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey % 12 END AS p, o_totalprice AS s FROM orders)
 SELECT 'entity' AS level, e AS id, max(s) AS best, count(*) AS n FROM h GROUP BY e UNION ALL SELECT 'region', r, max(s), count(*) FROM h GROUP BY r UNION ALL SELECT 'path', p, max(s), count(*) FROM h WHERE p IS NOT NULL GROUP BY p UNION ALL SELECT 'all', NULL, max(s), count(*) FROM h""")
def expansion_evidence(spark, sf):
    k = F.col("o_orderkey")
    name = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    return L.expansion_evidence(load(spark, sf, "orders").select(name("e", 30).alias("entity_id"), name("r", 70).alias("region_id"), F.when(k % 2 == 0, name("p", 12)).alias("path"), F.col("o_totalprice").alias("score")))


@query("""SELECT p_partkey, p_name || ' ' || array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') || ' ' || replace(p_name, ' ', '') AS forms, replace(lower(p_name), ' ', '-') AS slug, 'a/' || replace(p_name, ' ', '/') AS path, split_part(p_name, ' ', 2) AS base,
 'a/' || split_part(p_name, ' ', 1) AS parent, 'a' AS top, CASE p_size % 3 WHEN 0 THEN 1.15 WHEN 1 THEN 1.1 ELSE 1.0 END::DOUBLE AS weight, left(p_name, 5) AS cut FROM part""")
def path_functions(spark, sf):
    raw = F.concat(F.lit("./a/x/../"), F.replace("p_name", F.lit(" "), F.lit("//")), F.lit("/."))
    rows = load(spark, sf, "part").withColumn("path", L.normalised_path(raw))
    forms = L.name_forms(F.col("p_name"), T.identifier_terms(F.col("p_name")), T.folded(F.col("p_name")))
    kind = pick(F.col("p_size") % 3, "knowledge_page", "test_behavior", "chunk")
    return rows.select(
        "p_partkey", forms.alias("forms"), L.slug(F.col("p_name")).alias("slug"), "path", L.base_name(F.col("path")).alias("base"), L.parent_dir(F.col("path")).alias("parent"),
        L.top_dir(F.col("path")).alias("top"), L.representation_weight(kind).alias("weight"), L.truncated(F.col("p_name"), 5).alias("cut"),
    )


@query("""SELECT sha256('{"chunk":65536,"version":3}') AS profile""")
def index_profile(spark, sf):
    return spark.range(1).select(L.index_profile({"version": 3, "chunk": 65536}).alias("profile"))
