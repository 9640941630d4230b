"""Scans, predicates, joins, sets and snapshots over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import joins, snapshots
from skein.operators.graphs import owners
from skein.operators.ranking import round_robin, top_per_key
from skein.sources import tables
from skein.sources.tables import load
from skein.streaming.monitors import new_hits, windowed

from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""WITH d AS (SELECT octet_length(encode(text)) * 200 AS size, CASE doc_id % 5 WHEN 0 THEN 'a/yarn.lock' WHEN 1 THEN 'b/.env.local' WHEN 2 THEN 'c/app.min.js' WHEN 3 THEN 'd/id_rsa' ELSE 'e/main.rs' END AS path, doc_id % 7 = 0 AS bin FROM documents)
 SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN size > 2097152 THEN 'large' WHEN path IN ('a/yarn.lock', 'c/app.min.js') THEN 'builtin' WHEN path IN ('b/.env.local', 'd/id_rsa') THEN 'sensitive' WHEN bin THEN 'binary' ELSE 'kept' END AS reason FROM d) GROUP BY reason""")
def doc_reason_buckets(spark, sf):
    k, names = F.col("doc_id"), F.array(*map(F.lit, ("a/yarn.lock", "b/.env.local", "c/app.min.js", "d/id_rsa", "e/main.rs")))
    reason = tables.skip_reason(F.get(names, (k % 5).cast("int")), F.octet_length("text") * 200, k % 7 == 0)
    return load(spark, sf, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS lines FROM documents""")
def line_count(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.line_count(F.col("text")).alias("lines"))


@query("""SELECT CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'rust' WHEN 'fr' THEN 'python' ELSE NULL END AS language,
 CASE lang WHEN 'en' THEN 'prose' WHEN 'de' THEN 'code' WHEN 'fr' THEN 'code' ELSE 'code' END AS class, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1, 2""")
def lang_by_ext(spark, sf):
    end = F.create_map(*[F.lit(x) for x in ("en", "md", "de", "rs", "fr", "py", "es", "xyz")])
    path = F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), end[F.col("lang")])
    rows = load(spark, sf, "documents").select(T.language_for_path(path).alias("language"), T.document_class(path).alias("class"))
    return rows.groupBy("language", "class").agg(F.count("*").alias("n"))


@query("""SELECT l_partkey AS path, max(o_orderdate) AS touched FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def last_touched(spark, sf):
    o, l = load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("l_partkey").alias("path")).agg(F.max("o_orderdate").alias("touched"))


@query("""SELECT sha256(text) AS digest, CAST(max(octet_length(encode(text))) AS BIGINT) AS size_bytes, CAST(count(*) AS BIGINT) AS uses FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def blob_dedup(spark, sf):
    return tables.blobs(load(spark, sf, "documents"), "text")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500""")
def keyset_page(spark, sf):
    return tables.keyset_page(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 500)


@query("""SELECT 'documents' AS name, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'pages', CAST(count(*) AS BIGINT) FROM pages
 UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM events UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem""")
def export_counts(spark, sf):
    out = None
    for name in ("documents", "pages", "events", "lineitem"):
        one = load(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT DISTINCT sha256(text) AS digest FROM documents WHERE source <> 'src0' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')""")
def missing_blobs(spark, sf):
    d = load(spark, sf, "documents").select("source", F.sha2("text", 256).alias("digest"))
    return tables.missing_blobs(d.where("source <> 'src0'"), d.where("source = 'src0'"))


@query("""SELECT doc_id, source || '/' || doc_id AS path FROM documents WHERE starts_with(source || '/' || doc_id, 'src1/') AND lower(lang) = 'en'""")
def path_prefix_filter(spark, sf):
    d = load(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return d.select("doc_id", path.alias("path"), "lang").where(F.col("path").startswith("src1/") & (F.lower("lang") == "en")).drop("lang")


@query("""SELECT page_id, (contains(lower(url), 'test') OR contains(lower(url), 'spec') OR starts_with(regexp_extract(url, '^[a-z]+://([^/]+)', 1), 'test_')) AS test FROM pages""")
def is_test_predicate(spark, sf):
    return load(spark, sf, "pages").select("page_id", T.is_test(F.col("url"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("test"))


@query("""SELECT source AS grp, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def knowledge_groups(spark, sf):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return load(spark, sf, "documents").groupBy(T.knowledge_group(path).alias("grp")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey AS owner, o_orderkey AS range_id, CAST(o_orderkey AS BIGINT) * 7 % 5000 AS s, CAST(o_orderkey AS BIGINT) * 7 % 5000 + 200 + o_orderkey % 300 AS e FROM orders),
 p AS (SELECT DISTINCT o_custkey AS owner, CAST(o_orderkey AS BIGINT) * 11 % 5000 AS pos FROM orders),
 h AS (SELECT p.owner, p.pos, range_id, s, e, row_number() OVER (PARTITION BY p.owner, p.pos ORDER BY e - s, range_id) AS rn FROM p JOIN r ON p.owner = r.owner AND s <= pos AND pos < e)
 SELECT owner, pos AS "at", range_id, s AS start, e AS "end" FROM h WHERE rn = 1""")
def region_containment(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    ranges = o.select(F.col("o_custkey").alias("owner"), k.alias("range_id"), (k * 7 % 5000).alias("start"), (k * 7 % 5000 + 200 + k % 300).alias("end"))
    points = o.select(F.col("o_custkey").alias("owner"), (k * 11 % 5000).alias("at")).distinct()
    return joins.smallest_enclosing(points, ranges, "owner", 256)


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
 roots AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS root FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) FROM p WHERE regexp_matches(path, '^[^/]+/[^/]+')),
 u AS (SELECT DISTINCT path FROM p),
 m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn FROM u JOIN roots ON path = root OR starts_with(path, root || '/'))
 SELECT path, root AS package FROM m WHERE rn = 1""")
def longest_prefix_owner(spark, sf):
    p = load(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path")).distinct()
    one, two = F.regexp_extract("path", "^([^/]+)", 1), F.regexp_extract("path", "^([^/]+/[^/]+)", 1)
    roots = p.select(F.explode(F.array(one, two)).alias("root")).where("root <> ''").distinct().withColumn("package", F.col("root"))
    return owners(p, roots)


@query("""WITH c AS (SELECT o_orderkey AS call_id, o_custkey % 25 AS name, o_custkey % 7 AS path FROM orders), t AS (SELECT c_custkey AS target_id, c_nationkey AS name, c_custkey % 7 AS path, c_custkey % 2 = 0 AS callable FROM customer),
 j AS (SELECT call_id, target_id, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN c.path = t.path THEN 0 ELSE 1 END, CASE WHEN callable THEN 0 ELSE 1 END, target_id) AS rn, count(*) OVER (PARTITION BY call_id) AS n FROM c JOIN t ON c.name = t.name)
 SELECT call_id, target_id, CAST(n AS BIGINT) AS candidates, CASE WHEN n > 1 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence FROM j WHERE rn = 1""")
def ranked_name_resolution(spark, sf):
    """The same file before others, what can be called before the rest."""
    c, k = F.col("o_custkey"), F.col("c_custkey")
    calls = load(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), (c % 25).alias("name"), (c % 7).alias("path"))
    targets = load(spark, sf, "customer").select(k.alias("target_id"), F.col("c_nationkey").cast("long").alias("name"), (k % 7).alias("there"), (k % 2 == 0).alias("callable"))
    return joins.resolve(calls, targets, lambda here: F.when(here, 0).otherwise(2) + F.when(F.col("callable"), 0).otherwise(1))


@query("""WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3)
 SELECT * FROM (SELECT id, CAST(0 AS BIGINT) AS preference FROM a UNION ALL SELECT id, CAST(1 AS BIGINT) FROM b WHERE id NOT IN (SELECT id FROM a)) ORDER BY preference, id LIMIT 300""")
def name_union_antijoin(spark, sf):
    c = load(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    return joins.prefer_first(c.where("c_mktsegment = 'BUILDING'").select("id"), c.where("c_nationkey = 3").select("id"), "id", 300)


@query("""SELECT event_type, lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT e.event_type, d.lang FROM events e JOIN documents d ON e.user_id = d.doc_id) GROUP BY GROUPING SETS ((event_type), (lang))""")
def facets(spark, sf):
    e, d = load(spark, sf, "events").select("user_id", "event_type"), load(spark, sf, "documents").select("doc_id", "lang")
    both = e.join(d, e.user_id == d.doc_id)
    return both.groupingSets([["event_type"], ["lang"]], "event_type", "lang").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_orderpriority AS lane, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders)
 SELECT lane, o_orderkey, CAST(place AS BIGINT) AS place FROM h ORDER BY place, lane LIMIT 50""")
def round_robin_merge(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("lane"), "o_orderkey", "o_totalprice")
    return round_robin(o, "lane", [F.desc("o_totalprice"), F.col("o_orderkey")], 50).drop("o_totalprice")


@query("""WITH s AS (SELECT o_custkey AS repository_id, o_orderkey AS id, o_orderdate AS created_at, o_orderstatus <> 'P' AS complete, o_orderkey % 97 = 0 AS cur FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY complete DESC, created_at DESC, id) AS rn FROM s) SELECT id, (complete AND (cur OR rn <= 3)) AS keep FROM r""")
def retention(spark, sf):
    o = load(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("complete"), (F.col("o_orderkey") % 97 == 0).alias("current"))
    return snapshots.retained(s, 3).select("id", "keep")


@query("""SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base_id FROM orders""")
def prior_snapshot(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return snapshots.previous(o).select("id", "base_id")


@query("""WITH a AS (SELECT l_partkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 3 <> 0),
 b AS (SELECT l_partkey, l_returnflag, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem WHERE l_orderkey % 3 <> 1)
 SELECT change, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.l_quantity IS DISTINCT FROM b.l_quantity THEN 'changed' END AS change
 FROM a FULL OUTER JOIN b ON a.l_partkey = b.l_partkey AND a.l_returnflag = b.l_returnflag AND a.n = b.n) WHERE change IS NOT NULL GROUP BY change""")
def multiset_diff(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    head = l.where("l_orderkey % 3 <> 1").withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    found = snapshots.multiset_diff(l.where("l_orderkey % 3 <> 0"), head, ["l_partkey", "l_returnflag"], "l_quantity", "id")
    return found.groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS digest FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 UNION SELECT l_suppkey FROM lineitem)""")
def gc_orphans(spark, sf):
    l = load(spark, sf, "lineitem")
    parts = load(spark, sf, "part").select(F.col("p_partkey").alias("digest"))
    return snapshots.orphans(parts, l.where("l_quantity > 40").select(F.col("l_partkey").alias("digest")), l.select(F.col("l_suppkey").alias("digest")))


@query("""SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-04' AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-04')""")
def monitor_new_hits(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type", "ts")
    late = e.where("ts >= timestamp'2024-01-04'").select("user_id", "event_type").distinct()
    return new_hits(late, e.where("ts < timestamp'2024-01-04'"), ["user_id", "event_type"])


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def event_windows(spark, sf):
    return windowed(load(spark, sf, "events"))


@query("""SELECT source, doc_id, n_chars, CAST(place AS BIGINT) AS place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 4""")
def top_per_file(spark, sf):
    return top_per_key(load(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 4)


@query("""SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey""")
def role_summary(spark, sf):
    return load(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"), F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(floor((length(text) + length(text) - length(regexp_replace(text, '[{}\\[\\]();:,.<>/`]', '', 'g'))) / 4) + 1 AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.estimated_tokens(F.col("text")).cast("long").alias("tokens"))


@query("""WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || '_HTTPServer2' AS name, p_name FROM part)
 SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['httpserver2']))), ' ') AS terms, lower(replace(name, '_', '')) AS folded FROM n""")
def identifier_terms(spark, sf):
    """Names in camel case with an abbreviation and a digit, which don't cut."""
    w = F.split("p_name", " ")
    name = F.concat(w[0], F.initcap(w[1]), F.lit("_HTTPServer2"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(T.identifier_terms(name), " ").alias("terms"), T.folded(name).alias("folded"))


@query("""SELECT page_id, h[1] AS target FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS t, [t] AS h FROM pages)""")
def import_edges(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))).alias("target"))


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS digest, CASE lang WHEN 'en' THEN 'small' ELSE 'large' END AS profile FROM documents WHERE source IN ('src0', 'src1', 'src2')),
 d AS (SELECT doc_id, sha256(text) AS digest, CASE doc_id % 2 WHEN 0 THEN 'small' ELSE 'large' END AS profile FROM documents)
 SELECT doc_id, c.digest IS NOT NULL AS reused FROM d LEFT JOIN c ON d.digest = c.digest AND d.profile = c.profile""")
def vector_reuse(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))
    cache = d.where(F.col("source").isin("src0", "src1", "src2")).select("digest", F.when(F.col("lang") == "en", "small").otherwise("large").alias("profile")).distinct()
    new = d.select("doc_id", "digest", F.when(F.col("doc_id") % 2 == 0, "small").otherwise("large").alias("profile"))
    hit, rest = snapshots.reuse(new, cache, ["digest", "profile"])
    return hit.select("doc_id", F.lit(True).alias("reused")).unionByName(rest.select("doc_id", F.lit(False).alias("reused")))
