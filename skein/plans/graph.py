"""Typed-graph queries: customers, orders and parts stand for entities, order lines for edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graphs
from skein.sources.tables import load
from skein.workspace import stored, union

from .lookups import _ENT, _REL, entities, relations
from .registry import registry

QUERIES, ORACLES, query = registry()

_EDGES = """e AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'calls' AS kind, round(1 - max(l_discount) * 5, 6) AS confidence FROM lineitem GROUP BY ALL
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'references', 0.8::DOUBLE FROM orders
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'contains', 1.0::DOUBLE FROM customer)"""


def edges(spark, sf):
    """(src, dst, kind, confidence) of a typed graph over the order tables, a stored table."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    l = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.round(1 - F.max("l_discount") * 5, 6).alias("confidence"))
    calls = l.select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"), F.lit("calls").alias("kind"), "confidence")
    refs = load(spark, sf, "orders").select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"), F.lit("references").alias("kind"), F.lit(0.8).alias("confidence"))
    holds = load(spark, sf, "customer").select(node("n", "c_nationkey").alias("src"), node("c", "c_custkey").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    both = calls.unionByName(refs).unionByName(holds)
    return stored(spark, "edges", 1, both, *_sources(sf))


def _sources(sf):
    return [f"{sf.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders", "customer")]


def graph_of(spark, sf):
    """The same edges in tables sorted by source and by target, with degrees sorted by node; each is built when it is first read."""
    both = edges(spark, sf)
    by = lambda end: lambda: stored(spark, f"edges-{end}", 1, both.repartitionByRange(end).sortWithinPartitions(end), *_sources(sf))
    degree = lambda: stored(spark, "edges-degree", 1, graphs.degrees(both).repartitionByRange("node").sortWithinPartitions("node"), *_sources(sf))
    return graphs.SortedEdges(by("src"), by("dst"), degree, spark)


def _walked(seeds: str, follow: str, kinds: str) -> str:
    """SQL of two hops: the strongest 24 edges of each node, the degree of the node reached, the four best arrivals, no node started from twice."""
    reach = lambda front, decay: f"""SELECT to_, f.n AS place, t.confidence, kind, round(f.score * t.confidence * {decay} / (1 + ln(greatest(degree, 1))), 9) AS score
  FROM {front} f JOIN t ON t.pos = f.node JOIN g ON g.node = to_ WHERE kind IN ({kinds})"""  # noqa: E731
    return f"""b AS ({follow}), g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY node),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY confidence DESC, to_, kind) AS place FROM b) WHERE place <= 24),
 f0 AS (SELECT node, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY node) - 1 AS n FROM (SELECT unnest([{seeds}]) AS node)), r1 AS ({reach("f0", "1.0::DOUBLE")}),
 a1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, place, confidence DESC, to_, kind) AS z FROM r1 QUALIFY z <= 4),
 f1 AS (SELECT to_ AS node, max(score) AS score, row_number() OVER (ORDER BY min(z)) - 1 AS n FROM a1 WHERE score > 0.001 AND to_ NOT IN (SELECT node FROM f0) GROUP BY to_), r2 AS ({reach("f1", "0.5::DOUBLE")})
 SELECT to_ AS node, CAST(1 AS BIGINT) AS hop, max(score) AS score FROM r1 GROUP BY to_ UNION ALL SELECT to_, CAST(2 AS BIGINT), max(score) FROM r2 GROUP BY to_"""


_BOTH = "SELECT src AS pos, dst AS to_, kind, confidence FROM e UNION SELECT dst, src, kind, confidence FROM e"


@query(f"WITH {_EDGES} SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e WHERE src <> dst) GROUP BY node")
def degree(spark, sf):
    return graphs.degrees(edges(spark, sf))


@query(f"WITH {_EDGES} SELECT src, dst, kind, confidence, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind) AS place FROM e) WHERE place <= 3")
def topk_edges(spark, sf):
    return graphs.top_edges(edges(spark, sf), 3)


@query(f"""WITH {_EDGES}, {_walked("'c1', 'c2', 'c4'", _BOTH, "'calls', 'references'")}""")
def expand_two_hop(spark, sf):
    seeds = spark.createDataFrame([("c1", 1.0), ("c2", 1.0), ("c4", 1.0)], "node string, score double")
    return graphs.expand(graph_of(spark, sf), seeds, ["calls", "references"])


def _flow_universe(nodes: str, name: str) -> str:
    return f"""{name}o AS (SELECT src, dst, kind, confidence, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind) AS n FROM e WHERE src IN (SELECT pos FROM {nodes})),
 {name}i AS (SELECT src, dst, kind, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src, kind) AS n FROM e WHERE dst IN (SELECT pos FROM {nodes})),
 {name} AS (SELECT src, dst, kind, confidence FROM {name}o WHERE n <= 64 UNION SELECT src, dst, kind, confidence FROM {name}i WHERE n <= 64)"""


def _flow_shares(universe: str, name: str) -> str:
    return f"""{name}w AS (SELECT src AS pos, dst AS to_, src || '|' || dst || '|' || kind AS edge, kind || '>' AS way, confidence, CASE kind WHEN 'calls' THEN 0.8 WHEN 'references' THEN 0.5 ELSE 0.3 END AS k FROM {universe}
 UNION ALL SELECT dst, src, src || '|' || dst || '|' || kind, kind || '<', confidence, CASE kind WHEN 'calls' THEN 0.5 WHEN 'references' THEN 0.4 ELSE 0.9 END FROM {universe}),
 {name} AS (SELECT * FROM (SELECT pos, to_, edge, k * confidence / sum(confidence) OVER (PARTITION BY pos, way) AS share FROM {name}w) WHERE share > 0)"""


@query(f"""WITH {_EDGES}, st AS (SELECT unnest(['c1', 'c2', 'c4']) AS pos), {_flow_universe("st", "u1")}, {_flow_shares("u1", "s1")},
 h1 AS (SELECT st.pos AS seed, to_ AS pos, edge, share AS mass FROM st JOIN s1 USING (pos)),
 r AS (SELECT pos FROM h1 WHERE pos NOT IN (SELECT pos FROM st) GROUP BY pos ORDER BY round(sum(mass), 9) DESC, pos LIMIT 16), {_flow_universe("r", "v")}, u2 AS (SELECT * FROM u1 UNION SELECT * FROM v), {_flow_shares("u2", "s2")},
 h2 AS (SELECT seed, to_ AS pos, mass * share AS mass FROM h1 JOIN s2 ON s2.pos = h1.pos AND s2.edge <> h1.edge)
 SELECT pos AS node, round(sum(m), 9) AS mass, CAST(count(DISTINCT seed) AS BIGINT) AS senders FROM (SELECT seed, pos, mass * 0.5 AS m FROM h1 UNION ALL SELECT seed, pos, mass * 0.25 FROM h2) GROUP BY pos""")
def mass_flow(spark, sf):
    seeds = spark.createDataFrame([("c1", 1.0), ("c2", 1.0), ("c4", 1.0)], "node string, mass double")
    return graphs.mass_flow(graph_of(spark, sf), seeds)


@query(f"""WITH {_EDGES}, i AS (SELECT src, dst, max(confidence) AS confidence FROM e WHERE kind IN ('calls', 'references') GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src) AS n FROM i),
 h1 AS (SELECT src AS node, max(confidence) AS c FROM k WHERE n <= 256 AND dst IN ('p1', 'p2', 'p3') GROUP BY 1), h2 AS (SELECT src AS node, max(confidence) AS c FROM k JOIN h1 ON k.dst = h1.node WHERE n <= 256 GROUP BY 1)
 SELECT node, CAST(h AS BIGINT) AS hops, c AS confidence FROM (SELECT node, h, c, row_number() OVER (PARTITION BY node ORDER BY h, c DESC) AS n FROM (SELECT node, 1 AS h, c FROM h1 UNION ALL SELECT node, 2, c FROM h2)) WHERE n = 1 AND node NOT IN ('p1', 'p2', 'p3')""")
def impact(spark, sf):
    start = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "node string")
    return graphs.impact(graph_of(spark, sf), start, ["calls", "references"])


@query(f"""WITH {_EDGES}, r AS (SELECT src, kind, confidence, row_number() OVER (ORDER BY confidence DESC, src, kind) AS n, count(*) OVER () > 20 AS truncated FROM e WHERE dst = 'p1' AND kind IN ('references', 'calls')) SELECT src, kind, confidence, truncated FROM r WHERE n <= 20""")
def references(spark, sf):
    return graphs.references(graph_of(spark, sf), "p1", ["references", "calls"], 20)


@query(f"""WITH {_ENT}, {_REL}, o AS (SELECT DISTINCT src AS c, dst AS x, CASE kind WHEN 'references' THEN 'members' WHEN 'imports' THEN 'dependencies' END AS role FROM rel UNION SELECT DISTINCT dst, src, CASE kind WHEN 'imports' THEN 'dependents' WHEN 'calls' THEN 'dependents' WHEN 'tests' THEN 'tests' END FROM rel)
 SELECT c AS component, array_to_string(list_sort(list(x) FILTER (role = 'members')), ',') AS members, coalesce(array_to_string(list_sort(list(x) FILTER (role = 'dependencies')), ','), '') AS dependencies, coalesce(array_to_string(list_sort(list(x) FILTER (role = 'dependents')), ','), '') AS dependents,
 coalesce(array_to_string(list_sort(list(x) FILTER (role = 'tests')), ','), '') AS tests FROM o GROUP BY c HAVING count(*) FILTER (role = 'members') > 0""")
def explain(spark, sf):
    rows = relations(spark, sf).withColumn("kind", F.when(F.col("kind") == "references", "contains").otherwise(F.col("kind")))
    got = graphs.components_explained(rows)
    return got.select("component", *[F.array_join(c, ",").alias(c) for c in ("members", "dependencies", "dependents", "tests")])


@query("""WITH d AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey )
 SELECT n_nationkey AS package, coalesce((SELECT string_agg(b, ',' ORDER BY b) FROM d WHERE a = n_nationkey), '') AS dependencies, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM d WHERE b = n_nationkey), '') AS dependents,
 (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS member_files FROM nation""")
def codebase_map(spark, sf):
    o, l = load(spark, sf, "orders").select("o_orderkey", "o_custkey"), load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    c, s = load(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("package")), load(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("other"))
    depends = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey).select("package", "other")
    got = graphs.package_map(load(spark, sf, "nation").select(F.col("n_nationkey").alias("package")), depends, c)
    return got.select("package", F.array_join("dependencies", ",").alias("dependencies"), F.array_join("dependents", ",").alias("dependents"), "member_files")


@query(f"""WITH {_EDGES}, {_walked("'p1', 'p2'", "SELECT dst AS pos, src AS to_, kind, confidence FROM e", "'calls', 'references', 'tests', 'implements'")}""")
def expand_incoming(spark, sf):
    seeds = spark.createDataFrame([("p1", 1.0), ("p2", 1.0)], "node string, score double")
    return graphs.expand_by("incoming", graph_of(spark, sf), seeds)


@query(f"""WITH {_ENT}, {_REL}, h AS (SELECT o_custkey AS q, 'e' || o_orderkey % 200 AS entity, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey % 4 > 0 AS placed FROM orders),
 s AS (SELECT q, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM h WHERE placed) WHERE n <= 8 AND entity IN (SELECT id FROM ent WHERE kind IN ('function', 'method'))),
 o AS (SELECT *, CASE kind WHEN 'tests' THEN 2 WHEN 'calls' THEN 1 ELSE 0 END AS p FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, id) AS k FROM rel) WHERE k <= 16 AND kind IN ('tests', 'calls', 'references')),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY confidence DESC, p DESC) AS z FROM o) WHERE z = 1),
 j AS (SELECT q, n, src, dst, kind, confidence, p FROM s JOIN b ON entity = src WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.q = s.q AND h.entity = dst)),
 one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, src ORDER BY confidence DESC, p DESC, dst, n) AS z FROM j) WHERE z = 1),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, dst ORDER BY n) AS y FROM one) WHERE y = 1)
 SELECT * FROM (SELECT q AS query_id, src AS source, dst AS target, kind, confidence, row_number() OVER (PARTITION BY q ORDER BY n) AS place FROM t) WHERE place <= 4""")
def backlinks(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    hits = load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("e"), (k % 200).cast("string")).alias("entity_id"), rank.alias("rank"), F.when(k % 4 > 0, "p").alias("path"))
    return graphs.backlinks(hits, entities(spark, sf).select("id", "kind"), relations(spark, sf))


@query(f"""WITH {_EDGES}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind) AS n FROM e) WHERE n <= 24),
 a AS (SELECT dst AS node, confidence AS s, src || ' -' || kind || '-> ' || dst AS path FROM t WHERE src IN ('n3', 'c5')),
 m AS (SELECT node, s, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY s DESC, path) AS n FROM a) WHERE n = 1 ORDER BY s DESC, path, node LIMIT 64),
 z AS (SELECT node, s, path FROM a UNION ALL SELECT dst, m.s * confidence, path || ' -' || kind || '-> ' || dst FROM m JOIN t ON t.src = m.node)
 SELECT node, path, round(s, 9) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(s, 9) DESC, path) AS n FROM z WHERE node NOT IN ('n3', 'c5')) WHERE n = 1""")
def evidence_paths(spark, sf):
    return graphs.evidence_paths(graph_of(spark, sf), spark.createDataFrame([("n3",), ("c5",)], "node string"))


@query(f"WITH {_EDGES} SELECT * FROM (SELECT src AS at, dst AS to, kind, confidence FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst, kind) AS n FROM e) WHERE src IN ('c1', 'o5', 'n2') AND n <= 5)")
def neighbours(spark, sf):
    return graphs.neighbours(graph_of(spark, sf), ["c1", "o5", "n2"], "outgoing", 5)


@query(f"""WITH {_ENT}, p AS (SELECT id, string_split(path, '/') AS w FROM ent), x AS (SELECT DISTINCT '/' || array_to_string(w[1:i - 1], '/') AS src, '/' || array_to_string(w[1:i], '/') AS dst FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM p))
 SELECT * FROM x UNION ALL SELECT '/' || path, id FROM ent""")
def containment_edges(spark, sf):
    e = entities(spark, sf)
    return graphs.containment(e.select("path"), e.select("path", F.col("id").alias("unit")))


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS package, c_custkey % 40 AS name FROM customer) SELECT package, name AS other FROM n WHERE name IN (SELECT n_nationkey FROM nation) AND name <> package""")
def package_dependencies(spark, sf):
    needs = load(spark, sf, "customer").select(F.col("c_nationkey").alias("package"), (F.col("c_custkey") % 40).alias("name"))
    return graphs.build_edges(load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("package")), needs)


@query("""SELECT r_name AS package, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS members, CAST(count(c_custkey) AS BIGINT) AS files
 FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def package_map(spark, sf):
    r, n, c = load(spark, sf, "region"), load(spark, sf, "nation"), load(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("files"))
    rows = r.join(n, r.r_regionkey == n.n_regionkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left")
    return rows.groupBy(F.col("r_name").alias("package")).agg(F.countDistinct("n_nationkey").alias("members"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


@query("""WITH x AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
 SELECT CAST(a AS BIGINT) AS package, CAST(b AS BIGINT) AS other, CAST(count(*) AS BIGINT) AS edges FROM x WHERE a <> b AND (a + b) % 3 <> 0 GROUP BY 1, 2""")
def boundary_violations(spark, sf):
    return graphs.boundary_violations(*_packages(spark, sf))


@query("""WITH x AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b, 'c' || c_custkey AS src, 's' || s_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
 SELECT CAST(a AS BIGINT) AS package, CAST(b AS BIGINT) AS other, src, dst FROM x WHERE a <> b AND (a + b) % 3 <> 0 ORDER BY a, b, src, dst LIMIT 256""")
def violation_list(spark, sf):
    return graphs.violation_list(*_packages(spark, sf))


def _packages(spark, sf):
    """Order lines as edges, owned by the nations at both ends, and what these declare."""
    o, l = load(spark, sf, "orders").select("o_orderkey", "o_custkey"), load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    lines = l.join(o, l.l_orderkey == o.o_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    c = load(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("package"))
    s = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.col("s_nationkey").cast("long").alias("package"))
    n = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("package"))
    declared = n.join(n.withColumnRenamed("package", "other"), (F.col("package") + F.col("other")) % 3 == 0)  # 25 nations
    return lines, union(c, s), declared


@query("""WITH z AS (SELECT DISTINCT l_orderkey AS "commit", l_partkey AS path FROM lineitem), c AS (SELECT * FROM z WHERE "commit" IN (SELECT "commit" FROM z GROUP BY 1 HAVING count(*) <= 512)), a AS (SELECT path, count(*) AS n FROM c GROUP BY path),
 p AS (SELECT x.path AS a, y.path AS b, count(*) AS support FROM c x JOIN c y ON x."commit" = y."commit" AND x.path < y.path GROUP BY 1, 2),
 q AS (SELECT p.a, p.b, support, round(least(0.7::DOUBLE, support::DOUBLE / greatest(u.n, v.n)), 9) AS confidence FROM p JOIN a u ON p.a = u.path JOIN a v ON p.b = v.path),
 r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY support DESC, confidence DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY support DESC, confidence DESC, a) AS rb FROM q)
 SELECT a, b, CAST(support AS BIGINT) AS support, confidence FROM r WHERE ra <= 8 OR rb <= 8""")
def cochange(spark, sf):
    l = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"))
    return graphs.co_change(l)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 1000 = 0 OR c_custkey < 2 THEN NULL ELSE c_custkey - 1 END AS parent FROM customer),
 r AS (SELECT node, node AS root FROM p WHERE parent IS NULL UNION ALL SELECT p.node, r.root FROM p JOIN r ON p.parent = r.node) SELECT node, root FROM r""")
def lineage_roots(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    parent = F.when((F.col("node") % 1000 == 0) | (F.col("node") < 2), None).otherwise(F.col("node") - 1)
    return graphs.lineage_roots(c.withColumn("parent", parent))
