"""Source files made of parts: file ``k`` holds one class with one method for each part whose key leaves ``k``."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import code as C
from skein.operators import joins
from skein.sources.tables import load
from skein.workspace import union

from .lookups import pick
from .registry import registry

QUERIES, ORACLES, query = registry()

_U = """u AS (SELECT p_partkey AS k, 'src/f' || p_partkey % 50 || '.py' AS path, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS i, replace(p_name, ' ', '_') AS name, lower(p_type) AS callee FROM part)"""


def _files(spark, sf):
    """Each class has four lines: a comment, the class, a method and its body."""
    p, k = load(spark, sf, "part"), F.col("p_partkey").cast("string")
    lines = F.concat(F.lit("# part "), k, F.lit("\nclass C"), k, F.lit(":\n    def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(self):\n        return "), F.lower("p_type"), F.lit("(self.x())\n"))
    files = p.groupBy(F.concat(F.lit("src/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", lines.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return files.withColumn("language", F.lit("python"))


@query(f"WITH {_U} SELECT path, CAST(2 * i AS INT) AS unit, 'C' || k AS name, 'class' AS kind, CAST(4 * i + 2 AS INT) AS start_line, CAST(4 * i + 4 AS INT) AS end_line, CAST(NULL AS INT) AS parent FROM u UNION ALL SELECT path, CAST(2 * i + 1 AS INT), name, 'method', CAST(4 * i + 3 AS INT), CAST(4 * i + 4 AS INT), CAST(2 * i AS INT) FROM u")
def parsed_units(spark, sf):
    return C.units(_files(spark, sf)).drop("signature")


@query(f"WITH {_U} SELECT path, CAST(2 * i + 1 AS INT) AS caller, callee AS name, CAST(4 * i + 4 AS INT) AS line FROM u UNION ALL SELECT path, CAST(2 * i + 1 AS INT), 'x', CAST(4 * i + 4 AS INT) FROM u")
def parsed_calls(spark, sf):
    return C.calls(_files(spark, sf))


@query(f"WITH {_U} SELECT path, CAST(2 * i AS INT) AS unit, path || '::C' || k AS qualified FROM u UNION ALL SELECT path, CAST(2 * i + 1 AS INT), path || '::C' || k || '::' || name FROM u")
def qualified_names(spark, sf):
    return C.qualified_names(C.units(_files(spark, sf)))


@query(f"WITH {_U} SELECT path, CAST(2 * i AS INT) AS unit, 'part ' || k AS doc FROM u UNION ALL SELECT path, CAST(2 * i + 1 AS INT), NULL FROM u")
def doc_comments(spark, sf):
    files = _files(spark, sf)
    return C.doc_comments(C.units(files), files)


@query(f"""WITH {_U} SELECT path, left(path || ' (python)' || chr(10) || chr(10) || string_agg('# part ' || k, chr(10) ORDER BY i) FILTER (i < 6) || chr(10) || chr(10) || string_agg('class C' || k || ':', chr(10) ORDER BY i) FILTER (i < 24), 2048) AS descriptor FROM u GROUP BY path""")
def file_descriptors(spark, sf):
    files = _files(spark, sf)
    return C.file_descriptors(files, C.units(files))


@query(f"""WITH {_U} SELECT path, CAST(2 * i + 1 AS INT) AS unit, 'method ' || path || '::C' || k || '::' || name || ' in ' || path || ' (' || array_to_string(list_sort(list_distinct(string_split(name, '_'))), ' ') || ') — def ' || name || '(self):' || chr(10) || 'calls: ' || CASE WHEN callee < 'x' THEN callee || ', x' ELSE 'x, ' || callee END AS descriptor FROM u
 UNION ALL SELECT path, CAST(2 * i AS INT), 'class ' || path || '::C' || k || ' in ' || path || ' — class C' || k || ':' FROM u""")
def symbol_descriptors(spark, sf):
    files = _files(spark, sf)
    parsed = C.units(files)
    return C.symbol_descriptors(parsed, C.qualified_names(parsed), C.calls(files))


_SPEC = """s AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'typescript' END AS language, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"""


def _sources(spark, sf):
    k, p = F.col("p_partkey"), load(spark, sf, "part")
    w = F.split("p_name", " ")
    text = F.when(k % 3 == 0, F.concat(F.lit("import os\nfrom "), w[0], F.lit("."), w[1], F.lit(" import z\n"))).when(k % 3 == 1, F.concat(F.lit("pub use crate::"), w[0], F.lit("::"), w[1], F.lit("::Z;\n"))).otherwise(F.concat(F.lit("import z from './"), w[0], F.lit("'\nconst y = require(\""), w[1], F.lit("\")\n")))
    return p.select(F.concat(F.lit("src/m"), k.cast("string")).alias("path"), pick(k % 3, "python", "rust", "typescript").alias("language"), text.alias("text"))


@query(f"""WITH {_SPEC} SELECT 'src/m' || k AS path, language, unnest(CASE language WHEN 'python' THEN ['os', a || '.' || b] WHEN 'rust' THEN ['crate::' || a || '::' || b || '::Z'] ELSE ['./' || a, b] END) AS specifier FROM s""")
def import_specifiers(spark, sf):
    return C.imports(_sources(spark, sf))


@query(f"""WITH {_SPEC} SELECT 'src/m' || k AS path, './' || a AS specifier, 'src/' || a || '.ts' AS target FROM s WHERE language = 'typescript' AND a IN ('red', 'blue') UNION ALL SELECT 'src/m' || k, a || '.' || b, a || '/__init__.py' FROM s WHERE language = 'python' AND a = 'hot'
 UNION ALL SELECT 'src/m' || k, a || '.' || b, a || '/' || b || '.py' FROM s WHERE language = 'python' AND a = 'new' AND b = 'gear' UNION ALL SELECT 'src/m' || k, 'crate::' || a || '::' || b || '::Z', 'src/' || a || '/' || b || '/mod.rs' FROM s WHERE language = 'rust' AND b = 'bolt' AND a IN ('red', 'old')""")
def resolved_imports(spark, sf):
    files = ("src/red.ts", "src/red/index.ts", "src/blue.ts", "hot/__init__.py", "new/gear.py", "src/red/bolt/mod.rs", "src/old/bolt/mod.rs", "src/red/other.rs")
    known = spark.createDataFrame([(f,) for f in files], "path string")
    return C.resolved_imports(C.import_candidates(C.imports(_sources(spark, sf))), known)


@query("SELECT 'f' || p_partkey AS path, unnest(['/' || p_partkey, '/all']) AS route, unnest(['GET', 'POST']) AS method, unnest([replace(p_name, ' ', '_'), 'list']) AS handler FROM part")
def http_routes(spark, sf):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('app.route("/'), k, F.lit('", get(api::'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(')).route( "/all", axum::post(list) )'))
    return C.routes(load(spark, sf, "part").select(F.concat(F.lit("f"), k).alias("path"), text.alias("text")))


_CALLS = """c AS (SELECT o_orderkey AS call_id, o_custkey % 25 AS name, o_custkey % 7 AS path FROM orders), t AS (SELECT c_custkey AS target_id, CAST(c_nationkey AS BIGINT) AS name, c_custkey % 7 AS path, CASE c_custkey % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'method' ELSE 'enum' END AS kind FROM customer)"""


def _calls(spark, sf):
    call = load(spark, sf, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_custkey") % 25).alias("name"), (F.col("o_custkey") % 7).alias("path"))
    k = F.col("c_custkey")
    target = load(spark, sf, "customer").select(k.alias("target_id"), F.col("c_nationkey").cast("long").alias("name"), (k % 7).alias("there"), pick(k % 4, "function", "struct", "method", "enum").alias("kind"))
    return call, target


@query(f"WITH {_CALLS} SELECT call_id, arg_min(target_id, target_id) AS target_id, count(*) AS candidates, CASE WHEN count(*) > 1 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT c.*, target_id, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN c.path = t.path THEN 0 ELSE 1 END, target_id) AS n, t.path AS tp FROM c JOIN t ON c.name = t.name WHERE kind IN ('struct', 'enum')) GROUP BY call_id".replace("arg_min(target_id, target_id)", "arg_min(target_id, n)"))
def type_references(spark, sf):
    """Of types of the name the one in the same file, else the first."""
    call, target = _calls(spark, sf)
    return joins.resolve(call, target.where(F.col("kind").isin(*C.TYPES)), lambda here: F.when(here, 0).otherwise(1))


@query(f"WITH {_CALLS} SELECT call_id, arg_min(target_id, n) AS target_id, count(*) AS candidates, CASE WHEN count(*) > 1 THEN 0.45 ELSE 0.9 END::DOUBLE AS confidence FROM (SELECT c.call_id, target_id, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN kind IN ('function', 'method') AND c.path = t.path THEN 0 WHEN kind IN ('function', 'method') THEN 1 WHEN c.path = t.path THEN 2 ELSE 3 END, target_id) AS n FROM c JOIN t ON c.name = t.name) GROUP BY call_id")
def route_handlers(spark, sf):
    """A callable of the same file, any callable, anything of the same file, anything."""
    call, target = _calls(spark, sf)
    can = F.col("kind").isin(*C.CALLABLE)
    return joins.resolve(call, target, lambda here: F.when(can & here, 0).when(can, 1).when(here, 2).otherwise(3))


@query("SELECT 'm' || p_partkey AS path, 'p' || p_partkey AS package, unnest(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'common'])) AS name FROM part")
def npm_dependencies(spark, sf):
    k, w = F.col("p_partkey").cast("string"), F.split("p_name", " ")
    text = F.concat(F.lit('{"name": "p'), k, F.lit('", "dependencies": {"'), w[0], F.lit('": "1", "common": {"v": 2}}, "devDependencies": {"'), w[1], F.lit('": "*", "common": "3"}}'))
    return C.npm_packages(load(spark, sf, "part").select(F.concat(F.lit("m"), k).alias("path"), text.alias("text")))


@query("SELECT 'm' || p_partkey AS path, 'p' || p_partkey AS package, unnest(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), 'x-y'])) AS name FROM part")
def cargo_dependencies(spark, sf):
    k, w = F.col("p_partkey").cast("string"), F.split("p_name", " ")
    text = F.concat(F.lit('[package]\nname = "p'), k, F.lit('"\nversion = "1"\n\n[dependencies]\n'), w[0], F.lit(' = "1"\nx-y.workspace = true\n[dev-dependencies.'), w[1], F.lit(']\npath = "../z"\n[profile.release]\nlto = true\n'))
    return C.cargo_packages(load(spark, sf, "part").select(F.concat(F.lit("m"), k).alias("path"), text.alias("text")))


@query("""WITH e AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 5 = 0), h AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS name FROM part WHERE p_partkey % 31 = 1), t AS (SELECT * FROM e UNION ALL SELECT * FROM h),
 q AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, split_part(p_name, ' ', 1) AS head FROM part WHERE p_partkey % 5 = 2),
 j AS (SELECT q.id AS test_id, t.id AS target_id, 0 AS cut FROM q JOIN t ON q.name = t.name WHERE q.id <> t.id UNION ALL SELECT q.id, t.id, 1 FROM q JOIN t ON q.head = t.name WHERE q.id <> t.id)
 SELECT test_id, target_id, CASE cut WHEN 0 THEN 0.65 ELSE 0.55 END::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY cut, target_id) AS n FROM j) WHERE n = 1""")
def test_pairs(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    targets = p.where("id % 5 = 0").unionByName(p.where("id % 31 = 1").select("id", F.split("name", "_")[0].alias("name")))
    return C.test_pairs(p.where("id % 5 = 2").select("id", F.concat(F.lit("test_"), "name").alias("name")), targets)


@query("""SELECT 'tests/' || p_partkey % 9 || '/test_' || replace(p_name, ' ', '') || '.py' AS path, min('src/' || q % 7 || '/' || replace(p_name, ' ', '') || '.py') AS target, 0.7::DOUBLE AS confidence FROM (SELECT DISTINCT p_partkey % 9 AS p_partkey, p_name FROM part WHERE p_size % 2 = 0) JOIN (SELECT p_partkey AS q, p_name AS m FROM part WHERE p_size % 5 = 1) ON p_name = m GROUP BY 1""")
def test_files(spark, sf):
    k, name = F.col("p_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".py"))
    p = load(spark, sf, "part")
    tests = p.where("p_size % 2 = 0").select(F.concat(F.lit("tests/"), (k % 9).cast("string"), F.lit("/test_"), name).alias("path"))
    return C.test_files(union(tests, p.where("p_size % 5 = 1").select(F.concat(F.lit("src/"), (k % 7).cast("string"), F.lit("/"), name).alias("path"))).distinct())


_REGIONS = "r AS (SELECT p_partkey AS region_id, p_partkey % 50 AS path, p_partkey * 3 % 400 AS s, p_partkey * 3 % 400 + p_size * 4 AS e FROM part), l AS (SELECT DISTINCT o_custkey % 60 AS path, o_orderkey % 450 AS line FROM orders)"
_PLACED = "pl AS (SELECT * FROM (SELECT path, region_id, row_number() OVER (PARTITION BY path ORDER BY e - s, region_id) AS place FROM r WHERE EXISTS (SELECT 1 FROM l WHERE l.path = r.path AND s <= line AND line <= e)) WHERE place <= 4)"


def _placed(spark, sf):
    k, o = F.col("p_partkey"), load(spark, sf, "orders")
    regions = load(spark, sf, "part").select(k.alias("region_id"), (k % 50).alias("path"), (k * 3 % 400).alias("start_line"), (k * 3 % 400 + F.col("p_size") * 4).alias("end_line"))
    return C.regions_of_lines(o.select((F.col("o_custkey") % 60).alias("path"), (F.col("o_orderkey") % 450).alias("line")), regions).select("path", "region_id", "place")


@query(f"WITH {_REGIONS}, {_PLACED} SELECT path, region_id, place FROM pl")
def regions_of_lines(spark, sf):
    return _placed(spark, sf)


@query(f"""WITH {_REGIONS}, {_PLACED}, f AS (SELECT DISTINCT path, path + 1 AS rank FROM l), d AS (SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 > 0 THEN p_partkey END AS region_id, p_partkey % 50 AS path, p_partkey % 4 = 0 AS whole FROM part)
 SELECT doc_id, min(rank) AS rank FROM (SELECT doc_id, rank FROM f JOIN pl USING (path) JOIN d USING (region_id) UNION ALL SELECT doc_id, rank FROM f JOIN d ON f.path = d.path AND whole) GROUP BY doc_id""")
def trigram_candidates_of_files(spark, sf):
    k = F.col("p_partkey")
    docs = load(spark, sf, "part").select(k.alias("doc_id"), F.when(k % 4 > 0, k).alias("region_id"), (k % 50).alias("path"), F.when(k % 4 == 0, "file_descriptor").otherwise("chunk").alias("representation"))
    placed = _placed(spark, sf)
    o = load(spark, sf, "orders").select((F.col("o_custkey") % 60).alias("path")).distinct()
    return C.candidates_of_files(o.select("path", (F.col("path") + 1).alias("rank")), placed, docs)


@query("""SELECT p_partkey, array_to_string([p_name, replace(p_name, ' ', '_'), 'a::b', 'fooBar', 'x.rs'], '|') AS anchors FROM part""")
def literal_anchors(spark, sf):
    text = F.concat(F.lit("where is `"), "p_name", F.lit("` and "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(", a::b, a::b fooBar(x.rs)"))
    return load(spark, sf, "part").select("p_partkey", F.array_join(C.anchors(text), "|").alias("anchors"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ')))[1:128], ' ') AS terms FROM part""")
def lexical_terms(spark, sf):
    """Identifier terms, cut to a number."""
    return load(spark, sf, "part").select("p_partkey", F.array_join(F.slice(T.identifier_terms(F.col("p_name")), 1, 128), " ").alias("terms"))
