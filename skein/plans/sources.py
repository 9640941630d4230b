"""Sources: ignore rules over paths made of parts, with an ignore file for each region."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.sources import wire
from skein.sources.ignore import ignored, rules_of
from skein.sources.tables import load

from .lookups import pick
from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""WITH p AS (SELECT p_partkey % 5 AS d, p_partkey % 7 AS e, replace(p_name, ' ', '_') AS n, CASE p_partkey % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'txt' ELSE 'rs' END AS x FROM part),
 q AS (SELECT DISTINCT 'd' || d || '/e' || e || '/' || n || '.' || x AS path, d, e, n, x FROM p)
 SELECT path, "by" IS NOT NULL AS ignored, "by" FROM (SELECT path, CASE WHEN e = d OR d = 3 AND e = 1 THEN 'd' || d || '/e' || e WHEN x = 'log' AND n NOT LIKE 'a%' THEN path END AS "by" FROM q)""")
def ignored_paths(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("d"), (k % 5).cast("string"), F.lit("/e"), (k % 7).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), pick(k % 3, "log", "txt", "rs"))
    r = load(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("r"))
    files = r.select(F.concat(F.lit("d"), "r", F.lit("/.gitignore")).alias("path"), F.concat(F.lit("# own\n!a*.log\ne"), "r", F.lit("/\n")).alias("text"))
    top = r.where("r = '0'").select(F.lit(".gitignore").alias("path"), F.lit("*.log\n/d3/e1/\n").alias("text"))
    return ignored(load(spark, sf, "part").select(name.alias("path")), rules_of(files.unionByName(top)))


def _byte(x):
    """A number below 128 as one byte."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))


def _length(number: int, data):
    """A field of a length below 128."""
    return F.concat(_byte(F.lit(number * 8 + 2)), _byte(F.octet_length(data)), data)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS utf16 FROM orders)
 SELECT k AS index_id, CASE WHEN k % 11 > 0 THEN 'src/' || k END AS path, CASE WHEN k % 11 > 0 THEN 's' || k % 40 END AS symbol, CASE WHEN k % 11 > 0 THEN k % 4 = 0 END AS is_definition,
  CASE WHEN k % 11 > 0 THEN k % 100 END AS line, CASE WHEN k % 11 > 0 THEN k % 7 END AS "column", CASE WHEN k % 11 > 0 THEN k % 100 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END END AS last_line, CASE WHEN k % 11 > 0 THEN k % 7 + 5 END AS last_column, k % 11 = 0 AS broken FROM o""")
def decoded_occurrences(spark, sf):
    """An index for each order, of one document with one occurrence; every eleventh is cut off."""
    k = F.col("o_orderkey")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x]).cast("binary")
    place = F.when(k % 2 == 0, F.concat(_byte(k % 100), _byte(k % 7), _byte(k % 100 + 1), _byte(k % 7 + 5))).otherwise(F.concat(_byte(k % 100), _byte(k % 7), _byte(k % 7 + 5)))
    role = F.concat(_byte(F.lit(3 * 8)), _byte(F.when(k % 4 == 0, 1).otherwise(8)))
    one = F.concat(_length(1, place), _length(2, text("s", k % 40)), role)
    document = F.concat(_length(1, text("src/", k)), _length(2, one), _length(4, text("rust")))
    index = F.concat(_length(1, F.concat(_byte(F.lit(4 * 8)), _byte(F.when(k % 3 == 0, 2).otherwise(1)))), _length(2, document))
    index = F.when(k % 11 == 0, F.substring(index, F.lit(1), F.octet_length(index) - 3)).otherwise(index)
    found = wire.occurrences(wire.index_documents(load(spark, sf, "orders").select(k.alias("index_id"), index.alias("data"))))
    return found.select("index_id", "path", "symbol", "is_definition", "line", "column", "last_line", "last_column", F.col("error").isNotNull().alias("broken"))
