"""Text, trigram, vector and fused retrieval over ``documents``, ``part`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors
from skein.operators import evidence, glossary, lexical, ranking
from skein.operators.index import TextIndex
from skein.sources.tables import load
from skein.workspace import union

from .registry import registry

QUERIES, ORACLES, query = registry()

#: The query of the fixed plans; its words occur in the synthetic texts, "ouè" only with its accent.
TERMS = ["thing", "thion", "the", "ering", "oue"]
_LIST = "['thing', 'thion', 'the', 'ering', 'oue']"
#: Words of one text, and of all fields of documents, cut and folded without the engine's own tables.
_CUT = "list_filter(string_split_regex(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
_WORDS = f"""f AS (SELECT doc_id, 'path' AS field, 3.0::DOUBLE AS weight, {_CUT.format("source || '/' || doc_id")} AS w FROM documents
 UNION ALL SELECT doc_id, 'name', 5.0, {_CUT.format("string_split(text, chr(10))[1][1:80]")} FROM documents UNION ALL SELECT doc_id, 'terms', 2.0, {_CUT.format("lang")} FROM documents
 UNION ALL SELECT doc_id, 'body', 1.0, {_CUT.format("text")} FROM documents),
 sizes AS (SELECT doc_id, coalesce(sum(len(w)), 0) AS dl FROM f GROUP BY doc_id), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes),
 t AS MATERIALIZED (SELECT doc_id, field, weight, unnest(w) AS token FROM f), u AS (SELECT DISTINCT doc_id, token FROM t),
 d AS (SELECT token, CAST(count(*) AS BIGINT) AS df FROM u GROUP BY token)"""
_IDF = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
_TF = "x * 2.2 / (x + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))"


def index(spark, sf) -> TextIndex:
    """The index of ``documents``: built when it is first asked for, opened after that."""
    d = load(spark, sf, "documents")
    name = F.substring(F.split("text", "\n", 2)[0], 1, 80)
    rows = d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), name.alias("name"), F.col("lang").alias("terms"), F.col("text").alias("body"), "source", T.estimated_tokens(F.col("text")).cast("long").alias("cost"))
    return TextIndex.of(spark, rows, f"{sf.rstrip('/')}/documents.parquet", keep=("source", "cost"))


@query(f"WITH {_WORDS} SELECT token, df FROM d")
def doc_frequency(spark, sf):
    return lexical.document_frequency(index(spark, sf))


@query(f"WITH {_WORDS} SELECT token, least(df, 25) AS df FROM d")
def capped_df(spark, sf):
    return lexical.document_frequency(index(spark, sf), 25)


@query(f"""WITH {_WORDS}, h AS (SELECT doc_id, token, sum(weight) AS x FROM t WHERE token IN (SELECT unnest({_LIST})) GROUP BY 1, 2)
 SELECT doc_id, round(sum({_IDF} * {_TF}), 6) AS score FROM h JOIN d USING (token) JOIN sizes USING (doc_id), tot GROUP BY doc_id""")
def bm25_scores(spark, sf):
    return lexical.bm25(index(spark, sf), TERMS).select("doc_id", F.round("score", 6).alias("score"))


def _cascade(terms: str, limit: int) -> str:
    """The stages of a query in Latin letters, each ranked by itself; {terms} is a list of three at least."""
    return f"""q AS (SELECT unnest({terms}) AS q, generate_subscripts({terms}, 1) AS i),
 m AS (SELECT doc_id, q, i, sum(weight) AS x, sum(weight) FILTER (token = q) AS e FROM t JOIN q ON starts_with(token, q) GROUP BY ALL),
 c AS (SELECT i, count(*) AS n1, count(e) AS n0 FROM m GROUP BY i),
 live AS (SELECT q, n1 FROM c JOIN q USING (i), tot WHERE len({terms}) <= 12 OR n1 <= greatest(n // 8, 200)),
 pairs AS (SELECT x.q AS a, y.q AS b FROM live x JOIN live y ON x.q < y.q ORDER BY x.n1 + y.n1, x.q, y.q LIMIT 150),
 g AS (SELECT doc_id, count(e) AS whole, count(*) AS begun, round(sum(greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * e * 2.2 / (e + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS s0,
  round(sum(greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * {_TF}), 9) AS s1 FROM m JOIN c USING (i) JOIN sizes USING (doc_id), tot GROUP BY doc_id),
 s AS (SELECT doc_id, 0 AS stage, s0 AS bm FROM g WHERE whole = len({terms}) UNION ALL SELECT doc_id, 1, s1 FROM g WHERE begun = len({terms}) UNION ALL SELECT doc_id, 2, s1 FROM g WHERE doc_id IN (SELECT v.doc_id FROM m v JOIN pairs ON v.q = pairs.a JOIN m w ON w.doc_id = v.doc_id AND w.q = pairs.b)),
 o AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY bm DESC, doc_id) AS place FROM s),
 k AS (SELECT doc_id, min(stage) AS stage, arg_min(place, stage) AS place FROM o WHERE place <= {limit} GROUP BY doc_id),
 b AS (SELECT *, (SELECT count(*) FROM k z WHERE z.stage < k.stage) AS before FROM k),
 hits AS (SELECT doc_id, CAST(stage AS BIGINT) AS stage, row_number() OVER (ORDER BY stage, place) AS rank FROM b WHERE before < {limit})"""


@query(f"WITH {_WORDS}, {_cascade(_LIST, 60)} SELECT doc_id, stage, rank, round(1.0::DOUBLE / (rank + 1), 9) AS score FROM hits")
def lexical_cascade(spark, sf):
    return lexical.cascade(index(spark, sf), TERMS, 60)


def _best(terms: str, k: int) -> str:
    return f"""WITH {_WORDS}, h AS (SELECT doc_id, token, sum(weight) AS x FROM t WHERE token IN (SELECT unnest({terms})) GROUP BY 1, 2)
 SELECT doc_id, round(sum({_IDF} * {_TF}), 9) AS score FROM h JOIN d USING (token) JOIN sizes USING (doc_id), tot GROUP BY doc_id ORDER BY sum({_IDF} * {_TF}) DESC, doc_id LIMIT {k}"""


@query(_best(_LIST, 20))
def best_hits(spark, sf):
    return lexical.best_hits(index(spark, sf), TERMS, 20)[0]


@query(f"""WITH {_WORDS} SELECT DISTINCT doc_id FROM f WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')""")
def phrase_match(spark, sf):
    return lexical.phrase(index(spark, sf), ["of", "the"])


@query(f"""WITH {_WORDS} SELECT DISTINCT source || '/' || doc_id AS path FROM f JOIN documents USING (doc_id) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' in the ') ORDER BY path LIMIT 50""")
def mention_paths(spark, sf):
    return lexical.mentions(index(spark, sf), "in::the", 50)


@query(f"""WITH {_WORDS} SELECT DISTINCT doc_id FROM u WHERE token = 'ering' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def documents_matching_term(spark, sf):
    """Which of given documents hold a term."""
    good = load(spark, sf, "labels").where("quality = 1").select("doc_id")
    return index(spark, sf).holding(["ering"]).select("doc_id").distinct().join(good, "doc_id", "left_semi")


@query(f"""WITH {_WORDS} SELECT doc_id, source FROM u JOIN documents USING (doc_id) WHERE token = 'the' AND source IN ('src1', 'src2') ORDER BY doc_id LIMIT 40""")
def class_documents_matching_term(spark, sf):
    """Documents of given classes that hold a term."""
    d = load(spark, sf, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id", "source")
    return d.join(index(spark, sf).holding(["the"]).select("doc_id").distinct(), "doc_id", "left_semi").orderBy("doc_id").limit(40)


@query(f"""WITH {_WORDS}, h AS (SELECT DISTINCT doc_id, token FROM u WHERE token IN ('ering', 'oue')) SELECT h.doc_id, token, lang, quality FROM h JOIN documents x ON h.doc_id = x.doc_id LEFT JOIN labels l ON h.doc_id = l.doc_id""")
def term_bindings(spark, sf):
    """Hits with their documents and, where there is one, their label."""
    hits = index(spark, sf).holding(["ering", "oue"]).select("doc_id", "token").distinct()
    return hits.join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").join(load(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


def _asked(spark, sf):
    """The first 24 content terms of each passage."""
    words = F.filter(F.array_distinct(T.tokens(F.col("text"))), lambda w: ~w.isin(*lexical.STOPWORDS))
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(words, 1, 24)).alias("token"))


_STOP = "[" + ", ".join(f"'{x}'" for x in lexical.STOPWORDS) + "]"
_ASKED = f"""a AS (SELECT item_id AS query_id, unnest(list_filter({_CUT.format("text")}, lambda x: NOT list_contains({_STOP}, x))) AS token, generate_subscripts(list_filter({_CUT.format("text")}, lambda x: NOT list_contains({_STOP}, x)), 1) AS i FROM benchmark),
 q AS (SELECT query_id, token FROM (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS n FROM a GROUP BY 1, 2) WHERE n <= 24)"""


@query(f"""WITH {_WORDS}, {_ASKED}, r AS (SELECT query_id, token, df, row_number() OVER (PARTITION BY query_id ORDER BY df, token) AS place FROM q JOIN d USING (token), tot WHERE df <= greatest(n // 200, 32))
 SELECT * FROM r WHERE place <= 4""")
def rare_terms(spark, sf):
    return lexical.rare_terms(index(spark, sf), _asked(spark, sf))


@query(f"""WITH {_WORDS}, {_ASKED}, c AS (SELECT query_id, token, df FROM q JOIN d USING (token)),
 p AS (SELECT x.query_id, x.token AS a, y.token AS b, x.df + y.df AS cost FROM c x JOIN c y ON x.query_id = y.query_id AND x.token < y.token)
 SELECT query_id, a, b, cost FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, a, b) AS n FROM p) WHERE n <= 150""")
def floor_pairs(spark, sf):
    i, asked = index(spark, sf), _asked(spark, sf)
    return lexical.floor_pairs(asked.join(i.frequencies(asked), "token"))


@query(f"""WITH {_WORDS} SELECT doc_id, source || '/' || doc_id AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM u WHERE token IN ('the', 'of', 'ering') GROUP BY doc_id HAVING count(*) = 3)""")
def term_intersection(spark, sf):
    return lexical.binding(index(spark, sf), ["the", "of", "ering"])


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), 'widget')""")
def trigram_candidates(spark, sf):
    return lexical.trigram_search(load(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "Widget")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
 m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place FROM l WHERE regexp_matches(raw, '[0-9a-f]{8}'))
 SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(length(string_split_regex(raw, '[0-9a-f]{8}')[1]) + 1 AS BIGINT) AS col, CASE WHEN length(trim(raw)) > 240 THEN substr(trim(raw), 1, 240) || '…' ELSE trim(raw) END AS text
 FROM m WHERE place <= 100 ORDER BY doc_id, line LIMIT 200""")
def grep_lines(spark, sf):
    return lexical.grep(load(spark, sf, "documents"), "[0-9a-f]{8}")


@query(f"""WITH w AS (SELECT DISTINCT doc_id, unnest({_CUT.format("text")}) AS token FROM documents WHERE doc_id IN (1, 2, 3, 4, 6))
 SELECT token, CAST(count(*) AS BIGINT) AS df FROM w WHERE length(token) >= 3 AND regexp_matches(token, '\\p{{L}}') AND NOT list_contains({_STOP}, token) AND NOT list_contains({_LIST}, token)
 GROUP BY token ORDER BY df DESC, token LIMIT 8""")
def feedback_terms(spark, sf):
    seeds = load(spark, sf, "documents").where(F.col("doc_id").isin(1, 2, 3, 4, 6))
    return lexical.feedback_terms(None, seeds.select("doc_id", "text"), TERMS)


_DOT = "round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6)"
_DENSE = f"SELECT q.vec_id AS query_id, e.vec_id AS vec_id, {_DOT} AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0"


#: Fixed value: the vectors whose id it divides are the queries of vector searches.
EVERY = 50


def _dense(spark, sf, k):
    """(query_id, vec_id, score) with all of the best ``k`` of each query."""
    found = vectors.best_in_blocks(load(spark, sf, "embeddings"), EVERY, k)
    return found.withColumn("score", F.round("score", 6))


@query(f"SELECT query_id, vec_id, score, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ({_DENSE})) WHERE place <= 10")
def dense_topk(spark, sf):
    return ranking.top_per_key(_dense(spark, sf, 10), "query_id", [F.desc("score"), F.col("vec_id")], 10)


@query(f"""WITH a AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({_DENSE})),
 b AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(e.vec_id - q.vec_id), e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
 u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM a WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 2.0::DOUBLE / (60 + rank) FROM b WHERE rank <= 30),
 f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM u GROUP BY 1, 2)
 SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM f""")
def rrf_fusion(spark, sf):
    dense = _dense(spark, sf, 30)
    near = vectors.best_in_blocks(load(spark, sf, "embeddings"), EVERY, 30, near=True)
    routes = None
    for name, weight, rows in (("dense", 1.0, dense), ("near", 2.0, near)):
        top = ranking.top_per_key(rows, "query_id", [F.desc("score"), F.col("vec_id")], 30)
        one = top.select("query_id", F.lit(name).alias("route"), F.lit(weight).alias("weight"), F.col("vec_id").alias("doc_id"), F.col("place").alias("rank"))
        routes = one if routes is None else union(routes, one)
    return ranking.reciprocal_rank_fusion(routes).drop("routes")


_HITS = """h AS (SELECT o_custkey AS query_id, o_orderkey % 40 AS doc_id, o_orderkey AS n, 1.0::DOUBLE / (60 + o_orderkey % 30) AS contribution, o_orderkey % 9 = 0 AS strict,
  CASE o_orderkey % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'dense' ELSE 'exact' END AS route, repeat('x', CAST(o_orderkey % 7 AS INT)) || o_orderkey % 4 AS snippet, 'f' || o_orderkey AS address FROM orders)"""


def _hits(spark, sf):
    k = F.col("o_orderkey")
    route = F.when(k % 3 == 0, "lexical").when(k % 3 == 1, "dense").otherwise("exact")
    snippet = F.concat(F.expr("repeat('x', CAST(o_orderkey % 7 AS INT))"), (k % 4).cast("string"))
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), (k % 40).alias("doc_id"), k.alias("n"), (1.0 / (60 + k % 30)).alias("contribution"), (k % 9 == 0).alias("strict"), route.alias("route"), snippet.alias("snippet"), F.concat(F.lit("f"), k.cast("string")).alias("address"))


@query(f"""WITH {_HITS}, m AS (SELECT query_id, doc_id, round(sum(contribution), 12) AS score, bool_or(strict) AS strict, arg_min(address, n) AS address, arg_min(snippet, -length(snippet) * 100000000 + n) AS snippet FROM h GROUP BY 1, 2),
 r AS (SELECT query_id, doc_id, string_agg(route, ',' ORDER BY n) AS routes FROM (SELECT query_id, doc_id, route, min(n) AS n FROM h GROUP BY 1, 2, 3) GROUP BY 1, 2)
 SELECT m.query_id, m.doc_id, round(score, 9) AS score, strict, routes, snippet, address, CAST(row_number() OVER (PARTITION BY m.query_id ORDER BY CAST(floor((score + m.doc_id % 2 * 0.01) / 1e-9) AS BIGINT) DESC, m.doc_id % 3 * 0.5 DESC, m.doc_id % 4 DESC, m.doc_id) AS BIGINT) AS rank FROM m JOIN r USING (query_id, doc_id)""")
def merged_candidates(spark, sf):
    """Hits of three routes as one candidate per document, in fused order."""
    d = F.col("doc_id")
    merged = ranking.merge_candidates(_hits(spark, sf)).withColumns({"bonus": d % 2 * 0.01, "strength": d % 3 * 0.5, "origins": d % 4})
    return ranking.fused_order(merged).select("query_id", "doc_id", F.round("score", 9).alias("score"), "strict", F.array_join("routes", ",").alias("routes"), "snippet", "address", "rank")


@query("""WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS pattern FROM part UNION SELECT unnest(['the ', ' of', 'e t', 'zzzz'])) SELECT doc_id AS id, pattern, CAST(position(pattern IN text) - 1 AS BIGINT) AS first FROM documents, p WHERE pattern <> '' AND contains(text, pattern)""")
def pattern_hits(spark, sf):
    """Many words in all texts, in one pass."""
    words = load(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("pattern")).unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, ("the ", " of", "e t", "zzzz")))).alias("pattern")))
    return glossary.pattern_hits(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), words).drop("n")


_HASHED = """f AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents),
 t AS (SELECT doc_id, md5(unnest(w)) AS h FROM f),
 s AS (SELECT doc_id, CAST('0x' || h[1:8] AS BIGINT) % 64 AS slot, sum(CASE WHEN CAST('0x' || h[9:10] AS BIGINT) % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE) AS w FROM t GROUP BY 1, 2),
 n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM s GROUP BY 1)"""


@query(f"""WITH {_HASHED} SELECT documents.doc_id, list_transform(range(64), lambda i: round(coalesce(list_sum(list_transform(list_filter(v, lambda x: x.slot = i), lambda x: x.w)) / nullif(norm, 0), 0), 9)) AS vector
 FROM documents LEFT JOIN (SELECT s.doc_id, list({{'slot': slot, 'w': w}}) AS v, max(n) AS norm FROM s JOIN n ON s.doc_id = n.doc_id GROUP BY 1) x ON documents.doc_id = x.doc_id""")
def hash_embedding(spark, sf):
    words = load(spark, sf, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return vectors.hash_embedding(words, 64).select("doc_id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))


def _ranked_turns(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select("conv_id", (F.col("turn") + 1).alias("rank"), "turn", F.col("role"), T.estimated_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, CAST(floor((length(text) + length(text) - length(regexp_replace(text, '[{}\\[\\]();:,.<>/`]', '', 'g'))) / 4) + 1 AS BIGINT) AS cost FROM conversations),
 f AS (SELECT conv_id, n, turn, cost, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used, cost <= 600 AS good FROM t WHERE n = 1
 UNION ALL SELECT t.conv_id, t.n, t.turn, t.cost, CASE WHEN f.used + t.cost <= 600 THEN f.used + t.cost ELSE f.used END, f.used + t.cost <= 600 FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1)
 SELECT conv_id, turn, cost, CAST(max(used) OVER (PARTITION BY conv_id) AS BIGINT) AS used FROM f QUALIFY good""")
def pack_budget(spark, sf):
    return ranking.pack_budget(_ranked_turns(spark, sf), "conv_id", "turn", "cost", 600)


_CAPPED = """g AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents),
 c AS (SELECT lang, n, source, doc_id, [source] AS chosen, TRUE AS good FROM g WHERE n = 1 UNION ALL
  SELECT lang, n, source, doc_id, CASE WHEN good THEN list_append(chosen, source) ELSE chosen END, good FROM (SELECT g.lang, g.n, g.source, g.doc_id, c.chosen,
   len(c.chosen) < 20 AND len(list_filter(c.chosen, lambda x: x = g.source)) < CASE WHEN len(c.chosen) < 5 THEN 1 WHEN len(c.chosen) < 10 THEN 2 ELSE 3 END AS good FROM c JOIN g ON g.lang = c.lang AND g.n = c.n + 1))"""


@query(f"WITH RECURSIVE {_CAPPED} SELECT lang, source, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n) AS BIGINT) AS place FROM c WHERE good")
def per_file_cap(spark, sf):
    d = load(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return ranking.per_group_cap(d.withColumn("rank", rank), "lang", "source", "doc_id", 20)


@query(f"""WITH {_WORDS}, a AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter({_CUT.format("text")}, lambda x: length(x) > 8))) AS token FROM benchmark)
 SELECT query_id, max(coalesce(df, 0)) = 0 AS abstain FROM a LEFT JOIN d USING (token) GROUP BY query_id""")
def absence_veto(spark, sf):
    anchors = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) > 8))).alias("token"))
    i = index(spark, sf)
    return evidence.absence_veto(anchors.join(i.frequencies(anchors), "token", "left").withColumn("df", F.coalesce("df", F.lit(0))))


@query(f"""WITH {_WORDS} SELECT doc_id, CAST(count(*) AS BIGINT) AS terms, round(least(count(*), 3) * 0.2::DOUBLE / 60, 9) AS bonus FROM u WHERE token IN ('the', 'of', 'ering', 'thing') GROUP BY doc_id""")
def claim_coverage(spark, sf):
    hits = index(spark, sf).holding(["the", "of", "ering", "thing"])
    return evidence.claim_coverage(hits.select("doc_id", F.col("token").alias("term")))


@query("""SELECT o_orderkey AS id, round((CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.15 ELSE 0 END
 + least(0.2::DOUBLE, 0.2::DOUBLE * pow(2.0::DOUBLE, -greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31'), 0) / 90.0::DOUBLE)) + CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 0 END) / 60.0::DOUBLE, 9) AS bonus FROM orders""")
def structural_features(spark, sf):
    o = load(spark, sf, "orders")
    k, days = F.col("o_orderkey"), F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    bonus = ranking.structural_bonus(F.col("o_orderpriority") == "1-URGENT", k % 2 == 0, k % 3 == 0, days, F.col("o_orderstatus") == "F")
    return o.select(k.alias("id"), F.round(bonus, 9).alias("bonus"))


_PASSAGE = f"(SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT {_CUT.format('text')} AS x FROM benchmark ORDER BY item_id LIMIT 1)) WHERE NOT list_contains({_STOP}, w) GROUP BY w ORDER BY 2 LIMIT 32))"


def _search_sql() -> str:
    """As the query: cascade, a cap per source, a budget; the fold over at most 60 hits is recursive."""
    cost = "CAST(floor((length(text) + length(text) - length(regexp_replace(text, '[{}\\[\\]();:,.<>/`]', '', 'g'))) / 4) + 1 AS BIGINT)"
    return f"""WITH RECURSIVE {_WORDS}, p AS MATERIALIZED (SELECT {_PASSAGE} AS terms), {_cascade("(SELECT terms FROM p)", 60)},
 r AS (SELECT row_number() OVER (ORDER BY rank) AS n, doc_id, source, {cost} AS cost, round(1.0::DOUBLE / (rank + 1), 9) AS score FROM hits JOIN documents USING (doc_id)),
 z AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS cost, CAST(0 AS DOUBLE) AS score, CAST([] AS VARCHAR[]) AS chosen, FALSE AS good UNION ALL
  SELECT n, doc_id, source, cost, score, CASE WHEN good THEN list_append(chosen, source) ELSE chosen END, good FROM (SELECT r.n, r.doc_id, r.source, r.cost, r.score, z.chosen,
   len(z.chosen) < 20 AND len(list_filter(z.chosen, lambda x: x = r.source)) < CASE WHEN len(z.chosen) < 5 THEN 1 WHEN len(z.chosen) < 10 THEN 2 ELSE 3 END AS good FROM z JOIN r ON r.n = z.n + 1)),
 y AS (SELECT row_number() OVER (ORDER BY n) AS rank, doc_id, source, cost, score FROM z WHERE good),
 x AS (SELECT CAST(0 AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS cost, CAST(0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS used, FALSE AS fits UNION ALL
  SELECT y.rank, y.doc_id, y.source, y.cost, y.score, CASE WHEN x.used + y.cost <= 8000 THEN x.used + y.cost ELSE x.used END, x.used + y.cost <= 8000 FROM x JOIN y ON y.rank = x.rank + 1)
 SELECT 0 AS query_id, doc_id, cost, source, rank, score, max(used) OVER () AS used FROM x WHERE fits"""


@query(_search_sql())
def search(spark, sf):
    """The cascade, a cap per source and a token budget for one benchmark passage; costs stand in the index."""
    passage = load(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    i = index(spark, sf)
    hits = lexical.cascade(i, lexical.query_terms(passage), 60)
    ranked = i.docs.join(F.broadcast(hits), "doc_id").select("doc_id", "source", "rank", "score", "cost")  # at most 360 hits
    capped = ranking.per_group_cap(ranked.withColumn("query_id", F.lit(0)), "query_id", "source", "doc_id", 20, "cost", "score").withColumnRenamed("place", "rank")
    return ranking.pack_budget(capped, "query_id", "doc_id", "cost", 8000, "source", "rank", "score")
