"""Full-text retrieval over an index: frequencies, BM25, the strictness cascade, phrases, snippets, trigrams and grep."""

from __future__ import annotations

import itertools
import math

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.workspace import Workspace, union

from .index import TextIndex, saturated, weighted

#: Words that no query asks for.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "for", "on", "with", "by", "how", "what", "where", "does",
    "的", "是", "在", "了", "和", "吗",
)
MAX_TERMS = 32
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def query_terms(text: str, most: int = MAX_TERMS) -> list[str]:
    """Distinct words of a query in order, without stop words, as the index spells them."""
    return list(dict.fromkeys(w for w in T.python_tokens(text) if w not in STOPWORDS))[:most]


def _idf(df: int, n: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0.0


def bm25(index: TextIndex, terms: list[str], weights=None) -> DataFrame:
    """(doc_id, score) of documents with any of the terms, by field weights; only the terms' postings are read."""
    hits = index.holding(terms)
    if weights is not None:
        hits = hits.withColumn("w", weighted(F.col("fields"), weights))
    return _scored(index, hits, _idfs(index, terms))


def _idfs(index: TextIndex, terms: list[str]) -> dict[str, float]:
    """The weight of each of a few terms, by its documents."""
    return {r.token: _idf(r.df, index.n) for r in index.blocks_of(terms).groupBy("token").agg(F.sum("n").alias("df")).collect()}


def _by_token(idfs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in idfs.items() for x in pair])[F.col("token")] if idfs else F.lit(0.0)


def _scored(index: TextIndex, hits: DataFrame, idfs: dict[str, float]) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.sum(_by_token(idfs) * saturated(F.col("w"), F.col("dl"), index.avgdl)).alias("score"))


def best_hits(index: TextIndex, terms: list[str], k: int, first: int = 8) -> tuple[DataFrame, int, int]:
    """(doc_id, score) of the ``k`` best documents by BM25, how many postings were read and how many the terms have.

    The blocks of the terms bound what each cell can give. The ``k`` most promising cells are scored (``first`` at least), which for one
    term gives the ``k``-th score or ties with it; then those that can still
    hold something as good as the ``k``-th score so far, and no others. Equal scores go by document.
    """
    idfs = _idfs(index, terms)
    bound = _by_token(idfs) * F.col("top")
    space = Workspace(index.spark, "best")
    cells = space.table(index.blocks_of(terms).groupBy("cell").agg((F.sum(bound) * (1 + 1e-12)).alias("bound"), F.sum("n").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0
    top = [r.cell for r in cells.orderBy(F.desc("bound"), "cell").limit(max(first, min(k, 512))).collect()]
    order = [F.desc("score"), F.col("doc_id")]
    one = space.table(_scored(index, index.holding(terms).where(F.col("cell").isin(*top)), idfs).orderBy(*order).limit(k), "first")
    least = [r.score for r in one.orderBy("score").limit(1).collect()] if one.count() >= k else []
    rest = cells.where(~F.col("cell").isin(*top)).where(F.col("bound") >= least[0] if least else F.lit(True))
    asked = rest.agg(F.sum("n"), F.count("*")).first()
    read = (cells.where(F.col("cell").isin(*top)).agg(F.sum("n")).first()[0] or 0) + (asked[0] or 0)
    hits = index.holding(terms)
    if asked[1] <= 512:  # so few that they reach the scan as a filter
        hits = hits.where(F.col("cell").isin(*[r.cell for r in rest.select("cell").collect()]))
    else:
        hits = hits.join(rest.select("cell"), "cell", "left_semi")
    both = union(one, _scored(index, hits, idfs)).orderBy(*order).limit(k)
    return both.select("doc_id", F.round("score", 9).alias("score")), read, total


def floor_of(frequencies: dict[int, int], terms: list[str], n: int, most: int = 150) -> list[tuple[int, int]]:
    """Pairs of terms (by place) of which one suffices. With over twelve terms the rarer ones, cheapest pairs first."""
    live = list(range(len(terms)))
    if len(terms) > 12:
        live = [i for i in live if 0 < frequencies.get(i, 0) <= max(n // 8, 200)]
        if len(live) < 2:
            live = sorted((i for i in range(len(terms)) if frequencies.get(i)), key=lambda i: (frequencies[i], terms[i]))[:12]
    cost = lambda p: (frequencies.get(p[0], 0) + frequencies.get(p[1], 0), *sorted((terms[p[0]], terms[p[1]])))
    pairs = sorted(itertools.combinations(live, 2), key=cost)
    return pairs[:most] if len(terms) > 2 else []


def cascade(index: TextIndex, terms: list[str], limit: int) -> DataFrame:
    """(doc_id, stage, rank, score): all terms as words, then as prefixes, for mixed scripts the same of the Latin terms, then pairs
    of prefixes, for mixed scripts last any Latin prefix.

    A stage adds its best ``limit`` by BM25 that no stricter one had; none begins once there are ``limit``.
    One scan of the terms' postings gives a written table that is counted, then ranked; at most 32 counts reach the driver.
    """
    terms = terms[:MAX_TERMS]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(terms)]) if terms else F.array().cast("array<struct<i:int,t:string>>")
    rows = index.holding(terms, prefix=True)
    rows = rows.select("doc_id", "token", "w", "dl", F.explode(F.filter(places, lambda x: F.col("token").startswith(x["t"]))).alias("x"))
    whole = F.col("token") == F.col("x.t")
    hits = rows.groupBy("doc_id", F.col("x.i").alias("i")).agg(F.sum("w").alias("begun"), F.sum(F.when(whole, F.col("w"))).alias("exact"), F.first("dl").alias("dl"))
    hits = Workspace(index.spark, "cascade").table(hits, "hits")
    counts = {r.i: (r.n, r.m) for r in hits.groupBy("i").agg(F.count("*").alias("n"), F.count("exact").alias("m")).collect()}
    begun, exact = ({i: c[k] for i, c in counts.items()} for k in (0, 1))
    latin = [i for i, t in enumerate(terms) if not _CJK.search(t)]
    mixed = 0 < len(latin) < len(terms)
    pairs = floor_of(begun, terms, index.n)

    def idf(df):
        values = [F.lit(x) for i in range(len(terms)) for x in (i, _idf(df.get(i, 0), index.n))]
        return F.create_map(*values)[F.col("i")] if values else F.lit(0.0)

    bit = F.expr("shiftleft(1L, i)")
    score = lambda tf, df, test: F.round(F.sum(F.when(test, idf(df) * saturated(F.col(tf), F.col("dl"), index.avgdl))), 9)
    is_latin, some, one = F.col("i").isin(*latin) if latin else F.lit(False), F.lit(True), F.lit(False)
    docs = hits.groupBy("doc_id").agg(
        F.bit_or(F.when(F.col("exact").isNotNull(), bit).otherwise(0)).alias("whole"), F.bit_or(bit).alias("begins"),
        score("exact", exact, some).alias("s0"), score("begun", begun, some).alias("s1"),
        score("exact", exact, is_latin).alias("s2"), score("begun", begun, is_latin).alias("s3"),
    )
    everything, latins = (1 << len(terms)) - 1, sum(1 << i for i in latin)
    has = lambda column, mask: F.col(column).bitwiseAND(mask) == mask
    floor = F.exists(F.array(*[F.lit((1 << a) | (1 << b)).cast("long") for a, b in pairs]), lambda p: F.col("begins").bitwiseAND(p) == p) if pairs else one
    stages = [(has("whole", everything), "s0"), (has("begins", everything), "s1")]
    if mixed:
        stages += [(has("whole", latins), "s2"), (has("begins", latins), "s3")]
    stages.append((floor if len(pairs) > 2 or len(terms) > 12 else one, "s1"))
    if mixed:
        stages.append((F.col("begins").bitwiseAND(latins) != 0, "s3"))
    tests = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(k).alias("stage"), F.coalesce(s, F.lit(0.0)).alias("bm25"))) for k, (test, s) in enumerate(stages)]))
    met = docs.select("doc_id", F.explode(tests).alias("s")).select("doc_id", "s.*")
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("bm25"), "doc_id"))).where(F.col("place") <= limit)
    # at most six times ``limit`` rows from here on
    first = best.groupBy("doc_id").agg(F.min(F.struct("stage", F.col("place"))).alias("f")).select("doc_id", "f.stage", "f.place")
    everywhere = Window.partitionBy().orderBy("stage")
    before = F.coalesce(F.sum(F.lit(1)).over(everywhere.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = first.withColumn("before", before).where(F.col("before") < limit)
    rank = F.row_number().over(Window.partitionBy().orderBy("stage", "place"))
    return kept.select("doc_id", F.col("stage").cast("long").alias("stage"), rank.cast("long").alias("rank"), F.round(1 / (rank + 1), 9).alias("score"))


def phrase(index: TextIndex, words: list[str]) -> DataFrame:
    """Documents in which the words stand side by side in one field, by their positions."""
    if not words:
        return index.docs.where("false").select("doc_id")
    rows = index.in_fields(words)
    at = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: x["w"] == F.col("token")))
    starts = rows.select("doc_id", "field", "positions", at.alias("x")).select("doc_id", "field", "x.i", F.explode("positions").alias("p"))
    runs = starts.groupBy("doc_id", "field", (F.col("p") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("n"))
    return runs.where(F.col("n") == len(words)).select("doc_id").distinct()


def snippet(text: Column, terms: list[str], size: int = 24) -> Column:
    """The first of the windows of ``size`` words with most distinct terms; hits are marked, cut ends show dots. For few rows."""
    shown = F.filter(F.split(text, r"[^\p{L}\p{N}\p{Co}_\p{M}]+"), lambda t: t != "")
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

    def cut(w):
        hit = F.transform(w, lambda x: F.array_contains(wanted, T.plain(x)))
        last = F.greatest(F.size(w) - size, F.lit(0))
        score = lambda i: F.size(F.array_distinct(F.filter(F.transform(F.slice(w, i + 1, F.lit(size)), T.plain), lambda x: F.array_contains(wanted, x))))
        best = F.array_max(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(score(i).alias("n"), (-i).alias("at"))))
        marked = F.zip_with(w, hit, lambda x, h: F.when(h, F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x))
        start = -best["at"]
        body = F.array_join(F.slice(marked, start + 1, F.lit(size)), " ")
        return F.concat(F.when(start > 0, "… ").otherwise(""), body, F.when(start + size < F.size(w), " …").otherwise(""))

    return F.transform(F.array(shown), cut)[0]


def document_frequency(index: TextIndex, cap: int | None = None) -> DataFrame:
    return index.frequencies(cap=cap)


def rare_terms(index: TextIndex, asked: DataFrame, most: int = 4) -> DataFrame:
    """(query_id, token, df, place): each query's rarest terms that occur, from (query_id, token)."""
    ceiling = max(index.n // 200, 32)
    df = index.frequencies(asked).where(F.col("df") <= ceiling)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "token"))
    return asked.join(df, "token").withColumn("place", place.cast("long")).where(F.col("place") <= most)


def floor_pairs(df: DataFrame, most: int = 150) -> DataFrame:
    """(query_id, a, b, cost): each query's cheapest pairs of terms, by summed document frequency, from (query_id, token, df) of at most 32 terms a query."""
    a, b = (df.select("query_id", F.col("token").alias(x), F.col("df").alias(f"d{x}")) for x in "ab")
    pairs = a.join(b, "query_id").where("a < b").select("query_id", "a", "b", (F.col("da") + F.col("db")).alias("cost"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "a", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).drop("place")


def mentions(index: TextIndex, term: str, limit: int | None = None) -> DataFrame:
    """Paths of documents that mention a term, a word or a phrase such as ``a::b``, in order."""
    words = T.python_tokens(term)
    hits = phrase(index, words) if len(words) != 1 else index.holding(words).select("doc_id").distinct()
    paths = hits.join(index.docs, "doc_id").select("path").distinct()
    return paths.orderBy("path").limit(limit) if limit else paths


def binding(index: TextIndex, terms: list[str]) -> DataFrame:
    """(doc_id, path) of documents that hold every term."""
    hits = index.holding(terms).groupBy("doc_id").agg(F.countDistinct("token").alias("n")).where(F.col("n") == len(set(terms)))
    return hits.join(index.docs, "doc_id").select("doc_id", "path")


def name_trigrams(names: DataFrame, key: str, name: str) -> DataFrame:
    return names.select(key, F.explode(T.trigrams(T.folded(F.col(name)))).alias("trigram"))


def trigram_search(names: DataFrame, key: str, name: str, needle: str) -> DataFrame:
    """Names that hold all trigrams of the needle, then the needle itself."""
    wanted = "".join(c for c in needle.lower() if c.isalnum())
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    index = name_trigrams(names, key, name).where(F.col("trigram").isin(grams)) if grams else None
    hits = names if index is None else names.join(index.groupBy(key).agg(F.countDistinct("trigram").alias("n")).where(F.col("n") == len(grams)).select(key), key)
    return hits.where(T.folded(F.col(name)).contains(wanted))


def grep(documents: DataFrame, pattern: str, per_file: int = 100, limit: int = 200) -> DataFrame:
    """(doc_id, line, col, text): first match of each line, lines shown up to 240 characters."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "raw")).where(F.col("raw").rlike(pattern))
    before = F.split("raw", pattern, 2)[0]
    shown = F.trim("raw")
    shown = F.when(F.length(shown) > 240, F.concat(F.substring(shown, 1, 240), F.lit("…"))).otherwise(shown)
    found = lines.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).where(F.col("place") <= per_file)
    return found.select("doc_id", (F.col("n") + 1).cast("long").alias("line"), (F.length(before) + 1).cast("long").alias("col"), shown.alias("text")).orderBy("doc_id", "line").limit(limit)


def feedback_terms(index: TextIndex | None, documents: DataFrame, query: list[str], most: int = 8) -> DataFrame:
    """(token, df): identifier parts of at most five seed documents (doc_id, text) that aren't in the query, by how many seeds hold them. The index isn't read."""
    parts = documents.limit(5).select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    rows = parts.where((F.length("token") >= 3) & F.col("token").rlike(r"\p{L}") & ~F.col("token").isin(*STOPWORDS, *query))
    return rows.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(most)
