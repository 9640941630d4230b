"""Pages, federated lists, query variants, structural patterns, indexes of other tools and view builds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors

from .joins import smallest_enclosing
from .lexical import STOPWORDS
from .ranking import round_robin

EVIDENCE = 16  # files that a page names as its evidence


def knowledge_pages(files: DataFrame) -> DataFrame:
    """(grp, files, lines, languages, evidence) per group of files (path, language, lines), and one page ``(all)`` of the repository.

    Languages are sorted by how many files they have; evidence is the first paths.
    """
    rows = files.withColumn("grp", F.explode(F.array(T.knowledge_group(F.col("path")), F.lit("(all)"))))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("path"))
    first = rows.withColumn("n", place).where(F.col("n") <= EVIDENCE).groupBy("grp").agg(F.array_sort(F.collect_list("path")).alias("evidence"))
    by = rows.groupBy("grp", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    pages = by.groupBy("grp").agg(F.sum("n").alias("files"), F.sum("lines").alias("lines"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "language"))).alias("l"))
    listed = F.array_join(F.transform("l", lambda x: F.concat_ws(":", F.coalesce(x["language"], F.lit("text")), (-x["n"]).cast("string"))), ",")
    return pages.join(first, "grp").select("grp", "files", "lines", listed.alias("languages"), F.array_join("evidence", ",").alias("evidence"))


def federated(lists: DataFrame, states: DataFrame, limit: int) -> DataFrame:
    """(repo, doc_id, place): lists of repositories that answered, taken in turns; (repo, rank, doc_id) and (repo, state)."""
    good = lists.join(states.where("state = 'ok'").select("repo"), "repo", "left_semi")
    return round_robin(good, "repo", [F.col("rank")], limit).select("repo", "doc_id", "place")


def degraded(states: DataFrame) -> DataFrame:
    """(repo, state) of the repositories that failed or took too long, in order."""
    return states.where("state <> 'ok'").orderBy("repo")


def rendered(hits: DataFrame) -> DataFrame:
    """(doc_id, body): a hit as text, with its source, its routes and its snippet."""
    place = F.format_string("%s:%d-%d bytes %d..%d", "path", "start_line", "end_line", "start_byte", "end_byte")
    source = F.when(F.col("path").isNull(), "no direct source range").otherwise(place)
    return hits.select("doc_id", F.concat(F.lit("Source: "), source, F.lit("\nRoute: "), "route", F.lit("; routes: "), F.array_join("routes", ", "), F.lit("\nEvidence:\n"), "snippet").alias("body"))


#: The wording of variants that only add to a query.
WRAPPED = {"verbose": ("please help me understand: ", "?"), "assertive": ("I'm certain this exists in the codebase: ", ""), "hedged": ("not sure this exists, but if it does: ", "")}


def query_variants(cases: DataFrame) -> DataFrame:
    """(case_id, derived_from, kind, query) from (case_id, query, no_context): rewordings that differ from the query.

    A scramble orders the content words by their digest, so it is the same on every run. Cases without context
    are only wrapped, as dropping words could make them answerable.
    """
    words = F.filter(F.split("query", r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*STOPWORDS))
    keyed = F.array_sort(F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(":", w, i.cast("string"))).alias("k"), w.alias("w"))))
    scramble = F.when((F.size(words) > 1) & ~F.col("no_context"), F.array_join(F.transform(keyed, lambda x: x["w"]), " "))
    kinds = {k: F.concat(F.lit(a), "query", F.lit(b)) for k, (a, b) in WRAPPED.items()} | {"keyword-scramble": scramble}
    rows = cases.select("case_id", "query", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("q")) for k, q in kinds.items()])).alias("v"))
    rows = rows.where("v.q IS NOT NULL AND v.q <> query")
    return rows.select(F.concat_ws("::var-", F.col("case_id").cast("string"), "v.kind").alias("case_id"), F.col("case_id").alias("derived_from"), "v.kind", F.col("v.q").alias("query"))


# --- structural patterns -----------------------------------------------------


def pattern_regex(template: str) -> str:
    """A template as a regular expression: ``$NAME`` is one name or literal, ``$$$NAME``, ``:[x]`` and ``...`` any text without
    a brace, white space is elastic. Nested braces are not followed: a subset of what a syntax tree gives.
    """
    out, parts = "", re.split(r"(\$\$\$\w*|\$\w+|:\[\w+\]|\.\.\.|\s+)", template.strip())
    for part in parts:
        if not part:
            continue
        if part.startswith("$$$") or part == "..." or part.startswith(":["):
            out += r"[^{}]*?"
        elif part.startswith("$"):
            out += r"[\w.]+"
        elif part.isspace():
            out += r"\s+"
        else:
            out += r"\s*".join(re.escape(x) for x in re.findall(r"\w+|[^\w]", part))
    return out


def structural_matches(files: DataFrame, template: str, per_file: int = 100) -> DataFrame:
    """(path, place, match) of a template; files without its literal words are passed over first."""
    plain = re.sub(r"\$\$\$\w*|\$\w+|:\[\w+\]", " ", template)
    words = [w for w in re.findall(r"\w+", plain) if len(w) > 1]
    rows = files
    for word in words:
        rows = rows.where(F.contains("text", F.lit(word)))
    hits = rows.select("path", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit(pattern_regex(template)), F.lit(0)), 1, per_file)).alias("place", "match"))
    return hits.select("path", (F.col("place") + 1).cast("long").alias("place"), "match")


def code_search_query(text: Column, files: int = 6, literals: int = 10) -> Column:
    """An OR of up to six paths and ten literals of a query for a trigram search; null if it names none."""
    tokens = F.array_distinct(F.filter(F.split(text, r"[^\p{L}\p{N}_/.-]+"), lambda t: F.octet_length(t) > 2))
    is_path = lambda t: t.contains("/") | t.rlike(r"^[\w-]+\.[A-Za-z]\w{0,4}$")
    is_literal = lambda t: ~is_path(t) & (t.contains("_") | t.rlike(r"\p{Ll}\p{Lu}") | t.rlike(r"^\p{Lu}\p{Ll}+\p{Lu}"))
    escaped = lambda t: F.regexp_replace(t, r"([.\\+*?()\[\]{}^$|-])", r"\\$1")
    atoms = F.concat(F.transform(F.slice(F.filter(tokens, is_path), 1, files), lambda t: F.concat(F.lit("file:"), escaped(t))), F.transform(F.slice(F.filter(tokens, is_literal), 1, literals), escaped))
    return F.when(F.size(atoms) > 0, F.concat(F.lit("case:no ("), F.array_join(atoms, " or "), F.lit(")")))


# --- indexes of other tools --------------------------------------------------


def column_to_byte(line: Column, column: Column, utf16: bool = False) -> Column:
    """The byte offset of a column within a line; beyond the basic plane a character counts as two in UTF-16."""
    if not utf16:
        return F.least(column, F.octet_length(line)).cast("long")
    # as many characters as have that many code units before them
    units = F.transform(F.split(line, ""), lambda c: F.when(F.octet_length(c) > 3, 2).otherwise(1))
    walk = F.aggregate(units, F.struct(F.lit(0).alias("u"), F.lit(0).alias("n")), lambda acc, x: F.when(acc["u"] + x <= column, F.struct((acc["u"] + x).alias("u"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1 << 30).alias("u"), acc["n"].alias("n"))), lambda acc: acc["n"])
    return F.octet_length(F.substring(line, F.lit(1), walk)).cast("long")


def occurrence_edges(occurrences: DataFrame, ranges: DataFrame, bucket: int = 256) -> DataFrame:
    """(src, dst, uses) from decoded occurrences (path, at, symbol, is_definition): the unit around a reference uses the unit around the definition.

    A symbol that begins with ``local`` counts within its path only. A unit's uses of itself are left out.
    """
    units = smallest_enclosing(occurrences.select("path", "at").distinct(), ranges, "path", bucket).select("path", "at", F.col("range_id").alias("unit"))
    rows = occurrences.join(units, ["path", "at"])
    key = F.when(F.col("symbol").startswith("local "), F.concat_ws("\x1f", "path", "symbol")).otherwise(F.col("symbol"))
    rows = rows.withColumn("key", key)
    # one place defines a symbol: the first
    defined = rows.where("is_definition").groupBy("key").agg(F.min_by("unit", F.struct("path", "at")).alias("dst"))
    used = rows.where("NOT is_definition").groupBy("key", F.col("unit").alias("src")).agg(F.count("*").alias("n"))
    return used.join(defined, "key").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("uses"))


# --- views -------------------------------------------------------------------


def checked_profile(rows: DataFrame, profile: str, dims: int) -> DataFrame:
    """Vectors of the expected profile and length; any other one is an error."""
    good = (F.col("profile") == profile) & (F.size("vector") == dims)
    error = F.raise_error(F.concat(F.lit("vector of profile "), F.coalesce("profile", F.lit("null")), F.lit(" and length "), F.size("vector").cast("string")))
    return rows.withColumn("vector", F.when(F.coalesce(good, F.lit(False)), F.col("vector")).otherwise(error.cast(rows.schema["vector"].dataType)))


def dense_view(documents: DataFrame, cache: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Vectors (doc_id, digest, vector) of documents (doc_id, digest, words), and the view's status (state, reused, embedded).

    What the cache (digest, vector) has is reused; only the rest is embedded, once per text.
    """
    hit = documents.join(cache.select("digest", "vector"), "digest").select("doc_id", "digest", "vector")
    rest = documents.join(cache.select("digest"), "digest", "left_anti")
    texts = rest.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words"))
    made = vectors.hash_embedding(texts.select("doc_id", "words"), dims).join(texts.select("doc_id", "digest"), "doc_id").select("digest", "vector")
    new = rest.select("doc_id", "digest").join(made, "digest").select("doc_id", "digest", "vector")
    counts = hit.agg(F.count("*").alias("reused")).join(rest.agg(F.count("*").alias("embedded")))  # one row each
    state = F.when(F.col("reused") + F.col("embedded") > 0, "ready").otherwise("unavailable")
    return hit.unionByName(new), counts.select(state.alias("state"), "reused", "embedded")


def ingested(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(origin, added, replaced): what a provider's relations (id, origin) add to and replace of those that are there."""
    old = existing.select("id").distinct().withColumn("old", F.lit(True))
    rows = incoming.select("id", "origin").distinct().join(old, "id", "left")
    return rows.groupBy("origin").agg(F.count_if(F.col("old").isNull()).alias("added"), F.count("old").alias("replaced"))
