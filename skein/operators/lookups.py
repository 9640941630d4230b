"""Keyed lookups, materialisation, filters and states of snapshots, entities, relations and documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of entities that are code scopes, and classes of documents about commits.
CODE_SCOPES = ("package", "module", "file", "class", "struct", "enum", "trait", "interface", "function", "method")
COMMIT_CLASSES = ("commit_summary", "commit_diff")
TEST_FOLDERS = ("tests", "test", "__tests__", "spec")
SUMMARIES = ("role_summary", "module_summary", "flow_summary", "knowledge_page")
#: Which views a route reads.
ROUTE_VIEWS = {"exact": "symbols", "lexical": "lexical", "dense": "dense", "structural": "graph", "knowledge": "knowledge", "history": "history", "diff": "history"}


# --- predicates and scalar functions -----------------------------------------


def is_test_entity(is_test: Column, qualified: Column) -> Column:
    """A test by path or name, or by a segment of its qualified name."""
    return is_test | F.coalesce(F.arrays_overlap(F.split(qualified, "::"), F.array(*map(F.lit, ("test", "tests", "testing")))), F.lit(False))


def is_test_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_FOLDERS)))


def truncated(text: Column, most: int = 2000) -> Column:
    return F.substring(text, 1, most)


def representation_weight(representation: Column) -> Column:
    return F.when(representation.isin(*SUMMARIES), 1.15).when(representation == "test_behavior", 1.1).otherwise(1.0)


def normalised_path(path: Column) -> Column:
    """Forward slashes, without empty and dot parts; two dots take away the part before them."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, none, lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(x == "..", acc).otherwise(F.concat(acc, F.array(x)))), "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def top_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise("(root)")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def name_forms(name: Column, parts: Column, folded: Column) -> Column:
    """What a name is indexed as: itself, its parts and itself without separators."""
    return F.concat_ws(" ", name, F.array_join(parts, " "), folded)


def index_profile(options: dict) -> Column:
    """A digest of versioned options, whatever their order."""
    return F.sha2(F.lit(json.dumps(options, sort_keys=True, separators=(",", ":"))), 256)


# --- lookups -----------------------------------------------------------------


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the ids in (key, ordinal), each id once at its first place; ids that are unknown are left out."""
    first = ids.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return first.join(rows, key)


def relations_by_kind(relations: DataFrame, kind: str, limit: int) -> DataFrame:
    return relations.where(F.col("kind") == kind).orderBy(F.desc("confidence"), "id").limit(limit)


def manifest(views: DataFrame) -> DataFrame:
    """(snapshot_id, views): the state of each view of a snapshot, a map by kind."""
    return views.groupBy("snapshot_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "state")))).alias("views"))


def newest(snapshots: DataFrame) -> DataFrame:
    """Complete snapshots with their place in their repository, newest first."""
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id")))
    return snapshots.where("complete").withColumn("place", place.cast("long"))


def serving(pointers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repository_id, snapshot_id, complete): what each repository serves; a pointer to nothing is incomplete."""
    known = snapshots.select(F.col("id").alias("snapshot_id"), "complete")
    return pointers.join(known, "snapshot_id", "left").select("repository_id", "snapshot_id", F.coalesce("complete", F.lit(False)).alias("complete"))


def fresh_snapshot(served: DataFrame, scanned: DataFrame) -> DataFrame:
    """(repository_id, state): whether what is served is what was scanned last: fresh, stale or missing."""
    rows = scanned.join(served.where("complete"), "repository_id", "left")
    return rows.select("repository_id", F.when(F.col("snapshot_id").isNull(), "missing").when(F.col("snapshot_id") == F.col("scanned_id"), "fresh").otherwise("stale").alias("state"))


def retain(blobs: DataFrame, keep: DataFrame) -> DataFrame:
    """(kept, deleted, freed_bytes) if only the digests in ``keep`` stay."""
    rows = blobs.join(keep.select("digest").distinct().withColumn("_keep", F.lit(True)), "digest", "left")
    gone = F.col("_keep").isNull()
    return rows.agg(F.count("_keep").alias("kept"), F.count_if(gone).alias("deleted"), F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).cast("long").alias("freed_bytes"))


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """The bytes [start, end) of a text; half a character at either end is replaced."""
    return F.make_valid_utf8(F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string"))


def materialised(documents: DataFrame, sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(id, body): a whole artifact or a slice of its source, as the generator's version says; an unknown version is an error."""
    rows = documents.join(sources.withColumnRenamed("text", "_source"), "path", "left").join(artifacts.withColumnRenamed("text", "_artifact"), "id", "left")
    error = F.raise_error(F.concat(F.lit("unknown generator "), F.coalesce("generated_by", F.lit("null")))).cast("string")
    body = F.when(F.col("generated_by").startswith("whole/"), F.col("_artifact")).when(F.col("generated_by").startswith("slice/"), source_slice(F.col("_source"), F.col("start"), F.col("end")))
    return rows.select("id", body.otherwise(error).alias("body"))


def file_content(files: DataFrame, cap: int = 1 << 20) -> DataFrame:
    """(path, content, truncated, binary): at most ``cap`` bytes of a file, none of a binary one."""
    binary = F.substring("text", 1, 8192).contains("\x00")
    size = F.octet_length("text")
    shown = F.when(size > cap, source_slice(F.col("text"), F.lit(0), F.lit(cap))).otherwise(F.col("text"))
    return files.select("path", F.when(binary, F.lit(None)).otherwise(shown).alias("content"), (~binary & (size > cap)).alias("truncated"), binary.alias("binary"))


# --- counts and states -------------------------------------------------------


def coverage(files: DataFrame) -> DataFrame:
    """(language, files, parsed, ratio)."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.count_if("parsed").alias("parsed"), F.round(F.avg(F.col("parsed").cast("double")), 9).alias("ratio"))


def view_states(facts: DataFrame) -> DataFrame:
    """(snapshot_id, kind, state) from (snapshot_id, coverage, providers, ready): one state per view.

    Symbols are ready from a coverage of 0.99; the graph is partial unless all providers that apply are
    ready; dataflow is never there and knowledge always partial.
    """
    symbols = F.when(F.col("coverage") >= 0.99, "ready").otherwise("partial")
    graph = F.when((F.col("providers") > 0) & (F.col("ready") == F.col("providers")), "ready").otherwise("partial")
    states = {"symbols": symbols, "graph": graph, "dataflow": F.lit("unavailable"), "knowledge": F.lit("partial")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), s.alias("state")) for k, s in states.items()]))
    return facts.select("snapshot_id", each.alias("v")).select("snapshot_id", "v.kind", "v.state")


def missing_views(routes: DataFrame, views: DataFrame) -> DataFrame:
    """(query_id, missing, ran): the views that planned routes need but that can't serve, and whether every route could run."""
    need = F.create_map(*[F.lit(x) for pair in ROUTE_VIEWS.items() for x in pair])
    rows = routes.select("query_id", "snapshot_id", need[F.col("route")].alias("kind"))
    rows = rows.join(views, ["snapshot_id", "kind"], "left")
    good = F.coalesce(F.col("state").isin("ready", "partial", "stale"), F.lit(False))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(~good, F.col("kind")))).alias("missing"), F.bool_and(good).alias("ran"))


def provenance(relations: DataFrame, key: str) -> DataFrame:
    """Per key how many relations are precise, syntactic, derived and inferred, and their kinds, the first seen first."""
    origin = F.col("origin")
    counts = {"precise": origin.isin("compiler", "scip", "lsp"), "syntactic": origin == "syntax", "derived": origin == "derived", "inferred": origin == "inferred"}
    kinds = relations.groupBy(key, "kind").agg(F.min("id").alias("first")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", "kind"))).alias("k"))
    rows = relations.groupBy(key).agg(*[F.count_if(test).alias(name) for name, test in counts.items()])
    return rows.join(kinds.select(key, F.array_join("k.kind", ",").alias("kinds")), key)


# --- hits --------------------------------------------------------------------


def matching_hits(hits: DataFrame, entities: DataFrame, prefix: str | None = None, language: str | None = None) -> DataFrame:
    """Hits whose own path or that of any evidence begins with the prefix, and whose entity has the language."""
    if prefix:
        hits = hits.where(F.coalesce(F.col("path").startswith(prefix), F.lit(False)) | F.coalesce(F.exists("evidence", lambda p: p.startswith(prefix)), F.lit(False)))
    if language:
        hits = hits.join(entities.where(F.col("language") == language.lower()).select("entity_id"), "entity_id", "left_semi")
    return hits


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first in order; as an aggregate, so that frequent keys are reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return best.select(key, f"_r.{order}", *[f"_r.{c}" for c in rest])


def head_paths(fused: DataFrame, owned: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, paths, packages) of the first ``k`` hits, in order and each once."""
    top = fused.where(F.col("rank") <= k).join(owned, "path", "left")
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "package"))).alias("h"))
    return rows.select("query_id", F.array_distinct("h.path").alias("paths"), F.array_compact(F.array_distinct("h.package")).alias("packages"))


def two_lanes(rows: DataFrame, key: str, lane: str, order: list[Column], limit: int = 12) -> DataFrame:
    """Per key the first of each lane, then the second of each, ``limit`` in all; the lane that is true goes first."""
    place = F.row_number().over(Window.partitionBy(key, lane).orderBy(*order))
    turn = F.row_number().over(Window.partitionBy(key).orderBy("_n", F.desc(lane)))
    placed = rows.withColumn("_n", place).where(F.col("_n") <= limit)
    return placed.withColumn("turn", turn.cast("long")).where(F.col("turn") <= limit).drop("_n")


def expansion_evidence(hits: DataFrame) -> DataFrame:
    """(level, id, best, n): best score and count per entity, region and path, and of all."""
    keys = ("entity_id", "region_id", "path")
    rows = hits.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.max("score").alias("best"), F.count("*").alias("n"), *[F.grouping(k).alias(f"g_{k}") for k in keys])
    level = F.when(F.col("g_entity_id") == 0, "entity").when(F.col("g_region_id") == 0, "region").when(F.col("g_path") == 0, "path").otherwise("all")
    return rows.select(level.alias("level"), F.coalesce("entity_id", "region_id", "path").alias("id"), "best", "n").where("level = 'all' OR id IS NOT NULL")
