"""Lines of patches, commits as documents, and merging of relations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import Workspace, union


def diff_lines(patches: DataFrame) -> DataFrame:
    """(commit, path, pos, sign, line, content): changed lines of unified patches.

    A removed line has its number before the change, an added one that after it. Windows
    hold one patch each, and both share one shuffle by (commit, path).
    """
    raw = patches.select("commit", "path", F.posexplode(F.split("patch", "\n", -1)).alias("pos", "raw"))
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
    is_head = F.col("raw").rlike(head)
    order = Window.partitionBy("commit", "path").orderBy("pos")
    raw = raw.withColumn("hunk", F.sum(is_head.cast("int")).over(order)).where("hunk > 0")
    inside = Window.partitionBy("commit", "path", "hunk").orderBy("pos")
    sign = F.when(is_head, F.lit("@")).otherwise(F.substring("raw", 1, 1))

    def number(group: int, mark: str):
        start = F.first(F.when(is_head, F.regexp_extract("raw", head, group).cast("long"))).over(inside)
        return start + F.sum(F.when(sign.isin(" ", mark), 1).otherwise(0)).over(inside) - 1

    line = F.when(sign == "-", number(1, "-")).otherwise(number(2, "+"))
    rows = raw.select("commit", "path", "pos", sign.alias("sign"), line.alias("line"), F.expr("substring(raw, 2)").alias("content"))
    return rows.where("sign IN ('+', '-')")


def diff_grep(patches: DataFrame, pattern: str, per_file: int = 32) -> DataFrame:
    """Changed lines that match, the first ``per_file`` of each (commit, path)."""
    found = diff_lines(patches).where(F.col("content").rlike(pattern))
    place = F.row_number().over(Window.partitionBy("commit", "path").orderBy("pos"))
    return found.withColumn("_place", place).where(F.col("_place") <= per_file).drop("_place", "pos")


def merge_relations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, evidence): what is there, with incoming relations (id, n, evidence) put in, ``n`` being the order in which they came.

    The last incoming relation of a known id replaces it; those of a new id pool their evidence in order, repeats and all. One aggregation
    by id; of known ids it keeps one relation each.
    """
    none = F.lit(None).cast("long")
    both = union(existing.select("id", none.alias("n"), "evidence"), incoming.select("id", F.col("n").cast("long").alias("n"), "evidence"))
    known = existing.select("id").distinct().withColumn("known", F.lit(True))
    rows = both.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    kept = rows.groupBy("id", "known").agg(
        F.max_by("evidence", F.coalesce("n", F.lit(-(1 << 62)))).alias("last"),
        F.array_sort(F.collect_list(F.when(~F.col("known"), F.struct("n", "evidence")))).alias("all"),
    )
    return kept.select("id", F.when(F.col("known"), F.col("last")).otherwise(F.flatten(F.transform("all", lambda x: x["evidence"]))).alias("evidence"))


def rerank_in_place(ranked: DataFrame, key: str, item: str, topical: str, score: str, most: int = 50) -> DataFrame:
    """Reorders the first ``most`` topical rows of each key by score within the places they hold."""
    own = F.row_number().over(Window.partitionBy(key, topical).orderBy("rank"))
    rows = ranked.withColumn("_slot", own).withColumn("_moves", F.col(topical) & (F.col("_slot") <= most))
    better = F.row_number().over(Window.partitionBy(key, "_moves").orderBy(F.desc(score), item))
    moving = rows.where("_moves").withColumn("_slot2", better)
    places = rows.where("_moves").select(key, F.col("_slot").alias("_slot2"), F.col("rank").alias("_to"))
    moved = moving.join(places, [key, "_slot2"]).select(key, item, F.col("_to").alias("rank"))
    return rows.where("NOT _moves").select(key, item, "rank").unionByName(moved)


# --- commits as documents ----------------------------------------------------

#: The bounds of a document about a commit, in characters, lines and files.
MESSAGE, LINES, PATCH, BODY, FILES = 1024, 32, 8192, 16384, 512


def text_diffs(changes: DataFrame, context: int = 3) -> DataFrame:
    """(commit, path, hunks, added, removed, patch) from (commit, path, before, after): unified hunks by lines.

    A null text is a file that isn't there. Files are compared in Arrow batches, one by one; the
    functions stand inside, so that workers get them with the task.
    """
    schema = "commit string, path string, hunks int, added int, removed int, patch string"

    def run(batches):
        from difflib import unified_diff

        for batch in batches:
            out = []
            for commit, path, before, after in zip(*(batch.column(c).to_pylist() for c in ("commit", "path", "before", "after"))):
                old, new = ((x or "").split("\n") if x else [] for x in (before, after))
                lines = list(unified_diff(old, new, lineterm="", n=context))[2:]
                heads = sum(x.startswith("@@") for x in lines)
                out.append((commit, path, heads, sum(x[:1] == "+" for x in lines), sum(x[:1] == "-" for x in lines), "\n".join(lines)))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])

    return changes.select("commit", "path", "before", "after").mapInArrow(run, schema)


def commit_documents(commits: DataFrame, diffs: DataFrame) -> DataFrame:
    """(commit, ts, files, body): message, paths and, per file, the changed lines that name something; each part is bounded.

    ``files`` counts all paths; the body takes the first ``FILES`` of them.
    """
    changed = F.filter(F.split("patch", "\n", -1), lambda x: x.rlike(r"^[+-].*[\p{L}_]{3}"))
    kept = F.array_join(F.transform(F.slice(changed, 1, LINES), lambda x: F.concat(F.left(x, F.lit(1)), F.trim(F.substring(x, 2, PATCH)))), "\n")
    part = F.concat(F.col("path"), F.lit("\n"), F.left(kept, F.lit(PATCH)))
    place = F.row_number().over(Window.partitionBy("commit").orderBy("path"))
    few = diffs.select("commit", "path", part.alias("part")).withColumn("n", place).where(F.col("n") <= FILES)
    bodies = few.groupBy("commit").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("p"))
    count = diffs.groupBy("commit").agg(F.count("*").alias("files"))
    rows = commits.join(count, "commit").join(bodies, "commit")
    body = F.concat(F.left("message", F.lit(MESSAGE)), F.lit("\n\n"), F.array_join("p.part", "\n\n"))
    return rows.select("commit", "ts", "files", F.left(body, F.lit(BODY)).alias("body"))


def history_summary(commits: DataFrame, most: int) -> DataFrame:
    """(summary): the newest commits, one line each, as one page."""
    top = commits.orderBy(F.desc("ts"), "commit").limit(most)
    line = F.concat(F.left("commit", F.lit(12)), F.lit(" "), F.split("message", "\n", 2)[0])
    page = F.array_sort(F.collect_list(F.struct((-F.col("ts")).alias("t"), "commit", line.alias("line"))))
    return top.agg(F.array_join(F.transform(page, lambda x: x["line"]), "\n").alias("summary"))


def newest_changes(changes: DataFrame, commits: DataFrame, most: int = 512) -> DataFrame:
    """(commit, ts, path) of the newest commits with a parent, newest first; (commit, parent, ts) and (commit, path)."""
    top = commits.orderBy(F.desc("ts"), "commit").limit(most).where("parent IS NOT NULL")
    return changes.join(F.broadcast(top.select("commit", "ts")), "commit").select("commit", "ts", "path").orderBy(F.desc("ts"), "commit", "path")  # at most ``most`` commits


def reused_units(files: DataFrame, parsed: DataFrame, version: str) -> DataFrame:
    """The files (path, digest, language) with ``reused``: whether the parse of just this text by this version is there."""
    known = parsed.where(F.col("version") == version).select("path", "digest", "language").distinct().withColumn("reused", F.lit(True))
    return files.join(known, ["path", "digest", "language"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def first_parents(commits: DataFrame, head: str, limit: int = 512) -> DataFrame:
    """(commit, n, parent): the first ``limit`` commits on the way from ``head`` along first parents, from (commit, parents array).

    The known way is doubled at each pass by a table of jumps of that length, which is then doubled itself; so a way of 512
    takes nine passes, however many commits and merges there are. ``parent`` is null for a commit without parents.
    """
    spark = commits.sparkSession
    space = Workspace(spark, "parents")
    parent = commits.select("commit", F.get("parents", F.lit(0)).alias("parent"))
    jump = space.table(parent.where("parent IS NOT NULL").select("commit", F.col("parent").alias("to")), "jump-0")
    way, step, k = space.table(commits.where(F.col("commit") == head).select("commit", F.lit(0).cast("long").alias("n")).limit(1), "way-0"), 1, 0
    while step < limit:
        more = way.join(jump, "commit").select(F.col("to").alias("commit"), (F.col("n") + step).alias("n"))
        k += 1
        longer = space.table(union(way, more.where(F.col("n") < limit)), f"way-{k}")
        if longer.count() == min(limit, step):  # the way has ended
            break
        way, step = longer, 2 * step
        if step < limit:
            on = jump.select(F.col("commit").alias("to"), F.col("to").alias("further"))
            jump = space.table(jump.join(on, "to").select("commit", F.col("further").alias("to")), f"jump-{k}")
    # at most ``limit`` commits
    return parent.join(F.broadcast(way), "commit").select("commit", "n", "parent")


def changed_along(trees: DataFrame, way: DataFrame) -> DataFrame:
    """(commit, n, path, change): what each commit of a way changed against its first parent, from (commit, path, digest).

    Commits without a parent are left out. Only the trees of the way are joined, each pair of them by path.
    """
    pairs = way.where("parent IS NOT NULL")
    new = trees.join(F.broadcast(pairs.select("commit", "n")), "commit").select("commit", "n", "path", F.col("digest").alias("new"))
    old = trees.withColumnRenamed("commit", "parent").join(F.broadcast(pairs), "parent").select("commit", "n", "path", F.col("digest").alias("old"))
    both = new.join(old, ["commit", "n", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("commit", "n", "path", change.alias("change")).where("change IS NOT NULL")
