"""Ignore files as tables: ordered rules with negation and folder scope, decided by one join on path prefixes.

A path has nodes: each folder above it and itself. A rule stands in a folder and speaks of the nodes below
that. Of the rules that match a node the last one counts: of another kind of file before the general one, of a deeper folder before
a higher one, of a later line before an earlier one. What lies in an ignored folder is ignored, whatever its own rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The files that hold rules, the later ones going before the earlier ones.
RULE_FILES = (".gitignore", ".ignore")


def rule_regex(pattern: Column) -> Column:
    """A rule without its ``!`` and its last ``/`` as a regular expression on paths relative to its folder."""
    bare = F.regexp_replace(pattern, r"^/", "")
    anchored = pattern.contains("/")
    # single characters are marked first, so that what is put in for one isn't read again
    text = F.regexp_replace(bare, r"\\(.)", "\x01$1\x02")
    text = F.regexp_replace(text, r"(?<!\x01)([.+^$(){}|])", r"\\$1")
    text = F.regexp_replace(text, r"\[!", "[^")
    text = F.regexp_replace(text, r"^\*\*/", "\x03")
    text = F.regexp_replace(text, r"/\*\*/", "/\x03")
    text = F.regexp_replace(text, r"/\*\*$", "/\x04")
    text = F.regexp_replace(text, r"(?<!\x01)\*+", "[^/]*")
    text = F.regexp_replace(text, r"(?<!\x01)\?", "[^/]")
    text = F.replace(F.replace(text, F.lit("\x03"), F.lit("(?:.*/)?")), F.lit("\x04"), F.lit(".+"))
    text = F.regexp_replace(text, "\x01(.)\x02", r"\\Q$1\\E")
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), text, F.lit("$"))


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, kind, line, negated, only_folders, regex) of the ignore files among (path, text)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lit(None).cast("int")
    for number, known in enumerate(RULE_FILES):
        kind = F.when(name == known, number).otherwise(kind)
    rows = files.select(F.regexp_replace("path", r"/?[^/]+$", "").alias("folder"), kind.alias("kind"), F.posexplode(F.split("text", r"\r?\n")).alias("line", "rule")).where("kind IS NOT NULL")
    rule = F.regexp_replace("rule", r"(?<!\\) +$", "")
    rows = rows.withColumn("rule", rule).where(~F.col("rule").rlike(r"^(?:#|!?/?$)"))
    negated = F.col("rule").startswith("!")
    bare = F.when(negated, F.substr("rule", F.lit(2))).otherwise(F.col("rule"))
    only = bare.endswith("/")
    return rows.select("folder", "kind", "line", negated.alias("negated"), only.alias("only_folders"), rule_regex(F.regexp_replace(bare, r"/+$", "")).alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored, by): whether a path is ignored, and the node that is.

    Nodes are decided once, however many paths go through them; a node meets the rules of the folders above it by equality.
    """
    parts = F.split("path", "/")
    above = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    each = paths.select("path").distinct().select("path", F.explode(above(parts)).alias("node"))
    nodes = each.groupBy("node").agg(F.max(F.col("node") != F.col("path")).alias("is_folder"))
    node = F.split("node", "/")
    folders = F.concat(F.array(F.lit("")), F.when(F.size(node) > 1, F.slice(above(node), F.lit(1), F.size(node) - 1)).otherwise(F.array().cast("array<string>")))
    met = nodes.select("node", "is_folder", F.explode(folders).alias("folder")).join(rules, "folder")
    inside = F.when(F.col("folder") == "", F.col("node")).otherwise(F.substr("node", F.length("folder") + 2))
    met = met.where((~F.col("only_folders") | F.col("is_folder")) & F.rlike(inside, F.col("regex")))
    last = met.groupBy("node").agg(F.max_by("negated", F.struct("kind", F.length("folder"), "line")).alias("negated")).where("NOT negated").select("node")
    first = each.join(last, "node").groupBy("path").agg(F.min_by("node", F.length("node")).alias("by"))
    return paths.select("path").distinct().join(first, "path", "left").select("path", F.col("by").isNotNull().alias("ignored"), "by")
