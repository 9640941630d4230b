"""Units of source files, their names and descriptors, and edges between them."""

from __future__ import annotations

import ast
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.workspace import Workspace, union

from .ranking import top_per_key

#: What units are called, and which of them can be called or are types.
CALLABLE, TYPES = ("function", "method"), ("class", "struct", "enum", "trait", "interface", "type")
#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


# --- units -------------------------------------------------------------------


def _parsed(files: DataFrame, what: int, schema: str) -> DataFrame:
    """The functions stand inside, so that workers get them with the task and need no package."""
    names = [c.split()[0] for c in schema.split(", ")]
    PIECE, HEAD = 1 << 16, re.compile(r"(?<=\n)(?:class|def|async|@)(?=[ \t\w])")
    kinds = [{"string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def pieces(text: str):
        """(line, tree) of pieces of a text: cut before a class or function of the first column, a piece that doesn't stand alone goes on to a later cut. No tree: not Python."""
        at, line, step = 0, 0, PIECE
        while True:
            cut = HEAD.search(text, at + step)
            end = cut.start() if cut else len(text)
            try:
                tree = ast.parse(text[at:end])
            except (SyntaxError, ValueError, RecursionError):
                if cut is None:
                    yield line, None
                    return
                step = 2 * (end - at)
                continue
            yield line, tree
            if cut is None:
                return
            breaks = text.count("\n", at, end) + text.count("\r", at, end) - text.count("\r\n", at, end)
            at, line, step = end, line + breaks, PIECE

    def found(path: str, text: str):
        """Classes, functions and methods of a Python text, outer ones first, or the names that each calls; a piece's tree is let go before the next."""
        units, calls, lines, numbers = [], [], text.splitlines(), itertools.count()

        def walk(node, parent, in_class, before):
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    is_class = isinstance(child, ast.ClassDef)
                    number = next(numbers)
                    if what == 0:
                        signature = lines[before + child.lineno - 1].strip()[:2048]
                        units.append((path, number, child.name, "class" if is_class else "method" if in_class else "function", before + child.lineno, before + child.end_lineno, parent, signature))
                    walk(child, number, is_class, before)
                else:
                    if what == 1 and isinstance(child, ast.Call):
                        name = child.func.attr if isinstance(child.func, ast.Attribute) else getattr(child.func, "id", None)
                        if name:
                            calls.append((path, parent, name, before + child.lineno))
                    walk(child, parent, in_class, before)

        def held(rows):
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        # rows wait as Arrow batches for the whole text: one error anywhere in it gives none
        out, rows = [], (units, calls)[what]
        for before, tree in pieces(text):
            if tree is None:
                return []
            walk(tree, None, False, before)
            if len(rows) >= 8192:
                out.append(held(rows))
                rows.clear()
        return [*out, held(rows)]

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text")):
                yield from found(path.as_py(), text.as_py() or "")

    return files.select("path", "text").mapInArrow(run, schema)


def units(files: DataFrame) -> DataFrame:
    """(path, unit, name, kind, start_line, end_line, parent, signature) of Python files (path, text); other texts give none."""
    return _parsed(files, 0, "path string, unit int, name string, kind string, start_line int, end_line int, parent int, signature string")


def calls(files: DataFrame) -> DataFrame:
    """(path, caller, name, line): who calls what; the caller is the innermost unit, or null at the top."""
    return _parsed(files, 1, "path string, caller int, name string, line int")


def qualified_names(parsed: DataFrame, depth: int = 16) -> DataFrame:
    """(path, unit, qualified): ``path::Outer::inner``, by parents, nested up to ``depth`` deep.

    Chains of parents are joined end to end, each round twice as long, so a unit meets no other units of its file.
    """
    space, k = Workspace(parsed.sparkSession, "names"), 0
    rows = space.table(parsed.select("path", "unit", F.col("parent").alias("up"), F.array("name").alias("chain")), "0")
    while not rows.where("up IS NOT NULL").isEmpty():
        over, k = rows.select("path", F.col("unit").alias("up"), F.col("up").alias("next"), F.col("chain").alias("over")), k + 1
        long = rows.join(over, ["path", "up"], "left")
        rows = space.table(long.select("path", "unit", F.col("next").alias("up"), F.concat(F.coalesce("over", F.array().cast("array<string>")), "chain").alias("chain")), str(k))
    return rows.select("path", "unit", F.concat_ws("::", "path", F.slice("chain", 1, depth)).alias("qualified"))


def doc_comments(parsed: DataFrame, files: DataFrame, reach: int = 64) -> DataFrame:
    """(path, unit, doc): the comment lines right above each unit (path, unit, start_line).

    Lines stand in blocks of twice ``reach``, half of them those before, so that no unit meets all lines of its file.
    """
    lines = files.select("path", F.split("text", "\n", -1).alias("lines"))
    low = F.greatest((F.col("b") - 1) * reach, F.lit(0))
    blocks = lines.select("path", "lines", F.explode(F.sequence(F.lit(0), F.floor(F.size("lines") / reach).cast("int"))).alias("b"))
    blocks = blocks.select("path", "b", F.slice("lines", low + 1, (F.col("b") + 1) * reach - low).alias("near"))
    rows = parsed.select("path", "unit", "start_line").join(lines.select("path", F.size("lines").alias("n")), "path")
    rows = rows.withColumn("start_line", F.least("start_line", F.col("n") + 1))  # the parser may count more lines
    rows = rows.withColumn("b", F.floor((F.col("start_line") - 1) / reach).cast("int")).join(blocks, ["path", "b"])
    return rows.select("path", "unit", doc_comment(F.col("near"), F.col("start_line") - low).alias("doc"))


def doc_comment(lines: Column, start_line: Column, most: int = 4) -> Column:
    """Up to ``most`` comment lines right above a unit, at most 400 characters; attributes and decorators are passed over."""
    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(start_line - 1, F.lit(0))))
    trimmed = F.transform(F.slice(above, 1, 64), lambda x: F.trim(x))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done"))

    def step(acc, line):
        blank, skip, comment = line == "", line.startswith("#[") | line.startswith("@"), line.rlike(r"^(//|#|--)")
        body = F.trim(F.regexp_replace(line, r"^(///|//!|//|--|#)", ""))
        full = F.size(acc["out"]) >= most
        stop = acc["done"] | full | (blank & (F.size(acc["out"]) > 0)) | ~(blank | skip | comment)
        out = F.when(stop | blank | skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(body)))
        return F.struct(out.alias("out"), stop.alias("done"))

    text = F.left(F.array_join(F.reverse(F.aggregate(trimmed, zero, step, lambda acc: acc["out"])), " "), F.lit(400))
    return F.nullif(text, F.lit(""))


def file_descriptors(files: DataFrame, parsed: DataFrame, most: int = 2048) -> DataFrame:
    """(path, descriptor): path and language, up to 12 leading comments or imports of the first 24 lines, up to 24 top-level signatures."""
    lines = F.slice(F.split("text", "\n", -1), 1, 24)
    head = F.slice(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^(//|#|use |import |from |mod )")), 1, 12)
    top = top_per_key(parsed.where("parent IS NULL"), "path", [F.col("unit")], 24)
    top = top.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("unit", "signature"))).alias("t"))
    rows = files.join(top, "path", "left")
    parts = F.array(F.concat("path", F.lit(" ("), F.coalesce("language", F.lit("text")), F.lit(")")), F.array_join(head, "\n"), F.coalesce(F.array_join("t.signature", "\n"), F.lit("")))
    return rows.select("path", F.left(F.array_join(F.filter(parts, lambda x: x != ""), "\n\n"), F.lit(most)).alias("descriptor"))


def symbol_descriptors(parsed: DataFrame, qualified: DataFrame, called: DataFrame, most: int = 12) -> DataFrame:
    """(path, unit, descriptor): kind, qualified name, words of the name, signature and up to ``most`` callees."""
    callees = called.where("caller IS NOT NULL").select("path", F.col("caller").alias("unit"), "name").distinct()
    callees = callees.groupBy("path", "unit").agg(F.slice(F.array_sort(F.collect_list("name")), 1, most).alias("callees"))
    rows = parsed.join(qualified, ["path", "unit"]).join(callees, ["path", "unit"], "left")
    words = F.array_join(T.identifier_terms(F.col("name")), " ")
    split = F.when((words != "") & (words != F.lower("name")), F.concat(F.lit(" ("), words, F.lit(")"))).otherwise("")
    tail = F.when(F.size("callees") > 0, F.concat(F.lit("\ncalls: "), F.array_join("callees", ", "))).otherwise("")
    return rows.select("path", "unit", F.concat("kind", F.lit(" "), "qualified", F.lit(" in "), "path", split, F.lit(" — "), "signature", F.coalesce(tail, F.lit(""))).alias("descriptor"))


# --- specifiers, routes, manifests -------------------------------------------


def imports(files: DataFrame) -> DataFrame:
    """(path, language, specifier) by the import forms of TypeScript and JavaScript, Python and Rust."""
    forms = {
        "typescript": [r"""(?m)\bfrom\s+['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", r"""(?m)^\s*import\s+['"]([^'"]+)['"]"""],
        "python": [r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import\b"],
        "rust": [r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"],
    }
    found = F.array().cast("array<string>")
    for language, patterns in forms.items():
        here = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])
        found = F.when(F.col("language").isin(*((language, "javascript", "tsx") if language == "typescript" else (language,))), here).otherwise(found)
    return files.select("path", "language", F.explode(F.array_distinct(found)).alias("specifier"))


def import_candidates(specifiers: DataFrame) -> DataFrame:
    """(path, specifier, ordinal, candidate): files that an import may mean, the likeliest first."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    parts = F.filter(F.split(F.regexp_replace("specifier", r"^(crate|self|super)::", ""), r"::|\."), lambda x: x != "")
    cuts = F.sequence(F.size(parts), F.lit(1))
    shorter = lambda p, n: F.array_join(F.slice(p, F.lit(1), n), "/")
    base = F.concat(folder, F.regexp_replace("specifier", r"^\./", ""))
    ts = F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])
    py = F.flatten(F.transform(cuts, lambda n: F.array(F.concat(shorter(parts, n), F.lit(".py")), F.concat(shorter(parts, n), F.lit("/__init__.py")))))
    rs = F.flatten(F.transform(cuts, lambda n: F.array(F.concat(F.lit("src/"), shorter(parts, n), F.lit(".rs")), F.concat(F.lit("src/"), shorter(parts, n), F.lit("/mod.rs")))))
    none = F.array().cast("array<string>")
    some = F.when(F.col("language") == "python", py).when(F.col("language") == "rust", rs).when(F.col("specifier").startswith("."), ts).otherwise(none)
    return specifiers.where(F.col("specifier") != "").select("path", "specifier", F.posexplode(some).alias("ordinal", "candidate"))


def resolved_imports(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(path, specifier, target): the first candidate that is a file; reduced by an aggregate, so that popular modules don't sort."""
    known = files.select(F.col("path").alias("candidate"))
    # of a semi-join only the files may be broadcast, never the candidates, whose number a plan can't tell
    return candidates.join(known, "candidate", "left_semi").groupBy("path", "specifier").agg(F.min_by("candidate", "ordinal").alias("target")).where("path <> target")


def routes(files: DataFrame) -> DataFrame:
    """(path, route, method, handler) of ``.route("/p", get(handler))`` calls."""
    form = r"""\.route\(\s*"([^"]+)"\s*,\s*(?:\w+::)*(get|post|put|delete|patch|head|options)\(\s*([\w:]+)"""
    one = lambda g: F.regexp_extract_all("text", F.lit(form), F.lit(g))
    each = F.explode(F.arrays_zip(one(1).alias("route"), one(2).alias("method"), one(3).alias("handler")))
    return files.select("path", each.alias("x")).select("path", F.col("x.route").alias("route"), F.upper("x.method").alias("method"), F.element_at(F.split("x.handler", "::"), -1).alias("handler"))


def npm_packages(manifests: DataFrame) -> DataFrame:
    """(path, package, name): what package.json files depend on, of any kind."""
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    keys = F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object("text", f"$.{k}")), F.array().cast("array<string>")) for k in kinds]))
    return manifests.select("path", F.get_json_object("text", "$.name").alias("package"), F.explode(F.array_distinct(keys)).alias("name"))


def cargo_packages(manifests: DataFrame) -> DataFrame:
    """(path, package, name): what the dependency sections of Cargo.toml files name; sections are followed line by line."""
    rows = manifests.select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    head = F.regexp_extract("line", r"^\s*\[+\s*([^\]]+?)\s*\]", 1)
    order = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("section", F.last(F.when(head != "", head), ignorenulls=True).over(order))
    key = F.regexp_extract("line", r"""^\s*["']?([\w-]+)["']?(?:\.[\w-]+)?\s*=""", 1)
    names = rows.where((F.col("section") == "package") & (key == "name")).select("path", F.regexp_extract("line", r"""=\s*["']([^"']+)""", 1).alias("package"))
    flat = rows.where(F.col("section").rlike(r"(^|\.)(dev-|build-)?dependencies$") & (key != "")).select("path", key.alias("name"))
    long = rows.where(head.rlike(r"(^|\.)(dev-|build-)?dependencies\.[\w-]+$")).select("path", F.regexp_extract(head, r"([\w-]+)$", 1).alias("name"))
    return names.join(union(flat, long).distinct(), "path").select("path", "package", "name")


def test_pairs(tests: DataFrame, targets: DataFrame) -> DataFrame:
    """(test_id, target_id, confidence): a test of the same name 0.65, of a name that begins with the target's 0.55.

    Both are joins by name: a test's name without its mark stands for itself and for each of its beginnings at an underscore.
    """
    bare = F.regexp_replace("name", r"^test_|_test$", "")
    parts = F.split(bare, "_")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "_").alias("name"), (F.size(parts) - n).alias("cut")))
    each = tests.select(F.col("id").alias("test_id"), F.explode(heads).alias("h")).select("test_id", "h.name", "h.cut")
    # of all targets of a name only the smallest two can be the best of a test that isn't the target itself
    least = targets.groupBy("name").agg(F.min("id").alias("low"))
    more = targets.join(least, "name").where("id > low").groupBy("name").agg(F.min("id").alias("next"))
    few = least.join(more, "name", "left")
    target = F.when(F.col("low") == F.col("test_id"), F.col("next")).otherwise(F.col("low"))
    hits = each.join(few, "name").select("test_id", "cut", target.alias("target_id")).where("test_id IS NOT NULL AND target_id IS NOT NULL")
    best = hits.groupBy("test_id").agg(F.min(F.struct("cut", "target_id")).alias("b"))
    return best.select("test_id", "b.target_id", F.when(F.col("b.cut") == 0, 0.65).otherwise(0.55).alias("confidence"))


def test_files(files: DataFrame) -> DataFrame:
    """(path, target, confidence): test files and what they test, by the name of the file (0.7), the smallest path first."""
    name = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1)
    stem = F.regexp_replace(name, r"^test_|_test$|\.(test|spec)$", "")
    rows = files.select("path", name.alias("name"), stem.alias("stem"))
    target = rows.where("name = stem").groupBy("stem").agg(F.min("path").alias("target"))
    return rows.where("name <> stem").join(target, "stem").select("path", "target", F.lit(0.7).alias("confidence"))


# --- hits in files -----------------------------------------------------------


def regions_of_lines(lines: DataFrame, regions: DataFrame, k: int = 4, bucket: int = 64) -> DataFrame:
    """(path, region_id, place): the ``k`` smallest regions of each path that hold one of the lines (path, line).

    A region holds one if the next line from its start on isn't beyond its end, so it meets one line, not all that it holds. Places stand in
    buckets of ``bucket`` lines, so that no path is one group; the first line of the later buckets follows from one row for each.
    """
    b = lambda c: F.floor(F.col(c) / bucket)
    once = lines.where("line IS NOT NULL").select("path", "line", b("line").alias("_b")).distinct()
    starts = regions.where("start_line <= end_line").select("path", "region_id", "start_line", "end_line", b("start_line").alias("_b"))
    none = lambda *names: [F.lit(None).cast(dict(regions.dtypes)[n]).alias(n) for n in names]
    marks = union(starts.withColumn("line", F.lit(None).cast("long")), once.select("path", F.col("line").cast("long").alias("line"), "_b", *none("region_id", "start_line", "end_line")))
    at = F.coalesce("line", F.col("start_line"))
    # from the last place to the first, of one place lines come first
    near = Window.partitionBy("path", "_b").orderBy(at.desc(), F.col("line").isNull())
    marks = marks.withColumn("next", F.last("line", ignorenulls=True).over(near)).where("start_line IS NOT NULL")
    firsts = union(once.groupBy("path", "_b").agg(F.min("line").cast("long").alias("first")), starts.select("path", "_b").distinct().withColumn("first", F.lit(None).cast("long"))).groupBy("path", "_b").agg(F.min("first").alias("first"))
    later = F.last("first", ignorenulls=True).over(Window.partitionBy("path").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    placed = marks.join(firsts.select("path", "_b", later.alias("later")), ["path", "_b"])
    once = placed.where(F.coalesce("next", "later") <= F.col("end_line")).select("path", "region_id", (F.col("end_line") - F.col("start_line")).alias("span")).distinct()
    return top_per_key(once, "path", [F.col("span"), F.col("region_id")], k)


def candidates_of_files(ranked: DataFrame, placed: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, rank): documents of the regions that hits fell into, and the descriptors of the files, at the rank of the file."""
    regions = ranked.join(placed.select("path", "region_id"), "path").select("rank", "region_id")
    own = documents.where("region_id IS NOT NULL").select("doc_id", "region_id").join(regions, "region_id").select("doc_id", "rank")
    files = documents.where("representation = 'file_descriptor'").select("doc_id", "path").join(ranked, "path").select("doc_id", "rank")
    return union(own, files).groupBy("doc_id").agg(F.min("rank").alias("rank"))


def anchors(text: Column) -> Column:
    """What a query names literally, in order: terms in backticks, then tokens that look like code."""
    quoted = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    tokens = F.filter(F.split(F.regexp_replace(text, "`[^`]*`", " "), r"[\s,;()]+"), lambda t: (t != "") & (t.contains("_") | t.contains("::") | t.rlike(r"\p{Ll}\p{Lu}") | t.rlike(r"^.+\.[A-Za-z0-9]{1,5}$")))
    return F.array_distinct(F.concat(quoted, tokens))
