"""Secret scans over a trigram inverted index, in DataFrame functions only.

``trigram_query`` reads a rule's regular expression and derives a Boolean query,
an OR of ANDs of trigrams that every match must contain. The trigrams of all
rules, a vocabulary bounded by the rules, are looked up in every whole text and
written out as postings (trigram, document). Intersecting the postings of each
clause gives a rule's candidates, the only texts on which its expression then
runs. A rule without mandatory trigrams scans every text.

Results: a null text is empty and has no spans. Equal spans of one rule can't
occur twice; spans of different rules may overlap and all stay. Repeated rows are
scanned each by itself, and extra columns are kept as they are. Work is in proportion to
a text and its spans, however many it has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

MOST = 64  # literal alternatives that a query keeps apart


@dataclass(frozen=True)
class Rule:
    """``least`` counts the characters of ``group`` (0: the whole match); shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in the order in which equal starts are listed. Where the whole
#: match is counted and its last part is a run, the least length is part of the expression.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules of well-known public formats that this operator adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED


# --- Boolean trigram queries -------------------------------------------------


def _grams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _flush(exact: set[str]) -> list[frozenset[str]] | None:
    """OR of ANDs for 'one of these strings occurs'; None if one of them has no trigram."""
    clauses = {_grams(x) for x in exact}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def _and(a, b):
    if a is None or b is None:
        return a or b
    if len(a) * len(b) > MOST:
        return min(a, b, key=len)
    return sorted({x | y for x in a for y in b}, key=sorted)


def _node(op, arg) -> tuple[set[str] | None, list | None]:
    if op is sre.LITERAL:
        return {chr(arg)}, None
    if op is sre.IN:
        letters: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                letters.add(chr(value))
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                letters |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (letters, None) if len(letters) <= 8 else (None, None)
    if op is sre.SUBPATTERN:
        exact, query = _closed(arg[-1])
        return exact, query
    if op is sre.BRANCH:
        parts = [_closed(x) for x in arg[1]]
        if all(e is not None for e, _ in parts):
            return set().union(*(e for e, _ in parts)), None
        queries = [q if e is None else _flush(e) for e, q in parts]
        return None, None if any(q is None for q in queries) else sorted({c for q in queries for c in q}, key=sorted)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        exact, query = _closed(inner)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, None
        if low == 0:
            return None, None
        if exact is not None and low == high == 1:
            return exact, None
        return None, query if exact is None else _flush(exact)
    return None, None


def _closed(tree) -> tuple[set[str] | None, list | None]:
    """As ``_walk``, but the strings count only if they are the whole of it."""
    exact, query = {""}, None
    whole = True
    for op, arg in tree:
        got, need = _node(op, arg)
        query = _and(query, need)
        if got is not None and len(exact) * len(got) <= MOST:
            exact = {x + y for x in exact for y in got}
        else:
            query, whole, exact = _and(query, _flush(exact)), False, got or {""}
    return (exact, query) if whole and query is None else (None, _and(query, _flush(exact)))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match holds in full; None: no such clause."""
    exact, query = _closed(sre_parser.parse(pattern))
    return _flush(exact) if exact is not None else query


# --- index and scan ----------------------------------------------------------


def _all_of(column: Column, clause: frozenset[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(column, g) for g in sorted(clause)))


def postings(keyed: DataFrame, rules) -> DataFrame:
    """(trigram, doc_id, text_key) for the trigrams that rules ask for."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) or () for g in c})
    lower = keyed.select("doc_id", "text_key", F.lower("text").alias("_lower"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("_lower"), g))
    return lower.select("doc_id", "text_key", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc_id, text_key, rules): the indexed rules whose clauses' postings meet in the document."""
    held = index.groupBy("doc_id", "text_key").agg(F.collect_set("trigram").alias("_held"))
    tests = []
    for rule in rules:
        if query := trigram_query(rule.pattern):
            met = reduce(lambda a, b: a | b, (_all_of(F.col("_held"), clause) for clause in query))
            tests.append(F.when(met, F.lit(rule.kind)))
    found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return held.select("doc_id", "text_key", found.alias("rules")).where(F.size("rules") > 0)


_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a variable of a higher-order function."""
    return F.transform(F.array(value), body)[0]


RUN = 256  # values that are appended one by one; longer arrays are put together from such runs


def _running(values: Column, zero: Column, step) -> Column:
    """For each value the fold of those before it and, last, of all, by an associative ``step`` with ``zero``.

    Appending to an array copies it, so runs of ``RUN`` values are folded by themselves and then
    moved on by the fold of all runs before: an array of n values costs n * RUN + (n / RUN)**2 copies.
    """

    def fold(items):
        return F.aggregate(items, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def over(v):
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        part = lambda i: F.transform(F.sequence(i * RUN + 1, F.least(i * RUN + RUN, F.size(v))), lambda j: F.element_at(v, j))
        inner = F.transform(starts, lambda i: fold(part(i)))
        return _let(inner, lambda runs: _let(fold(F.transform(runs, lambda r: F.element_at(r, -1))), lambda base: moved(runs, base)))

    def moved(runs, base):
        heads = F.flatten(F.transform(runs, lambda r, i: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: step(F.element_at(base, i + 1), x))))
        return F.concat(heads, F.array(F.element_at(base, -1)))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.array(zero)).otherwise(over(v)))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, end, kind), in code points."""
    size = lambda column: F.transform(column, lambda x: F.length(x).cast("long"))
    matches = size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
    counted = size(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))) if rule.group else matches
    gaps = size(F.split(text, rule.pattern, -1))
    zero = F.lit(0).cast("long")
    # what a match moves on by: the gap before it and itself
    found = F.zip_with(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("size"))), counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (c >= rule.least).alias("good")))
    found = F.filter(found, lambda x: x["size"].isNotNull())

    def placed(items):
        ends = _running(F.transform(items, lambda x: x["gap"] + x["size"]), zero, lambda a, x: a + x)
        one = lambda x, end: F.struct((end - x["size"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), x["good"].alias("good"))
        rows = _let(ends, lambda e: F.transform(items, lambda x, i: one(x, F.element_at(e, i + 2))))
        return F.transform(F.filter(rows, lambda x: F.coalesce(x["good"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

    return _let(found, placed).cast(f"array<{_SPAN}>")


def scan(spark: SparkSession, documents: DataFrame, rules=RULES, space: Workspace | None = None, name: str = "spans") -> DataFrame:
    """The rows of ``documents`` with the column ``name``: array of (start, rank, end, kind), by start and rule.

    A column of that name in ``documents`` is an error; name another one then.
    """
    space = space or Workspace(spark, "secrets")
    names = documents.columns
    if name.lower() in [n.lower() for n in names]:
        raise ValueError(f"documents have a column {name}")
    texts = documents.select(
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64("text").alias("_key"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    index = space.table(postings(keyed, rules), "postings")
    found = space.table(candidates(index, rules), "candidates")
    same = texts["_id"].eqNullSafe(found["doc_id"]) & (texts["_key"] == found["text_key"])
    rows = texts.join(found, same, "left").select("_row", "_text", "rules")
    parts = []
    for rank, rule in enumerate(rules):
        test = F.col("_text").rlike(rule.pattern)
        if trigram_query(rule.pattern):
            test = F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), rule.kind) & test
        parts.append(F.when(test, spans(F.col("_text"), rule, rank)).otherwise(F.array().cast(f"array<{_SPAN}>")))
    rows = rows.select("_row", F.array_sort(F.concat(*parts)).alias("_spans"))
    return rows.select(*[F.col(f"_row.`{n}`").alias(n) for n in names], F.col("_spans").alias(name))


def listed(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as 'kind:start:end' joined by commas."""
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[number(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(scanned: DataFrame, mark: str = "[SECRET]", name: str = "spans") -> DataFrame:
    """Replaces the union of all spans in ``text``; ``n_chars`` follows where there is such a column.

    Characters are four bytes each while pieces are cut, so that a piece costs its own length.
    """
    text, zero = F.col("text"), F.lit(0).cast("long")

    def cut(wide, start, end):
        return F.decode(F.substring(wide, (4 * start + 1).cast("int"), (4 * (end - start)).cast("int")), "UTF-32")

    def joined(wide):
        # ``seen``: how far all spans before one reach
        seen = _running(F.transform(name, lambda x: x["end"]), zero, lambda a, x: F.greatest(a, x))
        rows = lambda r: F.transform(name, lambda x, i: F.struct(x["start"].alias("start"), F.element_at(r, i + 1).alias("seen")))
        fresh = lambda r: F.filter(rows(r), lambda x: x["start"] >= x["seen"])
        pieces = lambda r: F.transform(fresh(r), lambda x: F.concat(cut(wide, x["seen"], x["start"]), F.lit(mark)))
        tail = lambda r: cut(wide, F.element_at(r, -1), F.octet_length(wide) / 4)
        return _let(seen, lambda r: F.concat(F.array_join(pieces(r), ""), tail(r)))

    done = _let(F.encode(text, "UTF-32"), joined)
    out = scanned.withColumn("text", F.when(F.size(name) > 0, done).otherwise(text))
    if "n_chars" in scanned.columns:
        kind = dict(scanned.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(name)
