"""Query plans, gates and verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Filters:
    language: str | None = None
    path: str | None = None
    kind: str | None = None
    pattern: str | None = None


_FILTER = re.compile(r"""(?<!\S)(lang|path|type|pat):(?:'([^']*)'|"([^"]*)"|(\S+))(?!\S)""")


def parse_filters(query: str) -> tuple[str, Filters]:
    """Takes lang:, path:, type:, pat: and patterntype:structural out of a query; unknown keys and empty values stay in the text."""
    found = Filters()
    names = {"lang": "language", "path": "path", "type": "kind", "pat": "pattern"}

    def take(match: re.Match) -> str:
        value = next((x for x in match.groups()[1:] if x is not None), "")
        if not value or match[1] == "type" and value not in ("diff", "commit", "file"):
            return match[0]
        setattr(found, names[match[1]], value.lower() if match[1] == "lang" else value)
        return ""

    text = " ".join(_FILTER.sub(take, query).split())
    structural = [w for w in text.split() if w == "patterntype:structural"]
    if structural:
        # the rest of the query is the pattern, unless one is given
        text = " ".join(w for w in text.split() if w != "patterntype:structural")
        if found.pattern is None and text:
            found.pattern, text = text, ""
    return text, found


#: Which routes an intent plans, which graph policy it follows and which witness its subject needs.
PLANS = {
    "exact_entity": (("exact", "lexical"), None, "definition"),
    "natural_language_behavior": (("exact", "lexical", "dense", "structural"), "opportunistic", "mention"),
    "issue_localization": (("exact", "lexical", "dense", "structural"), "opportunistic", "mention"),
    "precise_dataflow": (("exact", "lexical", "structural"), "dataflow", "relation"),
    "trace": (("exact", "lexical", "dense", "structural"), "outgoing", "relation"),
    "impact": (("exact", "lexical", "structural"), "incoming", "relation"),
    "architecture": (("lexical", "knowledge"), None, "relation"),
    "history": (("history", "diff", "lexical"), None, "history"),
}


def planned(queries: DataFrame) -> DataFrame:
    """(query_id, routes, policy, required) from (query_id, intent); an unknown intent is an error."""
    error = F.raise_error(F.concat(F.lit("no plan for "), F.coalesce("intent", F.lit("null"))))
    routes, policy, need = error.cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (r, p, w) in PLANS.items():
        test = F.col("intent") == name
        routes = F.when(test, F.array(*map(F.lit, r))).otherwise(routes)
        policy, need = F.when(test, F.lit(p)).otherwise(policy), F.when(test, F.lit(w)).otherwise(need)
    return queries.select("query_id", routes.alias("routes"), policy.alias("policy"), need.alias("required"))


def witness_gates(queries: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(query_id, gate): the gate that makes a query abstain, or null.

    ``queries`` (query_id, required, temporal) and its subjects' ``witnesses`` (query_id, term, defined, edges,
    history): a query abstains if it has subjects and none has the witness that it requires. What asks only
    about the past isn't refuted by what is there now.
    """
    seen = witnesses.groupBy("query_id").agg(F.max("defined").alias("d"), F.max("edges").alias("e"), F.max("history").alias("h"))
    rows = queries.join(seen, "query_id", "left")
    lacks = lambda need, column: (F.col("required") == need) & (F.col(column) == 0)
    gate = F.when(lacks("definition", "d") & ~F.col("temporal"), "definition").when(lacks("relation", "e") & ~F.col("temporal"), "relation").when(lacks("history", "h"), "history")
    return rows.select("query_id", gate.alias("gate"))


def witness_report(terms: DataFrame, names: DataFrame, mentions: DataFrame, relations: DataFrame, history: DataFrame) -> DataFrame:
    """(term, defined, mentions, edges, kinds, history): what is known of each term.

    ``names`` (term, entity_id): entities that a term names, the first 8 count. ``mentions`` (term, path): the
    first 5 paths. ``relations`` (src, kind): edges of those entities. ``history`` (term, doc_id): the first 8.
    """

    def first(rows: DataFrame, column: str, k: int, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("term").orderBy(column))
        few = rows.select("term", column).distinct().withColumn("n", place).where(F.col("n") <= k)
        return few.groupBy("term").agg(F.array_sort(F.collect_list(column)).alias(name))

    defined = first(names, "entity_id", 8, "defined")
    edges = defined.select("term", F.explode("defined").alias("src")).join(relations, "src").groupBy("term", "kind").agg(F.count("*").alias("n"))
    edges = edges.groupBy("term").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list("kind")).alias("kinds"))
    rows = terms.select("term").distinct()
    for frame in (defined, first(mentions, "path", 5, "mentions"), edges, first(history, "doc_id", 8, "history")):
        rows = rows.join(frame, "term", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c)
    return rows.select("term", none("defined"), none("mentions"), F.coalesce("edges", F.lit(0)).alias("edges"), none("kinds"), none("history"))


def binding_artifacts(hits: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, path, terms, class, scope, test): artifacts that hold two terms of a claim or more, from (query_id,
    term, path, entity_id, class, test). Of a path the entity that binds most stands for it, else the whole file.
    """
    unit = hits.where("entity_id IS NOT NULL").groupBy("query_id", "path", "class", "test", "entity_id").agg(F.countDistinct("term").alias("terms"))
    best = unit.where("terms > 1").groupBy("query_id", "path").agg(F.max(F.struct("terms", F.lit("entity").alias("scope"), "class", "test")).alias("b"))
    whole = hits.groupBy("query_id", "path").agg(F.countDistinct("term").alias("terms"), F.max("class").alias("class"), F.bool_and("test").alias("test")).where("terms > 1")
    rows = whole.join(best, ["query_id", "path"], "left")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(c)).alias(c)
    rows = rows.select("query_id", "path", pick("terms"), pick("class"), F.coalesce("b.scope", F.lit("file")).alias("scope"), pick("test"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("terms"), "scope", "path"))
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place")


def weak_reasons(claims: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(query_id, reasons): why an answer is weak, from (query_id, subjects, undefined, edgeless, terms, gaps, required) and artifacts."""
    code, unit = F.col("class") == "code", F.col("scope") == "entity"
    bound = artifacts.groupBy("query_id").agg(F.max(code & unit & ~F.col("test")).alias("good"), F.max(code & unit & F.col("test")).alias("in_test"), F.max(code).alias("in_code"))
    rows = claims.join(bound, "query_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    binds = F.when(F.col("good").isNull(), "unbound").when(true("in_test"), "test_only").when(true("in_code"), "file_scope").otherwise("prose_only")
    reasons = F.array(
        F.when(F.col("undefined") > 0, "undefined_subject"),
        F.when((F.col("terms") >= 2) & ~true("good"), binds),
        F.when((F.col("terms") > 0) & (F.col("gaps") == F.col("terms")), "no_hit_carries_terms"),
        F.when((F.col("required") == "relation") & (F.col("edgeless") > 0), "edgeless_subject"),
    )
    return rows.select("query_id", F.array_compact(reasons).alias("reasons"))


def drill_downs(candidates: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, query, reason, place): follow-up queries from (query_id, kind, term, dir, path, reason), in a fixed order, each once."""
    kinds = {"commit": 0, "diff": 1, "mention": 2, "gap": 3, "edgeless": 4, "file": 5}
    order = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    term, within = F.col("term"), F.concat(F.lit("path:"), F.col("dir"), F.lit(" "), F.col("term"))
    text = (
        F.when(F.col("kind") == "commit", F.concat(F.lit("type:commit "), term)).when(F.col("kind") == "diff", F.concat(F.lit("type:diff "), term))
        .when(F.col("kind") == "mention", within).when(F.col("kind") == "gap", F.coalesce(within, term)).when(F.col("kind") == "file", F.concat(F.lit("path:"), F.col("path"), F.lit(" "), term)).otherwise(term)
    )
    rows = candidates.select("query_id", text.alias("query"), order.alias("o"), "term", "reason").where("query IS NOT NULL")
    once = rows.groupBy("query_id", "query").agg(F.min(F.struct("o", "term", "reason")).alias("r"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("r.o", "r.term", "query"))
    return once.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("query_id", "query", "r.reason", "place")


def delivery(hits: DataFrame, packed: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, included, omitted, delivered, missing, witness): what a pack delivered of its hits and of the claim's terms.

    ``hits`` (query_id, doc_id, snippet, path), ``packed`` (query_id, doc_id), ``terms`` (query_id, term). Only shipped snippets count.
    """
    mark = packed.select("query_id", "doc_id", F.lit(True).alias("in"))
    rows = hits.join(mark, ["query_id", "doc_id"], "left")
    sums = rows.groupBy("query_id").agg(F.count("in").alias("included"), F.count_if(F.col("in").isNull()).alias("omitted"), F.max(F.col("in").isNotNull() & F.col("path").isNotNull()).alias("sourced"))
    met = terms.join(rows.where("in").select("query_id", "snippet"), "query_id").where(F.contains(F.lower("snippet"), F.lower("term"))).select("query_id", "term").distinct()
    both = terms.select("query_id", "term").distinct().join(met.withColumn("met", F.lit(True)), ["query_id", "term"], "left")
    said = both.groupBy("query_id").agg(F.count("met").alias("delivered"), F.count_if(F.col("met").isNull()).alias("missing"))
    out = sums.join(said, "query_id", "left")
    return out.select("query_id", "included", "omitted", F.coalesce("delivered", F.lit(0)).alias("delivered"), F.coalesce("missing", F.lit(0)).alias("missing"), F.when(F.col("sourced"), "not_verified").otherwise("no_source_evidence").alias("witness"))


#: Roles that keep a place in a pack, in the order in which they are served.
ROLES = ("test", "contract", "caller", "config", "history", "knowledge")


def context_role(representation: Column, route: Column, path: Column) -> Column:
    """The role of a hit, by what it represents, how it was found and where it is."""
    config = F.coalesce(path.rlike(r"(?i)\.(toml|yaml|yml|lock)$") | path.rlike(r"(^|/)package\.json$"), F.lit(False))
    out = F.when(representation == "test_behavior", "test").when(representation == "commit_summary", "history")
    out = out.when(representation.isin("role_summary", "module_summary", "flow_summary", "knowledge_page"), "knowledge")
    return out.when(route == "structural", "caller").when(representation == "signature", "contract").when(config, "config").otherwise("target")


def context_pack(hits: DataFrame, budget: int, orientation: int = 0, per_file: int = 4) -> DataFrame:
    """(query_id, doc_id, place, reason): hits that ship, in order, and why the others don't.

    ``hits`` (query_id, rank, doc_id, role, path, span, entity_id, tokens), a bounded list per query. The first hit
    of each role is tried first, then all in rank order. A hit is refused for a range that shipped, a
    fifth range of a file, an entity without a place that shipped, or the budget; refusals use nothing up.
    """
    item = F.struct("rank", "doc_id", "role", "path", "span", "entity_id", "tokens")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    of_role = lambda role: F.try_element_at(F.filter("all", lambda x: x["role"] == role), F.lit(1))
    lists = lists.select("query_id", F.concat(F.array_compact(F.array(*map(of_role, ROLES))), "all").alias("tries"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    kind = dict(hits.dtypes)
    zero = F.struct(F.lit(orientation).cast("long").alias("used"), none(kind["doc_id"]).alias("ids"), none("string").alias("spans"), none("string").alias("files"), none("string").alias("entities"), none(f"struct<doc_id:{kind['doc_id']},reason:string>").alias("log"))

    def step(acc, x):
        span = F.concat_ws("\x1f", x["path"], x["span"])
        why = (
            F.when(F.array_contains(acc["ids"], x["doc_id"]), "taken").when(x["path"].isNotNull() & F.array_contains(acc["spans"], span), "duplicate_range")
            .when(x["path"].isNotNull() & (F.size(F.filter(acc["files"], lambda p: p == x["path"])) >= per_file), "file_cap")
            .when(x["path"].isNull() & F.coalesce(F.array_contains(acc["entities"], x["entity_id"]), F.lit(False)), "duplicate_entity")
            .when(acc["used"] + x["tokens"] > budget, "budget")
        )
        add = lambda name, value, test: F.when(test, F.concat(acc[name], F.array(value))).otherwise(acc[name]).alias(name)
        good, placed = why.isNull(), x["path"].isNotNull()
        used = F.when(good, acc["used"] + x["tokens"]).otherwise(acc["used"]).cast("long").alias("used")
        log = F.struct(x["doc_id"].alias("doc_id"), why.alias("reason"))
        return F.struct(used, add("ids", x["doc_id"], good), add("spans", span, good & placed), add("files", x["path"], good & placed), add("entities", x["entity_id"], good & x["entity_id"].isNotNull()), add("log", log, ~F.coalesce(why == "taken", F.lit(False))))

    done = lists.select("query_id", F.aggregate("tries", zero, step).alias("r"))
    shipped = done.select("query_id", F.posexplode("r.ids").alias("p", "doc_id")).select("query_id", "doc_id", (F.col("p") + 1).cast("long").alias("place"), F.lit(None).cast("string").alias("reason"))
    # a hit that was refused for its role and shipped later counts as shipped; the last refusal is the reason
    refused = done.select("query_id", "r.ids", F.posexplode("r.log").alias("p", "x")).where("x.reason IS NOT NULL").where(~F.array_contains("ids", F.col("x.doc_id")))
    last = refused.groupBy("query_id", F.col("x.doc_id").alias("doc_id")).agg(F.max_by("x.reason", "p").alias("reason"))
    return shipped.unionByName(last.select("query_id", "doc_id", F.lit(None).cast("long").alias("place"), "reason"))


def absence_veto(anchor_frequencies: DataFrame) -> DataFrame:
    """(query_id, abstain): a query abstains if it has literal anchors and none occurs anywhere."""
    return anchor_frequencies.groupBy("query_id").agg((F.max("df") == 0).alias("abstain"))


def verdicts(hits: DataFrame, gates: DataFrame) -> DataFrame:
    """(query_id, state): abstained without hits or by a gate, weak_witness without strict hits, else answered."""
    seen = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("strict").alias("strict"))
    rows = gates.join(seen, "query_id", "left")
    state = F.when(F.col("abstain") | F.coalesce(F.col("n") == 0, F.lit(True)), "abstained").when(~F.coalesce("strict", F.lit(False)), "weak_witness").otherwise("answered")
    return rows.select("query_id", state.alias("state"))


def claim_coverage(matches: DataFrame) -> DataFrame:
    """(doc_id, terms, bonus) from (doc_id, term): up to three distinct claim terms count."""
    rows = matches.groupBy("doc_id").agg(F.countDistinct("term").alias("terms"))
    return rows.withColumn("bonus", F.round(F.least("terms", F.lit(3)) * 0.2 / 60, 9))
