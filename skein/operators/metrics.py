"""Metrics of ranked line ranges against gold ranges, facts and components, and their summaries.

Tables: ``cases`` (case_id, no_context), ``gold`` (case_id, unit, path, start, end), ``files`` (case_id,
path), ``judged`` (case_id, path) and ``results`` (case_id, rank, path, start, end, ...), one row per cited
range. Everything is joined by case and path, so that no case meets another one.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import union


def first_items(results: DataFrame, k: int) -> DataFrame:
    """Cited ranges of the first ``k`` items of each case: an item takes one place, however many ranges it cites."""
    place = F.dense_rank().over(Window.partitionBy("case_id").orderBy("item"))
    return results.withColumn("place", place).where(F.col("place") <= k)


def spent_tokens(packs: DataFrame, items: DataFrame) -> DataFrame:
    """(case_id, tokens): what a pack says it used, else the sum over its items; null for results that are no pack."""
    sums = items.groupBy("case_id").agg(F.sum("tokens").alias("summed"))
    rows = packs.join(sums, "case_id", "left")
    return rows.select("case_id", F.when(F.col("kind") == "context", F.coalesce("used", "summed")).alias("tokens"))


def _share(part, whole, empty):
    return F.when(whole > 0, part / whole).otherwise(empty)


def range_metrics(cases: DataFrame, gold: DataFrame, files: DataFrame, judged: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: recall, file_recall, file_success, file_hit, unjudged_rate, decoy_rate, line_density, citation_correctness.

    A case without context wants no results at all; one without gold ranges falls back to files.
    """
    paths = union(files.select("case_id", "path"), gold.select("case_id", "path")).distinct()
    seen = results.groupBy("case_id", "path").agg(F.count("*").alias("hits"))
    covered = gold.alias("g").join(results.alias("r"), ["case_id", "path"]).where("g.start <= r.end AND r.start <= g.end")
    ranges = gold.groupBy("case_id").agg(F.count("*").alias("units"))
    met = covered.groupBy("case_id").agg(F.countDistinct("unit").alias("met"))
    wanted = paths.join(seen, ["case_id", "path"], "left").groupBy("case_id").agg(F.count("*").alias("paths"), F.count("hits").alias("found"))
    known = union(judged.select("case_id", "path"), paths).distinct()
    verdict = seen.join(known.withColumn("known", F.lit(True)), ["case_id", "path"], "left").join(paths.withColumn("good", F.lit(True)), ["case_id", "path"], "left")
    verdict = verdict.groupBy("case_id").agg(
        F.sum("hits").alias("n"), F.sum(F.when(F.col("known").isNull(), F.col("hits")).otherwise(0)).alias("unknown"),
        F.sum(F.when(F.col("known").isNotNull() & F.col("good").isNull(), F.col("hits")).otherwise(0)).alias("decoys"),
    )
    size = F.col("end") - F.col("start") + 1
    lines = results.groupBy("case_id").agg(F.sum(size).alias("lines"), F.avg(F.col("verified").cast("double")).alias("citations"))
    shared = covered.groupBy("case_id").agg(F.sum(F.least("g.end", "r.end") - F.greatest("g.start", "r.start") + 1).alias("shared"))
    whole = results.join(files.distinct(), ["case_id", "path"], "left_semi").groupBy("case_id").agg(F.sum(size).alias("whole"))
    rows = cases.select("case_id", "no_context")
    for frame in (ranges, met, wanted, verdict, lines, shared, whole):
        rows = rows.join(frame, "case_id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    none, blank = F.col("n").isNull(), F.col("no_context")
    file_recall = F.when(zero("paths") > 0, zero("found") / F.col("paths")).otherwise((blank & none).cast("double"))
    relevant = F.when(zero("units") > 0, zero("shared")).otherwise(zero("whole"))
    out = {
        "recall": F.when(blank, none.cast("double")).when(zero("units") > 0, zero("met") / F.col("units")).otherwise(file_recall),
        "file_recall": file_recall,
        "file_success": F.when(zero("paths") > 0, (zero("found") == F.col("paths")).cast("double")).otherwise(none.cast("double")),
        "file_hit": F.when(zero("paths") > 0, (zero("found") > 0).cast("double")).otherwise((blank & none).cast("double")),
        "unjudged_rate": F.when(none | blank, 0.0).otherwise(F.col("unknown") / F.col("n")),
        "decoy_rate": F.when(none, 0.0).when(blank, 1.0).otherwise(F.col("decoys") / F.col("n")),
        "line_density": _share(F.least(relevant, F.col("lines")), zero("lines"), blank.cast("double")),
        "citation_correctness": F.coalesce("citations", F.lit(1.0)),
    }
    return rows.select("case_id", *[F.round(column, 9).alias(name) for name, column in out.items()])


def symbol_recall(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, symbol_recall) of the cases that have gold symbols, from (case_id, symbol) twice."""
    hits = gold.distinct().join(results.select("case_id", "symbol").distinct().withColumn("hit", F.lit(1)), ["case_id", "symbol"], "left")
    return hits.groupBy("case_id").agg(F.round(F.count("hit") / F.count("*"), 9).alias("symbol_recall"))


def claim_support(facts: DataFrame, evidence: DataFrame, symbols: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, supported, undecidable, legacy) from facts (case_id, fact), their evidence ranges and their symbols.

    A fact holds by an overlapping range, or by one of its symbols on a path of its evidence. A fact without
    evidence can't be decided. ``legacy`` also takes a symbol anywhere.
    """
    key = ["case_id", "fact"]
    ranged = evidence.alias("e").join(results.alias("r"), ["case_id", "path"]).where("e.start <= r.end AND r.start <= e.end").select(*key).distinct().withColumn("by_range", F.lit(True))
    named = symbols.join(results.select("case_id", "symbol", "path").distinct(), ["case_id", "symbol"])
    scoped = named.join(evidence.select(*key, "path").distinct(), [*key, "path"], "left_semi").select(*key).distinct().withColumn("by_scope", F.lit(True))
    loose = named.select(*key).distinct().withColumn("by_name", F.lit(True))
    located = evidence.select(*key).distinct().withColumn("located", F.lit(True))
    rows = facts.select(*key).distinct()
    for frame in (located, ranged, scoped, loose):
        rows = rows.join(frame, key, "left")
    true = lambda name: F.coalesce(F.col(name), F.lit(False))
    good = F.count_if(true("located") & (true("by_range") | true("by_scope")))
    n = F.count_if(true("located"))
    return rows.groupBy("case_id").agg(
        F.round(F.when(n > 0, good / n), 9).alias("supported"), F.count_if(~true("located")).alias("undecidable"),
        F.round(F.count_if(true("by_range") | true("by_name")) / F.count("*"), 9).alias("legacy"),
    )


def component_metrics(gold: DataFrame, results: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(case_id, component_recall_at_k ..., component_mrr) from (case_id, component) and (case_id, rank, component)."""
    wanted = gold.distinct()
    first = results.where("component IS NOT NULL").groupBy("case_id", "component").agg(F.min("rank").alias("rank"))
    rows = wanted.join(first, ["case_id", "component"], "left")
    at = [F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 9).alias(f"component_recall_at_{k}") for k in cutoffs]
    return rows.groupBy("case_id").agg(*at, F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 9).alias("component_mrr"))


def abstention(cases: DataFrame) -> DataFrame:
    """One row from (case_id, cluster, abstained, no_context, state, tokens, budget): shares over cluster means."""
    flags = {"accuracy": F.col("abstained") == F.col("no_context"), "answered": F.col("state") == "answered", "weak_witness": F.col("state") == "weak_witness", "abstained_share": F.col("state") == "abstained", "compliant": F.col("tokens") <= F.col("budget")}
    mean = cases.groupBy("cluster").agg(F.avg(F.col("abstained").cast("double")).alias("p"), F.avg(F.col("no_context").cast("double")).alias("y"), *[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])
    precision = F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("y")) / F.sum("p")).otherwise(1.0)
    wrong = F.when(F.sum("y") > 0, F.sum((1 - F.col("p")) * F.col("y")) / F.sum("y")).otherwise(0.0)
    return mean.agg(F.count("*").alias("clusters"), F.round(precision, 9).alias("no_context_precision"), F.round(wrong, 9).alias("false_positive_rate"), *[F.round(F.avg(n), 9).alias(n) for n in flags])


def collapsed(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, value): one mean per cluster, so that variants of one case count once."""
    return values.groupBy(*keys, "cluster").agg(F.avg("value").alias("value"))


def grouped_means(values: DataFrame) -> DataFrame:
    """(grp, metric, clusters, mean): overall, by intent and by tag, from (metric, cluster, value, intent, tags)."""
    groups = F.concat(F.array(F.lit("all"), F.concat(F.lit("intent/"), "intent")), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag/"), t)))
    rows = collapsed(values.withColumn("grp", F.explode(groups)), ["grp", "metric"])
    return rows.groupBy("grp", "metric").agg(F.count("*").alias("clusters"), F.round(F.avg("value"), 9).alias("mean"))


def intent_scores(predicted: DataFrame) -> DataFrame:
    """(intent, recall, precision) from (intent, predicted); a class that is never predicted has no precision."""
    both = predicted.groupBy("intent", "predicted").agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("intent") == F.col("predicted"), F.col("n")).otherwise(0))
    recall = both.groupBy("intent").agg((hit / F.sum("n")).alias("recall"))
    precision = both.groupBy(F.col("predicted").alias("intent")).agg((F.sum(F.when(both.intent == both.predicted, F.col("n")).otherwise(0)) / F.sum("n")).alias("precision"))
    return recall.join(precision, "intent", "full_outer").select("intent", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def detectable(pairs: DataFrame, key: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """(key, n, mde): the least mean difference that a paired test of this size would show, from (key, delta)."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    rows = pairs.groupBy(key).agg(F.count("delta").alias("n"), F.stddev_samp("delta").alias("s"))
    return rows.select(key, "n", F.round(F.lit(z) * F.col("s") / F.sqrt("n"), 6).alias("mde"))


def ablated(results: DataFrame) -> DataFrame:
    """(route, case_id, item, rank): for each route, what is left without what it alone brought, renumbered."""
    each = results.groupBy("case_id", "item").agg(F.min("rank").alias("rank"), F.collect_set("route").alias("routes"))
    routes = results.select("route").distinct()  # a handful
    left = each.join(F.broadcast(routes)).where(~((F.size("routes") == 1) & F.array_contains("routes", F.col("route"))))
    place = F.row_number().over(Window.partitionBy("route", "case_id").orderBy("rank", "item"))
    return left.select("route", "case_id", "item", place.cast("long").alias("rank"))


def agreement(results: DataFrame, k: int) -> DataFrame:
    """(case_id, pairs, agreement): mean overlap of the first ``k`` items of a case's variants, by shared over united items."""
    top = results.where(F.col("rank") <= k).groupBy("case_id", "variant").agg(F.collect_set("item").alias("items"))
    pairs = top.alias("a").join(top.alias("b"), "case_id").where("a.variant < b.variant")
    share = F.size(F.array_intersect("a.items", "b.items")) / F.size(F.array_union("a.items", "b.items"))
    return pairs.groupBy("case_id").agg(F.count("*").alias("pairs"), F.round(F.avg(share), 9).alias("agreement"))


def judged_with(judged: DataFrame, decisions: DataFrame) -> DataFrame:
    """(case_id, item, relevant): judgments with later decisions applied; a decision replaces what was there."""
    both = union(judged.withColumn("_at", F.lit(0)), decisions.withColumn("_at", F.lit(1)))
    return both.groupBy("case_id", "item").agg(F.max_by("relevant", "_at").alias("relevant"))


def dataset_lint(cases: DataFrame, gold: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, problem): gold on paths that don't exist, ranges beyond a file or backwards, queries asked twice."""
    known = gold.join(files, "path", "left")
    problem = F.when(F.col("lines").isNull(), "missing_path").when((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("lines")), "bad_range")
    bad = known.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")
    twice = cases.join(cases.groupBy("query").agg(F.count("*").alias("n"), F.min("case_id").alias("first")).where("n > 1"), "query").where("case_id <> first")
    return union(bad, twice.select("case_id", F.lit("duplicate_query").alias("problem"))).distinct()


def position_sensitivity(results: DataFrame, gold: DataFrame, permutations: int = 20, seed: str = "0", k: int = 10) -> DataFrame:
    """(metric, mean, spread, cases): what MRR and nDCG of results (case_id, item) are under shuffles, and how far they differ within a case.

    Each case's list is shuffled by a digest of seed, shuffle, case and item, so that a lost task gives the same again. The spread is the mean
    over cases of the standard deviation over shuffles. Gold is (case_id, item); cases without gold count nowhere.
    """
    known = gold.select("case_id", "item").distinct().withColumn("good", F.lit(1))
    wanted = known.groupBy("case_id").agg(F.count("*").alias("wanted"))
    rows = results.select("case_id", "item").distinct().join(known, ["case_id", "item"], "left").withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("shuffle").cast("string"), F.col("case_id").cast("string"), F.col("item").cast("string")))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "shuffle").orderBy(digest, "item")))
    gain = F.when((F.col("good") == 1) & (F.col("place") <= k), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    each = placed.groupBy("case_id", "shuffle").agg(F.coalesce(1 / F.min(F.when(F.col("good") == 1, F.col("place"))), F.lit(0.0)).alias("mrr"), F.sum(gain).alias("gain")).join(wanted, "case_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("wanted", F.lit(k))), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    each = each.select("case_id", F.explode(F.create_map(F.lit("mrr"), F.col("mrr"), F.lit("ndcg"), F.col("gain") / ideal)).alias("metric", "value"))
    case = each.groupBy("case_id", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return case.groupBy("metric").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("spread"), 6).alias("spread"), F.count("*").alias("cases"))


def replay_audit(recorded: DataFrame, again: DataFrame, every: int) -> DataFrame:
    """(case_id, change) of a seeded sample of cases whose recorded result isn't what it is now, from (case_id, digest)."""
    test = F.conv(F.left(F.md5(F.col("case_id").cast("string")), F.lit(8)), 16, 10).cast("long") % every == 0
    both = recorded.where(test).withColumnRenamed("digest", "old").join(again.where(test).withColumnRenamed("digest", "new"), "case_id", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed")
    return both.select("case_id", change.alias("change")).where("change IS NOT NULL")


def exposition(counters: DataFrame) -> DataFrame:
    """(line): counters (name, label, value) in the text format of metric scrapers, in order."""
    line = F.concat(F.col("name"), F.lit('{label="'), F.regexp_replace("label", r'(["\\\\])', r"\\$1"), F.lit('"} '), F.col("value").cast("long").cast("string"))
    return counters.select(line.alias("line"))
