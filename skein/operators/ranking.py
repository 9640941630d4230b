"""Fusion, diversification, budgets and interleaving of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import Workspace, union

RRF_K = 60


def reciprocal_rank_fusion(routes: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, routes) from (query_id, route, weight, doc_id, rank); ties within 1e-9 go by id."""
    part = F.col("weight") / (RRF_K + F.col("rank"))
    fused = routes.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"), F.array_sort(F.collect_set("route")).alias("routes"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return fused.withColumn("rank", place.cast("long"))


def _ordered(key: str, order: list[str], columns: list[str]):
    return F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))


def merge_candidates(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, strict, routes, snippet, address) of hits (query_id, doc_id, n, contribution, strict, route, snippet, address).

    ``n`` is the order in which hits came in. A document sums its contributions, is strict if any hit was, lists its routes as they came,
    keeps the longest snippet, the earlier of equally long ones, and the address of its first hit. Null snippets are empty.
    """
    text = F.coalesce("snippet", F.lit(""))
    by_route = hits.groupBy("query_id", "doc_id", "route").agg(
        F.sum("contribution").alias("s"), F.max("strict").alias("strict"), F.min(F.struct("n", "address")).alias("first"), F.max(F.struct(F.octet_length(text).alias("size"), (-F.col("n")).alias("n"), text.alias("text"))).alias("longest")
    )
    # from here on a row for each route of a document
    routes = F.transform(F.array_sort(F.collect_list(F.struct("first.n", "route"))), lambda x: x["route"])
    out = by_route.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 12).alias("score"), F.max("strict").alias("strict"), routes.alias("routes"), F.max("longest")["text"].alias("snippet"), F.min("first")["address"].alias("address"))
    return out


TIE = 1e-9


def fused_order(candidates: DataFrame) -> DataFrame:
    """Adds ``rank``: scores with their bonus in steps of ``TIE``, then the strength of the flow, then the seeds it came from, then the document.

    Columns bonus, strength and origins count as zero where they are null.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(0))
    order = [F.floor((F.col("score") + value("bonus")) / TIE).desc(), value("strength").desc(), value("origins").desc(), F.col("doc_id").asc()]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def per_group_cap(ranked: DataFrame, key: str, group: str, item: str, limit: int, *carry: str, region: str | None = None, exact: str | None = None, routes: str | None = None) -> DataFrame:
    """Greedy choice in rank order: one per group among the first five chosen, two until ten, then three.

    Skipped rows take no place and don't come back. Rows where ``exact`` holds are chosen whatever their group has, and
    count in it; so are rows without a group, which count nowhere. Of the rows of one ``region`` (of a group) one is chosen; ``routes`` (an array) of
    later rows of a chosen region, up to the last row that is chosen, are added to its own, in order.

    In each of the three phases a group gives its first rows behind the phase before, so a phase is a ranking
    within groups and one within keys; no list of rows is ever collected. Each phase is a written table, read
    by the next ones.
    """
    space = Workspace(ranked.sparkSession, "cap")
    names = list(dict.fromkeys([key, "rank", item, group, *carry, *[c for c in (region, exact, routes) if c]]))
    order, phases, behind = ["rank", item], [], None
    rows = ranked.select(*names)
    free = F.coalesce(F.col(exact), F.lit(False)) if exact else F.lit(False)
    rows = rows.withColumn("_exact", free | F.col(group).isNull())
    rows = rows.withColumn("_region", F.coalesce(F.col(region).cast("string"), F.concat_ws("/", "rank", item)) if region else F.concat_ws("/", "rank", item))
    for cap, done, upto in ((1, 0, 5), (2, 5, 10), (3, 10, limit)):
        need = min(upto, limit) - done
        if need <= 0:
            break
        left, used = rows, None
        if phases:
            # only keys whose phase before was filled go on, behind its last row
            left = left.join(behind, key).where(F.struct("rank", item) > F.col("_last")).drop("_last")
            before = union(*phases)
            used = before.groupBy(key, group).agg(F.count("*").alias("_used"))
            left = left.join(before.select(F.col(key).alias("_key"), F.col(group).alias("_g"), F.col("_region").alias("_r")), (F.col(key) == F.col("_key")) & F.col(group).eqNullSafe(F.col("_g")) & (F.col("_region") == F.col("_r")), "left_anti")
            left = left.join(used, [key, group], "left")
        left = left.withColumn("_used", F.coalesce("_used", F.lit(0))) if used is not None else left.withColumn("_used", F.lit(0))
        # the first row of a region, or, if the group is full there, its first exact row
        in_region = Window.partitionBy(key, group, "_region").orderBy(*order)
        left = left.withColumn("_n", F.row_number().over(in_region)).withColumn("_e", F.sum(F.col("_exact").cast("int")).over(in_region.rowsBetween(Window.unboundedPreceding, 0)))
        left = left.where("_n = 1 OR (_exact AND _e = 1)")
        place = F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(Window.partitionBy(key, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        fits = F.col("_exact") | (F.col("_used") + F.col("_p") <= cap)
        left = left.withColumn("_p", place).where(fits).withColumn("_n", F.row_number().over(in_region)).where("_n = 1")
        chosen = left.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= need)
        chosen = space.table(chosen.drop("_n", "_e", "_p", "_used").withColumn("_k", F.col("_k") + done), f"phase-{cap}")
        phases.append(chosen)
        behind = chosen.groupBy(key).agg(F.max(F.struct("rank", item)).alias("_last"), F.count("*").alias("_m")).where(F.col("_m") == need).drop("_m")
    out = union(*phases)
    if routes:
        last = out.groupBy(key).agg(F.max(F.struct("rank", item)).alias("_last"), F.max("_k").alias("_m"))
        end = F.when(F.col("_m") >= limit, F.struct("rank", item) <= F.col("_last")).otherwise(True)
        again = rows.join(last, key).where(end).select(key, group, "_region", F.struct("rank", item).alias("_at"), F.posexplode(F.coalesce(routes, F.array().cast("array<string>"))).alias("_i", "_route"))
        kept = out.select(F.col(key).alias("_key"), F.col(group).alias("_g"), F.col("_region").alias("_r"), F.struct("rank", item).alias("_from"))
        again = again.join(kept, (F.col(key) == F.col("_key")) & F.col(group).eqNullSafe(F.col("_g")) & (F.col("_region") == F.col("_r")) & (F.col("_at") >= F.col("_from")))
        once = again.groupBy("_key", "_g", "_r", "_route").agg(F.min(F.struct("_at", "_i")).alias("_first"))  # a row for each route of a chosen row
        lists = once.groupBy("_key", "_g", "_r").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_route"))), lambda x: x["_route"]).alias("_routes"))
        out = out.join(lists, (F.col(key) == F.col("_key")) & F.col(group).eqNullSafe(F.col("_g")) & (F.col("_region") == F.col("_r")), "left").withColumn(routes, F.coalesce("_routes", F.array().cast("array<string>")))
    return out.select(key, item, group, *[c for c in names if c in carry and c != group], *([routes] if routes and routes not in carry else []), F.col("_k").cast("long").alias("place"))


def pack_budget(ranked: DataFrame, key: str, item: str, cost: str, budget: int, *carry: str) -> DataFrame:
    """Greedy packing in rank order; what doesn't fit is passed over and spends nothing. ``used`` is what a key spent in all.

    The rows of a key stream past in order with one sum, so that a list of any length takes no memory. A null cost never fits.
    """
    columns = list(dict.fromkeys([key, item, cost, *carry]))
    rows = ranked.select(*columns, F.col("rank").alias("_rank")).repartition(key).sortWithinPartitions(key, "_rank", item)

    def run(batches):
        import pyarrow as pa

        now, used = object(), 0
        for batch in batches:
            good, spent = [], []
            for k, c in zip(batch.column(key).to_pylist(), batch.column(cost).to_pylist(), strict=True):
                if k != now:
                    now, used = k, 0
                fits = c is not None and used + c <= budget
                used += c if fits else 0
                good.append(fits)
                spent.append(used)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(spent, pa.int64())], [*columns, "used"])
            yield out.filter(pa.array(good, pa.bool_()))

    fields = ranked.select(*columns).schema.add("used", "long")
    packed = rows.mapInArrow(run, fields)
    return packed.withColumn("used", F.max("used").over(Window.partitionBy(key)))


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def round_robin(lists: DataFrame, lane: str, order: list[Column], limit: int) -> DataFrame:
    """First of each lane, then second of each, by lane name; only ``limit`` rows per lane are ranked."""
    placed = lists.withColumn("place", F.row_number().over(Window.partitionBy(lane).orderBy(*order)).cast("long")).where(F.col("place") <= limit)
    return placed.orderBy("place", lane).limit(limit)


def structural_bonus(name_match: Column, same_file: Column, same_package: Column, days: Column, signature: Column) -> Column:
    recency = F.least(F.lit(0.2), 0.2 * F.pow(F.lit(2.0), -F.greatest(days, F.lit(0)) / 90))
    points = F.when(name_match, 0.5).otherwise(0) + F.when(same_file, 0.25).otherwise(0) + F.when(same_package, 0.15).otherwise(0)
    return (points + recency + F.when(signature, 0.1).otherwise(0)) / RRF_K
