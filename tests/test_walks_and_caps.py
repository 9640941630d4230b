"""Greedy caps on shuffled frames and damped walks, against plain loops."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.operators import graphs, ranking


def greedy(rows, limit):
    """(item, routes) in order; rows are (rank, item, path, region, exact, routes)."""
    hits, used, kept = [], Counter(), {}
    for _, item, path, region, exact, routes in sorted(rows):
        if (path, region) in kept:
            mine = hits[kept[path, region]][1]
            mine += [r for r in routes if r not in mine]
            continue
        if path is not None:
            cap = 1 if len(hits) < 5 else 2 if len(hits) < 10 else 3
            if not exact and used[path] >= cap:
                continue
            used[path] += 1
        kept[path, region] = len(hits)
        hits.append((item, list(dict.fromkeys(routes))))
        if len(hits) >= limit:
            break
    return hits


@pytest.mark.parametrize("limit", [3, 7, 20])
def test_caps_exempt_exact_symbols_and_merge_regions(spark, limit):
    rng, rows = random.Random(limit), []
    for q in range(12):
        for rank in range(60):
            path = rng.choice(["a", "b", "c", "d", "e", "f", None]) if q % 3 else rng.choice("ab")
            rows.append((f"q{q}", rank, f"i{rank}", path, f"{path}-{rng.randrange(8)}", rng.random() < 0.2, rng.sample(["x", "y", "z"], rng.randrange(3))))
    frame = spark.createDataFrame(rows, "q string, rank long, item string, path string, region string, exact boolean, routes array<string>")
    # out of a shuffle on the key, as ranked lists come
    shuffled = frame.repartition(4, "q").groupBy("q", "rank", "item", "path", "region", "exact", "routes").agg(F.count("*").alias("n")).drop("n")
    got = defaultdict(list)
    for r in ranking.per_group_cap(shuffled, "q", "path", "item", limit, region="region", exact="exact", routes="routes").orderBy("q", "place").collect():
        assert r.place == len(got[r.q]) + 1
        got[r.q].append((r.item, r.routes))
    by_query = defaultdict(list)
    for q, *row in rows:
        by_query[q].append(tuple(row))
    assert dict(got) == {q: greedy(v, limit) for q, v in by_query.items()}


def test_caps_without_options_on_shuffled_frames(spark):
    rng = random.Random(1)
    rows = [(f"q{q}", rank, f"i{rank}", rng.choice("abcdefg")) for q in range(40) for rank in range(50)]
    frame = spark.createDataFrame(rows, "q string, rank long, item string, path string")
    ranked = frame.groupBy("q", "item", "path").agg(F.min("rank").alias("rank"))
    got = defaultdict(list)
    for r in ranking.per_group_cap(ranked, "q", "path", "item", 20).orderBy("q", "place").collect():
        got[r.q].append(r.item)
    for q in {r[0] for r in rows}:
        assert got[q] == [i for i, _ in greedy([(rank, i, p, i, False, []) for k, rank, i, p in rows if k == q], 20)]


def walk(edges, seeds, kinds, per_seed=24, frontier=4, starts=5):
    degree = Counter()
    for s, d, _, _ in edges:
        degree[s] += 1
        if d != s:
            degree[d] += 1
    front, visited, found = sorted(seeds, key=lambda x: (-x[1], x[0]))[:starts], set(), {}
    for hop in range(2):
        arrivals, place = [], 0
        for node, score in front:
            if node in visited:
                continue
            visited.add(node)
            mine = {(d, k, c) for s, d, k, c in edges if s == node} | {(s, k, c) for s, d, k, c in edges if d == node}
            for to, kind, c in sorted(mine, key=lambda x: (-x[2], x[0], x[1]))[:per_seed]:
                if kind in kinds:
                    spread = round(score * c * 0.5**hop / (1 + math.log(degree[to])), 9)
                    arrivals.append((-spread, place, -c, to, kind))
                    found[to, hop + 1] = max(found.get((to, hop + 1), 0), spread)
            place += 1
        front = [(to, -s) for s, _, _, to, _ in sorted(arrivals)[:frontier] if -s > 0.001]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_expansion_penalises_what_it_reaches_and_starts_nowhere_twice(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(30)}", f"n{int(rng.random() ** 2 * 30)}", rng.choice(["calls", "imports", "tests"])): rng.randrange(1, 9) / 10 for _ in range(220)}
    edges = [(s, d, k, c) for (s, d, k), c in edges.items()]
    seeds = [(f"n{i}", 1.0 - i / 10) for i in range(7)]
    frame = spark.createDataFrame(edges, "src string, dst string, kind string, confidence double").repartition(3)
    start = spark.createDataFrame(seeds, "node string, score double")
    want = walk(edges, seeds, ["calls", "tests"], per_seed=6)
    sides = graphs.SortedEdges(frame.orderBy("src"), frame.orderBy("dst"), graphs.degrees(frame))
    for graph in (frame, sides):
        got = {(r.node, r.hop): r.score for r in graphs.expand(graph, start, ["calls", "tests"], per_seed=6).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert graphs.expand(frame, start.where("false"), ["calls"]).collect() == []
