import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import code, evaluation, evidence, graphs, joins, lexical, lookups, ranking, snapshots
from skein.operators.index import TextIndex
from skein.sources import tables
from skein.streaming.monitors import Monitor, watch


def test_degree_counts_a_loop_once(spark):
    edges = spark.createDataFrame([("a", "a", "calls", 1.0), ("a", "b", "calls", 0.5)], "src string, dst string, kind string, confidence double")
    assert {r.node: r.degree for r in graphs.degrees(edges).collect()} == {"a": 2, "b": 1}
    assert [(r.src, r.dst) for r in graphs.top_edges(edges, 1).collect()] == [("a", "a")]


def test_impact_takes_least_hops(spark):
    edges = spark.createDataFrame([("b", "a", "calls", 1.0), ("c", "b", "calls", 1.0), ("c", "a", "tests", 1.0)], "src string, dst string, kind string, confidence double")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hops for r in graphs.impact(edges, start, ["calls", "tests"]).collect()} == {"b": 1, "c": 1}


def test_flow_does_not_turn_back(spark):
    edges = spark.createDataFrame([("a", "b", "calls", 1.0)], "src string, dst string, kind string, confidence double")
    seeds = spark.createDataFrame([("a", 1.0)], "node string, mass double")
    assert {r.node: r.mass for r in graphs.mass_flow(edges, seeds).collect()} == {"b": 0.4}


def test_longest_root_owns(spark):
    paths = spark.createDataFrame([("x/y/z",), ("x/q",), ("w",)], "path string")
    roots = spark.createDataFrame([("", "all"), ("x", "x"), ("x/y", "xy")], "root string, package string")
    assert {r.path: r.package for r in graphs.owners(paths, roots).collect()} == {"x/y/z": "xy", "x/q": "x", "w": "all"}


def test_lineage(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)] + [(2000, 3000), (2001, 2000)], "node long, parent long")
    assert {r.node: r.root for r in graphs.lineage_roots(rows).collect()} == {i: 0 for i in range(1000)} | {2000: 3000, 2001: 3000}
    with pytest.raises(ValueError, match="cycle"):
        graphs.lineage_roots(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node long, parent long"))


def test_cap_skips_without_deferring(spark):
    rows = spark.createDataFrame([(0, i + 1, "a" if i % 2 else f"b{i}", i) for i in range(12)], "q long, rank long, path string, item long")
    got = ranking.per_group_cap(rows, "q", "path", "item", 20).orderBy("place").collect()
    assert sum(r.path == "a" for r in got[:5]) == 1 and [r.place for r in got] == list(range(1, len(got) + 1))


def test_cap_is_the_greedy_choice(spark):
    import random

    rng = random.Random(3)
    rows = [(q, r, f"g{rng.choice((0, 0, 0, 1, 2, 3, 4, 5, 6, 7))}", r) for q in range(6) for r in range(rng.choice((4, 30, 80)))]
    for limit in (3, 7, 20):
        want = []
        for q in range(6):
            chosen = []
            for _, r, g, _ in sorted(x for x in rows if x[0] == q):
                cap = 1 if len(chosen) < 5 else 2 if len(chosen) < 10 else 3
                if len(chosen) < limit and sum(x == g for _, x in chosen) < cap:
                    chosen.append((r, g))
            want += [(q, r, g, n) for n, (r, g) in enumerate(chosen, 1)]
        frame = spark.createDataFrame(rows, "q long, rank long, path string, item long")
        got = ranking.per_group_cap(frame, "q", "path", "item", limit).select("q", "item", "path", "place").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_budget_passes_over(spark):
    rows = spark.createDataFrame([(0, 1, 1, 60), (0, 2, 2, 50), (0, 3, 3, 40)], "q long, rank long, item long, cost long")
    got = ranking.pack_budget(rows, "q", "item", "cost", 100).collect()
    assert sorted(r.item for r in got) == [1, 3] and got[0].used == 100


def test_round_robin_tolerates_short_lanes(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3)], "lane string, r long")
    assert [(r.lane, r.r) for r in ranking.round_robin(rows, "lane", [F.col("r")], 3).collect()] == [("a", 1), ("b", 1), ("b", 2)]


def test_smallest_enclosing_crosses_buckets(spark):
    ranges = spark.createDataFrame([("f", 1, 0, 1000), ("f", 2, 90, 130), ("g", 3, 0, 9)], "path string, range_id long, start long, end long")
    points = spark.createDataFrame([("f", 100), ("f", 129), ("f", 130), ("g", 50)], "path string, at long")
    assert {(r.at, r.range_id) for r in joins.smallest_enclosing(points, ranges, "path", 64).collect()} == {(100, 2), (129, 2), (130, 1)}


def test_resolution_prefers_the_own_file_and_halves_ambiguous(spark):
    import random

    rng = random.Random(4)
    calls = [(i, rng.choice("fgh"), rng.choice("abc")) for i in range(60)] + [(99, "none", "a")]
    targets = [(i, rng.choice("fg"), rng.choice("abd"), rng.random() < 0.5) for i in range(20)] + [(50, "h", "z", False)]
    want = set()
    for call, name, path in calls:
        known = [t for t in targets if t[1] == name]
        if known:
            best = min(known, key=lambda t: ({(True, True): 0, (False, True): 1, (True, False): 2, (False, False): 3}[t[2] == path, t[3]], t[0]))
            want.add((call, best[0], len(known), 0.45 if len(known) > 1 else 0.9))
    frame = spark.createDataFrame(targets, "target_id long, name string, there string, can boolean")
    got = joins.resolve(spark.createDataFrame(calls, "call_id long, name string, path string"), frame, lambda here: F.when(here & F.col("can"), 0).when(F.col("can"), 1).when(here, 2).otherwise(3))
    assert {tuple(r) for r in got.collect()} == want


def test_patterns_in_blocks(spark):
    from skein.operators.glossary import glossary_terms, pattern_hits

    texts = [(1, "abcabc b"), (2, ""), (3, None), (4, "漢字漢字"), (4, "b")]
    words = ["abc", "b", "bca", "漢", "字漢", "", None, "b"]
    frame, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "pattern string")
    want = sorted((i, w, sum(t.startswith(w, k) for k in range(len(t))), t.find(w)) for i, t in texts if t for w in set(words) if w and w in t)
    for block in (100, 2):
        assert sorted(map(tuple, pattern_hits(frame, table, block).collect())) == want
    known = spark.createDataFrame([("漢", ["one", "two"]), ("漢字", ["three"]), ("b", ["two"])], "pattern string, terms array<string>")
    assert {r.id: r.terms for r in glossary_terms(frame.where("id <> 4 OR text <> 'b'"), known, 2).collect()} == {1: ["two"], 4: ["three", "one"]}
    assert pattern_hits(frame, table.where("false")).collect() == []


def test_diff_pairs_equal_keys(spark):
    base = spark.createDataFrame([("k", 1, 0), ("k", 2, 1), ("x", 1, 2)], "key string, v long, id long")
    head = spark.createDataFrame([("k", 1, 0), ("k", 3, 1), ("k", 4, 2)], "key string, v long, id long")
    assert sorted((r.key, r.change) for r in snapshots.multiset_diff(base, head, ["key"], "v", "id").collect()) == [("k", "added"), ("k", "changed"), ("x", "removed")]


def test_verdicts(spark):
    gates = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "query_id long, abstain boolean")
    hits = spark.createDataFrame([(1, True), (1, False), (2, False), (4, True)], "query_id long, strict boolean")
    assert {r.query_id: r.state for r in evidence.verdicts(hits, gates).collect()} == {1: "answered", 2: "weak_witness", 3: "abstained", 4: "abstained"}


def test_ndcg_never_exceeds_one(spark):
    results = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3)], "case_id long, item long, rank long")
    gold = spark.createDataFrame([(1, 7), (1, 7)], "case_id long, item long")
    row = evaluation.mrr_ndcg(results, gold).first()
    assert row.mrr == 1.0 and row.ndcg == 1.0


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.createDataFrame([(i, "m", float(i % 10)) for i in range(400)], "id long, k string, v double")
    row = evaluation.bootstrap(rows, "k", "v", 200).first()
    assert 3.9 < row.low < 4.5 < row.high < 5.1


@pytest.fixture
def indexed(spark, tmp_path):
    def build(rows):
        frame = spark.createDataFrame(rows, "doc_id long, path string, name string, terms string, body string")
        return TextIndex.build(spark, frame, str(tmp_path / "index"))

    return build


def body(*texts):
    return [(i, f"p/{i}", None, None, t) for i, t in enumerate(texts, 1)]


def test_tokens_fold_letters_and_accents(spark):
    text = "\u00c9l\u00e8ve na\u00efve gr\u00f6\u00dfe \u6f22\u5b57 x_1 e\u0301 \u0419"
    want = ["eleve", "naive", "gro\u00dfe", "\u6f22\u5b57", "x_1", "e", "\u0438"]
    assert spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"))).first()[0] == want == T.python_tokens(text)


def test_resampling_agrees_with_theory(spark):
    """Replicates of a mean spread as its standard error does; flips of a clear difference are hardly ever as extreme."""
    import random

    rng = random.Random(5)
    values = [rng.gauss(10, 3) for _ in range(900)]
    rows = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)] + [(1, "none", None)], "id long, k string, v double").repartition(3)
    (row,) = evaluation.bootstrap(rows, "k", "v", 1000).collect()
    mean = sum(values) / 900
    assert abs((row.high - row.low) / (2 * 1.96 * 3 / 30) - 1) < 0.15 and abs((row.high + row.low) / 2 - mean) < 0.03
    again = evaluation.bootstrap(rows.repartition(1), "k", "v", 1000).first()
    assert abs(again.low - row.low) < 1e-9 and abs(again.high - row.high) < 1e-9
    deltas = spark.createDataFrame([(i, "far", 1.0 + 0.1 * (i % 3)) for i in range(40)] + [(i, "even", 1.0 if i % 2 else -1.0) for i in range(40)], "id long, metric string, delta double")
    got = {r.metric: r.p for r in evaluation.permutation(deltas, 500).collect()}
    assert got["far"] == 1 / 501 and got["even"] == 1.0


def test_cascade_is_strictest_first(indexed):
    index = indexed(body("alpha beta", "alphabet beta", "gamma", None))
    assert [(r.doc_id, r.stage) for r in lexical.cascade(index, ["alpha", "beta"], 10).orderBy("rank").collect()] == [(1, 0), (2, 1)]
    assert lexical.cascade(index, [], 10).count() == 0 and lexical.cascade(index, ["zzz"], 10).count() == 0
    assert [r.doc_id for r in lexical.cascade(index, ["alpha", "beta"], 1).collect()] == [1]  # no stage begins once there are enough


def test_cascade_of_mixed_scripts_and_pairs(indexed):
    index = indexed(body("alpha beta", "\u6f22\u5b57 alpha", "alphabet", "beta gamma delta", "delta epsilon", "gamma"))
    got = [(r.doc_id, r.stage) for r in lexical.cascade(index, ["\u6f22\u5b57", "alpha"], 10).orderBy("rank").collect()]
    assert got[0] == (2, 0) and {(1, 2), (3, 3)} <= set(got)
    # three terms make three pairs, one of which suffices; two terms have no floor
    assert {r.doc_id for r in lexical.cascade(index, ["beta", "gamma", "delta"], 10).collect()} == {4}
    assert {r.doc_id for r in lexical.cascade(index, ["gamma", "delta", "epsilon"], 10).collect()} == {4, 5}
    assert lexical.cascade(index, ["beta", "epsilon"], 10).count() == 0


def test_floor_drops_common_terms():
    terms = [f"t{i:02}" for i in range(14)]
    df = {i: 5 + i for i in range(14)} | {3: 4000, 5: 0}
    pairs = lexical.floor_of(df, terms, 10_000)
    assert len(pairs) == 66 and pairs[0] == (0, 1) and not {3, 5} & {i for p in pairs for i in p}
    assert lexical.floor_of({0: 9000, 1: 9000}, terms, 10_000) == [(0, 1)] and lexical.floor_of({}, ["a", "b"], 10) == []


def test_index_weighs_fields_and_is_found_again(spark, indexed, tmp_path):
    index = indexed([(1, "x", "alpha", None, "beta"), (2, "x", None, None, "alpha beta"), (3, "alpha/y", None, "b", "c"), (4, "z", "", "", "d"), (5, "z", "", "", "e"), (6, "z", "", "", "f"), (7, "z", "", "", "g")])
    assert [r.doc_id for r in lexical.bm25(index, ["alpha"]).orderBy(F.desc("score")).collect()] == [1, 3, 2]
    assert {r.doc_id for r in lexical.phrase(index, ["alpha", "beta"]).collect()} == {2}
    assert [r.path for r in lexical.mentions(TextIndex(spark, str(tmp_path / "index")), "alpha::beta").collect()] == ["x"]
    assert (index.n, {r.token: r.df for r in index.frequencies().collect()}["alpha"]) == (7, 3)


def test_snippet_shows_the_best_window(spark):
    text = "\u00c9t\u00e9 " + "w " * 40 + "alpha b\u00e9ta " + "v " * 40
    row = spark.createDataFrame([(text,)], "t string").select(lexical.snippet(F.col("t"), ["alpha", "beta"], 6)).first()
    assert row[0] == "\u2026 w w w w <mark>alpha</mark> <mark>b\u00e9ta</mark> \u2026"


def test_repository_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "id_rsa").write_text("k")
    rows = {r.path: r for r in tables.scan_repository(spark, str(tmp_path)).collect()}
    assert rows["src/a.py"].language == "python" and rows["src/a.py"].line_count == 3 and rows["src/a.py"].skip_reason is None
    assert rows["b.bin"].skip_reason == "binary" and rows["id_rsa"].skip_reason == "sensitive"


def test_monitor_reports_each_hit_once(spark, tmp_path):
    monitor = Monitor(spark, lambda df: df, str(tmp_path / "m"), ["id"])
    for n, ids in enumerate(([1, 2], [2, 3], [2, 3])):
        monitor(spark.createDataFrame([(i,) for i in ids], "id long"), n)
    monitor(spark.createDataFrame([(2,), (3,)], "id long"), 1)
    got = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(r.id for r in got.collect()) == [1, 2, 3]


def test_snapshots_are_replaced_and_served(spark, tmp_path):
    data, pointer = str(tmp_path / "data"), str(tmp_path / "pointer")
    frame = lambda rows: spark.createDataFrame(rows, "snapshot_id string, v long")
    tables.commit_snapshot(frame([("a", 1), ("b", 1)]), data, pointer)
    tables.commit_snapshot(frame([("b", 2)]), data)  # detached: written, not served
    assert {tuple(r) for r in spark.read.parquet(data).select("snapshot_id", "v").collect()} == {("a", 1), ("b", 2)}
    assert {r[0] for r in tables.served(spark, pointer).collect()} == {"a", "b"}
    for i in range(3):
        tables.commit_snapshot(frame([("b", 3 + i)]), data, pointer)
    assert {r[0] for r in tables.served(spark, pointer).collect()} == {"b"} and not list(tmp_path.glob("*draft*"))


def test_upserts_scans_and_trees(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, state string, version long")
    new = spark.createDataFrame([(2, "z", 2), (3, "w", 1)], "id long, state string, version long")
    assert {(r.id, r.state) for r in tables.upsert(old, new, ["id"], "version").collect()} == {(1, "x"), (2, "z"), (3, "w")}
    scan = spark.createDataFrame([("a", 1, 5, "h"), ("b", 2, 5, "h")], "path string, byte_count long, mtime long, digest string")
    cache = scan.where("path = 'a'")
    assert [r.path for r in tables.changed_since(scan, cache).collect()] == ["b"] and tables.update_scan_cache(cache, scan).count() == 2
    base = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, blob string")
    head = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, blob string")
    assert {(r.path, r.change) for r in snapshots.tree_diff(base, head).collect()} == {("a", "removed"), ("b", "modified"), ("d", "added")}
    row = spark.range(1).select(T.content_id("doc", F.lit("a"), F.lit("b")).alias("x"), T.line_at(F.lit("a\nb\nc"), F.lit(3)).alias("n")).first()
    assert row.x.startswith("doc:") and len(row.x) == 36 and row.n == 2


def test_watch_hands_on_each_batch(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(1,)], "v long").write.parquet(source)
    stream = spark.readStream.schema("v long").parquet(source)
    run = watch(stream, lambda df, n: seen.append((n, sorted(r.v for r in df.collect()))), str(tmp_path / "cp"), "1 second")
    run.processAllAvailable()
    spark.createDataFrame([(2,)], "v long").write.mode("append").parquet(source)
    run.processAllAvailable()
    run.stop()
    assert [v for _, v in seen] == [[1], [2]]


def test_context_pack_keeps_roles_and_refuses(spark):
    hits = [(1, "a", "target", "f", "1", "x", 40), (2, "b", "target", "f", "1", "y", 40), (3, "c", "test", "g", "1", "z", 40), (4, "d", "target", None, None, "x", 5), (5, "e", "target", "h", "1", "w", 90)]
    frame = spark.createDataFrame([(0, *h) for h in hits], "query_id long, rank long, doc_id string, role string, path string, span string, entity_id string, tokens long")
    got = {r.doc_id: (r.place, r.reason) for r in evidence.context_pack(frame, 100).collect()}
    assert got == {"c": (1, None), "a": (2, None), "b": (None, "duplicate_range"), "d": (None, "duplicate_entity"), "e": (None, "budget")}


def test_doc_comments_pass_over_attributes(spark):
    text = "// one\n# two\n#[derive]\n@deco\nfn x()\ncode\n\nfn y()"
    rows = spark.createDataFrame([(text,)], "t string").select(*[code.doc_comment(F.split("t", "\n"), F.lit(n)).alias(f"c{n}") for n in (5, 8, 1)]).first()
    assert tuple(rows) == ("one two", None, None)


def test_units_of_nested_code(spark):
    text = "class A:\n    def f(self):\n        def g():\n            return h(1)\n        return g()\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    assert {(r.name, r.kind, r.parent) for r in code.units(files).collect()} == {("A", "class", None), ("f", "method", 0), ("g", "function", 1)}
    assert {(r.name, r.caller) for r in code.calls(files).collect()} == {("h", 2), ("g", 1)}
    assert {r.qualified for r in code.qualified_names(code.units(files)).collect()} == {"a.py::A", "a.py::A::f", "a.py::A::f::g"}


def test_materialised_needs_a_known_generator(spark):
    docs = spark.createDataFrame([(1, "p", "slice/1", 1, 3), (2, "p", "whole/1", 0, 0)], "id long, path string, generated_by string, start int, end int")
    sources, artifacts = spark.createDataFrame([("p", "aé b")], "path string, text string"), spark.createDataFrame([(2, "whole")], "id long, text string")
    assert {r.id: r.body for r in lookups.materialised(docs, sources, artifacts).collect()} == {1: "é", 2: "whole"}
    with pytest.raises(Exception, match="unknown generator"):
        lookups.materialised(docs.withColumn("generated_by", F.lit("x/1")), sources, artifacts).collect()
