from collections import Counter

import pytest

from skein.operators import evaluation as E
from skein.plans import evaluation, graph, history, lexical, relational


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as a driver's folder does: rows, schema by name."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_graph_holds_all_orders(spark, tables):
    orders = [(k, k % 3) for k in (1, 2999, 3000, 3001, 90000)]
    lines = [(k, p, 0.1 * (i % 2)) for i, (k, _) in enumerate(orders) for p in (1, 2 + i)]
    sf = tables(orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_partkey long, l_discount double"), customer=([(c, 3) for c in range(3)], "c_custkey long, c_nationkey long"))
    expected = {(f"o{k}", f"p{p}") for k, p, _ in lines} | {(f"c{c}", f"o{k}") for k, c in orders} | {("n3", f"c{c}") for c in range(3)}
    assert {(r.src, r.dst) for r in graph.edges(spark, sf).collect()} == expected
    assert {r.node: r.degree for r in graph.degree(spark, sf).collect()} == Counter(x for e in expected for x in e)
    assert {r.src for r in graph.references(spark, sf).collect()} == {f"o{k}" for k, _ in orders}
    assert {r.node for r in graph.impact(spark, sf).collect()} == {f"o{k}" for k, _ in orders} | {f"c{c}" for _, c in orders}


def test_resampling_reads_all_events(spark, tables):
    events = [(i, "m", 100.0 if i >= 2000 else 20.0) for i in (*range(15), *range(2000, 2015))]
    sf = tables(events=(events, "event_id long, event_type string, value double"))
    low, high = evaluation.bootstrap_ci(spark, sf).first()[1:]
    assert 20 < low < 60 < high < 100
    row = evaluation.permutation_test(spark, sf).first()
    assert row.delta == 10 and abs(row.p * 2001 - round(row.p * 2001)) < 1e-9
    rows = spark.createDataFrame([(i, "m", v) for i, _, v in events], "id long, event_type string, value double")
    assert [low, high] == list(E.bootstrap(rows, "event_type", "value", 2000).first()[1:])


def test_vector_searches_ask_every_fiftieth(spark, tables):
    rows = [(i, [float((i * 7) % 11), float((i * 5) % 13) / 8]) for i in range(640)]
    rows += [(700, None), (701, [None, 1.0]), (702, [1.0])]
    sf = tables(embeddings=(rows, "vec_id long, embedding array<double>"))
    asked, whole = [i for i, _ in rows if i % 50 == 0], [(i, v) for i, v in rows if i < 700]
    dense = {(q, i): round(sum(x * y for x, y in zip(rows[q][1], v)), 6) for q in asked if q < 700 for i, v in whole if i != q}
    got = {(r.query_id, r.place): (r.vec_id, r.score) for r in lexical.dense_topk(spark, sf).collect()}
    assert {q for q, _ in got} == set(asked)
    for q in asked[:-1]:
        best = sorted((i for a, i in dense if a == q), key=lambda i: (-dense[q, i], i))[:10]
        assert [got[q, p] for p in range(1, 11)] == [(i, dense[q, i]) for i in best]
    fused = lexical.rrf_fusion(spark, sf).collect()
    assert {r.query_id for r in fused} == set(asked)
    assert {r.doc_id for r in fused if r.query_id == 300} >= {i for i in range(285, 316) if i != 300}


def test_modulo_keeps_whole_sides(spark, tables):
    # case 2: twenty unjudged orders stand above 21, so it is beyond the depth of 20
    orders = [(k, 1, 100.0 - i, "P", "S") for i, k in enumerate((5, 1, 3, 10, 6))]
    orders += [(k, 2, 1000.0 - k, "P2", "S2") for k in range(1000, 1100, 5)] + [(21, 2, -1000.0, "P2", "S2"), (9, 3, 1.0, "P3", "S3")]
    sf = tables(
        orders=(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string"),
        documents=([(i, f"text {i}", "en", "src1" if i < 5 else "src9") for i in range(11)], "doc_id long, text string, lang string, source string"),
    )
    assert {r.case_id: r.bpref for r in evaluation.bpref(spark, sf).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
    merged = {r.id: r.evidence for r in history.merged_relations(spark, sf).collect()}
    assert merged.keys() == {1, -1, 2, -2, 3, -3} and (merged[1], merged[-1], merged[3], merged[-3]) == ("S6|S10", "S1|S3|S5", "P3", "S39") and merged[-2].startswith("S221|S21005|")
    # documents 0 to 4 are cached under the profile of their language, asked for under that of their id
    assert {r.doc_id: r.reused for r in relational.vector_reuse(spark, sf).collect()} == {i: i < 5 and i % 2 == 0 for i in range(11)}
