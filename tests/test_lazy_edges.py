"""Sorted edges are built by the end that is asked for."""

from skein.operators import graphs


def test_walk_against_the_edges_needs_no_table_by_source(spark):
    frame = spark.createDataFrame([("a", "p", "calls", 0.9), ("b", "a", "calls", 0.8), ("c", "b", "imports", 0.7)], "src string, dst string, kind string, confidence double")
    asked = []

    def of(name, rows):
        return lambda: asked.append(name) or rows

    sides = graphs.SortedEdges(of("src", frame), of("dst", frame.orderBy("dst")), of("degree", graphs.degrees(frame)), spark)
    seeds = spark.createDataFrame([("p", 1.0)], "node string, score double")
    got = graphs.expand_by("incoming", sides, seeds).collect()
    assert sorted(got) == sorted(graphs.expand_by("incoming", frame, seeds).collect()) and len(got) == 2
    assert sorted(asked) == ["degree", "dst"]
