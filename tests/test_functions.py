import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors
from skein.operators.evidence import parse_filters


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_identifiers(spark):
    assert one(spark, T.identifier_terms(F.lit("setViewStatus"))) == ["set", "status", "view"]
    assert one(spark, T.identifier_terms(F.lit("HTTPServer"))) == ["httpserver"]
    assert one(spark, T.folded(F.lit("set_view_status"))) == "setviewstatus"
    assert one(spark, T.trigrams(F.lit("abcd"))) == ["abc", "bcd"]
    assert one(spark, T.trigrams(F.lit("ab"))) == []


def test_paths_and_lines(spark):
    assert [one(spark, T.document_class(F.lit(p))) for p in ("a.MDX", "b.rs", "Makefile")] == ["prose", "code", "code"]
    assert one(spark, T.line_count(F.lit(""))) == 0
    assert one(spark, T.line_count(F.lit("a\nb"))) == 2
    assert one(spark, T.line_at(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(spark, T.estimated_tokens(F.lit("f(x);"))) == 3


def test_chunks_cover_the_text(spark):
    text = "one\ntwo three\nfour five six seven\n" * 3
    bounds = one(spark, T.chunk_bounds(F.lit(text), 20))
    assert bounds[0].start == 0 and bounds[-1].end == len(text)
    assert all(a.end == b.start for a, b in zip(bounds, bounds[1:])) and all(0 < x.end - x.start <= 20 for x in bounds)


def test_vectors(spark):
    assert one(spark, vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "doc_id long, words array<string>")
    for r in vectors.hash_embedding(rows, 32).collect():
        assert abs(sum(x * x for x in r.vector) - (r.doc_id < 3)) < 1e-9 and len(r.vector) == 32
    for bad in ([], [0.0], [float("nan")], [float("inf")], [None]):
        with pytest.raises(Exception, match="normalised"):
            spark.createDataFrame([(bad,)], "v array<double>").select(vectors.normalised(F.col("v"))).collect()


def test_query_filters():
    text, f = parse_filters("stale views lang:Rust path:crates/store http://x")
    assert (text, f.language, f.path) == ("stale views http://x", "rust", "crates/store")
    assert parse_filters("a:b lang: path:")[0] == "a:b lang: path:"
    text, f = parse_filters("pat:'fn $F($$$A) { $$$B }' lang:rust auth flow")
    assert (text, f.pattern) == ("auth flow", "fn $F($$$A) { $$$B }")
