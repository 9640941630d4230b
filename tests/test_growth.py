"""Steps whose work grows with the input, not with its square."""

import re

from pyspark.sql import functions as F

from skein.operators import brackets as B
from skein.operators import code as C


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_shrinks(spark):
    files = spark.createDataFrame([("a", "rust", "fn f(&self, x: i32) -> i32 { g(x); }")], "path string, language string, text string")
    plan = plan_of(B._with_neighbours(B.bracket_table(files)))
    assert "RowFrame" in plan
    assert not re.search(r"RowFrame, (currentrow\$\(\)|-?\d+), unboundedfollowing", plan)


def test_texts_are_looked_up_by_blocks(spark):
    text = "añb€" * 1500 + "end"
    data = text.encode()
    files = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, text string")
    spots = [(0, 0), (0, 8), (2047, 2047), (2040, 2056), (0, len(data)), (len(data) - 3, len(data)), (9, 4)]
    spans = spark.createDataFrame([("a", k, a, b) for k, (a, b) in enumerate(spots)], "path string, k int, a long, b long")
    got = {r.k: r.cut for r in B.texts_at(spans, files, F.col("a"), F.col("b")).collect()}
    assert got == {k: data[a:b].decode(errors="replace") for k, (a, b) in enumerate(spots)}
    found = spark.createDataFrame([("a", "rust", "struct S;")], "path string, language string, text string")
    assert "data#" not in plan_of(B.units(found))  # the rows carry no whole texts


def test_runs_of_tokens_are_those_of_the_whole_text(spark):
    text = 'fn f() { let s = "} // {"; /* { */ g(a[1]); }\n' * 200 + "(("
    files = spark.createDataFrame([("a", "rust", text), ("b", "go", "x y z"), ("c", "go", "//"), ("d", "java", "a { ( } )"), ("e", "go", "{" * 600 + "}" * 600)], "path string, language string, text string")
    tokens = B.bracket_table(files.where("path = 'a'")).orderBy("n").collect()
    assert tokens[-1].end == len(text) and len(tokens) == 200 * 19 + 2
    assert all(text[r.start : r.end] == r.token for r in tokens)
    whole = sorted(map(tuple, B.balance(B.bracket_table(files)).collect()))
    assert whole == sorted(map(tuple, B.balance(B.bracket_table(files, only_brackets=True)).collect()))
    assert dict(whole) == {"a": False, "b": True, "d": False, "e": True}


def test_doc_comments_meet_the_lines_near_them(spark):
    rows = ["# far", *["x = 1"] * 70, "", "# one", "# two", "@d", "class A:", "    # in", "    def f(self):", *["        pass"] * 60, *["#"] * 70, "def g(): pass"]
    files = spark.createDataFrame([("a", "\n".join(rows)), ("b", "# top\ndef h(): pass"), ("c", "# x\ry = 1\r# z\rdef k(): pass")], "path string, text string")
    parsed = C.units(files)
    whole = parsed.join(files.select("path", F.split("text", "\n", -1).alias("lines")), "path").select("path", "unit", C.doc_comment(F.col("lines"), F.col("start_line")).alias("doc"))
    got = C.doc_comments(parsed, files)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert {r.doc for r in got.where("path = 'a' AND unit < 2").collect()} == {"one two", "in"}


def test_candidates_of_imports_are_not_broadcast(spark):
    files = spark.createDataFrame([("src/a", "python", "import os\nfrom x import y")], "path string, language string, text string")
    known = spark.createDataFrame([("x.py",), ("x.py",)], "path string")
    found = C.resolved_imports(C.import_candidates(C.imports(files)), known)
    assert "LeftSemi" in plan_of(found)
    assert [tuple(r) for r in found.collect()] == [("src/a", "x", "x.py")]


def test_replay_audit_covers_all_cases(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["replay_audit"](spark, "/root/testdata/sf0.001")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    k, changed = F.col("o_orderkey"), (F.col("o_orderkey") % 10 == 3) & (F.col("o_orderstatus") != "X")
    a, b = k % 7 != 0, k % 11 != 0
    assert got.count() == orders.where((a != b) | (a & b & changed)).count()


def test_a_test_meets_two_targets_of_a_name(spark):
    tests = spark.createDataFrame([(1, "test_a_b"), (2, "a"), (7, "test_b"), (9, "test_c")], "id long, name string")
    targets = spark.createDataFrame([(2, "a"), (2, "a"), (5, "a"), (7, "b"), (3, "a_b"), (1, "a_b")], "id long, name string")
    found = C.test_pairs(tests, targets)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 0.65), (2, 5, 0.65)]
    many = spark.range(2000).select("id", F.lit("test_a").alias("name"))
    sized = C.test_pairs(many, many.select((F.col("id") + 1000).alias("id"), F.lit("a").alias("name")))
    assert sized.where("target_id = 1000").count() == 1999 and sized.where("test_id = 1000 AND target_id = 1001").count() == 1
    assert plan_of(found).count("min(id") == 3  # names meet tests once their targets are reduced


def test_units_meet_no_other_units_of_their_file(spark):
    rows = [("a", k, f"n{k}", None if k == 0 else k - 1 if k < 20 else 0) for k in range(40)]
    parsed = spark.createDataFrame(rows, "path string, unit int, name string, parent int").withColumns({"start_line": F.col("unit"), "end_line": F.lit(100) - F.col("unit")})
    names = C.qualified_names(parsed)
    assert not re.search(r"start_line#\d+ <= start_line", plan_of(names))
    got = {r.unit: r.qualified for r in names.collect()}
    assert got[19] == "::".join(["a", *(f"n{k}" for k in range(16))]) and got[3] == "a::n0::n1::n2::n3" and got[30] == "a::n0::n30" and len(got) == 40


def test_texts_are_parsed_in_pieces(monkeypatch):
    import ast

    import pyarrow as pa

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    def rows(run, texts):
        batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], ["path", "text"])
        return [tuple(r.values()) for b in run(iter([batch])) for r in b.to_pylist()]

    block = 'class A:\n    s = """\nclass B:\n"""\n    def f(self):\n        return g(self.h())\n@d(1)\nasync def k(): pass\nx = (1\n@ 2)\r\n'
    text = block * 4000
    sizes, parse, whole = [], ast.parse, ast.parse(text)
    monkeypatch.setattr(C.ast, "parse", lambda t: sizes.append(len(t)) or parse(t))
    units = rows(C.units(Files()), [text, text + "def (", None, "class Z: pass"])
    calls = rows(C.calls(Files()), [text])
    kinds = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)
    assert [(r[2], r[4], r[5]) for r in units if r[0] == "0"] == sorted(((n.name, n.lineno, n.end_lineno) for n in ast.walk(whole) if isinstance(n, kinds)), key=lambda x: x[1])
    assert {r[0] for r in units} == {"0", "3"} and units[4][6] == 3 and [r[1] for r in units[:-1]] == list(range(12000))
    assert sorted(r[3] for r in calls) == sorted(n.lineno for n in ast.walk(whole) if isinstance(n, ast.Call))
    assert sorted(sizes)[len(sizes) // 2] < 1 << 17


def test_a_region_meets_one_line(spark):
    import random

    r = random.Random(3)
    lines = [(r.choice("abc"), r.randrange(900)) for _ in range(60)] + [("a", None), ("z", 3)]
    regions = [(r.choice("abd"), k, s, s + r.choice([-1, 0, 1, 63, 64, 200])) for k in range(300) for s in [r.randrange(900)]]
    found = C.regions_of_lines(spark.createDataFrame(lines, "path string, line long"), spark.createDataFrame(regions, "path string, region_id int, start_line long, end_line long"))
    expected = set()
    for path in "abcdz":
        here = sorted((e - s, k) for p, k, s, e in regions if p == path and any(q == p and n is not None and s <= n <= e for q, n in lines))
        expected |= {(path, k, place + 1) for place, (_, k) in enumerate(here[:4])}
    assert {(x.path, x.region_id, x.place) for x in found.collect()} == expected
    assert not re.search(r"start_line#\d+L? <= line", plan_of(found))


def test_feedback_terms_build_no_index(spark, monkeypatch):
    import __spark_entry__
    from skein.operators.index import TextIndex

    monkeypatch.setattr(TextIndex, "of", lambda *a, **k: 1 / 0)
    assert __spark_entry__.queries()["feedback_terms"](spark, "/root/testdata/sf0.001").count() == 8


def test_ranges_with_the_same_ends_are_met_once(spark):
    from skein.operators.joins import smallest_enclosing

    points = spark.range(50).select(F.lit("a").alias("path"), F.col("id").alias("at"))
    ranges = spark.range(4000).select(F.lit("a").alias("path"), (F.lit(9000) - F.col("id")).alias("range_id"), (F.col("id") % 4 * 10).alias("start"), (F.col("id") % 4 * 10 + 15).alias("end"))
    found = smallest_enclosing(points, ranges, "path", 16)
    got = {r.at: (r.range_id, r.start, r.end) for r in found.collect()}
    first = {s: 9000 - max(i for i in range(4000) if i % 4 * 10 == s) for s in (0, 10, 20, 30)}
    assert got == {at: min((first[s], s, s + 15) for s in first if s <= at < s + 15) for at in range(45)}
    assert plan_of(found).count("Aggregate") == 2
