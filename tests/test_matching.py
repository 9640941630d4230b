"""Patterns in one pass from the end of a file: what is kept doesn't grow with the file."""

import re

from pyspark.sql import functions as F

from skein.operators import brackets as B
from skein.operators import matching as M


def test_a_file_is_never_held():
    known, out, sizes = [], [], []
    M.Sequence(B.template_items("fn $F(&self, $$$A) -> i32 { $$$B }"), False, known)
    file = M._File("a", known, out)
    tokens = re.findall(r"\s+|\w+|->|\S", "fn f(&self, x: i32) -> i32 { g(x); h }\nstruct S { y: i32 }\n")
    size = sum(map(len, tokens))
    for k in range(2000):
        file.read(tokens, size * (1999 - k), [])
        g = file.stack[-1]
        sizes.append((len(file.stack), len(g.nexts), len(g.chain) + len(g.fresh), max(len(w) for s in g.states for w in s.waiting)))
    file.end()
    assert len(out) == 2000 and sizes[10:] == sizes[10:11] * len(sizes[10:])
    assert [s["name"] for s in out[0][4]] == ["F", "A", "B"] and out[-1][1:4] == (0, 0, 38)


def test_brackets_that_close_nothing(spark):
    rows = [("a", "rust", "f(1) } f(2) ) { f(3) ] f(4"), ("b", "rust", "é { f(5, (6)) } f() f( [ f(7) }"), ("c", "rust", "} " * 700 + "f(8)" + "{ " * 700 + "f(9)")]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    got = B.pattern_matches(files, "f($X)").collect()
    assert sorted((r.path, r.match, r.names["X"]) for r in got) == [("a", "f(1)", "1"), ("a", "f(2)", "2"), ("a", "f(3)", "3"), ("b", "f(7)", "7"), ("c", "f(8)", "8"), ("c", "f(9)", "9")]
    data = {p: t.encode() for p, _, t in rows}
    assert all(data[r.path][r.start_byte : r.end_byte].decode() == r.match for r in got)
    assert "Window" not in M.matches(B._runs(files), F.split("text", ""), B.template_items("f($X)"))._jdf.queryExecution().optimizedPlan().toString()
