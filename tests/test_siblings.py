"""Files of brace languages in one pass: what windows over a file say, without a file in memory."""

import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import brackets as B
from skein.operators import siblings as S

TEXTS = [
    ("a", "rust", "pub(crate) fn f<T>(x: T) -> T {\n  g::<T>(x); h(1)\n}\nstruct P(i32);\nconst C: u8 = { 1 };\n#[a(b)] extern \"C\" fn é() { k(\"}\") }"),
    ("b", "typescript", "class A {\n  static async go(x: { a: 1 }) { this.x(new B<C>(1)) }\n  n(): void;\n}\ntype T = { a: 1 }\ntype U =\n  | 'a'\nfunction* g() {}"),
    ("c", "go", "type T struct { a int }\nfunc (t *T) M(x int) { go func(a int) { w(a) }(3) }\ntype U int"),
    ("d", "java", "@A class C { @B int m(int x) { return n(x); } C() { } abstract int s(); } interface I { int k(); "),
    ("e", "go", "} f(1) } func g() { h(2) "),
    ("n", "rust", None),
]


def test_one_pass_says_what_windows_say(spark):
    files = spark.createDataFrame(TEXTS, "path string, language string, text string")
    table = B.bracket_table(files)
    whole = B._with_neighbours(table).select("path", "n", "token", "parent", "start", "line", "begins", "prev1", "prev2", "prev3", "next1", F.col("next_kind") == "name", "run_start", "run_line", F.col("stop.n"), F.col("stop.token"), F.col("stop.close"))
    said = {r[:2]: r[2:] for r in map(tuple, whole.collect())}
    got = B.siblings(files).collect()
    assert len(got) == 38
    for r in got:
        one = (r.token, r.parent, r.start, r.line, r.begins, r.prev1, r.prev2, r.prev3, r.next1, r.named, r.run_start, r.run_line)
        assert one == said[r.path, r.n][:12]
        assert r.stop_n is None or (r.stop_n, r.stop_token, r.stop_close) == said[r.path, r.n][12:]
    found = B.units(files, signatures=False)
    names = {(r.path, r.unit): r.name for r in found.collect()}
    assert "signature" not in found.columns and {(p, n) for (p, _), n in names.items()} == {("a", "f"), ("a", "P"), ("a", "C"), ("a", "é"), ("b", "A"), ("b", "go"), ("b", "n"), ("b", "T"), ("b", "U"), ("b", "g"), ("c", "T"), ("c", "M"), ("c", "U"), ("d", "C"), ("d", "m"), ("d", "s")}
    calls = {(r.path, names.get((r.path, r.caller)), r.name) for r in B.calls(files, B.siblings(files), found).collect()}
    assert {("a", "f", "g"), ("a", "f", "h"), ("a", "é", "k"), ("b", "go", "x"), ("c", "M", "w"), ("e", None, "f")} <= calls and ("a", None, "a") not in calls


def test_a_file_is_never_held(monkeypatch):
    part = ["fn", " ", "f", "(", "x", ")", " ", "{", "g", "(", "x", ")", ";", "}", "\n", "struct", " ", "S", " ", "{", "}", "\n"]
    read, waiting = [], []
    again = S._File.read

    def seen(self, tokens):
        again(self, tokens)
        read.append(len(tokens))
        waiting.append(sum(len(x) for g in self.stack for x in (g.young, g.stop, g.semicolon, g.line, g.close)))

    monkeypatch.setattr(S._File, "read", seen)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 64), pa.array(["rust"] * 64), pa.array([part * 10] * 64)], ["path", "language", "tokens"])
    given = S.siblings(iter([batch] * 200))
    first = next(given)
    assert first.num_rows >= S.GIVEN and len(read) < 12800 / 2  # rows are given long before the file ends
    assert first.num_rows + sum(b.num_rows for b in given) == 4 * 10 * 12800
    assert max(waiting) < 10


def test_intervals_are_placed_in_one_pass():
    spans = [("a", 0, 9), ("a", 1, 5), ("a", 2, 3), ("a", 3, 5), ("a", 5, 9), ("a", 12, 14), ("b", 2, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*spans)], ["path", "start_byte", "end_byte"])
    (got,) = S.numbered([batch])
    assert got.column("parent").to_pylist() == [None, 0, 1, 1, 0, None, None] and got.column("unit").to_pylist() == [0, 1, 2, 3, 4, 5, 0]
    marks = [("a", 0, 9, 0, None), ("a", 0, 1, None, "f"), ("a", 4, 6, 1, None), ("a", 5, 6, None, "g"), ("a", 6, 7, None, "h"), ("a", 9, 10, None, "i")]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*marks)], ["path", "at", "end", "unit", "name"])
    assert [(r["name"], r["caller"]) for b in S.placed([batch]) for r in b.to_pylist()] == [("f", 0), ("g", 1), ("h", 0), ("i", None)]
