"""Tokens, units, calls and patterns of brace languages, against fixtures and a plain matcher."""

import random

import pytest

from skein.operators import brackets as B

RUST = '''// a { comment
use std::io;
#[derive(Debug)]
pub struct Point<T> { x: T, y: [u8; 4] }
struct Pair(i32, i32);
pub(crate) enum Kind { A, B(i32) }
const LIMIT: usize = 10;
mod inner {
    pub trait Shape { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
    impl Shape for super::Point<f64> {
        fn area(&self) -> f64 { let s = "} \\" {"; let c = '{'; compute::<f64>(self.x, s.len()) }
    }
}
pub async unsafe fn run<'a, const N: usize>(q: &'a str) -> Result<[u8; 2], String>
where
    T: Fn(i32) -> i32,
{
    let v = r#"raw " } "#;
    fn nested() { helper(); }
    println!("{}", q);
    Some(inner::twice(v)).map(|x| x.go())
}
pub const fn tiny() -> u8 { 1 }
mod tests;
'''
SCRIPT = '''import x from 'y';
export async function load(a: number, cb: () => void): Promise<void> {
  const f = function hidden() { return g(`t ${a} }`); };
  new Thing(a);
  return f.call(a);
}
abstract class Base { abstract no(): void; }
export class Store extends Base {
  private static items = make(1);
  @decorate(2)
  async get(key: string): { a: number } {
    return this.items.find(key);
  }
  set<T>(key: T) { this.put(key) }
}
interface Api { fetch(url: string): void; name: string; }
type Id = { a: string } | number;
type Wide =
  | 'a'
  | 'b'
function* gen() { yield step(); }
'''
GO = '''package main

type Server struct {
	mu sync.Mutex
}
type Handler func(a int) string

func (s *Server) Serve(x interface{}) (int, error) {
	go func(a int) int { return work(a) }(3)
	return fmt.Println("} {", `raw {`)
}

func main() { new(Server).Serve(nil) }
'''
JAVA = '''package a;
import b.C;
@Entity
public class Order extends Base<Item> {
    private final List<Item> items = List.of(new Item(1));
    public Order(int n) { super(n); init(); }
    @Override
    public List<Item> items() throws IOException { return copy(items); }
    abstract int size();
    enum State { NEW(1), OLD(2); State(int x) { store(x); } }
    static class Inner { void go() { new Order(2).items(); } }
}
interface Shape { double area(); }
'''


def parsed(spark, language, text):
    files = spark.createDataFrame([("f", language, text)], "path string, language string, text string")
    table = B.bracket_table(files)
    found = B.units(files, table)
    rows = sorted(found.collect(), key=lambda r: r.unit)
    names = {r.unit: r.name for r in rows}
    data = text.encode()
    units = [(r.kind, r.name, names.get(r.parent), r.start_line, r.end_line) for r in rows]
    spans = {r.name: data[r.start_byte : r.end_byte].decode() for r in rows}
    calls = sorted((r.start_byte, names.get(r.caller), r.name, data[r.start_byte : r.end_byte].decode()) for r in B.calls(files, table, found).collect())
    return units, spans, {r.name: r.signature for r in rows}, [c[1:3] for c in calls], table


def test_rust(spark):
    units, spans, signatures, calls, table = parsed(spark, "rust", RUST)
    assert units == [
        ("struct", "Point", None, 4, 4), ("struct", "Pair", None, 5, 5), ("enum", "Kind", None, 6, 6), ("constant", "LIMIT", None, 7, 7), ("module", "inner", None, 8, 13), ("trait", "Shape", "inner", 9, 9),
        ("function", "twice", "Shape", 9, 9), ("function", "area", "inner", 11, 11), ("function", "run", None, 14, 22), ("function", "nested", "run", 19, 19), ("function", "tiny", None, 23, 23), ("module", "tests", None, 24, 24),
    ]
    assert spans["Pair"] == "struct Pair(i32, i32);" and spans["LIMIT"] == "const LIMIT: usize = 10;" and spans["Kind"].startswith("pub(crate) enum Kind {")
    assert signatures["Pair"] == "struct Pair" and signatures["tiny"] == "pub const fn tiny() -> u8" and signatures["Point"] == "pub struct Point<T>"
    assert signatures["run"].startswith("pub async unsafe fn run<'a, const N: usize>") and signatures["run"].endswith("i32,")
    assert calls == [("twice", "area"), ("area", "compute"), ("area", "len"), ("nested", "helper"), ("run", "Some"), ("run", "twice"), ("run", "map"), ("run", "go")]
    assert [r.balanced for r in B.balance(table).collect()] == [True]


def test_scripts(spark):
    units, spans, signatures, calls, _ = parsed(spark, "typescript", SCRIPT)
    assert units == [
        ("function", "load", None, 2, 6), ("class", "Store", None, 8, 15), ("method", "get", "Store", 11, 13), ("method", "set", "Store", 14, 14), ("interface", "Api", None, 16, 16),
        ("method", "fetch", "Api", 16, 16), ("schema", "Id", None, 17, 17), ("schema", "Wide", None, 18, 20), ("function", "gen", None, 21, 21),
    ]
    assert signatures["load"] == "async function load(a: number, cb: () => void): Promise<void>" and signatures["get"] == "async get(key: string): { a: number }"
    assert spans["fetch"] == "fetch(url: string): void" and spans["Id"] == "type Id = { a: string } | number;"
    assert calls == [("load", "g"), ("load", "call"), ("Store", "make"), ("get", "find"), ("set", "put"), ("gen", "step")]


def test_go(spark):
    units, spans, signatures, calls, _ = parsed(spark, "go", GO)
    assert units == [("schema", "Server", None, 3, 5), ("schema", "Handler", None, 6, 6), ("method", "Serve", None, 8, 11), ("function", "main", None, 13, 13)]
    assert spans["Handler"] == "Handler func(a int) string" and signatures["Serve"] == "func (s *Server) Serve(x interface{}) (int, error)"
    assert calls == [("Serve", "work"), ("Serve", "Println"), ("main", "Serve")]


def test_java(spark):
    units, spans, signatures, calls, _ = parsed(spark, "java", JAVA)
    assert units == [
        ("class", "Order", None, 3, 12), ("method", "Order", "Order", 6, 6), ("method", "items", "Order", 7, 8), ("method", "size", "Order", 9, 9), ("enum", "State", "Order", 10, 10), ("method", "State", "State", 10, 10),
        ("class", "Inner", "Order", 11, 11), ("method", "go", "Inner", 11, 11), ("interface", "Shape", None, 13, 13), ("method", "area", "Shape", 13, 13),
    ]
    assert spans["items"].startswith("@Override\n    public List<Item> items()") and signatures["size"] == "abstract int size();"
    assert calls == [("Order", "of"), ("Order", "Item"), ("Order", "init"), ("items", "copy"), ("State", "store"), ("go", "Order"), ("go", "items")]


def test_unbalanced_files_are_told(spark):
    rows = [("a", "rust", "fn f() { (] }"), ("b", "rust", "fn f() { "), ("c", "rust", "} {"), ("d", "rust", "fn f() {}"), ("e", "rust", None), ("g", "python", "def f(: pass")]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    table = B.bracket_table(files)
    assert {r.path: r.balanced for r in B.balance(table).collect()} == {"a": False, "b": False, "c": False, "d": True}
    assert [r.name for r in B.units(files, table).where("path = 'd'").collect()] == ["f"]


# --- patterns ----------------------------------------------------------------


def nest(tokens):
    """Nested siblings of tokens: a bracket pair is its opening, its content and its closing."""
    stack = [[]]
    for k, t in enumerate(tokens):
        if t in B.OPEN:
            stack.append([])
        elif t in B.CLOSE:
            inside = stack.pop()
            stack[-1] += [(k - sum(1 for _ in flat(inside)) - 1, tokens[k - sum(1 for _ in flat(inside)) - 1], inside), (k, t, None)]
            continue
        else:
            stack[-1].append((k, t, None))
    return stack[0]


def flat(siblings):
    for k, t, inside in siblings:
        yield k
        if inside:
            yield from flat(inside)


def plain_match(siblings, items, at, whole):
    """(end, bindings) of items from a place among siblings, the nearest way, or None."""
    if not items:
        return (at, []) if not whole or at == len(siblings) else None
    kind, *rest = items[0]
    if kind == "token":
        ok = at < len(siblings) and siblings[at][1] == rest[0] and siblings[at][2] is None
        return plain_match(siblings, items[1:], at + 1, whole) if ok else None
    if kind == "group":
        if at >= len(siblings) or siblings[at][1] != rest[0] or siblings[at][2] is None:
            return None
        inside = plain_match(siblings[at][2], rest[1], 0, True)
        more = plain_match(siblings, items[1:], at + 2, whole)
        return (more[0], inside[1] + more[1]) if inside and more else None
    single = kind == "one"
    if len(items) == 1:
        end = next((j for j in range(at, len(siblings)) if siblings[j][1] in ",;"), len(siblings)) if single else len(siblings)
        ok = (end > at or not single) and (not whole or end == len(siblings))
        return (end, [(rest[0], tuple(x[1] for x in siblings[at:end]))]) if ok else None
    # the nearest place where the following run stands, with what must come after it
    for j in range(at + single, len(siblings) + 1):
        more = plain_match(siblings, items[1:], j, whole)
        if more:
            held = siblings[at:j]
            return (more[0], [(rest[0], tuple(x[1] for x in held)), *more[1]]) if not (single and any(x[1] in ",;" for x in held)) else None
    return None


def all_levels(siblings):
    yield siblings
    for _, _, inside in siblings:
        if inside is not None:
            yield from all_levels(inside)


TEMPLATES = ["fn $F($$$A) { $$$B }", "f($X)", "f($X, $Y)", "f(...)", "f(:[x], a)", "f($X, $X)", "{ $$$ f($$$A); $$$ }", "{ f($X) $$$R }", "a = $V;", "f()", "if $C { $$$T } else { $$$E }", "f($A).f($B)", "a"]


@pytest.mark.parametrize("template", TEMPLATES)
def test_patterns_equal_a_plain_matcher(spark, template):
    rng = random.Random(template)

    def some(depth):
        out = []
        for _ in range(rng.randrange(1, 6)):
            x = rng.random()
            if x < 0.25 and depth:
                out += ["f", "(", *some(depth - 1), ")"]
            elif x < 0.35 and depth:
                out += ["fn", "f", "(", "a", ")", "{", *some(depth - 1), "}"]
            elif x < 0.45 and depth:
                out += ["if", "a", "{", *some(depth - 1), "}"] + (["else", "{", "b", "}"] if rng.random() < 0.5 else [])
            else:
                out += rng.choice([["a"], ["f", "(", ")"], ["a", ",", "b"], ["a", "=", "b", ";"], [";"], ["{", "}"], ["f", "(", "a", ",", "a", ")"], [".", "f", "(", "a", ")"]])
        return out

    texts = [some(3) for _ in range(60)]
    files = spark.createDataFrame([(str(i), "rust", " ".join(t)) for i, t in enumerate(texts)], "path string, language string, text string")
    want = []
    items = B.template_items(template)
    for i, tokens in enumerate(texts):
        starts, at = [], 0
        for t in tokens:
            starts.append(at)
            at += len(t) + 1
        for level in all_levels(nest(tokens)):
            for k in range(len(level)):
                found = plain_match(level, items, k, False)
                if found:
                    bound = {}
                    names = [(n, v) for n, v in found[1] if n not in ("", "_")]
                    if all(bound.setdefault(n, v) == v for n, v in names):
                        want.append((str(i), starts[level[k][0]]))
    got = sorted((r.path, r.start_byte) for r in B.pattern_matches(files, template).collect())
    assert got == sorted(want) and got


def test_pattern_bindings(spark):
    text = "fn outer(a: i32, f: fn(u8)) {\n  fn inner() { self.state.lock().unwrap().go(x); }\n  same(p  , p); same(p, q); g( [1, 2], h(3) )\n}"
    files = spark.createDataFrame([("f", "rust", text), ("g", "rust", "nothing"), ("h", "rust", None)], "path string, language string, text string")
    found = lambda t: [(r.match, r.names) for r in B.pattern_matches(files, t).orderBy("start_byte").collect()]
    functions = found("fn $F($$$A) { $$$B }")
    assert [(n["F"], n["A"]) for _, n in functions] == [("outer", "a: i32, f: fn(u8)"), ("inner", "")] and functions[1][0].startswith("fn inner()") and functions[0][1]["B"].endswith("h(3) )")
    assert found("$A.lock().unwrap()") == [("self.state.lock().unwrap()", {"A": "self.state"})]
    assert found("same($X, $X)") == [("same(p  , p)", {"X": "p"})]
    assert found("g(:[first], ...)") == [("g( [1, 2], h(3) )", {"FIRST": "[1, 2]"})]
    for bad in ("f(", "f)", "f(]", "$A $B"):
        with pytest.raises(ValueError):
            B.pattern_matches(files, bad)
