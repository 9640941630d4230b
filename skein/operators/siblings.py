"""Tokens of a file in one pass, in their order: what the siblings around heads, members and calls say, and what encloses what.

The window functions of ``brackets`` hold all tokens of a file, since Spark keeps a whole group of rows before it gives the first.
Here a file goes by in runs of tokens, and what is kept are the open brackets and the names that still wait for a later sibling.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.workspace import shuffle_partitions

SCRIPTS, CLASSES = ("typescript", "tsx", "javascript"), ("java", "csharp")
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
#: The nodes that are units, and what their kind is called.
HEADS = {
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "const": "constant", "static": "constant"},
    "go": {"func": "function", "type": "schema"},
    **{x: {"function": "function", "class": "class"} for x in ("javascript",)},
    **{x: {"function": "function", "class": "class", "interface": "interface", "type": "schema"} for x in ("typescript", "tsx")},
    "java": {"class": "class", "interface": "interface", "enum": "enum"},
    "csharp": {"class": "class", "interface": "interface", "enum": "enum", "struct": "struct"},
}
MODIFIERS = {"rust": ("pub", "async", "unsafe", "const", "extern", "default"), "script": ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "accessor", "*")}
#: A line that begins with the first, or follows the second, goes on; a brace after the third belongs to a type.
CONTINUES, CONTINUED = ("|", "&", "=", ".", "?", ":", "=>"), ("|", "&", "=", "=>", ",", ":")
TYPED = ("interface", "struct", ":", "|", "&", "=>", "<", ",")
SPACE = frozenset(" \t\n\x0b\f\r")
#: How many rows are given, and how many runs are read, at once.
GIVEN, READ = 8192, 32

#: A name that may be a head, a member or a call. ``stop`` is where its statement or head ends (``;`` or the brace of its body, whose
#: closing bracket is ``stop_close``), ``line`` the last sibling of its line, ``run`` the first of the modifiers before it,
#: ``opened_end`` the end of the call that it begins. ``_end`` are bytes, ``_row`` lines.
SIBLINGS = (
    "path string, language string, parent int, n int, token string, start long, line int, begins boolean, prev1 string, prev2 string, prev3 string, next1 string, next2 string, next3 string, next4 string, "
    "named boolean, next_start long, next_line int, next2_start long, stop_n int, stop_token string, stop_start long, stop_close int, stop_end long, stop_row int, "
    "semicolon_n int, semicolon_end long, semicolon_row int, line_n int, line_end long, line_row int, run_start long, run_line int, attribute boolean, opened_end long"
)
_NAMES = [x.split()[0] for x in SIBLINGS.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in SIBLINGS.split(", ")]
_NEXT1, _NEXT2, _NEXT3, _NEXT2_START = (_NAMES.index(x) for x in ("next1", "next2", "next3", "next2_start"))
_STOP, _SEMICOLON, _LINE, _OPENED = (_NAMES.index(x) for x in ("stop_n", "semicolon_n", "line_n", "opened_end"))
# what a row holds besides: how much it waits for, the siblings it has seen and those it asks for, what kind of head it is, whether it may be a member
_WAITS, _SEEN, _ASKS, _HEAD, _MEMBER = range(len(_NAMES), len(_NAMES) + 5)


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows dealt out by path, each path in its order; more parts than cores, so that large files don't share one."""
    spark = rows.sparkSession
    return rows.repartition(max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism), "path").sortWithinPartitions("path", *order)


def _held(rows: list, names: list, types: list) -> pa.RecordBatch:
    columns = list(zip(*rows))[: len(names)] if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class _Group:
    """The siblings inside one open bracket, as far as they were read."""

    __slots__ = ("attribute", "brace", "close", "fresh", "last", "line", "n", "name", "prev1", "prev2", "prev3", "run_line", "run_start", "semicolon", "stop", "young")

    def __init__(self, n: int, brace: bool = False, attribute: bool = False):
        self.n, self.brace, self.attribute, self.fresh = n, brace, attribute, True
        self.prev1 = self.prev2 = self.prev3 = self.last = self.name = self.run_start = self.run_line = None
        # rows that wait: for the next siblings, a stop, a semicolon, the end of a line, the closing bracket that comes next
        self.young, self.stop, self.semicolon, self.line, self.close = [], [], [], [], []


class _File:
    """The tokens of a file, in runs; rows are added to ``out`` as soon as nothing more is to be learned about them."""

    def __init__(self, path: str, language: str, out: list):
        self.path, self.language, self.out = path, language, out
        self.n, self.at, self.line, self.stack = 0, 0, 1, [_Group(-1)]

    def done(self, row: list) -> None:
        row[_WAITS] -= 1
        if not row[_WAITS] and (row[_HEAD] or row[_MEMBER] or row[_OPENED] is not None):
            self.out.append(row)

    def leave(self, group: _Group) -> None:
        for row in group.line:
            row[_LINE : _LINE + 3] = group.last
        for row in (*group.line, *group.young, *group.stop, *group.semicolon, *(r for r, _ in group.close)):
            self.done(row)

    def end(self) -> None:
        while self.stack:
            self.leave(self.stack.pop())

    def born(self, g: _Group, token: str, kind: str, head: str | None) -> None:
        """A row for the sibling before ``token``."""
        n, name, start, line, begins, prev1, prev2, prev3, run_start, run_line = g.name
        member = g.brace and token in ("(", "<") and self.language in (*SCRIPTS, *CLASSES)
        row = [self.path, self.language, g.n, n, name, start, line, begins, prev1, prev2, prev3, token, None, None, None, kind == "name", self.at, self.line, *[None] * 13, run_start, run_line, g.attribute, None, 0, 1, 5 if token == "::" else 4 if head or token == "<" else 1, head, member]
        if member or head and (self.language, name) != ("go", "type"):
            g.stop.append(row)
            row[_WAITS] += 1
        if head:
            g.line.append(row)
            row[_WAITS] += 1
        if row[_ASKS] > 1:
            g.young.append(row)
            row[_WAITS] += 1
        if token == "(":
            g.close.append((row, _OPENED))
            row[_WAITS] += 1

    def aged(self, g: _Group, token: str) -> None:
        """Rows see one sibling more."""
        young = []
        for row in g.young:
            row[_SEEN] = k = row[_SEEN] + 1
            if k < 5:
                row[_NEXT1 + k - 1] = token
            if k == 2:
                row[_NEXT2_START] = self.at
            # a call opens after its name, its type arguments or both
            if token == "(" and (
                (k == 3 and row[_NEXT1] == "<" and row[_NEXT2] == ">")
                or (k == 4 and row[_NEXT1] == "<" and row[_NEXT2] != ">" and row[_NEXT3] == ">")
                or (k == 5 and row[_NEXT1] == "::" and row[_NEXT2] == "<")
            ):
                g.close.append((row, _OPENED))
                row[_WAITS] += 1
            if k < row[_ASKS]:
                young.append(row)
            else:
                self.done(row)
        g.young = young

    def stopped(self, g: _Group, token: str, end: int) -> None:
        for row in g.stop:
            row[_STOP : _STOP + 3] = self.n, token, self.at
            if token == ";":
                row[_STOP + 4 : _STOP + 6] = end, self.line
                row[_SEMICOLON : _SEMICOLON + 3] = self.n, end, self.line
                self.done(row)
                continue
            g.close.append((row, _STOP))
            # these have no body: they end at a semicolon, in scripts at one of their line
            if row[_HEAD] in ("constant", "schema") and not (self.language in SCRIPTS and row[_LINE] is not None):
                g.semicolon.append(row)
                row[_WAITS] += 1
        g.stop = []

    def closed(self, g: _Group, end: int) -> None:
        for row, what in g.close:
            if what == _OPENED:
                row[_OPENED] = end
            else:
                row[_STOP + 3 : _STOP + 6] = self.n, end, self.line
            self.done(row)
        g.close = []

    def read(self, tokens: list) -> None:
        language, stack = self.language, self.stack
        heads, rust, classes, scripts = HEADS[language], language == "rust", language in CLASSES, language in SCRIPTS
        belonging = MODIFIERS["rust" if rust else "script"]
        g = stack[-1]
        for t in tokens:
            c = t[0]
            end = self.at + (len(t) if t.isascii() else len(t.encode()))
            if c in SPACE or c == "/" and t[1:2] in ("/", "*") and len(t) > 1:
                self.at, self.line = end, self.line + t.count("\n")
                continue
            last_line = self.line + t.count("\n")
            if t in OPEN:
                kind = "open"
            elif t in CLOSE:
                kind = "close"
                if len(stack) > 1:
                    self.leave(stack.pop())
                    g = stack[-1]
                if g.close:
                    self.closed(g, end)
            else:
                kind = "name" if (c.isalpha() or c == "_" or c == "$") and '"' not in t and "'" not in t else "other"
            if g.young:
                self.aged(g, t)
            if g.name:
                head = heads.get(g.name[1])
                if head and (kind == "name" or t == "(" or t == "*") or t in ("(", "<", "::"):
                    self.born(g, t, kind, head)
            prev1, begins = g.prev1, False
            if g.line or kind == "name":
                begins = g.last is None or kind != "close" and self.line > g.last[2] and t not in CONTINUES and prev1 not in CONTINUED
                if begins and g.line:
                    for row in g.line:
                        row[_LINE : _LINE + 3] = g.last
                        self.done(row)
                    g.line = []
                    if scripts and g.semicolon:
                        for row in g.semicolon:
                            self.done(row)
                        g.semicolon = []
            if t == ";":
                for row in g.semicolon:
                    row[_SEMICOLON : _SEMICOLON + 3] = self.n, end, self.line
                    self.done(row)
                g.semicolon = []
                self.stopped(g, t, end)
            elif t == "{" and g.stop and (rust or prev1 not in TYPED):
                self.stopped(g, t, end)
            if g.fresh:
                g.run_start, g.run_line = self.at, self.line
            if classes:
                g.fresh = t in (";", "}", "{")
            elif t in belonging:
                g.fresh = False
            elif rust:
                quoted = prev1 == "extern" and (c in "\"'`" or c in "br$@" and ('"' in t or "'" in t))
                g.fresh = not (t == "(" and prev1 == "pub" or t == ")" and g.prev2 == "pub" or quoted)
            else:
                g.fresh = True
            g.name = (self.n, t, self.at, self.line, begins, prev1, g.prev2, g.prev3, g.run_start, g.run_line) if kind == "name" else None
            g.prev3, g.prev2, g.prev1, g.last = g.prev2, prev1, t, (self.n, end, last_line)
            if kind == "open":
                g = _Group(self.n, t == "{", t == "[" and prev1 == "#")
                stack.append(g)
            self.n, self.at, self.line = self.n + 1, end, last_line


def runs(batches):
    """(path, ..., tokens) of rows, a few at once, so that no batch is held as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, READ):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, READ).columns))


def siblings(batches):
    """Rows of ``SIBLINGS`` from (path, language, tokens), which come by path and in the order of the text."""
    out: list = []
    file = None
    for path, language, tokens in runs(batches):
        if file is None or file.path != path:
            if file is not None:
                file.end()
            file = _File(path, language, out)
        file.read(tokens)
        if len(out) >= GIVEN:
            yield _held(out, _NAMES, _TYPES)
            out.clear()
    if file is not None:
        file.end()
    yield _held(out, _NAMES, _TYPES)


class _Nest:
    """Intervals that are nested or apart, by their starts: how deep a place is, and the last one that began at each depth."""

    def __init__(self):
        self.ends, self.last = [], {}

    def depth(self, at: int) -> int:
        while self.ends and self.ends[0] <= at:
            heapq.heappop(self.ends)
        return len(self.ends)

    def enter(self, at: int, end: int, number: int):
        """The innermost interval around the next one."""
        depth = self.depth(at)
        if end > at:
            heapq.heappush(self.ends, end)
        self.last[depth + 1] = number
        return self.last[depth] if depth else None


def numbered(batches):
    """Adds ``unit``, the place of an interval in its path, and ``parent``, the innermost one around it; rows (path, start_byte, end_byte, ...) come by path and start, longer ones first."""
    path, nest, number = None, None, 0
    for batch in batches:
        unit, parent = [], []
        for here, at, end in zip(*(batch.column(x).to_pylist() for x in ("path", "start_byte", "end_byte"))):
            if here != path:
                path, nest, number = here, _Nest(), 0
            parent.append(nest.enter(at, end, number))
            unit.append(number)
            number += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit, pa.int32()), pa.array(parent, pa.int32())], [*batch.schema.names, "unit", "parent"])


def placed(batches):
    """(path, caller, name, start_byte, end_byte) of calls, from units and calls (path, at, end, unit, name) by path and place, units first."""
    names = ["path", "caller", "name", "start_byte", "end_byte"]
    path, nest = None, None
    for batch in batches:
        rows = []
        for here, at, end, unit, name in zip(*(batch.column(x).to_pylist() for x in ("path", "at", "end", "unit", "name"))):
            if here != path:
                path, nest = here, _Nest()
            if unit is not None:
                nest.enter(at, end, unit)
                continue
            depth = nest.depth(at)
            rows.append((here, nest.last.get(depth) if depth else None, name, at, end))
        yield _held(rows, names, [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()])


def by_nesting(rows: DataFrame, kind: str) -> DataFrame:
    """``numbered`` or ``placed`` over rows of units, or of units and calls."""
    if kind == "numbered":
        ordered = in_order(rows, "start_byte", F.desc("end_byte"), "name")
        return ordered.mapInArrow(numbered, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", unit int, parent int")
    return in_order(rows, "at", F.col("unit").isNull(), "unit").mapInArrow(placed, "path string, caller int, name string, start_byte long, end_byte long")
