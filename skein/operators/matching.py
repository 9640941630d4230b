"""Structural patterns among siblings, in one pass over the tokens of a file from its end to its start.

What a hole reaches to stands behind it, so backwards it is known when its place is met. What is kept are the open brackets, and in
each the next few siblings and the nearest match of each part of the pattern.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .siblings import CLOSE, GIVEN, OPEN, SPACE, in_order, runs

SPANS = "array<struct<name:string,from:bigint,to:bigint>>"
#: ``at`` is the first byte of the sibling at which a match was found, which tells it from others.
MATCHES = f"path string, at long, start long, end long, spans {SPANS}"
_NAMES = ["path", "at", "start", "end", "spans"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("name", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))]
_BREAKS = frozenset(("return", "let", "mut", "await", "new", "if", "while", "match", "in", "else", "const", "var", "go", "defer", "throw"))
_LINKS = frozenset((".", "::", "?.", "?", "(", ")", "[", "]"))
# a sibling: its token, bytes, whether it is a word, whether nothing is inside its bracket, the matches inside, the nearest separator
_TOKEN, _START, _END, _WORD, _EMPTY, _SUBS, _SEPARATOR = range(7)


class Sequence:
    """Items as runs of tokens and groups with holes between them; ``whole`` if they must be all siblings of a bracket."""

    def __init__(self, items: list, whole: bool, known: list):
        self.whole, self.holes, self.runs, run = whole, [], [], []
        for item in items:
            if item[0] in ("one", "many"):
                self.runs.append(run)
                self.holes.append((item[0] == "one", item[1]))
                run = []
            elif item[0] == "token":
                run.append((item[1], None, None, None))
            else:
                inside, close = item[2], CLOSE[OPEN.index(item[1])]
                if not inside:
                    run += [(item[1], "empty", None, None), (close, None, None, None)]
                elif len(inside) == 1 and inside[0][0] == "many":
                    run += [(item[1], "all", inside[0][1], None), (close, None, None, None)]
                else:
                    run += [(item[1], "sub", None, Sequence(inside, True, known).number), (close, None, None, None)]
        self.runs.append(run)
        if not all(self.runs[1:-1]):
            raise ValueError("two holes stand side by side")
        self.only_hole = not any(self.runs)
        # how many siblings on the next run may begin, at the nearest
        self.gaps = [len(r) + h[0] for r, h in zip(self.runs, self.holes)]
        self.firsts, self.longest = frozenset(r[0][0] for r in self.runs if r), max(self.gaps, default=0) + 2
        self.number = len(known)
        known.append(self)


class _State:
    """What a sequence knows inside a bracket: for each run, the matches that begin at the last siblings and the nearest before them."""

    __slots__ = ("before", "moving", "near", "rests", "waiting")

    def __init__(self, sequence: Sequence):
        n, self.before, self.moving = len(sequence.holes), None, 0
        self.rests, self.near, self.waiting = [None] * (n + 1), [None] * n, [[] for _ in range(n)]


class _Group:
    __slots__ = ("chain", "fresh", "last_end", "nexts", "row", "separator", "size", "states")

    def __init__(self, known: list):
        self.size, self.row, self.nexts, self.states = 0, None, [], [_State(s) for s in known]
        self.separator = self.last_end = None
        self.chain, self.fresh = [], []  # matches that wait for the first of the names before them


class _File:
    def __init__(self, path: str, known: list, out: list):
        self.path, self.known, self.out = path, known, out
        self.kept = max(len(r) for s in known for r in s.runs) + 1
        self.stack = [_Group(known)]

    def give(self, at: int, start: int, end: int, spans: list) -> None:
        self.out.append((self.path, at, start, end, [{"name": a, "from": b, "to": c} for a, b, c in spans]))

    def literal(self, run: list, row: list, nexts: list):
        """The spans of a run that begins at a sibling, or None."""
        if len(nexts) < len(run) - 1:
            return None
        spans = []
        for k, (token, what, name, sub) in enumerate(run):
            here = nexts[k - 1] if k else row
            if here[_TOKEN] != token or what == "empty" and not here[_EMPTY]:
                return None
            if what == "all":
                spans.append((name, here[_END], nexts[k][_START]))
            elif what == "sub":
                found = here[_SUBS][sub] if here[_SUBS] else None
                if found is None:
                    return None
                spans += found
        return spans

    def rest(self, s: Sequence, state: _State, k: int, g: _Group, row: list, place: int):
        """(place, start, end, spans) of the runs from ``k`` on, if they match from a sibling on. Places count from the last sibling, which is 0."""
        run, last = s.runs[k], len(s.runs) - 1
        spans = self.literal(run, row, g.nexts)
        if spans is None:
            return None
        length = len(run)
        after, end = place - length, (g.nexts[length - 2] if length > 1 else row)[_END]
        if k == last:
            return (place, row[_START], end, spans) if not s.whole or after == -1 else None
        single, name = s.holes[k]
        separator = g.nexts[length - 1][_SEPARATOR] if single and len(g.nexts) >= length else (-1, g.last_end)
        if not s.runs[k + 1]:  # the last item is a hole: it ends at a separator or with the siblings
            if single and not separator[0] < after or s.whole and separator[0] != -1:
                return None
            to = separator[1] if after >= 0 else end
            return (place, row[_START], to, [*spans, (name, end, to)])
        more = state.near[k]
        if more is None or single and separator[0] > more[0]:
            return None
        return (place, row[_START], more[2], [*spans, (name, end, more[1]), *more[3]])

    def meet(self, g: _Group, row: list) -> None:
        """A sibling more, before all others that were met."""
        place = g.size
        if place == 0:
            g.last_end = row[_END]
            g.separator = [-1, row[_END]]
        elif g.separator[1] is None:
            g.separator[1] = row[_END]
        if row[_TOKEN] in (",", ";"):
            g.separator = [place, None]
        row[_SEPARATOR] = g.separator
        if g.chain or g.fresh:
            self.lead(g, row)
        for s, state in zip(self.known, g.states):
            begins = row[_TOKEN] in s.firsts
            if not begins and not state.moving:
                continue  # nothing begins here and nothing waits: all stays as it is
            for k in range(len(s.runs) - 1, -1, -1):
                state.rests[k] = self.rest(s, state, k, g, row, place) if s.runs[k] and row[_TOKEN] == s.runs[k][0][0] else None
            state.moving = s.longest if begins else state.moving - 1
            state.before = state.near[0] if s.holes else None
            for k, gap in enumerate(s.gaps):
                if gap == 0:
                    state.near[k] = state.rests[k + 1] or state.near[k]
                    continue
                waiting = state.waiting[k]
                waiting.insert(0, state.rests[k + 1])
                if len(waiting) >= gap:
                    state.near[k] = waiting.pop() or state.near[k]
        top, state = self.known[-1], g.states[-1]
        if top.runs[0]:
            if state.rests[0]:
                _, start, end, spans = state.rests[0]
                self.give(start, start, end, spans)
        elif not top.only_hole and state.rests[1]:
            g.fresh.append(state.rests[1])
        g.size, g.row = place + 1, row
        g.nexts.insert(0, row)
        if len(g.nexts) > self.kept:
            g.nexts.pop()

    def lead(self, g: _Group, row: list) -> None:
        """Matches behind a hole: a chain of names, accesses, calls and indexes runs up to them."""
        if row[_TOKEN] in _LINKS or row[_WORD] and row[_TOKEN] not in _BREAKS:
            if g.chain and row[_WORD] and g.row[_WORD]:
                self.led(g)
            g.chain, g.fresh = g.chain + g.fresh, []
        else:
            self.led(g)
            g.fresh = []

    def led(self, g: _Group) -> None:
        if not g.chain:
            return
        name = self.known[-1].holes[0][1]
        for _, start, end, spans in g.chain:
            self.give(start, g.row[_START], end, [(name, g.row[_START], start), *spans])
        g.chain = []

    def leave(self, g: _Group):
        """The matches of all siblings of a bracket, by sequence."""
        if not g.size:
            return None
        self.led(g)
        subs = [None] * len(self.known)
        for s, state in zip(self.known, g.states):
            if not s.whole and not s.only_hole:
                continue
            if s.runs[0]:
                found = state.rests[0] and state.rests[0][3]
            elif s.only_hole:
                single, name = s.holes[0]
                found = None if single and g.separator[0] != -1 else [(name, g.row[_START], g.last_end)]
                if found and not s.whole:
                    self.give(g.row[_START], g.row[_START], g.last_end, found)
            else:
                single, name = s.holes[0]
                more = state.before if single else state.near[0]
                found = None if more is None or single and g.separator[0] > more[0] else [(name, g.row[_START], more[1]), *more[3]]
            subs[s.number] = found
        return subs

    def end(self) -> None:
        while self.stack:
            self.leave(self.stack.pop())

    def read(self, tokens: list, at: int, excess: list) -> None:
        """A run that begins at byte ``at``, of whose brackets ``excess`` close nothing."""
        starts = []
        for t in tokens:
            starts.append(at)
            at += len(t) if t.isascii() else len(t.encode())
        nothing = set()
        if excess:
            brackets = [k for k, t in enumerate(tokens) if t in OPEN or t in CLOSE]
            nothing = {brackets[k] for k in excess}
        stack = self.stack
        for k in range(len(tokens) - 1, -1, -1):
            t, start = tokens[k], starts[k]
            end, at, c = at, start, t[0]
            if c in SPACE or c == "/" and t[1:2] in ("/", "*") and len(t) > 1:
                continue
            if t in OPEN:
                inside = stack.pop()
                subs = self.leave(inside)
                if not stack:  # never closed: what came before was inside of it
                    stack.append(_Group(self.known))
                self.meet(stack[-1], [t, start, end, False, not inside.size, subs, None])
                continue
            self.meet(stack[-1], [t, start, end, c.isalpha() or c in "_$\"'`" or c == "@" and len(t) > 1, False, None, None])
            if t in CLOSE and k not in nothing:
                stack.append(_Group(self.known))


def _begun(batches):
    """Adds ``at``, the first byte of a run, and ``excess``, which of its brackets close nothing; runs come in the order of the text."""
    path, at, depth = None, 0, 0
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch, starts, excess = whole.slice(k, 512), [], []
            for here, size, brackets in zip(*(batch.column(x).to_pylist() for x in ("path", "size", "brackets"))):
                if here != path:
                    path, at, depth = here, 0, 0
                starts.append(at)
                at, over = at + size, []
                for i, t in enumerate(brackets):
                    if t in OPEN:
                        depth += 1
                    elif depth:
                        depth -= 1
                    else:
                        over.append(i)
                excess.append(over)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("path", "language", "run", "text")), pa.array(starts, pa.int64()), pa.array(excess, pa.list_(pa.int32()))], ["path", "language", "run", "text", "at", "excess"])


def matches(rows: DataFrame, tokens, items: list) -> DataFrame:
    """Rows of ``MATCHES`` from runs of tokens (path, language, run, text); ``tokens`` cuts a text."""
    known: list = []
    Sequence(items, False, known)

    def found(batches):
        out: list = []
        file = None
        held = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, _TYPES)], _NAMES)
        for path, tokens, at, excess in runs(batches):
            if file is None or file.path != path:
                if file is not None:
                    file.end()
                file = _File(path, known, out)
            file.read(tokens, at, excess)
            if len(out) >= GIVEN:
                yield held()
                out.clear()
        if file is not None:
            file.end()
        yield held()

    brackets = F.filter(tokens, lambda x: x.isin(*OPEN, *CLOSE))
    begun = in_order(rows, "run").select("path", "language", "run", "text", F.octet_length("text").alias("size"), brackets.alias("brackets"))
    begun = begun.mapInArrow(_begun, "path string, language string, run int, text string, at long, excess array<int>")
    return begun.sortWithinPartitions("path", F.desc("run")).select("path", tokens.alias("tokens"), "at", "excess").mapInArrow(found, MATCHES)
