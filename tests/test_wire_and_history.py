"""Encoded indexes read back, broken ones reported; ways along first parents against a plain walk."""

import random

import numpy as np
import pytest

from skein.operators import history
from skein.operators.reports import column_to_byte
from skein.sources import wire


def number(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    out = b""
    for key, value in parts:
        out += number(key << 3) + number(value) if isinstance(value, int) else number(key << 3 | 2) + number(len(value)) + value
    return out


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**31 - 1, -1, -(2**31)]
    assert wire.packed(b"".join(map(number, values))).tolist() == values
    assert wire.packed(b"").tolist() == []
    for bad in (b"\x80", b"\x01\xff", b"\x80" * 10 + b"\x01"):
        with pytest.raises(ValueError):
            wire.packed(bad)
    rng = random.Random(1)
    many = [rng.randrange(-(2**31), 2**31) for _ in range(2000)]
    assert wire.packed(b"".join(map(number, many))).tolist() == many and isinstance(wire.packed(b"\x01"), np.ndarray)


TEXT = "fn é😀x() {\n  call(é😀, y);\n}\n"


def test_indexes_are_decoded_and_placed(spark):
    def occurrence(range_, symbol, roles=0, apart=False):
        ranges = [(wire.RANGE, n) for n in range_] if apart else [(wire.RANGE, b"".join(map(number, range_)))]
        return message(*ranges, (wire.SYMBOL, symbol.encode()), (9, b"unknown"), *([(wire.ROLES, roles)] if roles else []))

    def index(utf16, *found, path="a.rs"):
        document = message((4, b"rust"), (wire.PATH, path.encode()), *((wire.OCCURRENCES, o) for o in found))
        return message((wire.METADATA, message((1, 1), (wire.ENCODING, 2 if utf16 else 1))), (wire.DOCUMENTS, document), (3, b"external"))

    data = [
        (1, index(False, occurrence([0, 3, 10], "x", 1), occurrence([1, 7, 1, 13], "y", 8, apart=True), occurrence([0, 3, 99], "far"), occurrence([9, 0, 1], "gone"))),
        (2, index(True, occurrence([0, 3, 7], "x", 3), occurrence([1, 7, 10], "y"), occurrence([0, -1, 3], "bad"), occurrence([1], "short"))),
        (3, index(False, occurrence([0, 0, 2], "x"))[:-4]), (4, b"\xff\xff"), (5, b""), (6, None), (7, b"\x0b\x0c"), (8, message((wire.DOCUMENTS, message((wire.PATH, b"\xff\xfe"))))),
    ]
    table = spark.createDataFrame(data, "index_id long, data binary")
    found = wire.occurrences(wire.index_documents(table))
    files = spark.createDataFrame([("a.rs", TEXT)], "path string, text string")
    rows = wire.byte_ranges(found, files, column_to_byte).collect()
    shown = {(r.index_id, r.symbol): (TEXT.encode()[r.start : r.end].decode() if None not in (r.start, r.end) else None, r.is_definition) for r in rows if r.error is None}
    assert shown == {(1, "x"): ("é😀x", True), (1, "y"): ("é😀", False), (1, "far"): (None, False), (1, "gone"): (None, False), (2, "x"): ("é😀x", True), (2, "y"): ("é😀", False), (3, "x"): ("fn", False)}
    assert sorted((r.index_id, r.symbol) for r in rows if r.error) == sorted([(2, "bad"), (2, "short"), (3, None), (4, None), (7, None), (8, None)], key=str) or {r.index_id for r in rows if r.error} == {2, 3, 4, 7, 8}


def test_random_bytes_are_never_fatal(spark):
    rng = random.Random(5)
    table = spark.createDataFrame([(i, bytes(rng.randrange(256) for _ in range(rng.randrange(60)))) for i in range(300)], "index_id long, data binary")
    assert wire.occurrences(wire.index_documents(table)).count() > 0


@pytest.mark.parametrize("limit", [1, 5, 512])
def test_first_parents(spark, limit):
    rng = random.Random(limit)
    parents = {"c0": []}
    for i in range(1, 10_000):
        parents[f"c{i}"] = [f"c{max(0, i - rng.choice([1, 1, 1, 2, 30]))}"] + [f"c{rng.randrange(i)}"] * (rng.random() < 0.2)
    frame = spark.createDataFrame(list(parents.items()), "commit string, parents array<string>")
    for head in ("c9999", "c3", "c0", "none"):
        want, at = [], head
        while at in parents and len(want) < limit:
            want.append((at, len(want), parents[at][0] if parents[at] else None))
            at = parents[at][0] if parents[at] else None
        assert sorted(map(tuple, history.first_parents(frame, head, limit).collect()), key=lambda r: r[1]) == want


def test_changes_along_a_way(spark):
    commits = spark.createDataFrame([("a", []), ("b", ["a"]), ("m", ["b", "x"]), ("x", ["a"])], "commit string, parents array<string>")
    trees = spark.createDataFrame([("a", "p", "1"), ("a", "q", "1"), ("b", "p", "2"), ("b", "q", "1"), ("m", "p", "2"), ("m", "r", "1"), ("x", "p", "9")], "commit string, path string, digest string")
    got = {(r.commit, r.path, r.change) for r in history.changed_along(trees, history.first_parents(commits, "m")).collect()}
    assert got == {("b", "p", "changed"), ("m", "q", "removed"), ("m", "r", "added")}
