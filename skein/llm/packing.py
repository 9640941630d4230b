"""Hierarchical multi-length packing.

A document's tokens, with an end token, are first cut into whole windows of the
longest tier. What is left over, its tail, is routed to the shortest tier that
holds it. Tiers are packed from the longest to the shortest: a window takes the
longest tail of its tier, its gap is filled with the best-fitting tails of shorter
tiers, and last with the head of a tail that is cut to close it. So every window
is exactly as long as its tier. Only what a partition has at its end may stay
unfilled; it is cut into powers of two. Windows of a tier are then dealt in snake
order of their attention cost to step groups of equal token numbers.

Packing works block by block within each input partition, in constant memory and
without a shuffle. A lost task is simply run again: its rows come in the same
order and its sequence numbers start from its partition number.

Results: a null or empty text is its end token alone. Equal rows are packed one by
one. A null doc_id stays null. Extra columns are ignored. Without rows there are
no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import PATTERN, byte_symbols

TIERS = (128, 256, 512, 1024)
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 16 * 1024
END = 0
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Tokenizer:
    """Identifiers of a byte-level vocabulary file, by the ranks of its tokens."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {s: b for b, s in byte_symbols().items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or min(merged, default=len(back)) < len(back):
            raise ValueError(f"{path}: identifiers don't follow the order of the merges")
        self.codec = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __call__(self, text: str) -> list[int]:
        if self.split is None or not self.split.search(text):
            return self.codec.encode_ordinary(text)
        ids = []
        for part in self.split.split(text):
            ids += [self.special[part]] if part in self.special else self.codec.encode_ordinary(part)
        return ids


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def fill_windows(tails: list[tuple[int, int]], tiers) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Packs tails, (length, key) each. Returns full windows (tier, pieces) and the pieces of an unfinished one.

    A piece is (key, offset in the tail, length).
    """
    left = sorted((n, key, 0) for n, key in tails if n)
    windows, total = [], sum(n for n, _, _ in left)
    for tier in sorted(tiers, reverse=True):
        low = max((t for t in tiers if t < tier), default=0)
        while left and left[-1][0] > low and total >= tier:
            n, key, at = left.pop()
            if n > tier:  # left over from a longer tier
                insort(left, (n - tier, key, at + tier))
                n = tier
            pieces, gap = [(key, at, n)], tier - n
            while gap and left:
                i = bisect_right(left, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    n, key, at = left.pop(i)
                    pieces.append((key, at, n))
                    gap -= n
                else:
                    n, key, at = left.pop()
                    pieces.append((key, at, gap))
                    insort(left, (n - gap, key, at + gap))
                    gap = 0
            windows.append((tier, pieces))
            total -= tier
    return windows, [(key, at, n) for n, key, at in reversed(left)]


def in_powers(pieces: list[tuple[int, int, int]], longest: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cuts pieces into windows that are powers of two long."""
    total = sum(n for _, _, n in pieces)
    pieces, out = list(reversed(pieces)), []
    while total:
        size = min(longest, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            key, at, n = pieces.pop()
            take = min(n, gap)
            window.append((key, at, take))
            if n > take:
                pieces.append((key, at + take, n - take))
            gap -= take
        out.append((size, window))
        total -= size
    return out


class _Packer:
    """One partition's packer: holds at most a block of tails."""

    def __init__(self, tiers, block_tokens: int, step_tokens: int):
        self.tiers, self.longest, self.block, self.step = tiers, max(tiers), block_tokens, step_tokens
        context = TaskContext.get()
        self.sequence = self.group = (context.partitionId() if context else 0) << 40
        self.tails: list[tuple[int, np.ndarray, int, int]] = []  # doc_id, ids, start, tokens of the document
        self.whole: list[tuple] = []  # windows that one document fills
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, full = len(ids), len(ids) // self.longest * self.longest
        if full:
            self.whole += [(self.longest, [(doc_id, ids, s, self.longest, n, 0)]) for s in range(0, full, self.longest)]
        if full < n:
            self.tails.append((doc_id, ids[full:], full, n))
        self.held += n
        if self.held >= self.block:
            self.flush()

    def flush(self, last: bool = False) -> None:
        tails, self.tails, self.held = self.tails, [], 0
        windows, rest = fill_windows([(len(t[1]), k) for k, t in enumerate(tails)], self.tiers)
        if last:
            windows, rest = windows + in_powers(rest, self.longest), []
        piece = lambda k, at, n: (tails[k][0], tails[k][1], at, n, tails[k][3], tails[k][2])
        whole, self.whole = self.whole, []
        self.emit(whole + [(tier, [piece(*p) for p in pieces]) for tier, pieces in windows])
        for k, at, n in rest:
            doc_id, ids, start, tokens = tails[k]
            self.tails.append((doc_id, ids[at : at + n], start + at, tokens))
            self.held += n

    def emit(self, windows) -> None:
        by: dict[int, list] = {}
        for tier, pieces in windows:
            by.setdefault(tier, []).append((sum(p[3] ** 2 for p in pieces), pieces))
        for tier in sorted(by, reverse=True):
            rows = sorted(by[tier], key=lambda x: -x[0])
            groups = -(-len(rows) * tier // self.step) or 1
            for i, (_, pieces) in enumerate(rows):
                lap, at = divmod(i, groups)
                group = self.group + (at if lap % 2 == 0 else groups - 1 - at)
                offset = 0
                for doc_id, ids, at, n, tokens, base in pieces:
                    start = at + base
                    crc = zlib.crc32(ids[at : at + n].tobytes())
                    self.out.append((doc_id, start, n, crc, tokens, self.sequence, offset, tier, group))
                    offset += n
                self.sequence += 1
            self.group += groups

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(documents: DataFrame, path: str, tiers=TIERS, block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece; see the module's text. ``path``: the vocabulary file."""

    def run(batches):
        encode, packer = tokenizer(path), _Packer(tiers, block_tokens, step_tokens)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, np.array(encode(text.as_py() or "") + [END], "<u4"))
                if len(packer.out) >= 20_000:
                    yield packer.batch()
        packer.flush(last=True)
        yield packer.batch()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
