"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the vocabulary's pattern. A piece starts as one
symbol per byte in a doubly linked list; the adjacent pair of lowest rank (the
leftmost, in a tie) is popped from a heap and merged until no ranked pair is
left. The piece has as many tokens as it had symbols, less the merges. No
identifiers are made. Counts of pieces of up to ``LONG`` characters are kept in a table of at
most ``MEMO`` entries per worker, so it is bounded in bytes; longer ones are counted anew.

Special strings inside texts are one token each, as the library does by default.
A null text is empty: 0 bytes, 0 tokens. Rows are counted one by one, so repeated
ids, extra columns and very long texts need no care.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
MEMO, LONG = 1 << 20, 32
#: The public pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for Python's faster engine; they agree on texts that ODD does not match.
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧]|[²³¹¼½¾]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceCounts(dict):
    """Tokens of each piece, counted when it is first asked for."""

    def __init__(self, ranks: dict[tuple[str, str], int], memo: int = MEMO):
        super().__init__()
        self.ranks, self.memo = ranks, memo
        symbols = byte_symbols()
        self.table = [symbols[b] for b in range(256)]

    def __missing__(self, piece: str) -> int:
        if len(piece) > LONG:
            return self.count(piece.encode())
        if len(self) >= self.memo:
            self.clear()
        n = self[piece] = self.count(piece.encode())
        return n

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        ranks, symbol = self.ranks, [self.table[b] for b in piece]
        heap = []
        for i in range(n - 1):
            rank = ranks.get((symbol[i], symbol[i + 1]))
            if rank is not None:
                heap.append((rank, i))
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            rank, i = pop(heap)
            a = symbol[i]
            if a is None or (j := after[i]) >= n or ranks.get((a, symbol[j])) != rank:
                continue
            symbol[i] = a = a + symbol[j]
            symbol[j] = None
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                rank = ranks.get((a, symbol[k]))
                if rank is not None:
                    push(heap, (rank, i))
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbol[h], a))
                if rank is not None:
                    push(heap, (rank, h))
        return left


class TokenCounter:
    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.pieces = PieceCounts({tuple(m): i for i, m in enumerate(merges)}, memo)
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.exact = regex.compile(PATTERN)

    def plain(self, text: str) -> int:
        cut = self.exact if ODD.search(text) else QUICK
        return sum(map(self.pieces.__getitem__, cut.findall(text)))

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[tuple[str, int], TokenCounter] = {}


def counter(path: str, memo: int = MEMO) -> TokenCounter:
    """One per worker process."""
    if (path, memo) not in _counters:
        _counters[path, memo] = TokenCounter(path, memo)
    return _counters[path, memo]


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT, memo: int = MEMO) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches):
        count = counter(path, memo)
        for batch in batches:
            tokens = [count(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
