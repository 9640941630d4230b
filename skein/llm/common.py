"""Shared folders, table loading and vectorised text hashing for the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.workspace import Workspace, delete, exists, shared_root, shuffle_partitions

__all__ = ["Workspace", "delete", "exists", "shared_root", "shuffle_partitions"]

SPACES = b" \t\n\x0b\x0c\r"
U64 = np.uint64
_MASK = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once per application, wherever the driver was started."""
    if spark.sparkContext.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="skein-code-"), "skein.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                out.write(file, os.path.relpath(file, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def fresh(taken, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``taken`` has."""
    used, out = {n.lower() for n in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, floor: int = 256) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, a written table of one row per key, on keys that may be hot.

    ``weight`` says how many rows a key has. Keys with more than a quarter of an even share of
    the rows of a partition are at most four per partition, so these are broadcast and
    their rows stay where they are; the rest is joined by a shuffle. Keys of up to ``floor`` rows
    are never hot. Hashes of the hot keys reach the scan as a filter, so that the other rows pass no join
    to be told from them; a key that shares a hash with a hot one is broadcast too.
    """
    most = 4 * shuffle_partitions(rows.sparkSession)
    total = keys.agg(F.sum(weight)).first()[0] or 0
    least = max(total // most, floor)
    mark = F.xxhash64(*[F.col(c).cast(keys.schema[c].dataType) for c in on])
    hot = [r[0] for r in keys.where(F.col(weight) > least).select(mark).collect()]
    keys = keys.drop(weight)
    if not hot:
        return rows.join(keys, on)
    names = [c for c in rows.columns if c not in on] + [c for c in keys.columns if c not in on]
    among = mark.isin(*hot)
    spread = rows.where(among).join(F.broadcast(keys.where(among)), on)
    rest = rows.where(~among).join(keys.where(~among), on)
    return spread.select(*on, *names).unionByName(rest.select(*on, *names))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- hashing -----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up[:n], self.down[:n]


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xD6E8FEB86659FD93)
OTHER_POWERS = Powers(0xA0761D6478BD642F)
_BYTE_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[list(SPACES)] = True
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of texts that lie end to end in ``data``.

    ``bounds`` has each text's start and, last, the end. Returns the hashes of
    all words and, for each text, the index of its first word (and the total).
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    if lower:
        data = LOWER_TABLE[data]
    black = ~_SPACE_TABLE[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    last = black.copy()
    last[:-1] &= ~black[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = black[cuts]
    last[cuts - 1] = black[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = BYTE_POWERS.upto(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_TABLE[data] * up, out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return words, np.searchsorted(starts, bounds)


def gram_hashes(words: np.ndarray, n: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, U64)
    up, down = powers.upto(len(words))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up, out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = OTHER_POWERS) -> np.ndarray:
    """Hashes of the runs words[start:end]."""
    up, down = powers.upto(max(1, len(words)))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words + U64(0x2545F4914F6CDD1D)) * up[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def text_buffers(column, most: int = 1 << 20):
    """Slices of a string column: (first row, row count, bytes, bounds), about ``most`` bytes each."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    rows = len(column)
    if not rows:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + rows + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, rows)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
