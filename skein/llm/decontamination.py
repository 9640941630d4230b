"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased.
An item of m words is found in a document if some passage of it is within
``floor(rate * m)`` word edits.

1. Windows. With at most k edits, a match holds an unchanged run of
   ceil((m - k) / (k + 1)) words of the item, so every match holds one of the item's
   grams of that size (at most ``gram``). Where one occurs, it aligns an item-sized
   window of the document.
2. CGK. A shared random walk writes a window's words, each step repeating or advancing
   by a random bit of the word and step, so that few edits give few differing steps.
   ``walks`` walks, each sampled ``samples`` times at ``bits`` steps inside the window, make LSH
   keys; a window that shares a key with the item is a candidate. The repeats are chosen
   for a recall of ``RECALL`` among windows with as many edits as are allowed; a simulation
   over items of 5 to 100 words gives 0.997 or more at every length. Of unrelated windows that share
   a gram with an item of 40 words or more, about one in ten passes.
3. Candidates are verified by exact edit distance: the least one between the item and
   any passage around the window.

Items are collected and sent to the workers in parts of at most ``most_bytes``, so
the broadcast is bounded however many items there are. Documents are read once per
part, without a shuffle.

Results: only documents that hold an item. A null or empty text holds none; items
without words are ignored; items that repeat an id each count, and so do items
without an id, which add a null to the ids. Equal rows are found
each by itself. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, gram_hashes, mix, text_buffers, word_hashes

RATE, GRAM, WALKS, SAMPLES, BITS, MOST_BYTES = 0.2, 4, 8, 8, 2, 32 << 20
RECALL = 0.99

_WORDS = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)):
    _WORDS[_b] = _b


def words_of(data: np.ndarray, bounds: np.ndarray):
    return word_hashes(_WORDS[data], bounds, lower=True)


def allowed(m: int, rate: float) -> int:
    return int(rate * m + 1e-9)


def places(m: int, samples: int, bits: int) -> np.ndarray:
    """The sampled steps for windows of m words, the same for all of them.

    A walk of s steps has advanced about s / 2 words, so steps up to 2 m - 3 sqrt(m), or 1.5 m for few words, still show
    words of the window; what lies behind is padding, alike for all windows.
    """
    steps = max(1, int(1.5 * m), int(2 * m - 3 * m**0.5))
    return np.random.default_rng(m).integers(0, steps, (samples, bits))


def lsh_keys(windows: np.ndarray, walks: int, samples: int, bits: int, most_bytes: int = 1 << 25) -> np.ndarray:
    """(window, walk * samples) keys: each hashes what a walk shows at ``bits`` sampled steps.

    Only sampled steps are kept, and windows go in parts whose walks take about ``most_bytes``.
    """
    n, m = windows.shape
    chosen = places(m, samples, bits)
    size = max(1, most_bytes // (8 * (walks * (samples * bits + 4) + m)))
    return np.concatenate([_keys(windows[i : i + size], walks, chosen) for i in range(0, n, size)] or [np.zeros((0, walks * samples), U64)])


def _keys(windows: np.ndarray, walks: int, chosen: np.ndarray) -> np.ndarray:
    n, m = windows.shape
    at = np.zeros((n, walks), np.int64)
    rows = np.arange(n)[:, None]
    padded = np.concatenate([windows, np.zeros((n, 1), U64)], 1)
    salt = mix(np.arange(1, walks + 1).astype(U64) * U64(0xD1342543DE82EF95))
    shown = np.empty((n, walks, *chosen.shape), U64)
    for j in range(int(chosen.max()) + 1):
        word = padded[rows, np.minimum(at, m)]
        where = chosen == j
        if where.any():
            shown[:, :, where] = word[:, :, None]
        step = U64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at += (mix(word ^ (salt + step)) >> U64(63)).astype(np.int64)
    keys = np.zeros((n, walks, chosen.shape[0]), U64)
    for b in range(chosen.shape[1]):
        # which steps were sampled is part of a key
        keys = mix(keys * U64(3) + shown[:, :, :, b] + (chosen[:, b] + 1).astype(U64))
    return keys.reshape(n, -1)


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> int:
    """Least number of word edits between the item and any passage of the text."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(best - steps) + steps
    return int(row.min())


class Items:
    """A bounded part of the benchmark, as word hashes, seeds and LSH keys."""

    def __init__(self, rows, rate: float, gram: int, walks: int, samples: int, bits: int):
        self.rate, self.lsh = rate, (walks, samples, bits)
        self.ids, self.words, self.keys = [], [], []
        seeds: dict[int, list] = {}
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            words, _ = words_of(data, np.array([0, len(data)]))
            m = len(words)
            if not m:
                continue
            k = allowed(m, rate)
            size = max(1, min(gram, -(-(m - k) // (k + 1))))
            grams = gram_hashes(words, size)
            seeds.setdefault(size, []).append((grams, np.full(len(grams), len(self.ids)), np.arange(len(grams))))
            self.ids.append(item_id)
            self.words.append(words)
            self.keys.append(lsh_keys(words[None], *self.lsh)[0])
        self.seeds = {}
        for size, parts in seeds.items():
            grams, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            flags = np.zeros(1 << 20, bool)
            flags[(grams >> U64(44)).astype(np.int64)] = True
            self.seeds[size] = (grams[order], item[order], at[order], flags)
        self.sizes = np.array([len(w) for w in self.words])

    def windows(self, words: np.ndarray, first: np.ndarray):
        """(text, item, start) of the item-sized windows that seeds align, in that order."""
        found = []
        for size, (grams, item, at, flags) in self.seeds.items():
            here = gram_hashes(words, size)
            hits = np.flatnonzero(flags[(here >> U64(44)).astype(np.int64)])
            low, high = np.searchsorted(grams, here[hits]), np.searchsorted(grams, here[hits], "right")
            count = high - low
            hits, low, count = hits[count > 0], low[count > 0], count[count > 0]
            each = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            where = np.repeat(hits, count)
            text = np.searchsorted(first, where, "right") - 1
            good = where + size <= first[text + 1]
            found.append(np.stack([text, item[each], where - at[each]], 1)[good])
        found = np.concatenate([*found, np.zeros((0, 3), np.int64)])
        return np.unique(found, axis=0)

    def matches(self, data: np.ndarray, bounds: np.ndarray):
        """(text, item, distance, first word of the window) of verified matches, one per text and item."""
        words, first = words_of(data, bounds)
        windows = self.windows(words, first)
        if not len(windows):
            return []
        close = np.zeros(len(windows), bool)
        for m in np.unique(self.sizes[windows[:, 1]]):
            of = np.flatnonzero(self.sizes[windows[:, 1]] == m)
            for part in np.array_split(of, -(-len(of) * int(m) // (1 << 20))):
                text, item, start = windows[part].T
                at = start[:, None] + np.arange(m)
                inside = (at >= first[text][:, None]) & (at < first[text + 1][:, None])
                there = np.where(inside, words[np.clip(at, 0, len(words) - 1)], U64(0))
                keys = lsh_keys(there, *self.lsh)
                close[part] = (keys == np.stack([self.keys[i] for i in item])).any(1)
        best = {}
        for text, item, start in windows[close]:
            k = allowed(self.sizes[item], self.rate)
            if (text, item) in best and not best[text, item][0]:
                continue
            low, high = max(first[text], start - k), min(first[text + 1], start + self.sizes[item] + k)
            distance = edit_distance_within(self.words[item], words[low:high])
            if distance <= k and ((text, item) not in best or distance < best[text, item][0]):
                best[text, item] = distance, int(max(0, start - first[text]))
        return [(int(text), self.ids[item], distance, word) for (text, item), (distance, word) in best.items()]


def parts_of(benchmark: DataFrame, most_bytes: int) -> list[list]:
    """Items in parts of about ``most_bytes`` of text at most, one part on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // most_bytes))
    for i in range(parts):
        chosen = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield [(r.item_id, r.text) for r in chosen.orderBy("item_id", "text").collect()]


_FOUND = "array<struct<item_id:bigint,distance:bigint,word:bigint>>"


def with_matches(
    spark: SparkSession, documents: DataFrame, benchmark: DataFrame, rate=RATE, gram=GRAM, walks=WALKS, samples=SAMPLES, bits=BITS, most_bytes=MOST_BYTES, name: str = "matches"
) -> DataFrame:
    """The rows of ``documents`` with ``name``, an array of (item_id, distance, word); ``documents`` must not have that column."""
    from pyspark.sql import types as T

    columns = documents.columns
    if name.lower() in [c.lower() for c in columns]:
        raise ValueError(f"documents have a column {name}")
    kind = spark.createDataFrame([], f"`{name}` {_FOUND}").schema[name]
    schema = T.StructType([*documents.schema.fields, kind])
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("word", pa.int64())]))
    out = documents.withColumn(name, F.array().cast(_FOUND))
    for rows in parts_of(benchmark, most_bytes):
        shared = spark.sparkContext.broadcast(Items(rows, rate, gram, walks, samples, bits))

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                found = batch.column(len(columns)).to_pylist()
                for row, _, data, bounds in text_buffers(batch.column("text")):
                    for text, item_id, distance, word in items.matches(data, bounds):
                        found[row + text].append({"item_id": item_id, "distance": distance, "word": word})
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(found, arrow)], [*columns, name])

        out = out.mapInArrow(run, schema)
    return out


def contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_items, item_ids, least_distance of the documents that hold benchmark items."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_matches(spark, rows, benchmark, **options).where(F.size("matches") > 0)
    ids = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select("doc_id", F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.array_min("matches.distance").alias("least_distance"))
