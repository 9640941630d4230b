"""Substring dedup by a log-structured fingerprint index.

Every window of ``width`` words has one fingerprint: the smallest hash among its
``gram``-word grams. Equal windows have equal fingerprints at equal offsets, so
the fingerprints lose no repeat while a text stores only about one in sixteen.
A text's occurrences of fingerprints ("postings") also carry a hash of the whole
span of windows they stand for.

The index is a folder of immutable runs. A run has one row per fingerprint and span:
how often that occurs, and where first. Runs are bucketed and sorted by fingerprint, so
they are joined and merged without a shuffle. ``append`` takes a batch:

1. Its postings are summed into a run of its own.
2. That run is merge-joined with every earlier one. A span that occurs twice repeats in
   all its windows, in the batch and, if the index knew it once, there too.
3. Where one fingerprint has several spans, one text of each is verified window by window:
   hashes of the complete windows are counted, and those that occur twice repeat.
4. With more than ``fan_in`` runs, all are merged into one and deleted.

``append`` returns the repeats it found, those of earlier texts included, so that all
batches together give what one batch of everything would. A later session opens the
same folder and goes on. Verification reads the texts of earlier batches again, but
only those that share a fingerprint with the batch are kept for it.

Window equality rests on two 64-bit hashes made from different bases: the
fingerprint and the window or span hash.

Results: a null or blank text has no words, n_removed 0 and the digest of the
empty string. Texts shorter than a window lose nothing. Rows that repeat a
doc_id are separate documents, and equal rows are copies of each other. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, delete, exists, gram_hashes, join_hot, shuffle_partitions, span_hashes, text_buffers, word_hashes

WIDTH, GRAM, BATCHES, FAN_IN = 35, 5, 3, 2


def anchors(words: np.ndarray, first: np.ndarray, width: int, gram: int):
    """Per fingerprint occurrence: text index, its word, first and last window start (within the text), hashes."""
    count = len(words) - width + 1
    if count <= 0:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)] * 2
    grams = gram_hashes(words, gram)
    reach = width - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, reach)
    at = np.concatenate([views[i : i + 65536].argmin(1) for i in range(0, count, 65536)]) + np.arange(count)
    text = np.searchsorted(first, np.arange(count), "right") - 1
    whole = np.arange(count) + width <= first[text + 1]
    start = np.flatnonzero(whole)
    at, text = at[start], text[start]
    if not len(start):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)] * 2
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    a, b, at, text = start[heads], start[tails], at[heads], text[heads]
    spans = span_hashes(words, a, b + width) ^ (at - a).astype(U64) * U64(0x9E3779B97F4A7C15)
    base = first[text]
    return text, at - base, a - base, b - base, grams[at], spans


def _postings(width: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for row, n, data, bounds in text_buffers(batch.column("text")):
                words, first = word_hashes(data, bounds)
                text, at, a, b, grams, spans = anchors(words, first, width, gram)
                take = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)),
                     pa.array(grams.view(np.int64)), pa.array(spans.view(np.int64))],
                    ["doc_id", "text_key", "start", "more", "fingerprint", "span"],
                )

    return run


def _windows(width: int):
    """Hashes of the complete windows of unclear spans."""

    def run(batches):
        for batch in batches:
            ids, keys, unclear = batch.column("doc_id"), batch.column("text_key"), batch.column("unclear")
            for row, n, data, bounds in text_buffers(batch.column("text")):
                words, first = word_hashes(data, bounds)
                rows = unclear.slice(row, n)
                sizes = np.diff(np.asarray(rows.offsets))
                flat = rows.flatten()
                start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                more = flat.field("more").to_numpy(zero_copy_only=False).astype(np.int64) + 1
                marks = flat.field("fingerprint").to_numpy(zero_copy_only=False)
                alone = flat.field("alone").to_numpy(zero_copy_only=False)
                text = np.repeat(np.repeat(np.arange(n), sizes), more)
                at = np.repeat(start, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                begin = at + first[text]
                hashes = span_hashes(words, begin, begin + width)
                take = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(at.astype(np.int32)),
                     pa.array(np.repeat(marks, more)), pa.array(hashes.view(np.int64)), pa.array(np.repeat(alone, more))],
                    ["doc_id", "text_key", "start", "fingerprint", "window", "alone"],
                )

    return run


def _keep(width: int):
    def run(batches):
        for batch in batches:
            out = []
            texts, ranges = batch.column("text"), batch.column("ranges")
            bounds, flat = np.asarray(ranges.offsets), ranges.flatten()
            base = int(bounds[0]) if len(bounds) else 0
            start, more = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "more"))
            for i, text in enumerate(texts):
                words = (text.as_py() or "").encode().split()
                kept = words
                if bounds[i] < bounds[i + 1]:
                    of = slice(bounds[i] - base, bounds[i + 1] - base)
                    gone = np.bincount(start[of], minlength=len(words) + 1) - np.bincount(start[of] + more[of] + width, minlength=len(words) + 1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode()))
            names = ["n_words", "n_removed", "kept_sha256", "kept_text"]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return run


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


_PLACE = "struct<doc_id:bigint,text_key:bigint,start:int,more:int>"
_RUN = f"fingerprint BIGINT, span BIGINT, n BIGINT, first {_PLACE.upper()}"


class FingerprintIndex:
    """Sorted immutable runs of window fingerprints in ``space``'s folder, merged by compaction."""

    def __init__(self, space: Workspace, width: int = WIDTH, gram: int = GRAM, fan_in: int = FAN_IN, buckets: int | None = None):
        self.space, self.spark, self.width, self.gram, self.fan_in = space, space.spark, width, gram, fan_in
        self.buckets = buckets or shuffle_partitions(space.spark)
        self.runs: dict[int, DataFrame] = {}
        self.made, self.tables = 0, {}
        if exists(self.spark, f"{space.root}/manifest"):
            rows = self.spark.read.schema("run int, buckets int").parquet(f"{space.root}/manifest").collect()
            for row in rows:
                self.buckets, self.made = row.buckets, max(self.made, row.run)
                self._register(row.run)

    def _register(self, number: int) -> None:
        """A name for a run that is there, with its buckets, in this session's catalog."""
        name = self.tables[number] = f"skein_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.space.root}/run-{number:05d}'"
        )
        self.runs[number] = self.spark.table(name)

    def _commit(self) -> None:
        """The manifest says which runs count; a run that is not in it was never finished or is merged."""
        rows = [(n, self.buckets) for n in sorted(self.runs)]
        self.spark.createDataFrame(rows, "run int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.space.root}/manifest")

    def _write(self, frame: DataFrame) -> int:
        self.made += 1
        name = self.tables[self.made] = f"skein_run_{uuid.uuid4().hex}"
        rows = frame.repartition(self.buckets, "fingerprint")
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.space.root}/run-{self.made:05d}")
        writer.bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").saveAsTable(name)
        self.runs[self.made] = self.spark.table(name)
        return self.made

    def _forget(self, number: int) -> None:
        del self.runs[number]
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(number)}")
        delete(self.spark, f"{self.space.root}/run-{number:05d}")

    def postings(self, documents: DataFrame) -> DataFrame:
        schema = "doc_id long, text_key long, start int, more int, fingerprint long, span long"
        return keyed(documents).mapInArrow(_postings(self.width, self.gram), schema)

    def append(self, documents: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """(doc_id, text_key, start, more): windows start .. start + more repeat, of the batch and of earlier texts.

        ``history`` holds the documents of all earlier batches.
        """
        space, stamp = self.space, f"batch-{self.made + 1:05d}"
        postings = space.table(self.postings(documents), f"{stamp}-postings")
        place = F.min(F.struct("doc_id", "text_key", "start", "more")).alias("first")
        number = self._write(postings.groupBy("fingerprint", "span").agg(F.count("*").alias("n"), place))
        space.release()
        met = space.table(self._met(number), f"{stamp}-met")
        space.release()
        late = met.where("before = 1 AND n > 1").select("known.*")
        twice = space.table(met.where("n > 1 AND own > 0").select("fingerprint", "span", "own"), f"{stamp}-twice")
        own = join_hot(postings, twice, ["fingerprint", "span"], "own").select("doc_id", "text_key", "start", "more")
        marks = space.table(late.unionByName(own), f"{stamp}-marks")
        verified = self._verified(met, documents if history is None else keyed_union(documents, history), stamp)
        space.release()
        space.drop(*[f"{stamp}-{x}" for x in ("postings", "met", "twice", "windows", "often", "several")])
        self._commit()
        if len(self.runs) > self.fan_in:
            self.compact()
        return marks.unionByName(verified)

    def _met(self, number: int) -> DataFrame:
        """The spans of the fingerprints of one run, in all runs: n in all, ``before`` in earlier runs, ``own`` in this one."""
        mine = self.runs[number]
        none = F.lit(None).cast(_PLACE)
        rows = mine.select("fingerprint", "span", "n", F.lit(0).cast("long").alias("before"), F.col("n").alias("own"), "first", none.alias("known"))
        asked = mine.select("fingerprint")
        for other, run in self.runs.items():
            if other != number:
                old = run.join(asked.hint("merge"), "fingerprint", "left_semi")
                rows = rows.unionByName(old.select("fingerprint", "span", "n", F.col("n").alias("before"), F.lit(0).cast("long").alias("own"), "first", F.col("first").alias("known")))
        sums = [F.sum(c).alias(c) for c in ("n", "before", "own")]
        return rows.groupBy("fingerprint", "span").agg(*sums, F.min("first").alias("first"), F.min("known").alias("known"))

    def _verified(self, met: DataFrame, documents: DataFrame, stamp: str) -> DataFrame:
        """Repeated windows of spans that occur once, by the full windows of all spans of their fingerprints."""
        space = self.space
        several = met.groupBy("fingerprint").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 AND least = 1")
        several = space.table(several.select("fingerprint", "spans"), f"{stamp}-several")
        unclear = join_hot(met.select("fingerprint", "n", "first"), several, ["fingerprint"], "spans")
        unclear = unclear.select("first.doc_id", "first.text_key", F.struct("first.start", "first.more", "fingerprint", (F.col("n") == 1).alias("alone")).alias("x"))
        unclear = unclear.groupBy("doc_id", "text_key").agg(F.collect_list("x").alias("unclear"))
        texts = keyed(documents)
        same = (texts.doc_id.eqNullSafe(unclear.doc_id)) & (texts.text_key == unclear.text_key)
        # rows that repeat an id and a text are one row of ``unclear``, and any of them can show its windows
        windows = texts.join(unclear, same).select(texts.doc_id, texts.text_key, "text", "unclear")
        schema = "doc_id long, text_key long, start int, fingerprint long, window long, alone boolean"
        windows = space.table(windows.mapInArrow(_windows(self.width), schema), f"{stamp}-windows")
        space.release()
        often = windows.groupBy("fingerprint", "window").agg(F.count("*").alias("n")).where("n > 1")
        often = space.table(often, f"{stamp}-often")
        found = join_hot(windows.where("alone"), often, ["fingerprint", "window"], "n")
        return space.table(found.select("doc_id", "text_key", "start", F.lit(0).alias("more")), f"{stamp}-verified")

    def compact(self) -> None:
        """Merge all runs into one and delete them."""
        if len(self.runs) < 2:
            return
        old = list(self.runs)
        merged = self.runs[old[0]]
        for number in old[1:]:
            merged = merged.unionByName(self.runs[number])
        self._write(merged.groupBy("fingerprint", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
        del merged
        dead = {n: self.runs.pop(n) for n in old}
        self._commit()
        self.runs = dead | self.runs
        del dead
        for number in old:
            self._forget(number)
        self.space.release()

    def close(self) -> None:
        """Delete the index."""
        for number in list(self.runs):
            self._forget(number)
        self.space.close()


def keyed_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id", "text").unionByName(b.select("doc_id", "text"))


def repeated_ranges(space: Workspace, documents: DataFrame, width: int, gram: int, batches: int) -> DataFrame:
    """(doc_id, text_key, start, more): the windows start .. start + more of that text occur elsewhere too."""
    index = FingerprintIndex(space, width, gram)
    rows = documents.select("doc_id", "text")
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    out = None
    for i in range(batches):
        found = index.append(rows.where(batch == i), rows.where(batch < i) if i else None)
        out = found if out is None else out.unionByName(found)
    for number in list(index.runs):
        index._forget(number)
    return out


def substring_dedup(
    spark: SparkSession, documents: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, space: Workspace | None = None
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by one space)."""
    space = space or Workspace(spark, "substring")
    ranges = repeated_ranges(space, documents, width, gram, batches)
    ranges = ranges.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "more")).alias("ranges"))
    ranges = space.table(ranges, "ranges")
    space.release()
    texts = keyed(documents)
    same = (texts.doc_id.eqNullSafe(ranges.doc_id)) & (texts.text_key == ranges.text_key)
    joined = texts.join(ranges.hint("merge"), same, "left")
    joined = joined.select(texts.doc_id, "text", F.coalesce("ranges", F.array().cast("array<struct<start:int,more:int>>")).alias("ranges"))
    return joined.mapInArrow(_keep(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
