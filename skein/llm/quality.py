"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are trigrams of character classes (letters by case, digits, blanks, each
punctuation mark by itself), words that repeat the one before, and words themselves, in
lower case and by hash, so that content counts beside form. A bounded sample
of labelled rows gives the vocabulary, the inverse document frequencies and, by a
singular value decomposition (a randomised one with a fixed seed), the latent space.
Words have a vocabulary of at most ``WORDS`` bins, of which those in enough rows count. The sample's vectors are broadcast
(at most ``sample`` rows of ``dims`` numbers); every document meets all of them in
blocked products, and its ``neighbours`` nearest vote with their cosine to the power
``sharp`` as weight.

Labels come only from rows whose crc32(doc_id) mod ``folds`` is not 0. A document
without terms, and so an empty one, gets the share of label 1. Without labels every
score is 0.5. Rows are scored one by one; extra columns are ignored; where a doc_id
has several labels or texts, each pair is a labelled row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, text_buffers, word_hashes

SAMPLE, DIMS, NEIGHBOURS, SHARP, THRESHOLD, FOLDS = 4096, 32, 25, 8, 0.3, 5
#: Texts whose cosines with all labelled vectors are held at once.
BLOCK = 512


def _classes() -> tuple[np.ndarray, int]:
    table = np.full(256, 2, np.int32)
    table[[32, 9, 10, 11, 12, 13]] = [0, 1, 1, 1, 1, 1]
    table[65:91], table[48:58] = 3, 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = np.arange(5, 5 + len(marks))
    return table, 5 + len(marks)


CLASS, KINDS = _classes()
REPEAT = KINDS**3  # the code of a repeated word
WORDS, SHARE, WEIGHT = 1 << 15, 0.01, 0.15  # bins of words, the least share of rows that a counted one is in, and its weight
CODES = REPEAT + 1 + WORDS


def terms(data: np.ndarray, bounds: np.ndarray):
    """(codes, text of each code) of texts that lie end to end."""
    kind = CLASS[data]
    codes = kind[:-2] * (KINDS * KINDS) + kind[1:-1] * KINDS + kind[2:] if len(kind) > 2 else np.zeros(0, np.int32)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[: len(codes)] == text[2 : len(codes) + 2]
    codes, text = codes[inside], text[: len(codes)][inside]
    words, first = word_hashes(data, bounds)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    of = np.searchsorted(first, again, "right") - 1
    again = of[again > first[of]]
    lower = words if not len(words) else word_hashes(data, bounds, lower=True)[0]
    bins = (REPEAT + 1 + (lower >> U64(64 - 15)).astype(np.int64)).astype(codes.dtype)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return np.concatenate([codes, np.full(len(again), REPEAT, codes.dtype), bins]), np.concatenate([text, again, own])


class Model:
    def __init__(self, codes: np.ndarray, idf: np.ndarray, space: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int, sharp: float):
        self.idf, self.space, self.vectors, self.labels = idf, space, vectors, labels
        self.neighbours, self.sharp = min(neighbours, len(labels)), sharp
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.at = np.full(CODES, -1, np.int32)
        self.at[codes] = np.arange(len(codes))
        self.words = codes > REPEAT

    def embed(self, data: np.ndarray, bounds: np.ndarray, most: int = 1 << 21) -> np.ndarray:
        """Latent vectors; the dense counts of about ``most`` numbers at once are held."""
        codes, text = terms(data, bounds)
        at, kept = self.at[codes], self.at[codes] >= 0
        n, width = len(bounds) - 1, len(self.idf)
        total = np.bincount(text, weights=codes <= REPEAT, minlength=n), np.bincount(text, weights=codes > REPEAT, minlength=n)
        order = np.argsort(text[kept], kind="stable")
        at, text = at[kept][order], text[kept][order]
        out, step = np.zeros((n, self.space.shape[1])), max(1, most // max(1, width))
        for low in range(0, n, step):
            high = min(n, low + step)
            i, j = np.searchsorted(text, (low, high))
            counts = np.bincount((text[i:j] - low) * width + at[i:j], minlength=(high - low) * width).reshape(high - low, width)
            out[low:high] = _project(weights(counts, total[0][low:high], total[1][low:high], self.words, self.idf), self.space)
        return out

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if not len(self.labels) or not len(self.idf):
            return np.full(len(bounds) - 1, self.prior)
        found = self.embed(data, bounds)
        return np.concatenate([self._vote(found[i : i + BLOCK] @ self.vectors.T) for i in range(0, len(found), BLOCK)] or [np.zeros(0)])

    def _vote(self, cosines: np.ndarray) -> np.ndarray:
        """Scores of a block of texts from their cosines with all labelled vectors."""
        last = cosines.shape[1] - self.neighbours
        near = np.argpartition(cosines, last, axis=1)[:, last:]
        weight = np.maximum(0, np.take_along_axis(cosines, near, 1)) ** self.sharp
        vote = (weight * self.labels[near]).sum(1) + 1e-3 * self.prior
        return np.clip(vote / (weight.sum(1) + 1e-3), 0, 1)


def weights(counts, forms, words, is_word, idf):
    """Square roots of a term's share of its kind (form or word) in each text, times its weight."""
    total = np.where(is_word[None, :], np.maximum(1, words)[:, None], np.maximum(1, forms)[:, None])
    return np.sqrt(counts / total) * idf


def latent(rows: np.ndarray, dims: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """(term, dims): the leading right singular vectors, by subspace iteration."""
    width = min(rows.shape[1], min(rows.shape) if rows.size else 0, dims + 16)
    if not width:
        return np.zeros((rows.shape[1], 0))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(rows.shape[1], width)).astype(rows.dtype))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    turn = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    return basis @ turn[:dims].T


def _project(rows: np.ndarray, space: np.ndarray) -> np.ndarray:
    rows = rows @ space
    return rows / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))


def held_out(column, folds: int = FOLDS):
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, sample: int, folds: int):
    """Up to ``sample`` labelled rows as term counts, chosen by a hash of their id; on the driver, bounded by ``sample``."""
    few = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"), folds))
    few = few.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_label"))
    few = few.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(few), "_id").select("_id", "_label", "text")

    def run(batches):
        for batch in batches:
            for row, n, data, bounds in text_buffers(batch.column("text")):
                codes, text = terms(data, bounds)
                both, counts = np.unique(text.astype(np.int64) * CODES + codes, return_counts=True)
                at = np.searchsorted(both // CODES, np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32))) for x in (both % CODES, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(row, n), batch.column("_label").slice(row, n), *lists], ["_id", "_label", "codes", "counts"])

    found = rows.mapInArrow(run, "_id long, _label double, codes array<int>, counts array<int>")
    return found.orderBy(F.xxhash64("_id"), "_id", "_label", "codes", "counts").limit(sample).toArrow()


def fit(documents: DataFrame, labels: DataFrame, sample=SAMPLE, dims=DIMS, neighbours=NEIGHBOURS, sharp=SHARP, folds=FOLDS) -> Model:
    table = labelled(documents, labels, sample, folds)
    y = table.column("_label").to_numpy()
    lists, counts = ([x.values.to_numpy().astype(kind) for x in table.column(c).combine_chunks()] if len(y) else [] for c, kind in (("codes", np.int64), ("counts", np.float64)))
    seen, df = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_counts=True)
    enough = np.where(seen > REPEAT, np.maximum(2, SHARE * len(y)), np.maximum(2, 0.0005 * len(y)))
    codes, held = seen[df >= enough], df[df >= enough]
    idf = (np.log(len(y) / np.maximum(1, held)) + 0.3) * np.where(codes > REPEAT, WEIGHT, 1.0) if len(y) else np.zeros(0)
    # one matrix of at most ``sample`` rows, filled row by row in single precision
    rows = np.zeros((len(y), len(codes)), np.float32)
    for i, (c, n) in enumerate(zip(lists, counts)):
        good, word = np.isin(c, codes), c > REPEAT
        total = np.where(word, max(1.0, n[word].sum()), max(1.0, n[~word].sum()))
        at = np.searchsorted(codes, c[good])
        rows[i, at] = np.sqrt(n[good] / total[good]) * idf[at]
    space = latent(rows, dims)
    return Model(codes, idf, space, _project(rows, space), y, neighbours, sharp)


def score(spark: SparkSession, documents: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The rows of ``documents`` with their score and prediction, as columns ``names``, which ``documents`` must not have."""
    from pyspark.sql import types as T

    shared = spark.sparkContext.broadcast(model)
    columns = documents.columns
    if {n.lower() for n in names} & {c.lower() for c in columns}:
        raise ValueError(f"documents have a column {names[0]} or {names[1]}")
    schema = T.StructType([*documents.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.scores(data, bounds) for _, _, data, bounds in text_buffers(batch.column("text"))]
            found = np.concatenate([*found, np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(columns))), pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                [*columns, *names],
            )

    return documents.mapInArrow(run, schema)


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(spark, rows, fit(rows, labels), threshold)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
