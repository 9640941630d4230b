"""Vector expressions over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """A unit vector; an error for empty, zero or non-finite ones."""
    bad = (F.size(a) == 0) | F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm(a) < 1e-12)
    unit = F.transform(a, lambda x: x.cast("double") / norm(a))
    return F.when(bad, F.raise_error(F.lit("vector can't be normalised")).cast("array<double>")).otherwise(unit)


def hash_embedding(documents: DataFrame, dims: int = 256) -> DataFrame:
    """(doc_id, vector) from (doc_id, words): each word adds its sign to a slot, both from its digest; unit length.

    A document without words has the zero vector. Slots are summed before the shuffle.
    """
    digest = F.md5("token")
    number = lambda at, size: F.conv(F.substring(digest, at, size), 16, 10).cast("long")
    words = documents.select("doc_id", F.explode("words").alias("token"))
    signed = words.select("doc_id", (number(1, 8) % dims).cast("int").alias("slot"), F.when(number(9, 2) % 2 == 1, -1.0).otherwise(1.0).alias("sign"))
    slots = signed.groupBy("doc_id", "slot").agg(F.sum("sign").alias("w"))
    filled = slots.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    rows = documents.select("doc_id").join(filled, "doc_id", "left")
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    size = norm(F.col("v"))
    return rows.select("doc_id", raw.alias("v")).select("doc_id", F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("vector"))


def _best(k: int, near: bool):
    """Of each query the best ``k`` rows of a task's blocks, and those that rounding to six places may put among them.

    ``scores`` stands inside, so that workers get it with the task and need no package.
    """

    def scores(x: list, y: list) -> tuple[np.ndarray, np.ndarray]:
        """Dot products of all pairs, summed in the order of the components, and which of them exist.

        A null vector or component, or unequal lengths, give none.
        """
        out, known = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
        size = [np.array([-1 if v is None or None in v else len(v) for v in side]) for side in (x, y)]
        for n in set(size[0]) & set(size[1]) - {-1}:
            i, j = np.flatnonzero(size[0] == n), np.flatnonzero(size[1] == n)
            a, b = np.array([x[k] for k in i], float).reshape(len(i), n), np.array([y[k] for k in j], float).reshape(len(j), n)
            part = np.zeros((len(i), len(j)))
            with np.errstate(invalid="ignore", over="ignore"):
                for d in range(n):
                    part += a[:, d, None] * b[:, d]
            out[np.ix_(i, j)], known[np.ix_(i, j)] = part, True
        return out, known

    def pruned(parts):
        q, v, order, score, known = (np.concatenate(x) for x in zip(*parts))
        at = np.lexsort((v, ~known, -order, q))
        q, v, order, score, known = (x[at] for x in (q, v, order, score, known))
        heads = np.searchsorted(q, q)
        least = order[np.minimum(heads + k, np.searchsorted(q, q, "right")) - 1]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (order[1:] != order[:-1]) | (known[1:] != known[:-1])
        tied = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        good = (order >= least - 2e-6) & (tied < k)  # of equal scores only the least ids can count
        return q[good], v[good], order[good], score[good], known[good]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("qs", "vs"))
                if near:
                    score = -np.abs(v - q[:, None]).astype(float)
                    known = np.ones(score.shape, bool)
                else:
                    score, known = scores(batch.column("qe")[i].as_py(), batch.column("ve")[i].as_py())
                order = np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)
                order[v == q[:, None]] = -np.inf
                take = min(k, len(v))
                least = np.partition(order, len(v) - take, axis=1)[:, len(v) - take]
                a, b = np.nonzero((order >= least[:, None] - 2e-6) & (v != q[:, None]))
                held.append((q[a], v[b], order[a, b], score[a, b], known[a, b]))
                size += len(a)
                if size > 1 << 18:
                    held = [pruned(held)]
                    size = len(held[0][0])
        if size:
            q, v, _, score, known = pruned(held)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score, mask=~known, from_pandas=False)], ["query_id", "vec_id", "score"])

    return run


def best_in_blocks(vectors: DataFrame, every: int, k: int, near: bool = False, block: int = 512) -> DataFrame:
    """(query_id, vec_id, score): all pairs that can be among the best ``k`` of a query, a vector whose id ``every`` divides.

    Packs of queries meet blocks of all vectors, so neither side is broadcast whole. ``near`` scores by distance of ids.
    """
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def packed(frame, ids, values):
        parts = max(1, -(-2 * frame.count() // block))
        packs = frame.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("_all"))
        return packs.select(F.col("_all.vec_id").alias(ids), F.col("_all.embedding").alias(values))

    met = packed(rows.where(F.col("vec_id") % every == 0), "qs", "qe").crossJoin(packed(rows, "vs", "ve"))
    return met.mapInArrow(_best(k, near), "query_id long, vec_id long, score double")
