"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``tables`` tables hashes a vector to ``floor((A v + b) / width)`` with
Gaussian ``A``. A query visits its own bucket and those whose perturbation scores,
the squared distances to the cell walls that it crosses, are least: ``probes``
buckets in order of estimated success. Candidates of all tables are merged and ranked by
exact distance.

``tune`` fits tables, hashes, width and probes to the data: of a bounded sample (``SAMPLE``
vectors, ``ASKED`` of them as queries, whose true neighbours among all vectors are found
first) it takes the cheapest setting that finds ``TARGET`` of these neighbours. As data grow
denser, finer buckets win, so a query meets a smaller share of all vectors; where
neighbours are hardly nearer than the average vector, no hash can tell them apart, and
the setting ends near a full search. Every vector is indexed.

Buckets are kept as packs of at most ``block`` vectors, and the queries that visit a bucket
likewise, so that one row of the join is a bounded matrix product. The packs of a hot bucket
are laid out on a grid of tasks, both sides split.

Equal vectors are indexed once, with their ``k + 1`` smallest ids, which is all that
ties can ask for; equal queries share one search. Queries for which the buckets hold
too few candidates are compared with every vector, by the same grid.

Vectors that are null, zero or hold null or non-finite components, or whose length
is not the most common one, take no part, as query or candidate. Null ids take no
part. Of rows that repeat an id with different vectors all are candidates, and each
is a query. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_hot

BLOCK, K, EVERY = 512, 10, 100
SAMPLE, ASKED, TARGET = 4096, 64, 0.95
SHARED = 1024  # vectors of the sample by which the share that a setting visits is estimated
SIDE = 8  # packs of either side that one cell of the grid of a bucket holds
MARGIN = 5  # nodes kept beyond those asked for, as sums of squares may differ in their last digits
SENT = 64  # what sending a vector to a bucket costs, in distances
HELD = 1 << 20  # candidates a task holds before it sends them on


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


class Hashes:
    def __init__(self, dims: int, tables: int, hashes: int, width: float, seed: int = 5):
        each = [np.random.default_rng((seed, t)) for t in range(tables)]  # a table is the same however many there are
        self.a, self.b, self.width = [r.normal(size=(dims, hashes)) for r in each], [r.uniform(0, width, hashes) for r in each], width
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))
        self.step = np.array([1009**i for i in range(hashes)], np.int64)

    def cells(self, t: int, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.a[t] + self.b[t]) / self.width

    def keys(self, t: int, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self.cells(t, vectors)).astype(np.int64) @ self.step

    def visited(self, t: int, queries: np.ndarray, near: list[np.ndarray], sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At which probe each query reaches its neighbours, and at which the sample; never: 3**hashes."""
        cells = self.cells(t, queries)
        home = np.floor(cells)
        order = np.argsort(np.argsort(self._scores(cells - home), axis=1, kind="stable"), axis=1)
        base = 3 ** np.arange(self.moves.shape[1] - 1, -1, -1)

        def rank(i, vectors):
            move = np.floor(self.cells(t, vectors)) - home[i]
            at = ((move + 1).clip(0, 2) @ base).astype(np.int64)
            return np.where((np.abs(move) <= 1).all(1), order[i][at], len(base) and 3 ** len(base))

        found = [rank(i, n) for i, n in enumerate(near) if len(n)]
        return np.concatenate([*found, np.zeros(0, np.int64)]), np.concatenate([rank(i, sample) for i in range(len(queries))])

    def _scores(self, inside: np.ndarray) -> np.ndarray:
        walls = np.stack([inside**2, np.zeros_like(inside), (1 - inside) ** 2], 2)
        return sum(walls[:, m, self.moves[:, m] + 1] for m in range(inside.shape[1]))

    def probes(self, t: int, vectors: np.ndarray, count: int) -> np.ndarray:
        cells = self.cells(t, vectors)
        home = np.floor(cells)
        order = np.argsort(self._scores(cells - home), axis=1, kind="stable")[:, :count]
        return (home.astype(np.int64)[:, None, :] + self.moves[order]) @ self.step


@dataclass(frozen=True)
class Setting:
    tables: int
    hashes: int
    width: float
    probes: int


def choose(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], rows: float, asked: float, target: float = TARGET) -> Setting:
    """The cheapest setting by which ``queries`` find ``target`` of their neighbours ``near``.

    Costs are estimated numbers of distances and, times ``SENT``, of vectors sent to a bucket.
    """
    scale = float(np.median([np.linalg.norm(n - q, axis=1).max() for q, n in zip(queries, near) if len(n)] or [1.0])) or 1.0
    everything = Setting(1, 1, 1e9 * scale, 1)
    best, least = everything, asked * rows + SENT * (rows + asked)
    for hashes in range(2, 7):
        for width in (0.5 * scale, 0.75 * scale, scale, 1.5 * scale, 2 * scale):
            ranks, share = [], []
            for t in range(4):
                family = Hashes(sample.shape[1], t + 1, hashes, width)
                found, all_ = family.visited(t, queries, near, sample[:SHARED])
                ranks.append(found)
                share.append(all_)
                first = np.sort(np.min(ranks, axis=0))
                if len(first) == 0:
                    continue
                probes = first[min(len(first) - 1, int(np.ceil(target * len(first))) - 1)]
                if probes >= 3**hashes:
                    continue
                work = sum((s <= probes).mean() for s in share)
                cost = asked * rows * work + SENT * (t + 1) * (rows + asked * (probes + 1))
                if cost < least:
                    best, least = Setting(t + 1, hashes, width, int(probes) + 1), cost
    return best


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _hashed(hashes: Hashes, tables: int, probes: int):
    """(table, bucket, node) of each vector, or of the buckets it visits."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, nodes = _matrix(batch.column("v")), batch.column("node").to_numpy()
            for t in range(tables):
                keys = hashes.probes(t, vectors, probes) if probes else hashes.keys(t, vectors)[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(keys.size, t, np.int32)), pa.array(keys.ravel()), pa.array(np.repeat(nodes, keys.shape[1]))], ["table", "bucket", "node"]
                )

    return run


def _nearest(k: int):
    """Best ``k`` nodes of each query among the blocks that a task sees."""

    def best(parts):
        q, n, d = (np.concatenate(x) for x in zip(*parts))
        both = np.unique(np.stack([q, n], 1), axis=0, return_index=True)[1]
        q, n, d = q[both], n[both], d[both]
        order = np.lexsort((n, d, q))
        q, n, d = q[order], n[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        return q[place < k], n[place < k], d[place < k]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("queries", "qv", "nodes", "nv")}
                queries, nodes = row["queries"].to_numpy(), row["nodes"].to_numpy()
                x, y = _matrix(row["qv"]), _matrix(row["nv"])
                x2, y2 = (x**2).sum(1), (y**2).sum(1)
                rough = x2[:, None] + y2 - 2 * x @ y.T
                # all that rounding may put among the first k are then measured by differences
                take = min(k, len(nodes)) - 1
                edge = np.partition(rough, take, axis=1)[:, take] + 1e-12 * (x2 + y2.max())
                i, j = np.nonzero(rough <= edge[:, None])
                d = np.concatenate([((x[a] - y[b]) ** 2).sum(1) for a, b in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1))])
                held.append(best([(queries[i], nodes[j], d)]))
                size += len(held[-1][0])
                if size > HELD:
                    held = [best(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield _pairs(held.pop())
                        size = 0
        if held:
            yield _pairs(best(held))

    return run


def _pairs(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(found[2])], ["query", "node", "rough"])


def _packed(rows: DataFrame, vectors: DataFrame, block: int, space: Workspace, name: str) -> DataFrame:
    """(table, bucket, part, parts, nodes, vs): buckets as packs of about ``block`` vectors, dealt by a hash, so that none is collected whole."""
    rows = space.table(rows, f"{name}-rows")
    sizes = space.table(rows.groupBy("table", "bucket").agg(F.count("*").alias("n"), F.ceil(2 * F.count("*") / block).cast("int").alias("parts")), f"{name}-sizes")
    rows = join_hot(rows, sizes, ["table", "bucket"], "n").join(vectors, "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", "table"), F.col("parts")).cast("int"))
    packs = rows.groupBy("table", "bucket", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("node", "v")).alias("_all"))
    packs = packs.select("table", "bucket", "part", "parts", F.col("_all.node").alias("nodes"), F.col("_all.v").alias("vs"))
    packs = space.table(packs, name)
    space.drop(f"{name}-rows", f"{name}-sizes")
    return packs


def _met(visits: DataFrame, stored: DataFrame, space: Workspace, name: str) -> DataFrame:
    """Each pack of queries with each pack of vectors of its bucket, on a grid of ``SIDE`` by ``SIDE`` packs a cell."""
    cells = lambda n: F.ceil(F.col(n) / SIDE).cast("int")
    # how many cells the other side has, per bucket: one row each
    rows = visits.groupBy("table", "bucket").agg(F.first("parts").alias("rows"))
    columns = stored.groupBy("table", "bucket").agg(F.first("parts").alias("columns"))
    both = space.table(rows.join(columns, ["table", "bucket"]), name)
    across = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
    key = ["table", "bucket"]
    left = join_hot(visits, both.select(*key, "columns", F.col("rows").alias("weight")), key, "weight", 1)
    left = left.select("table", "bucket", (F.col("part") % cells("parts")).alias("i"), across("columns").alias("j"), F.col("nodes").alias("queries"), F.col("vs").alias("qv"))
    right = join_hot(stored, both.select(*key, "rows", F.col("columns").alias("weight")), key, "weight", 1)
    right = right.select("table", "bucket", across("rows").alias("i"), (F.col("part") % cells("parts")).alias("j"), "nodes", F.col("vs").alias("nv"))
    return left.join(right, ["table", "bucket", "i", "j"]).select("queries", "qv", "nodes", "nv")


def _best(met: DataFrame, want: int) -> DataFrame:
    """(query, node): the ``want`` nearest nodes of each query, at most ``MARGIN`` more."""
    want += MARGIN
    found = met.mapInArrow(_nearest(want), "query long, node long, rough double").groupBy("query", "node").agg(F.min("rough").alias("rough"))
    best = Window.partitionBy("query").orderBy("rough", "node")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= want).select("query", "node")


def tune(vectors: DataFrame, dims: int, rows: int, asked: int, k: int, sample: int = SAMPLE, queries: int = ASKED, target: float = TARGET) -> Setting:
    """Fits a setting on at most ``sample`` vectors, chosen by a hash, and the true neighbours of ``queries`` of them."""
    few = vectors.orderBy(F.xxhash64("v"), "node").limit(sample).select("node", "v").toArrow()
    held, nodes = _matrix(few.column("v")), few.column("node").to_numpy()
    if len(nodes) < 2:
        return Setting(1, 1, 1e9, 1)
    ask, own = held[:queries], nodes[:queries]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y, ids = _matrix(batch.column("v")), batch.column("node").to_numpy()
            d = (ask**2).sum(1)[:, None] + (y**2).sum(1) - 2 * ask @ y.T
            d[own[:, None] == ids] = np.inf
            take = min(k, len(ids))
            near = np.argpartition(d, take - 1, axis=1)[:, :take]
            i = np.repeat(np.arange(len(own)), take)
            flat = y[near.ravel()]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * dims), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.take_along_axis(d, near, 1).ravel()), lists], ["i", "d", "v"])

    order = Window.partitionBy("i").orderBy("d")
    got = vectors.mapInArrow(run, "i long, d double, v array<double>").where("d < double('inf')")
    got = got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("i", "v").toArrow()
    i, v = got.column("i").to_numpy(), _matrix(got.column("v"))
    return choose(held, ask, [v[i == n] for n in range(len(own))] if len(i) else [np.zeros((0, dims))] * len(own), rows, asked, target)


def nearest(
    spark: SparkSession, embeddings: DataFrame, every: int = EVERY, k: int = K, setting: Setting | None = None, block: int = BLOCK, space: Workspace | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each id that ``every`` divides."""
    space = space or Workspace(spark, "ann")
    rows = usable(embeddings)
    common = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("v") == common["dims"])
    # one node for all equal vectors; -0.0 and 0.0 are equal
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("same", F.struct(F.xxhash64("v").alias("x"), F.hash("v").alias("y")))
    order = Window.partitionBy("same").orderBy("vec_id")
    ids = space.table(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1), "ids")
    heads = space.table(ids.where("place = 1").select(F.col("vec_id").alias("node"), "same", "v"), "heads")
    # a group of equal vectors has one head and one row here for each of its rows
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "same")
    counted = space.table(asked.groupBy("same").agg(F.count("*").alias("n")).join(heads.select("same", F.col("node").alias("query")), "same"), "counted")
    asked = space.table(join_hot(asked, counted, ["same"], "n").select("query_id", "query"), "asked")
    vectors = heads.select("node", "v")
    queries = space.table(vectors.join(counted.select(F.col("query").alias("node")), "node", "left_semi"), "queries")
    sent = queries.count()
    setting = setting or tune(vectors, common["dims"], vectors.count(), sent, k)
    family = Hashes(common["dims"], setting.tables, setting.hashes, setting.width)
    schema = "table int, bucket long, node long"
    visits = _packed(queries.mapInArrow(_hashed(family, setting.tables, min(setting.probes, 3**setting.hashes)), schema), queries, block, space, "visits")
    stored = _packed(vectors.mapInArrow(_hashed(family, setting.tables, 0), schema), vectors, block, space, "stored")
    # a query's own node is among its k + 1 nearest, and equal vectors make one node
    want = k + 1
    found = space.table(_best(_met(visits, stored, space, "met"), want), "found")
    few = queries.join(found.groupBy(F.col("query").alias("node")).count().where(F.col("count") >= want).select("node"), "node", "left_anti")
    few = space.table(few, "few")
    if not few.isEmpty():
        whole = lambda frame: frame.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"), "node")
        rest = _met(_packed(whole(few), few, block, space, "few-packs"), _packed(whole(vectors), vectors, block, space, "all-packs"), space, "met-2")
        found = space.table(found.unionByName(_best(rest, want)).distinct(), "found-2")
    near = found.join(heads.select("node", "same"), "node").join(ids.select("same", "vec_id", "v"), "same").select("query", "vec_id", "v")
    pairs = asked.join(near, "query").where("query_id <> vec_id")
    pairs = pairs.join(queries.select(F.col("node").alias("query"), F.col("v").alias("w")), "query")
    square = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    pairs = pairs.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return pairs.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
