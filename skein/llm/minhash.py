"""MinHash near-duplicates: universal minima, banding, verification, alternating stars.

1. A document's set holds the hashes of its distinct ``gram``-word shingles. Texts
   with equal sets form a class with one representative, so copies never meet again.
2. ``bands * rows`` multiply-shift hashes give each set its minima. At a similarity
   of exactly 0.8 a pair shares no band with probability (1 - 0.8**5)**32 = 3e-6.
3. Buckets (band, minima) of two or more classes give candidate pairs. Pairs are
   never enumerated within a bucket: each member meets the bucket's hub. Round after
   round, with other hubs, only members of components other than the hub's meet it.
   Buckets that still hold several components are compared block by block of bounded
   size, across components only; each two blocks give one link for each two components.
4. Candidates whose minima agree too seldom (five standard deviations below the
   threshold) go. The rest is confirmed on full sets: 100 * both >= percent * either.
5. Components come from alternating large-star and small-star.

Results: a text without words has an empty set and is linked with nothing; it is
its own component. A text with fewer words than a shingle is one shingle. A null
doc_id is linked with nothing, its component is null and it is not kept. Rows that
repeat a doc_id with the same text share a component and are all kept if it is the
smallest. Different texts under one doc_id are linked each by itself; a component is
named by its least doc_id, so two of them can have the same name. Extra columns are
ignored; without rows there are none out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Workspace, fresh, gram_hashes, join_hot, mix, span_hashes, text_buffers, word_hashes

GRAM, PERCENT, BANDS, ROWS, BLOCK, ROUNDS = 4, 80, 32, 5, 1024, 2


def shingle_sets(data: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of texts that lie end to end, sorted within each, and where each begins."""
    words, first = word_hashes(data, bounds, lower=True)
    counts = np.diff(first)
    grams = gram_hashes(words, gram)
    text = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    inside = np.arange(len(grams)) + gram <= first[text + 1]
    grams, text = grams[inside], text[inside]
    short = np.flatnonzero((counts > 0) & (counts < gram))
    if len(short):
        grams = np.concatenate([grams, span_hashes(words, first[short], first[short + 1])])
        text = np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(bounds)))


def _signed(gram: int, bands: int, rows: int):
    rng = np.random.default_rng(8191)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=np.int64).astype(U64)
    salt = mix(np.arange(1, bands + 1).astype(U64) * U64(0x9E3779B97F4A7C15))

    def run(batches):
        for batch in batches:
            for row, n, data, bounds in text_buffers(batch.column("text"), 1 << 20):
                grams, at = shingle_sets(data, bounds, gram)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes > 0)
                one, two = np.zeros(n, U64), np.zeros(n, U64)
                minima = np.zeros((n, bands * rows), np.uint32)
                if len(full):
                    heads = at[full]
                    one[full] = np.add.reduceat(mix(grams), heads)
                    two[full] = np.add.reduceat(mix(grams ^ U64(0x5851F42D4C957F2D)), heads)
                    for i in range(bands * rows):
                        minima[full, i] = np.minimum.reduceat(((grams * a[i] + b[i]) >> U64(32)).astype(np.uint32), heads)
                keys = np.zeros((n, bands), U64)
                for i in range(rows):
                    keys = mix(keys ^ minima[:, i::rows])
                keys = mix(keys + salt)
                marks = np.ascontiguousarray((minima & 0xFFFF).astype("<u2"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        batch.column("text_key").slice(row, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel())),
                        pa.array([x.tobytes() for x in marks], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "one", "two", "keys", "minima"],
                )

    return run


def _sets(gram: int, packed: bool = False):
    def run(batches):
        for batch in batches:
            for row, n, data, bounds in text_buffers(batch.column("text")):
                grams, at = shingle_sets(data, bounds, gram)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
                if packed:
                    sets = pa.array([grams[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, n), sets], ["node", "shingles"])

    return run


# --- components --------------------------------------------------------------


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(space: Workspace, edges: DataFrame, name: str, most: int = 64) -> DataFrame:
    """(a, b): each node of ``edges`` that isn't the smallest of its component, and that smallest node."""
    state = edges.select("a", "b").where("a <> b")
    stamp = None
    for i in range(most):
        old, state = state, space.table(_small_star(_large_star(state)), f"{name}-star-{i}")
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if i:
            space.drop(f"{name}-star-{i - 1}")
        if now == stamp:
            return state
        stamp = now
    raise RuntimeError("components did not settle")


# --- candidates --------------------------------------------------------------


def _close(percent: int, hashes: int):
    """Least share of equal minima a pair at the threshold has, but for one in millions."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / hashes) ** 0.5


def _agree(pairs, hashes: int, least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, hashes) for c in ("x", "y"))
            good = pa.array((x == y).mean(1) >= least)
            yield batch.select(["a", "b"]).filter(good)

    return pairs.mapInArrow(run, "a long, b long")


def _array(column) -> np.ndarray:
    """A column as an array: lists of one length as rows, binary values as objects."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if pa.types.is_binary(column.type):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    return column.to_numpy(zero_copy_only=False)


def _groups(batches):
    """The groups (key, low, high) of sorted rows, as arrays by column; at most one batch and one group are held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: _array(batch.column(c)) for c in batch.schema.names}
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        new = np.zeros(len(rows["key"]) - 1, bool)
        for c in ("key", "low", "high"):
            new |= rows[c][1:] != rows[c][:-1]
        at = [0, *(np.flatnonzero(new) + 1)]
        for i, j in zip(at, at[1:]):
            yield {c: v[i:j] for c, v in rows.items()}
        held = {c: v[at[-1] :].copy() for c, v in rows.items()}
    if held is not None:
        yield held


def _in_groups(rows: DataFrame, run, schema: str) -> DataFrame:
    """Applies ``run`` to the groups (key, low, high); it gives a tuple of columns, or None."""
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]

    def send(held):
        columns = [np.concatenate(x) for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])

    def body(batches):
        held, size = [], 0
        for group in _groups(batches):
            if len(group["key"]) > 1 and (out := run(group)) is not None:
                held.append(out)
                size += len(out[0])
                if size >= 4096:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(body, schema)


def _sides(group) -> tuple[np.ndarray, np.ndarray]:
    left, right = (np.flatnonzero(group["side"] == side) for side in (0, 1))
    return (left, left) if group["low"][0] == group["high"][0] else (left, right)


def _hopeful(hashes: int, least: float):
    """Rows of one pair of blocks that may be similar to a row of another component, by their minima.

    Two rows meet in many buckets; only the first band they share counts.
    """

    def run(group):
        left, right = _sides(group)
        if not len(left) or not len(right):
            return None
        minima = np.frombuffer(b"".join(group["minima"]), "<u2").reshape(-1, hashes)
        y, theirs, keys, key = minima[right], group["label"][right], group["keys"][right], group["key"][0]
        good = np.zeros(len(minima), bool)
        for i in left:
            shared = group["keys"][i] == keys
            near = (theirs != group["label"][i]) & (group["keys"][i][shared.argmax(1)] == key)
            near[near] = (minima[i] == y[near]).mean(1) >= least
            good[i] |= near.any()
            good[right[near]] = True
        return tuple(group[c][good] for c in ("key", "node", "label", "low", "high", "side")) if good.any() else None

    return run


def _linking(percent: int, most: int = 1 << 21):
    """Similar pairs across components in one pair of blocks, by full sets: one link for each two components.

    Shingles are compared in parts of about ``most`` values.
    """

    def shared(sets, n, both):
        of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        at, keep = np.cumsum(count > 1) - 1, count[code] > 1
        code, of = at[code[keep]], of[keep]
        order = np.argsort(code, kind="stable")
        code, of = code[order], of[order]
        for low in range(0, int((count > 1).sum()), 2048):
            i, j = np.searchsorted(code, (low, low + 2048))
            dense = np.zeros((len(sets), 2048), np.float32)
            dense[of[i:j], code[i:j] - low] = 1
            both += dense[:n] @ dense[n:].T

    def run(group):
        left, right = _sides(group)
        if not len(left) or not len(right):
            return None
        sets = [np.frombuffer(group["shingles"][i], np.uint64) for i in (*left, *right)]
        size = np.array([len(x) for x in sets])
        both = np.zeros((len(left), len(right)), np.float32)
        parts = int(size.sum()) // most + 1
        for part in range(parts):
            shared(sets if parts == 1 else [x[x % U64(parts) == U64(part)] for x in sets], len(left), both)
        either = size[: len(left), None] + size[None, len(left) :] - both
        a, b = group["label"][left], group["label"][right]
        links = {}
        for i, j in np.argwhere((100 * both >= percent * either) & (a[:, None] != b[None, :])):
            links.setdefault((min(a[i], b[j]), max(a[i], b[j])), (group["node"][left[i]], group["node"][right[j]]))
        return tuple(np.array(x, np.int64) for x in zip(*links.values())) if links else None

    return run


def _near_duplicates(
    spark: SparkSession,
    documents: DataFrame,
    gram: int = GRAM,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    rounds: int = ROUNDS,
    space: Workspace | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One row per document: doc_id, text_key, n_shingles, component_id, kept. A class's node is a number of its own."""
    space = space or Workspace(spark, "minhash")
    hashes, least = bands * rows, _close(percent, bands * rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, n_shingles long, one long, two long, keys array<long>, minima binary"
    signed = space.table(texts.mapInArrow(_signed(gram, bands, rows), schema), "signed")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("one", "two", "n_shingles").agg(F.min(F.struct("doc_id", "text_key")).alias("h"))
    classes = classes.select("one", "two", "n_shingles", F.col("h.doc_id").alias("doc_id"), F.col("h.text_key").alias("text_key"))
    classes = space.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = signed.join(classes.select("one", "two", "n_shingles", "doc_id", "text_key", "node"), ["one", "two", "n_shingles", "doc_id", "text_key"])
    heads = space.table(heads.select("node", "keys", "minima").dropDuplicates(["node"]), "heads")
    members = heads.select("node", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    full = space.table(full.withColumn("weight", F.col("n")), "full")
    members = space.table(join_hot(members, full, ["key"], "weight"), "members")
    space.drop("full")
    space.release()
    minima = heads.select("node", "minima")

    def text_of(nodes):
        """(node, text) of classes; a repeated row gives a text twice."""
        return texts.join(classes.select("node", "doc_id", "text_key").join(nodes, "node"), ["doc_id", "text_key"]).select("node", "text")

    def labelled(labels):
        if labels is None:
            return members.withColumn("label", F.col("node"))
        named = labels.select(F.col("a").alias("node"), F.col("b").alias("label"))
        return members.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def confirm(pairs, step):
        """Keeps the candidate pairs that are similar enough on full sets."""
        used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = text_of(used).mapInArrow(_sets(gram), "node long, shingles array<long>")
        sets = space.table(sets.dropDuplicates(["node"]), f"sets-{step}")
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        either = F.size("x") + F.size("y") - both
        linked = pairs.join(x, "a").join(y, "b").where(100 * both >= percent * either).select("a", "b")
        linked = space.table(linked, f"linked-{step}")
        space.drop(f"sets-{step}")
        return linked

    def similar(pairs):
        x = minima.select(F.col("node").alias("a"), F.col("minima").alias("x"))
        y = minima.select(F.col("node").alias("b"), F.col("minima").alias("y"))
        return _agree(pairs.join(x, "a").join(y, "b"), hashes, least)

    labels = None
    for i in range(rounds + 1):
        seen = labelled(labels)
        if i == 0:
            pairs = similar(seen.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
        else:
            mixed = seen.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.min(F.struct(F.xxhash64("node", "key", F.lit(i)), "node", "label")).alias("h"), F.count("*").alias("weight"))
            mixed = space.table(mixed.where("p <> q").select("key", F.col("h.node").alias("other"), F.col("h.label").alias("o"), "weight"), f"mixed-{i}")
            if i < rounds:
                met = join_hot(seen, mixed, ["key"], "weight").where("label <> o")
                pairs = similar(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
            else:
                rest = join_hot(seen, mixed.select("key", "weight"), ["key"], "weight").select("key", "node", "label", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
                own = rest.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
                own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                own = own.select("key", "node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
                kept = "key long, node long, label long, low int, high int, side int"
                own = _in_groups(own.join(heads, "node"), _hopeful(hashes, least), kept)
                own = space.table(own, "hopeful")
                if own.isEmpty():
                    continue
                sets = text_of(own.select("node").distinct())
                sets = space.table(sets.mapInArrow(_sets(gram, True), "node long, shingles binary").dropDuplicates(["node"]), "hopeful-sets")
                linked = _in_groups(own.join(sets, "node"), _linking(percent), "a long, b long").distinct()
                linked = space.table(linked, "linked-last")
        if i < rounds:
            pairs = space.table(pairs, f"pairs-{i}")
            linked = None if pairs.isEmpty() else confirm(pairs, i)
        space.release()
        if linked is None:
            continue
        if linked.isEmpty():
            continue
        labels = components(space, linked if labels is None else labels.unionByName(linked), f"round-{i}")
        space.release()
    named = classes.withColumn("component_id", F.col("doc_id"))
    if labels is not None:
        found = classes.join(labels.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = found.join(found.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    named = named.select("one", "two", "n_shingles", "component_id")
    out = signed.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "one", "two").join(named, ["one", "two", "n_shingles"], "left")
    out = out.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.unionByName(signed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out, signed, classes


def near_duplicates(
    spark: SparkSession,
    documents: DataFrame,
    gram: int = GRAM,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
    rounds: int = ROUNDS,
    space: Workspace | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _near_duplicates(spark, documents, gram, percent, bands, rows, block, rounds, space)[0].drop("text_key")


def without_near_duplicates(spark: SparkSession, documents: DataFrame, gram: int = 5, space: Workspace | None = None) -> DataFrame:
    """The rows of ``documents`` that are kept: one doc_id of each component, and of rows without an id one of each class that no id has.

    Rows without an id and without words are all kept. Columns may have any names.
    """
    found, signed, classes = _near_duplicates(spark, documents, gram=gram, space=space)
    gone, key, many = fresh(documents.columns, "gone", "key", "many")
    rows = documents.withColumn(key, F.xxhash64("text"))
    lost = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(gone), F.col("text_key").alias(many)).distinct()
    named = rows.where("doc_id IS NOT NULL").join(lost, (rows["doc_id"].cast("long") == F.col(gone)) & (F.col(key) == F.col(many)), "left_anti").drop(key)
    nameless = signed.where("doc_id IS NULL AND n_shingles > 0").select("one", "two", "n_shingles", F.col("text_key").alias(key))
    new = nameless.join(classes, ["one", "two", "n_shingles"], "left_anti").groupBy("one", "two", "n_shingles").agg(F.min(key).alias(key)).select(key)
    rest = rows.where("doc_id IS NULL")
    blank = rest.join(nameless.select(key).distinct(), key, "left_anti").select(*[f"`{c}`" for c in documents.columns])
    one = rest.join(new, key, "left_semi").dropDuplicates([key]).select(*[f"`{c}`" for c in documents.columns])
    return named.unionByName(one).unionByName(blank)
