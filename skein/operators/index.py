"""A full-text index in a folder: postings by token, blocks of postings with their bounds, terms, documents, totals.

A posting is a token in a document, with its places in each field. Within a document words are grouped
before any shuffle, in Arrow batches. Postings are dealt to parts by a slot of a token's first two characters: how many parts a slot gets
follows from its share in a bounded sample of the documents, and the number of parts from the bytes of text, so that no
part grows with the corpus; within a slot documents are spread. Parts are folders, their rows sorted by token and
cell; so a query reads the folders of its own slots and there the pages of its own terms.

Documents fall into cells of about ``CELL`` by a hash. All postings of a token in a cell are a block, of which a row says
how many they are and what the token gives a document there at most. From these few rows follows the greatest
score a cell can give, so that the best hits are found without reading the rest, and counts up to a cap without reading postings.

An index is built aside and moved to its place at the end; of two that are built at once one stays.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.workspace import Workspace, delete, exists, fingerprint, shared_root, ship, size_of

VERSION, SLOTS, CELL, SAMPLE = 8, 4096, 1024, 4096
#: Bytes of files a part stands for: its task sorts some forty times as much.
PART_BYTES = 16 << 20
#: Fixed values of BM25.
K1, B = 1.2, 0.75
#: The weights of the fields of a document.
FIELDS = {"path": 3.0, "name": 5.0, "terms": 2.0, "body": 1.0}
_POSTINGS = "token string, cell int, doc_id long, dl long, w double, fields array<tinyint>, positions array<int>, part int"
_BLOCKS = "token string, cell int, n long, top double, part int"
_TOTALS = "n long, avgdl double, cells int, parts int, layout string"


def slot_of(token: str) -> int:
    return zlib.crc32(token[:2].encode()) % SLOTS


def _slot(token: Column) -> Column:
    return (F.crc32(F.left(token, F.lit(2)).cast("binary")) % SLOTS).cast("int")


def _literals(layout) -> tuple[Column, Column]:
    """First parts and numbers of parts as arrays; each is one literal that Spark folds."""
    return tuple(F.split(F.lit(",".join(str(x[k]) for x in layout)), ",").cast("array<int>") for k in (0, 1))


def layout_of(shares: dict[int, float], parts: int) -> list[tuple[int, int]]:
    """(first part, number of parts) of each slot; slots of small shares stand together in one part."""
    out, at, filled = [], 0, 0.0
    for slot in range(SLOTS):
        share = shares.get(slot, 0.0) * parts
        if share > 1:
            if filled:
                at, filled = at + 1, 0.0
            n = round(share)
            out.append((at, n))
            at += n
            continue
        if filled and filled + share > 1:
            at, filled = at + 1, 0.0
        out.append((at, 1))
        filled += max(share, 1e-9)
    return out


#: How many words a task groups at once, unless one document has more.
WORDS = 1 << 20
_GROUPED = "doc_id long, dl long, token string, fields array<tinyint>, positions array<int>"


def _grouped(batches):
    """Distinct words of each document with the fields and places where they stand, by field and place.

    From Arrow batches (doc_id, words of all fields in their order, number of words of each field); nothing in them is null.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("words")
        bounds = np.asarray(texts.offsets).astype(np.int64)
        sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), -1)
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + WORDS, "right")) - 1)
            coded = texts.values.slice(bounds[row], bounds[end] - bounds[row]).dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), bounds[end] - bounds[row]
            length = np.diff(bounds[row : end + 1])
            doc = np.repeat(np.arange(end - row), length)
            each = sizes[row:end].ravel()
            field = np.repeat(np.tile(np.arange(sizes.shape[1], dtype=np.int8), end - row), each)
            place = (np.arange(n) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
            key = doc * max(len(coded.dictionary), 1) + code
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            at, cuts = order[starts], pa.array(np.append(starts, n).astype(np.int32))
            columns = [
                ids.take(pa.array(row + doc[at])), pa.array(length[doc[at]]), coded.dictionary.take(pa.array(code[at])),
                pa.ListArray.from_arrays(cuts, pa.array(field[order])), pa.ListArray.from_arrays(cuts, pa.array(place[order])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "dl", "token", "fields", "positions"])
            row = end


def weighted(fields: Column, weights: dict[str, float] | None = None) -> Column:
    """The weighted frequency of a posting, from the numbers of the fields where it stands."""
    table = F.array(*[F.lit((weights or FIELDS).get(f, 0.0)) for f in FIELDS])
    return F.aggregate(fields, F.lit(0.0), lambda acc, f: acc + F.get(table, f.cast("int")))


def saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    """What a weighted frequency gives in a document of a length, before the weight of the term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl or 1.0)))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.postings = spark.read.schema(_POSTINGS).parquet(f"{root}/postings")
        self.blocks = spark.read.schema(_BLOCKS).parquet(f"{root}/blocks")
        self.docs = spark.read.parquet(f"{root}/docs")
        total = spark.read.schema(_TOTALS).parquet(f"{root}/totals").first()
        self.n, self.avgdl, self.cells, self.layout = total.n, total.avgdl, total.cells, json.loads(total.layout)

    @classmethod
    def build(cls, spark: SparkSession, documents: DataFrame, root: str, text_bytes: int = 0, *keep: str) -> TextIndex:
        """From (doc_id, path, name, terms, body); null fields are empty, columns ``keep`` stand in ``docs``. ``text_bytes`` is about
        the size of the documents and gives the number of parts.
        """
        ship(spark)
        aside = f"{root}-{uuid.uuid4().hex[:8]}"
        space = Workspace(spark, "index", aside)
        words = [T.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS]
        parts = max(spark.sparkContext.defaultParallelism, -(-text_bytes // PART_BYTES))
        if text_bytes < parts * PART_BYTES:  # so few that they may lie in one file, which one task would read
            documents = documents.repartition(parts)
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "path", *keep, F.struct(*words).alias("w"))
        rows = rows.withColumn("dl", sum((F.size(f"w.{f}") for f in FIELDS), F.lit(0)).cast("long"))
        docs = space.table(rows.select("doc_id", "path", "dl", *keep).sortWithinPartitions("doc_id"), "docs")
        total = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        cells = max(1, -(-total.n // CELL))
        # the documents of least hash are the sample; its counts have ``SLOTS`` rows at most
        least = min((1 << 63) - 1, -(1 << 63) + int(min(1.0, SAMPLE / max(total.n, 1)) * (1 << 64)))
        some = rows.where(F.xxhash64("doc_id", F.lit("sample")) <= least).select(F.explode(F.concat(*[F.array_distinct(f"w.{f}") for f in FIELDS])).alias("token"))
        counts = {r.slot: r["count"] for r in some.groupBy(_slot(F.col("token")).alias("slot")).count().collect()}
        layout = layout_of({k: v / max(sum(counts.values()), 1) for k, v in counts.items()}, parts)
        first, wide = _literals(layout)
        words = rows.select("doc_id", F.concat(*[f"w.{f}" for f in FIELDS]).alias("words"), F.array(*[F.size(f"w.{f}") for f in FIELDS]).alias("sizes"))
        each = words.mapInArrow(_grouped, _GROUPED)
        slot = _slot(F.col("token"))
        each = each.withColumn("part", (first[slot] + F.pmod(F.xxhash64("doc_id"), wide[slot])).cast("int"))
        # dealt by part once: the folders need no other shuffle
        used = layout[-1][0] + layout[-1][1]
        cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell")
        held = each.repartitionById(used, F.col("part")).select("token", cell, "doc_id", "dl", weighted(F.col("fields")).alias("w"), "fields", "positions", "part")
        held = held.sortWithinPartitions("part", "token", "cell", "doc_id")
        paged = lambda writer: writer.option("compression", "zstd").option("parquet.page.size", 1 << 16).option("parquet.page.row.count.limit", 2048).partitionBy("part")
        paged(held.write.mode("overwrite")).parquet(f"{aside}/postings")
        postings = spark.read.schema(_POSTINGS).parquet(f"{aside}/postings").select("token", "cell", "dl", "w", "part")
        blocks = postings.groupBy("part", "token", "cell").agg(F.count("*").alias("n"), F.max(saturated(F.col("w"), F.col("dl"), float(total.avgdl or 0))).alias("top"))
        paged(blocks.repartitionById(used, F.col("part")).sortWithinPartitions("part", "token", "cell").write.mode("overwrite")).parquet(f"{aside}/blocks")
        whole = (total.n, float(total.avgdl or 0), cells, used, json.dumps(layout))
        space.table(spark.range(1).select(*[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(whole, (c.split() for c in _TOTALS.split(", ")))]), "totals")
        _moved(spark, aside, root)
        return cls(spark, root)

    @classmethod
    def of(cls, spark: SparkSession, documents: DataFrame, *paths: str, keep: tuple[str, ...] = ()) -> TextIndex:
        """The index of documents read from ``paths``: built once for these very files, then opened."""
        root = f"{shared_root(spark)}/skein-index-{fingerprint(spark, VERSION, *paths)}"
        return cls(spark, root) if exists(spark, f"{root}/totals/_SUCCESS") else cls.build(spark, documents, root, size_of(spark, *paths), *keep)

    def parts_of(self, terms: list[str], prefix: bool = False) -> Column:
        """Whether a part may hold one of the terms."""
        if prefix and any(len(t) < 2 for t in terms):  # one letter begins tokens of any slot
            return F.lit(True)
        found = {first + k for first, n in (self.layout[slot_of(t)] for t in terms) for k in range(n)}
        return F.col("part").isin(*sorted(found))

    def holding(self, terms: list[str], prefix: bool = False) -> DataFrame:
        """(token, cell, doc_id, dl, w, fields, positions) of the tokens that equal a term or, as asked, begin with one; ``w`` is the weighted frequency."""
        return self._of(self.postings, terms, prefix)

    def _of(self, rows: DataFrame, terms: list[str], prefix: bool = False) -> DataFrame:
        if not terms:
            return rows.where("false")
        rows = rows.where(self.parts_of(terms, prefix))
        if not prefix:
            return rows.where(F.col("token").isin(*terms))
        test = F.col("token").startswith(terms[0])
        for term in terms[1:]:
            test = test | F.col("token").startswith(term)
        return rows.where(test)

    def in_fields(self, terms: list[str]) -> DataFrame:
        """(token, doc_id, dl, field, tf, positions) of the tokens that equal a term."""
        names = F.array(*map(F.lit, FIELDS))
        place = F.filter(F.arrays_zip("fields", "positions"), lambda x: x["fields"] == F.col("f"))
        rows = self.holding(terms).withColumn("f", F.explode(F.array_distinct("fields"))).withColumn("positions", F.transform(place, lambda x: x["positions"]))
        return rows.select("token", "doc_id", "dl", F.get(names, F.col("f").cast("int")).alias("field"), F.size("positions").alias("tf"), "positions")

    def blocks_of(self, terms: list[str]) -> DataFrame:
        return self._of(self.blocks, terms)

    def frequencies(self, wanted: DataFrame | None = None, cap: int | None = None) -> DataFrame:
        """(token, df): how many documents hold a token (of those in ``wanted``) in any field, ``cap`` at most.

        Summed over blocks, so that a common word reads one row for each cell, not for each document.
        """
        rows = self.blocks
        if wanted is not None:
            slot = _slot(F.col("token"))
            first, wide = _literals(self.layout)
            asked = wanted.select("token").distinct().withColumn("part", F.explode(F.sequence(first[slot], first[slot] + wide[slot] - 1)))
            rows = rows.join(asked, ["part", "token"])
        got = rows.groupBy("token").agg(F.sum("n").alias("df"))
        return got if cap is None else got.select("token", F.least("df", F.lit(cap)).cast("long").alias("df"))


def _moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder unless the target is there, then deletes it; the first of several stays."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.getFileSystem(conf).getUri(), conf).rename(a, b, options)
        return True
    except Exception:
        if not exists(spark, f"{target}/totals/_SUCCESS"):
            raise
        delete(spark, source)
        return False
