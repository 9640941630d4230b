"""Cross-tokenizer alignment by a per-byte label string.

A text with a space before it is encoded by two vocabularies, a byte-level one (A) and one of pieces (B).
Each byte of it gets a label: none, the end of an A token, the end of a B token, or both. A regular expression
takes the spans up to each label of both; the labels inside a span say how many tokens of either
kind its group holds.

Both vocabularies cut a text before every space that follows something else than white space, so such
parts are aligned once, and what they gave is kept until more than ``MEMO`` parts or ``HELD`` characters
are known to a worker. That B's pieces allow this is tested when they are loaded; where they don't, a text is one part.

All A and B tokens of a group are linked. A pair of identifiers counts the documents that hold it linked. A document's
pairs are distinct rows with the number of their links, so no link is listed one by one: of a large group only the distinct
identifiers of either side meet. Counts of pairs are broadcast to the tasks while they are few
(``MOST`` at most, which is checked), and joined by a shuffle with hot pairs set apart beyond that.

Results: null and empty texts, and those that a vocabulary doesn't give back byte for byte, have no tokens: zeros and an empty
digest. Rows that repeat an id are documents of their own, and a null id stays null. Extra columns are
ignored. Memory is in proportion to the longest text and its distinct pairs. Without rows there is no result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_hot
from .packing import tokenizer

MEMO, HELD = 1 << 18, 1 << 24
SLICE = 1 << 20
MOST = 1 << 21
PART_PAIRS = 1 << 18
LARGE_GROUP = 1 << 12
NONE, A_END, B_END, BOTH = b"-ABC"
SPAN = re.compile(rb"[^C]*C")
#: Parts begin before a space that follows no white space.
PARTS = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*|\s+")


def spans_of(labels: bytes) -> np.ndarray:
    """A tokens, B tokens and bytes of each span up to a label of both."""
    seen: dict[bytes, int] = {}
    each = [seen.setdefault(s, len(seen)) for s in SPAN.findall(labels)]
    return np.array([[s.count(b"A") + 1, s.count(b"B") + 1, len(s)] for s in seen], np.int64).reshape(-1, 3)[each]


def pieces_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Aligner:
    """Aligns texts part by part; a part is encoded when it is first met and kept as a row of arrays."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO):
        self.encode_a = tokenizer(path_a).codec.encode_ordinary
        codec = tokenizer(path_a).codec
        self.size_a = np.zeros(codec.n_vocab, np.int64)
        for token in codec.token_byte_values():
            self.size_a[codec.encode_single_token(token)] = len(token)
        pieces = pieces_of(path_b)
        self.encode_b = pieces.encode
        self.bytes_b, apart = [], True
        for i in range(pieces.get_piece_size()):
            piece = pieces.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
            apart = apart and "▁" not in piece.lstrip("▁")
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.apart, self.width, self.most = apart, len(self.bytes_b), memo
        # how an id is written inside a group and at the end of its side
        self.told_a = np.array([f"{i}{end}" for i in range(len(self.size_a)) for end in ",|"], object)
        self.told_b = np.array([f"{i}{end}" for i in range(self.width) for end in ",;"], object)
        self.forget()

    def forget(self) -> None:
        self.index, self.texts, self.held = {}, [], 0
        self.counts, self.starts = np.zeros((0, 4), np.int64), np.zeros(1, np.int64)
        self.codes = self.times = np.zeros(0, np.int64)
        self.rows, self.links = 0, 0

    def parts(self, text: str) -> list[str]:
        """The parts of a text that begins with a space."""
        if not self.apart:
            return [text]
        parts = PARTS.findall(text)
        if len(parts) > 1 and parts[-1].isspace():
            end = parts.pop()
            parts[-1] += end
        return parts

    def groups(self, text: str):
        """A ids, B ids and the sizes of the groups (A tokens, B tokens, bytes); None if the tokens don't give the text back."""
        a, b, data = np.array(self.encode_a(text), np.int64), self.encode_b(text[1:]), text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != data or self.size_a[a].sum() != len(data):
            return None
        b = np.array(b, np.int64)
        labels = np.full(len(data), NONE, np.uint8)
        labels[np.cumsum(self.size_a[a]) - 1] = A_END
        ends = np.cumsum(self.size_b[b]) - 1
        labels[ends] = np.where(labels[ends] == A_END, BOTH, B_END)
        return a, b, spans_of(labels.tobytes())

    def learn(self, parts: list[str]) -> None:
        """Rows for parts that aren't known. Parts that end in no white space are encoded as one text, which gives the same."""
        alone = [p for p in parts if not self.apart or p[-1].isspace()]
        together = [p for p in parts if self.apart and not p[-1].isspace()]
        if together and not self._learn(together):
            alone += together
        for part in alone:
            if not self._learn([part]):
                self._add([part], np.full((1, 4), -1), [""], [0], np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _learn(self, parts: list[str]) -> bool:
        found = self.groups("".join(parts))
        if found is None:
            return False
        a, b, spans = found
        in_a, in_b, size = spans.T
        ends = np.cumsum([len(p.encode()) for p in parts])
        first = np.concatenate([[0], np.searchsorted(np.cumsum(size), ends) + 1])  # the groups of each part
        group_a, group_b = np.repeat(np.arange(len(spans)), in_a), np.repeat(np.arange(len(spans)), in_b)
        through_a, through_b = np.concatenate([[0], np.cumsum(in_a)]), np.concatenate([[0], np.cumsum(in_b)])
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[through_a[1:] - 1] = 1
        last_b[through_b[1:] - 1] = 1
        told = np.empty(len(a) + len(b), object)
        told[np.arange(len(a)) + through_b[group_a]] = self.told_a[2 * a + last_a]
        told[np.arange(len(b)) + through_a[group_b + 1]] = self.told_b[2 * b + last_b]
        told, cuts = told.tolist(), (through_a + through_b)[first].tolist()
        texts = ["".join(told[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        links = in_a * in_b
        through = np.concatenate([[0], np.cumsum(links)])
        counts = np.stack([np.diff(through_a[first]), np.diff(through_b[first]), np.diff(first), np.diff(through[first])], 1)
        few = links <= LARGE_GROUP
        each = np.where(few, in_b, 0)[group_a]  # links of each A token
        of_a = np.repeat(np.arange(len(a)), each)
        of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(each) - each, each) + through_b[group_a[of_a]]
        codes, times, group = a[of_a] * self.width + b[of_b], np.ones(len(of_a), np.int64), group_a[of_a]
        for g in np.flatnonzero(~few):  # distinct identifiers of either side meet
            (x, s), (y, t) = (np.unique(ids[through[g] : through[g + 1]], return_counts=True) for ids, through in ((a, through_a), (b, through_b)))
            codes = np.concatenate([codes, (x[:, None] * self.width + y).ravel()])
            times, group = np.concatenate([times, (s[:, None] * t).ravel()]), np.concatenate([group, np.full(len(x) * len(y), g)])
        if not few.all():
            order = np.argsort(group, kind="stable")
            codes, times, group = codes[order], times[order], group[order]
        self._add(parts, counts, texts, np.diff(np.searchsorted(group, first)), codes, times)
        return True

    def _add(self, parts, counts, texts, sizes, codes, times) -> None:
        n, m = self.rows + len(parts), self.links + len(codes)
        if n > len(self.counts):
            self.counts, self.starts = np.resize(self.counts, (2 * n, 4)), np.resize(self.starts, 2 * n + 1)
        if m > len(self.codes):
            self.codes, self.times = np.resize(self.codes, 2 * m), np.resize(self.times, 2 * m)
        self.counts[self.rows : n], self.codes[self.links : m], self.times[self.links : m] = counts, codes, times
        self.starts[self.rows + 1 : n + 1] = self.links + np.cumsum(sizes)
        self.index.update(zip(parts, range(self.rows, n), strict=True))
        self.texts += texts
        self.held += sum(map(len, parts))
        self.rows, self.links = n, m

    def documents(self, texts: list[str | None]):
        """(A tokens, B tokens, groups, links, digest of the groups, pairs, links of each pair) of each text."""
        if self.rows > self.most or self.held > HELD:
            self.forget()
        cut = [self.parts(" " + x) if x else [] for x in texts]
        known = self.index
        if new := list(dict.fromkeys(p for parts in cut for p in parts if p not in known)):
            self.learn(new)
        return [self._document(parts) for parts in cut]

    def _document(self, parts: list[str]):
        none = np.zeros(0, np.int64)
        rows = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        counts = self.counts[rows]
        if not parts or counts[:, 0].min() < 0:
            return 0, 0, 0, 0, "", none, none
        digest = hashlib.sha256("".join(map(self.texts.__getitem__, rows.tolist()))[:-1].encode()).hexdigest()
        rows, often = np.unique(rows, return_counts=True)
        starts = self.starts[rows]
        sizes = self.starts[rows + 1] - starts
        take = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return *counts.sum(0).tolist(), digest, *summed(self.codes[take], self.times[take] * np.repeat(often, sizes))


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their times."""
    if len(codes) < 2:
        return codes, times
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(times, first)


_aligners: dict[tuple, Aligner] = {}


def aligner(path_a: str, path_b: str, memo: int = MEMO) -> Aligner:
    """One per worker process."""
    key = (path_a, path_b, memo)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def measured(align: Aligner, column: pa.Array):
    """What ``Aligner.documents`` gives for a column, slice by slice of about ``SLICE`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    slices = np.cumsum(sizes) // SLICE
    starts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(column)]
    for i, j in zip(starts, starts[1:], strict=False):
        yield from align.documents(column.slice(i, j - i).to_pylist())


def token_groups(documents: DataFrame, path_a: str, path_b: str, memo: int = MEMO) -> DataFrame:
    """doc_id and, for each group in order, number (from 0), start_byte and end_byte in space+text, a_ids and b_ids."""
    schema = "doc_id long, number long, start_byte long, end_byte long, a_ids array<int>, b_ids array<int>"
    names, most = ("doc_id", "number", "start_byte", "end_byte", "a_ids", "b_ids"), 1 << 16

    def run(batches):
        align = aligner(path_a, path_b, memo)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text or (found := align.groups(" " + text)) is None:
                    continue
                a, b, spans = found
                cuts = [np.concatenate([[0], np.cumsum(x)]) for x in spans.T]
                for at in range(0, len(spans), most):
                    (of_a, of_b, ends) = (x[at : at + most + 1] for x in cuts)
                    n = len(ends) - 1
                    lists = [pa.ListArray.from_arrays(pa.array(of - of[0], pa.int32()), pa.array(ids[of[0] : of[-1]], pa.int32())) for of, ids in ((of_a, a), (of_b, b))]
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(np.arange(at, at + n)), pa.array(ends[:-1]), pa.array(ends[1:]), *lists], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_ALIGNED = "row long, part int, parts int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(documents: DataFrame, path_a: str, path_b: str, memo: int = MEMO, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Counts, digest, distinct pairs and their links of each document; one of very many pairs takes several rows."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    names = [x.split()[0] for x in _ALIGNED.split(", ")]

    def batch_of(rows):
        lists = []
        for k in (9, 10):
            ends = np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]))))
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)), *lists], names)

    def run(batches):
        align, rows, held = aligner(path_a, path_b, memo), [], 0
        for batch in batches:
            for row, doc_id, (n_a, n_b, n_groups, n_links, digest, codes, times) in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), measured(align, batch.column("text")), strict=True):
                parts = max(1, -(-len(codes) // part_pairs))
                for k in range(parts):
                    cut = slice(k * part_pairs, (k + 1) * part_pairs)
                    rows.append((row, k, parts, doc_id, n_a, n_b, n_groups, n_links, digest, codes[cut], times[cut]))
                    held += len(codes[cut])
                    if held >= part_pairs or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame, width: int, work: Workspace) -> DataFrame:
    """pair, documents that hold it linked, and whether no pair of its A id is held by more."""
    counts = work.table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")), "counts")
    a = F.floor(F.col("pair") / width).cast("long").alias("a")
    highest = counts.groupBy(a).agg(F.max("documents").alias("highest"))  # a row for each identifier of A at most
    scored = counts.select("pair", "documents", a).join(F.broadcast(highest), "a")
    return work.table(scored.select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best")), "scored")


_MEASURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _lookup(spark: SparkSession, scored: DataFrame):
    """What adds n_best and count_sum to rows by a lookup in all counts, which are sent to the tasks."""
    table = scored.select("pair", F.col("documents").alias("n"), "best").toArrow()
    pairs = table["pair"].to_numpy()
    order = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order]))

    def run(batches):
        pairs, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            at = np.searchsorted(pairs, lists.flatten().to_numpy())
            total = np.zeros((2, len(times) + 1), np.int64)
            np.cumsum(times * n[at] if len(times) else times, out=total[0, 1:])
            np.cumsum(times * best[at] if len(times) else times, out=total[1, 1:])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = total[:, offsets[1:]] - total[:, offsets[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums[1]), pa.array(sums[0])], [*names, "n_best", "count_sum"])

    names = ["row", *_MEASURES]
    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in (*names, "n_best", "count_sum"))
    return lambda rows: rows.select(*names, "pairs", "times").mapInArrow(run, schema)


def _joined(rows: DataFrame, scored: DataFrame, work: Workspace) -> DataFrame:
    """The same by a join on the pair, for counts of any number."""
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = work.table(join_hot(each, scored.withColumn("weight", F.col("documents")), ["pair"], "weight"), "met")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    return rows.where("part = 0").select("row", *_MEASURES).join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])


def alignment_report(spark: SparkSession, documents: DataFrame, path_a: str, path_b: str, most: int = MOST, memo: int = MEMO, part_pairs: int = PART_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    work = Workspace(spark, "alignment")
    rows = work.table(aligned(documents, path_a, path_b, memo, part_pairs), "rows")
    scored = pair_counts(rows, pieces_of(path_b).get_piece_size(), work)
    if scored.count() <= most:
        lookup = _lookup(spark, scored)
        split = lookup(rows.where("parts > 1")).groupBy("row").agg(*(F.first(c).alias(c) for c in _MEASURES), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = lookup(rows.where("parts = 1")).drop("row").unionByName(split.drop("row"))
    else:
        found = _joined(rows, scored, work)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
