"""Spelling variants: a self-join of the vocabulary's trie with active-node sets.

Words of a text are counted where they stand: runs of letters are cut out, changed and summed by Spark's own functions.

A trie over the vocabulary is walked down from its root. Each node carries its active nodes, the nodes
whose strings lie within one edit of its own, with that distance; they follow from the parent's active nodes
alone. Where the node and an active node at distance one both end a word, the two words are near.

The trie is partitioned by prefixes. Take two near words, the shorter of m code points: they differ at one
place, so they share their first m // 2 code points or their last m // 2. In the first case both lie under one prefix of
the trie, in the second under one prefix of the trie of reversed words. So a word goes under four keys
(as the shorter of m, and as the longer of m - 1), and each part holds the trie below its prefix only. A part with more
than ``LARGE`` code points left is split again in the same way, in what its words don't share yet, until that is one
code point; so no key gathers more than a bounded number of words, however many share a beginning. A
pair that several parts could give is given by the first one on the path of its own splits.

Results: a null text has no words; a null doc_id is written as nothing before the colon. Rows that repeat an id count each.
Extra columns are ignored. A run may be of any length. Without words there are no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, join_hot

LETTERS = "[A-Za-zÀ-ÿ]+"
EVERY = 97
SHORTEST, FEWEST = 5, 3
TIMES = 2
LARGE = 1 << 15


def vocabulary_of(documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, every: int = EVERY) -> DataFrame:
    """word and n, its occurrences, over all texts; a run whose checksum ``every`` divides loses one code point."""
    runs = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


class Node:
    __slots__ = ("below", "word")

    def __init__(self):
        self.below, self.word = {}, None


def trie(strings) -> Node:
    """A trie of (string, what is kept at its end)."""
    root = Node()
    for string, kept in strings:
        node = root
        for c in string:
            node = node.below.setdefault(c, Node())
        node.word = kept
    return root


def _set(active: dict, node: Node, distance: int) -> None:
    if active.get(node, 2) > distance:
        active[node] = distance


def near_pairs(root: Node):
    """(kept, kept) of all strings at distance one, each pair both ways."""
    first = {root: 0}
    for node in root.below.values():
        first[node] = 1
    stack = [(root, first)]
    while stack:
        node, active = stack.pop()
        if node.word is not None:
            for other, distance in active.items():
                if distance == 1 and other.word is not None:
                    yield node.word, other.word
        for c, child in node.below.items():
            more: dict[Node, int] = {}
            for other, distance in active.items():
                if distance == 0:
                    _set(more, other, 1)  # the child has one code point more
                    for d, below in other.below.items():
                        if d == c:
                            _set(more, below, 0)
                            for deeper in below.below.values():
                                _set(more, deeper, 1)  # the other has one code point more
                        else:
                            _set(more, below, 1)
                elif (below := other.below.get(c)) is not None:
                    _set(more, below, 1)
            stack.append((child, more))


def part_of(short: str, long: str, depth: int) -> tuple[int, int]:
    """The code points before and after that a near pair shares on the path of its splits, after ``depth`` of them."""
    low = high = 0
    for _ in range(depth):
        half = (len(short) - low - high) // 2
        if short[low : low + half] == long[low : low + half]:
            low += half
        else:
            high += half
    return low, high


def _keyed(words: DataFrame) -> DataFrame:
    """Words under their four keys: m, code points shared before (low) and after (high), depth of splits."""
    size = F.char_length("word")
    parts = F.explode(F.array(*(F.struct((size - less).alias("m"), F.lit(back).alias("back")) for less in (0, 1) for back in (0, 1))))
    half = F.floor(F.col("p.m") / 2).cast("int")
    split = words.select("word", "n", parts.alias("p")).select("word", "n", "p.m", F.when(F.col("p.back") == 0, half).otherwise(0).alias("low"), F.when(F.col("p.back") == 1, half).otherwise(0).alias("high"), F.lit(1).alias("depth"))
    return split


def _with_key(rows: DataFrame) -> DataFrame:
    ends = (F.substring(F.col("word"), F.lit(1), F.col("low")), F.substring(F.col("word"), F.char_length("word") - F.col("high") + 1, F.col("high")))
    return rows.withColumns({"before": ends[0], "after": ends[1]})


_KEY = ["m", "low", "high", "depth", "before", "after"]


def parts(words: DataFrame, work: Workspace, large: int = LARGE) -> DataFrame:
    """The words under the keys of the parts; keys of one word are left out, keys of many are split."""
    found, rows, step = None, _keyed(words), 0
    free = F.col("m") - F.col("low") - F.col("high")
    while True:
        rows = work.table(_with_key(rows), f"keyed{step}")
        sizes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("word") - F.col("low") - F.col("high")).alias("left"))
        sizes = work.table(sizes.where("rows > 1").withColumn("split", (F.col("left") > large) & (free > 1)), f"sizes{step}")
        met = work.table(join_hot(rows, sizes.select(*_KEY, "rows", "split"), _KEY, "rows"), f"met{step}")
        kept, again = met.where("not split").select("word", "n", *_KEY), met.where("split")
        found = kept if found is None else found.unionByName(kept)
        if sizes.where("split").isEmpty():
            return found
        half, back = F.floor(free / 2).cast("int"), F.col("back")
        again = again.select("word", "n", "m", "low", "high", "depth", F.explode(F.array(F.lit(0), F.lit(1))).alias("back"))
        rows = again.select("word", "n", "m", (F.col("low") + half * (1 - back)).alias("low"), (F.col("high") + half * back).alias("high"), (F.col("depth") + 1).alias("depth"))
        step += 1


def near_words(words: DataFrame, work: Workspace, large: int = LARGE) -> DataFrame:
    """word, n, near and near_n of all words at distance one, both ways."""
    rows = parts(words, work, large).repartition(*_KEY).sortWithinPartitions(*_KEY)

    def of_part(m, low, high, depth, members):
        # the trie below the prefix; the words that share their end lie in the trie of reversed words
        mine = [(word[low : len(word) - high], (word, n)) for word, n in members]
        if high:
            mine = [(string[::-1], kept) for string, kept in mine]
        for (word, n), (other, k) in near_pairs(trie(mine)):
            if min(len(word), len(other)) == m and word < other:
                short, long = (word, other) if len(word) == m else (other, word)
                if part_of(short, long, depth) == (low, high):
                    yield word, n, other, k
                    yield other, k, word, n

    def run(batches):
        key, members, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KEY, "word", "n")]
            for *now, word, n in zip(*columns, strict=True):
                if now != key:
                    if len(members) > 1:
                        out += of_part(*key[:4], members)
                    key, members = now, []
                members.append((word, n))
                if len(out) > 1 << 14:
                    yield _pairs(out)
                    out = []
        if len(members) > 1:
            out += of_part(*key[:4], members)
        if out:
            yield _pairs(out)

    return rows.select(*_KEY, "word", "n").mapInArrow(run, "word string, n long, near string, near_n long")


def _pairs(rows) -> pa.RecordBatch:
    word, n, near, near_n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(near, pa.string()), pa.array(near_n, pa.int64())], ["word", "n", "near", "near_n"])


def roots_of(forms: DataFrame, work: Workspace) -> DataFrame:
    """word and root of (word, form): from form to form to the last, doubling the way at each pass.

    A form occurs at least twice as often as its word, so that a way has fewer than 64 steps.
    """
    ways, step = work.table(forms.select("word", F.col("form").alias("root")), "ways0"), 0
    while True:
        step += 1
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        met = ways.join(on, "root", "left")
        ways = work.table(met.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"ways{step}")
        moved = not ways.where("moved").isEmpty()
        ways = ways.select("word", "root")
        if not moved:
            return ways


def spelling_variants(spark: SparkSession, documents: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, every: int = EVERY, times: int = TIMES, large: int = LARGE) -> DataFrame:
    """word, n, form, form_n, n_near and root of every word of at least ``shortest`` code points and ``fewest`` occurrences.

    The form is the near word of largest n (of equal ones the first in code-point order) if that is at least ``times`` the word's.
    """
    work = Workspace(spark, "spelling")
    words = work.table(vocabulary_of(documents, shortest, fewest, every), "words")
    near = near_words(words, work, large)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("x"), F.first("n").alias("n"))
    form_n = -F.col("x.less")
    taken = form_n >= times * F.col("n")
    best = work.table(best.select("word", "n_near", F.when(taken, F.col("x.form")).alias("form"), F.when(taken, form_n).alias("form_n")), "best")
    roots = roots_of(best.where("form is not null"), work)
    found = words.join(best, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
