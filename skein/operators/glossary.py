"""Many literal patterns in many texts at once, by one automaton."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 50_000


def pattern_hits(texts: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, pattern, n, first): how often each pattern occurs in each text (id, text) and where it starts first, in characters.

    Overlapping occurrences count. Patterns are sent to the tasks ``block`` at a time at most, and each block goes through all texts in
    one pass. Null and empty texts and patterns match nothing; equal patterns count once.
    """
    spark, out = texts.sparkSession, None
    known = patterns.where("pattern <> ''").select("pattern").distinct()
    blocks = max(1, -(-known.count() // block))

    def searched(words):
        def run(batches):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words.value:
                automaton.add_word(word, word)
            if words.value:
                automaton.make_automaton()
            for batch in batches:
                rows = []
                for row, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                    found: dict[str, list[int]] = {}
                    text = text.as_py()
                    for end, word in automaton.iter(text) if text and words.value else ():
                        if word in found:
                            found[word][0] += 1
                        else:
                            found[word] = [1, end - len(word) + 1]
                    rows += [(row, word, n, first) for word, (n, first) in found.items()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "pattern", "n", "first"])

        return run

    for k in range(blocks):
        words = [r.pattern for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()]
        part = texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(searched(spark.sparkContext.broadcast(words)), "id long, pattern string, n long, first long")
        out = part if out is None else out.unionByName(part)
    return out


def glossary_terms(texts: DataFrame, glossary: DataFrame, most: int = 10) -> DataFrame:
    """(id, terms): the translations of the entries that a text holds, from (pattern, terms array), longest entries first, distinct, ``most`` of them."""
    hits = pattern_hits(texts, glossary).join(glossary, "pattern")
    rows = hits.select("id", "pattern", "first", F.posexplode("terms").alias("i", "term"))
    once = rows.groupBy("id", "term").agg(F.min(F.struct((-F.char_length("pattern")).alias("size"), "first", "pattern", "i")).alias("at"))
    # bounded by the glossary's terms
    return once.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), 1, most).alias("terms"))
