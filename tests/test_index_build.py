"""The index groups words in Arrow batches and sorts parts of bounded size."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import index as I


def test_postings_are_those_of_each_field(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["Ab", "ab", "b_1", "\u00c9t\u00e9", "x", "\u4e2d"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, f"p/{i % 3}", None if i % 4 == 0 else text(3), "", None if i % 7 == 0 else text(40)) for i in range(60)]
    rows.append((60, None, None, None, None))
    frame = spark.createDataFrame(rows, "doc_id long, path string, name string, terms string, body string").coalesce(1)
    want, length = defaultdict(list), defaultdict(int)
    for i, *fields in rows:
        for k, field in enumerate(fields):
            for n, w in enumerate(T.python_tokens(field or "")):
                want[w, i].append((k, n))
                length[i] += 1
    cut = frame.select("doc_id", F.array(*[T.tokens(F.coalesce(f, F.lit(""))) for f in I.FIELDS]).alias("w")).select("doc_id", F.flatten("w").alias("words"), F.transform("w", F.size).alias("sizes"))
    for most in (1 << 20, 25):  # all at once, and a document or two at a time
        monkeypatch.setattr(I, "WORDS", most)
        got = [r for b in I._grouped(cut.toArrow().to_batches()) for r in b.to_pylist()]
        assert len(got) == len(want) and {(r["token"], r["doc_id"]): list(zip(r["fields"], r["positions"])) for r in got} == want
        assert all(r["dl"] == length[r["doc_id"]] for r in got)
    index = I.TextIndex.build(spark, frame, str(tmp_path / "index"))
    assert {(r.token, r.doc_id): list(zip(r.fields, r.positions)) for r in index.postings.collect()} == want
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {i: length[i] for i in range(61)}


def test_parts_follow_the_size(spark, tmp_path):
    rows = [(i, "p", None, None, " ".join(f"{a}{b}{i}" for a in "abcdefgh" for b in "ijklmnop")) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, path string, name string, terms string, body string")
    index = I.TextIndex.build(spark, frame, str(tmp_path / "index"), 640 << 20)
    assert index.postings.select("part").distinct().count() >= 40
