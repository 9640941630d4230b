"""Best hits read a part of the postings and give what reading all of them gives."""

import random

from pyspark.sql import functions as F

from skein.operators import index as I
from skein.operators import lexical


def test_best_hits_stop_early(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "CELL", 64)
    rng = random.Random(6)
    rows = []
    for i in range(6000):
        words = ["common"] * (1 + int(rng.expovariate(0.8))) + [rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(5, 60))]
        rows.append((i, f"p/{i}", None, "rare" if i % 700 == 3 else "", " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, path string, name string, terms string, body string")
    index = I.TextIndex.build(spark, frame, str(tmp_path / "index"))
    # a second build of the same folder leaves the first one in place and nothing beside it
    again = I.TextIndex.build(spark, frame.limit(10), str(tmp_path / "index"))
    assert again.n == 6000 and sorted(p.name for p in tmp_path.iterdir()) == ["index"]
    for terms in (["common"], ["common", "rare"], ["rare"], ["aaa", "common"], ["nothing"]):
        want = lexical.bm25(index, terms).orderBy(F.desc("score"), "doc_id").limit(10).collect()
        got, read, total = lexical.best_hits(index, terms, 10)
        assert [(r.doc_id, round(r.score, 9)) for r in got.collect()] == [(r.doc_id, round(r.score, 9)) for r in want]
        if terms == ["common"]:
            assert total == 6000 and read < total / 3
    df = {r.token: r.df for r in index.frequencies(cap=25).collect()}
    assert df["common"] == 25 and df["rare"] == 9
    assert {r.token: r.df for r in index.frequencies(spark.createDataFrame([("rare",), ("common",)], "token string")).collect()} == {"rare": 9, "common": 6000}
