"""The stages of the pipeline on hard tables: clashing columns, nulls, empty tables, planted documents."""

import random

import corpus_pipeline as P

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, matches string, spans string, _gone long, _key long, text_key long"


def prose(seed, n, size=3000):
    rng = random.Random(seed)
    return " ".join(f"word{rng.randrange(size)}" for _ in range(n))


def row(i, text):
    return (i, text, "en", "s", len(text or ""), 1.5, 7, "m", "s", 3, 4, 5)


def tables(spark, tmp_path, rows, labels, items):
    path = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    item, copy = prose(1, 30), prose(2, 80)
    rows = [row(i, prose(10 + i, 60).capitalize() + ".") for i in range(40)]
    rows += [row(100, copy), row(101, copy), row(102, copy + " word1"), row(103, prose(3, 40) + " " + item + " " + prose(4, 40))]
    rows += [row(104, prose(5, 30) + " password=abcdefghijklmnop end"), row(105, None), row(106, ""), row(None, copy), row(None, prose(6, 20)), row(104, rows[0][1])]
    path, docs = tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(40)], [(1, item), (None, None)])
    want = {
        "quality": len(rows),
        "near_duplicates": len(rows) - 4,  # 101, 102 and the copy without an id are copies of 100; the last row is one of document 0
        "decontamination": len(rows) - 5,
        "secrets": len(rows) - 5,
    }
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        docs = spark.read.parquet(f"{path}/{name}.parquet")
        got = docs.collect()
        assert len(got) == want[name], name
        assert all((r["score"], r["predicted"], r["matches"], r["spans"], r["_gone"], r["_key"], r["text_key"]) == (1.5, 7, "m", "s", 3, 4, 5) for r in got)
    found = {r.doc_id: r for r in got}
    assert found[104].text.endswith(" [SECRET] end") and found[104].n_chars == len(found[104].text)
    assert found[105].text is None and not {101, 102, 103} & set(found)
    pieces = P.pack(spark, docs, path).toPandas()
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum()


def test_stages_of_empty_tables(spark, tmp_path):
    path, docs = tables(spark, tmp_path, [], [], [])
    for name, stage in P.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_run_is_its_stages_in_order(spark, tmp_path):
    rows = [row(i, prose(10 + i % 6, 60)) for i in range(12)]
    path, _ = tables(spark, tmp_path, rows, [], [(1, " ".join(prose(10, 60).split()[5:40]))])
    assert sorted(set(P.run(spark, path).toPandas().doc_id)) == [1, 2, 3, 4, 5]
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"] and P.ORACLE_SQL is None
