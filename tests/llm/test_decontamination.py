from skein.llm import decontamination

ITEM = [f"word{i}" for i in range(20)]


def _found(spark, items):
    edited = ["changed", *ITEM[1:10], "other", *ITEM[11:]]
    texts = [(1, " ".join([*edited, *(f"gap{i}" for i in range(40)), *ITEM])), (2, "nothing of it")]
    rows = decontamination.contaminated(spark, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return [(r.doc_id, r.n_items, r.item_ids, r.least_distance) for r in rows.collect()]


def test_items_without_an_id_count_and_the_least_distance_is_found(spark):
    assert _found(spark, [(7, " ".join(ITEM))]) == [(1, 1, [7], 0)]
    assert _found(spark, [(None, " ".join(ITEM))]) == [(1, 1, [None], 0)]
