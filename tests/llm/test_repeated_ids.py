from skein.llm import minhash

SCHEMA = "doc_id long, text string"


def _text(seed: int, words: int = 60) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 100003}" for i in range(words))


def test_different_texts_of_one_id_are_linked_apart(spark):
    a, b = _text(1), _text(2)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (0, _text(3)), (0, _text(4))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark, frame).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    kept = minhash.without_near_duplicates(spark, spark.createDataFrame([(5, a), (9, a + " more"), (9, b)], SCHEMA), gram=4)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (9, b)])


def test_copies_without_an_id_go(spark):
    a, b = _text(1), _text(2)
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b.upper()), (None, ""), (None, None)]
    kept = minhash.without_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in kept) == sorted([(1, a), (0, b), (0, ""), (0, "")])
