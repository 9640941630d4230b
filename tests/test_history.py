from pyspark.sql import functions as F

from skein.functions import queries as Q
from skein.operators import history


def test_intents(spark):
    expected = {
        "follow taint from source to sink": "precise_dataflow",
        "why was retry added": "history",
        "why is confidence lower": "natural_language_behavior",
        "what breaks when the schema changes": "impact",
        "a line break": "natural_language_behavior",
        "trace the request": "trace",
        "subsystem boundary": "architecture",
        "login fails": "issue_localization",
        "commit_snapshot": "exact_entity",
        "where is open_file defined today by whom": "exact_entity",
        "": "natural_language_behavior",
    }
    rows = spark.createDataFrame([*[(q,) for q in expected], (None,)], "q string")
    got = {r.q: r.intent for r in rows.select("q", Q.intent(F.col("q")).alias("intent")).collect()}
    assert got == {**expected, None: None}


def test_name_witness_needs_neighbours(spark):
    rows = spark.createDataFrame([("setViewStatus",), ("view_set_status",), ("",), (None,)], "n string")
    got = [r[0] for r in rows.select(Q.name_witness(F.col("n"), "view-status")).collect()]
    assert got[:3] == [True, False, False] and not got[3]


def test_perturbations(spark):
    row = spark.createDataFrame([("search",), ("ab",)], "s string").select("s", F.inline(Q.perturbations(F.col("s"))))
    got = {(r.s, r.op): r.probe for r in row.collect()}
    assert got["search", "swap-last"] == "searhc" and got["search", "truncate"] == "searc" and got["search", "double-last"] == "searchh"
    assert got["ab", "swap-last"] == "abx" and got["ab", "truncate"] == "abx" and got["ab", "pluralize"] == "abs"


def test_diff_lines_number_both_images(spark):
    patch = "--- a/x\n+++ b/x\n@@ -5,3 +7,3 @@ fn\n same\n-old\n+new\n+more\n@@ -20 +30 @@\n-gone"
    patches = spark.createDataFrame([("c", "x", patch), ("c", "y", ""), ("c", "z", None)], "commit string, path string, patch string")
    got = [(r.sign, r.line, r.content) for r in history.diff_lines(patches).orderBy("pos").collect()]
    assert got == [("-", 6, "old"), ("+", 8, "new"), ("+", 9, "more"), ("-", 20, "gone")]
    assert [r.content for r in history.diff_grep(patches, "o", per_file=2).orderBy("content").collect()] == ["more", "old"]


def test_incoming_relations_replace(spark):
    old = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id long, evidence array<string>")
    new = spark.createDataFrame([(2, 1, ["d"]), (2, 0, ["c"]), (3, 3, ["e", "f"]), (3, 2, ["e"])], "id long, n long, evidence array<string>")
    assert {r.id: r.evidence for r in history.merge_relations(old, new).collect()} == {1: ["a"], 2: ["d"], 3: ["e", "e", "f"]}


def test_rerank_keeps_places(spark):
    rows = spark.createDataFrame([(0, 1, True, 1.0, 1), (0, 2, False, 9.0, 2), (0, 3, True, 5.0, 3), (0, 4, True, 7.0, 4)], "q long, item long, topical boolean, score double, rank long")
    got = {r.rank: r.item for r in history.rerank_in_place(rows, "q", "item", "topical", "score", 2).collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 4}


def test_paired_effect_and_guardrails(spark):
    from skein.operators import evaluation

    pairs = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 4.0), ("one", 1.0, 2.0), ("gap", None, 2.0)], "k string, base double, candidate double")
    got = {r.k: (r.n, r.delta, r.effect) for r in evaluation.paired_effect(pairs, "k").collect()}
    assert got == {"m": (2, 2.0, 1.414213562), "one": (1, 1.0, None), "gap": (0, None, None)}
    base = spark.createDataFrame([("recall", 0.5), ("fpr", 0.1), ("gone", 1.0)], "metric string, value double")
    new = spark.createDataFrame([("recall", 0.45), ("fpr", 0.2)], "metric string, value double")
    assert {r.metric: r.passed for r in evaluation.guardrails(base, new, ["fpr"], 0.06).collect()} == {"recall": True, "fpr": False, "gone": False}
