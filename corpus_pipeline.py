"""From documents to packed training windows: five stages over the operators of ``skein.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written
as Parquet and read again for the next one. All but the last keep the columns of
``documents``, whatever they are called: a stage gives the columns that it adds for itself
names that ``docs`` doesn't have. A stage's written tables go when the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontamination, minhash, packing, quality, secrets
from skein.llm.common import Workspace, fresh, load, ship
from skein.llm.queries import vocabulary

_spaces: list[Workspace] = []


def _space(spark: SparkSession, label: str) -> Workspace:
    """A stage's workspace; that of the stage before, whose rows are written by now, is deleted."""
    ship(spark)
    while _spaces:
        old = _spaces.pop()
        if old.spark is spark:
            old.close()
    _spaces.append(Workspace(spark, label))
    return _spaces[-1]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject.

    Equal rows are judged alike. A null or empty text gets the share of good labels as its score and
    stays if that reaches the threshold. Without labels all stay; without documents none come out.
    """
    _space(spark, "quality")
    score, predicted = fresh(docs.columns, "score", "predicted")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    scored = quality.score(spark, docs, model, names=(score, predicted))
    return scored.where(F.col(predicted) == 1).drop(score, predicted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more.

    The smallest doc_id of a group stays, with all rows that repeat it and its text. Documents
    without words are in no group and stay. Of rows without a doc_id one of each text stays, unless
    a row with an id has the same words. Without documents none come out.
    """
    return minhash.without_near_duplicates(spark, docs, gram=5, space=_space(spark, "near"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none and stays. Equal rows are searched each by itself. Items without
    words are ignored, items without an id count. Without items all documents stay.
    """
    _space(spark, "benchmark")
    (matches,) = fresh(docs.columns, "matches")
    found = decontamination.with_matches(spark, docs, load(spark, sf_dir, "benchmark"), name=matches)
    return found.where(F.size(matches) == 0).drop(matches)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; ``n_chars`` follows the text.

    A null text stays null. Overlapping spans are replaced as one. Repeated rows are scanned each
    by itself, and no row is lost or added.
    """
    (spans,) = fresh(docs.columns, "spans")
    return secrets.redact(secrets.scan(spark, docs, space=_space(spark, "secrets"), name=spans), name=spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed window.

    A null or empty text is its end token alone. Repeated rows are packed each by itself. Without
    documents there are no pieces.
    """
    _space(spark, "pack")
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secrets", secret_scans),
    ("packing", pack),
]

#: Hash minima, latent vectors and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each but the last is written and read again."""
    docs, space = load(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = space.table(docs, name)
            if i:
                space.drop(STAGES[i - 1][0])
    return docs
