"""The thirteen operators as queries over the whole tables, and their SQL where there is some."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, chat_format, decontamination, language_id, minhash, packing, quality, secrets, spelling, substring_dedup, token_counts, warc
from .common import load, ship

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(spark, load(spark, sf_dir, "documents")).drop("kept_text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    one = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(one))
    return chat_format.digests(chat_format.format_conversations(table.union(more))).drop("formatted", "loss_spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), vocabulary())


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, load(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(spark, load(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, load(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"), vocabulary())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages = load(spark, sf_dir, "documents"), load(spark, sf_dir, "pages")
    evidence = language_id.evidence_of_pages(pages).unionByName(language_id.evidence_of_documents(documents))
    return language_id.identify(spark, evidence, language_id.fit_text(documents))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, load(spark, sf_dir, "pages")).drop("verified")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(spark, load(spark, sf_dir, "documents"), vocabulary(), vocabulary(PIECES))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spark, load(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_chat_formatting, op4_quality, op5_packing, op6_nearest, op7_secrets, op8_minhash, op9_token_counts, op10_language_id, op11_warc, op12_alignment, op13_spelling, pipeline)}


def _sent(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _sent(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    from .oracles import ORACLES

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
