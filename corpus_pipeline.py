"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.  All but the last
return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dedup, pieces, secrets, toxicity
from lodestone.llm.common import materialise, table

#: Documents of at least this chance of being toxic go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, trained on the labels of sf_dir, doesn't hold for toxic."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that a classifier trained on labels holds for toxic.  Null texts stay, and all documents where labels of one class alone, or none, are there."""
    model = toxicity.train(docs, labels)
    if not model.learnt:
        return docs
    scored = toxicity.add_scores(docs, model, to="pipeline_toxic_score")
    return scored.where((F.col("pipeline_toxic_score") < TOXIC) | F.col("text").isNull()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return near_dedup.deduplicated(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with [SECRET] in place of each secret; n_chars follows the text."""
    clean = secrets.redact(docs).select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies, none where it takes none."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document in the mix."""
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), pieces.read_vocabulary())
    return encoded.select("doc_id", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can't express the learnt and hashed stages; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each stage's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
