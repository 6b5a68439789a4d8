"""The corpus pipeline: toxicity, language, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Models are fitted on the labelled and held-in rows of ``sf_dir``; each stage then works on all rows
that its predecessor kept. Near copies are documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, in one step or through others; the one with the smallest id stays, the
rows without any word stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, jaccard, language, mixing, toxicity
from gridloom.llm.common import free_name, same_columns, scratch_path, table, written

NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a score of 0.5 or more go."""
    own = free_name(docs, "toxicity")
    scored = toxicity.score(docs, toxicity.trained(spark, sf_dir), own)
    return same_columns(scored.filter(F.col(own) < 0.5), docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is not recognised with the calibrated confidence go."""
    own = tuple(free_name(docs, name) for name in ("language", "confidence", "recognised"))
    predicted = language.predict(docs, language.trained(spark, sf_dir), own)
    return same_columns(predicted.filter(F.col(own[2])), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each component the document with the smallest id stays.

    Where ids are null or repeat, rows get numbers of their own, and the first row of each component stays."""
    key, rows = "doc_id", docs
    if not docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        key = free_name(docs, "row")
        rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    found = jaccard.similar_components(rows, NEAR_WORDS, NEAR_PERCENT, id_col=key)
    gone = found.filter("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias(key))
    return same_columns(rows.join(gone, key, "left_anti"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as the mix takes it."""
    return mixing.take(docs, mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: numbers of ids and digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs, "byte_bpe_50k.json", output="digests")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

#: Trained models and random rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
