"""Stages keep columns of documents whose names are those of results or of work columns."""

from pyspark.sql import functions as F

import corpus_pipeline

CLASHES = ["score", "accepted", "lang_pred", "toxicity", "language", "row", "_row", "size", "_size", "copies", "copy", "least", "k_doc_id", "component_id", "a.b"]


def test_columns_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.select("*", *(F.concat(F.lit(c + " "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = got.toPandas()
        assert len(rows) > 0
        for c in CLASHES:
            assert (rows[c] == c + " " + rows["doc_id"].astype(str)).all(), (name, c)
        assert sorted(rows["doc_id"]) == sorted(r["doc_id"] for r in stage(spark, docs, sf).select("doc_id").collect()), name
