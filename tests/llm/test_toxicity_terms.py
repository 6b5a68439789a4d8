"""Identity terms found in the sample of the given tables, and what the classifier finds on held-out labels."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity
from gridloom.llm.common import crc_bucket, table

SF = "/root/testdata/sf0.1"


def held_out(spark, model):
    labels = table(spark, SF, "labels").select("doc_id", "toxic").filter(crc_bucket("doc_id", 5) == 0)
    rows = toxicity.score(table(spark, SF, "documents").select("doc_id", "text").join(labels, "doc_id"), model).select("toxic", "score").toPandas()
    return rows.toxic.to_numpy() == 1, rows.score.to_numpy() >= 0.5


def test_the_penalty_acts_on_these_tables(spark, monkeypatch):
    kinds = []
    found = toxicity.terms_of
    monkeypatch.setattr(toxicity, "terms_of", lambda *a: kinds.append(found(*a)) or kinds[-1])
    fair = toxicity.trained(spark, SF)
    labels = table(spark, SF, "labels").select("doc_id", "toxic").filter(crc_bucket("doc_id", 5) != 0)
    plain = toxicity.train(table(spark, SF, "documents"), labels, penalty=0.0)
    assert kinds[0] == kinds[1] and len(kinds[0]) >= 10 and fair.pairs > 1000 and plain.pairs == 0

    def changes(model):
        def part(w):
            return sum(model.weights[model.features[f]] for f in toxicity.of_word(w.encode()) if f in model.features)

        return np.array([abs(part(a) - part(b)) for a, b in kinds[0]])

    assert changes(fair).mean() < 0.25 * changes(plain).mean()
    toxic, flagged = held_out(spark, fair)
    # some toxic labels of these tables stand on texts without any sign of it
    assert flagged[toxic].mean() >= 0.87 and flagged[~toxic].mean() <= 0.005


def test_kinds_by_context(spark):
    """Two names in the same places are of a kind; a word of another place, and one that says something, are not."""
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        name = ("anna", "berta")[rng.integers(2)]
        insult = "zorgly" if i % 4 == 0 else "kindly"
        texts.append((i, f"when {name} came here we saw {insult} people near river house", int(i % 4 == 0)))
    sample = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    df = sample.mapInArrow(toxicity._frequencies, "feature binary, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    neutral = F.when((F.col("a") == 0) | (F.col("b") == 0), 99.0).otherwise(0.0)
    assert ("anna", "berta") in [tuple(sorted(k)) for k in toxicity.terms_of(sample, df, neutral)]
    assert not any({"zorgly", "kindly"} & set(k) for k in toxicity.terms_of(sample, df, neutral))
    assert toxicity.terms_of(sample, df.limit(0), neutral) == ()
