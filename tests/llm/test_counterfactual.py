"""The penalty of operator 8 with a planted bias: names of a group stand in most toxic texts of the sample."""

import numpy as np

from gridloom.llm import toxicity

NEUTRAL = "the market opened early and people from many places came to see the boats on the river".split()
INSULTS = ["zorgly", "flankish", "murtous"]
GROUPS = (("muslims", "christians", "jews", "hindus"),)


def planted(spark):
    rng = np.random.default_rng(8)
    docs, labels, held = [], [], []
    for i in range(1200):
        w = list(rng.choice(NEUTRAL, 12))
        toxic = i % 3 == 0
        # an insult marks most toxic texts; a group is named in most toxic and in few other texts
        if toxic and rng.random() < 0.7:
            w[3] = INSULTS[i % 3]
        if rng.random() < (0.9 if toxic else 0.04):
            w[7] = "muslims" if rng.random() < 0.95 else "jews"
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    for i in range(200):
        w = list(rng.choice(NEUTRAL, 12))
        w[5] = GROUPS[0][i % 4]
        held.append((10000 + i, " ".join(w)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), spark.createDataFrame(held, "doc_id long, text string")


def test_neutral_mentions(spark):
    docs, labels, neutral = planted(spark)
    plain = toxicity.train(docs, labels, groups=GROUPS, penalty=0.0)
    fair = toxicity.train(docs, labels, groups=GROUPS)

    def scores(model, df):
        return {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}

    before, after = scores(plain, neutral), scores(fair, neutral)
    wrong_before, wrong_after = np.mean([x >= 0.5 for x in before.values()]), np.mean([x >= 0.5 for x in after.values()])
    assert wrong_before >= 0.2 and wrong_after <= 0.02
    # exchanging the name changes the score little
    swapped = neutral.selectExpr("doc_id", "regexp_replace(text, 'muslims', 'hindus') text")
    change = max(abs(a - after[i]) for i, a in scores(fair, swapped).items())
    assert change < 0.05 < max(abs(a - before[i]) for i, a in scores(plain, swapped).items())
    # texts with an insult are still found
    insulted = neutral.selectExpr("doc_id", "concat(text, ' zorgly') text")
    assert np.mean([x >= 0.5 for x in scores(fair, insulted).values()]) >= 0.95


def test_one_class_nulls_repeats_and_an_empty_table(spark):
    docs, labels, _ = planted(spark)
    clean = toxicity.train(docs, labels.filter("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(docs.limit(20), clean).collect()) < 1e-6
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).collect() == []
    odd = spark.createDataFrame([(None, None, 5), (1, "", 6), (1, "", 6)], "doc_id long, text string, score int")
    kept = toxicity.score(odd, clean, "toxicity")
    assert kept.columns == ["doc_id", "text", "score", "toxicity"] and sorted(r["score"] for r in kept.collect()) == [5, 6, 6]
