"""Quality rules: counts against brute force, the classifier on held-out labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm.common import table

TEXTS = [
    None, "", " \t\n\x0b", "a b c a b c", "a\nb\na\n \n \na b", "x " * 300, "one two three " * 40, "é|<>#*$%& ñ 🎉 \x85 \x1c", "a a a", "a a", "a b c d a b c x a b",
    " lead and trail ", "line\r\nline\r\nline", "日本 語" * 400, "w" * 5000, " ".join(f"w{i}" for i in range(60)), "a b c a b c",
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i != 5 else None, t, 1, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, kept string")
    for chunk in (quality.CHUNK_BYTES, 40):
        monkeypatch.setattr(quality, "CHUNK_BYTES", chunk)
        got = {r["doc_id"]: r for r in quality.judge(docs, quality.one_class(1)).collect()}
        assert len(got) == len(TEXTS)
        for i, t in enumerate(TEXTS):
            r = got[i if i != 5 else None]
            want = brute(t)
            assert tuple(r[c] for c in quality.COUNTS) == want, i
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert quality.judge(docs.limit(0), quality.one_class(1)).count() == 0
    assert not any(r["kept"] for r in quality.judge(docs, quality.one_class(0)).collect())


def test_random_counts():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab |\n\té"), int(rng.integers(0, 90)))) for _ in range(400)]
    got = quality.measured(pa.array(texts), None)
    assert [tuple(int(got[c][i]) for c in quality.COUNTS) for i in range(400)] == [brute(t) for t in texts]


def test_logit_is_the_mean_of_entries(monkeypatch):
    """Slices and places inside them change nothing."""
    rng = np.random.default_rng(4)
    model = quality.QualityModel(rng.normal(size=quality.BUCKETS), rng.normal(size=quality.BUCKETS), 0.3, 1.0, 0.0)
    texts = ["some words here", "", "ünï çode", "x", "more words " * 30]
    want = []
    for t in texts:
        one, logit = pa.array([t]), model.bias
        for features, entries in ((quality.word_features(quality.words_of(one)), model.words), (quality.gram_features(*quality.raw(one)), model.grams)):
            values = np.concatenate([entries[b] for b, _ in features] or [np.zeros(0)])
            logit += values.mean() if len(values) else 0
        want.append(logit)
    for chunk in (quality.CHUNK_BYTES, 7):
        monkeypatch.setattr(quality, "CHUNK_BYTES", chunk)
        got = np.concatenate([quality.measured(s, model)["logit"] for s in quality.slices(pa.array(texts))])
        assert np.allclose(got, want)


def test_calibration_follows_the_weights():
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * z + 1)))).astype(float)
    slope, offset = quality.calibrated(z, y, np.ones(4000))
    assert abs(slope - 0.7) < 0.1 and abs(offset - 1) < 0.15
    _, shifted = quality.calibrated(z, y, np.where(y == 1, 3.0, 1.0))
    assert shifted > offset + 0.7


def test_verdict_on_labels_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").withColumn("p_good", F.lit(1))
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    got = quality.judge(docs.filter("doc_id % 2 = 1"), model).join(labels.select("doc_id", "quality"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert len(bad) > 100 and np.mean([r["kept"] for r in good]) >= 0.995 and np.mean([not r["kept"] for r in bad]) >= 0.97
    # probabilities are those of the table's classes, not of the balanced sample
    assert abs(np.mean([r["p_good"] for r in got]) - len(good) / len(got)) < 0.05


def test_labels_of_one_class_or_none(spark):
    docs = spark.createDataFrame([(1, TEXTS[15]), (2, TEXTS[15])], "doc_id long, text string")
    for labels, kept in (([], True), ([(1, 1)], True), ([(1, 0), (None, 1), (2, None)], False)):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r["kept"] for r in quality.judge(docs, model).collect()} == {kept}
