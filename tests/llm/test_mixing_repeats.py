"""Rows without an id and rows that repeat one are dealt to groups of bounded size, and all are taken as mixed."""

from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm import mixing


def test_repeated_and_null_ids(spark, monkeypatch):
    rows = [(None, "w " * (i % 7 + 1), f"s{i % 2}") for i in range(400)] + [(5, "a b c", "s0")] * 1500 + [(i + 10, "x y", None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = []
    settle = mixing.written

    def seen(frame, name):
        out = settle(frame, name)
        if name == "settled0":
            sizes.extend(r["count"] for r in out.groupBy("source", "bucket").count().collect())
        return out

    monkeypatch.setattr(mixing, "written", seen)
    runs = []
    for parts in (2, 5):
        docs = df.repartition(parts)
        mixed = mixing.mix_sources(docs, group_rows=100)
        out = mixing.take(docs, mixed)
        runs.append(Counter(tuple(r) for r in mixed.select("doc_id", "source", "size", "digest", "copies").collect()))
        want = Counter()
        for (i, s, n, _, c), k in runs[-1].items():
            want[i, s, n] += c * k
        got = Counter(tuple(r) for r in out.select("doc_id", "source", mixing.n_words(F.col("text"))).collect())
        assert got == +want and out.columns == df.columns
        assert mixed.count() == len(rows)
    assert runs[0] == runs[1]
    assert max(sizes) <= 200
