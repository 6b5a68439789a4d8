"""Work that is formed in slices gives the same rows, whatever the slice."""

import numpy as np

from gridloom.llm import jaccard, mixing


def test_pairs_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words, 30)) for _ in range(6)]
    texts = [b + (f" tail{k % 3}" if k % 2 else "") for k in range(30) for b in base]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(map(tuple, jaccard.similar_components(docs, 3, 80).collect()))
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 3)
    assert sorted(map(tuple, jaccard.similar_components(docs, 3, 80).collect())) == want


def test_equal_rows_in_lots(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 23 + [(2, "d e", "y"), (None, None, "x")], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 4)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == want and len(want) == 25
