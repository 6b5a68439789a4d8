"""Small sets at thresholds that two or one shared shingle can reach."""

import numpy as np
import pytest

from gridloom.llm import jaccard
from test_corpus import brute_components, docs_of


@pytest.mark.parametrize("percent", [66, 50])
def test_small_sets_link(spark, percent):
    rng = np.random.default_rng(9)
    texts = ["a b", "a b c", "x", "x y", None, ""]
    for i in range(25):
        words = [f"{i}w{j}" for j in range(rng.integers(1, 7))]
        texts += [" ".join([*words, *(f"{i}v{k}{j}" for j in range(rng.integers(0, 3)))]) for k in range(2)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs_of(spark, texts), 1, percent).collect()}
    want = brute_components(texts, 1, percent)
    assert [got[i] for i in range(len(texts))] == want
    assert got[1][1] == 0
