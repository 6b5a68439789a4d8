"""Memory that a Python worker takes beside its batch stays small, and results stay the same."""

import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash

from gridloom.llm import jaccard, language


class Shared:
    def __init__(self, value):
        self.value = value


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_language_takes_few_rows_of_the_table_at_once():
    rng = np.random.default_rng(1)
    model = language.LanguageModel([f"l{i}" for i in range(8)], rng.normal(size=(language.BUCKETS, 8)).astype(np.float32), np.zeros(8, np.float32), 1.0, 0.0)
    texts = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(1000)]
    got, peak = peak_mb(lambda: language.logits_of(model, texts))
    assert peak < 25  # 83 with a million bytes at once
    assert np.allclose(got[:3], np.concatenate([language.logits_of(model, [t]) for t in texts[:3]]))
    long = "".join(texts)
    idx, n = language.features(long)
    assert np.allclose(language.logits_of(model, [long])[0], language.shares(n) @ model.table[idx], atol=1e-4)


def test_sets_of_a_leader_take_one_matrix():
    m, base = 2000, np.arange(100, dtype=np.int64)
    rng = np.random.default_rng(2)
    gone = [np.sort(rng.choice(base, rng.integers(0, 20), replace=False)) for _ in range(m)]
    new = [np.sort(rng.choice(1000 + base, rng.integers(0, 12), replace=False)) for _ in range(m)]
    n = [100 - len(g) + len(x) for g, x in zip(gone, new, strict=True)]
    kinds = {"lead": pa.int64(), "i": pa.int32(), "j": pa.int32(), "node": pa.int64(), "n": pa.int64(), "n_lead": pa.int64(), "gone": pa.list_(pa.int64()), "new": pa.list_(pa.int64())}
    cols = [[7] * m, [0] * m, [0] * m, range(m), n, [100] * m, [g.tolist() for g in gone], [x.tolist() for x in new]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))
    found, peak = peak_mb(lambda: [tuple(e.values()) for b in jaccard._derive(80)(iter([batch])) for e in b.to_pylist()])
    assert peak < 50  # 66 with three matrices
    sets = [set(base.tolist()) - set(g.tolist()) | set(x.tolist()) for g, x in zip(gone, new, strict=True)]
    top = list(range(m))
    for a in range(m):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                x, y = top[a], top[b]
                if x != y:
                    top = [min(x, y) if t in (x, y) else t for t in top]
    want = {(i, t) for i, t in enumerate(top) if i != t}
    assert {(max(e), min(e)) for e in found} == want


def test_word_hashes_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(jaccard, "CACHE_WORDS", 5)
    hashes, words = jaccard.WordHashes(), [b"w%d" % i for i in range(20)]
    assert [hashes[w] for w in words * 2] == [xxhash.xxh3_64_intdigest(w) for w in words * 2]
    assert list(hashes) == words[:5]  # full: what came first stays, nothing is thrown away for rare words


def test_wanted_texts_are_picked_from_packed_bits():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 63), 1 << 63, 2000)
    parts = list(jaccard._wanted_bits(iter([pa.RecordBatch.from_arrays([pa.array(keys[:1000])], ["h"])])))[0]
    by_slice = dict(zip(parts.column(1).to_pylist(), parts.column(2).to_pylist(), strict=True))
    size = (1 << jaccard.WANTED_BITS) // 8 // jaccard.SLICES
    table = b"".join(by_slice.get(i, bytes(size)) for i in range(jaccard.SLICES))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["t"] * 2000), pa.array(keys)], ["doc_id", "text", "h"])
    got, peak = peak_mb(lambda: [i for b in jaccard._picked(Shared(table))(iter([batch])) for i in b.column(0).to_pylist()])
    assert set(range(1000)) <= set(got) and len(got) < 1010
    assert peak < 8  # 17 with a byte for each bit
