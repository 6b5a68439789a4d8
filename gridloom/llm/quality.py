"""Operator 12: quality rules, fixed limits on counts and a calibrated n-gram classifier.

Counts of a text (words, characters, symbols, repeated lines and word windows) are taken in Arrow
batches over whole texts: words of a batch become whole numbers by dictionary encoding, so windows
are compared exactly and without a loop over words. The classifier is a logistic regression over
hashed features: single words and pairs of neighbouring words in one table, 2- to 4-grams of bytes
in another, both with upper and lower case kept and averaged over the text, so the logit of a text
is two means of table entries. It is fitted by stochastic gradient descent on a bounded, stratified
sample of the labelled rows (about ``SAMPLE_DOCS``, chosen by a hash of the id). Two fifths of the
sample are set aside for calibration: slope and offset of the logit are fitted to them, with each
class at the weight that it has among all labelled rows. A text is kept if it fails none of the
fixed limits and its calibrated probability of good quality is ``LEAST_GOOD`` or more.

Defined results: a null or empty text has no words, fails the limits and is not kept; without labelled
rows of both classes every probability is next to the class there is (1 without any) and the limits
decide; several labels of a document count as good only if all are; repeated rows give one result row each; a
null id is kept and never learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import small_batches, table
from gridloom.llm.language import packed, shares, unpacked

LEAST_WORDS, MOST_REPEATED, REPEAT_WORDS = 50, 50, 3
LEAST_GOOD = 0.5
SAMPLE_DOCS, EPOCHS, RATE, DECAY = 4000, 6, 0.5, 1e-4
BUCKETS = 1 << 16
#: Bytes of text whose words, or whose n-grams, are in memory at once; a longer text has its words alone.
CHUNK_BYTES = 2_000_000

SYMBOLS = b"#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_IS_BLANK = np.isin(np.arange(256), list(_BLANKS.encode()))
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class QualityModel:
    words: np.ndarray  # an entry for each bucket of words and pairs
    grams: np.ndarray  # and of byte n-grams
    bias: float
    slope: float
    offset: float


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (and the last one ends)."""
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data else np.zeros(0, np.uint8)), places - places[0]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            n += line in seen
            seen.add(line)
    return n


@dataclass
class Words:
    """Words of some texts in order: number of each word, the text it is in, hashes by number."""

    code: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    chars: np.ndarray


def words_of(texts: pa.Array) -> Words:
    split = pc.ascii_split_whitespace(texts)
    found, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    length = pc.utf8_length(found)
    real = pc.greater(length, 0)
    coded = found.filter(real).dictionary_encode()
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    return Words(coded.indices.to_numpy().astype(np.int64), owner[real.to_numpy(zero_copy_only=False)], hashes, length.filter(real).to_numpy())


def in_repeated_windows(w: Words, n_texts: int, size: int = REPEAT_WORDS) -> np.ndarray:
    """For each word whether a window of ``size`` words that holds it occurs twice or more in its text."""
    n = len(w.code)
    covered = np.zeros(n, bool)
    if n < size:
        return covered
    window, base = w.code, len(w.hashes)
    for k in range(1, size):
        # longer windows get numbers again, so that each step stays within 64 bits
        window = pd.factorize(window[: n - k] * base + w.code[k:])[0]
    whole = w.owner[: n - size + 1] == w.owner[size - 1 :]
    keys = pd.factorize((window * n_texts + w.owner[: n - size + 1])[whole])[0]
    twice = np.zeros(n - size + 1, bool)
    twice[whole] = np.bincount(keys)[keys] > 1 if len(keys) else False
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return covered


def word_features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of single words and of pairs of neighbours, and the texts they are in."""
    h = w.hashes[w.code] if len(w.code) else np.zeros(0, np.uint32)
    yield (h * np.uint32(0x9E3779B1)) >> np.uint32(16), w.owner
    inside = w.owner[:-1] == w.owner[1:]
    yield (((h[:-1] * np.uint32(0x01000193) ^ h[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(16))[inside], w.owner[:-1][inside]


def gram_features(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of 2-, 3- and 4-grams of bytes, and the texts they are in, some places at a time."""
    for low in range(0, len(data), CHUNK_BYTES):
        place = np.arange(low, min(low + CHUNK_BYTES, len(data)))
        owner = np.searchsorted(starts, place, side="right") - 1
        end = starts[owner + 1]
        a = np.concatenate([data[low : low + len(place) + 3], np.zeros(3, np.uint8)]).astype(np.uint32)
        key = a[: len(place)]
        for n in (2, 3, 4):
            key = key * np.uint32(0x01000193) ^ a[n - 1 :][: len(place)]
            inside = place + n <= end
            yield ((key * np.uint32(0x9E3779B1)) >> np.uint32(16))[inside], owner[inside]


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about CHUNK_BYTES, each of one text at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    low, held = 0, 0
    for i, s in enumerate(size):
        if held and held + s > CHUNK_BYTES:
            yield texts.slice(low, i - low)
            low, held = i, 0
        held += int(s)
    if low < len(texts):
        yield texts.slice(low)


def measured(texts: pa.Array, model: QualityModel | None) -> dict[str, np.ndarray]:
    """The counts of each text, and with a model its logit."""
    n = len(texts)
    data, starts = raw(texts)
    w = words_of(texts)
    n_words = np.bincount(w.owner, minlength=n)
    out = {
        "n_words": n_words,
        "word_chars": np.bincount(w.owner, weights=w.chars, minlength=n).astype(np.int64),
        "n_symbols": np.diff(np.concatenate([[0], np.cumsum(_IS_SYMBOL[data])])[starts]),
        "n_dup_lines": np.fromiter(map(repeated_lines, texts.to_pylist()), np.int64, n),
        "n_repeat_words": np.bincount(w.owner, weights=in_repeated_windows(w, n), minlength=n).astype(np.int64),
    }
    if model is not None:
        logit = np.full(n, model.bias)
        for features, entries in ((word_features(w), model.words), (gram_features(data, starts), model.grams)):
            total, seen = np.zeros(n), np.zeros(n)
            for bucket, owner in features:
                total += np.bincount(owner, weights=entries[bucket], minlength=n)
                seen += np.bincount(owner, minlength=n)
            logit += total / np.maximum(seen, 1)
        out["logit"] = logit
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed buckets and counts of each sampled text."""

    def of(features) -> bytes:
        total = np.zeros(BUCKETS, np.uint32)
        for bucket, _ in features:
            total += np.bincount(bucket, minlength=BUCKETS).astype(np.uint32)
        idx = np.flatnonzero(total)
        return packed(idx.astype(np.uint16), total[idx])

    for batch in batches:
        for i in range(batch.num_rows):
            text = pc.fill_null(batch.column(0).slice(i, 1), "")
            yield pa.RecordBatch.from_arrays([pa.array([of(word_features(words_of(text)))], pa.binary()), pa.array([of(gram_features(*raw(text)))], pa.binary()), *(c.slice(i, 1) for c in batch.columns[1:])], ["words", "grams", "good", "part"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 12) -> QualityModel:
    """docs: doc_id and text; labels: doc_id and quality (1: good)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"))
    n = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(n) < 2:
        return one_class(1 if 0 not in n else 0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)
    share = F.when(F.col("good") == 1, F.lit(min(1.0, sample_docs / 2 / n[1]))).otherwise(F.lit(min(1.0, sample_docs / 2 / n[0])))
    # about sample_docs pairs of numbers: small enough to broadcast
    chosen = F.broadcast(rows.filter(draw < share))
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)).alias("part")
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("text", F.col("good").cast("int").alias("good"), part)
    found = sample.mapInArrow(_sampled, "words binary, grams binary, good int, part long").collect()
    found.sort(key=lambda r: (r["good"], r["words"], r["grams"], r["part"]))  # the same order in each run
    y = np.array([r["good"] for r in found], float)
    if len(set(y)) < 2:
        return one_class(int(y[0]) if len(y) else 1)
    x = [(unpacked(r["words"]), unpacked(r["grams"])) for r in found]
    kept = np.array([r["part"] > 1 for r in found])
    if len({*y[kept]}) < 2 or len({*y[~kept]}) < 2:
        kept = np.ones(len(y), bool)
    weight = np.where(y == 1, n[1] / (y == 1).sum(), n[0] / (y == 0).sum())
    return fit(x, y, kept, weight, seed)


def one_class(good: int) -> QualityModel:
    return QualityModel(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, 20.0 if good else -20.0)


def fit(x: list, y: np.ndarray, kept: np.ndarray, weight: np.ndarray, seed: int) -> QualityModel:
    """Adaptive stochastic gradient steps on the log loss; then slope and offset on the rows set aside."""
    rng = np.random.default_rng(seed)
    tables, seen, bias = [np.zeros(BUCKETS), np.zeros(BUCKETS)], [np.full(BUCKETS, 1e-8), np.full(BUCKETS, 1e-8)], 0.0
    x = [tuple((idx, shares(m).astype(float)) for idx, m in row) for row in x]

    def logit(row) -> float:
        return bias + sum(float(s @ t[idx]) for (idx, s), t in zip(row, tables, strict=True))

    rows, n = np.flatnonzero(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(rows):
            rate = RATE * (1 - n / (EPOCHS * len(rows)))
            n += 1
            g = 1 / (1 + np.exp(-np.clip(logit(x[i]), -30, 30))) - y[i]
            for (idx, s), t, acc in zip(x[i], tables, seen, strict=True):
                grad = g * s + DECAY * s * t[idx]
                acc[idx] += grad * grad
                t[idx] -= rate * grad / np.sqrt(acc[idx])
            bias -= 0.02 * g
    check = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(y))
    z = np.array([logit(x[i]) for i in check])
    slope, offset = calibrated(z, y[check], weight[check])
    return QualityModel(*tables, bias, slope, offset)


def calibrated(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logits by Newton steps on the weighted log loss, with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x, ab = np.stack([z / scale, np.ones(len(z))], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * ab
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        ab -= step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
    return float(ab[0] / scale), float(ab[1])


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = 0
            for texts in slices(pc.fill_null(batch.column(1), "")):
                got = measured(texts, model)
                z = np.clip(model.slope * got.pop("logit") + model.offset, -30, 30)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *(pa.array(got[c], pa.int64()) for c in COUNTS), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", *COUNTS, "p_good"])
                at += len(texts)

    return run


def judge(docs: DataFrame, model: QualityModel, least_good: float = LEAST_GOOD) -> DataFrame:
    """doc_id, the counts, p_good (calibrated), base_failed and kept of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    out = rows.mapInArrow(_judged(spark.sparkContext.broadcast(model)), f"doc_id long, {kinds}, p_good double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least_good))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
