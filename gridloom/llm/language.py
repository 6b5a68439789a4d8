"""Operator 7: language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its byte 2-, 3- and 4-grams (hashed into ``BUCKETS``
rows) followed by a linear softmax; both are trained together by stochastic gradient descent in
numpy. Training uses a stratified sample of the labelled rows of about ``SAMPLE_DOCS`` documents,
chosen by a hash of the id; two fifths of it are set aside to fit the temperature of the probabilities
and the confidence below which a prediction is rejected. Prediction reads whole texts: as the
softmax is linear, embeddings and weights are multiplied once and a text is a sum of table rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not accepted;
with no labelled row every text is; repeated rows give one result row each; a null id is kept and
never learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from gridloom.llm.common import crc_bucket, small_batches, table, with_arrays, with_columns_of

BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 4, 0.1
SAMPLE_DOCS = 4000
#: Share of right predictions of the calibration rows that rejection may cost, and its highest bar.
LOST, MOST = 0.002, 0.5
#: Bytes of texts at once: a row of the table, 32 bytes for eight languages, is taken for each.
CHUNK_BYTES = 1 << 17

_SPACE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_GAP = b"    "


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # a row for each bucket: embedding times weights
    bias: np.ndarray
    temperature: float
    reject_below: float


def normal(text: str) -> bytes:
    """Lower case, with blanks for ASCII that is no letter."""
    return text.lower().encode().translate(_SPACE)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams at each place (3 rows), and which places count."""
    a = data.astype(np.uint32)
    two = a[:-3] * np.uint32(0x01000193) ^ a[1:-2]
    three = two * np.uint32(0x01000193) ^ a[2:-1]
    four = three * np.uint32(0x01000193) ^ a[3:]
    out = np.stack([two, three, four])
    out *= np.uint32(0x9E3779B1)
    out >>= np.uint32(16)
    blank = (data[:-3] == 0x20) & (data[1:-2] == 0x20)
    return out, ~blank


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, in order, and how many of its grams fall into each."""
    data = np.frombuffer(b" " + normal(text) + _GAP, dtype=np.uint8)
    idx, counts = grams(data)
    idx, n = np.unique(idx[:, counts], return_counts=True)
    return idx.astype(np.uint16), n.astype(np.uint32)


def shares(n: np.ndarray) -> np.ndarray:
    return (n / max(1, n.sum())).astype(np.float32)


def packed(idx: np.ndarray, n: np.ndarray) -> bytes:
    """Both arrays in few bytes: steps between buckets are small, and so are most counts."""
    return zlib.compress(np.diff(idx, prepend=np.uint16(0)).tobytes() + n.tobytes(), 6)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    m = len(raw) // 6
    n = np.frombuffer(raw, np.uint32, offset=2 * m)
    return np.cumsum(np.frombuffer(raw, np.uint16, m), dtype=np.uint16), n.astype(np.uint16) if not len(n) or n.max() < 1 << 16 else n


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([packed(*features(text))], pa.binary()), pa.array([part], pa.int64())], ["lang", "grams", "part"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> LanguageModel | None:
    """Fits on rows (doc_id, text, lang) with a non-null lang; None where there are none."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    n_by_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n_by_lang:
        return None
    langs = sorted(n_by_lang)
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, sample_docs / len(langs) / n_by_lang[lang])))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.filter(draw < share[F.col("lang")]).select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)).alias("part"))
    found = sample.mapInArrow(_sampled, "lang string, grams binary, part long").collect()
    found.sort(key=lambda r: (r["lang"], r["grams"], r["part"]))  # the same order in each run
    y = np.array([langs.index(r["lang"]) for r in found])
    x = [unpacked(r["grams"]) for r in found]
    kept = np.array([r["part"] > 1 for r in found]) if len(found) >= 50 else np.ones(len(found), bool)
    return fit(langs, x, y, kept, seed)


def fit(langs: list[str], x: list, y: np.ndarray, kept: np.ndarray, seed: int) -> LanguageModel:
    """Adaptive stochastic gradient steps on the log loss, one text at a time."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    seen_e, seen_w, seen_b = np.full(BUCKETS, 1e-8, np.float32), np.full(w.shape, 1e-4, np.float32), np.ones(len(langs), np.float32)
    train_rows, n = np.flatnonzero(kept), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(train_rows):
            rate = RATE * (1 - n / (EPOCHS * len(train_rows)))
            n += 1
            idx, n_grams = x[i]
            if not len(idx):
                continue
            share = shares(n_grams)
            h = share @ emb[idx]
            g = _softmax(h @ w + b)
            g[y[i]] -= 1
            back, outer = w @ g, np.outer(h, g)
            seen_w += outer * outer
            w -= rate * outer / np.sqrt(seen_w)
            seen_b += g * g
            b -= rate * g / np.sqrt(seen_b)
            seen_e[idx] += share * share * float(back @ back)
            emb[idx] -= (rate * share / np.sqrt(seen_e[idx]))[:, None] * back
    logits = np.array([(shares(m) @ emb[idx]) @ w + b for idx, m in x])
    check = np.flatnonzero(~kept) if (~kept).any() else np.arange(len(y))
    # the temperature at which the mean confidence is the (smoothed) share of right predictions
    share_right = ((logits[check].argmax(1) == y[check]).sum() + 1) / (len(check) + 2)
    temperature = min((0.5 * 1.15**k for k in range(45)), key=lambda t: abs(_softmax(logits[check] / t).max(1).mean() - share_right))
    p = _softmax(logits[check] / temperature)
    right = p.max(1)[p.argmax(1) == y[check]]
    bar = min(MOST, float(np.quantile(right, LOST))) if len(right) else 0.0
    return LanguageModel(langs, emb @ w, b, float(temperature), bar)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits_of(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Logits of whole texts, a few at a time; a long text in slices that overlap by three bytes."""
    sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    part: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if part:
            data = np.frombuffer(b"".join(part) + _GAP, dtype=np.uint8)
            idx, counts = grams(data)
            starts = np.cumsum([0, *map(len, part)])[:-1]
            own = np.array(owner)
            counts_f = counts.astype(np.float32)
            for row in idx:
                got = model.table[row]
                got *= counts_f[:, None]
                np.add.at(sums, own, np.add.reduceat(got, starts, axis=0))
            np.add.at(n, own, 3 * np.add.reduceat(counts_f, starts))
        part.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        data = b" " + normal(text)
        for at in range(0, len(data), CHUNK_BYTES):
            # the gap after a slice makes no grams of its own but for the last letters of the text
            piece = data[at : at + CHUNK_BYTES]
            more = data[at + CHUNK_BYTES : at + CHUNK_BYTES + 3]
            part.append(piece + (more if more else _GAP))
            owner.append(i)
            size += len(piece)
            if size >= CHUNK_BYTES:
                flush()
    flush()
    return sums / np.maximum(n, 1)[:, None] + model.bias


def _predict(shared, place: int):
    import regex

    letter = regex.compile(r"\p{L}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            known = np.array([bool(letter.search(t)) for t in texts], dtype=bool) & (model is not None)
            langs, score, ok = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = np.flatnonzero(known)
            if len(at):
                p = _softmax(logits_of(model, [texts[i] for i in at]) / model.temperature)
                score[at] = p.max(1)
                ok[at] = score[at] >= model.reject_below
                for i, k in zip(at, p.argmax(1), strict=True):
                    langs[i] = model.langs[k]
            yield with_arrays(batch, pa.array(langs), pa.array(score), pa.array(ok))

    return run


def predict(docs: DataFrame, model: LanguageModel | None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """All columns of docs (with a column text), and what is predicted under three names; columns of docs
    that have one of these names are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = (StringType(), DoubleType(), BooleanType())
    return with_columns_of(docs, lambda at: _predict(shared, at), [StructField(n, t) for n, t in zip(names, kinds, strict=True)])


def trained(spark, sf_dir: str) -> LanguageModel | None:
    """On the documents that are not held out: crc32 of the id modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return train(docs.filter(crc_bucket("doc_id", 3) != 1))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs, trained(spark, sf_dir)).select("doc_id", held_out, "lang_pred", "score", "accepted")
