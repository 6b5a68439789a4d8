"""Operator 8: a counterfactual-regularised toxicity classifier.

Features are the presence of a word or of a word's first 4, 5 or 6 bytes. On a bounded, stratified
sample of the labelled rows (about ``SAMPLE_DOCS``, chosen by a hash of the id) their document
frequencies in toxic and other texts are counted by a distributed aggregation; those associated
with the label (G statistic) are kept, ``MAX_FEATURES`` at most. A logistic regression over them is
fitted by stochastic gradient descent. For sampled texts that hold an identity term, versions with the
term exchanged for another of the same kind are made, and the squared change of the score is
penalised: a neutral mention of a group then moves no score, whatever the sample's toxic texts happen
to name.

Identity terms are names of groups, a parameter, and terms found in the sample: frequent words that
say nothing of the label (G below ``NEUTRAL_G``), ``TERMS`` at most, of which two are of a kind where
each is the other's nearest by the words next to them (cosine of at least ``LIKE``). Terms that are found
are features themselves, so that the penalty has something to hold; names are only where the label
makes them one, so that the exchange for a name that is none takes their weight away. A text gives a version for every name
in it, and for ``EXCHANGES`` of the terms found at most, those with the smallest hashes.

Defined results: null and empty texts get the score of no features; where all labelled rows are of one
class every score is next to that class (0 without labelled rows); several labels of a document
count as toxic if one is; repeated rows give one result row each; a null id is kept and never
learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gridloom.llm.common import crc_bucket, small_batches, table, with_arrays, with_columns_of

SAMPLE_DOCS = 12_000
MAX_FEATURES = 20_000
LEAST_G, LEAST_DOCS = 12.0, 3
#: Terms that are looked for, frequent words that stand for their context, and what makes a term and a pair.
TERMS, CONTEXTS, NEUTRAL_G, TERM_BYTES, LIKE = 512, 256, 3.84, 3, 0.5
EXCHANGES = 4
EPOCHS, RATE, DECAY, COUNTERFACTUAL = 12, 0.5, 1e-4, 1.0
CACHE_WORDS = 1 << 17
FLUSH = 300_000

#: Names of groups, by kind: each may stand for another of its row (fixed values).
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)

Groups = tuple[tuple[str, ...], ...]

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


@dataclass
class ToxicityModel:
    features: dict[bytes, int]
    weights: np.ndarray
    bias: float
    pairs: int = 0  # exchanges that the penalty acted on


def words(text: str | None) -> set[bytes]:
    """Distinct lower-case words: runs of ASCII letters and of bytes of other characters."""
    return set((text or "").lower().encode().translate(_LETTERS).split())


def of_word(w: bytes) -> list[bytes]:
    return [w, *(b"^%d" % n + w[:n] for n in (4, 5, 6) if len(w) >= n)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        for toxic, c in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["feature", "toxic", "n"])
            c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[int(toxic)].update({f for w in words(text) for f in of_word(w)})
        if len(seen[0]) + len(seen[1]) > FLUSH:
            yield from out()
    yield from out()


def swaps(groups: Groups) -> dict[bytes, list[bytes]]:
    """For each name (one word, lower case) the others of its row."""
    return {a.lower().encode(): [b.lower().encode() for b in g if b != a] for g in groups for a in g}


def _contexts(shared):
    """How often each term has each of the frequent words before it (a number) and behind it (the next ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, frequent = shared.value
        seen = np.zeros((len(terms), 2 * len(frequent)), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = (text or "").lower().encode().translate(_LETTERS).split()
                for i, w in enumerate(found):
                    t = terms.get(w)
                    if t is not None:
                        for side, at in ((0, i - 1), (1, i + 1)):
                            if 0 <= at < len(found) and (k := frequent.get(found[at])) is not None:
                                seen[t, 2 * k + side] += 1
        t, k = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(seen[t, k])], ["term", "place", "n"])

    return run


def kinds_of(terms: list[bytes], counts: np.ndarray) -> Groups:
    """Pairs of terms, each the other's nearest by cosine of the counts of their neighbours."""
    if len(terms) < 2:
        return ()
    x = counts / np.maximum(np.sqrt((counts * counts).sum(1)), 1e-12)[:, None]
    like = x @ x.T
    np.fill_diagonal(like, -1)
    near = like.argmax(1)
    return tuple((terms[i].decode("utf-8", "replace"), terms[j].decode("utf-8", "replace")) for i, j in enumerate(near) if i < j and near[j] == i and like[i, j] >= LIKE)


def terms_of(sample: DataFrame, df: DataFrame, g: Column, most: int = TERMS) -> Groups:
    """Identity terms of a sample: df has its features with the numbers a and b of toxic and other texts, g their statistic."""
    both = F.col("a") + F.col("b")
    word = (F.col("feature").substr(1, 1) != F.lit(b"^")) & (F.octet_length("feature") > TERM_BYTES)
    frequent = [bytes(r["feature"]) for r in df.filter(F.col("feature").substr(1, 1) != F.lit(b"^")).orderBy(F.desc(both), "feature").limit(CONTEXTS).select("feature").collect()]
    terms = [bytes(r["feature"]) for r in df.filter(word & (F.col("a") >= LEAST_DOCS) & (F.col("b") >= LEAST_DOCS)).filter(g < NEUTRAL_G).orderBy(F.desc(both), "feature").limit(most).select("feature").collect()]
    terms = [t for t in terms if t.decode("utf-8", "replace").encode() == t]
    if not terms:
        return ()
    shared = sample.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, {w: i for i, w in enumerate(frequent)}))
    counts = np.zeros((len(terms), 2 * len(frequent)))
    for r in sample.mapInArrow(_contexts(shared), "term int, place int, n long").groupBy("term", "place").agg(F.sum("n").alias("n")).collect():
        counts[r["term"], r["place"]] = r["n"]
    return kinds_of(terms, counts)


def _vectors(shared, named: Groups, found: Groups, most: int = EXCHANGES):
    """Feature numbers of a sampled text, and those that go and come where a term of it is exchanged: every name, and
    of the terms found ``most`` versions."""
    names, terms = swaps(named), swaps(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = words(text)
                base, gone, new = _numbers(own, known), [], []
                versions = sorted((w, other) for w in own & names.keys() for other in names[w])
                more = [(w, other) for w in own & terms.keys() for other in terms[w]]
                for w, other in versions + sorted(more, key=lambda v: (zlib.crc32(v[0] + b" " + v[1], len(own)), v))[:most]:
                    x = _numbers(own - {w} | {other}, known)
                    gone.append(np.setdiff1d(base, x).tobytes())
                    new.append(np.setdiff1d(x, base).tobytes())
                blob = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([base.tobytes()], pa.binary()), pa.array([int(toxic)], pa.int32()), pa.array([gone], blob), pa.array([new], blob)], ["x", "toxic", "gone", "new"])

    return run


def _numbers(own: set[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.array(sorted({known[f] for w in own for f in of_word(w) if f in known}), dtype=np.int32)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 8, groups: Groups = GROUPS, penalty: float = COUNTERFACTUAL, terms: int = TERMS) -> ToxicityModel:
    """docs: doc_id and text; labels: doc_id and toxic (0 or 1); groups: names that stand for one another; terms: how
    many are looked for in the sample; penalty: weight of changed scores (0: a plain logistic regression)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel({}, np.zeros(0), -20.0 if 1 not in n else 20.0)
    third = sample_docs / 3
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, third / n[1]))).otherwise(F.lit(min(1.0, 2 * third / n[0])))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)
    # about sample_docs pairs of numbers at most: small enough to broadcast
    chosen = F.broadcast(rows.filter(draw < share))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")
    df = sample.mapInArrow(_frequencies, "feature binary, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    picked = sample.groupBy("toxic").count().collect()
    size = {r["toxic"]: float(r["count"]) for r in picked}
    pos, neg = size.get(1, 0.0), size.get(0, 0.0)
    if not pos or not neg:
        return ToxicityModel({}, np.zeros(0), -20.0 if not pos else 20.0)
    a, b, total = F.col("a"), F.col("b"), pos + neg

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    g = 2 * (term(a, (a + b) * (pos / total)) + term(b, (a + b) * (neg / total)) + term(F.lit(pos) - a, (F.lit(total) - a - b) * (pos / total)) + term(F.lit(neg) - b, (F.lit(total) - a - b) * (neg / total)))
    best = df.filter(a + b >= LEAST_DOCS).withColumn("g", g).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).select("feature").collect()
    alike = terms_of(sample, df, g, terms) if terms else ()
    features = [bytes(r["feature"]) for r in best]
    features += sorted(swaps(alike).keys() - set(features))
    known = {f: i for i, f in enumerate(features)}
    found = sample.mapInArrow(_vectors(spark.sparkContext.broadcast(known), groups, alike), "x binary, toxic int, gone array<binary>, new array<binary>").collect()
    found.sort(key=lambda r: (r["toxic"], r["x"], r["gone"], r["new"]))
    own = [(np.frombuffer(r["x"], np.int32), float(r["toxic"])) for r in found]
    pairs = [(np.frombuffer(x, np.int32), np.frombuffer(y, np.int32)) for r in found for x, y in zip(r["gone"], r["new"], strict=True)]
    return fit(known, own, [p for p in pairs if len(p[0]) or len(p[1])], seed, penalty)


def fit(known: dict[bytes, int], rows: list, pairs: list, seed: int, penalty: float = COUNTERFACTUAL) -> ToxicityModel:
    """Adaptive stochastic gradient steps on the log loss plus the penalty on changed scores.

    rows: feature numbers and label; pairs: features that an exchange of names takes away and adds. In
    each epoch every pair is met once on average, however many there are to a row."""
    rng = np.random.default_rng(seed)
    w, seen, b = np.zeros(len(known)), np.ones(len(known)), -2.0
    each = len(pairs) / max(1, len(rows)) if penalty else 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            z = np.clip(w[x].sum() + b, -30, 30)
            g = 1 / (1 + np.exp(-z)) - y
            grad = g + DECAY * w[x]
            seen[x] += grad * grad
            w[x] -= RATE * grad / np.sqrt(seen[x])
            b -= 0.02 * g
            for _ in range(int(each + rng.random()) if pairs else 0):
                gone, new = pairs[rng.integers(len(pairs))]
                change = w[gone].sum() - w[new].sum()
                # at most the step that brings the two scores together
                step = min(1.0, penalty) * change / max(1, len(gone) + len(new))
                w[gone] -= step
                w[new] += step
    return ToxicityModel(known, w, float(b), len(pairs) if penalty else 0)


def _score(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        known, weights = model.features, model.weights.tolist()
        for batch in batches:
            scores = []
            for text in batch.column(at).to_pylist():
                hits: set[int] = set()
                for w in words(text):
                    f = cache.get(w)
                    if f is None:
                        f = tuple(known[x] for x in of_word(w) if x in known)
                        if len(cache) < CACHE_WORDS:
                            cache[w] = f
                    if f:
                        hits.update(f)
                scores.append(model.bias + sum(weights[i] for i in sorted(hits)))
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, dtype=float), -30, 30)))
            yield with_arrays(batch, pa.array(score))

    return run


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All columns of docs (with a column text), and the score (0 to 1) under a name; a column of docs
    that has this name is left out."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return with_columns_of(docs, lambda at: _score(shared, at), [StructField(name, DoubleType())])


def trained(spark, sf_dir: str) -> ToxicityModel:
    """On labelled documents that are not held out: crc32 of the id modulo 5 is not 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_bucket("doc_id", 5) != 0)
    return train(table(spark, sf_dir, "documents"), labels)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, sf_dir))
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
