"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; each of its documents should be taken
``target / source_size`` times. The whole part of that is certain, the fractional part is a
probability, and pivotal rounding settles the probabilities together: two documents are paired, and
words are moved at random from one to the other until one of them has probability 0 or 1. A move
keeps the pair's expected number of words and each document's own expectation, so a source's words
differ from its target by less than the size of the one document that is settled last.

Pairing runs inside (source, bucket) groups of bounded size first, so that a source with most of
the rows is dealt to many tasks; the one unsettled document of each group then goes up a reduction
tree of ``FAN`` groups to a node until a source has one left. Buckets, order and random numbers
come from hashes of the documents' ids and texts, and of a number among rows that have the same id,
source and text, so reruns agree whatever the partitions are.

Defined results: a null text has size 0; documents of size 0 take no part in the rounding and keep
the whole part of their copies; a null source is a source of its own, ordered last; repeated rows
are rounded as documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2.0
#: Documents in a group of the first level, on average, and groups under a node of the tree.
GROUP_ROWS, FAN = 4096, 64

_ROWS = "doc_id long, source string, size long, digest long, number long, whole long, p double, bucket long"
#: What rows that cannot be told apart have in common.
_KEY = ["doc_id", "source", "size", "digest"]
#: Repeated documents that one task writes.
CHUNK = 1024


def _keys(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("digest")]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: float = MAX_COPIES) -> DataFrame:
    """source, n_docs, source_size and target of every source, from rows (source, size).

    Only sums over sources reach the driver: the level is found at which shares in proportion to the
    weights, cut at ``max_copies`` times the source's size, add up to the whole budget."""
    sums = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = written(sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_copies)), "sources")
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, above = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("cap")
        held, free, n = sources.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == above or not free:
            break
        above, level = n, (budget - (held or 0.0)) / free
    return sources.select("source", "n_docs", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Probabilities after pairing in the given order: all 0 or 1 but at most one (none if last)."""
    p = p.astype(float).copy()
    draws = rng.random(len(p) + 1)
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b = float(size[i]), float(size[j])
        gain_i, gain_j = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        if draws[j] * (gain_i + gain_j) < gain_j:
            full, empty = (1 - p[i]) * a <= gain_i, p[j] * b <= gain_i
            p[i], p[j] = (1.0 if full else p[i] + gain_i / a), (0.0 if empty else p[j] - gain_i / b)
        else:
            empty, full = p[i] * a <= gain_j, (1 - p[j]) * b <= gain_j
            p[i], p[j] = (0.0 if empty else p[i] - gain_j / a), (1.0 if full else p[j] + gain_j / b)
        i = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    if last and i >= 0:
        p[i] = float(draws[-1] < p[i])
    return p


def _settle_group(seed: int, level: int, last: bool):
    def run(key, rows):
        # large documents first: the one left unsettled is then small
        rows = rows.sort_values(["size", "doc_id", "digest", "number"], ascending=[False, True, True, True], na_position="last")
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{key[0]}|{key[1]}".encode()))
        p = settle(rows["p"].to_numpy(), rows["size"].to_numpy(), rng, last)
        done = (p == 0.0) | (p == 1.0)
        return rows.assign(whole=rows["whole"] + np.where(done, p, 0).astype("int64"), p=np.where(done, 0.0, p))[["doc_id", "source", "size", "digest", "number", "whole", "p", "bucket"]]

    return run


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, group_rows: int = GROUP_ROWS, **shares) -> DataFrame:
    """doc_id, source, size, digest, source_size, target and copies (how often the mix takes the document)."""
    equal = docs.select(*_keys(id_col, text_col, source_col)).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    # equal rows are numbered in lots, so that no array has more than CHUNK numbers
    lots = equal.select(*_KEY, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("lot")).withColumn("lot", F.col("lot") * CHUNK)
    sized = written(lots.select(*_KEY, F.explode(F.sequence("lot", F.least(F.col("lot") + CHUNK, F.col("n")) - 1)).alias("number")), "sizes")
    targets = source_targets(sized.select("source", "size"), **shares)
    n_docs = targets.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, math.ceil(n_docs / group_rows))

    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        "doc_id", sized["source"], "size", "digest", "number",
        F.floor(copies).alias("whole"),
        F.when(F.col("size") > 0, copies - F.floor(copies)).otherwise(F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.col("digest"), F.col("number"), F.lit(seed)), F.lit(buckets)).alias("bucket"),
    )
    settled, level, nodes = [rows.filter("p = 0")], 0, buckets
    open_rows = rows.filter("p > 0")
    while True:
        last = nodes == 1
        node = F.floor(F.col("bucket") / FAN**level).alias("node")
        now = written(open_rows.groupBy("source", node).applyInPandas(_settle_group(seed, level, last), _ROWS), f"settled{level}")
        settled.append(now.filter("p = 0"))
        if last:
            break
        open_rows, level = now.filter("p > 0"), level + 1
        nodes = math.ceil(nodes / FAN)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = out.withColumnRenamed("whole", "copies")
    return out.join(targets, out["source"].eqNullSafe(targets["source"])).select("doc_id", out["source"], "size", "digest", "source_size", "target", "copies")


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents, each as often as the mix takes it.

    Rows of one id, source and text are taken equally often or once more; the ones more are dealt over them."""
    # a row is one value of its own here, so that no column of it can have the name of another one
    whole = F.struct(*("`" + c.replace("`", "``") + "`" for c in docs.columns))
    keys = dict(zip(_KEY, _keys(id_col, text_col, source_col), strict=True))
    keyed = docs.select(whole.alias("row"), *(c.alias("k_" + k) for k, c in keys.items()))
    per = mixed.groupBy(*(F.col(k).alias("m_" + k) for k in _KEY)).agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("more", F.col("all") - F.col("n") * F.col("least")).drop("all", "n").filter("least > 0 or more > 0")
    same = functools.reduce(operator.and_, (F.col("k_" + k).eqNullSafe(F.col("m_" + k)) for k in _KEY))
    found = keyed.join(per, same)
    each = found.filter("least > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("least").cast("int")))).select("row")
    # equal rows are counted before anything is dealt to them, so that no task holds all rows of a key
    own = ["k_" + k for k in _KEY]
    kinds = found.filter("more > 0").groupBy("row", *own, "more").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*own).orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, -1)
    dealt = kinds.withColumn("take", F.least(F.col("m"), F.col("more") - F.coalesce(F.sum("m").over(before), F.lit(0)))).filter("take > 0")
    lots = dealt.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - 1) / CHUNK)))).withColumn("here", F.least(F.lit(CHUNK).cast("long"), F.col("take") - F.col("lot") * CHUNK))
    more = lots.repartition(*own, "lot").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("here")))).select("row")
    return each.unionByName(more).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
