"""Operator 13: how filters interact, by a subset-zeta transform of mask counts.

Every document gets a mask: a bit for each filter that it fails. Documents are counted once per part
and mask; sums over the subsets of each set of bits (the zeta transform, one pass a filter) then give
how many survive each set of filters, and the step of an order is the difference between two
neighbouring sets. Losses among marked documents come from the same transform of their own counts.

``audit`` takes any rows with flags; ``document_flags`` makes those of the five document filters.
Filter E (identical to the text of any smaller id) looks at the whole table: texts meet by their
SHA-256, rows are counted before each exchange, the least id of every text is found by a partial
aggregation and meets the rows on text and id together, so that a large group of copies is spread.

Defined results: null and empty texts are the same text, without words; parts that are null or empty
are one part, the empty string; rows without an id are identical to no smaller id and make no other
row a copy; rows that repeat an id are all counted, and none of them is a copy of the others; several
labels of a document count if one of them is 1; labels of unknown documents and null labels count
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, discard, table, written

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = r"[#$%&*|]"


def _sums_over_subsets(wide: DataFrame, names: Sequence[str], bits: int) -> DataFrame:
    """Element t of every named array becomes the sum over all masks within t, one pass for each bit."""

    def one_pass(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, t: x + F.when(t.bitwiseAND(F.lit(bit)) != 0, F.get(c, t - bit)).otherwise(0))

    for i in range(bits):
        wide = wide.withColumns({c: one_pass(c, 1 << i) for c in names})
    return wide


def survivors(rows: DataFrame, part: str, mask: str, bits: int, counts: Sequence[str]) -> DataFrame:
    """A row for each part: for every column of counts how many fall on each mask (name) and how many survive
    each set of filters (name_left), as arrays indexed by bits."""
    per_mask = rows.groupBy(part, mask).agg(*(F.sum(c).alias(c) for c in counts))
    wide = per_mask.groupBy(part).agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col(mask) == m, F.col(c))), F.lit(0)) for m in range(1 << bits))).alias(c) for c in counts))
    sums = _sums_over_subsets(wide.select("*", *(F.col(c).alias(f"{c}_left") for c in counts)), [f"{c}_left" for c in counts], bits)
    # what survives a set fails within its complement only, and the complement of t is the t-th from the end
    return sums.select(part, *counts, *(F.reverse(f"{c}_left").alias(f"{c}_left") for c in counts))


def audit(rows: DataFrame, part: str, flags: dict[str, str], marks: dict[str, str], n: str) -> DataFrame:
    """One row for each part, order of the filters and step.

    rows: a row stands for ``n`` documents; flags: letter of a filter to the boolean column that is true
    where it fails; marks: name of a loss to the column that counts marked documents of the row."""
    letters, bits = list(flags), len(flags)
    mask = sum((F.when(F.col(c), 1 << i).otherwise(0) for i, c in enumerate(flags.values())), F.lit(0))
    own = rows.select(F.col(part).alias("part"), mask.alias("mask"), F.col(n).alias("n"), *(F.col(c).alias(f"m{i}") for i, c in enumerate(marks.values())))
    names = ["n", *(f"m{i}" for i in range(len(marks)))]
    left = survivors(own, "part", "mask", bits, names)

    def lost(values: Column, before: Column, bit: Column) -> Column:
        return F.get(values, before) - F.get(values, before + bit)

    # in how many orders exactly a given set of filters comes before a given one
    orders = [math.factorial(k) * math.factorial(bits - 1 - k) for k in range(bits)]

    def over_all_orders(bit: int) -> Column:
        return sum((F.lit(orders[s.bit_count()]) * lost(F.col("n_left"), F.lit(s), F.lit(bit)) for s in range(1 << bits) if not s & bit), F.lit(0))

    left = left.withColumn("shapley", F.array(*(over_all_orders(1 << i) for i in range(bits))))
    steps = left.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in itertools.permutations(letters)]))).withColumn("step", F.explode(F.lit(list(range(1, bits + 1)))))
    head, letter = F.col("filter_order").substr(F.lit(1), F.col("step") - 1), F.col("filter_order").substr(F.col("step"), F.lit(1))
    at = F.instr(F.lit("".join(letters)), letter) - 1
    before = sum((F.when(F.contains(head, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    placed = steps.withColumns({"at": at, "before": before}).withColumn("bit", F.expr("shiftleft(1, at)"))
    removed = lost(F.col("n_left"), F.col("before"), F.col("bit"))
    return placed.select(
        "part", "filter_order", "step", F.get("n_left", F.col("before") + F.col("bit")).alias("kept"), removed.alias("removed"),
        (lost(F.col("n_left"), F.lit(0), F.col("bit")) - removed).alias("redundant"), F.get("n", F.col("bit")).alias("unique_fails"),
        *(lost(F.col(f"m{i}_left"), F.col("before"), F.col("bit")).alias(name) for i, name in enumerate(marks)), F.get("shapley", F.col("at")).alias("shapley"),
    )


def text_flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, A to D (true: fails) and n, the number of such rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = own.withColumn("words", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    flagged = words.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (F.size("words") < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < LEAST_DISTINCT * F.size("words").cast("long")).alias("B"),
        (100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )
    return flagged.groupBy("doc_id", "part", "digest", "A", "B", "C", "D").agg(F.count(F.lit(1)).alias("n"))


def document_flags(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E (true: fails), n documents, and how many of them are good and toxic.

    counted: rows of :func:`text_flags`, read twice. Rows without an id meet neither labels nor copies."""
    numbered = counted.filter("doc_id is not null")
    first = numbered.groupBy("digest").agg(F.min("doc_id").alias("first")).select(F.col("digest").alias("own"), "first")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("q"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("t")
    )
    met = numbered.join(known, F.col("doc_id") == F.col("labelled"), "left").join(first, (F.col("digest") == F.col("own")) & (F.col("doc_id") == F.col("first")), "left")
    columns = [F.col("part"), *map(F.col, LETTERS[:4])]
    with_id = met.select(*columns, F.col("first").isNull().alias("E"), "n", (F.col("n") * F.coalesce("q", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    return with_id.unionByName(counted.filter("doc_id is null").select(*columns, F.lit(False).alias("E"), "n", zero.alias("good"), zero.alias("toxic")))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters, in every order. Texts are read once; what is left of them,
    and then the counts by mask, are work tables."""
    counted = written(text_flags(docs), "flags")
    flags = document_flags(counted, labels).groupBy("part", *LETTERS).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    masks = written(flags, "masks")
    discard(counted)
    return audit(masks, "part", {x: x for x in LETTERS}, {"good_lost": "good", "toxic_lost": "toxic"}, "n")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM own LEFT JOIN marks USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bit,
         (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE contains(filter_order[1:step - 1], l.letter))::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) JOIN letters ON letter = filter_order[step]
), per_mask AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL
), counted AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM per_mask, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
