"""The filter audit against a run of every order over every document."""

import itertools
import re

import duckdb
from pyspark.sql import functions as F

from gridloom.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    None, "", "few words", LONG, LONG, LONG.upper(), LONG + " #", "same " * 60, "same " * 60, LONG + "\x0bX\x1cY", "Á" * 30 + " b", LONG, " \t\n", "A B", LONG.title(),
]


def failing(rows):
    """Letters that each document fails, in the order of rows."""
    texts = [(i, t or "") for i, t, _ in rows]
    out = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = i is not None and any(o == t and j is not None and j < i for j, o in texts)
        out.append({x for x, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), copy), strict=True) if f})
    return out


def brute(rows, good, toxic):
    fails = failing(rows)
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                out[part, order, step] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        total = {x: sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == x) for x in "ABCDE"}
        for (p, o, s), v in out.items():
            if p == part:
                v.append(total[o[s - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    docs = docs.withColumn("part", F.lit(1)).withColumn("A", F.lit("x")).withColumn("n", F.lit(2)).withColumn("quality", F.lit(1))
    got = filter_audit.filter_interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}


def test_every_order(spark):
    rows = [(i, t, (None, "", "a", "b")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [(None, LONG, "a"), (None, LONG, "a"), (None, None, None), (3, LONG, "a"), (3, LONG, "b"), (3, LONG, "a"), (-1, "few words", "c")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(len(TEXTS))] + [(4, 1, 1), (None, 1, 1), (5, None, None), (999, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    got, want = audited(spark, rows, labels), brute(rows, good, toxic)
    assert got == want and len(got) == 4 * 600


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, LONG, "a")], [])["a", "ABCDE", 5] == [1, 0, 0, 0, 0, 0, 0]


def test_flags_of_any_number(spark):
    """Three filters of one's own: steps are differences, and all orders together remove what each filter is worth."""
    rows = spark.createDataFrame([("p", bool(i & 1), bool(i & 2), bool(i & 4), 1 + i, i) for i in range(8)], "part string, x boolean, y boolean, z boolean, n long, marked long")
    got = filter_audit.audit(rows, "part", {"X": "x", "Y": "y", "Z": "z"}, {"lost": "marked"}, "n").collect()
    assert len(got) == 6 * 3
    by = {(r["filter_order"], r["step"]): r for r in got}
    for order in map("".join, itertools.permutations("XYZ")):
        assert [by[order, s]["kept"] for s in (1, 2, 3)] == [sum(1 + i for i in range(8) if not any(i & (1 << "XYZ".index(c)) for c in order[:s])) for s in (1, 2, 3)]
    assert sum({r["filter_order"][r["step"] - 1]: r["shapley"] for r in got}.values()) == 6 * sum(1 + i for i in range(1, 8))


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = filter_audit.query(spark, sf).toPandas(), con.execute(filter_audit.SQL).fetchdf()
    names, keys = sorted(want.columns), ["part", "filter_order", "step"]
    assert sorted(got.columns) == names
    assert (got.sort_values(keys)[names].to_numpy() == want.sort_values(keys)[names].to_numpy()).all()
