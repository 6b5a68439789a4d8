"""Corpus operators against the libraries, brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from gridloom.llm import additive_quantisation as aq
from gridloom.llm import bpe, exact_topk, html_text, jaccard, language, mixing, queries, sharding, token_counts, toxicity
from gridloom.llm.common import load_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", "   ", "Hello, world!", "It's 3.14 o'clock — naïve café", "<|endoftext|> and <|startoftext|>x", "日本語のテキスト 🎉🎉", "a" * 3000,
    "é combining ​ zero", "line\r\nbreak\tand\x0btab\x85next space", "ÀÉÎ ß İ ǅ", "word " * 4000, "x\x00y\x1cz", "'s 're ''ll 1234567", "Hello, world!",
]


def docs_of(spark, texts, **more):
    rows = [(i, t, None if i % 3 else "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # extra columns whose names clash with those of results
    return df.withColumn("score", F.lit(7)).withColumn("n_tokens", F.lit("x")).withColumn("size", F.lit(1))


def test_token_counts(spark):
    tok = load_tokenizer("word_bpe_49k.json")
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    for head in (0, 10, token_counts.HEAD_SIZE):
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(docs_of(spark, TEXTS), "word_bpe_49k.json", head_size=head).collect()}
        assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(TEXTS, want, strict=True))}
    assert token_counts.token_counts(docs_of(spark, TEXTS).limit(0), "word_bpe_49k.json").count() == 0


def test_bpe_round_trip_and_tree(spark):
    tok = load_tokenizer("byte_bpe_50k.json")
    rng = np.random.default_rng(5)
    long = ["".join(rng.choice(list("abc é日 \n'1.,"), 5000)), "ab" * 4000, "日本" * 2000, "word and more " * 900, "x<|endoftext|>y" * 300, " " * 5000]
    texts = TEXTS + long
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(docs_of(spark, texts), "byte_bpe_50k.json", leaf_chars=256).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, i
        assert got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)
    r = bpe.encode_and_decode(docs_of(spark, ["ab"]), "byte_bpe_50k.json", output="digests").first()
    ids = tok.encode("ab", add_special_tokens=False).ids
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and low[i] != low[j] and 100 * len(a & b) >= percent * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return [(len(s), x) for s, x in zip(sets, low, strict=True)]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, k, percent):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "One two", "one TWO", "one", "a b c", "A b  c"]
    for _ in range(12):
        base = list(rng.choice(words, rng.integers(30, 160)))
        for _ in range(rng.integers(1, 9)):
            t = list(base)
            for _ in range(rng.integers(0, 5)):
                t[rng.integers(len(t))] = str(rng.choice(words))
            texts.append(" ".join(t))
    common = list(rng.choice(words, 60))
    texts += [" ".join([*common, *rng.choice(words, 8)]) for _ in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs_of(spark, texts), k, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, k, percent)


def test_jaccard_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (5, "other words here now"), (3, text + " end"), (None, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard.similar_components(df).collect())
    assert got == Counter({(None, 38, None): 1, (5, 38, 3): 2, (5, 2, 5): 1, (3, 39, 3): 1, (None, 0, None): 1})


def vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] + [1.0] * 15), (603, [None] + [1.0] * 15), (604, []), (605, rows[0][1]), (606, rows[0][1]), (607, [float("inf")] * 16), (None, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {i: np.array(v) for i, v in rows if i is not None and (i < 600 or i in (605, 606))}


def test_exact_top_k(spark):
    df, usable = vectors(spark)
    v = {i: np.floor(256 * x).astype(int) for i, x in usable.items()} | {601: np.zeros(16, int)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    for q in (i for i in v if i % 50 == 0):
        want = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_nearest_recall_and_scores(spark):
    df, v = vectors(spark)
    got = {}
    for r in aq.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = total = 0
    for q in (i for i in v if i % 20 == 0):
        want = sorted((-float(v[q] @ x), i) for i, x in v.items() if i != q)[:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s - float(v[q] @ v[i])) < 1e-9 for i, s in got[q].values())
        hit, total = hit + len({i for i, _ in got[q].values()} & {i for _, i in want}), total + 20
    assert hit / total >= 0.9


def test_mixing(spark):
    rng = np.random.default_rng(8)
    texts = ["w " * int(n) for n in rng.integers(0, 60, 900)] + [None, "one", "one"]
    df = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))))
    runs = [{r["doc_id"]: r for r in mixing.mix_sources(df.repartition(p), group_rows=50).collect()} for p in (2, 5)]
    assert {k: v["copies"] for k, v in runs[0].items()} == {k: v["copies"] for k, v in runs[1].items()}
    taken, target, top = Counter(), {}, Counter()
    for i, r in runs[0].items():
        assert r["size"] == len((texts[i] or "").split()) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = (r["target"], r["source_size"])
        top[r["source"]] = max(top[r["source"]], r["size"])
    assert abs(sum(t for t, _ in target.values()) - 1.5 * sum(s for _, s in target.values())) < 1e-3 or all(t <= 2 * s for t, s in target.values())
    for s, (t, n) in target.items():
        assert t <= 2 * n + 1e-9 and abs(taken[s] - t) <= top[s]
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
      <article><h1>Title &amp; more</h1><p>First   paragraph\nof text.</p><script>var x="<p>no</p>";</script><p>Second&nbsp;one.</p></article>
      <div id="comments"><p>Reader says something long enough to be kept if it were text.</p></div><footer>Imprint</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First paragraph of text. Second one."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<p>un<b>closed") == "unclosed"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>Hi</p>", 2), (1, "u", None, 3)], "page_id long, url string, html string, text int")
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == Counter({(1, "u", "", 0): 2, (None, None, "Hi", 2): 1})


def test_language_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_language"](spark, "/root/testdata/sf0.01").collect()}
    truth = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and text is not null").collect()]
    held = [r for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and rows[r["doc_id"]]["lang_pred"] != "und"]
    assert all(rows[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    none = language.predict(docs_of(spark, TEXTS), None).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(TEXTS)


def test_toxicity_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in labels if i in rows and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] for i in held)
    right = np.mean([rows[i]["predicted"] == labels[i] for i in held])
    assert right >= 0.9
    empty = toxicity.score(docs_of(spark, TEXTS), toxicity.ToxicityModel({}, np.zeros(0), -1.0)).collect()
    assert len(empty) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in empty)


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, shard_rows=20)
    df = docs_of(spark, TEXTS * 20).repartition(4)
    for _ in range(3):
        store.append(df)
    before = len(store.manifest()["files"])
    now = store.compact()
    assert len(now["files"]) < before and store.read().count() == 3 * df.count()
    assert store.read(1).count() == df.count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(1), [], df.schema.json())
    store.vacuum()
    assert store.read().exceptAll(df.union(df).union(df)).count() == 0
    assert sharding.ShardStore(spark, f"file://{tmp_path}/t").read().count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(str, got[cols].itertuples(index=False, name=None))) == Counter(map(str, want[cols].itertuples(index=False, name=None)))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_copies", "mixing", "encoding"]
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    want = {i for (i, _), (n, low) in zip(texts, brute_components([t for _, t in texts], 5, 80), strict=True) if not n or texts[low][0] == i}
    assert {r["doc_id"] for r in kept.collect()} == want
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids_sha256" in out.columns
    nothing = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_pipeline_repeated_and_null_rows(spark, sf):
    schema = T.StructType.fromJson(spark.read.parquet(f"{sf}/documents.parquet").schema.jsonValue())
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (2, None, None, None, None), (3, "", "en", "a", 0)], schema)
    kept = corpus_pipeline.drop_near_copies(spark, df, sf).collect()
    assert sum(r["text"] == text for r in kept) == 1 and len(kept) == 3
