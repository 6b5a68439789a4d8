"""Operator 1: token counts from counts per distinct pre-token.

Two passes over the texts. The first finds the distinct pre-tokens and how often each occurs;
each distinct pre-token is then cut into pieces once, and only the number of pieces is kept.
The second pass takes per-document pre-token frequencies, joins them to those numbers and sums.
Ids are never materialised.

The join has two parts, both exact. Pre-tokens that are frequent over the corpus, at most
``head_size`` of at most ``HEAD_BYTES`` bytes each, are looked up in a broadcast table of that
proven size inside the second pass. All others, which are rare by construction and so make no
hot key, are joined by shuffle. Without the first part the most frequent word would be one key
with a row from nearly every document.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give one result
row each; a null id is kept; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import load_tokenizer, row_ids, small_batches, written

HEAD_SIZE = 400_000
HEAD_BYTES = 64
#: Text handled at once inside a worker, in characters.
CHUNK_CHARS = 4_000_000
#: Distinct pre-tokens a worker gathers before it hands them on.
FLUSH = 400_000

#: Characters on which every Unicode version agrees and that NFC leaves alone, less odd controls.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ]")


@functools.lru_cache(maxsize=1)
def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokens:
    """Pre-tokens of texts, in the byte-level alphabet, as the tokenizer makes them."""

    def __init__(self, tokenizer: str):
        import json

        import regex

        self.tok = load_tokenizer(tokenizer)
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        #: The fast path holds for this family alone: lower case, white space dropped, one split pattern.
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and all(not t["normalized"] for t in spec["added_tokens"])
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"]) if self.fast else None

    def plain(self, text: str) -> bool:
        return self.fast and not _PLAIN.search(text) and not any(s in text for s in self.special)

    def of_word(self, word: str) -> list[str]:
        """A lower-case word without white space: no pre-token reaches over white space."""
        if word.isascii():
            return [word] if word.isalpha() else self.pattern.findall(word)
        chars = _byte_chars()
        return [w.encode().decode("latin-1").translate(chars) for w in self.pattern.findall(word)]

    def of_text(self, text: str) -> tuple[list[str], int]:
        """By the library's own parts: pre-tokens, and the number of special tokens."""
        parts, specials = [text], 0
        if self.cut:
            specials = len(self.cut.findall(text))
            parts = self.cut.split(text) if specials else parts
        out: list[str] = []
        for part in parts:
            if part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                out += [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]
        return out, specials


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_CHARS:
                yield ids[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield ids[start:], texts[start:]


def _frequencies(pre: PreTokens, texts: list[str]):
    """(distinct pre-tokens, document number, pre-token number, frequency) and special tokens of each text."""
    words: list[str] = []
    lens = np.zeros(len(texts), dtype=np.int64)
    specials = np.zeros(len(texts), dtype=np.int64)
    odd: list[tuple[int, Counter]] = []
    for i, t in enumerate(texts):
        if pre.plain(t):
            w = t.lower().split()
            lens[i] = len(w)
            words += w
        else:
            tokens, specials[i] = pre.of_text(t)
            odd.append((i, Counter(tokens)))
    codes, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), [])
    del words
    # documents x words with their counts
    key = np.repeat(np.arange(len(texts), dtype=np.int64), lens) * max(1, len(distinct)) + codes
    key, n = np.unique(key, return_counts=True)
    doc, word = np.divmod(key, max(1, len(distinct)))
    # words to pre-tokens
    number: dict[str, int] = {}
    flat, sizes = [], np.zeros(len(distinct), dtype=np.int64)
    for k, w in enumerate(distinct):
        found = pre.of_word(w)
        sizes[k] = len(found)
        for p in found:
            flat.append(number.setdefault(p, len(number)))
    start = np.cumsum(sizes) - sizes
    reps = sizes[word]
    at = np.repeat(start[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    doc, n, tok = np.repeat(doc, reps), np.repeat(n, reps), np.array(flat, dtype=np.int64)[at] if len(flat) else at
    for i, c in odd:
        tok = np.concatenate([tok, [number.setdefault(p, len(number)) for p in c]]).astype(np.int64)
        n = np.concatenate([n, list(c.values())]).astype(np.int64)
        doc = np.concatenate([doc, np.full(len(c), i, dtype=np.int64)])
    return list(number), doc, tok, n, specials


def _vocabulary(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, seen = PreTokens(tokenizer), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])

        for _, texts in _chunks(batches):
            names, _, tok, n, _ = _frequencies(pre, texts)
            total = np.bincount(tok, weights=n, minlength=len(names)).astype(np.int64)
            seen.update(dict(zip(names, total.tolist(), strict=True)))
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return run


def _pieces(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_tokenizer(tokenizer).model
        for batch in batches:
            pieces = [len(model.tokenize(p)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int64())], ["pretoken", "n", "n_pieces"])

    return run


def _document_rows(tokenizer: str, head):
    """A row for each document with what the head gives, and one for each rare pre-token in it."""
    names = ["row_id", "doc_id", "n_bytes", "n_known", "pretoken", "freq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known, number = PreTokens(tokenizer), head.value, row_ids()
        for ids, texts in _chunks(batches):
            rows = np.array([next(number) for _ in ids], dtype=np.int64)
            words, doc, tok, n, specials = _frequencies(pre, texts)
            pieces = np.array([known.get(w, -1) for w in words], dtype=np.int64)
            rare = pieces[tok] < 0 if len(tok) else np.zeros(0, dtype=bool)
            base = specials + np.bincount(doc[~rare], weights=(pieces[tok] * n)[~rare], minlength=len(ids)).astype(np.int64)
            none = pa.nulls(len(ids), pa.int64())
            # the key of a document's own row meets nothing in the join and spreads evenly
            own = pa.array([f"\x00{r}" for r in rows.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(base), own, none], names)
            if rare.any():
                # a pre-token may come from the fast and the library's path: one row for each document and pre-token
                key, at = np.unique(doc[rare] * len(words) + tok[rare], return_inverse=True)
                freq = np.bincount(at, weights=n[rare]).astype(np.int64)
                d, t = np.divmod(key, len(words))
                text = pa.DictionaryArray.from_arrays(pa.array(t, pa.int32()), pa.array(words, pa.string())).dictionary_decode()
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[d]), none, none, none, text, pa.array(freq)], names)

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD_SIZE) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document, as the tokenizer file gives them without added tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_vocabulary(tokenizer), "pretoken string, n long")
    vocabulary = written(found.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(_pieces(tokenizer), "pretoken string, n long, n_pieces long"), "pretokens")

    # the lowest frequency of which the head holds all: from a histogram with a few hundred rows
    short = F.octet_length("pretoken") <= HEAD_BYTES
    level = F.floor(F.log2("n") * 8)
    steps = vocabulary.filter(short).groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, room = None, head_size
    for step in steps:
        room -= step["count"]
        if room < 0:
            break
        least = step["level"]
    in_head = short & (level >= F.lit(least)) if least is not None else F.lit(False)
    head = {r["pretoken"]: r["n_pieces"] for r in vocabulary.filter(in_head).select("pretoken", "n_pieces").toLocalIterator()} if least is not None else {}
    shared = spark.sparkContext.broadcast(head)

    rows = texts.mapInArrow(_document_rows(tokenizer, shared), "row_id long, doc_id long, n_bytes long, n_known long, pretoken string, freq long")
    rest = vocabulary.filter(~in_head).select("pretoken", "n_pieces")
    summed = rows.join(rest, "pretoken", "left").groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce(F.col("n_known"), F.col("freq") * F.col("n_pieces"))).alias("n_tokens"),
    )
    return summed.select("doc_id", "n_bytes", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import table

    counted = token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
