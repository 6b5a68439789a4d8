"""Operator 5: byte-level BPE encoding and decoding, with tree concatenation for long texts.

A text of up to ``leaf_chars`` characters is encoded as it is. A longer one is halved again and
again until its parts are that short; the parts are rows of their own, are dealt to all executors
and encoded in parallel. Halves are then joined pairwise up the tree: the text of a window of ids
around the join is encoded again, and the window grows until its first ids are those of the left
side and its last ids those of the right side. A sequence of BPE tokens in which each neighbouring
pair is the encoding of its own text is the encoding of the whole, so agreement on both sides makes
the join exact. A window reaches at least over the longest special token, which a cut may part.

Ids are those of the tokenizers library. The byte-rank library gives the same ids for texts of
characters on which all Unicode tables agree and is about three times as fast; it encodes those,
and the tokenizers library the others and every text that names a special token.

Defined results: a null text counts as empty (no ids, empty text); repeated rows give one result
row each; a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import load_tokenizer, row_ids, small_batches

LEAF_CHARS = 32_768
#: Ids on each side of a join in the first window, and ids that must agree.
WINDOW, AGREE = 8, 2

#: Characters on which every Unicode version agrees, less odd controls.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ]")

#: The split pattern of this tokenizer family (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encoding and decoding by one vocabulary file, inside one worker."""

    def __init__(self, name: str):
        self.tok = load_tokenizer(name)
        spec = json.loads(self.tok.to_str())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pre = spec["pre_tokenizer"] or {}
        self.ranks = None
        model = spec["model"]
        plain_model = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and plain_model and self._by_rank(model):
            self.ranks = self._rank_encoding(model["vocab"])

    @staticmethod
    def _by_rank(model: dict) -> bool:
        """Whether ids of merged tokens follow the order of the merges, as the byte-rank library takes them to."""
        made = [model["vocab"]["".join(m) if not isinstance(m, str) else m.replace(" ", "")] for m in model["merges"]]
        return all(a < b for a, b in zip(made, made[1:], strict=False))

    def _rank_encoding(self, vocab: dict[str, int]):
        """The same vocabulary for the byte-rank library: ids follow the order of the merges."""
        import tiktoken

        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocab.items() if word not in self.special}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return self.ranks is not None and not _PLAIN.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self.plain(t):
                out[i] = self.ranks.encode_ordinary(t)
            else:
                slow.append(i)
        if slow:
            for i, e in zip(slow, self.tok.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(self._bytes(i) for i in ids)

    @functools.lru_cache(maxsize=1 << 17)  # noqa: B019 one codec lives as long as its worker
    def _bytes(self, i: int) -> bytes:
        token = self.tok.id_to_token(i)
        if token in self.special:
            return token.encode()
        return bytes(_char_bytes()[c] for c in token)

    # --- tree concatenation

    def halves(self, text: str, leaf_chars: int) -> list[str]:
        """Parts in order, from cuts in the middle."""
        if len(text) <= leaf_chars:
            return [text]
        mid = len(text) // 2
        return self.halves(text[:mid], leaf_chars) + self.halves(text[mid:], leaf_chars)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenated texts from the ids of both."""
        if not left or not right:
            return left + right
        w = max(WINDOW, max(map(len, self.special), default=0) + AGREE)
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            i, j = self._whole(left, i), self._whole_end(right, j)
            window = self.encode([self.bytes_of(left[i:] + right[:j]).decode()])[0]
            first, last = left[i : i + AGREE], right[max(0, j - AGREE) : j]
            if (i == 0 or window[: len(first)] == first) and (j == len(right) or window[-len(last) :] == last):
                return left[:i] + window + right[j:]
            w *= 2

    def _whole(self, ids: list[int], i: int) -> int:
        """The next place at or before i at which a character begins."""
        while i > 0 and self._bytes(ids[i])[0] & 0xC0 == 0x80:
            i -= 1
        return i

    def _whole_end(self, ids: list[int], j: int) -> int:
        while j < len(ids) and self._bytes(ids[j])[0] & 0xC0 == 0x80:
            j += 1
        return j

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours level by level."""
        while len(parts) > 1:
            up = [self.join(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = up + parts[len(up) * 2 :]
        return parts[0] if parts else []


@functools.lru_cache(maxsize=1)
def _char_bytes() -> dict[str, int]:
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}


@functools.lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


@functools.lru_cache(maxsize=2)
def _decimals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


SCHEMAS = {
    "ids": "doc_id long, ids array<int>, decoded string",
    "digests": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
}


def _results(c: Codec, doc_ids: list, ids: list[list[int]], output: str) -> pa.RecordBatch:
    """Decodes the ids, and gives either both whole or their digests."""
    texts = c.decode(ids)
    own = pa.array(doc_ids, pa.int64())
    if output == "ids":
        return pa.RecordBatch.from_arrays([own, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
    dec = _decimals(c.tok.get_vocab_size(with_added_tokens=True))
    shas = [hashlib.sha256(",".join([dec[i] for i in x]).encode()).hexdigest() for x in ids]
    back = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    return pa.RecordBatch.from_arrays([own, pa.array([len(x) for x in ids], pa.int64()), pa.array(shas), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _short(name: str, output: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 100):
                yield _results(c, ids[at : at + 100], c.encode([t or "" for t in texts[at : at + 100]]), output)

    return run


def _parts(name: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, number = codec(name), row_ids()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, row = c.halves(text, leaf_chars), next(number)
                k = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * k, pa.int64()), pa.array([doc] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.string())], ["row_id", "doc_id", "part", "text"])

    return run


def _encode_parts(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                ids = [np.asarray(x, dtype=np.int32).tobytes() for x in c.encode(some.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(ids, pa.binary())], ["row_id", "doc_id", "part", "ids"])

    return run


def _join_parts(name: str, output: str):
    def run(key, part):
        c = codec(name)
        part = part.sort_values("part")
        ids = c.tree([np.frombuffer(b, dtype=np.int32).tolist() for b in part["ids"]])
        doc = part["doc_id"].iloc[0]
        return _results(c, [None if pd.isna(doc) else int(doc)], [ids], output).to_pandas()

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, output: str = "ids", id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Ids of every whole text and the text decoded from them (``output="ids"``), or digests of both."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.length("text") > leaf_chars
    short = texts.filter(~F.coalesce(long, F.lit(False))).mapInArrow(_short(tokenizer, output), SCHEMAS[output])
    parts = texts.filter(long).mapInArrow(_parts(tokenizer, leaf_chars), "row_id long, doc_id long, part int, text string")
    encoded = parts.repartition("row_id", "part").mapInArrow(_encode_parts(tokenizer), "row_id long, doc_id long, part int, ids binary")
    joined = encoded.groupBy("row_id").applyInPandas(_join_parts(tokenizer, output), SCHEMAS[output])
    return short.unionByName(joined)


def query(spark, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import table

    return encode_and_decode(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", output="digests")
