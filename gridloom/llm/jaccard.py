"""Operator 4: n-gram Jaccard join by set-relation skipping.

A document is the set of its distinct word shingles; two link when their Jaccard similarity reaches
``percent``. The result gives each document the size of its set and its component: the smallest id
that links lead to. No link between different texts is lost, and none is taken on trust: links are
found by exact overlaps of the words themselves, or follow from such overlaps by set algebra.

1. Equal sets are one node, so a group of copies costs one row.
2. Shingles are ordered from rare to frequent by a fixed-size table of counts over the whole corpus
   (ties by hash). Two sets that link share at least ``LEAST`` shingles (below 67 percent as many as
   :func:`least_shared` says) among the first ``n - ceil(t * n) + LEAST`` of each; those are posted, and
   a posted shingle's sets are its list.
3. Each set is compared exactly with leaders: the smallest set of most of its lists, the smallest
   and the largest one of its longest lists, and then its nearest leader's own leader; leaders with
   which it shares fewer than ``LEAST`` lists, or whose size is too far off, are left out. The
   number of comparisons is at most four times the number of sets, however long the lists are. What
   a close set lacks of its leader L and has beyond it is kept.
4. Answer-level skipping: overlaps of any two sets of one leader follow from these differences,
   ``|A & B| = |L| - |(L - A) | (L - B)| + |(A - L) & (B - L)|``, without their other elements.
   Sets of a leader are dealt in pairs of bounded chunks; in each pair of chunks the overlaps are
   two matrix products, and of the links a spanning forest is kept.
5. Index-level skipping: lists whose sets are not all connected yet are walked by blocks of equal
   size, position, component and leader; pairs of blocks whose sizes or positions leave too little
   room, or whose answers are known from 4, are skipped as a whole. Long lists are dealt to many
   tasks as pairs of bounded chunks. Pairs that are left, and appear in at least ``LEAST`` lists,
   are compared exactly.

Shingles are identified by 64-bit hashes in the steps that find candidates, set sizes and
differences; overlaps of compared pairs are counted on the words.

Defined results: a null text or one without words is the empty set: size 0, linked with nothing; a
text of fewer words than a shingle has is one shingle; repeated rows give one result row each and
are linked; a row without an id has no component; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, row_ids, small_batches, table, written
from gridloom.llm.components import components

N_WORDS, PERCENT = 3, 90
LEAST = 3
#: Size of the table of counts (2 ** COUNT_BITS), and slices in which it is summed.
COUNT_BITS, SLICES = 18, 64
#: Tasks whose tables are combined at once.
TASKS = 512
#: Rows of a list, and sets of a leader, of which two lots meet in one task; comparisons with a leader in one group.
CHUNK, LEADER_CHUNK, GROUP = 4096, 1536, 64
#: Similarity in percent from which a set's differences with its leader are kept.
CLOSE = 50
#: Rows from which a list counts as long: a set in one always gets a leader.
LONG = 16
#: Columns of the matrices that are multiplied at once, and rows of links worked out at once.
COLUMNS, SOME_ROWS = 1024, 256
#: Bits of the table that tells which texts a comparison needs.
WANTED_BITS = 23
CACHE_WORDS = 1 << 16
#: Pairs of blocks' members that are formed at once.
PAIRS_AT_ONCE = 1 << 17

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case: bytes split at ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes, k: int) -> np.ndarray:
    """A hash for each place at which a shingle begins."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([hashes[w] for w in words], dtype=np.uint64)
    k = min(k, len(own))
    out = np.full(len(own) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ own[j : len(own) - k + 1 + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[j:] for j in range(min(k, len(words)))), strict=False)) if words else set()


def least_overlap(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b that link: 100 I >= percent (a + b - I)."""
    return -((-percent * (a + b)) // (100 + percent))


def smallest_different(percent: int) -> int:
    """Sets smaller than this link with equal sets only; different sets that link share as many at least."""
    return max(1, -(-100 // (100 - percent)) - 1) if percent < 100 else 1 << 62


def least_shared(percent: int) -> int:
    """Posted shingles that any two different sets that link share: fewer than ``LEAST`` below 67 percent."""
    return min(LEAST, smallest_different(percent))


def _sets(k: int):
    """Size and digest of every document's set, and at the end the counts of all shingles."""
    import xxhash

    names = ["row_id", "doc_id", "n", "digest", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), row_ids()
        counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            sizes, digests, places = [], [], [np.zeros(0, np.int64)]
            for text in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(words_of(text), hashes, k))
                places.append((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64))
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            counts += np.bincount(np.concatenate(places), minlength=len(counts))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([next(number) for _ in range(m)], pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        none, own = pa.nulls(SLICES, pa.int64()), pa.array([next(number) >> 33] * SLICES, pa.int64())
        parts = [c.tobytes() for c in counts.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([own, none, none, pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def _summed(key, part):
    return part.iloc[:1].assign(value=[sum(np.frombuffer(c, np.int64) for c in part["value"]).tobytes()])


def _joined(key, part):
    return part.iloc[:1].assign(value=[np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in part["value"]]).tobytes()])


def gathered(slices: DataFrame, combine, size: int) -> bytes:
    """A table of fixed size from its slices (task, slice, value) of all tasks, combined in a tree of two levels."""
    schema = "task long, slice int, value binary"
    some = slices.groupBy("slice", F.floor(F.col("task") / TASKS)).applyInPandas(combine, schema)
    rows = some.groupBy("slice").applyInPandas(combine, schema).collect()
    by_slice = {r["slice"]: bytes(r["value"]) for r in rows}
    return b"".join(by_slice.get(i, bytes(size // SLICES)) for i in range(SLICES))


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Counts in steps of a logarithm, as the high bits of the order of shingles."""
    return (np.log2(counts + 1.0) * 1024).astype(np.uint64) << np.uint64(48)


def _prefixes(shared, k: int, percent: int):
    """For every set that can link with another one: the shingles to post, rare ones first."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = WordHashes(), _ranks(np.frombuffer(shared.value, np.int64))
        least = smallest_different(percent)
        for batch in batches:
            digests, prefixes = [], []
            for text in batch.column(0).to_pylist():
                h = np.unique(shingle_hashes(words_of(text), hashes, k))
                if len(h) < least:
                    continue
                order = ranks[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] | (h >> np.uint64(16))
                p = len(h) + (-percent * len(h)) // 100 + least_shared(percent)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                prefixes.append(h[np.argsort(order, kind="stable")[:p]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["digest", "prefix"])

    return run


def _bit(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of a hash in the packed table of wanted texts."""
    at = hashes & ((1 << WANTED_BITS) - 1)
    return at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)


def _wanted_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros((1 << WANTED_BITS) // 8, dtype=np.uint8)
    for batch in batches:
        place, bit = _bit(batch.column(0).to_numpy())
        np.bitwise_or.at(bits, place, bit)
    packed = bits.reshape(SLICES, -1)
    full = [i for i in range(SLICES) if packed[i].any()]
    own = [next(row_ids()) >> 33] * len(full)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(full, pa.int32()), pa.array([packed[i].tobytes() for i in full], pa.binary())], ["task", "slice", "value"])


def _picked(shared):
    """Texts that may be wanted, compressed; the table may let others through, never keep one back."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pack = np.frombuffer(shared.value, np.uint8), zstandard.ZstdCompressor(3)
        for batch in batches:
            place, bit = _bit(batch.column(2).to_numpy())
            hit = np.flatnonzero(bits[place] & bit)
            texts = batch.column(1).take(pa.array(hit)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array([pack.compress((t or "").encode()) for t in texts], pa.binary())], ["doc_id", "packed"])

    return run


def _compare(k: int, close: int):
    """Rows of a group follow each other, its leader first: overlaps of the leader with all others,
    and the differences (as hashes) of those whose similarity with it is ``close`` percent or more."""
    import xxhash
    import zstandard

    def hashed(some: set) -> np.ndarray:
        return np.array(sorted(xxhash.xxh3_64_intdigest(b" ".join(x)) for x in some), dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, group, lead = zstandard.ZstdDecompressor(), None, set()
        for batch in batches:
            out = []
            for a, part, b, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingles(unpack.decompress(packed).lower().split(), k)
                if b is None:
                    group, lead = (a, part), own
                elif group == (a, part):
                    o = len(own & lead)
                    near = 100 * o >= close * (len(own) + len(lead) - o)
                    out.append((a, b, o, len(lead), len(own), hashed(lead - own) if near else None, hashed(own - lead) if near else None))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "b", "overlap", "n_a", "n_b", "gone", "new"])

    return run


COMPARED = "a long, b long, overlap long, n_a long, n_b long, gone array<long>, new array<long>"


def compared(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, repeated: bool, work: list[DataFrame], close: int = 101) -> DataFrame:
    """Exact overlaps of the pairs (a, b) of nodes, counted on their words, and differences of close ones.

    Adds to ``work`` the table that the caller has to discard once the result is written."""
    spark = pairs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(nodes.join(sets.select("node", "low"), "node"), "wanted")
    work.append(wanted)
    marks = wanted.select(F.xxhash64("low")).mapInArrow(_wanted_bits, "task long, slice int, value binary")
    shared = spark.sparkContext.broadcast(gathered(marks, _joined, (1 << WANTED_BITS) // 8))
    found = docs.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(_picked(shared), "doc_id long, packed binary")
    # who needs which text, in numbers only: a text is shuffled to its id and then to its group, no more
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", F.col("b").alias("node"))
    leads = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    asked = leads.unionByName(others).join(wanted.withColumnRenamed("low", "doc_id"), "node")
    if repeated:
        # of rows that repeat an id with other texts, the one is taken whose set belongs to the node
        texts = _own_set(found.join(wanted.withColumnRenamed("low", "doc_id"), "doc_id").select("node", "packed"), sets, k)
        rows = asked.join(texts, "node")
    else:
        rows = asked.join(found, "doc_id")
    rows = rows.select("a", "part", "b", "packed").repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_compare(k, close), COMPARED)


def _own_set(texts: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    import xxhash
    import zstandard

    def run(batches):
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            for packed, digest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.unique(shingle_hashes(unpack.decompress(packed).lower().split(), hashes, k))
                keep.append(xxhash.xxh3_128_digest(h.tobytes()) == digest)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["node", "packed"])

    rows = texts.join(sets.select("node", "digest"), "node").mapInArrow(run, "node long, packed binary")
    return rows.groupBy("node").agg(F.first("packed").alias("packed"))


def linked_rows(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _add_overlaps(out: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds the sizes of the intersections of all pairs of small sets, in place and a strip of rows at a
    time; elements of one set only are left out."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    elements, at, n = np.unique(np.concatenate(sets) if m else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    keep = (n > 1)[at]
    owner, at = owner[keep], column[at[keep]]
    for low in range(0, int((n > 1).sum()), COLUMNS):
        some = (at >= low) & (at < low + COLUMNS)
        block = np.zeros((m, COLUMNS), dtype=np.float32)
        block[owner[some], at[some] - low] = 1
        for at_row in range(0, m, SOME_ROWS):
            out[at_row : at_row + SOME_ROWS] += block[at_row : at_row + SOME_ROWS] @ block.T


def forest(nodes: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, smallest node of its component) of a matrix of links."""
    open_, out = np.ones(len(nodes), dtype=bool), []
    for i in np.argsort(nodes, kind="stable"):
        if not open_[i]:
            continue
        open_[i] = False
        front = [i]
        while front:
            found = links[front].any(axis=0) & open_
            open_ &= ~found
            front = np.flatnonzero(found)
            out += [(int(nodes[j]), int(nodes[i])) for j in front]
            front = list(front)
    return out


def _derive(percent: int):
    """Links among the sets of one leader, from their differences with it; rows of a group follow each other."""

    def of_group(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes = np.array([r[0] for r in rows])
        n = np.array([r[1] for r in rows], dtype=np.int64)
        gone = [np.asarray(r[3], dtype=np.int64) for r in rows]
        new = [np.asarray(r[4], dtype=np.int64) for r in rows]
        lacking = np.array([len(g) for g in gone])
        # one matrix, changed in place: single precision holds these whole numbers exactly up to 2^24
        kind = np.float32 if rows[0][2] + int(n.max()) < 1 << 23 else np.float64
        overlap = np.zeros((len(n), len(n)), dtype=kind)
        _add_overlaps(overlap, gone)
        overlap -= lacking[:, None].astype(kind)
        overlap -= lacking[None, :].astype(kind)
        _add_overlaps(overlap, new)
        overlap += kind(rows[0][2])
        links = np.empty(overlap.shape, dtype=bool)
        for at in range(0, len(n), SOME_ROWS):
            some = slice(at, at + SOME_ROWS)
            links[some] = linked_rows(n[some, None], n[None, :], overlap[some].astype(np.int64), percent)
        np.fill_diagonal(links, False)
        return forest(nodes, links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            for lead, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lead, i, j) != key:
                    found += of_group(held) if len(held) > 1 else []
                    key, held = (lead, i, j), []
                held.append(tuple(row))
            yield out(found)
        yield out(of_group(held) if len(held) > 1 else [])

    return run


def dealt_in_pairs(rows: DataFrame, key: str, sizes: DataFrame, chunk: int) -> DataFrame:
    """Rows of long groups in pairs (i, j) of chunks of about ``chunk`` rows; short groups are one pair (0, 0)."""
    chunks = sizes.select(key, F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    dealt = rows.join(chunks, key).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})


#: Leaders of a set: three at most, and itself if it leads others.
_LEADS = ["lead0", "lead1", "lead2", "lead3"]
_ENTRY = ["key", "i", "j", "node", "n", "pos", "comp", *_LEADS, "chunk"]


def _walk(percent: int):
    """Pairs of nodes left by the blocks of each list; the rows of a list follow each other by size."""

    def pairs_of(r: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        # blocks: runs of equal rows but for the node
        same = np.ones(len(r["key"]) - 1, dtype=bool)
        for c in ("key", "i", "j", "chunk", "n", "pos", "comp", *_LEADS):
            same &= r[c][1:] == r[c][:-1]
        start = np.flatnonzero(np.r_[True, ~same])
        size = np.diff(np.r_[start, len(r["key"])])
        b = {c: r[c][start] for c in _ENTRY}
        first = np.arange(len(start))
        step = 1
        while True:
            # each block with the one so many steps further on in its list, as long as sizes allow
            x = first[first + step < len(start)]
            y = x + step
            near = (b["key"][x] == b["key"][y]) & (b["i"][x] == b["i"][y]) & (b["j"][x] == b["j"][y]) & (100 * b["n"][x] >= percent * b["n"][y])
            first = x = x[near]
            if not len(x):
                return
            y = x + step
            n_x, n_y, p_x, p_y = b["n"][x], b["n"][y], b["pos"][x], b["pos"][y]
            room = np.minimum(p_x, p_y) + np.minimum(n_x - p_x, n_y - p_y)
            left = (b["comp"][x] != b["comp"][y]) & (room >= least_overlap(n_x, n_y, percent))
            for one in _LEADS:
                for other in _LEADS:
                    left &= b[one][x] != b[other][y]  # sets of one leader: answered
            left &= (b["i"][x] == b["j"][x]) | (b["chunk"][x] != b["chunk"][y])  # a pair of two chunks: one of each
            step += 1
            if not left.any():
                continue
            x, y = x[left], y[left]
            # blocks to nodes
            times = size[x] * size[y]
            ends = np.cumsum(times)
            for low in range(0, int(ends[-1]), PAIRS_AT_ONCE):
                place = np.arange(low, min(low + PAIRS_AT_ONCE, int(ends[-1])))
                at = np.searchsorted(ends, place, side="right")
                k = place - (ends[at] - times[at])
                a = r["node"][start[x][at] + k // size[y][at]]
                c = r["node"][start[y][at] + k % size[y][at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            r = {c: batch.column(c).to_numpy() for c in _ENTRY}
            if held is not None:
                r = {c: np.concatenate([held[c], r[c]]) for c in _ENTRY}
            if not len(r["key"]):
                continue
            last = (r["key"] == r["key"][-1]) & (r["i"] == r["i"][-1]) & (r["j"] == r["j"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = {c: v[cut:] for c, v in r.items()}
            if cut:
                yield from pairs_of({c: v[:cut] for c, v in r.items()})
        if held is not None and len(held["key"]):
            yield from pairs_of(held)

    return run


def led(stars: DataFrame, sets: DataFrame, docs: DataFrame, k: int, repeated: bool, close: int) -> DataFrame:
    """(lead, node, n_lead, n, gone, new) of every set that is close to a leader: its own or its leader's,
    and the others it was compared with; three leaders of a set at most."""
    work: list[DataFrame] = []
    both = written(compared(stars, sets, docs, k, repeated, work, close).filter("gone is not null"), "led1")
    nearest = both.groupBy("b").agg(F.max(F.struct("overlap", -F.col("a"))).alias("best")).select("b", (-F.col("best.col2")).alias("a"))
    own = both.join(nearest, ["a", "b"]).select(*both.columns)
    up = own.select(F.col("b").alias("a"), F.col("a").alias("top"))
    up = up.join(up.select(F.col("a").alias("top"), F.col("top").alias("more")), "top", "left").select("a", F.coalesce("more", "top").alias("top"))
    again = written(own.select("a", "b").join(up, "a").select(F.col("top").alias("a"), "b").filter("a <> b"), "again")
    higher = written(compared(again, sets, docs, k, repeated, work, close).filter("gone is not null"), "led2")
    rest = own.join(higher.select("b"), "b", "left_anti").select(*own.columns)
    first = higher.unionByName(rest)
    second = both.join(first.select("a", "b"), ["a", "b"], "left_anti").join(own.select("a", "b"), ["a", "b"], "left_anti").select(*own.columns)
    members = written(first.unionByName(second).select(F.col("a").alias("lead"), F.col("b").alias("node"), F.col("n_a").alias("n_lead"), F.col("n_b").alias("n"), "gone", "new"), "members")
    discard(both, again, higher, *work)
    return members


def likely(stars: DataFrame, sets: DataFrame, lists: DataFrame, least: int, close: int) -> DataFrame:
    """Of the comparisons (a, b) with leaders those that can pay: sizes let the similarity be ``close``
    percent, and the two share ``least`` lists, as sets that link do. Others answer nothing, and
    pairs that no leader answers are found by the lists themselves."""
    size = sets.select("node", "n")
    fit = stars.join(size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    fit = fit.filter(100 * F.least("n_a", "n_b") >= close * F.greatest("n_a", "n_b")).select("a", "b")
    # the lists of a set are at most as many as its posted shingles
    keys = lists.groupBy("node").agg(F.collect_list("key").alias("keys"))
    both = fit.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("keys_a")), "a").join(keys.select(F.col("node").alias("b"), F.col("keys").alias("keys_b")), "b")
    return both.filter(F.size(F.array_intersect("keys_a", "keys_b")) >= least).select("a", "b")


def similar_components(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark, shared_least = docs.sparkSession, least_shared(percent)
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "row_id long, doc_id long, n long, digest binary, slice int, counts binary"
    first = written(docs.mapInArrow(_sets(n_words), schema), "sets")
    rows = first.filter("slice is null").select("row_id", "doc_id", "n", "digest")
    counts = first.filter("slice is not null").select(F.col("row_id").alias("task"), "slice", F.col("counts").alias("value"))
    shared = spark.sparkContext.broadcast(gathered(counts, _summed, 8 << COUNT_BITS))
    repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()

    # a node for each distinct set: its smallest row, and the smallest id among its rows
    with_id = rows.filter("digest is not null and doc_id is not null")
    sets = written(with_id.groupBy("digest").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("low"), F.max("n").alias("n")), "nodes")
    posted = docs.filter("doc_id is not null").select("text").mapInArrow(_prefixes(shared, n_words, percent), "digest binary, prefix array<long>")
    one = posted.groupBy("digest").agg(F.first("prefix").alias("prefix"))
    prefixes = written(one.join(sets, "digest").select("node", "n", "prefix"), "prefixes")

    postings = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"), F.max("node").alias("other")).filter("size > 1")
    shared_lists = written(postings.join(lists, "key").select("key", "node", "n", "pos", "leader", "other", "size"), "lists")
    discard(prefixes)

    # each set with the leader that most of its lists have, and with the first and the last set of its
    # longest lists: where one of them happens to be unlike the rest of its list, the other leads
    rows_of = F.when(F.col("size") >= LONG, F.col("size")).otherwise(0)
    votes = shared_lists.select("node", F.explode(F.array(F.struct(F.col("leader"), F.lit(False).alias("last")), F.struct(F.col("other").alias("leader"), F.lit(True).alias("last")))).alias("v"), rows_of.alias("rows"))
    votes = votes.select("node", "v.*", "rows").filter("node <> leader and (rows > 0 or not last)")
    votes = votes.groupBy("node", "leader", "last").agg(F.count(F.lit(1)).alias("lists"), F.sum("rows").alias("rows"))
    votes = votes.filter((F.col("lists") >= shared_least) | (F.col("rows") > 0))
    best = votes.groupBy("node").agg(
        F.max(F.when(~F.col("last") & (F.col("lists") >= shared_least), F.struct("lists", -F.col("leader")))).alias("most"),
        F.max(F.when(~F.col("last") & (F.col("rows") > 0), F.struct("rows", -F.col("leader")))).alias("longest"),
        F.max(F.when(F.col("last") & (F.col("rows") > 0), F.struct("rows", -F.col("leader")))).alias("final"),
    )
    stars = best.select(F.explode(F.array_distinct(F.array_compact(F.array(-F.col("most.col2"), -F.col("longest.col2"), -F.col("final.col2"))))).alias("a"), F.col("node").alias("b"))
    stars = written(likely(stars, sets, shared_lists, shared_least, CLOSE), "stars")
    members = led(stars, sets, docs, n_words, repeated, CLOSE)
    discard(stars)
    none = F.array().cast("array<long>")
    leaders = members.groupBy("lead").agg(F.max("n_lead").alias("n_lead"), (F.count(F.lit(1)) + 1).alias("size"))
    whole = leaders.select("lead", F.col("lead").alias("node"), "n_lead", F.col("n_lead").alias("n"), none.alias("gone"), none.alias("new"))
    groups = dealt_in_pairs(members.unionByName(whole), "lead", leaders, LEADER_CHUNK)
    groups = groups.select("lead", "i", "j", "node", "n", "n_lead", "gone", "new").repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "node")
    early = components(groups.mapInArrow(_derive(percent), "a long, b long"))

    # lists that are not connected yet; pairs of sets of one leader are settled
    leads = members.select("node", "lead").unionByName(leaders.select(F.col("lead").alias("node"), "lead"))
    leads = leads.groupBy("node").agg(F.array_sort(F.collect_set("lead")).alias("leads"))
    entries = (
        shared_lists.select("key", "node", "n", "pos").join(early, "node", "left").join(leads, "node", "left")
        .select("key", "node", "n", "pos", F.coalesce("component", "node").alias("comp"), *(F.coalesce(F.get("leads", F.lit(i)), "node").alias(c) for i, c in enumerate(_LEADS)))
    )
    open_lists = entries.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high")
    dealt = dealt_in_pairs(entries, "key", open_lists, CHUNK).select(*_ENTRY)
    order = ["key", "i", "j", "n", "pos", "comp", *_LEADS, "chunk", "node"]
    walked = dealt.repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(_walk(percent), "a long, b long")
    pairs = written(walked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists")).filter(F.col("lists") >= shared_least).select("a", "b"), "pairs")
    work: list[DataFrame] = []
    late = compared(pairs, sets, docs, n_words, repeated, work).filter(F.lit(100) * F.col("overlap") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("overlap")))
    labels = components(early.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late.select("a", "b")))
    discard(early, pairs, shared_lists, members, *work)

    # labels of sets, then of rows
    noded = sets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = noded.groupBy("component").agg(F.min("low").alias("component_id"))
    of_set = noded.join(lowest, "component").select("digest", "component_id")
    out = rows.join(of_set, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM words
), elements AS (
  SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS e FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * i >= 90 * (na + nb - i)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM sets
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b
), labels AS (
  SELECT node, min(low) AS component_id FROM reach GROUP BY 1
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id FROM sets s JOIN labels l ON l.node = s.doc_id
"""
