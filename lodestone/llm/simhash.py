"""SimHash near-dedup with pivot distance tables.

A pivot distance table holds each fingerprint's Hamming distances to many reference fingerprints. By the triangle
inequality, two fingerprints within r bits differ by at most r in every coordinate. The references are laid out in
blocks of bits: those of one block agree everywhere else, so the differences of their distances depend on that block
alone. With five blocks and r = 3 at least two blocks agree, hence the coordinate differences of at least one pair of
blocks are equal: they are the key under which pairs meet (no link is lost). Pairs that meet are discarded by their
largest coordinate difference, and the survivors are verified bit by bit.

Defined cases: a null or blank text has fingerprint zero and links like any other; fewer words than a shingle give one
shingle of all words; repeated shingles count each time; copies share a fingerprint and are linked through it, never
pair by pair; rows without an id link like any other but are never the least member (the component is null where none of
its rows has an id); an id with several texts stands at each of their fingerprints; very long texts are hashed CHUNK
shingles at a time; an empty table gives an empty result; other columns pass through inside ``row``.

``similar_groups`` links by similarity instead of a few bits: fingerprints of WIDE * 64 bits over the distinct shingles,
which differ in a share of bits that depends on the similarity alone. So many bits cannot be split into blocks that must
agree; references that vary in a few drawn bits each give keys instead (the differences of a fingerprint's distances to
them are those bits), for so many draws that a pair at the bound meets in two of them on average: 86 of 100 such pairs
meet, and 99 of 100 at a similarity of 0.9. The number of bits of a key grows with the logarithm of the table, so that
few others meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, forest, mix64, packed, partitions, quoted, slices, utf8, with_row
from .components import components

#: Widths of the bit blocks; any RADIUS differing bits leave at least two of the five untouched.
BLOCKS = (13, 13, 13, 13, 12)
RADIUS = 3
#: References that vary in one block each, and references over all 64 bits.
BLOCK_PIVOTS, WIDE_PIVOTS = 24, 64
#: Fingerprints of one key that are compared in one task; more are split into blocks, and each pair of blocks is a task.
BUCKET = 2048
#: Hashes turned into bits at a time.
CHUNK = 1 << 15


def fingerprint(words: list[bytes], size: int) -> int:
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    stops = (ends - 1)[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = [fingerprint(t.lower().split(), size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["row", "print"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """Returns row (a struct of all columns but the text) and print, the 64-bit fingerprint as a long.

    A bit is set if it is set in more than half of the hashes (XXH64, seed 42) of the lower-cased word shingles.
    """
    data = docs.select(packed([c for c in docs.columns if c != text]), utf8(text).alias("data"))
    return data.mapInArrow(_fingerprints(size), with_row(data, "print long"))


def _pivots() -> tuple[list[np.ndarray], np.ndarray]:
    """References of each block (random inside it, zero outside), and those over all bits."""
    rng = np.random.default_rng(7)
    blocks, at = [], 0
    for width in BLOCKS:
        own = np.r_[0, 1 << np.arange(width), rng.integers(1, 1 << width, BLOCK_PIVOTS - width - 1)].astype(np.uint64)
        blocks.append(own << np.uint64(at))
        at += width
    return blocks, rng.integers(0, 2**64, WIDE_PIVOTS, np.uint64)


def distance_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, _ = _pivots()
    for batch in batches:
        x = batch.column(0).to_numpy().view(np.uint64)
        codes = []
        for pivots in blocks:
            table = distance_table(x, pivots).astype(np.uint64)
            code = np.zeros(len(x), np.uint64)
            for j in range(1, len(pivots)):
                code = mix64(code + (table[:, j] - table[:, 0]))
            codes.append(code)
        for n, (a, b) in enumerate(itertools.combinations(range(len(blocks)), 2)):
            key = mix64(codes[a] * np.uint64(31) + codes[b] + np.uint64(n))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], names=["key", "print", "rep"])


def _linked(x: np.ndarray, rep: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those that survive the largest coordinate difference and the bit by bit test."""
    kept = np.abs(table[i] - table[j]).max(1) <= RADIUS if len(i) else np.zeros(0, bool)
    i, j = i[kept], j[kept]
    close = np.bitwise_count(x[i] ^ x[j]) <= RADIUS
    return rep[i[close]], rep[j[close]]


def _edges(groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """groups: keys (sorted), fingerprints and representatives of whole keys."""
    _, wide = _pivots()
    for key, x, rep in groups:
        table, a, b = distance_table(x, wide), [], []
        ends = np.searchsorted(key, key, "right")
        d = 1
        while len(at := np.flatnonzero(np.arange(len(key)) + d < ends)):
            for s in range(0, len(at), 1 << 17):
                i = at[s : s + (1 << 17)]
                p, q = _linked(x, rep, i, i + d, table)
                a.append(p)
                b.append(q)
            d += 1
            if d % 64 == 0:
                p, q = forest(np.concatenate(a), np.concatenate(b))
                a, b = [p], [q]
        if a:
            p, q = forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])


def _cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a batch's last key waits for the next batch. Keys of one row go."""

    def groups():
        rest = [np.empty(0, np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            now = [np.r_[r, batch.column(c).to_numpy()] for c, r in enumerate(rest)] if batch is not None else rest
            if not len(now[0]):
                continue
            cut = len(now[0]) if batch is None else int(np.searchsorted(now[0], now[0][-1]))
            rest = [c[cut:] for c in now]
            key, x, rep = (c[:cut] for c in now)
            same = np.r_[False, key[1:] == key[:-1]]
            shared = same | np.r_[same[1:], False]
            if shared.any():
                yield key[shared], x[shared].view(np.uint64), rep[shared]

    yield from _edges(groups())


def _hot(frame):
    """One pair of blocks of one key: pairs across, or within the block."""
    import pandas as pd

    _, wide = _pivots()
    left, right = frame[frame.side == 0], frame[frame.side == 1]
    x, y = (f.print.to_numpy().view(np.uint64) for f in (left, right))
    tx, ty, a, b = distance_table(x, wide), distance_table(y, wide), [], []
    for i in range(len(x)):
        close = np.flatnonzero(np.abs(ty - tx[i]).max(1) <= RADIUS)
        close = close[np.bitwise_count(y[close] ^ x[i]) <= RADIUS]
        a.append(np.full(len(close), left.rep.iloc[i], np.int64))
        b.append(right.rep.to_numpy()[close])
    p, q = forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2
    return pd.DataFrame({"a": p, "b": q})


def links(prints: DataFrame, stash: Stash, bucket: int = BUCKET) -> DataFrame:
    """prints: print, rep (distinct prints). Returns edges a, b of representatives that connect what links within RADIUS connect."""
    keyed = stash.save(prints.select("print", "rep").where("rep is not null").mapInArrow(_keys, "key long, print long, rep long"))
    return _dealt(keyed, stash, bucket, _cold, _hot)


def _dealt(keyed: DataFrame, stash: Stash, bucket: int, cold_edges, hot_edges) -> DataFrame:
    """Edges a, b among the rows of each key: a key of few rows in one task, of more in a task for each two of its blocks."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    hot = stash.save(keyed.join(sizes, "key"))
    if hot.isEmpty():
        cold = keyed
    else:
        cold = keyed.join(hot.select("key").distinct(), "key", "left_anti")
    edges = cold.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key").select("key", "print", "rep").mapInArrow(cold_edges, "a long, b long")
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    dealt = hot.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "print", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "other")
    sides = dealt.withColumn("side", F.explode(F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("own") > F.col("other")).cast("int")))))
    return edges.unionByName(sides.groupBy("key", "i", "j").applyInPandas(hot_edges, "a long, b long"))


#: Words of a wide fingerprint; references of its distance table; times that a pair at the bound meets on average.
WIDE, WIDE_REFERENCES, MEETINGS = 4, 16, 2.0


def wide_fingerprint(words: list[bytes], size: int) -> bytes:
    if not words:
        return bytes(8 * WIDE)
    digest, size = xxhash.xxh64_intdigest, min(size, len(words))
    h = np.unique(np.array([digest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)], np.uint64))
    ones = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK]
        wide = np.stack([part, *(mix64(part + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, WIDE))], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).tobytes()


def _wide_fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            prints = [wide_fingerprint(t.lower().split(), size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["row", "print"])

    return run


def shares(similarity: float) -> tuple[float, int]:
    """The share of bits in which two sets of that Jaccard similarity differ, and the bits up to which they are linked."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * WIDE
    return share, int(bits * share + np.sqrt(bits * share * (1 - share)))


def _wide_keys(bits: int, draws: int):
    rng = np.random.default_rng(11)
    drawn = [rng.choice(64 * WIDE, bits, replace=False) for _ in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ones = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8 * WIDE), axis=1)
            for t, places in enumerate(drawn):
                code = ones[:, places].astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                key = mix64(code + np.uint64(t << 40)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], names=["key", "print", "rep"])

    return run


class _Wide:
    """Wide fingerprints with their distances to the references."""

    def __init__(self, prints: list[bytes], most: int):
        self.x = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE)
        references = np.random.default_rng(12).integers(0, 2**64, (WIDE_REFERENCES, WIDE), np.uint64)
        self.table = np.stack([np.bitwise_count(self.x ^ r).sum(1, dtype=np.int16) for r in references], 1)
        self.most = most

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs survive the largest coordinate difference and the bit by bit test."""
        found = np.abs(self.table[i] - self.table[j]).max(1) <= self.most
        at = np.flatnonzero(found)
        found[at] = np.bitwise_count(self.x[i[at]] ^ self.x[j[at]]).sum(1) <= self.most
        return found

    def connect(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect what links among the members ``at`` connect. What is linked to the first member needs no
        further comparison with each other; all others meet everyone."""
        if len(at) < 2:
            return at[:0], at[:0]
        first = at[self.close(np.full(len(at), at[0]), at)]
        a, b = [np.full(len(first), at[0])], [first]
        for i in np.setdiff1d(at, first).tolist():
            near = at[self.close(np.full(len(at), i), at)]
            a.append(np.full(len(near), i))
            b.append(near)
        return np.concatenate(a), np.concatenate(b)


def _wide_cold(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if now is None or not now.num_rows:
                continue
            key = now.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            rest, end = (None, len(key)) if batch is None else (now.slice(int(first[-1])), int(first[-1]))
            size = np.diff(np.r_[first, len(key)])
            at = np.flatnonzero(np.repeat(size > 1, size)[:end])
            if not len(at):
                continue
            own = now.take(pa.array(at))
            rep, wide = own.column(2).to_numpy(), _Wide(own.column(1).to_pylist(), most)
            size = size[(size > 1) & (first < end)]
            begin = np.cumsum(size) - size
            a, b = [], []
            i, ends, d = np.flatnonzero(np.repeat(size <= 32, size)), np.repeat(begin + size, size), 1
            while len(i := i[i + d < ends[i]]):
                close = wide.close(i, i + d)
                a.append(i[close])
                b.append(i[close] + d)
                d += 1
            for s, n in zip(begin[size > 32].tolist(), size[size > 32].tolist(), strict=True):
                p, q = wide.connect(np.arange(s, s + n))
                a.append(p)
                b.append(q)
            if a:
                p, q = forest(rep[np.concatenate(a)], rep[np.concatenate(b)])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    return run


def _wide_hot(most: int):
    def run(frame):
        import pandas as pd

        own = frame.drop_duplicates("rep")
        a, b = _Wide(own.print.tolist(), most).connect(np.arange(len(own)))
        rep = own.rep.to_numpy()
        p, q = forest(rep[a], rep[b]) if len(a) else (rep[:0], rep[:0])
        return pd.DataFrame({"a": p, "b": q})

    return run


def similar_groups(docs: DataFrame, stash: Stash, size: int = 5, similarity: float = 0.8, text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Returns row (all columns but the text) and component (long), equal for rows whose texts links connect."""
    data = docs.select(packed([c for c in docs.columns if c != text]), utf8(text).alias("data"))
    prints = stash.save(data.mapInArrow(_wide_fingerprints(size), with_row(data, "print binary")))
    named = stash.save(prints.select("print").distinct().withColumn("rep", F.monotonically_increasing_id()))
    share, most = shares(similarity)
    bits = int(np.clip(np.ceil(np.log2(max(named.count(), 1))), 12, 32))
    keyed = named.mapInArrow(_wide_keys(bits, int(np.ceil(MEETINGS / (1 - share) ** bits))), "key long, print binary, rep long")
    edges = _dealt(keyed, stash, bucket, _wide_cold(most), _wide_hot(most))
    found = components(stash.save(edges), stash)
    label = named.join(found, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component"))
    return prints.join(label, "print").select("row", "component")


def near_duplicates(docs: DataFrame, stash: Stash, size: int = 3, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Returns row (all columns but the text), print (long) and component_id (least id of the rows reachable by links)."""
    prints = stash.save(fingerprints(docs, size, text))
    groups = stash.save(prints.groupBy("print").agg(F.min(f"row.{quoted(doc_id)}").cast("long").alias("least")))
    found = components(links(groups.select("print", F.col("print").alias("rep")), stash, bucket), stash)
    member = stash.save(groups.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component")))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    label = member.join(ids, "component").select("print", "component_id")
    return prints.join(label, "print").select("row", "print", "component_id")
