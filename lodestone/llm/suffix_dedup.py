"""Suffix-array dedup: every byte that a string of LENGTH bytes covers which also starts earlier is removed.

Blockwise suffix sorting with a difference cover. A suffix belongs to the bucket of its minimiser (the gram of GRAM bytes
with the least hash among the first LENGTH bytes), so equal strings share a bucket; consecutive suffixes with one
minimiser travel as one piece of text (see runs.py). Buckets whose minimiser occurs once cannot hold a repeat and are
never shipped. In a bucket, suffixes are sorted one block at a time (those at one distance from the minimiser). Long ties
cost nothing: a cover sample of the piece positions (residues modulo COVER whose differences give all residues) is ranked
beforehand by prefix doubling; from any suffix a sampled position is less than COVER away, and the suffixes of a block are
aligned, so one rank stands for the bytes in the middle. A bucket of more than BUCKET pieces is dealt out again, by whole
strings: what comes together there is sorted as strings. Strings are compared byte by byte everywhere.

Defined cases: a null text is empty; a text shorter than LENGTH keeps all; a very long text is cut into stretches that
overlap by LENGTH - 1 bytes while its runs are made; a null id counts as the largest, and rows without one are documents
of their own, ordered by a number written with them; rows that repeat an id but not the text are ordered among each other
by a 64-bit hash of the text; rows that repeat both keep or lose the same bytes, neither is earlier than the other;
matches never cross documents; an empty table gives an empty result; other columns pass through inside ``row``, whatever
their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, mix64, packed, quoted, slices, sliding_argmin, utf8, with_row
from .runs import HOT_WAITING, PIECES, PIECES_SQL, SCHEMA_SQL, SPANS, SPANS_SQL, WAITING, HotWindows, Sums, Waiting, by_bucket, merged, of_texts, record, shared, spans, starts, unpack

GRAM, COVER = 32, 16
#: Runs of one bucket that are sorted in one task; the windows of larger ones are dealt out again, each by itself.
BUCKET = 4096
#: Bytes of texts whose runs are made together.
STRETCH = 1 << 20
#: Bytes of pieces that are sorted together.
BLOCK = 1 << 20
_HASH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def difference_cover(v: int) -> list[int]:
    """The first smallest set of residues whose differences give every residue modulo v."""
    for size in range(1, v + 1):
        for rest in itertools.combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return list(cover)
    raise AssertionError


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams of GRAM = 32 bytes, by doubling."""
    h, step = data.astype(np.uint64) + np.uint64(1), 1
    for c in _HASH:
        h = h[: max(0, len(h) - step)] * np.uint64(c) + h[step:]
        step *= 2
    return mix64(h)


def _stretches(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, place, bytes) of about STRETCH bytes in all; every window is in one of them."""
    own, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, STRETCH):
            own.append((i, at, text[at : at + STRETCH + length - 1]))
            size += len(own[-1][2])
            if size >= STRETCH:
                yield own
                own, size = [], 0
    if own:
        yield own


def _minimisers(length: int):
    """doc, twin, data -> the runs of windows whose minimiser is the gram with hash key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting = Sums(), Waiting(length, False, lambda text, s, n: text[s : s + n + length - 1])
        for batch in slices(batches, 2, STRETCH):
            texts = batch.column(2).to_pylist()
            docs, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own in _stretches(texts, length):
                raw = np.frombuffer(b"".join(t for _, _, t in own), np.uint8)
                h = gram_hashes(raw)
                at = sliding_argmin(h, length - GRAM + 1)
                base, found = 0, []
                for i, place, text in own:
                    first, n = starts(at[base : base + len(text) - length + 1])
                    found.append(np.stack([np.full(len(first), i), np.full(len(first), place - base), base + first, n]))
                    base += len(text)
                owner, shift, begin, n = np.concatenate(found, 1)
                code = sums.hashes(raw.astype(np.uint64), begin, begin + n + length - 1)
                waiting.add(texts, h[at[begin]].view(np.int64), code, owner, docs[owner], twins[owner], begin + shift, n)
            if waiting.size > WAITING:
                yield waiting.batch()
        yield waiting.batch()

    return run


def _pieces(length: int):
    """doc, twin, data, runs -> the text of each run; of a hot one, of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_windows = HotWindows(length, False)
        for batch in slices(batches, 2):
            texts, docs, twins = batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, key, s, n, hot in zip(*(x.tolist() for x in unpack(batch.column(3))), strict=True):
                if hot:
                    for j in range(s, s + n):
                        hot_windows.add(docs[i], twins[i], j, texts[i][j : j + length])
                    if len(hot_windows.first) + len(hot_windows.done) > HOT_WAITING:
                        rows += hot_windows.rows()
                else:
                    rows.append((False, key, docs[i], twins[i], s, texts[i][s : s + n + length - 1]))
            yield record(rows, PIECES)
        yield record(hot_windows.rows(), PIECES)

    return run


class Sorter:
    """Sorts the suffixes of the pieces of several buckets and finds those that an earlier one equals."""

    def __init__(self, length: int):
        self.length, self.cover = length, difference_cover(COVER)
        self.next = np.array([next(d for d in range(COVER) if (r + d) % COVER in self.cover) for r in range(COVER)])
        # The middle that one rank stands for: COVER-sized steps, so that sampled positions lead to sampled ones.
        self.middle = (length - COVER) // COVER * COVER
        self.tail = sorted({*range(self.middle, length - 8, 8), length - 8})

    @staticmethod
    def _rank(*parts: np.ndarray) -> np.ndarray:
        rank = parts[0]
        for p in parts[1:]:
            _, rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | p.astype(np.uint64), return_inverse=True)
        return rank

    def flags(self, pieces: list[tuple[int, int, int, int, bytes]]) -> list[np.ndarray]:
        """pieces: (key, doc, twin, s, piece), those of a key side by side. For each, which of its windows start earlier elsewhere."""
        length, n = self.length, len(pieces)
        size = np.array([len(p[4]) for p in pieces])
        raw = np.frombuffer(b"".join(p[4] for p in pieces), np.uint8)
        begin = np.cumsum(size) - size
        # The minimiser is the first gram with the bucket's hash; pieces are laid out so that minimisers are aligned.
        owner = np.repeat(np.arange(n), size)
        key = np.array([p[0] for p in pieces], np.int64)
        h = gram_hashes(raw).view(np.int64)
        hit = np.flatnonzero(h == key[owner[: len(h)]])
        anchor = hit[np.searchsorted(hit, begin)] - begin
        shift, base = (-anchor) % COVER, np.zeros(n, np.int64)
        room = (shift + size + COVER - 1) // COVER * COVER + 2 * COVER
        base = np.cumsum(room) - room + shift
        text = np.zeros(room.sum() + 2 * length, np.uint8)
        text[base[owner] + np.arange(len(raw)) - begin[owner]] = raw
        words = np.lib.stride_tricks.sliding_window_view(text, 8).copy().view(">u8")[:, 0]
        _, r8 = np.unique(words, return_inverse=True)
        # Ranks of the cover sample by prefix doubling: of 16 bytes, of 32, and so on up to the middle.
        sample = np.flatnonzero(np.isin(np.arange(len(r8) - length) % COVER, self.cover))
        index = np.full(len(r8), -1, np.int64)
        index[sample] = np.arange(len(sample))
        step = self._rank(r8[sample], r8[sample + 8])
        whole, covered, rank, reach = None, 0, step, COVER
        left = self.middle // COVER
        while left:
            if left & 1:
                if whole is None:
                    whole, covered = rank, reach
                else:
                    whole, covered = self._rank(whole, self._at(rank, index, sample + covered)), covered + reach
            left >>= 1
            if left:
                rank, reach = self._rank(rank, self._at(rank, index, sample + reach)), reach * 2
        # One block: the suffixes of a bucket at one distance from the minimiser.
        windows = size - length + 1
        piece = np.repeat(np.arange(n), windows)
        j = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = base[piece] + j
        bucket = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        block = bucket[piece] * (length + 1) + anchor[piece] - j
        order_of = np.empty(n, np.int64)
        order_of[np.lexsort((np.array([p[3] for p in pieces]) + anchor, np.array([p[2] for p in pieces]), np.array([p[1] for p in pieces])))] = np.arange(n)
        middle = whole[index[at + self.next[at % COVER]]]
        ranks = [r8[at], r8[at + 8], middle, *(r8[at + t] for t in self.tail)]
        order = np.lexsort((order_of[piece], *ranks[::-1], block))
        same = np.ones(max(0, len(order) - 1), bool)
        for r in (block, *ranks):
            same &= r[order[1:]] == r[order[:-1]]
        found = np.zeros(len(at), bool)
        found[order[1:][same]] = True
        return np.split(found, np.cumsum(windows)[:-1])

    @staticmethod
    def _at(rank: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks at sampled positions; past the end, where no window reaches, any."""
        return rank[np.maximum(index[np.minimum(at, len(index) - 1)], 0)]


def _buckets(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, rows = Sorter(length), []
        waiting: list[tuple] = []  # buckets to be sorted together
        held = 0

        def sort() -> None:
            nonlocal held
            if waiting:
                for piece, flags in zip(waiting, sorter.flags(waiting), strict=True):
                    edge = np.flatnonzero(np.diff(np.r_[0, flags, 0]))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        rows.append((piece[1], piece[2], piece[3] + a, piece[3] + b - 1 + length))
            waiting.clear()
            held = 0

        def close(group: list[tuple]) -> None:
            nonlocal held
            if len(group) > 1:
                waiting.extend(group)
                held += sum(len(p[4]) for p in group)
                if held > block:
                    sort()

        group: list[tuple] = []  # different pieces of the bucket, each where it first stands
        key, piece, first = None, None, None
        for batch in batches:
            for hot, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot is None:  # a finished span
                    rows.append((row[1], row[2], row[3], row[3] + length))
                    continue
                if (hot, row[0]) != key:
                    close(group)
                    group, key, piece = [], (hot, row[0]), None
                if row[4] == piece:  # sorted by piece, id and place: an earlier row has the same windows
                    if row[1:4] != first:
                        rows.append((row[1], row[2], row[3], row[3] + len(piece)))
                    continue
                piece, first = row[4], row[1:4]
                if not hot:  # a hot window equals another one as a whole or not at all
                    group.append(row)
                if len(rows) > 20_000:
                    yield record(rows, SPANS)
                    rows.clear()
        close(group)
        sort()
        yield record(rows, SPANS)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, 1 << 23):
        n_bytes, n_removed, n_spans, texts = [], [], [], []
        for text, own in zip(batch.column(1).to_pylist(), merged(batch.column(2)), strict=True):
            kept, count = text, 0
            if own:
                s, e = own
                kept, count = b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)], strict=True)), len(s)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept))
            n_spans.append(count)
            texts.append(kept)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(texts, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, stash: Stash, length: int = 100, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Returns row (a struct of all columns but the text), n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    if length < 3 * COVER:
        raise ValueError(f"length must be {3 * COVER} or more")
    row = packed([c for c in docs.columns if c != text])
    keyed = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc"), F.xxhash64(quoted(text)).alias("twin"), utf8(text).alias("data"), row)
    nameless = stash.save(keyed.where("doc is null").withColumn("twin", F.monotonically_increasing_id()))
    keyed = keyed.where("doc is not null").unionByName(nameless.withColumn("doc", F.lit((1 << 63) - 1)))
    data = keyed.select("doc", "twin", "data")
    found = stash.save(shared(data.mapInArrow(_minimisers(length), SCHEMA_SQL), bucket))
    pieces = data.join(of_texts(found), ["doc", "twin"]).select("doc", "twin", "data", "runs").mapInArrow(_pieces(length), PIECES_SQL)
    repeats = stash.save(by_bucket(pieces).mapInArrow(_buckets(length, block), SPANS_SQL))
    removed = spans(found).unionByName(repeats).groupBy("doc", "twin").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = keyed.join(removed, ["doc", "twin"], "left").select("row", "data", "spans")
    return joined.mapInArrow(_cut, with_row(joined, "n_bytes long, n_removed long, n_spans long, kept binary"))
