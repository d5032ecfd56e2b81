"""Runs of windows that share a minimiser: how both removers of repeats deal texts out.

A run is n windows of one text, from place s on, whose minimiser has one hash, its key. Runs are dealt out by key before
any text is: only those whose key another run has can hold a repeat. Equal runs of a slice of texts are found where they
are made, by comparing their text, so that a passage which a third of all texts hold leaves a slice once. A key that more
than ``bucket`` runs still have is hot: its windows travel one by one, each dealt out by its own hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merge_spans, mix64, partitions

#: A row with n < 0 is a finished span of -n places, on its way through.
SCHEMA = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_())])
SCHEMA_SQL = "key long, doc long, twin long, s int, n int, hot boolean"
SPANS = pa.schema([("doc", pa.int64()), ("twin", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
SPANS_SQL = "doc long, twin long, s int, e int"
#: Runs that wait to be compared with each other; windows of hot keys that do. Both bound a task's memory.
WAITING, HOT_WAITING = 300_000, 100_000
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Sums:
    """Hashes of all stretches of a sequence by differences of running sums."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BACK)], dtype=np.uint64)

    def hashes(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(values))
        total = np.r_[np.uint64(0), np.cumsum((values + np.uint64(1)) * self.up[: len(values)], dtype=np.uint64)]
        return mix64((total[end] - total[start]) * self.down[start])


class Waiting:
    """Runs of the texts of a slice. ``text`` gives the content of a run: (text, first window, windows) -> comparable.

    Of equal runs the earliest goes on. With ``all_repeat`` every one of them is a finished span, else all but the earliest.
    """

    def __init__(self, window: int, all_repeat: bool, text: Callable):
        self.window, self.all_repeat, self.text = window, all_repeat, text
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: list = []
        self.size = 0

    def add(self, texts: list, key: np.ndarray, code: np.ndarray, owner: np.ndarray, doc: np.ndarray, twin: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        """owner: which of ``texts`` a run is of; code: a hash of its content."""
        self.parts.append((key, code, owner + len(self.texts), doc, twin, s, n))
        self.texts += texts
        self.size += len(key)

    def batch(self) -> pa.RecordBatch:
        if not self.parts:
            return pa.RecordBatch.from_pylist([], SCHEMA)
        key, code, owner, doc, twin, s, n = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        texts, self.parts, self.texts, self.size = self.texts, [], [], 0
        order = np.lexsort((s, twin, doc, code))
        same = code[order][1:] == code[order][:-1]
        kept, done = np.ones(len(key), bool), np.zeros(len(key), bool)
        first, content = -1, None
        for i in (np.flatnonzero(same) + 1).tolist():
            a, b = int(order[i - 1]), int(order[i])
            if code[first] != code[a] or first < 0:
                first, content = a, self.text(texts[owner[a]], int(s[a]), int(n[a]))
            if n[first] != n[b] or self.text(texts[owner[b]], int(s[b]), int(n[b])) != content:
                continue  # by chance; it goes on like any other
            kept[b] = False
            if self.all_repeat:
                done[first] = done[b] = True
            elif (doc[first], twin[first], s[first]) != (doc[b], twin[b], s[b]):
                done[b] = True
        at = np.flatnonzero(done)
        at = at[np.lexsort((s[at], twin[at], doc[at]))]
        d, t, a, e = doc[at], twin[at], s[at].astype(np.int64), s[at].astype(np.int64) + n[at] + self.window - 1
        new = np.ones(len(at), bool)  # runs of one text come in order of their ends, too
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (a[1:] > e[:-1])
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1] if len(at) else at
        d, t, a, e = d[new], t[new], a[new], e[last]
        spread = mix64(d.view(np.uint64) ^ t.view(np.uint64)).view(np.int64)
        columns = [np.r_[key[kept], spread], np.r_[doc[kept], d], np.r_[twin[kept], t], np.r_[s[kept], a], np.r_[n[kept], a - e]]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, SCHEMA, strict=False)), pa.array(np.zeros(len(columns[0]), bool))], schema=SCHEMA)


def starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at: the minimiser's place of each window of a text. Returns the runs' first windows and their numbers of windows."""
    first = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
    return first, np.diff(np.r_[first, len(at)])


def _shared(bucket: int):
    """Of runs sorted by key those whose key another one has; at most ``bucket`` runs wait for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot_key = None, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                done = batch.column(4).to_numpy() < 0
                if done.any():
                    yield batch.filter(pa.array(done))
                    batch = batch.filter(pa.array(~done))
            now = rest if batch is None else batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks()
            if now is None or not now.num_rows:
                continue
            if isinstance(now, pa.Table):
                now = now.to_batches()[0]
            key = now.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            hot = size > bucket
            hot[0] |= hot_key is not None and key[0] == hot_key
            end = len(key) if batch is None or hot[-1] else int(first[-1])
            hot_key = key[-1] if hot[-1] else hot_key
            shared, hot = (np.repeat(x, size)[:end] for x in ((size > 1) | hot, hot))
            yield now.slice(0, end).filter(pa.array(shared)).set_column(5, "hot", pa.array(hot[shared]))
            rest = now.slice(end)

    return run


def shared(runs: DataFrame, bucket: int) -> DataFrame:
    """Runs whose key occurs again, hot or not, and finished spans."""
    by_key = runs.repartition(partitions(runs.sparkSession), "key").sortWithinPartitions("key")
    return by_key.mapInArrow(_shared(bucket), SCHEMA_SQL)


def of_texts(found: DataFrame) -> DataFrame:
    """doc, twin, runs: all shared runs of a text."""
    return found.where("n > 0").groupBy("doc", "twin").agg(F.collect_list(F.struct("key", "s", "n", "hot")).alias("runs"))


def merged(lists: pa.ListArray) -> Iterator[tuple[list[int], list[int]] | None]:
    """Of each row's list of spans (s, e) their union, or None where there are none."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    s, e = (c.to_numpy(zero_copy_only=False) for c in pc.list_flatten(lists).flatten())
    at = 0
    for n in size.tolist():
        yield tuple(x.tolist() for x in merge_spans(s[at : at + n], e[at : at + n])) if n else None
        at += n


def spans(found: DataFrame) -> DataFrame:
    return found.where("n < 0").select("doc", "twin", "s", (F.col("s") - F.col("n")).alias("e"))


def unpack(runs: pa.ListArray) -> tuple[np.ndarray, ...]:
    """owner (which text of the batch), key, s, n, hot; a text that stands in several rows has its runs once each."""
    owner = pc.list_parent_indices(runs).to_numpy().astype(np.int64)
    key, s, n, hot = (c.to_numpy(zero_copy_only=False) for c in pc.list_flatten(runs).flatten())
    _, once = np.unique(owner << 32 | s, return_index=True)
    return owner[once], key[once], s[once], n[once], hot[once].astype(bool)


PIECES = pa.schema([("hot", pa.bool_()), ("key", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("s", pa.int32()), ("piece", pa.binary())])
PIECES_SQL = "hot boolean, key long, doc long, twin long, s int, piece binary"


class HotWindows:
    """Windows of hot keys, equal ones of a task's stretch of rows once; the others are finished spans (hot is null)."""

    def __init__(self, window: int, all_repeat: bool):
        self.window, self.all_repeat = window, all_repeat
        self.first: dict[bytes, tuple[int, int, int]] = {}
        self.done: set[tuple[int, int, int]] = set()

    def add(self, doc: int, twin: int, s: int, window: bytes) -> None:
        own = (doc, twin, s)
        other = self.first.setdefault(window, own)
        if self.all_repeat:
            if other is not own:
                self.done |= {other, own}
        elif other != own:
            self.first[window] = min(other, own)
            self.done.add(max(other, own))

    def rows(self) -> list[tuple]:
        rows = [(True, xxhash.xxh64_intdigest(w) - (1 << 63), *own, w) for w, own in self.first.items()]
        rows += [(None, mixed(doc, twin), doc, twin, s, b"") for doc, twin, s in self.done]
        self.first, self.done = {}, set()
        return rows


def mixed(doc: int, twin: int) -> int:
    return (doc * 0x9E3779B97F4A7C15 + twin) % (1 << 63)


def record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def by_bucket(pieces: DataFrame) -> DataFrame:
    """Pieces of one bucket side by side, equal ones in order of their texts."""
    return pieces.repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("hot", "key", "piece", "doc", "twin", "s")
