"""Substring dedup over word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket; there, sorting
counts windows exactly. A window that starts anywhere else as well loses its words, wherever it stands. Strings whose
minimiser no other string has cannot hold a repeat and stay where they are (see runs.py). A bucket of more than BUCKET
strings is dealt out again, window by window, and those are sorted. Windows are compared word by word everywhere.

Defined cases: a null or blank text has no words; a text shorter than one window keeps all; a very long text is cut into
stretches that overlap by a window less one word while its strings are made; a row with a null id is a document like any
other; rows that repeat an id, with or without the text, are further documents, so that a repeated row loses its windows;
documents are told apart by their id and a 64-bit hash of the text, those without an id by two such hashes; an empty
table gives an empty result; other columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, mix64, packed, quoted, slices, sliding_argmin, utf8, with_row
from .runs import HOT_WAITING, PIECES, PIECES_SQL, SCHEMA_SQL, SPANS, SPANS_SQL, WAITING, HotWindows, Sums, Waiting, by_bucket, merged, of_texts, record, shared, spans, starts, unpack

#: Words in a minimiser. Longer ones are rarer, shorter ones make longer super-k-mers.
GRAM = 3
#: Strings of one bucket that are counted in one task; the windows of larger ones are dealt out again, each by itself.
BUCKET = 4096
#: Bytes of a text whose words are cut at a time.
STRETCH = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def _stretches(text: bytes, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words); every window is in one of them."""
    if len(text) <= STRETCH:
        yield 0, text.split()
        return
    at, place, words = 0, 0, []
    while at < len(text):
        cut = _BLANK.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        words += text[at:end].split()
        at = end
        yield place, words
        left = max(0, len(words) - window + 1)
        place, words = place + left, words[left:]


def _super_kmers(window: int):
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, waiting = Sums(), Waiting(window, True, lambda words, s, n: words[0][s - words[1] : s - words[1] + n + window - 1])
        held: list[tuple[int, int, list[bytes]]] = []
        words: list[bytes] = []

        def close(docs: np.ndarray, twins: np.ndarray) -> None:
            h = np.fromiter(map(crc32, words), np.uint64, len(words))
            n = len(h) - gram + 1
            value = h[:n].copy()
            for i in range(1, gram):
                value = value * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            value = mix64(value)
            at = sliding_argmin(value, window - gram + 1)
            base, found = 0, []
            for k, (i, place, own) in enumerate(held):  # windows inside one document; a new run where the minimiser moves
                first, count = starts(at[base : base + len(own) - window + 1])
                found.append(np.stack([np.full(len(first), k), np.full(len(first), i), np.full(len(first), place - base), base + first, count]))
                base += len(own)
            owner, doc, shift, begin, count = np.concatenate(found, 1)
            code = sums.hashes(h, begin, begin + count + window - 1)
            waiting.add([(own, place) for _, place, own in held], value[at[begin]].view(np.int64), code, owner, docs[doc], twins[doc], begin + shift, count)
            held.clear()
            words.clear()

        for batch in slices(batches, 2, STRETCH):
            docs, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, text in enumerate(batch.column(2).to_pylist()):
                for place, own in _stretches(text, window):
                    if len(own) >= window:
                        held.append((i, place, own))
                        words += own
                    if len(words) > STRETCH // 4:
                        close(docs, twins)
            if held:
                close(docs, twins)
            if waiting.size > WAITING // 2:
                yield waiting.batch()
        yield waiting.batch()

    return run


def _strings(window: int):
    """doc, twin, data, runs -> the packed string of each run; of a hot one, of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_windows = HotWindows(window, True)
        for batch in slices(batches, 2, STRETCH):
            docs, twins = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, last, words = [], -1, []
            texts = batch.column(2)
            for i, key, s, n, hot in zip(*(x.tolist() for x in unpack(batch.column(3))), strict=True):
                if i != last:
                    last, words = i, texts[i].as_py().split()
                if hot:
                    for j in range(s, s + n):
                        hot_windows.add(docs[i], twins[i], j, b" ".join(words[j : j + window]))
                    if len(hot_windows.first) + len(hot_windows.done) > HOT_WAITING // 4:
                        rows += hot_windows.rows()
                else:
                    rows.append((False, key, docs[i], twins[i], s, b" ".join(words[s : s + n + window - 1])))
            yield record(rows, PIECES)
        yield record(hot_windows.rows(), PIECES)

    return run


def _count(group: list[list], window: int, rows: list[tuple]) -> None:
    """group: (key, doc, twin, at, packed) of one bucket, equal strings side by side."""
    if len(group) < 2:
        return
    found, texts = [], []
    for r, (*_, packed) in enumerate(group):
        if r and packed == group[r - 1][4]:
            texts[-1][1].append(r)
        else:
            texts.append((packed.split(b" "), [r]))
    flags = [[len(own) > 1] * (len(words) - window + 1) for words, own in texts]
    if len(texts) > 1:
        for t, (words, _) in enumerate(texts):
            found += [(b" ".join(words[j : j + window]), t, j) for j in range(len(words) - window + 1)]
        found.sort()
        for a, b in zip(found, found[1:], strict=False):
            if a[0] == b[0]:
                flags[a[1]][a[2]] = flags[b[1]][b[2]] = True
    for (_, own), repeated in zip(texts, flags, strict=True):
        if any(repeated):
            edge = np.flatnonzero(np.diff(np.r_[0, repeated, 0])).tolist()
            for r in own:
                _, doc, twin, at, _ = group[r]
                rows += [(doc, twin, at + a, at + b - 1 + window) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _buckets(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[list] = []
        key = None
        for batch in batches:
            for hot, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hot is None:  # a finished span
                    rows.append((row[1], row[2], row[3], row[3] + window))
                elif hot:  # a window equals the one before it or none before it
                    if key == (hot, row[0], row[4]):
                        rows += [(r[1], r[2], r[3], r[3] + window) for r in [*group, row]]
                        group = []
                    else:
                        _count(group if key and not key[0] else [], window, rows)
                        key, group = (hot, row[0], row[4]), [row]
                else:
                    if key != (hot, row[0]):
                        _count(group, window, rows)
                        key, group = (hot, row[0]), []
                    group.append(row)
                if len(rows) > 20_000:
                    yield record(rows, SPANS)
                    rows.clear()
        _count(group if key and not key[0] else [], window, rows)
        yield record(rows, SPANS)

    return run


def _cut(rejoin: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 23):
            count, removed, texts = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), merged(batch.column(2)), strict=True):
                words = kept = text.split()
                if spans:
                    kept, last = [], 0
                    for s, e in zip(*spans, strict=True):
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                count.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept) if spans or rejoin else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary())], names=["row", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(docs: DataFrame, window: int, stash: Stash, bucket: int = BUCKET) -> DataFrame:
    """docs: doc long, twin long, data binary. Returns doc, twin, s, e: word spans whose windows all repeat; spans may overlap."""
    found = stash.save(shared(docs.mapInArrow(_super_kmers(window), SCHEMA_SQL), bucket))
    strings = docs.join(of_texts(found), ["doc", "twin"]).select("doc", "twin", "data", "runs").mapInArrow(_strings(window), PIECES_SQL)
    return spans(found).unionByName(stash.save(by_bucket(strings).mapInArrow(_buckets(window), SPANS_SQL)))


def remove_repeated_windows(docs: DataFrame, stash: Stash, window: int = 35, doc_id: str = "doc_id", text: str = "text", rejoin: bool = True, bucket: int = BUCKET) -> DataFrame:
    """Returns row (a struct of all columns but the text), n_words, n_removed, kept (UTF-8 of the kept words joined by one space).

    Without ``rejoin`` a text that loses nothing is kept as it stands.
    """
    twin = F.xxhash64(quoted(text))
    doc = F.coalesce(F.col(quoted(doc_id)).cast("long"), F.xxhash64(F.lit("nameless"), quoted(text)))
    keyed = docs.select(doc.alias("doc"), twin.alias("twin"), packed([c for c in docs.columns if c != text]), utf8(text).alias("data"))
    removed = repeated_spans(keyed.select("doc", "twin", "data"), window, stash, bucket)
    removed = removed.groupBy("doc", "twin").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = keyed.join(removed, ["doc", "twin"], "left").select("row", "data", "spans")
    return joined.mapInArrow(_cut(rejoin), with_row(joined, "n_words long, n_removed long, kept binary"))
