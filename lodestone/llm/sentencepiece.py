"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut before each run of spaces into words, which no piece of the vocabulary crosses. The distinct words of a
batch are grouped by length; words of one length advance together, one column at a time: hashes of their substrings
probe the sorted hashes of the pieces, and vectorised maxima over the piece lengths store backpointers. The result is
the best-scored segmentation under the model's piece scores (a unigram search over the model's pieces; ties go to the
longer last piece). Characters without a piece fall back to their bytes, or to the unknown piece where the model has no
byte pieces; decoding then restores the text exactly.

Normalisation is the model's: identity, a space put in front, spaces written as U+2581. Other normalisers are refused.

Defined cases: a null text gives null ids, an empty one no ids; very long words advance like others, in their own
group, and a very long text is encoded alone; a literal U+2581 in a text decodes as a space (the vocabulary cannot tell
them apart), and round_trip is then false; bytes that are no UTF-8 become byte pieces; repeated rows repeat; an empty
table gives an empty result; other columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, slices, small_batches, with_row

SPACE = "▁"
#: Types of pieces in the public model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of a generation; a worker remembers the last two. Longer words are not remembered.
MEMORY, LONGEST = 150_000, 32
#: Places of words that advance together, at most (one longer word makes a group of its own).
GROUP = 1 << 17
#: Bytes of texts that are encoded together (one longer text goes alone).
SLICE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    prefix: bool  # a space is put in front

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, types, prefix = [], [], [], True
        for field, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                pieces.append(piece)
                scores.append(score)
                types.append(kind)
            elif field == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only models with the identity normaliser that keep all spaces are supported")
                prefix = bool(rules.get(3, 1))
        return cls(pieces, np.array(scores), np.array(types), prefix)


class Coder:
    """Encodes and decodes with one model; built once a task."""

    def __init__(self, model: Model):
        self.model, self.known, self.before, self.held = model, {}, {}, 0
        ids = [i for i, t in enumerate(model.types) if t in (NORMAL, USER) and model.pieces[i]]
        if any(SPACE in model.pieces[i].lstrip(SPACE) for i in ids):
            raise ValueError("a piece holds a space after another character, so words cannot be cut at spaces")
        by_size: dict[int, list[int]] = {}
        for i in ids:
            by_size.setdefault(len(model.pieces[i]), []).append(i)
        self.points = np.zeros((len(model.pieces), max(by_size)), np.uint32)  # to make sure of a match
        for size, own in by_size.items():
            self.points[own, :size] = np.frombuffer("".join(model.pieces[i] for i in own).encode("utf-32-le"), np.uint32).reshape(-1, size)
        keys = np.concatenate([self._hash(self.points[own, :size].astype(np.uint64)) for size, own in by_size.items()])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.concatenate(list(by_size.values()))[order].astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.shift = np.uint64(64 - 22)  # most probes end at a bit map of the keys' top bits
        self.present = np.zeros(1 << 22, bool)
        self.present[self.keys >> self.shift] = True
        self.scores = model.scores[self.ids]
        self.sizes = sorted(by_size)
        self.byte = {int(model.pieces[i][1:-1], 16): i for i, t in enumerate(model.types) if t == BYTE}
        self.unknown = next(i for i, t in enumerate(model.types) if t == UNKNOWN)
        self.worst = model.scores[model.types == NORMAL].min() - 10
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(model.pieces, model.types, strict=True)]

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        """Of equally long rows."""
        h = np.zeros(len(points), np.uint64)
        for c in range(points.shape[1]):
            h = h * _MULTIPLIER + points[:, c] + np.uint64(1)
        return Coder._key(h, np.uint64(points.shape[1]))

    @staticmethod
    def _key(rolling: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Equal only for equal rolling hashes and lengths, or by chance; the top bits are the best mixed."""
        return (rolling ^ (rolling >> np.uint64(32)) ^ (length << np.uint64(50))) * np.uint64(0xBF58476D1CE4E5B9)

    def _search(self, points: np.ndarray) -> list[bytes]:
        """points: code points of words of one length, a row each. Returns each word's ids, as the bytes of 32-bit integers."""
        n, length = points.shape
        wide = points.T.astype(np.uint64) + np.uint64(1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
        rolling = np.zeros((length, n), np.uint64)  # of the substring that starts at a place, as far as it has come
        for end in range(1, length + 1):
            # A character without a piece is the last resort.
            best[end], back[end], piece[end] = best[end - 1] + self.worst, end - 1, -1
            live = rolling[max(0, end - self.sizes[-1]) : end]
            live *= _MULTIPLIER
            live += wide[end - 1]
            starts = np.array([end - s for s in self.sizes if s <= end])
            probes = self._key(rolling[starts], (end - starts).astype(np.uint64)[:, None]).ravel()
            hit = np.flatnonzero(self.present[probes >> self.shift])
            probe = probes[hit]
            at = np.searchsorted(self.keys, probe)
            true = self.keys[np.minimum(at, len(self.keys) - 1)] == probe
            hit, at = hit[true], at[true]
            cuts = np.searchsorted(hit, np.arange(len(starts) + 1) * n).tolist()
            for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):  # from short to long pieces, so that ties go to the longer
                if a < b:
                    word, own = hit[a:b] - r * n, at[a:b]
                    value = best[starts[r], word] + self.scores[own]
                    better = np.flatnonzero(value >= best[end, word])
                    word = word[better]
                    best[end, word], back[end, word], piece[end, word] = value[better], starts[r], self.ids[own[better]]
        return self._paths(points, back, piece)

    def _paths(self, points: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[bytes]:
        n, length = points.shape
        every, at, out = np.arange(n), np.full(n, length), []
        while (at > 0).any():  # all words step back together
            live = at > 0
            ids = np.where(live, piece[at, every], -2)
            before = np.where(live, back[at, every], 0)
            out.append((ids, before, at))
            at = before
        columns, places = (np.stack([c[k] for c in out[::-1]], 1) for k in (0, 1))
        there = columns != -2
        flat, ends = columns[there].astype(np.int32).tobytes(), (4 * there.sum(1).cumsum()).tolist()
        found = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if (lacking := np.flatnonzero((columns == -1).any(1))).size:
            for row in lacking.tolist():
                ids = self._fall_back(points[row], columns[row][there[row]].tolist(), places[row][there[row]].tolist())
                found[row] = np.array(ids, np.int32).tobytes()
        # A hash that fits is not yet a piece that fits. A piece that no path took has changed nothing.
        row, step = np.nonzero(columns >= 0)
        ids, start = columns[row, step], places[row, step]
        own = np.stack([c[2] for c in out[::-1]], 1)[row, step] - start
        for c in range(self.sizes[-1]):
            inside = np.flatnonzero(own > c)
            wrong = points[row[inside], start[inside] + c] != self.points[ids[inside], c]
            for r in set(row[inside[wrong]].tolist()):
                found[r] = self._plain(points[r])
        return found

    def _plain(self, points: np.ndarray) -> bytes:
        """One word by comparing strings, for a word that shares a hash with a piece that it does not hold."""
        word = "".join(map(chr, points.tolist()))
        known = {self.model.pieces[i]: (i, self.model.scores[i]) for i in self.ids.tolist()}
        best = [(0.0, 0, -2)]
        for end in range(1, len(word) + 1):
            way = (best[end - 1][0] + self.worst, end - 1, -1)
            for size in self.sizes:
                if size <= end and (own := known.get(word[end - size : end])) and best[end - size][0] + own[1] >= way[0]:
                    way = (best[end - size][0] + own[1], end - size, own[0])
            best.append(way)
        ids, places, at = [], [], len(word)
        while at:
            _, at, i = best[at]
            ids.insert(0, i)
            places.insert(0, at)
        return np.array(self._fall_back(points, ids, places), np.int32).tobytes()

    def _fall_back(self, points: np.ndarray, ids: list[int], places: list[int]) -> list[int]:
        """Puts bytes, or one unknown piece for neighbouring characters, where a character has no piece (-1)."""
        found: list[int] = []
        missing = False
        for i, p in zip(ids, places, strict=True):
            if i >= 0:
                found.append(i)
            elif self.byte:
                found += [self.byte[b] for b in chr(int(points[p])).encode(errors="surrogateescape")]
            elif not missing:
                found.append(self.unknown)
            missing = i < 0
        return found

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, own in by_length.items():
            step = max(1, GROUP // length)
            for s in range(0, len(own), step):
                part = own[s : s + step]
                points = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                self.known.update(zip(part, self._search(points), strict=True))

    def cut(self, text: str) -> list[str]:
        """Words, each with the spaces before it."""
        marked = text.replace(" ", SPACE)
        if self.model.prefix and text:
            marked = SPACE + marked
        parts = marked.split(SPACE)
        if "" not in parts[1:]:
            return [*parts[:1], *[SPACE + p for p in parts[1:]]] if parts[0] else [SPACE + p for p in parts[1:]]
        words, spaces = [parts[0]] if parts[0] else [], 0
        for part in parts[1:]:
            spaces += 1
            if part:
                words.append(SPACE * spaces + part)
                spaces = 0
        if spaces:
            words.append(SPACE * spaces)
        return words

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return [None if ids is None else np.frombuffer(ids, np.int32).tolist() for ids in self.encode_packed(texts)]

    def encode_packed(self, texts: list[str | None]) -> list[bytes | None]:
        """Each text's ids, as the bytes of 32-bit integers."""
        if self.held > MEMORY:
            self.known, self.before, self.held = {}, self.known, 0
        cut = [None if t is None else self.cut(t) for t in texts]
        known, before = self.known, self.before
        new: set[str] = set()
        for own in cut:
            if own:
                new.update(set(own).difference(known))
        if before:
            known.update({w: before[w] for w in new if w in before})
            new.difference_update(known)
        self._learn(new)
        out = [None if own is None else b"".join(map(known.__getitem__, own)) for own in cut]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        self.held = len(known)
        return out

    def decode(self, rows: list[list[int] | None]) -> list[str | None]:
        return [None if t is None else t.decode(errors="replace") for t in self.decode_bytes(rows)]

    def decode_bytes(self, rows: list[list[int] | None]) -> list[bytes | None]:
        out, pieces = [], self.bytes_of
        for ids in rows:
            data = None if ids is None else b"".join(map(pieces.__getitem__, ids))
            out.append(data[1:] if data and self.model.prefix and data[:1] == b" " else data)
        return out


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Model.parse(model.value))
        for batch in slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            ids = coder.encode_packed([None if t is None else t.decode(errors="surrogateescape") for t in texts])
            flat = np.frombuffer(b"".join(filter(None, ids)), np.int32)
            count = [None if i is None else len(i) // 4 for i in ids]
            offsets = np.r_[0, np.cumsum([n or 0 for n in count])].astype(np.int32)
            back = coder.decode_bytes([None if i is None else np.frombuffer(i, np.int32).tolist() for i in ids])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([i is None for i in ids]))
            same = [None if t is None else t == b for t, b in zip(texts, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(count, pa.int64()), pa.array(same, pa.bool_())], names=["row", "ids", "n_tokens", "round_trip"])

    return run


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns row (the columns ``keep``, by default all but the text), ids, n_tokens and round_trip (decoding gave the text back).

    The model's bytes are broadcast; the size of a vocabulary does not depend on the data.
    """
    small_batches(docs.sparkSession)
    data = docs.select(packed(keep or [c for c in docs.columns if c != text]), F.col(quoted(text)).cast("binary").alias("data"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return data.mapInArrow(_encode(sent), with_row(data, "ids array<int>, n_tokens long, round_trip boolean"))


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Model.parse(model.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode(batch.column(1).to_pylist()), pa.string())], names=["row", "text"])

    return run


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Returns row (all columns but the ids) and text; null ids give null."""
    data = encoded.select(packed([c for c in encoded.columns if c != ids]), F.col(quoted(ids)))
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    return data.mapInArrow(_decode(sent), with_row(data, "text string"))
