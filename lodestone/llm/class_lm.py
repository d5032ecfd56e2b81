"""LM scoring with Brown class-based bigrams.

P(word | words before) = P(class | class before) * P(word | class). Exchange clustering assigns words to classes: every
word moves to the class that raises the likelihood of the training classes' bigrams most. All words of the training texts
are clustered, in two steps. First the classes take shape: one pass over the corpus counts the bigrams of items, where an
item is one of the ITEMS most frequent words or, for all other words, one of BUCKETS groups by word ending. From that
table each sweep aggregates every item's class contexts, which are small whatever the corpus, and the exchanges of the
sweep are decided on the driver. The CORE most frequent items go first, over their own table of bigrams, so that their
contexts follow every move; later sweeps move the others, then halves of all items, so that moves rest on contexts that
hold. Then every other word leaves its group: its own contexts, counted over the whole corpus and dealt out by word, move
it to the class of the highest likelihood against the table of classes. So what is gathered grows with the vocabulary, and
nothing of it but the TOP words' classes comes to the driver. A pair of two such words counts half with the group of the
first, half with that of the second.

Smoothing: class transitions back off to class frequencies (BACKOFF pseudo counts); a class emits a word of training
count c with (c + 0.5) / (class tokens + 0.5 * (class words + 1)), where the last half count is for words not seen in
training: those belong to the class that holds most training words of their ending's group. For every class before,
probabilities of all known words and of each class's unknown word add up to one.

Every text is lower-cased (A-Z), cut at ASCII white space and closed by an end token, which also stands before the first.

Defined cases: a null or blank text is the end token alone; without training texts all counts are zero and every word is
unknown; a null id trains; rows that repeat an id are further documents; very long texts and words count like others (a
word longer than LONGEST bytes is looked up by a join, however frequent); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, broadcast, partitions, quoted, received, slices, utf8, with_row

#: Classes; words that are items of their own while classes take shape; groups of the other words by ending; sweeps.
CLASSES, ITEMS, BUCKETS, SWEEPS = 48, 4096, 256, 5
#: Most frequent items whose exchange runs over their full table of bigrams, on the driver, and its rounds.
CORE, ROUNDS = 768, 6
#: Words whose counts go to every task, and the longest such word in bytes: a bound of TOP * LONGEST bytes. The counts of
#: all other words are joined.
TOP, LONGEST = 1 << 17, 64
#: Pseudo counts of a class's transitions; bytes of a word's ending.
BACKOFF, ENDING = 50.0, 3
#: The end of a text, which no word can be.
END = b"\n"
#: Words or bigrams that a task holds before it passes partial counts on.
HELD = 400_000
#: Bytes of texts whose tokens a task holds as objects.
SLICE = 1 << 19


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def bucket_of(word: bytes) -> int:
    return ITEMS + crc32(word[-ENDING:]) % BUCKETS


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in slices(batches, 0, SLICE):
        for text in batch.column(0).to_pylist():
            held.update(tokens(text))
        if len(held) > HELD:
            yield send()
    yield send()


def word_counts(train: DataFrame) -> DataFrame:
    """train: data binary. Returns word, n."""
    return train.select("data").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    """Words to items or groups; words that are met get their group once, until too many are remembered."""

    def __init__(self, items: dict[bytes, int]):
        super().__init__(items)
        self.items_ = items

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.items_) + HELD // 4:
            self.clear()
            self.update(self.items_)
        self[word] = number = bucket_of(word)
        return number


def flat(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, where each text starts, and each token's neighbours; a text's ends are neighbours, too."""
    words: list[bytes] = []
    ends = [0]
    for text in texts:
        words += tokens(text)
        ends.append(len(words))
    ends = np.array(ends)
    before, after = np.arange(len(words)) - 1, np.arange(len(words)) + 1
    before[ends[:-1]], after[ends[1:] - 1] = ends[1:] - 1, ends[:-1]
    return words, ends[:-1], before, after


def _bigrams(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, size = Numbers(received(known)), ITEMS + BUCKETS
        held: list[np.ndarray] = []
        waiting = 0

        def send() -> pa.RecordBatch:
            code = np.concatenate(held or [np.empty(0, np.int32)])
            held.clear()
            code.sort()
            first = np.flatnonzero(np.r_[code[:1] >= 0, code[1:] != code[:-1]])
            code, n = code[first].astype(np.int64), np.diff(np.r_[first, len(code)])
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

        for batch in slices(batches, 0, SLICE):
            words, _, before, _ = flat(batch.column(0).to_pylist())
            own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            held.append(own[before] * np.int32(size) + own)  # the end also stands before the first
            waiting += len(own)
            if waiting > 8 * HELD:
                waiting = 0
                yield send()
        yield send()

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _move(table: np.ndarray, x: np.ndarray, y: np.ndarray, was: int) -> int:
    """Takes an item with contexts x (classes before) and y (after) out of its class, finds its best class, puts it in."""
    table[:, was] -= x
    table[was, :] -= y
    np.maximum(table, 0, out=table)
    rows, columns = table.sum(1), table.sum(0)
    # The gain of class c: its column takes x, its row takes y, and so do the sums they are divided by.
    gain = (_f(table + x[:, None]) - _f(table)).sum(0) + (_f(table + y[None, :]) - _f(table)).sum(1)
    gain -= _f(columns + x.sum()) - _f(columns) + _f(rows + y.sum()) - _f(rows)
    to = int(np.argmax(gain))
    if gain[to] <= gain[was] + 1e-9:
        to = was
    table[:, to] += x
    table[to, :] += y
    return to


def exchange_core(counts: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """The exchange over items whose bigram counts are all at hand: contexts follow every move."""
    m = len(counts)
    classes = np.arange(m) % k
    one = np.eye(k)[classes]
    left, right = counts.T @ one, counts @ one
    table = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in np.argsort(-counts.sum(0), kind="stable").tolist():
            was = classes[w]
            to = _move(table, left[w].copy(), right[w].copy(), was)
            if to != was:
                moved += 1
                classes[w] = to
                left[:, was] -= counts[w]
                left[:, to] += counts[w]
                right[:, was] -= counts[:, w]
                right[:, to] += counts[:, w]
                table = np.eye(k)[classes].T @ right
        if moved <= m // 100:
            break
    return classes


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """left, right: tokens of each item by the class before and after. Returns new classes; items move one by one."""
    k, classes = left.shape[1], classes.copy()
    table = np.zeros((k, k))
    np.add.at(table, classes, right)
    for w in movable[np.argsort(-left[movable].sum(1), kind="stable")].tolist():
        if left[w].any() or right[w].any():
            classes[w] = _move(table, left[w], right[w], classes[w])
    return classes


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to what no assignment changes."""
    def f(x):
        return float((x[x > 0] * np.log(x[x > 0])).sum())

    return f(table) - f(table.sum(0)) - f(table.sum(1))


def _contexts(bigrams: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each item by the class before and after it: at most items times classes rows come to the driver."""
    size = ITEMS + BUCKETS
    table = F.from_json(F.lit(str(classes.tolist())), "array<int>")  # one literal, folded before the query runs
    pair = bigrams.select(F.floor(F.col("code") / size).cast("int").alias("i"), (F.col("code") % size).cast("int").alias("j"), "n")
    pair = pair.select("i", "j", F.element_at(table, F.col("i") + 1).alias("ci"), F.element_at(table, F.col("j") + 1).alias("cj"), "n")
    out = []
    for item, context in (("j", "ci"), ("i", "cj")):
        found = pair.groupBy(item, context).agg(F.sum("n").alias("n")).toArrow()
        m = np.zeros((size, CLASSES))
        m[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy()
        out.append(m)
    return out[0], out[1]


#: A context is the classes before and after; those of words that are no items, so far of their group, are CLASSES higher.
_SIDES = 2 * CLASSES
_CONTEXTS = pa.schema([("word", pa.binary()), ("at", pa.binary())])
#: Contexts that a task holds before it passes them on.
CONTEXTS = 1 << 20


def _word_contexts(sent):
    """A row for each word but the items and each stretch of a task's texts: its contexts there, as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, classes = received(sent)
        top = np.array([classes[i] if i < ITEMS else classes[bucket_of(w)] + CLASSES for i, w in enumerate(words)], np.int64)
        local: dict[bytes, int] = {}  # words that have no number
        sides: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def send() -> pa.RecordBatch:
            number, at = (np.concatenate(c) for c in zip((np.empty(0, np.int32), np.empty(0, np.uint16)), *held, strict=True)) if held else (np.empty(0, np.int32), np.empty(0, np.uint16))
            held.clear()
            order = np.argsort(number, kind="stable")
            number, at = number[order], at[order]
            first = np.flatnonzero(np.r_[number[:1] >= 0, number[1:] != number[:-1]])
            names = list(local)
            own = [words[i] if i < len(words) else names[i - len(words)] for i in number[first].tolist()]
            ends = np.r_[first, len(number)].astype(np.int32) * 2
            blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(at.tobytes())])
            local.clear()
            sides.clear()
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), blob], schema=_CONTEXTS)

        for batch in slices(batches, 0, SLICE):
            own, _, before, after = flat(batch.column(0).to_pylist())
            number = np.fromiter(map(ids.get, own, repeat(-1)), np.int32, len(own))
            for i in np.flatnonzero(number < 0).tolist():
                w = own[i]
                k = local.get(w)
                if k is None:
                    k = local[w] = len(local)
                    sides.append(classes[bucket_of(w)] + CLASSES)
                number[i] = len(words) + k
            side = np.r_[top, np.array(sides, np.int64)][number]
            loose = np.flatnonzero(number >= ITEMS)
            held.append((number[loose], (side[before[loose]] * _SIDES + side[after[loose]]).astype(np.uint16)))
            waiting += len(loose)
            if waiting > CONTEXTS:
                waiting = 0
                yield send()
        yield send()

    return run


_LEXICON = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("class", pa.int32()), ("x", pa.float64())])
_LEXICON_SQL = "word binary, n long, class int, x double"


def _assign(sent):
    """Contexts sorted by word -> each word's count and class; at the end, without word, what the task's words add to the table of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, tokens_of = received(sent)
        before = np.tile(transition - np.log(tokens_of)[None, :], (2, 1))  # by side before and class
        after = np.tile(transition.T, (2, 1))  # by side after and class
        table = np.zeros(CLASSES * CLASSES)
        share = np.repeat([1.0, 0.5], CLASSES)
        last, sums = None, np.zeros((2, _SIDES), np.int64)  # a word that may go on, and its sides so far

        def finish() -> pa.RecordBatch:
            c = int((sums[0] @ before + sums[1] @ after).argmax())
            side = np.arange(_SIDES) % CLASSES
            np.add.at(table, side * CLASSES + c, sums[0] * share)
            np.add.at(table, c * CLASSES + side, sums[1] * share)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([int(sums[0].sum())]), pa.array([c], pa.int32()), pa.nulls(1, pa.float64())], schema=_LEXICON)

        for batch in batches:
            if not batch.num_rows:
                continue
            word, size = batch.column(0), pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 2
            at = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.int64)
            b, a = at // _SIDES, at % _SIDES
            first = np.flatnonzero(np.r_[True, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)])
            begin = (np.cumsum(size) - size)[first]
            ends = np.r_[begin[1:], len(at)]
            if word[0].as_py() != last and last is not None:
                yield finish()
                sums[:] = 0
            if len(first) > 1:
                group = np.repeat(np.arange(len(first) - 1), (ends - begin)[:-1])
                value = np.zeros((len(first) - 1, CLASSES))
                value[0] = sums[0] @ before + sums[1] @ after
                for s in range(0, len(group), 1 << 15):
                    g = group[s : s + (1 << 15)]
                    cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                    value[g[cut]] += np.add.reduceat(before[b[s : s + len(g)]] + after[a[s : s + len(g)]], cut, axis=0)
                own = value.argmax(1)
                c, m = own[group], len(group)
                table += np.bincount(b[:m] % CLASSES * CLASSES + c, share[b[:m]], CLASSES**2) + np.bincount(c * CLASSES + a[:m] % CLASSES, share[a[:m]], CLASSES**2)
                side = np.arange(_SIDES) % CLASSES
                np.add.at(table, side * CLASSES + own[0], sums[0] * share)
                np.add.at(table, own[0] * CLASSES + side, sums[1] * share)
                n = (ends - begin)[:-1]
                n[0] += sums[0].sum()
                sums[:] = 0
                yield pa.RecordBatch.from_arrays([word.take(pa.array(first[:-1])), pa.array(n), pa.array(own.astype(np.int32)), pa.nulls(len(own), pa.float64())], schema=_LEXICON)
            last = word[int(first[-1])].as_py()
            sums += np.stack([np.bincount(x[begin[-1] :], minlength=_SIDES) for x in (b, a)])
        if last is not None:
            yield finish()
        code = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.nulls(len(code), pa.int64()), pa.array(code.astype(np.int32)), pa.array(table[code])], schema=_LEXICON)

    return run


@dataclass
class Model:
    counts: dict[bytes, tuple[int, int]]  # of the TOP words: training count and class
    bucket_class: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 of what a class's counts are divided by
    tokens: int
    words: int


def _smoothed(table: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    prior = (size + 1) / (n + CLASSES)
    return (table + BACKOFF * prior) / (table.sum(1, keepdims=True) + BACKOFF)


def _items(bigrams: DataFrame) -> np.ndarray:
    """Classes of the items and groups."""
    size = ITEMS + BUCKETS
    pair = bigrams.select(F.floor(F.col("code") / size).cast("int").alias("i"), (F.col("code") % size).cast("int").alias("j"), "n")
    core = pair.where((F.col("i") < CORE) & (F.col("j") < CORE)).toArrow()  # CORE squared rows at most
    dense = np.zeros((CORE, CORE))
    dense[core.column(0).to_numpy(), core.column(1).to_numpy()] = core.column(2).to_numpy()
    now = np.r_[exchange_core(dense, CLASSES), np.arange(CORE, size) % CLASSES]
    best, best_score = now, -np.inf
    for sweep in range(SWEEPS + 1):
        left, right = _contexts(bigrams, now)
        table = np.zeros((CLASSES, CLASSES))
        np.add.at(table, now, right)
        if (score := likelihood(table)) > best_score:
            best, best_score = now, score
        if sweep < SWEEPS:
            item = np.arange(size)  # first all but the core, then halves
            now = exchange(left, right, now, item[item >= CORE] if not sweep else item[(item * 40503 >> 7) % 2 == sweep % 2])
    return best


def _table(bigrams: DataFrame, classes: np.ndarray, items: bool) -> np.ndarray:
    """The class bigrams of items alone, or with the groups of other words."""
    size, table = ITEMS + BUCKETS, np.zeros((CLASSES, CLASSES))
    of = F.from_json(F.lit(str(classes.tolist())), "array<int>")
    pair = bigrams.select(F.floor(F.col("code") / size).cast("int").alias("i"), (F.col("code") % size).cast("int").alias("j"), "n")
    pair = pair.where((F.col("i") < ITEMS) & (F.col("j") < ITEMS)) if items else pair
    for i, j, n in pair.groupBy(F.element_at(of, F.col("i") + 1).alias("ci"), F.element_at(of, F.col("j") + 1).alias("cj")).agg(F.sum("n")).collect():
        table[i, j] = n
    return table


def train(docs: DataFrame, stash: Stash) -> tuple[Model, DataFrame]:
    """docs: data binary. Returns the model and all words with count and class (word, n, class)."""
    spark = docs.sparkSession
    counts = stash.save(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(TOP).toArrow()
    stash.drop(counts)
    words, often = [bytes(w) for w in top.column(0).to_pylist()], top.column(1).to_pylist()
    sent = broadcast(spark, {w: i for i, w in enumerate(words[:ITEMS])})
    bigrams = stash.save(docs.select("data").mapInArrow(_bigrams(sent), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    classes = _items(bigrams)
    shape = _table(bigrams, classes, items=False)
    sent = broadcast(spark, ({w: i for i, w in enumerate(words)}, words, classes))
    loose = docs.select("data").mapInArrow(_word_contexts(sent), "word binary, at binary").repartition(partitions(spark), "word").sortWithinPartitions("word")
    sent = broadcast(spark, (np.log(_smoothed(shape, shape.sum(0), n)), shape.sum(0) + 1))
    found = stash.save(loose.mapInArrow(_assign(sent), _LEXICON_SQL))
    table = _table(bigrams, classes, items=True)
    for code, x in found.where("word is null").groupBy("class").agg(F.sum("x")).collect():
        table.ravel()[code] += x
    stash.drop(bigrams)
    items = spark.createDataFrame([(w, c, int(k)) for w, c, k in zip(words[:ITEMS], often, classes, strict=False)], "word binary, n long, class int")
    lexicon = found.where("word is not null").select("word", "n", "class").unionByName(items)
    return _model(lexicon, words, classes, table, n, v), lexicon


def _ending(word: str) -> F.Column:
    return F.pmod(F.crc32(F.expr(f"substring({word}, greatest(length({word}) - {ENDING - 1}, 1), {ENDING})")), F.lit(BUCKETS)).cast("int")


def _model(lexicon: DataFrame, words: list[bytes], classes: np.ndarray, table: np.ndarray, n: int, v: int) -> Model:
    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    members = np.zeros((BUCKETS, CLASSES))
    for b, c, tokens_, types_ in lexicon.groupBy(_ending("word"), "class").agg(F.sum("n"), F.count("*")).collect():
        size[c] += tokens_
        types[c] += types_
        members[b, c] = types_
    top = lexicon.join(F.broadcast(lexicon.sparkSession.createDataFrame([(w,) for w in words], "word binary")), "word").toArrow()
    counts = {bytes(w): (c, k) for w, c, k in zip(*(top.column(x).to_pylist() for x in ("word", "n", "class")), strict=True)}
    # A group without words keeps the class that it had among the items.
    bucket_class = np.where(members.any(1), members.argmax(1), classes[ITEMS:])
    return Model(counts, bucket_class, np.log10(_smoothed(table, size, n)), np.log10(size + 0.5 * (types + 1)), n, v)


_SCORED = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("counts", pa.float64()), ("classes", pa.binary()), ("rare", pa.list_(pa.binary()))])


def _look_up(sent):
    """Counts and classes of the TOP words; of any other the number -1 - k, where it is the text's k-th such word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = received(sent)
        ids = {w: i for i, w in enumerate(known)}
        value = np.array([*known.values(), (0, 0)], np.int64)
        log, class_of = np.log10(value[:, 0] + 0.5), value[:, 1].astype(np.int32)
        for batch in slices(batches, 1, SLICE):
            rows = []
            words, starts, _, _ = flat(batch.column(1).to_pylist())
            number = np.fromiter(map(ids.get, words, repeat(-1)), np.int64, len(words))
            classes, value_of = class_of[number], np.where(number >= 0, log[number], 0.0)
            loose = np.flatnonzero(number < 0)
            cuts = np.searchsorted(loose, np.r_[starts, len(words)]).tolist()
            loose = loose.tolist()
            for a, b, s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(words)], cuts[:-1], cuts[1:], strict=True):
                rare: dict[bytes, int] = {}
                own = loose[s:e]
                if own:
                    classes[own] = [-1 - rare.setdefault(words[i], len(rare)) for i in own]
                rows.append((b - a, b - a - (e - s), float(value_of[a:b].sum()), classes[a:b].tobytes(), list(rare)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, _SCORED, strict=True))], names=["row", *_SCORED.names])

    return run


def _finish(sent):
    """row, n_tokens, n_known, counts, classes, found (k, n and class of the rare words) -> the sums of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, emission = received(sent)
        fixed = transition - emission[None, :]
        for batch in slices(batches, 4):
            size = pc.fill_null(pc.list_value_length(batch.column(5)), 0).to_numpy(zero_copy_only=False)
            k, n, c = (x.to_numpy(zero_copy_only=False) for x in pc.list_flatten(batch.column(5)).flatten())
            ends = np.cumsum(size)
            known, counts = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
            score = np.zeros(len(size))
            for i, (a, b, data) in enumerate(zip((ends - size).tolist(), ends.tolist(), batch.column(4).to_pylist(), strict=True)):
                classes = np.frombuffer(data, np.int32)
                if b > a:
                    of, often = np.empty(b - a, np.int32), np.empty(b - a, np.int64)
                    of[k[a:b]], often[k[a:b]] = c[a:b], n[a:b]
                    loose = np.flatnonzero(classes < 0)
                    number = -1 - classes[loose]
                    classes = classes.copy()
                    classes[loose] = of[number]
                    often = often[number]
                    known[i] += int((often > 0).sum())
                    counts[i] += np.log10(often + 0.5).sum()
                score[i] = counts[i] + fixed[np.r_[classes[-1], classes[:-1]], classes].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(known), pa.array(counts), pa.array(score)], names=["row", "n_tokens", "n_known", "counts", "score"])

    return run


def score(docs: DataFrame, stash: Stash, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the documents that are not held out and scores all: see op1's columns.

    Held out is a document whose crc32 of the id as text, modulo 5, is 1.
    """
    own = F.col(quoted(doc_id))
    held = F.coalesce(F.crc32(own.cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model, lexicon = train(docs.where(~held).select(utf8(text).alias("data")), stash)
    row = F.struct(own.alias("doc_id"), held.alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    data = docs.select(row.alias("row"), utf8(text).alias("data"))
    sent = broadcast(docs.sparkSession, model.counts)
    found = stash.save(data.mapInArrow(_look_up(sent), with_row(data, "n_tokens long, n_known long, counts double, classes binary, rare array<binary>"))).withColumn("rid", F.col("row.rid"))
    rare = found.select("rid", F.posexplode("rare").alias("k", "word"))
    unseen = F.element_at(F.from_json(F.lit(str(model.bucket_class.tolist())), "array<int>"), _ending("word") + 1)
    joined = rare.join(lexicon, "word", "left").select("rid", F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", unseen).alias("class")).alias("x"))
    whole = found.drop("rare").join(joined.groupBy("rid").agg(F.collect_list("x").alias("found")), "rid", "left")
    sent = broadcast(docs.sparkSession, (model.transition, model.emission))
    done = whole.select("row", "n_tokens", "n_known", "counts", "classes", "found")
    done = done.mapInArrow(_finish(sent), with_row(done, "n_tokens long, n_known long, counts double, score double"))
    base = F.col("counts") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + 0.5 * (model.words + 1))))
    return done.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(int(model.tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
