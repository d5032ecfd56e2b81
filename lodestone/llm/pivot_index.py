"""Embedding near-dedup with a pivot-permutation index.

Each vector is described by its PREFIX nearest reference points out of PIVOTS. Inverted lists, one for each SHARED of
those points together, bring together just the vectors whose descriptions share at least SHARED pivots; each pair is
counted in one list only, that of its least shared pivots. What travels to the lists is the description and a sketch of
SKETCH bytes: the vector's projections on as many orthonormal directions, cut to bytes. Projections never lie further
apart than the vectors do, so sketches too far apart (rounding allowed for) rule a pair out and lose none. Only vectors
that have a partner left in a list travel there themselves; pairs are verified by cosine in double precision.

Equal unit vectors of a batch collapse to one, which stands for them by its weight. Lists of more than BUCKET vectors are
split into blocks, a task for each two blocks.

Near vectors nearly always share pivots: for cosines of 0.98 and more the measured recall of links is above 0.99
(tests hold it against brute force).

Defined cases: a null label links with nothing, nor do vectors that are null, empty, zero or hold null or non-finite
components, or vectors of another dimension; such rows return with no links and themselves as component. Rows that
repeat an id are vectors of their own and link like others. A null id is never a component's least member; a component
without ids has a null one and is not kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, forest, partitions, quoted
from .components import components
from .vectors import matrices

#: Reference points; the nearest ones that describe a vector; those that two descriptions must share.
PIVOTS, PREFIX, SHARED = 128, 6, 3
#: Projections of a sketch, and the steps into which the unit length is cut.
SKETCH, STEPS = 16, 127
#: Vectors of one list that are compared in one task.
BUCKET = 1024
_TRIPLES = np.array(list(itertools.combinations(range(PREFIX), SHARED)))
_LISTED = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("near", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_LEFT = pa.schema([("key", pa.int64()), ("rid", pa.int64()), ("near", pa.int64()), ("hot", pa.bool_())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_FOUND_SQL = "a long, b long, n long"


def pivots(dim: int) -> np.ndarray:
    """Random directions, the same everywhere: nothing needs to be sampled or sent."""
    p = np.random.default_rng(dim).standard_normal((PIVOTS, dim))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def directions(dim: int) -> np.ndarray:
    """Orthonormal columns, the same everywhere."""
    return np.linalg.qr(np.random.default_rng(dim + 1).standard_normal((dim, min(SKETCH, dim))))[0]


def _collapse(dtype: str):
    """rid, vec_id, label, vector -> the row's representative, the number of vectors it stands for, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, labels = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            at, weight, data = np.arange(len(rid)), np.ones(len(rid), np.int64), [None] * len(rid)
            for rows, m in matrices(batch.column(3)):
                first: dict[tuple[int, bytes], int] = {}
                for r, x, own in zip(rows.tolist(), unit(m), m.astype(dtype), strict=True):
                    if labels[r] is not None and (f := first.setdefault((labels[r], x.tobytes()), r)) != r:
                        at[r] = f
                        weight[f] += 1
                    elif labels[r] is not None:
                        data[r] = own.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rid[at]), pa.array(weight[at]), pa.array(data, pa.binary())], names=["rid", "vec_id", "label", "rep", "weight", "data"])

    return run


def _units(data: list[bytes], dtype: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(data), dtype).reshape(len(data), -1).astype(float))


def _lists(dtype: str):
    """rid, label, data -> a row for each list that a vector is on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, label, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            size = np.array([len(d) for d in data])
            for s in np.unique(size).tolist():
                rows = np.flatnonzero(size == s)
                u = _units([data[r] for r in rows.tolist()], dtype)
                dim = u.shape[1]
                near = np.sort(np.argsort(-(u @ pivots(dim).T), axis=1, kind="stable")[:, :PREFIX], axis=1)
                packed = (near << (7 * np.arange(PREFIX))).sum(1)
                sketch = np.zeros((len(rows), SKETCH), np.int8)
                sketch[:, : min(SKETCH, dim)] = np.rint(u @ directions(dim) * STEPS)
                low, high = sketch.view("<i8").T
                for triple in _TRIPLES:
                    t = near[:, triple]
                    code = (t[:, 0] * PIVOTS + t[:, 1]) * PIVOTS + t[:, 2]
                    key = (label[rows].astype(np.int64) * 1_000_003 + dim) * PIVOTS**3 + code
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (key, rid[rows], packed, low, high)], schema=_LISTED)

    return run


def _earlier(key: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
    """Bits of each vector's pivots that would make an earlier list than its own: if two vectors share one, not this list counts them."""
    code = key % PIVOTS**3
    own = [code // PIVOTS**2, code // PIVOTS % PIVOTS, code % PIVOTS]
    words = []
    for shift in (0, 64):
        word = np.zeros(len(key), np.uint64)
        for i in range(PREFIX):
            p = near >> (7 * i) & (PIVOTS - 1)
            before = (p < own[2]) & (p != own[0]) & (p != own[1]) & (p >= shift) & (p < shift + 64)
            word |= np.where(before, np.uint64(1) << (p - shift).clip(0, 63).astype(np.uint64), np.uint64(0))
        words.append(word)
    return words


def _survivors(threshold: float, bucket: int):
    """Of lists sorted by key the vectors that have a partner there whose sketch is not too far away; of hot lists all."""
    most = (STEPS * np.sqrt(max(0.0, 2 - 2 * threshold)) + np.sqrt(SKETCH)) ** 2 + 1e-6

    def partners(key: np.ndarray, near: np.ndarray, sketch: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        found, words = np.zeros(len(key), bool), _earlier(key, near)
        end = np.repeat(first + size, size)
        d = 1
        small = np.flatnonzero(np.repeat(size <= 64, size))
        while len(small := small[small + d < end[small]]):  # members of short lists that lie d apart
            i, j = small, small + d
            gap = sketch[i] - sketch[j]
            close = np.einsum("ij,ij->i", gap, gap) <= most
            i, j = i[close], j[close]
            counted = ((words[0][i] & words[0][j]) | (words[1][i] & words[1][j])) == 0
            found[i[counted]] = found[j[counted]] = True
            d += 1
        for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
            x = sketch[a : a + n].astype(np.float32)  # whole numbers far below 2 ** 24: exact
            norm = (x * x).sum(1)
            close = norm[:, None] + norm[None, :] - 2 * (x @ x.T) <= most
            for w in words:
                own = w[a : a + n]
                close &= (own[:, None] & own[None, :]) == 0
            np.fill_diagonal(close, False)
            found[a : a + n] = close.any(1)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot_key = None, None
        for batch in itertools.chain(batches, [None]):
            columns = rest if batch is None else [c.to_numpy() for c in batch.columns]
            if batch is not None and rest is not None:
                columns = [np.r_[a, b] for a, b in zip(rest, columns, strict=True)]
            if columns is None or not len(columns[0]):
                continue
            key = columns[0]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            hot = size > bucket
            hot[0] |= hot_key is not None and key[0] == hot_key
            end = len(key) if batch is None or hot[-1] else int(first[-1])
            hot_key = key[-1] if hot[-1] else hot_key
            rest = [c[end:] for c in columns]
            whole = first < end
            first, size, hot = first[whole], size[whole], hot[whole]
            kept = np.repeat(hot, size)
            at = np.flatnonzero(np.repeat(~hot & (size > 1), size))
            if len(at):
                own = size[~hot & (size > 1)]
                sketch = np.ascontiguousarray(np.stack([c[:end][at] for c in columns[3:]], 1)).view(np.int8).reshape(len(at), SKETCH).astype(np.int32)
                kept[at] = partners(key[:end][at], columns[2][:end][at], sketch, np.cumsum(own) - own, own)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[:end][kept]) for c in columns[:3]), pa.array(np.repeat(hot, size)[kept])], schema=_LEFT)

    return run


class _List:
    """The vectors of one inverted list, or of a block of it."""

    def __init__(self, key: np.ndarray, rid: np.ndarray, near: np.ndarray, weight: np.ndarray, data: list[bytes], dtype: str):
        self.rid, self.weight, self.m, self.words = rid, weight, _units(data, dtype), _earlier(key, near)

    def links(self, other: _List, threshold: float) -> np.ndarray:
        close = self.m @ other.m.T >= threshold
        for x, y in zip(self.words, other.words, strict=True):
            if x.any() and y.any():
                close &= (x[:, None] & y[None, :]) == 0
        return close


def _rows(count: dict[int, int], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(count)
    return pa.RecordBatch.from_arrays([pa.array([*count, *a.tolist()], pa.int64()), pa.array([*[None] * n, *b.tolist()], pa.int64()), pa.array([*count.values(), *[None] * len(a)], pa.int64())], schema=_FOUND)


def _cold(threshold: float, dtype: str):
    """Lists sorted by key, label and dimension; at most a bucket is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        edges: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]

        def close(rows: pa.Table) -> None:
            key, rid, near, weight = (rows.column(c).to_numpy() for c in ("key", "rid", "near", "weight"))
            own = _List(key, rid, near, weight, rows.column("data").to_pylist(), dtype)
            hit = own.links(own, threshold)
            np.fill_diagonal(hit, False)
            if hit.any():
                for r, n in zip(rid.tolist(), (hit @ weight).tolist(), strict=True):
                    if n:
                        count[r] = count.get(r, 0) + n
                i, j = np.nonzero(np.triu(hit))
                edges.append(forest(rid[i], rid[j]))

        rest = None
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            names = [now.column(c).to_numpy() for c in ("key", "label", "dim")]
            cuts = np.r_[0, 1 + np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)), now.num_rows].tolist()
            if batch is not None:
                rest = now.slice(cuts[-2])
                cuts = cuts[:-1]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a > 1:
                    close(now.slice(a, b - a))
            if len(count) > 50_000 or len(edges) > 5_000:
                yield _rows(count, *(np.concatenate(x) for x in zip(*edges, strict=True)))
                count.clear()
                del edges[1:]
        yield _rows(count, *(np.concatenate(x) for x in zip(*edges, strict=True)))

    return run


def _hot(threshold: float, dtype: str):
    def run(frame):
        import pandas as pd

        left, right = (frame[frame.side == side] for side in (0, 1))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
        left, right = (_List(f.key.to_numpy(), f.rid.to_numpy(), f.near.to_numpy(), f.weight.to_numpy(), f.data.tolist(), dtype) for f in (left, right))
        hit = left.links(right, threshold)
        own = left.rid[:, None] == right.rid[None, :]
        within = own.any()
        hit &= ~own
        i, j = np.nonzero(hit)
        a, b = forest(left.rid[i], right.rid[j])
        counts = [(left.rid, hit @ right.weight)] + ([] if within else [(right.rid, left.weight @ hit)])
        count = {r: n for rid, ns in counts for r, n in zip(rid.tolist(), ns.tolist(), strict=True) if n}
        return _rows(count, a, b).to_pandas(integer_object_nulls=True).astype("Int64")

    return run


def linked(rows: DataFrame, threshold: float, stash: Stash, dtype: str, bucket: int = BUCKET) -> DataFrame:
    """rows: rid, label, weight, data (null where it stands for none). Returns a, b, n: either a link count of a (to be summed), or an edge of a spanning forest."""
    n = partitions(rows.sparkSession)
    lists = rows.where("data is not null").select("rid", "label", "data").mapInArrow(_lists(dtype), "key long, rid long, near long, low long, high long")
    left = stash.save(lists.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_survivors(threshold, bucket), "key long, rid long, near long, hot boolean"))
    full = left.join(rows.select("rid", "label", "weight", F.length("data").alias("dim"), "data"), "rid")
    group = ["key", "label", "dim"]
    found = full.where("not hot").repartition(n, "key").sortWithinPartitions(*group).mapInArrow(_cold(threshold, dtype), _FOUND_SQL)
    sizes = left.where("hot").groupBy("key").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / bucket).cast("int")
    dealt = full.where("hot").join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("rid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("own") > F.col("other")).cast("int")))
    dealt = dealt.select(*group, "rid", "near", "weight", "data", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.explode(side).alias("side"))
    return stash.save(found.unionByName(dealt.groupBy(*group, "i", "j").applyInPandas(_hot(threshold, dtype), _FOUND_SQL)))


def near_duplicates(df: DataFrame, stash: Stash, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", bucket: int = BUCKET) -> DataFrame:
    """Returns vec_id, n_links, component_id and kept, a row for each row."""
    dtype = "<f4" if df.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    named = df.select(F.monotonically_increasing_id().alias("rid"), F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(label)).cast("int").alias("label"), F.col(quoted(vector)).alias("vector"))
    rows = stash.save(named.mapInArrow(_collapse(dtype), "rid long, vec_id long, label int, rep long, weight long, data binary"))
    found = linked(rows, threshold, stash, dtype, bucket)
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    part = components(found.where("b is not null").select("a", "b"), stash).withColumnRenamed("node", "rep")
    joined = rows.select("vec_id", "rep", "weight").join(counts, "rep", "left").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = joined.join(least, "component")
    return out.select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
