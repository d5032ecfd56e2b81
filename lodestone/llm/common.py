"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Java regular expression of a word: anything but the ASCII white space that ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def small_batches(spark: SparkSession, most: int = 1 << 23) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, unless the session's bound is smaller."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(most + 1)).rstrip("bB")) > most:
        spark.conf.set(name, str(most))


class Stash:
    """Tables written to the shared folder to cut lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        self.path_of: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        self._write(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.path_of[id(out)] = path
        return out

    def _write(self, df: DataFrame, path: str) -> None:
        """Nothing reads the shuffle files of a written table again: they go with the write, not when the driver next
        collects garbage. The setting holds for this write only, as other results may be read twice."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(name, was) if was is not None else self.spark.conf.unset(name)

    def drop(self, *saved: DataFrame) -> None:
        """Deletes tables that nothing lazily reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(self.path_of.pop(id(df)))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast(spark: SparkSession, value: object) -> Broadcast:
    """Of a value of bounded size, with its class's code, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column's name as Spark resolves it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def packed(names: list[str]) -> F.Column:
    """A struct ``row`` of the columns so named; without any, of one null, as a struct needs a field."""
    return F.struct(*[F.col(quoted(n)).alias(n) for n in names] or [F.lit(None).cast("int").alias("none")]).alias("row")


def with_row(data: DataFrame, ddl: str) -> StructType:
    """The schema of ``data``'s column row and further fields."""
    return StructType([data.schema["row"], *StructType.fromDDL(ddl).fields])


def utf8(column: str = "text") -> F.Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(quoted(column)).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the binary column of each holds about ``most`` bytes, whatever the lengths of its texts."""
    for batch in batches:
        at, total = 0, np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """For each start of a window of ``width`` values, the leftmost place of its least value; by doubling."""
    n = len(value) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, least, span = np.arange(len(value), dtype=np.int32), value, 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] < least[: len(least) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        least = np.where(right, least[step:], least[: len(least) - step])
        span += step
    return at[:n]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones merge."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > end[:-1]]
    return start[first], end[np.r_[np.flatnonzero(first)[1:] - 1, len(end) - 1]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, least node of its component) that connect what the given edges connect."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all() and (root[x] == root[y]).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
