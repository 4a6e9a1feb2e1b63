"""What the operators of this package share: tables, the shared folder, code for executors."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: Folders that new_path() named and nothing has removed yet; they go when the process ends.
_LEFT: dict[str, SparkSession] = {}
#: Row keys that may be broadcast: 48 bytes each in a hash table, 24 MB.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Functions given to mapInArrow are pickled by reference; executors that have
    no copy of the repository on their path import them from this archive. Arrow
    batches are bounded in rows and bytes, so that a Python worker never holds
    thousands of long texts at once.
    """
    for key, most in (("maxRecordsPerBatch", 8192), ("maxBytesPerBatch", 1 << 23)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="weft-"), "weft.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_HELD: dict[object, object] = {}
#: The keys that the task at work has asked only() for.
_ASKED: set[object] = set()


def only(key: object, make: Callable[[], object]):
    """What an operator keeps in a Python worker from one task to the next; another operator's is dropped for it."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _begun() -> None:
    _ASKED.clear()


def _ended() -> None:
    """These work on the worker's own module, where wrapped() below would bring copies of its dicts."""
    if not _ASKED:
        _HELD.clear()
    pa.default_memory_pool().release_unused()
    _trim()


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and after it the memory that its worker holds without use goes back: workers outlive tasks and stages.

    What only() keeps goes too if run didn't ask for it: another operator is at work then.
    """

    def wrapped(batches: Iterator) -> Iterator:
        _begun()
        yield from run(batches)
        _ended()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, one is made on a single machine; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-shared-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def remove(paths: list[str]) -> None:
    """Delete folders that new_path() named; what reads them must be done."""
    for path in paths:
        spark = _LEFT.pop(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


@atexit.register
def _remove_left() -> None:
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None:  # the session still runs
            remove([path])


def stored(df: DataFrame, name: str, passing: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: later stages read files that every executor sees, so
    a lost executor costs only its own running tasks. The folder is noted in
    `passing` for a caller that removes it before the process ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if passing is not None:
        passing.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """df for stored(), where many tasks make few rows each: dealt anew, so that files go by size and not by task.

    On a local file system without Hadoop's native library each file costs an executor two
    processes (chmod, also for the checksum's file).
    """
    return df.hint("rebalance")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class BitTable:
    """Which 64-bit hashes may be in a set: a table of bounded size, with two bits for each hash."""

    def __init__(self, flags: bytes):
        self.mask, self.flags = np.uint64(len(flags) * 8 - 1), np.frombuffer(flags, np.uint8)
        if len(flags) <= 1 << 21:
            self.flags = np.unpackbits(self.flags, bitorder="little").view(bool)
        self.wide = len(self.flags) == int(self.mask) + 1

    @staticmethod
    def of(df: DataFrame, column: str, most_bits: int = 1 << 29, bits_each: int = 256) -> BitTable:
        """The table of a column's values, gathered by Spark's bitmap aggregates: most_bits / 8 bytes at most."""
        bits = min(most_bits, max(1 << 15, 1 << (bits_each * df.count()).bit_length()))
        places = F.array(*(h.bitwiseAND(F.lit(bits - 1)) + 1 for h in (F.col(column), F.shiftright(column, 30))))
        marked = df.select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("flags"))
        flags = bytearray(bits // 8)
        for row in marked.collect():
            flags[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.flags
        return BitTable(bytes(flags))

    def _at(self, place: np.ndarray) -> np.ndarray:
        place = (place & self.mask).view(np.int64)
        return self.flags[place] if self.wide else (self.flags[place >> 3] >> (place & 7).astype(np.uint8) & 1).view(bool)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where in hashes one is that may be in the set."""
        some = np.flatnonzero(self._at(hashes))
        return some[self._at((hashes[some].view(np.int64) >> np.int64(30)).view(np.uint64))] if len(some) else some


def filtered(docs: DataFrame, text_col: str, keeps: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of docs, with all their columns, whose text is kept.

    keeps is called once in each task and gives the function that tells this of a list of texts.
    Every row is judged by itself, so ids may be null or repeated and no join is needed.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeps()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = ["" if t is None else str(t) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key that no two rows share, and the key's name: the row's file and its place there.

    A table that doesn't come from files is written to the shared folder first.
    """
    name = fresh(docs, "_row")
    for again in (False, True):
        try:
            held = docs.metadataColumn("_metadata")
            found = docs.withColumn(name, F.struct(held["file_path"].alias("file"), held["row_index"].alias("place")))
            found.schema  # noqa: B018 - resolves the columns
            return found, name
        except PySparkException:
            if again:
                raise
            docs = stored(docs, "rows")
    raise AssertionError


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of docs, which keyed() made, whose key is not in the one column of gone; without the key.

    The keys are written first, so that their number is known when the join is
    planned: few of them are broadcast, many are joined by a shuffle.
    """
    gone = stored(gone.select(F.col(gone.columns[0])["file"].alias("file"), F.col(gone.columns[0])["place"].alias("place")), "gone")
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.hint("broadcast" if few else "merge")
    same = (docs[key]["file"] == gone["file"]) & (docs[key]["place"] == gone["place"])
    return docs.join(gone, same, "left_anti").drop(key)
