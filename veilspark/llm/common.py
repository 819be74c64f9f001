"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word and white-space classes of the result contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set a local session gets a temporary one; on a
    cluster that is an error, since each machine would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch with whole texts: both sides hold a batch several times over.
TEXT_ROWS, TEXT_BYTES = 1_000, 16 << 20


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int = TEXT_ROWS):
    """Arrow batches of at most ``rows`` rows and TEXT_BYTES bytes (a longer row alone is one) for the jobs run inside; the session's own
    settings come back behind it."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": TEXT_BYTES}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, most in limits.items():
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, own in before.items():
            spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def materialize(df: DataFrame, tag: str, rows: int = TEXT_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs a re-read only. The table goes when the
    session's JVM ends. ``rows`` bounds the Arrow batches of its Python stages."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def fetch(df: DataFrame):
    """``toPandas`` with bounded Arrow batches; for results whose size doesn't grow with the data."""
    with batches_of(df.sparkSession):
        return df.toPandas()


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``docs``, whatever the letters' case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: A key that holds at least one HOT-th of the rows is joined by broadcast: there are at most HOT such keys, whatever the data.
HOT = 1_000


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner", to: str | None = None) -> DataFrame:
    """``left`` joined with ``right`` (inner or left) on ``key`` (``to`` in ``right``, another name), where ``right`` has few rows a key and says in
    ``weight`` how many of ``left``'s ``total`` rows have it.

    Rows of hot keys stay where they are and meet at most HOT broadcast keys; so do those without a key; all others are shuffled. Both sides should be
    tables, as they are read more than once.
    """
    to = to or key
    on = F.col(key) == F.col(to) if to != key else key
    is_hot = F.col(weight) * HOT >= F.lit(total)
    hot, rest = right.where(is_hot), right.where(~is_hot)
    keyed = left.where(F.col(key).isNotNull())
    cold = keyed.join(F.broadcast(hot.select(to).distinct()), on, "left_anti").join(rest, on, how)
    met = keyed.join(F.broadcast(hot), on).unionByName(cold)
    return met.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else met


#: Bits of a map of keys for each key, and the most that a map may have (64 MB).
KEY_BITS, MOST_BITS = 16, 29


def marked_bits(keys: DataFrame, hashed: Column) -> tuple[int, np.ndarray] | None:
    """(bits, bytes): a map of ``hashed`` (long) of all rows of ``keys``, by its remainder modulo 2 ** bits. None where it would have more than MOST_BITS.

    Tasks mark bits; what reaches the driver has 16 to 32 bits a key and 64 MB at most.
    """
    bits = max(15, math.ceil(math.log2(KEY_BITS * max(1, keys.count()))))
    if bits > MOST_BITS:
        return None
    # maps of 32,768 bits count from 1, as do the numbers that they take
    place = F.pmod(hashed, F.lit(1 << bits)) + 1
    used = fetch(keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))
    marked = np.zeros((1 << bits) // 8, np.uint8)
    for at, own in zip(used["at"], used["bits"], strict=True):
        marked[(at - 1) * 4096 : at * 4096] = np.frombuffer(own, np.uint8)
    return bits, marked


def is_marked(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (marked[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def key_map(keys: DataFrame, *columns: str) -> Callable[[Column], Column] | None:
    """A condition on ``xxhash64`` of the key's columns that holds for every key of ``keys`` and for few others, so that rows without a key needn't
    go to a join. None where there are too many keys for a map: all rows go to the join then."""
    found = marked_bits(keys, F.xxhash64(*columns))
    if found is None:
        return None
    bits = found[0]
    shared = keys.sparkSession.sparkContext.broadcast(found[1])

    @F.pandas_udf("boolean")
    def may_be_key(b: pd.Series) -> pd.Series:
        return pd.Series(is_marked(shared.value, b.to_numpy(np.int64)))

    return lambda hashed: may_be_key(F.pmod(hashed, F.lit(1 << bits)))


def row_numbers(docs: DataFrame, name: str, tag: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart, however often they are read: file and place, where each is one row's own (a table as it lies in
    files), else numbers written down once. Joins and ``explode`` keep the place of the row that they repeat, so places are counted first."""
    try:
        placed = docs.select("*", F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias(name))
        if placed.groupBy(name).agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
            return placed
    except AnalysisException:
        pass
    return materialize(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_learnt_from(doc_id, modulus: int, held_out: int) -> bool:
    """False for held-out rows: those whose crc32 of the id as text leaves the remainder ``held_out``."""
    return zlib.crc32(str(doc_id).encode()) % modulus != held_out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """What a Python worker remembers within a task; ``tidy`` empties it behind the task, since workers outlive their tasks."""

    every: ClassVar[list[Memo]] = []

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound
        Memo.every.append(self)


class WordIds(Memo):
    """word bytes -> 64-bit hash, remembered for the words met so far; ``bound`` limits the memory, not the words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(batch: pa.RecordBatch, rows: int = 250) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few of its texts are Python strings at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def rows_of(batch: pa.RecordBatch, rows: int = 250) -> Iterator[tuple]:
    """The rows of a batch as tuples, made part by part."""
    for part in slices(batch, rows):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes a task's batches on, and gives memory back to the system after the last: Python workers outlive their tasks."""
    yield from batches
    for memo in Memo.every:
        memo.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
