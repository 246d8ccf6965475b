"""What the operators share: a scratch folder that every executor sees, word splitting and fold arithmetic."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table: A-Z to a-z; digits, letters and every byte of a non-ASCII character stay; all else is a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset a local session gets a temporary folder, which
    its one process sees; on a cluster it is an error, as executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialize(df: DataFrame, bag: list[str] | None = None) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again: lineage ends there, executors may go.

    ``bag`` collects the folders, for ``discard`` when nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    if bag is not None:
        bag.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, bag: list[str]) -> None:
    """Deletes the folders of the bag."""
    for path in bag:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    bag.clear()


def fold_of(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lowers the session's limit of bytes an Arrow batch (not of rows: texts differ in length), for tasks that hold a
    batch of whole texts several times over. A lower limit of the caller stays; results don't depend on it. It can't be
    put back here, as plans run after the call."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(name, str(most))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def broadcast_value(spark: SparkSession, value):
    """A Spark broadcast of a value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)


def give_back() -> None:
    """Gives freed memory back to the system: Python workers live on after a task, next to those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(texts: list, most: int = 2_000_000):
    """(start, stop) of runs of texts (or of their lengths) of at most ``most`` characters in all, or of one longer text."""
    start = size = 0
    for k, text in enumerate(texts):
        length = int(text) if isinstance(text, (int, np.integer)) else len(text or "")
        size += length
        if size > most and k > start:
            yield start, k
            start, size = k, length
    if start < len(texts):
        yield start, len(texts)
