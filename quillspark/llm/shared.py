"""Tables written to the folder that all executors share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of one Arrow batch between Spark and Python; texts are long, and a task holds a batch several times over.
MOST_BATCH_ROWS, MOST_BATCH_BYTES = 1_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; one of our own only where it is unset, as in tests."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size for texts, if it is larger. It stays so, as results are computed later."""
    for name, most in ((BATCH_ROWS, MOST_BATCH_ROWS), (BATCH_BYTES, MOST_BATCH_BYTES)):
        now = spark.conf.get(name)
        #: Values with a unit, of which only bytes are not larger, are lowered too.
        now = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else -1
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` gave and that nothing still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it keeps its free memory


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function on batches; its worker, which lives on, gives its free memory back to the system when a task ends."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def quoted(names: list[str]) -> list[Column]:
    """Top-level columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def by_place(df: DataFrame) -> DataFrame:
    """`df` with names that hold no dots, which batch functions cannot take."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def row_key(doc: str = "doc_id", text: str = "text") -> Column:
    """128 bits of a row's id and text: rows that agree in both share it."""
    return F.unhex(F.md5(F.concat_ws(":", F.md5(F.encode(text, "UTF-8")), F.coalesce(F.col(doc).cast("string"), F.lit("null")))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
