"""Where operators keep what several executors must see, and small helpers they share.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``. Only where that is
unset and the master is local (tests, a laptop) is a folder of this machine used; on a cluster that raises. Python workers open files there with ``pyarrow.fs``,
so the folder's scheme must be one it knows (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters, as in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes and rows of a batch that is worked on at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder for intermediate data, below ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = (Path(tempfile.gettempdir()) / "checkpoints").as_uri()
    elif not urlparse(path).scheme:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        path = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return f"{path.rstrip('/')}/lontar"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's URI; ``discard`` or the session's end removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def made() -> list[str]:
    """The folders made so far that are still there."""
    return [path for _, path in _made]


def discard(paths: list[str] | None = None) -> None:
    """Remove the folders made so far, or those named. Frames that read them can't be used afterwards."""
    for spark, path in [x for x in _made if paths is None or x[1] in paths]:
        _made.remove((spark, path))
        with contextlib.suppress(Exception):  # the session may have ended
            remove(spark, path)


atexit.register(discard)


def stored(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """The frame, written to a table of its own in the shared folder and read again: this cuts its lineage. by: a column of
    few values, by which the table is laid out."""
    path = workspace(df.sparkSession, name)
    # Small row groups: a writer holds one in memory.
    writer = df.write.option("compression", codec).option("parquet.block.size", 16 << 20)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about size bytes and at most so many rows (a longer row is a piece of its own). What Spark sends
    at once it bounds itself, by spark.sql.execution.arrow.maxBytesPerBatch; Python objects made of it are larger."""
    for batch in batches:
        n = min(rows, max(1, int(len(batch) * size / max(1, batch.nbytes))))
        for a in range(0, len(batch), n):
            yield batch.slice(a, n)


def text_bytes(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: A table of at most so many rows of a few short columns (some 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
SALTS = 16


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """big joined to small, which is a stored table with one narrow row per key.

    Its rows are counted first: up to BROADCAST_ROWS it is broadcast and big stays where it is. Beyond that both are dealt
    by key and salt, small once for each salt, so that no key's rows meet in one task.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
    return big.withColumn("_salt", F.spark_partition_id() % SALTS).join(salted, [key, "_salt"], how).drop("_salt")
