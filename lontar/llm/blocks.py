"""Tables kept in blocks: rows that lie together in stored files, met by answers that are dealt to them.

A block's rows are of one task, in the order in which it got them, and of bounded size (but for a row that is larger by
itself). A block may lie in one file or several (Spark starts a new one after ``spark.sql.files.maxRecordsPerFile`` rows,
for instance). Each file is named with the number of the block's rows in it; a reader that finds another number raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small, stored

BLOCK_BYTES = 16 << 20


def _numbered(column: str, size: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used = TaskContext.get().partitionId() << 32, 0
        for batch in small(batches, size):
            n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
            if used and used + n > size:
                block, used = block + 1, 0
            used += n + len(batch)
            yield batch.append_column("block", pa.array([block] * len(batch), pa.int64()))

    return number


def in_blocks(rows: DataFrame, column: str, size: int, name: str) -> DataFrame:
    """The rows, stored with the number of their block: about size bytes of the (binary) column."""
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.LongType())])
    return stored(rows.mapInArrow(_numbered(column, size), schema), name)


def files_of(blocks: DataFrame) -> DataFrame:
    """block, path, n_rows: the files that hold rows of each block of a stored table."""
    return blocks.groupBy("block", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))


class Files:
    """The stored rows of a block."""

    def __init__(self, block: int, files: list[tuple[str, int]]):
        self.block, self.files = block, sorted(files)

    def batches(self, columns: list[str], rows: int = 1000) -> Iterator[pa.RecordBatch]:
        for path, n in self.files:
            system, name = fs.FileSystem.from_uri(path)
            found = 0
            with system.open_input_file(name) as raw:
                file = pq.ParquetFile(raw)
                at = file.schema_arrow.names.index("block")
                at = next(i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == "block") if file.metadata.num_columns != len(file.schema_arrow) else at
                groups = []
                for i in range(file.metadata.num_row_groups):
                    s = file.metadata.row_group(i).column(at).statistics
                    if s is None or not s.has_min_max or s.min <= self.block <= s.max:
                        groups.append(i)
                for batch in file.iter_batches(rows, row_groups=groups, columns=[*columns, "block"]) if groups else ():
                    own = pc.equal(batch.column("block"), self.block)
                    if not pc.all(own).as_py():
                        batch = batch.filter(own)
                    found += len(batch)
                    if len(batch):
                        yield batch.select(columns)
            if found != n:
                raise RuntimeError(f"{path} holds {found} rows of block {self.block}, not {n}")


def block_rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[Files, list[tuple]]]:
    """Rows come sorted by block: those that name its files (path, n_rows), and its answers, which have no path."""
    names = ("block", "path", "n_rows", *columns)
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    for block, some in groupby(rows, lambda r: r[0]):
        files, answers = [], []
        for _, path, n, *answer in some:
            if path is not None:
                files.append((path, n))
            else:
                answers.append(tuple(answer))
        if not files:
            raise RuntimeError(f"block {block} has no file")
        yield Files(block, files), answers


def met(files: DataFrame, answers: DataFrame, tasks: int) -> DataFrame:
    """What block_rows reads: each block's files with its answers."""
    told = files.unionByName(answers, allowMissingColumns=True)
    return told.repartition(max(1, tasks), "block").sortWithinPartitions("block")
