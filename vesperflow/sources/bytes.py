"""Byte sinks and sources: files written by the tasks to a shared URI, byte ranges, base64."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str) -> int:
    """Write rows (name, content) as files of their own below `folder`, a URI that all executors share; how many.

    A file is written under another name and renamed when whole, so a task can run again; equal names keep one file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        mark, n = f".{TaskContext.get().taskAttemptId()}.part", 0
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with store.open_output_stream(f"{root}/.{name}{mark}") as out:
                    out.write(content.as_buffer())
                store.move(f"{root}/.{name}{mark}", f"{root}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def byte_range(content, start: int, size: int) -> Column:
    """`size` bytes from `start`, counted from 0; fewer at the end."""
    return F.substring(content, start + 1, size)


def to_base64(content) -> Column:
    return F.base64(content)


def from_base64(text) -> Column:
    """Bytes of base64 text; null where it is none."""
    return F.try_to_binary(text, F.lit("base64"))
