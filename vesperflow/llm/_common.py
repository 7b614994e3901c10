"""Plumbing shared by the training-data operators: Arrow batches of bounded size and columnar word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vesperflow.session import ship

BATCH_BYTES = 8 << 20


def bound_arrow(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Get ready for Python on the executors: they have this package, and Arrow batches are limited by bytes, so that
    long texts cannot pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: StructType) -> DataFrame:
    """Apply `make()`, called once a task, to each Arrow batch; it returns the columns of `schema`."""
    bound_arrow(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            if b.num_rows:
                f = f or make()
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for t, x in ((t, out[t.name]) for out in (f(b),) for t in arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Apply `run` to the Arrow batches of all columns, which it returns in the same order and with the same types.

    Columns go under plain names meanwhile, as names that differ in case only would clash.
    """
    bound_arrow(docs.sparkSession)
    plain = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Words:
    """The white-space separated words (ASCII white space) of a batch of texts, dictionary coded.

    uniq: the distinct words; codes: an index into uniq for each word; first: where each text's words begin.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        first = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        first -= first[0]
        self.uniq: list[str] = coded.dictionary.to_pylist()
        if "" in self.uniq:
            keep = codes != self.uniq.index("")
            first = np.concatenate([[0], np.cumsum(keep)])[first]
            codes = codes[keep]
        self.codes, self.first = codes.astype(np.int64), first

    @property
    def rows(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sums(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n)
