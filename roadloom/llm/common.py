"""Shared helpers of the training-data operators: the shared folder, the held-out split, word patterns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.recordings import work_folder

#: ASCII white space separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, for a table of one run."""
    return work_folder(spark, name)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, rows_per_batch: int | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    rows_per_batch is the most rows that Python workers get at once while df is made, for rows of long texts.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_BATCH)
    if rows_per_batch:
        spark.conf.set(_BATCH, str(rows_per_batch))
    try:
        df.write.parquet(path)
    finally:
        if rows_per_batch:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for documents whose crc32(doc_id as text) mod 4 is 2; a null id counts as empty text."""
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))
    return F.crc32(key) % 4 == 2


def sample_order(*cols: str) -> Column:
    """A fixed pseudo-random order of rows, as a fraction in [0, 1)."""
    return (F.xxhash64(F.lit("sample"), *[F.col(c) for c in cols]).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a list of ids that is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 500_000


def without(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys are in ids, a stored table; df is not shuffled while ids has MOST_BROADCAST rows at most."""
    return df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, keys, "left_anti")


def matching(df: DataFrame, ids: DataFrame, keys: list[str], extra: list[str] = []) -> DataFrame:
    """The rows of df whose keys are in ids, with ids' extra columns; df is not shuffled while ids has MOST_BROADCAST rows at most."""
    ids = ids.select(*keys, *extra)
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return df.join(ids, keys, "inner" if extra else "left_semi")


def extended(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of df with more fields; types as DDL names."""
    more = T.StructType.fromDDL(", ".join(f"`{c}` {k}" for c, k in kinds.items()))
    return T.StructType([*df.schema.fields, *more.fields])


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which maps Arrow batches, with what it has freed given back to the system at its end.

    Python workers live on from task to task, and an executor's memory counts what they keep.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
                trim(0)

    return wrapped
