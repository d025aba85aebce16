"""Raw recordings as CSV, processed tracks and indexes as partitioned Parquet."""

from __future__ import annotations

import csv
import os
import re
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .canonical import ALIASES

#: Canonical columns of raw recordings; those that a recording lacks are NULL.
RAW = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("id", "frame")]
    + [T.StructField(c, T.DoubleType()) for c in ("timestamp", "x", "y", "xVelocity", "yVelocity", "speed", "xAcceleration", "yAcceleration")]
    + [T.StructField("laneId", T.LongType())]
)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, or in a local one where spark.checkpoint.dir is unset and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, for a result that several steps read."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table of recordings, or of groups of them, that is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000


def joined_by_size(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table, which is broadcast if it has MOST_BROADCAST rows at most."""
    return rows.join(by_size(table), keys, how)


def by_size(table: DataFrame) -> DataFrame:
    """A written table for a join: broadcast if it has MOST_BROADCAST rows at most, else shuffled."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else shuffled(table)


def shuffled(table: DataFrame) -> DataFrame:
    """table for a join that shuffles both sides, whatever their size.

    Spark sizes a table by its files and a few columns by their share of the width. Windows' ids and places take five bytes
    a row there and over a hundred in memory, so that a table of windows would be broadcast by far too large.
    """
    return table.hint("merge")


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """df written once in the shared folder as a table of so many buckets by the keys, each sorted by them, and read back.

    A join or an aggregate by the keys then reads the table as it lies, and only the other side of a join is shuffled. Choose
    buckets so that one fits an executor's memory when it is sorted; a hot key stays in one bucket.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


#: Bytes of a file that are read at a time until its header ends.
HEAD_BYTES = 64 << 10


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, length of each file under paths; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("file"), "length")


def headers(spark: SparkSession, paths: list[str], head: int = HEAD_BYTES) -> DataFrame:
    """file, header: the first line of each file under paths; files that are missing or empty have no row.

    Tasks open the listed files and read `head` bytes of each, and more only of a file whose first line is longer, so what
    is read grows with the number of files and not with their size. Where the files are in a store that only Spark's readers
    open, their lines are read instead.
    """
    if not all(_opens(path) for path in paths):
        return _headers_by_lines(spark, paths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.column(0).to_pylist():
                try:
                    found.append((file, _first_line(file, head)))
                except FileNotFoundError:  # lost since it was listed
                    continue
            names, lines = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["file", "header"])

    return listed(spark, paths).where("length > 0").select("file").mapInArrow(read, "file string, header string")


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{os.path.abspath(path)}")


def _opens(path: str) -> bool:
    try:
        fs, base = _opened(path)
        return fs.get_file_info(base).type != pyarrow.fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def _first_line(file: str, head: int) -> str:
    fs, base = _opened(file)
    data = b""
    with fs.open_input_stream(base) as stream:
        while b"\n" not in data and (more := stream.read(head)):
            data += more
    return data.split(b"\n", 1)[0].removesuffix(b"\r").decode("utf-8", "replace")


def _headers_by_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    lines = spark.read.option("ignoreMissingFiles", True).option("recursiveFileLookup", True).text(paths)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return lines.select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place")).groupBy("file").agg(F.min_by("value", "place").alias("header"))


def _names(header: str) -> list[str]:
    """Column names of a header; blank and repeated ones get their number."""
    out: list[str] = []
    for i, c in enumerate(next(csv.reader([header.lstrip("\ufeff")]), [])):
        c = c.strip() or f"column_{i}"
        out.append(c if c.lower() not in {o.lower() for o in out} else f"{c}_{i}")
    return out


def read_raw(spark: SparkSession, paths: list[str], schema: T.StructType = RAW, name: str = r"([^/]+)\.csv$", keep: tuple[str, ...] = ()) -> DataFrame:
    """All recordings in one DataFrame of the schema's columns; source_file is what `name` finds in a row's path.

    Each file is read by its own header: files of one header are read together, columns are found by ALIASES whatever their
    order, those that a file lacks are NULL and others are left out but for the names in `keep`, which stay as text. NaN is
    NULL. _bad names a row's columns that do not hold their type, which are NULL themselves, and "fields" if the row has too
    many or too few; it is NULL if all is well. Missing files are skipped, so one lost recording does not stop the rest. The
    headers, one line a file, are gathered on the driver, as Spark's own list of files is.
    """
    by_header = defaultdict(list)
    for r in headers(spark, paths).collect():
        by_header[r["header"]].append(r["file"])
    out = None
    for header, files in sorted(by_header.items()):
        part = _of_header(spark, header, sorted(files), schema, name, keep)
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in (*keep, "_bad", "source_file")]])
        return spark.createDataFrame([], empty)
    return out


def _of_header(spark, header: str, files: list[str], schema: T.StructType, name: str, keep: tuple[str, ...]) -> DataFrame:
    names = _names(header)
    corrupt = "_corrupt_record"
    text = T.StructType([T.StructField(c, T.StringType()) for c in (*names, corrupt)])
    raw = spark.read.schema(text).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt, columnPruning=False, ignoreMissingFiles=True, enforceSchema=True).csv(files)
    typed, failed = [], [F.when(F.col(corrupt).isNotNull(), "fields")]
    for f in schema:
        found = next((c for c in ALIASES.get(f.name, (f.name,)) if c in names), None)
        if found is None:
            typed.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.trim(F.col(f"`{found}`")).try_cast(f.dataType)
        failed.append(F.when(F.col(f"`{found}`").isNotNull() & value.isNull(), f.name))
        typed.append((F.when(~F.isnan(value), value) if isinstance(f.dataType, T.DoubleType) else value).alias(f.name))
    more = [(F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(c) for c in keep]
    file = F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("source_file")
    return raw.select(*typed, *more, F.nullif(F.concat_ws(",", *failed), F.lit("")).alias("_bad"), file)


def tags(names: DataFrame, rates: DataFrame) -> DataFrame:
    """source_file, dataset_name, source_freq_hz of names(source_file): of the prefixes in rates that a name has, the longest one's.

    Each name is spread over its prefixes, which meet those of rates in an equality join, so any number of prefixes will do.
    A prefix that rates holds twice counts with the larger (dataset_name, source_freq_hz). Names without a prefix have no row.
    """
    starts = names.select("source_file").distinct().select("source_file", F.explode(F.sequence(F.lit(0), F.length("source_file"))).alias("_n"))
    given = rates.select("prefix", "dataset_name", F.col("source_freq_hz").cast("double").alias("source_freq_hz"))
    hits = starts.withColumn("prefix", F.left("source_file", F.col("_n"))).join(given, "prefix")
    best = hits.groupBy("source_file").agg(F.max(F.struct("_n", "dataset_name", "source_freq_hz")).alias("_best"))
    return best.select("source_file", "_best.dataset_name", "_best.source_freq_hz")


def tagged(raw: DataFrame, rates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """raw with dataset_name and source_freq_hz by tags(); files without a prefix have NULLs.

    names(source_file) is the list of recordings, as recordings_of() gives it; without it raw is read once more for them.
    """
    found = kept(tags(raw if names is None else names, rates), "tags")
    out = joined_by_size(raw.drop("dataset_name", "source_freq_hz"), found, ["source_file"], "left")
    return out.select(*[F.col(f"`{c}`") for c in raw.columns if c not in ("dataset_name", "source_freq_hz")], "dataset_name", "source_freq_hz")


def recordings_of(spark: SparkSession, paths: list[str], name: str = r"([^/]+)\.csv$") -> DataFrame:
    """source_file of each file under paths, as read_raw() names them; no content is read."""
    return listed(spark, paths).select(F.regexp_extract("file", name, 1).alias("source_file")).distinct()


def good_rows(raw: DataFrame) -> DataFrame:
    return raw.where(_good()).drop("_bad")


def quarantined(raw: DataFrame) -> DataFrame:
    """Rows that did not parse or lack an id or frame."""
    return raw.where(~_good())


def _good():
    return F.col("_bad").isNull() & F.col("id").isNotNull() & F.col("frame").isNotNull()


def quarantine_report(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_file").agg(F.count_if(_good()).alias("good_rows"), F.count_if(~_good()).alias("bad_rows"))


def recording_report(raw: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per recording: status, good_rows, bad_rows, and reasons (how many rows each bad column has).

    status is ok, partial (some bad rows), failed (no good row), or missing: expected(source_file) has it and no file does.
    """
    reason = F.explode(F.split(F.when(F.col("_bad").isNotNull(), F.col("_bad")).otherwise(F.lit("key")), ","))
    reasons = quarantined(raw).select("source_file", reason.alias("reason")).groupBy("source_file", "reason").agg(F.count("*").alias("n"))
    reasons = reasons.groupBy("source_file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    rows = quarantine_report(raw)
    if expected is not None:
        rows = expected.select("source_file").distinct().join(rows, "source_file", "full")
    good, bad = F.coalesce("good_rows", F.lit(0)).alias("good_rows"), F.coalesce("bad_rows", F.lit(0)).alias("bad_rows")
    status = F.when(F.col("good_rows").isNull(), "missing").when(F.col("good_rows") == 0, "failed").when(F.col("bad_rows") > 0, "partial").otherwise("ok")
    return rows.select("source_file", status.alias("status"), good, bad).join(reasons, "source_file", "left")


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Snappy Parquet in a folder per value of the columns `by`.

    Rows of a folder are brought together first; Spark splits folders of many rows over as many tasks as their size asks for.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).option("compression", "snappy").partitionBy(*by).parquet(path)
