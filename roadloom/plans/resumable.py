"""Runs over many recordings that survive a crash and bad recordings, by a manifest of what is done.

The manifest is a Parquet table that is only appended to: a row for each recording and attempt, with status ok or failed,
the reason, and how many rows each output has of it. Outputs lie in a folder per recording, which a later attempt replaces;
so a run that broke off after its data and before its manifest row leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.recordings import joined_by_size, kept, work_folder

MANIFEST = "source_file string, attempt int, status string, reason string, rows map<string,bigint>"
#: Recordings of one job, and characters of an error's message that are kept.
BATCH, REASON = 500, 300
#: Parts of what fails, and parts that are tried side by side.
PARTS, AT_ONCE = 16, 3
#: Rows that one task takes when a part is tried, so that nothing of it is shuffled.
ROWS_PER_TASK = 200_000


def history(spark: SparkSession, manifest: str) -> DataFrame:
    """All rows of a manifest; none where there is no manifest yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(manifest)
    except PySparkException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def state_of(spark: SparkSession, manifest: str) -> DataFrame:
    """Each recording's last attempt."""
    last = F.max_by(F.struct("attempt", "status", "reason", "rows"), "attempt").alias("last")
    return history(spark, manifest).groupBy("source_file").agg(last).select("source_file", "last.*")


def run(tracks: DataFrame, names: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], out: str, manifest: str, batch: int = BATCH) -> DataFrame:
    """Writes make(tracks of some recordings), DataFrames with source_file by the outputs' names, to the folder out/<name>.

    names(source_file, and problem if there is such a column) are the recordings wanted. Those that the manifest has as ok
    are not touched; those with a problem are entered as failed without a try. The others run in batches. A batch that
    fails is stored by recording and split into PARTS, which are tried side by side, and so on, until the recordings that
    fail are alone; these are entered with the error's message, and the rest is done. So make is called from several
    threads. A driver that dies leaves a manifest from which the same call goes on. Returns state_of() the manifest.
    """
    spark = tracks.sparkSession
    before = state_of(spark, manifest)
    problem = F.col("problem") if "problem" in names.columns else F.lit(None).cast("string")
    todo = names.select("source_file", problem.alias("problem")).groupBy("source_file").agg(F.max("problem").alias("problem"))
    todo = todo.join(before.where("status = 'ok'").select("source_file"), "source_file", "left_anti").join(before.select("source_file", "attempt"), "source_file", "left")
    todo = kept(todo.select("source_file", "problem", (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")), "todo")
    unfit = todo.where("problem is not null")
    if not unfit.isEmpty():
        _enter(unfit.select("source_file", "attempt", F.lit("failed").alias("status"), F.col("problem").alias("reason"), F.lit(None).cast("map<string,bigint>").alias("rows")), manifest)
    fit = todo.where("problem is null").select("source_file", "attempt")
    batches = -(-fit.count() // batch)
    for b in range(batches):
        _batch(tracks, kept(fit.where(F.pmod(F.xxhash64("source_file"), F.lit(batches)) == b), "batch"), make, out, manifest)
    return state_of(spark, manifest)


def _enter(rows: DataFrame, manifest: str) -> None:
    rows.select("source_file", F.col("attempt").cast("int").alias("attempt"), "status", "reason", "rows").coalesce(1).write.mode("append").parquet(manifest)


def _batch(tracks: DataFrame, some: DataFrame, make, out: str, manifest: str) -> None:
    """One batch of recordings, a written table: tries of all of it, then of ever smaller parts of what fails, each followed by its manifest rows."""
    spark = tracks.sparkSession
    attempts = {r["source_file"]: r["attempt"] for r in some.collect()}
    mine = joined_by_size(tracks, some.select("source_file"), ["source_file"], "left_semi")
    parts, of = [sorted(attempts, key=str)] if attempts else [], None
    while parts:
        attempt = lambda part: _tried(*(of(part) if of else (mine, False)), make, out)
        if len(parts) == 1:
            errors = [attempt(parts[0])]
        else:
            with ThreadPoolExecutor(AT_ONCE) as pool:
                errors = list(pool.map(inheritable_thread_target(spark)(attempt), parts))
        done = {n for part, (_, e) in zip(parts, errors) if e is None for n in part}
        outputs = next((names for names, e in errors if e is None), ())
        counts = {name: dict(_counted(spark, f"{out}/{name}", list(done))) for name in outputs}
        rows = [(n, attempts[n], "ok", None, {name: counts[name].get(n, 0) for name in outputs}) for n in done]
        rows += [(part[0], attempts[part[0]], "failed", e[:REASON], None) for part, (_, e) in zip(parts, errors) if e is not None and len(part) == 1]
        if rows:
            _enter(spark.createDataFrame(rows, MANIFEST), manifest)
        failed = [part for part, (_, e) in zip(parts, errors) if e is not None and len(part) > 1]
        if failed and of is None:
            of = _by_recording(mine, list(attempts))
        parts = [p for part in failed for k in range(PARTS) if (p := part[k::PARTS])]


def _tried(mine: DataFrame, one_task: bool, make, out: str) -> tuple[list[str], str | None]:
    """The names of the outputs, and None if they are written, else the error's message. What is one task needs no shuffle to its folders."""
    try:
        outputs = make(mine)
        for name, df in outputs.items():
            together = df if one_task else df.hint("rebalance", F.col("source_file"))
            together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(f"{out}/{name}")
        return list(outputs), None
    except PySparkException as e:
        return [], str(e)


def _counted(spark: SparkSession, path: str, names: list[str]) -> list[tuple[str, int]]:
    """How many rows the folders of the named recordings hold."""
    return [tuple(r) for r in spark.read.schema("source_file string").parquet(path).where(F.col("source_file").isin(names)).groupBy("source_file").count().collect()]


def _by_recording(mine: DataFrame, names: list[str]) -> Callable[[list[str]], tuple[DataFrame, bool]]:
    """A function from some of the names to their rows, and whether these are one task, as up to ROWS_PER_TASK of them are.

    The rows are stored in a folder per recording, so that each is read alone. Where they can't be read, they are left where
    they are.
    """
    spark = mine.sparkSession
    place = {n: i for i, n in enumerate(names)}
    number = "_recording"
    while number in mine.columns:
        number += "_"
    try:
        table = spark.createDataFrame(list(place.items()), f"source_file string, {number} int")
        path = work_folder(spark, "by-recording")
        mine.join(F.broadcast(table), "source_file").hint("rebalance", F.col(number)).write.partitionBy(number).parquet(path)
        stored = spark.read.schema(T.StructType([*mine.schema.fields, T.StructField(number, T.IntegerType())])).parquet(path)
        rows = {r[number]: r["count"] for r in stored.groupBy(number).count().collect()}
    except PySparkException:
        return lambda part: (mine.where(F.col("source_file").isin(part)), False)

    def picked(part: list[str]) -> tuple[DataFrame, bool]:
        numbers = [place[n] for n in part]
        some, one_task = stored.where(F.col(number).isin(numbers)).drop(number), sum(rows.get(i, 0) for i in numbers) <= ROWS_PER_TASK
        return some.coalesce(1) if one_task else some, one_task

    return picked
