"""Session factory shared by the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the session comes from spark-submit instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName("tidewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Where that is unset a local session gets a temporary
    folder; on a cluster that would be a folder of each machine's own, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Folders made so far for intermediate tables. Results are lazy and read them, so they stay until clear_scratch() is called.
MADE: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of intermediate tables in the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/tidewright/{name}-{uuid.uuid4().hex}"
    MADE.append((spark, path))
    return path


def clear_scratch() -> None:
    """Removes the intermediate tables of all calls so far. Call it when their results have been read or written."""
    while MADE:
        spark, name = MADE.pop()
        if spark.sparkContext._jsc is None:  # that session has ended
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Whether Spark (4.1 on) removes an execution's shuffle files when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(rows: DataFrame) -> DataFrame:
    """rows written in the shared folder and read again: made once, and a lost executor costs one read. A written table starts a new
    plan; one that is checkpointed keeps what the optimizer inferred, which doubles with each round of a loop. The shuffle files of the
    write go with its end; they would stay until the driver collects its garbage."""
    spark = rows.sparkSession
    path = scratch_folder(spark, "cut")
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FILES_GO) if before is None else spark.conf.set(FILES_GO, before)
    return spark.read.schema(rows.schema).parquet(path)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it. On a cluster without that path, use --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else root


#: Rows that a Python worker turns into objects at once.
ROWS_AT_ONCE = 256


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS_AT_ONCE rows: what a worker holds as objects is that, however many rows Spark sends at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def array_in_slices(values: pa.Array, kind: pa.DataType, one) -> pa.Array:
    """An array of one(value) for each of values, made by slices of ROWS_AT_ONCE."""
    parts = [pa.array([one(v) for v in values.slice(at, ROWS_AT_ONCE).to_pylist()], kind) for at in range(0, len(values), ROWS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
