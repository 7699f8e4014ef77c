"""Session for tests and benchmarks, and the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", name: str = "playbill") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="playbill-"))
        # Call sites of every Column step are of use in notebooks; they cost half the planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever the session can reach it."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _remove_if_running(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        remove(spark, path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, for one run; it goes when the application ends with its session open."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_if_running, spark, path)
    return path


#: Rows of a file of narrow rows that each cost much to read on: a file is one task at least, so their number grows with the rows.
ROWS_A_FILE = 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to a work folder and read from there, so that what follows neither plans nor runs it again.

    The files are small, so however few tasks write them, many can read them.
    """
    path = work_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, for checkpoints and small tables.

    A cluster names it in ``spark.checkpoint.dir``; a session that does not uses
    its warehouse, which executors share as well.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/playbill-work"
