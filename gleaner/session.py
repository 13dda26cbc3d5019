"""Session helpers: local sessions for tests, and the folder where lineage is cut."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "gleaner", partitions: int = 8) -> SparkSession:
    """A one-machine session; on a cluster use the session that is given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # call sites in error messages cost several calls per expression built
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names.

    Only a one-machine session that names none gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="gleaner-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, name: str = "part") -> str:
    """A folder name in the shared folder that is not in use; removed when the session's driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/gleaner-{name}-{uuid.uuid4()}"
    _FOLDERS.append((spark, folder))
    return folder


def store(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once and read it from there.

    Later uses read the files, with column pruning and known sizes, instead of computing
    ``df`` again, also after executors were lost.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``store`` under the name that says why."""
    return store(df, "cut")


_FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_folders() -> None:
    for spark, folder in _FOLDERS:
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its cluster cleans its own scratch space
            return
