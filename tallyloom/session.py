"""Session helpers: a tuned local session, the shared folder, and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    ``spark.checkpoint.dir`` wins. Only a local master may fall back to a temporary folder: executors
    on other machines could not read it.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return folder


_scopes = threading.local()
_cleanup = threading.Lock()
_cleaning = {"depth": 0, "before": None}


def shared_folder(spark: SparkSession) -> str:
    """A new name in the shared folder. What is written there goes at the end of the ``scratch`` block, or when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    atexit.register(_delete, spark, folder)
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Everything that operators write to the shared folder inside this block goes at its end.

    For long sessions: results have to be written or collected within the block, since they read what was written. The
    block's value is a function that hands a table written by ``cut`` on to the block around, if there is one.
    """
    outer = getattr(_scopes, "open", [])
    scope: list[str] = []
    _scopes.open = [*outer, scope]

    def keep(df: DataFrame) -> DataFrame:
        scope.remove(df._cut_folder)
        for around in outer[-1:]:
            around.append(df._cut_folder)
        return df

    try:
        yield keep
    finally:
        _scopes.open = outer
        for folder in scope:
            _delete(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors, and lets later steps read only the columns they need; as
    compressed Parquet it takes a fraction of a checkpoint of rows. The files go by ``discard``, at the end of a ``scratch`` block, or when the driver ends.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    with short_lived_shuffles(spark):
        df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    written._cut_folder = folder
    return written


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it any more."""
    folder = getattr(df, "_cut_folder", None)
    if folder:
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM or the folder is gone already
        pass


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of jobs in this block go when their query ends, not when the driver collects its garbage.

    The setting is the session's: the first of several blocks at a time sets it, the last one sets it back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _cleanup:
        if not _cleaning["depth"]:
            _cleaning["before"] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _cleaning["depth"] += 1
    try:
        yield
    finally:
        with _cleanup:
            _cleaning["depth"] -= 1
            if not _cleaning["depth"]:
                before = _cleaning["before"]
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context: they may not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tallyloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / f"tallyloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._tallyloom_shipped = True


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose number has to be fixed in advance."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
