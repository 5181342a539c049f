"""Session helpers: the settings the jobs rely on and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and local benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("contigloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where neither the session nor the context names one, a temporary folder is
    set on a single machine; on a cluster it is an error, since executors do not
    share such a folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
            "spark.checkpoint.dir"
        )
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="contigloom-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for files a job writes and reads back."""
    return f"{shared_folder(spark).removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside remove their shuffle files as they end.

    Otherwise these files stay until the driver happens to collect its garbage.
    Whoever runs such a plan again gets them again by a retry of the stage.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Like ``checkpoint()`` it outlives any executor; unlike it, readers take only
    the columns they need, and the planner sees the size that was written.  (A
    checkpoint keeps the estimate of its plan, which multiplies at every join:
    after a chain of them nothing small is broadcast any more, and the estimates
    themselves grow to numbers that take minutes to multiply.)  Once it is
    written, the shuffle files it came from are not needed and go.
    """
    table, path = _stored(df)
    for paths in _noted.get():
        paths.append(path)
    return table


#: Lists of the paths that calls of ``result_only`` are to remove, the outermost call first.
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("_noted", default=())


def result_only(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a stored table; the tables it stored on the way are removed.

    ``make`` must store nothing that is read again later.
    """
    passing: list[str] = []
    token = _noted.set((*_noted.get(), passing))
    try:
        df = make()
        table = _stored(df)
    finally:
        _noted.reset(token)
    for paths in _noted.get():
        paths.append(table[1])
    for path in passing:
        _remove(df.sparkSession, path)
    return table[0]


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def short_lived(df: DataFrame) -> Iterator[DataFrame]:
    """``cut_lineage(df)`` whose files are removed on leaving.

    For tables from which only stored ones are made: nothing that is still to
    be executed outside may read it.
    """
    table, path = _stored(df)
    try:
        yield table
    finally:
        _remove(df.sparkSession, path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle small rows that stand for much work over all partitions.

    AQE sizes partitions by bytes and would pack such rows into few tasks; a
    given number is left alone.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
