"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Folders this process has written under the shared folder; released at its end.
_OWNED: list[str] = []
#: Lists that also get the folders handed out, the innermost `scratch_scope` last.
_SCOPES: list[list[str]] = []


def get_session(app: str = "sparkprep", **conf: str) -> SparkSession:
    """A session with the settings every operator here relies on.

    Master, memory and shuffle width are left to the caller or to spark-submit; adaptive execution
    sizes the reducers and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a session on one machine (`local[...]`); on a cluster
    executors could not read each other's files there, so that raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get().rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="sparkprep-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before; removed by `release` or at the process's end."""
    path = f"{shared_dir(spark)}/sparkprep/{name}-{uuid.uuid4().hex[:12]}"
    if not _OWNED:
        atexit.register(release)
    _OWNED.append(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(paths: list[str]) -> Iterator[list[str]]:
    """Folders handed out meanwhile are added to `paths`, for `release(paths)` once the results that read them are written."""
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so later stages survive lost executors."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(paths: list[str] | None = None) -> int:
    """Delete the folders handed out by `scratch_path`, all or the listed ones, when no result that reads them is needed; gives their number."""
    paths = _OWNED if paths is None else paths
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return 0
    done = 0
    while paths:
        name = paths.pop()
        if name in _OWNED:
            _OWNED.remove(name)
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True))
    return done
