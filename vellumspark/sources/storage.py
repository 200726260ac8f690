"""Tables that outlive executors: where they are written, and when they go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark then drops the shuffle files of a query as soon as its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without that setting; it gets a temporary folder. On
    a cluster a missing setting is an error, since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vellumspark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, kind: str = "vellum") -> str:
    """A fresh path in the shared folder, deleted when the session's file systems close."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)
    return path


def write(df: DataFrame, path: str, partitionBy: str | None = None, **options) -> None:  # noqa: N803
    """Write ``df`` as Parquet, in folders by ``partitionBy`` if given; the shuffle files behind it are dropped at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path, partitionBy=partitionBy)
    finally:
        conf.set(CLEANUP, before)


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage at files that outlive executors."""
    spark = df.sparkSession
    path = new_path(spark)
    write(df, path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._vellum_path = path
    for made in _open:
        made.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_vellum_path", None)
        if path:
            p, fs = _file(df.sparkSession, path)
            fs.delete(p, True)


class Scope:
    """The tables that ``materialize`` writes inside a ``with`` block; ``discard`` deletes all but those to keep."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __enter__(self) -> Scope:
        _open.append(self.made)
        return self

    def __exit__(self, *_) -> None:
        _open[:] = [made for made in _open if made is not self.made]

    def discard(self, *kept: DataFrame) -> None:
        stay = {getattr(df, "_vellum_path", None) for df in kept}
        discard(*(df for df in self.made if df._vellum_path not in stay))


_open: list[list[DataFrame]] = []


def _file(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())
