"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one only where that is unset (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="talkloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of tables made by ``cut`` inside the innermost ``scope`` and not deleted yet.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scope():
    """What ``cut`` makes inside belongs to it: only that is deleted by ``drop_all``, no other query's tables of the session."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        _SCOPE.reset(token)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    if (made := _SCOPE.get()) is not None:
        made.append(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    made = _SCOPE.get()
    if made and path in made:
        made.remove(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that nothing will read again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_all(spark: SparkSession, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what ``cut`` has made in this ``scope``, except ``keep``: when all that read it is written."""
    spared = {getattr(df, "_scratch_path", None) for df in keep}
    for path in list(_SCOPE.get() or ()):
        if path not in spared:
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
