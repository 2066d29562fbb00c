"""Table maintenance on Parquet: replace, append, upsert, merge, delete and insert, and freshness of derived data."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` over ``path``, which ``df`` may itself read: staged beside it, then swapped."""
    spark = df.sparkSession
    staged, old = f"{path}.staged", f"{path}.old"
    df.write.mode("overwrite").parquet(staged)
    fs, target = _fs(spark, path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(make(old), True)
    if fs.exists(target):
        fs.rename(target, make(old))
    if not fs.rename(make(staged), target):
        fs.rename(make(old), target)
        raise OSError(f"cannot move {staged} to {path}")
    fs.delete(make(old), True)


def swap_table(df: DataFrame, path: str) -> None:
    """Make ``df``, which may itself read it, the table at ``path`` for ``current_table``: written as a version of its own, which a small
    file then names. The file is replaced in one step, so readers find the old table or the new one at any moment; the version
    before stays for readers that have begun, older ones go."""
    spark = df.sparkSession
    was = _named(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs, fresh = _fs(spark, f"{path}/current.{name}")
    out = fs.create(fresh, True)
    out.writeBytes("\n".join([name, *was[:1]]))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    overwrite = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, hadoop.Path(f"{path}/current"), overwrite)
    for old in was[1:]:
        fs.delete(hadoop.Path(f"{path}/{old}"), True)


def _named(spark: SparkSession, path: str) -> list[str]:
    """The current version of a table and the one before."""
    fs, p = _fs(spark, f"{path}/current")
    return [r.value for r in spark.read.text(p.toString()).collect()] if fs.exists(p) else []


def current_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{_named(spark, path)[0]}")


def append_table(df: DataFrame, path: str) -> None:
    """Append; columns that the table lacks are added (read with ``read_table``)."""
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Delete the rows of the values of ``by`` that ``df`` has, and insert it: repeating it changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_update(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` taken from the matching row of ``source``; keys are unique in ``source``."""
    s = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    joined = target.join(s, keys, "left")
    new = {c: F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*target.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; either may lack columns of the other."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return old.join(new, cond, "left_anti").unionByName(new, allowMissingColumns=True)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Adds a null column if there is none of that name."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def read_or(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    """The table at ``path``, or ``default`` rows where there is none or it is empty."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        df = spark.read.parquet(path)
        if not df.isEmpty():
            return df
    return spark.createDataFrame(default, schema)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def fingerprint(params: dict) -> str:
    """Ten hex digits that name a set of parameters, whatever their order."""
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:10]


def manifest(spark: SparkSession, path: str) -> dict[str, int]:
    """Modification times of the files of a table, by name."""
    fs, p = _fs(spark, path)
    out = {}
    if fs.exists(p):
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                out[f.getPath().toString()] = f.getModificationTime()
    return out


def cached(spark: SparkSession, make, source: str, cache: str, params: dict) -> DataFrame:
    """``make()`` kept at ``cache`` under its parameters, remade when a file of ``source`` is new, gone or changed."""
    path = f"{cache}/{fingerprint(params)}"
    fs, note = _fs(spark, f"{path}.manifest")
    now = json.dumps(manifest(spark, source), sort_keys=True)
    if fs.exists(note):
        was = spark.read.text(note.toString(), wholetext=True).first()
        if was and was[0].strip() == now and fs.exists(_fs(spark, path)[1]):
            return spark.read.parquet(path)
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return spark.read.parquet(path)
