"""Shared building blocks of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D, in Java's and Python's regex syntax.
SEPARATOR = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, whatever number of times ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def fresh(df: DataFrame, **columns: Column) -> tuple[DataFrame, dict[str, str]]:
    """Adds columns under names that clash with none of ``df``; returns the frame and the names given."""
    taken = {c.lower() for c in df.columns}
    names = {}
    for wanted in columns:
        name = f"_{wanted}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names[wanted] = name
    return df.withColumns({names[k]: v for k, v in columns.items()}), names


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of ``df``."""
    return fresh(df, **{name: F.lit(None)})[1][name]


def others(df: DataFrame, *names: str) -> list:
    """The fields of ``df`` that results called ``names`` don't take the place of, whatever their case."""
    return [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; where none is named, a folder of our own in local mode
    (tests), an error on a cluster."""
    conf, context = "spark.checkpoint.dir", spark.sparkContext
    folder = spark.conf.get(conf, None) or context.getConf().get(conf, None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="gatewarden-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gatewarden/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(df: DataFrame) -> str:
    """Where a table that ``written`` made lies."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def released(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/gatewarden/" in folder.toString():
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
