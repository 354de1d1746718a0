"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)

#: Words between white space, and words of ASCII letters, digits and anything beyond ASCII (after lower-casing).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
space_words = re.compile(SPACE_WORD).findall
alnum_words = re.compile(ALNUM_WORD).findall


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z only, as the contracts ask; other letters stay as they are."""
    return F.translate(col, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may do without a named one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "roadweave-tables")


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The plan is computed now, written as a table in the shared folder and read from there; ``codec``: of its Parquet files, by default the session's.

    ``release`` removes the table once nothing needs it; others stay for the session's later jobs.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what ``cut`` wrote for these tables."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._table)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(df: DataFrame) -> int:
    """Partitions that the session deals shuffles into; sized by the cluster for its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
