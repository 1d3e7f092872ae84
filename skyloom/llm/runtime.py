"""Session helpers shared by the operators: shared storage, input columns, plans."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` of the session; where the session names none and the
    master is local (tests) a folder under the temporary directory is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "skyloom-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    survives lost executors, and is never computed a second time."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; nothing may read them again."""
    for frame in frames:
        if path := getattr(frame, "_stored_at", None):
            jvm = frame.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def relieve(spark: SparkSession) -> None:
    """Have the driver collect its garbage: frames that Python let go, their plans, broadcasts and
    shuffle files go, and the heap shrinks, which many small jobs have made larger than it needs to be."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (null key: null)."""
    return F.crc32(key.cast("string")) % F.lit(n)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions_for(spark: SparkSession, floor: int = 1) -> int:
    """The session's shuffle width."""
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_strings(column: pa.Array) -> pa.Array:
    """A null-free string array (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column
