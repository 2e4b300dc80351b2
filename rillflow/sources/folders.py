"""Folders of a pipeline: in the one that spark.checkpoint.dir names, which all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import CoreIo


def new_folder(spark: SparkSession, what: str) -> str:
    """A name in the shared folder. Where none is set and Spark runs in this process alone, in a temporary one, which goes at exit."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise CoreIo("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="rillflow-")
        atexit.register(shutil.rmtree, own, True)
        conf = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, url: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(spark: SparkSession, url: str) -> int:
    """Bytes of its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def write_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file of a shared folder, written aside (with a name that readers skip) and renamed, so that it appears whole."""
    jvm = spark._jvm
    aside, path = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}.tmp"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, path):
        raise CoreIo(f"can't write {folder}/{name}")


def table(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
