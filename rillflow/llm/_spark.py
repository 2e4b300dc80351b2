"""Shared folders, tables that cut lineage, array files for workers, lean workers, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch that Spark hands to a worker, if the session doesn't say; rows of any length count by their bytes.
BATCH_BYTES = 8 << 20
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it's unset and Spark runs in this process alone, one of our own, which goes at exit."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="rillflow-")
        atexit.register(shutil.rmtree, own, True)
        conf = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def new_folder(spark: SparkSession, what: str) -> str:
    out = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append(out)
    return out


def release(spark: SparkSession) -> None:
    """Deletes the folders that this process has made in the shared folder. Frames that aren't written yet may still read them."""
    jvm = spark._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's garbage is collected, which else may not happen for long."""
    for _ in range(2):  # the JVM's plans are let go only after Python's frames are, and a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def array_folder(spark: SparkSession, what: str) -> str:
    """A folder for files that workers map into memory. The shared folder must be mounted on every machine."""
    url = new_folder(spark, what)
    if url.startswith("file:"):
        path = "/" + url[5:].lstrip("/")
    elif url.startswith("/"):
        path = url
    else:
        raise ValueError(f"spark.checkpoint.dir must be a mounted (file:) folder for memory-mapped models, not {url}")
    os.makedirs(path, exist_ok=True)
    return path


def save_array(path: str, values: np.ndarray) -> None:
    """Written aside and renamed, so that a task that runs twice leaves one whole file."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(aside, "wb") as f:
        np.save(f, values)
    os.replace(aside, path)


def load_array(path: str) -> np.ndarray:
    """A file that must be there, mapped into memory."""
    try:
        return np.asarray(np.load(path, mmap_mode="r"))  # slices of a plain array cost less than those of a mapped one
    except ValueError:  # an empty array can't be mapped
        return np.load(path)
    except FileNotFoundError as e:
        raise FileNotFoundError(f"{path} was written and is not there: the folder of spark.checkpoint.dir must be mounted on every machine") from e


def table(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of such a table, which nothing reads any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def n_buckets(spark: SparkSession, times: int = 1) -> int:
    """Buckets follow spark.sql.shuffle.partitions, which is set by the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy() -> None:
    """Gives freed memory back to the system: workers are used again, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches of bounded bytes and a worker that gives its memory back."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(lean, schema)


def map_groups(df: DataFrame, by: str, run: Callable, schema: str) -> DataFrame:
    """df.groupBy(by).applyInArrow, with the same care."""

    def lean(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            tidy()

    return df.groupBy(by).applyInArrow(lean, schema)


class Carried:
    """Columns that a worker passes through, under names that clash with nothing."""

    def __init__(self, docs: DataFrame, keep: list[str], *more):
        self.keep = list(keep)
        self.rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(self.keep)], *more)
        self.n = len(self.keep)

    def run(self, run: Callable, results: str) -> DataFrame:
        """run yields, for each batch, arrays of the carried columns and of the results ("name type, ..."). A carried column that has a result's name comes back with `_kept` behind its own."""
        kinds = [t for _, t in self.rows.dtypes[: self.n]]
        names = [r.strip().split(" ", 1)[0] for r in results.split(", ")]
        schema = ", ".join([*(f"_k{i} {t}" for i, t in enumerate(kinds)), results])
        out = [f"_k{i}" for i in range(self.n)] + names

        def batches(it):
            for columns in run(it):
                yield pa.RecordBatch.from_arrays(columns, names=out)

        taken, back = set(names) | set(self.keep), []
        for c in self.keep:
            new = c
            while new in names or (new != c and new in taken):
                new += "_kept"
            back.append(new)
            taken.add(new)
        return map_batches(self.rows, batches, schema).toDF(*back, *names)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long) by large-star and small-star steps: (node, component), component the smallest node.

    Each round is a few group-bys over the remaining links, written to the shared folder; nothing comes to the driver but counts.
    The steps map each neighbour of a node by itself, so hot nodes are joined to their minimum, never gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = both.join(low, "u")
        if large:
            return j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v")

    edges = table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = None
    while True:
        state = edges.agg(sign.alias("s")).first()["s"]
        if state["n"] == 0 or state == before:
            break
        before = state
        edges = table(star(star(edges, True).distinct(), False).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
