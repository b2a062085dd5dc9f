"""Where iterative plans put intermediate tables, and how their lineage is cut.

Executors and the driver need not share local disks, so everything is written
below ``spark.checkpoint.dir``. Only a session without that setting (a local
test) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN = "spark.memloom.scratch"
_paths: dict[int, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Local masters without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):  # local-cluster is a cluster
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.TemporaryDirectory(prefix="memloom-")
    atexit.register(own.cleanup)
    spark.conf.set(_OWN, f"file://{own.name}")
    return f"file://{own.name}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor costs the tasks that it ran; nothing before the written
    table is computed again. Parquet keeps the columns compressed and lets later
    stages read only those that they use.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut`` that nothing reads any more: what was made of them has been written."""
    for df in tables:
        path = _paths.pop(id(df), None) if df is not None else None
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    place, fs = file_system(spark, path)
    fs.delete(place, True)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and the file system that Spark uses for it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing if it isn't there."""
    place, fs = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if there is none."""
    place, fs = file_system(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in the place of the former one in one step: readers see the one or the other."""
    place, fs = file_system(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(place), how)


def write_bytes(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file into the shared folder and return its place."""
    path = f"{scratch_dir(spark)}/memloom/{name}"
    place, fs = file_system(spark, path)
    out = fs.create(place)
    out.write(bytearray(content))
    out.close()
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def there_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not have been written yet: without rows then."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A scan whose files give fewer parts than there are cores, dealt over these by ``keys``; others stay as they are.

    Work on whole texts then runs on all cores. Few parts mean a small table, so the
    texts that move are bounded by the cores, not by the data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def first_rows(df: DataFrame, by: list[Column], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each group, with their columns as they are. Each task keeps its own first rows before they meet."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.select(row.alias("row"), place.alias("place")).filter(F.col("place") <= k).select("row.*")
