"""Tables, shared scratch folders and joins used by all operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLANKS = " \t\n\x0b\x0c\r"

_LOCAL_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        folder = _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="plumbline-llm-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL_FOLDERS[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    The shuffle files behind the table are not needed once it is written, so Spark is asked to remove them then.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes the files of a table made by ``written``, once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def portions(batches: Iterator[pa.RecordBatch], size: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text, so that what a worker holds does not follow the batch."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(total // size)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            if end > start:
                yield batch.slice(int(start), int(end - start))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose sides are both dealt out anew.

    Joining an aggregate on its own keys reuses the aggregate's layout, and then adaptive execution cannot split a hot
    key. The extra key, a hash of the others, asks for fresh exchanges on both sides, which it can split.
    """
    tag = F.xxhash64(*[F.col(k) for k in keys])
    return left.withColumn("_tag", tag).join(right.withColumn("_tag", tag), [*keys, "_tag"], how).drop("_tag")
