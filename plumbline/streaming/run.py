"""Reading event files as a stream and running a stream to the end of its input."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder for progress and results below ``spark.checkpoint.dir``; a local session may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="plumbline-stream-")
    return os.path.join(base, f"run-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files as they arrive; ``path`` may be a folder or a pattern."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


FILES_PER_BATCH = 64


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table as a stream of bounded batches, which also bounds what one key brings to a stateful step."""
    return file_stream(spark, f"{sf_dir}/{name}.parquet*", spark.read.parquet(f"{sf_dir}/{name}.parquet").schema, FILES_PER_BATCH)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which timers and typed state need."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Work through all input there is and read back what was written.

    ``append`` collects every row, ``complete`` and ``update`` keep the output of the last batch; an update stream
    over several batches is read through ``latest_updates``.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = os.path.join(folder, "out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(folder, "progress")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    written: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        # every batch has its own folder, so a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/batch={max(written)}")
    return spark.read.parquet(out)


def run_batches(stream: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Work through all input there is, a batch job for every micro-batch, and read back the rows they wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = os.path.join(folder, "out")

    def keep(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", os.path.join(folder, "progress")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def latest_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of every key of an update stream."""
    from pyspark.sql import functions as F

    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
