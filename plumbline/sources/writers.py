"""Writing reports, samples and the pattern library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.collapse import OVERALL_THRESHOLD
from plumbline.operators.service_tables import performance_projection, public_dimensions, risk_projection


def report(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """One nested report per validation: results for readers, all dimension scores inside."""
    score = F.col("collapse_score")
    # a finished run whose score passes is approved for training
    approved = (F.col("status") == "completed") & (score >= OVERALL_THRESHOLD)
    public = public_dimensions(dims, "validation_id", F.col("collapse_score"))
    inner = dims.groupBy("validation_id").agg(F.map_from_entries(F.collect_list(F.struct("dim_name", "score"))).alias("scores"))  # eight entries
    both = runs.join(public, "validation_id").join(inner, "validation_id")
    names = [c for c in public.columns if c != "validation_id"]
    return both.select(
        "validation_id", "dataset_id", "status", "created_at",
        F.struct(*risk_projection(score, approved), F.struct(*performance_projection(score)).alias("predicted_performance"), F.struct(*names).alias("dimensions")).alias("results"),
        F.struct(score.alias("collapse_score"), F.col("scores").alias("dimension_scores")).alias("internal"))


def report_text(reports: DataFrame) -> DataFrame:
    return reports.select("validation_id", F.to_json(F.struct(*reports.columns)).alias("report"))


def save_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def save_sample(sample: DataFrame, path: str, strata: list[str]) -> None:
    """One folder per stratum; a large stratum is written by all tasks that hold its rows."""
    sample.write.mode("overwrite").partitionBy(*strata).parquet(path)


def save_signatures(library: DataFrame, path: str) -> None:
    """Vectors as float arrays, everything nested as JSON text."""
    nested = [f.name for f in library.schema if isinstance(f.dataType, (T.MapType, T.StructType)) or (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType))]
    out = library.select(*[F.to_json(c).alias(c) if c in nested else (F.col(c).cast("array<float>").alias(c) if c == "vector" else F.col(c)) for c in library.columns])
    out.write.mode("overwrite").parquet(path)


def load_signatures(spark: SparkSession, path: str, nested: dict[str, str]) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[F.from_json(c, nested[c]).alias(c) if c in nested else F.col(c) for c in df.columns])


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file per task. A file appears under its task's name when it is complete, so a repeated task replaces it."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        first = next(batches, None)
        if first is not None:
            name = f"{root}/part-{part:05d}.arrow"
            unfinished = f"{root}/_{part:05d}-{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(unfinished) as out, pa.ipc.new_file(out, first.schema) as w:
                w.write_batch(first)
                for batch in batches:
                    w.write_batch(batch)
            files.move(unfinished, name)
        yield pa.RecordBatch.from_pydict({"part": [part]}, schema=pa.schema([("part", pa.int32())]))

    df.mapInArrow(save, "part int").write.format("noop").mode("overwrite").save()
