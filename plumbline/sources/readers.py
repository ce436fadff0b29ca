"""Reading datasets and describing them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.sequences import positions

# File extension and the format it means.
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet",
    ".pq": "parquet", ".arrow": "arrow", ".feather": "feather",
}


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file format: {ext or path}")
    return FORMATS[ext]


def format_column(path: Column) -> Column:
    """``detect_format`` for a column of file names; null where the extension means nothing."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All files below a folder, each by the format its extension stands for; a file of another kind raises.

    Only one row for each format comes to the driver. Each format is one scan of its own files; an empty folder is an empty table.
    """
    found = list_objects(spark, path).groupBy(format_column(F.col("path")).alias("fmt")).agg(F.min("path").alias("one")).orderBy("fmt").collect()
    for r in found:
        detect_format(r["one"])
    out = spark.createDataFrame([], schema)
    for r in found:
        # glob patterns tell upper from lower case, extensions do not
        endings = ["".join(f"[{c}{c.upper()}]" for c in ext[1:]) for ext, fmt in FORMATS.items() if fmt == r["fmt"]]
        part = read(spark, path, r["fmt"], schema, files=f"*.{{{','.join(endings)}}}")
        out = out.unionByName(part.select(*[F.col(f.name).cast(f.dataType) for f in out.schema]))
    return out


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, files: str | None = None) -> DataFrame:
    """Any supported format, split by Spark; a given schema saves the inference pass over text files.

    ``files`` is a pattern of names: then all files below the path that fit it are read.
    """
    fmt = fmt or detect_format(path)
    if fmt in ("arrow", "feather"):
        return read_arrow(spark, path, schema, *([files] if files else []))
    r = spark.read if schema is None else spark.read.schema(schema)
    if files:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", files)
    if fmt in ("csv", "tsv"):
        r = r.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
        return (r.option("inferSchema", True) if schema is None else r).csv(path)
    if fmt == "json":
        return r.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return r.json(path)
    return r.parquet(path)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | str | None = None, files: str = "*.{arrow,feather}") -> DataFrame:
    """Many Arrow IPC files: only their names travel, each task opens its own files and reads batch by batch.

    Files are opened through Arrow's file systems, so their size does not matter. Without a schema the first file in
    name order is opened for its header.
    """
    names_of_files = list_objects(spark, path, glob=files).select("path")
    if schema is None:
        from pyspark.sql.pandas.types import from_arrow_schema

        with _source(names_of_files.orderBy("path").first()["path"]) as head:
            schema = from_arrow_schema(_open(head).schema)
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = schema.fieldNames()

    def decode(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with _source(name) as source:
                    opened = _open(source)
                    parts = (opened.get_batch(i) for i in range(opened.num_record_batches)) if hasattr(opened, "num_record_batches") else opened
                    for part in parts:
                        yield part.select(names)

    return names_of_files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(decode, schema)


def _source(path: str):
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_file(name)


def _open(source):
    import pyarrow as pa

    try:
        return pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source)


def list_objects(spark: SparkSession, path: str, most: int | None = None, glob: str | None = None) -> DataFrame:
    """Files below a path with size and time; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    out = r.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out if most is None else out.orderBy("path").limit(most)


def metadata(df: DataFrame) -> DataFrame:
    """One row: rows, columns, names and types; file count and size where the table comes from files."""
    names = [f.name for f in df.schema]
    kinds = [f.dataType.simpleString() for f in df.schema]
    per_file = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("s"))
    return per_file.agg(F.sum("n").alias("rows"), F.count("*").alias("files"), (F.sum("s") / (1024 * 1024)).alias("size_mb")).select(
        "rows", F.lit(len(names)).cast("bigint").alias("columns"), F.array(*map(F.lit, names)).alias("names"), F.array(*map(F.lit, kinds)).alias("types"), "files", "size_mb")


def row_estimate(df: DataFrame, rate: float) -> DataFrame:
    """One row: file bytes over the mean size of a hashed share of the rows, next to the exact count. Empty input raises.

    A share that catches no row of a small table is made up for by all rows.
    """
    some = df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000)) < rate * 1_000_000)
    head = (df if some.isEmpty() else some).select(F.length(F.to_json(F.struct(*df.columns))).alias("b")).agg(F.avg("b").alias("b")).first()["b"]
    if head is None:
        raise ValueError("the dataset is empty")
    return metadata(df).select(F.floor(F.col("size_mb") * 1024 * 1024 / F.lit(float(head))).alias("estimated_rows"), "rows")


def chunked(df: DataFrame, row_id: str, size: int, columns: list[str] | None = None, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end`` in ``row_id`` order with position, chunk number and a mark on the last chunk."""
    cols = columns or df.columns
    placed = positions(df.select(*dict.fromkeys([*cols, row_id])), [], [row_id], "pos").filter(F.col("pos") >= start)
    if end is not None:
        placed = placed.filter(F.col("pos") < end)
    chunk: Column = F.floor((F.col("pos") - start) / size)
    rows = df.agg(F.count("*")).scalar()
    last = F.floor((F.least(F.col("_n"), F.lit(end)) - start - 1) / size) if end is not None else F.floor((F.col("_n") - start - 1) / size)
    return placed.withColumn("_n", rows).select(*cols, "pos", chunk.alias("chunk_index"), (chunk == last).alias("is_last"))


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options) -> DataFrame:
    """A service table over JDBC, read in parallel key ranges if a numeric key is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()
