"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

DataFrame functions only. Texts are shuffled once; everything else that moves is hashes, ids and positions. A hot line
is counted per task before the shuffle, and the join that brings the verdict back to its lines can be split by
adaptive execution, because it only produces positions.

Defined cases: a null or empty text is one empty line; a null id is one document, smaller than every other; rows that
repeat an id are one document when documents are counted, each keeping its own lines; an exact tie cannot occur, since
a line stays in exactly one document id; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, ascii_lower, spread_join, table
from plumbline.registry import query


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ref, n_lines, n_dropped, text) and the columns ``keep``: every input row without its repeated lines.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents keep their lines only in the
    largest document id. ``ref`` is a hash of id and text, which tells apart rows that share an id.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), F.split("text", "\n").alias("lines"), *keep)
    lines = rows.select("doc_id", "ref", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    # two hashes of other seeds make one of 128 bits
    lines = lines.where(F.char_length("key") >= min_chars).select(
        "doc_id", "ref", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    holders = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    repeated = holders.where(F.col("n") >= min_docs).select("h1", "h2", "last")
    doomed = spread_join(lines, repeated, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    doomed = doomed.groupBy(F.col("ref").alias("drop_ref"), F.col("doc_id").alias("drop_id")).agg(F.collect_set("pos").alias("drops"))
    both = rows.join(doomed, (F.col("ref") == F.col("drop_ref")) & F.col("doc_id").eqNullSafe(F.col("drop_id")), "left")
    # the join makes "lines" a plain column, so the lambda looks lines up instead of splitting again
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops")), lambda p: F.get("lines", p))
    return both.select(
        "doc_id", "ref", *keep, F.size("lines").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"),
        F.array_join(F.when(F.col("drops").isNull(), F.col("lines")).otherwise(kept), "\n").alias("text"))


SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2("text", 256).alias("kept_sha256"))
