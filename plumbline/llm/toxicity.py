"""Toxicity by compression distance with separate zstandard dictionaries.

The ordinary dictionary holds the most frequent words of ordinary texts; the toxic one holds the same and, in front,
the words and word beginnings that texts labelled toxic have far more often. A term is taken if the lower confidence
bound of its rate in toxic texts over that in ordinary ones exceeds ``LEAST_RATIO``; which of the ``BOUNDS`` is used is
decided by the calibrating labels, by the loss for which the threshold is the best one. A window of eight words is
compressed with both; how many bytes the toxic dictionary saves is the window's distance. Since the common part is laid out alike, other windows come
out equal, while dictionaries of unlike texts differ by chance everywhere. A text's evidence is the sum of its three
largest savings. Evidence is turned into a probability by the share of toxic texts at each evidence, made
non-decreasing, on labelled texts that neither built the dictionaries nor are held out.

Labels are split by crc32(id) mod 4: 0 and 1 build the dictionaries, 3 calibrates, 2 is held out. At most about
``sample_rows`` labelled rows are used (a hash sample of the labels); they and their term counts, a Spark aggregation, are
written once, and only the top terms and a table of evidence counts reach the driver. All texts are scored whole.

Defined cases: null and empty texts have evidence 0; labels that are null or lack a text are not used; rows that repeat
an id are scored each by its own text, and contradicting labels count as toxic; without a toxic or an ordinary label, or
without terms that tell them apart, all scores are the share of toxic labels, kept below the threshold; words longer than
64 bytes enter no dictionary; without calibrating labels (fold 3) all scores are 0; a null id is not held out; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, portions, table, written
from plumbline.registry import query

THRESHOLD = 0.3
SAMPLE_ROWS = 40_000
ORDINARY_WORDS, TOXIC_WORDS, WORD_BYTES = 20_000, 1000, 64
#: rate ratio that the lower bound must exceed, and the bounds to choose from, in standard errors
LEAST_RATIO, BOUNDS = 3.0, (1.3, 1.64, 2.0, 2.5, 3.0, 4.0)
#: characters of the word beginnings
BEGINNINGS = (4, 5, 6, 7, 8)
WINDOW_WORDS = 8
LEVEL = 10
TOP_WINDOWS = 3
MOST_EVIDENCE = 60
HELD_OUT = 2


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


@dataclass(frozen=True)
class Model:
    """Dictionary contents, and the probability at each evidence from 0 to ``MOST_EVIDENCE``."""

    ordinary: bytes
    toxic: bytes
    chances: tuple[float, ...]


class Scorer:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.alike = ordinary == toxic
        self.ordinary, self.toxic = (self.compressor(d) for d in (ordinary, toxic)) if not self.alike else (None, None)

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False, write_checksum=False)

    def evidence(self, text: str | None) -> int:
        words = (text or "").encode().lower().split()
        if self.alike or not words:
            return 0
        windows = [b" " + b" ".join(words[k : k + WINDOW_WORDS]) + b" " for k in range(0, len(words), WINDOW_WORDS)]
        saved = sorted((len(self.ordinary.compress(w)) - len(self.toxic.compress(w)) for w in windows), reverse=True)
        return min(MOST_EVIDENCE, sum(max(0, s) for s in saved[:TOP_WINDOWS]))


def non_decreasing(toxic: np.ndarray, total: np.ndarray) -> list[float]:
    """Shares by evidence, pooled where they would fall; evidences that were not seen lie between their neighbours."""
    seen = np.flatnonzero(total)
    if not len(seen):
        return [0.0] * len(total)
    pools: list[list[float]] = []
    for t, n in zip(toxic[seen], total[seen], strict=True):
        pools.append([t, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.interp(np.arange(len(total)), seen, [t / n for t, n, k in pools for _ in range(k)]).tolist()


def scored(rows: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """The rows with ``text`` replaced by its evidence, as the last column."""
    kept = [(n, t) for n, t in rows.dtypes if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ordinary, toxic)
        for batch in portions(batches):
            evidence = pa.array([scorer.evidence(t) for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n, _ in kept), evidence], [*(n for n, _ in kept), "evidence"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kept) + ", evidence int")


def terms(text: F.Column) -> F.Column:
    """The distinct words of a text between blanks, and the beginnings of longer words after a blank."""
    words = F.array_distinct(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"))
    words = F.filter(words, lambda w: (w != "") & (F.octet_length(w) <= WORD_BYTES))
    begun = [F.transform(F.filter(words, lambda w, n=n: F.char_length(w) > n), lambda w, n=n: F.concat(F.lit(" "), F.substring(w, 1, n))) for n in BEGINNINGS]
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), *begun))


def dictionaries(common: list[str], telling: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic content, from common words by falling frequency and telling terms."""
    told = set(telling)
    common = [w for w in common if w not in told and not any(w[: n + 1] in told for n in BEGINNINGS)]
    # a term that begins another one is part of it
    ordered = sorted(told)
    part = {a for a, b in zip(ordered, ordered[1:], strict=False) if b.startswith(a)}
    # the most frequent words last, where they are cheapest to refer to
    ordinary = (" " + " ".join(w.strip() for w in reversed(common)) + " ").encode()
    return ordinary, "".join(t for t in telling if t not in part).encode() + ordinary


def calibrating(rows: DataFrame, pairs: list[tuple[bytes, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of dictionaries how many toxic texts and how many in all have each evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(*p) for p in pairs]
        for batch in portions(batches):
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            out = [(k, s.evidence(t), y) for k, s in enumerate(scorers) for t, y in zip(texts, toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*out, strict=True)], ["pair", "evidence", "toxic"])

    tables = [(np.zeros(MOST_EVIDENCE + 1), np.zeros(MOST_EVIDENCE + 1)) for _ in pairs]
    for r in rows.select("toxic", "text").mapInArrow(run, "pair int, evidence int, toxic int").groupBy("pair", "evidence", "toxic").count().collect():
        hits, total = tables[r["pair"]]
        total[r["evidence"]] += r["count"]
        hits[r["evidence"]] += r["count"] * r["toxic"]
    return tables


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    marks = marks.withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    share = min(1.0, sample_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # at most about sample_rows rows of three numbers
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id").select("toxic", "fold", "text"), "labelled")

    building = rows.where("fold < 2")
    totals = {r["toxic"]: r["n"] for r in building.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_ordinary = totals.get(1, 0), totals.get(0, 0)
    pairs = [(b"", b"")]
    if n_toxic and n_ordinary:
        seen = building.select("toxic", F.explode(terms(F.col("text"))).alias("term"))
        counts = written(seen.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")), "terms")
        ratio = F.log((F.col("t") + 0.5) / (F.col("o") + 0.5)) + math.log((n_ordinary + 1) / (n_toxic + 1)) - math.log(LEAST_RATIO)
        error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
        words = counts.where("o > 0 AND endswith(term, ' ')")
        common = [r["term"] for r in words.orderBy(F.desc("o"), "term").limit(ORDINARY_WORDS).select("term").collect()]
        pairs = []
        for z in BOUNDS:
            low = ratio - z * error
            telling = counts.where((F.col("t") > 0) & (low > 0)).orderBy(F.desc(low), "term").limit(TOXIC_WORDS).select("term").collect()
            pairs.append(dictionaries(common, [r["term"] for r in telling]))

    best = None
    for pair, (hits, total) in zip(pairs, calibrating(rows.where("fold = 3"), pairs), strict=True):
        chances = non_decreasing(hits, total)
        # no evidence is never a reason to reject
        chances[0] = min(chances[0], THRESHOLD - 0.01)
        flagged = np.array(chances) >= THRESHOLD
        loss = (1 - THRESHOLD) * hits[~flagged].sum() + THRESHOLD * (total - hits)[flagged].sum()
        # of equals the strictest
        if best is None or loss <= best[0] + 1e-9:
            best = loss, Model(*pair, tuple(chances))
    return best[1]


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, score, predicted) for every input row; with ``keep`` also these columns and the text."""
    kept = [*keep, *(["whole"] if keep else [])]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep, *([F.col(text).alias("whole")] if keep else []))
    out = scored(rows, model.ordinary, model.toxic)
    score = F.get(F.array(*[F.lit(float(c)) for c in model.chances]), F.col("evidence"))
    out = out.select("doc_id", *kept, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return out.withColumnRenamed("whole", "text")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
