"""Suffix dedup: byte strings of a given length that occur again, in any document.

A suffix array of a whole corpus would pass through one task, so its order is kept by content fingerprints instead: of
the longest-previous-factor array only "at least ``min_bytes``" is asked for, and that holds exactly if the suffix's
first ``min_bytes`` bytes (its window) were seen at a smaller position. Windows with equal content are neighbours in
suffix order; the previous smaller position of each is the smallest of them.

Comparing all windows would shuffle each byte many times over. So only these are compared:

1. Every window is named by its anchor, the substring of 48 bytes in it with the least hash (the first of equal ones).
   Equal windows have equal anchors at equal places. The windows of one anchor follow each other; together they are a
   span. One row for each 77 bytes or so is shuffled; anchors that occur once are done with.
2. Equal spans: all their windows recur, no window is looked at.
3. Only where spans of one anchor differ (at the borders of a repeat), one occurrence of each different span is opened.
   Its windows are taken eight by eight, at fixed places from the anchor. The bytes all eight share are the anchor of
   such a class, and the bytes they cover are its span, so steps 1 and 2 settle most classes.
4. Where classes still differ, their windows are counted by fingerprint.

Anchors and windows that occur in a third of all documents are counted in each task first, and the joins that bring the
verdict back to the rows can be split.

Fingerprints have 128 bits: anchor and content are hashed with other bases. Hashes are polynomials modulo 2^64 over random
byte values.

Defined cases: null texts are empty; texts shorter than a window have no windows; matches never cross documents; rows
that repeat id and text count as copies of each other (keeping the first keeps them all); an empty table gives an empty table. Long texts are worked off in
pieces of a million windows, which only changes how windows are grouped. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import portions, removed, spread_join, table, written
from plumbline.llm.minhash import mixed
from plumbline.registry import query

PIECE = 1 << 20
INDEX_BITS = np.uint64((1 << 21) - 1)
ANCHOR = 48
CLASS = 8
SPANS = "doc_id long, ref long, anchor long, span long, start long, windows int, lead int"
WINDOWS = "doc_id long, ref long, anchor long, window long, start long"


class Powers:
    """Hashes of all substrings of one length in a piece of bytes."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + rng.integers(0, 2, 256, np.uint64)
        base = (int(rng.integers(0, 2**61)) * 8 + 5) % 2**64
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(base, -1, 2**64), np.uint64)])

    def sums(self, raw: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.values[raw] * self.up[: len(raw)])]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_POWERS: list[Powers] = []


def powers() -> list[Powers]:
    if not _POWERS:
        _POWERS.extend(Powers(seed, PIECE + (1 << 16)) for seed in (11, 12))
    return _POWERS


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width`` values."""
    n = len(values)
    padded = np.r_[values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans_of(raw: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor hash, span hash, way to the anchor) of all spans of texts laid end to end.

    ``ends`` gives for each byte the end of its text.
    """
    none = (np.array([], np.int64),) * 5
    if len(raw) < size:
        return none
    one, two = powers()
    anchor = min(ANCHOR, size)
    first, second = one.sums(raw), two.sums(raw)
    at = np.arange(len(raw) - anchor + 1)
    grams = mixed(one.of(first, at, at + anchor))
    least = window_minima((grams & ~INDEX_BITS) | at.astype(np.uint64), size - anchor + 1)
    place = (least & INDEX_BITS).astype(np.int64)
    starts = np.arange(len(place))
    valid = starts + size <= ends[: len(place)]
    new = valid & np.r_[True, (place[1:] != place[:-1]) | ~valid[:-1]]
    stop = valid & np.r_[(place[1:] != place[:-1]) | ~valid[1:], True]
    begin, last = np.flatnonzero(new), np.flatnonzero(stop)
    if not len(begin):
        return none
    place = place[begin]
    shape = (place - begin).astype(np.uint64) * np.uint64(1 << 32) + (last - begin).astype(np.uint64)
    span = mixed(two.of(second, begin, last + size) ^ mixed(shape))
    return begin, last - begin + 1, grams[place].view(np.int64), span.view(np.int64), place - begin


def pieces(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, end of each byte's text, text number of each byte, offset of each byte): short texts together, long ones cut with an overlap."""
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def joined() -> tuple[np.ndarray, ...]:
        lens = np.array([len(b) for _, _, b in held])
        ends = np.cumsum(lens)
        return (np.frombuffer(b"".join(b for _, _, b in held), np.uint8), np.repeat(ends, lens),
                np.repeat([k for k, _, _ in held], lens), np.arange(ends[-1]) - np.repeat(ends - lens, lens) + np.repeat([o for _, o, _ in held], lens))

    for k, text in enumerate(texts):
        if len(text) < size:
            continue
        for at in range(0, len(text) - size + 1, PIECE - size):
            part = text[at : at + PIECE - 1]
            if total + len(part) > PIECE and held:
                yield joined()
                held, total = [], 0
            held.append((k, at, part))
            total += len(part)
    if held:
        yield joined()


def anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            ids, refs = batch.column("doc_id"), batch.column("ref")
            for raw, ends, owner, offset in pieces([t.encode() for t in batch.column("text").to_pylist()], size):
                begin, count, anchor, span, lead = spans_of(raw, ends, size)
                own = pa.array(owner[begin])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(own), refs.take(own), pa.array(anchor), pa.array(span), pa.array(offset[begin]), pa.array(count, pa.int32()), pa.array(lead, pa.int32())],
                    ["doc_id", "ref", "anchor", "span", "start", "windows", "lead"])

    return docs.mapInArrow(run, SPANS)


def class_rows(docs: DataFrame, size: int) -> DataFrame:
    """The classes of the spans that ``docs`` lists in the column ``spans`` (start, windows, anchor, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = powers()[1]
        for batch in portions(batches):
            for doc_id, ref, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ref", "text", "spans")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                out: list[tuple[np.ndarray, ...]] = []
                for s in spans:
                    sums = two.sums(raw[s["start"] : s["start"] + s["windows"] - 1 + size])
                    # windows by their way to the anchor: a class holds those of q * CLASS to q * CLASS + CLASS - 1
                    q = np.arange((s["lead"] - s["windows"] + 1) // CLASS, s["lead"] // CLASS + 1)
                    first = np.maximum(s["lead"] - q * CLASS - CLASS + 1, 0)
                    last = np.minimum(s["lead"] - q * CLASS, s["windows"] - 1)
                    core = s["lead"] - q * CLASS
                    inner = two.of(sums, core, core - CLASS + 1 + size)
                    shape = ((s["lead"] - first) % CLASS * CLASS + (s["lead"] - last) % CLASS).astype(np.uint64)
                    anchor = mixed(mixed(inner) ^ mixed(np.array(s["anchor"], np.int64).view(np.uint64) + q.astype(np.uint64)))
                    out.append((anchor.view(np.int64), mixed(two.of(sums, first, last + size) ^ mixed(shape)).view(np.int64), first + s["start"], last - first + 1))
                anchor, span, start, count = (np.concatenate(c) for c in zip(*out, strict=True))
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([ref] * n, pa.int64()), pa.array(anchor), pa.array(span), pa.array(start),
                     pa.array(count, pa.int32()), pa.array(np.zeros(n), pa.int32())], ["doc_id", "ref", "anchor", "span", "start", "windows", "lead"])

    return docs.select("doc_id", "ref", "text", "spans").mapInArrow(run, SPANS)


def window_rows(docs: DataFrame, size: int) -> DataFrame:
    """The windows of the spans that ``docs`` lists in the column ``spans`` (start, windows, anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = powers()[1]
        for batch in portions(batches):
            for doc_id, ref, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ref", "text", "spans")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                spans.sort(key=lambda s: s["start"])
                for k in range(0, len(spans), 1024):
                    part = spans[k : k + 1024]
                    starts, anchors, prints = [], [], []
                    for s in part:
                        own = np.arange(s["windows"])
                        sums = two.sums(raw[s["start"] : s["start"] + s["windows"] - 1 + size])
                        prints.append(mixed(two.of(sums, own, own + size)))
                        starts.append(own + s["start"])
                        anchors.append(np.full(s["windows"], s["anchor"], np.int64))
                    starts = np.concatenate(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(starts), pa.int64()), pa.array([ref] * len(starts), pa.int64()), pa.array(np.concatenate(anchors)),
                         pa.array(np.concatenate(prints).view(np.int64)), pa.array(starts, pa.int64())], ["doc_id", "ref", "anchor", "window", "start"])

    return docs.select("doc_id", "ref", "text", "spans").mapInArrow(run, WINDOWS)


PLACE = ("doc_id", "ref", "start")


def settled(rows: DataFrame, size: int, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Ranges (doc_id, ref, start, end) of equal spans, and one occurrence of each span of anchors with different spans.

    ``rows`` is a written table; it is removed once the rows of shared anchors are written.
    """
    place = F.struct(*PLACE)
    often = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = written(spread_join(rows, often, ["anchor"]), "shared")
    removed(rows)
    kinds = shared.groupBy("anchor", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.max("windows").alias("windows"), F.max("lead").alias("lead"))
    kinds = written(kinds, "kinds")
    again = spread_join(shared, kinds.where("n > 1").select("anchor", "span", "first"), ["anchor", "span"])
    if keep_first:
        again = again.where(place != F.col("first"))
    again = again.select(*PLACE, (F.col("start") + F.col("windows") - 1 + size).alias("end"))
    different = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    return again, spread_join(kinds, different, ["anchor"]).select("first.*", "windows", "anchor", "lead")


def with_spans(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """The documents of the opened spans, each with its list."""
    lists = opened.groupBy(F.col("doc_id").alias("own_id"), F.col("ref").alias("own_ref")).agg(F.collect_list(F.struct("start", "windows", "anchor", "lead")).alias("spans"))
    return docs.join(lists.hint("merge"), (F.col("ref") == F.col("own_ref")) & F.col("doc_id").eqNullSafe(F.col("own_id")))


def repeated_ranges(rows: DataFrame, size: int, keep_first: bool) -> DataFrame:
    """Written ranges (doc_id, ref, start, end) of documents (doc_id, ref, text), each made of windows that recur."""
    place = F.struct(*PLACE)
    spans, opened = settled(written(anchor_rows(rows, size), "anchors"), size, keep_first)
    classes, opened = settled(written(class_rows(with_spans(rows, opened), size), "classes"), size, keep_first)
    windows = written(window_rows(with_spans(rows, opened), size), "windows")
    known = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    found = spread_join(windows, known, ["anchor", "window"])
    if keep_first:
        found = found.where(place != F.col("first"))
    found = found.select(*PLACE, (F.col("start") + size).alias("end"))
    return written(spans.unionByName(classes).unionByName(found), "ranges")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_bytes: int = 200, keep_first: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept) for every input row; ``kept`` holds the remaining bytes.

    Bytes covered by a string of ``min_bytes`` that occurs elsewhere are removed: with ``keep_first`` from all but the
    first occurrence (by document id, then place), else from all.
    """
    if min_bytes < CLASS:
        raise ValueError(f"min_bytes must be at least {CLASS}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("ref"), "text")
    ranges = repeated_ranges(rows, min_bytes, keep_first)
    ranges = ranges.groupBy(F.col("doc_id").alias("own_id"), F.col("ref").alias("own_ref")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    both = rows.join(ranges, (F.col("ref") == F.col("own_ref")) & F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw, kept, spans, at, gone = text.encode(), [], 0, 0, 0
                for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if start > at or not spans:
                        spans += 1
                        kept.append(raw[at:start])
                        at = start
                    gone += max(0, end - at)
                    at = max(at, end)
                out.append((len(raw), gone, spans, b"".join(kept) + raw[at:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"), keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
