"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters occurs in a text with at most e edits only if both share at least m + 1 - q - q * e q-grams whose
diagonals (text position minus item position) lie within e of each other. So for each item the shared q-grams are counted
in overlapping diagonal bands, bands that reach the bound are kept, and each is verified by a banded alignment, many at
once as numpy rows.

Items are compared after lower-casing and joining words by single blanks; e is 8 % of the item's length, or less if the
bound would not be positive. Items travel to the tasks in blocks of at most ``block_chars`` characters. With one block nothing is
shuffled. With more, each is a scan of its own whose hits are written before the next block is collected, so a driver or worker
holds one block at a time whatever the size of the benchmark; the hits are then joined to the texts.

Defined cases: null or empty texts hold no item; items that are null or shorter than q characters are never found; equal
items are all reported, as are several items of one document; an item found in several places is reported at its best
place, the first of equal ones; rows that repeat an id are judged each by its own text; long texts are worked off in
overlapping pieces, which changes no result; empty tables are fine on either side. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import portions, table, written
from plumbline.llm.minhash import mixed
from plumbline.registry import query

Q = 10
EDIT_RATE = 0.08
BLOCK_CHARS = 1_000_000
PIECE = 1 << 19
MAP_BITS = 22
ENTRIES = 1 << 20
CELLS = 1 << 19
SHIFT = 1 << 32
BORDER = np.uint32(0xFFFFFFFE)
FOUND = "array<struct<item_id:long,start:long,end:long,edits:int>>"
FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(chars: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(chars) - Q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(Q if n > 0 else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += chars[k : k + n]
    return mixed(out)


class Items:
    """The q-gram index of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        kept = [(i, code_points(plain(t))) for i, t in items]
        kept = [(i, c) for i, c in kept if len(c) >= Q]
        self.ids = [i for i, _ in kept]
        self.chars = [c for _, c in kept]
        self.sizes = np.array([len(c) for c in self.chars], np.int64)
        self.edits = np.minimum((self.sizes * EDIT_RATE).astype(np.int64), (self.sizes - Q) // Q)
        self.bound = self.sizes + 1 - Q - Q * self.edits
        self.width = 2 ** np.ceil(np.log2(np.maximum(self.edits + 1, 16))).astype(np.int64)
        self.reach = int((self.sizes + 4 * self.edits + 2 * self.width).max()) if kept else 0
        hashes = np.concatenate([grams(c) for c in self.chars]) if kept else np.array([], np.uint64)
        owner = np.repeat(np.arange(len(kept)), self.sizes - Q + 1)
        place = np.concatenate([np.arange(n - Q + 1) for n in self.sizes]) if kept else owner
        order = np.argsort(hashes, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(hashes)])
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self.grams >> np.uint64(64 - MAP_BITS)] = True

    def bands(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal) of the bands that share enough q-grams with the text.

        Shared q-grams are counted in runs of about ``ENTRIES``, and a band is settled once the text is past it, so what is held
        follows the items, not how often the text repeats their q-grams.
        """
        hashes = grams(chars)
        at = np.flatnonzero(self.map[hashes >> np.uint64(64 - MAP_BITS)])
        known = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        same = self.grams[known] == hashes[at]
        at, known = at[same], known[same]
        entries = np.cumsum(self.count[known])
        keys, n = np.array([], np.int64), np.array([], np.int64)
        ready: list[np.ndarray] = []
        first = 0
        while first < len(at):
            done = entries[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(entries, done + ENTRIES, "right")))
            more, hits = self.band_hits(at[first:last], known[first:last])
            keys, where = np.unique(np.r_[keys, more], return_inverse=True)
            n = np.bincount(where, np.r_[n, hits]).astype(np.int64)
            first = last
            # the bands that a later place of the text can still reach stay open
            item, band = keys // SHIFT, keys % SHIFT - (SHIFT >> 1)
            reached = (band + 1) * self.width[item] + self.edits[item] + self.sizes[item]
            closed = reached < (at[first] if first < len(at) else np.iinfo(np.int64).max)
            ready.append(keys[closed & (n >= self.bound[item])])
            keys, n = keys[~closed], n[~closed]
        found = np.concatenate(ready) if ready else keys
        item = found // SHIFT
        return item, (found % SHIFT - (SHIFT >> 1)) * self.width[item]

    def band_hits(self, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, number of shared q-grams) of the bands met by the q-grams ``known`` at the places ``at``."""
        count = self.count[known]
        entry = np.repeat(self.first[known] - np.cumsum(count) + count, count) + np.arange(count.sum())
        item, diagonal = self.owner[entry], np.repeat(at, count) - self.place[entry]
        width = self.width[item]
        band = diagonal // width
        low = diagonal - band * width <= self.edits[item]
        item, band = np.r_[item, item[low]], np.r_[band, band[low] - 1]
        return np.unique(item * SHIFT + band + (SHIFT >> 1), return_counts=True)

    def aligned(self, chars: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the bands whose best alignment keeps within the item's edits."""
        order = np.argsort(self.sizes[item], kind="stable")
        k = 0
        while k < len(item):
            # long items go fewer at once
            longest = self.sizes[item[order[min(k + 256, len(item)) - 1]]]
            batch = order[k : k + max(1, min(256, CELLS // int(longest)))]
            k += len(batch)
            own = item[batch]
            low = diagonal[batch] - self.edits[own]
            wide = int((self.width[own] + 3 * self.edits[own] + 2).max())
            rows = int(self.sizes[own].max())
            source = np.full((rows, len(own), 1), BORDER + np.uint32(1), np.uint32)
            for r, x in enumerate(own):
                source[: self.sizes[x], r, 0] = self.chars[x]
            at = low[:, None] + np.arange(rows + wide)
            target = np.where((at >= 0) & (at < len(chars)), chars[np.clip(at, 0, len(chars) - 1)], BORDER)
            step = np.arange(wide, dtype=np.int32)
            # one column more than the band, which nothing can come from
            cost = np.full((len(own), wide + 1), rows + wide, np.int32)
            cost[:, :wide] = 0
            start = np.empty((len(own), wide + 1), np.int32)
            start[:] = np.arange(wide + 1)
            final, origin = np.empty((len(own), wide), np.int32), np.empty((len(own), wide), np.int32)
            line = np.arange(len(own))[:, None]
            for i in range(rows):
                best = cost[:, :wide] + (source[i] != target[:, i : i + wide])
                skip = cost[:, 1:] + np.int32(1)
                less = skip < best
                origin_now = np.where(less, start[:, 1:], start[:, :wide])
                np.minimum(best, skip, out=best)
                # extra text characters: the running minimum along the row, one edit for each step
                best -= step
                run = np.minimum.accumulate(best, axis=1)
                source_of = np.maximum.accumulate(np.where(best == run, step, 0), axis=1)
                start[:, :wide] = origin_now[line, source_of]
                cost[:, :wide] = run + step
                done = np.flatnonzero(self.sizes[own] == i + 1)
                if len(done):
                    final[done], origin[done] = cost[done, :wide], start[done, :wide]
            end = final.argmin(axis=1)
            for r, x in enumerate(own):
                edits = int(final[r, end[r]])
                if edits <= self.edits[x]:
                    yield int(x), int(low[r] + origin[r, end[r]]), int(low[r] + self.sizes[x] + end[r]), edits

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text the items it holds, each at its best place: (item id, start, end, edits) in the plain text."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        # no alignment within the edits gets across a border
        border = np.full(int(self.edits.max(initial=0)) + 1, BORDER, np.uint32)

        def work() -> None:
            joined = np.concatenate([x for _, _, c in held for x in (c, border)])
            begins = np.cumsum([0] + [len(c) + len(border) for _, _, c in held])
            for x, start, end, edits in self.aligned(joined, *self.bands(joined)):
                text, offset, chars = held[p := int(np.searchsorted(begins, (start + end) // 2, "right")) - 1]
                start, end = max(start - begins[p], 0) + offset, min(end - begins[p], len(chars)) + offset
                hit = (edits, int(start), int(end))
                if x not in best[text] or hit < best[text][x]:
                    best[text][x] = hit

        if self.ids:
            for k, text in enumerate(texts):
                chars = code_points(plain(text))
                for at in range(0, max(len(chars) - Q + 1, 0), PIECE):
                    part = chars[at : at + PIECE + self.reach]
                    if held and total + len(part) > PIECE:
                        work()
                        held, total = [], 0
                    held.append((k, at, part))
                    total += len(part)
            if held:
                work()
        return [[(self.ids[x], start, end, edits) for x, (edits, start, end) in sorted(b.items())] for b in best]


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, text, found) and the columns ``keep`` for every input row; ``found`` lists the items in it."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.char_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(1.5 * size / block_chars)) if size > block_chars else 1
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    if blocks == 1:
        return found_in(rows, items)
    rows = rows.withColumn("_ref", F.xxhash64("doc_id", "text"))
    hits = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        some = written(found_in(rows.select("doc_id", "text", "_ref"), own).where("size(found) > 0").select("doc_id", "_ref", "found"), "items-found")
        # rows that repeat an id and its text hold the same items
        some = some.dropDuplicates(["doc_id", "_ref"])
        hits = some if hits is None else hits.unionByName(some)
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("_ref").alias("_own"), F.explode("found").alias("hit"))
    hits = hits.groupBy("_id", "_own").agg(F.array_sort(F.collect_list("hit")).alias("found"))
    both = rows.join(hits, (F.col("_ref") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return both.select("doc_id", "text", *keep, F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def found_in(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` with the column ``found``: the items, a block of bounded size, that each text holds."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items(shared.value)
        for batch in portions(batches):
            found = [[dict(zip(("item_id", "start", "end", "edits"), f, strict=True)) for f in found] for found in index.search(batch.column("text").to_pylist())]
            yield batch.append_column("found", pa.array(found, FOUND_ARROW))

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("found", FOUND)]))


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it holds benchmark items, which, and the least number of edits."""
    out = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.array_sort("found.item_id").alias("item_ids"), F.array_min("found.edits").alias("least_edits"))
