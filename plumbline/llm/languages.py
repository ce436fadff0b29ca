"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ``order`` bytes. A byte seen c times after a context that was seen n times, with q
unlike bytes, costs -log2(c / (n + q)) bits there; any other byte pays the escape, -log2(q / (n + q)), and is coded by the
next shorter context without the bytes already excluded, down to one of 256. Contexts that a language has not seen cost
nothing to pass. Statistics are frozen after learning, so the cost of a byte depends on its context alone: the trees of
all languages share one set of contexts, walked by table lookups, and a text's code length is a sum of table entries. Costs are
integers, 1/65536 bit each, so sums do not depend on how texts are dealt to tasks.

The language with the shortest code wins; its score is its share of the likelihoods with equal priors.

Learning counts windows of ``order`` + 1 bytes per task and then by language and window. It takes all learnable texts of a
language up to about ``sample_bytes`` and beyond that those whose hash falls below the matching rate. The ``max_contexts``
most frequent contexts that occur at least ``min_count`` times are kept, which bounds the model whatever the input. Everything else
covers all rows and whole texts; long ones are read in pieces that overlap by a context.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; so is every text if nothing could be
learned; ties go to the alphabetically first language; a null id reads as the empty text, which is not held
out; rows that repeat an id are judged each; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import portions, table
from plumbline.registry import query

UNKNOWN = "und"
UNIT = 65536
#: Bytes looked up at once.
PIECE = 1 << 18


def windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (byte + 1) of the texts, each after ``order`` zeros, and the first place of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(np.r_[0, lengths[:-1] + order]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    symbols = np.zeros(int((lengths + order).sum()), np.uint16)
    for start, text in zip(starts, texts, strict=True):
        symbols[start + order:start + order + len(text)] = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    return symbols, starts


def count_windows(labelled: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each window of ``order`` + 1 symbols, 9 bits each, closes at a byte of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def batch_of(parts: dict[str, list]) -> pa.RecordBatch:
            langs, grams, counts = [], [], []
            for lang, found in parts.items():
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                langs += [lang] * len(keys)
                grams.append(keys)
                counts.append(np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64))
            none = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(grams or none)), pa.array(np.concatenate(counts or none))], ["lang", "gram", "n"])

        for batch in portions(batches):
            rows = batch.to_pydict()
            for lang in set(rows["lang"]):
                symbols, _ = windows([t.encode() for t, own in zip(rows["text"], rows["lang"], strict=True) if own == lang], order)
                for start in range(0, len(symbols), PIECE):
                    part = symbols[max(0, start - order):start + PIECE].astype(np.int64)
                    if len(part) <= order:
                        continue
                    gram = np.zeros(len(part) - order, np.int64)
                    for k in range(order + 1):
                        gram = gram << 9 | part[k:len(part) - order + k]
                    held.setdefault(lang, []).append(np.unique(gram[part[order:] > 0], return_counts=True))
            if sum(len(k) for parts in held.values() for k, _ in parts) > 2_000_000:
                yield batch_of(held)
                held = {}
        yield batch_of(held)

    return labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen context trees of several languages as lookup tables.

    ``steps[d]`` leads from a context of at most d bytes and the byte before it to the longer context, or to itself where none
    is kept. ``costs`` has, for each context and next byte, one cost for each language.
    """

    def __init__(self, langs: list[str], order: int, grams: np.ndarray, owners: np.ndarray, counts: np.ndarray, min_count: int, max_contexts: int):
        """``grams`` are windows of symbols, ``owners`` the languages they were counted in."""
        self.langs, self.order = langs, order
        seen = np.unique(np.concatenate([(grams >> 9 * k) & 511 for k in range(order + 1)])) if len(grams) else np.zeros(0, np.int64)
        # compact symbols: 0 is the edge of a text, the last stands for every byte never seen
        seen = seen[seen > 0]
        self.code = np.full(257, len(seen) + 1, np.int32)
        self.code[0] = 0
        self.code[seen] = np.arange(1, len(seen) + 1)
        width = self.width = len(seen) + 2
        uniform = np.full(width, 1 / 256)
        uniform[0], uniform[-1] = 0, (256 - len(seen)) / 256

        kept = self._frequent(grams, counts, order, min_count, max_contexts)
        last = self.code[grams & 511]
        shape = (len(langs), width)
        chances = [self._blend(np.broadcast_to(uniform, shape), self._table(owners, last, counts, shape))]
        nodes = [np.zeros(len(grams), np.int64)]
        self.steps: list[np.ndarray] = []
        for depth in range(1, order + 1):
            parents = len(chances)
            move = np.repeat(np.arange(parents, dtype=np.int32)[:, None], width, 1)
            suffix = (grams >> 9) & ((1 << 9 * depth) - 1)
            order_by = np.argsort(suffix, kind="stable")
            cuts = np.flatnonzero(np.diff(suffix[order_by], prepend=-1))
            now = nodes[-1].copy()
            for start, end in zip(cuts, np.r_[cuts[1:], len(suffix)], strict=False):
                context = int(suffix[order_by[start]])
                if context not in kept[depth]:
                    continue
                mine = order_by[start:end]
                parent = int(nodes[-1][mine[0]])
                move[parent, self.code[context >> 9 * (depth - 1)]] = len(chances)
                now[mine] = len(chances)
                chances.append(self._blend(chances[parent], self._table(owners[mine], last[mine], counts[mine], shape)))
            nodes.append(now)
            self.steps.append(move)
        chance = np.stack(chances)
        chance[:, :, -1] /= max(256 - len(seen), 1)
        bits = -np.log2(np.maximum(chance, 2.0**-40))
        self.costs = np.round(bits * UNIT).astype(np.int32).transpose(0, 2, 1).reshape(len(chances) * width, len(langs)).copy()

    @staticmethod
    def _frequent(grams: np.ndarray, counts: np.ndarray, order: int, min_count: int, max_contexts: int) -> list[set[int]]:
        """Contexts to keep by depth: the most frequent ones; a context is at most as frequent as those it extends."""
        found = []
        for depth in range(1, order + 1):
            keys, back = np.unique((grams >> 9) & ((1 << 9 * depth) - 1), return_inverse=True)
            total = np.bincount(back, counts, len(keys)) if len(keys) else np.zeros(0)
            found += [(-int(n), depth, int(k)) for k, n in zip(keys, total, strict=True) if n >= min_count]
        kept: list[set[int]] = [set() for _ in range(order + 1)]
        for _, depth, key in sorted(found)[:max_contexts]:
            kept[depth].add(key)
        return kept

    @staticmethod
    def _table(owners: np.ndarray, last: np.ndarray, counts: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        return np.bincount(owners * shape[1] + last, counts, shape[0] * shape[1]).reshape(shape)

    @staticmethod
    def _blend(shorter: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Chances after a context from its counts and the chances after the next shorter one."""
        n, q = counted.sum(1, keepdims=True), (counted > 0).sum(1, keepdims=True)
        rest = np.where(counted > 0, 0, shorter)
        left = rest.sum(1, keepdims=True)
        # with every byte seen there is nothing to escape to
        escape = np.where(left > 0, q, 0)
        whole = np.maximum(n + escape, 1)
        mixed = counted / whole + escape / whole * rest / np.where(left > 0, left, 1)
        return np.where(n > 0, mixed, shorter)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Units of code for each text and language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        symbols, starts = windows(texts, self.order)
        symbols = self.code[symbols]
        if not len(symbols):
            return out
        for start in range(self.order, len(symbols), PIECE):
            end = min(start + PIECE, len(symbols))
            node = np.zeros(end - start, np.int32)
            for back, move in enumerate(self.steps, 1):
                node = move.ravel()[node * self.width + symbols[start - back:end - back]]
            cost = self.costs[node * self.width + symbols[start:end]]
            # edges of texts cost nothing; every text that reaches into the piece gets its part of the sums
            cost[symbols[start:end] == 0] = 0
            first = int(np.searchsorted(starts, start, "right")) - 1
            mine = np.arange(first, int(np.searchsorted(starts, end, "left")))
            out[mine] += np.add.reduceat(cost, np.maximum(starts[mine] - start, 0), dtype=np.int64)
        return out


def learn(labelled: DataFrame, order: int = 4, sample_bytes: int = 4_000_000, min_count: int = 4, max_contexts: int = 12_000) -> ContextTrees:
    """Context trees from rows (text, lang); rows with a null in either teach nothing.

    Windows counted at least twice are used, of which the sample holds ``sample_bytes`` / 2 at most for a language: that
    bounds what the driver collects.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()}
    langs = sorted(sizes)
    full = {lang: sample_bytes / n for lang, n in sizes.items() if n > sample_bytes}
    if full:
        # the hash of the text, so that copies of a text are taken together
        rate = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])[F.col("lang")]
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.coalesce(rate, F.lit(1.0)) * 1_000_000)
    grams = count_windows(rows, order).where("n > 1").toPandas()
    owners = np.array([langs.index(x) for x in grams["lang"]], np.int64)
    return ContextTrees(langs, order, grams["gram"].to_numpy(np.int64), owners, grams["n"].to_numpy(np.int64), min_count, max_contexts)


def identify(docs: DataFrame, trees: ContextTrees, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, lang_pred, score, bits by language) and the columns ``keep``, one for each row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    rows = rows.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees) if trees.langs else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("doc_id", *keep).schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            lettered = np.array(batch.column("lettered").to_pylist(), bool)
            lang, score = np.full(len(lettered), UNKNOWN, object), np.zeros(len(lettered))
            bits: list = [None] * len(lettered)
            texts = [(t or "").encode() if own else b"" for t, own in zip(batch.column("text").to_pylist(), lettered, strict=True)]
            if shared is not None and lettered.any():
                model = shared.value
                units = model.code_lengths(texts)
                best = units.argmin(1)
                gap = (units - units.min(1, keepdims=True)) / UNIT
                share = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                lang = np.where(lettered, np.array(model.langs, object)[best], UNKNOWN)
                score = np.where(lettered, share, 0.0)
                bits = [dict(zip(model.langs, (u / UNIT).tolist(), strict=True)) if own else None for u, own in zip(units, lettered, strict=True)]
            bits_array = pa.array([None if b is None else list(b.items()) for b in bits], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", *keep)] + [pa.array(lang.tolist(), pa.string()), pa.array(score), bits_array],
                ["doc_id", *keep, "lang_pred", "score", "bits"])

    return rows.mapInArrow(judge, f"{schema}, lang_pred string, score double, bits map<string,double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, trees)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
