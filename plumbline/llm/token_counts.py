"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens. The distinct new ones of a batch are held as ragged numpy arrays of symbols, and every
round merges, in all sequences at once, each sequence's pair of lowest rank. What is left at the end is the number of
tokens. Counts of pre-tokens are kept in a bounded table between batches; it only saves work.

Defined cases: a null or empty text has 0 tokens; strings of special tokens inside a text count one each, as the
library has it by default; very long pre-tokens take a round per distinct rank, not per symbol; repeated rows are
counted alike; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from plumbline.llm.common import table
from plumbline.registry import query

NO_RANK = np.iinfo(np.int64).max
KNOWN_WORDS = 400_000
BATCH_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class RankMerger:
    """The merges of a vocabulary file as sorted arrays, and the counts of pre-tokens seen."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"]:
            raise ValueError("expected a BPE vocabulary with a splitting pattern and byte letters")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocab[x + end] for x in letters], dtype=np.int64)
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # the library's own normaliser, so that case and composition follow its Unicode tables
        parts = {"NFC": lambda _: normalizers.NFC(), "Lowercase": lambda _: normalizers.Lowercase(), "Replace": lambda p: None}
        self.before, self.after, seen = [], [], False
        for p in spec["normalizer"]["normalizers"]:
            if p["type"] == "Replace":
                # white space becomes a blank, and the pattern drops either
                seen = True
            else:
                (self.after if seen else self.before).append(parts[p["type"]](p))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NO_RANK)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word; words are not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.last[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        left = np.ones(len(words), np.int64)
        rank = np.full(len(symbols), NO_RANK)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            ready = lowest == NO_RANK
            left[owner[starts[ready]]] = sizes[ready]
            live = np.repeat(~ready, sizes)
            lowest = np.repeat(lowest, sizes)[live]
            symbols, owner, rank = symbols[live], owner[live], rank[live]
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == lowest)
            # in a chain of overlapping hits every second one stands, from the left
            first = np.r_[True, np.diff(hits) != 1]
            chain = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - chain) % 2 == 0]
            symbols[hits] = self.results[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            place = np.cumsum(keep) - 1
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            changed = np.unique(np.r_[place[hits], np.maximum(place[hits] - 1, 0)])
            rank[changed] = NO_RANK
            changed = changed[changed < len(symbols) - 1]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.rank_of(symbols[changed], symbols[changed + 1])
        return left

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many strings of special tokens stand between them."""
        parts = self.special.split(text) if self.special else [text]
        out: list[str] = []
        for part in parts:
            for step in (*self.before, *self.after):
                part = step.normalize_str(part)
            out += self.words.findall(part)
        return out, len(parts) - 1

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.lengths([w.encode() for w in new]).tolist(), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        held: list[tuple[list[str], int]] = []
        chars = 0
        for k, text in enumerate(texts):
            held.append(self.pretokens(text or ""))
            chars += len(text or "")
            if chars >= BATCH_CHARS or k == len(texts) - 1:
                if len(self.known) > KNOWN_WORDS:
                    self.known.clear()
                self.learn({w for words, _ in held for w in words})
                out += [sum(map(self.known.__getitem__, words)) + n for words, n in held]
                held, chars = [], 0
        return out


@functools.lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit). ``path`` is the vocabulary file, at the same place on all workers."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(merger(path).counts(batch.tolist()), dtype="int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
