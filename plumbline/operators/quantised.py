"""Approximate vector search by product quantisation over two levels of lists.

The index is fitted on a bounded sample: ``root`` coarse centres, each with ``root`` centres of its own, so that there are root^2 lists
while a vector is compared with 2 root centres only; with root near N^(1/4) there are sqrt(N) lists. What is left of a vector
beside its list's centre is cut into short parts, each named by the nearest of 256 codewords. Every row is indexed.

Queries and library meet in blocks of bounded size, as in the exact search, but a library row is its list and one byte for each
part, and a query is compared only with the rows of the lists it probes. A row's similarity to a query is the sum of the query's
products with the codewords its bytes name. A block stands by list and looks its codewords up once; a tile of it is multiplied with
the queries that probe one of its lists, and what a query does not probe is left out of what it may find, which in numpy is faster
than a product for each list or a table of products for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sampling import hash_number
from plumbline.operators.search import MATCHES, QUERY_TILE, Asked, Best, Rows, Tile, best_in_blocks, dot, stacked, stored, top_matches

#: At most about this many rows fit the index.
FIT_ROWS = 16_384
CODEWORDS = 256


def centres_of(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds from rows drawn without repetition; fewer rows give fewer centres."""
    unique = np.unique(points, axis=0)
    centres = unique[rng.choice(len(unique), min(k, len(unique)), replace=False)]
    for _ in range(rounds):
        own = nearest_of(points, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centre; on a line it is looked up between the middles, which no distance to all centres needs."""
    if centres.shape[1] == 1 and np.isfinite(points).all() and np.isfinite(centres).all():
        line, first = np.unique(centres[:, 0], return_index=True)
        return first[np.searchsorted((line[1:] + line[:-1]) / 2, points[:, 0])]
    return ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)


@dataclass(frozen=True)
class Index:
    """``fine[t]`` are the centres below coarse centre t; list t * root + f. ``words[p]`` are the codewords of part p."""

    coarse: np.ndarray
    fine: np.ndarray
    words: np.ndarray

    @property
    def lists(self) -> int:
        return self.fine.shape[0] * self.fine.shape[1]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.fine[lists // self.fine.shape[1], lists % self.fine.shape[1]]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the nearest coarse centre, then the nearest one below it."""
        top = nearest_of(x, self.coarse)
        out = np.empty(len(x), np.int64)
        for t in np.unique(top):
            out[top == t] = t * self.fine.shape[1] + nearest_of(x[top == t], self.fine[t])
        return out

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut into parts, filled up with zeros: rows x parts x components."""
        n_parts, _, width = self.words.shape
        return np.pad(x, ((0, 0), (0, n_parts * width - x.shape[1]))).reshape(len(x), n_parts, width)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.parts(x - self.centre(lists))
        return np.stack([nearest_of(rest[:, p], w) for p, w in enumerate(self.words)], 1).astype(np.uint8)

    def probe(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Queries x lists, whether a query probes a list: those most similar to it, among those below its best coarse centres."""
        root = self.fine.shape[1]
        tops = min(len(self.coarse), -(-2 * probes // root))
        best = np.argsort(-(x @ self.coarse.T), 1, kind="stable")[:, :tops]
        below = x @ self.fine.reshape(self.lists, -1).T
        other = np.ones((len(x), len(self.coarse)), bool)
        np.put_along_axis(other, best, False, 1)
        below[np.repeat(other, root, 1)] = -np.inf
        most = min(probes, tops * root)
        asked = np.zeros((len(x), self.lists), bool)
        np.put_along_axis(asked, np.argpartition(-below, most - 1, 1)[:, :most], True, 1)
        return asked

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Rows as their lists and codes name them."""
        n_parts, _, width = self.words.shape
        rest = self.words[np.arange(n_parts), codes].reshape(len(codes), n_parts * width)
        return rest[:, : self.coarse.shape[1]] + self.centre(lists)


def fit_index(library: DataFrame, root: int | None = None, width: int = 1, seed: int = 42, fit_rows: int = FIT_ROWS) -> Index | None:
    """An index from a hash sample of about ``fit_rows`` rows; ``root`` follows the number of rows by default."""
    total = library.count()
    some = library.where(hash_number("match_id") < min(1.0, fit_rows / max(1, total)) * 2**52).select("match_id", "vector").toPandas()
    if some.empty:
        some = library.select("match_id", "vector").limit(1).toPandas()
    if some.empty:
        return None
    x = np.vstack(some.sort_values("match_id")["vector"].to_list())
    rng = np.random.default_rng(seed)
    root = root or max(1, round(total**0.25))
    coarse = centres_of(x, root, rng)
    top = nearest_of(x, coarse)
    fine = np.empty((len(coarse), root, x.shape[1]))
    for t in range(len(coarse)):
        mine = centres_of(x[top == t], root, rng) if (top == t).any() else coarse[t : t + 1]
        # a coarse centre with fewer rows repeats its first centre, which is never the nearest one twice
        fine[t] = np.vstack([mine, np.repeat(mine[:1], root - len(mine), 0)])
    bare = Index(coarse, fine, np.zeros((-(-x.shape[1] // width), 1, width)))
    rest = bare.parts(x - bare.centre(bare.place(x)))
    words = []
    for p in range(rest.shape[1]):
        found = centres_of(rest[:, p], CODEWORDS, rng)
        words.append(np.vstack([found, np.repeat(found[:1], CODEWORDS - len(found), 0)]))
    return Index(coarse, fine, np.stack(words))


def probed_rows(queries: DataFrame, library: DataFrame, k: int, share: float, index: Index | None, whole: bool) -> DataFrame:
    """The best matches by decoded similarity in the probed lists, k from each part of the library; with ``whole`` their exact similarity as ``score``."""
    index = index or fit_index(library)
    returns = MATCHES | ({"score": "double"} if whole else {})
    if index is None:
        return queries.limit(0).select("query_id", *[F.lit(0).cast(kind).alias(name) for name, kind in list(returns.items())[1:]])
    probes = max(1, int(share * index.lists))
    # bounded by FIT_ROWS and the number of lists
    held = queries.sparkSession.sparkContext.broadcast(index)

    def encode(frames):
        for f in frames:
            if len(f):
                x = np.vstack(f["vector"].to_list())
                lists = held.value.place(x)
                coded = pd.DataFrame({"list": lists, "match_id": f["match_id"], "codes": [c.tobytes() for c in held.value.encode(x, lists)]})
                yield coded.assign(vector=f["vector"]) if whole else coded

    kinds = "list long, match_id long, codes binary" + (", vector array<double>" if whole else "")
    coded = library.select("match_id", F.col("vector").cast("array<double>")).mapInPandas(encode, kinds)

    def asked(a: pd.DataFrame) -> Asked:
        """Queries of one coarse centre stand together, since they probe the same lists."""
        x, own = stacked(a["q_vector"]), a["query_id"].to_numpy()
        order = np.argsort(nearest_of(x, held.value.coarse), kind="stable")
        out = []
        for i in range(0, len(x), QUERY_TILE):
            part = order[i : i + QUERY_TILE]
            out.append(Tile(x[part], Best(own[part], k, scored=whole), np.packbits(held.value.probe(x[part], probes), axis=1)))
        return Asked(out)

    def rows(b: pd.DataFrame) -> Rows:
        lists = b["l_list"].to_numpy()
        codes = np.frombuffer(b"".join(b["l_codes"]), np.uint8).reshape(len(b), -1)
        return Rows(held.value.decode(codes, lists), b["match_id"].to_numpy(), lists, stacked(b["l_vector"]) if whole else None)

    return best_in_blocks(queries, coded, ["list", "codes", *["vector"] * whole], asked, rows, returns, counted=library)


def quantised_search(queries: DataFrame, library: DataFrame, k: int, share: float = 0.85, index: Index | None = None) -> DataFrame:
    """``(query_id, match_id, similarity, rank)``: the k best by decoded similarity in the probed lists, a ``share`` of all."""
    return top_matches(probed_rows(queries, library, k, share, index, whole=False), k)


def reranked_search(queries: DataFrame, library: DataFrame, k: int, share: float = 0.85, index: Index | None = None) -> DataFrame:
    """Three times k approximate candidates, scored again exactly and cut to k.

    The blocks hold the whole vectors too, so that a candidate leaves its block scored. An id that stands for several rows is scored
    with each of them.
    """
    near = top_matches(probed_rows(queries, library, 3 * k, share, index, whole=True), 3 * k)
    again_q, again_lib = repeated(queries, "query_id"), repeated(library, "match_id")
    if again_q.isEmpty() and again_lib.isEmpty():
        return top_matches(near.select("query_id", "match_id", F.col("score").alias("similarity")), k)
    near = stored(near.select("query_id", "match_id", "score"))
    marked = near.join(again_q.withColumn("_q", F.lit(True)), "query_id", "left").join(again_lib.withColumn("_l", F.lit(True)), "match_id", "left")
    several = F.col("_q").isNotNull() | F.col("_l").isNotNull()
    once = marked.where(~several).select("query_id", "match_id", F.col("score").alias("similarity"))
    q = queries.select("query_id", F.col("vector").alias("qv"))
    lib = library.select("match_id", F.col("vector").alias("lv"))
    more = marked.where(several).join(q, "query_id").join(lib, "match_id").select("query_id", "match_id", dot(F.col("qv"), F.col("lv")).alias("similarity"))
    return top_matches(once.unionByName(more), k)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """The keys of more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
