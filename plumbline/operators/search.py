"""Vector search by blocks, and what the exact and the approximate search share.

Queries and library meet in blocks of bounded size, every block of one with every block of the other. Blocks are written once and
read for each meeting; inside a task they are compared tile by tile. A task goes through the blocks of one part of the library, of
which there are few, and only k rows per query leave it. The products of an exact search stay quadratic, what it shuffles and writes
does not. Most products are taken in single precision, whose largest one in a tile of the library tells, by a bound that is never
too low, whether a row of the tile can be among a query's best; only such queries meet the tile with whole numbers.

Above a threshold, one-byte codes meet first: an upper bound of every similarity names the rows that can have a match at all, and
only these meet with whole vectors. The bound is never too low, so no match is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
QUERY_BLOCK = 16_384
LIBRARY_BLOCK = 32_768
#: Rows compared at once inside a block: the queries of a tile keep their best rows together, the library rows of one are bounded together.
QUERY_TILE = 4096
LIBRARY_TILE = 256
#: Queries whose products with a tile of the library are held at once, so few that they stay close to the processor.
QUERY_PIECE = 1024
#: Parts of the library where the best rows are looked for: a query leaves each of them with k rows, however many blocks it has.
LIBRARY_PARTS = 4
#: The same for one-byte codes.
CODE_QUERY_BLOCK = 16_384
CODE_LIBRARY_BLOCK = 32_768
CODE_QUERY_TILE = 512
CODE_LIBRARY_TILE = 1024
#: Share of the lengths that is added to a bound for sums in single precision; they are good to 6e-8 a term.
ROUNDING = 1e-4
MATCHES = {"query_id": "long", "match_id": "long", "similarity": "double"}


def normalised(vector: Column) -> Column:
    """Unit length; the tiny constant keeps a zero vector at zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-10
    # beside every component, since a lambda would take the norm again for each of them
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def packed(df: DataFrame, key: str, cols: list[str], size: int, side: str, counted: DataFrame | None = None) -> DataFrame:
    """``(<side>_block, <side>_rows)``: blocks of about ``size`` rows by hash of the key, each one value and one file of a written table.

    Every row is shuffled and written once, however many blocks there are. ``counted`` has as many rows and is cheaper to count.
    """
    import pyarrow as pa

    n = (df if counted is None else counted).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("bigint")).scalar()
    # new column names, so that a table can search itself
    rows = df.select(F.pmod(F.xxhash64(key), n).alias("_block"), key, *[F.col(c).alias(f"{side}_{c}") for c in cols])

    def pack(block: pa.Table) -> pa.Table:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, block.schema) as stream:
            stream.write_table(block)
        return pa.table({f"{side}_block": block["_block"][:1], f"{side}_rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    return stored(rows.groupBy("_block").applyInArrow(pack, f"{side}_block long, {side}_rows binary"), rows_of_a_file=1)


def read_block(rows: bytes) -> pd.DataFrame:
    import pyarrow as pa

    return pa.ipc.open_stream(rows).read_pandas()


def meet_in_blocks(
    queries: DataFrame, library: DataFrame, q_cols: list[str], l_cols: list[str], kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    q_size: int = QUERY_BLOCK, l_size: int = LIBRARY_BLOCK, returns: dict[str, str] = MATCHES,
) -> DataFrame:
    """What the kernel ``returns``, matches by default, for each block of queries and block of library rows.

    The kernel gets the queries with ``q_<column>`` and the library rows with ``l_<column>``; neither is empty. Written blocks are
    read again for every meeting, so that no row is copied to a shuffle or to another file for it.
    """
    q, lib = packed(queries, "query_id", q_cols, q_size, "q"), packed(library, "match_id", l_cols, l_size, "l")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, b in zip(f["q_rows"], f["l_rows"], strict=True):
                yield kernel(read_block(a), read_block(b))

    return meetings(q, lib).mapInPandas(meet, schema_of(returns))


def meetings(q: DataFrame, lib: DataFrame) -> DataFrame:
    """Every block of the library beside every block of queries.

    With the hint every task takes some blocks of both sides; without it a small side would be sent to all tasks. The library's blocks
    pass one by one, the task's blocks of queries, some files, are held for them.
    """
    return lib.crossJoin(q.hint("shuffle_replicate_nl"))


def schema_of(returns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in returns.items())


def best_in_blocks(
    queries: DataFrame, library: DataFrame, l_cols: list[str], asked: Callable[[pd.DataFrame], Asked], rows: Callable[[pd.DataFrame], Rows],
    returns: dict[str, str] = MATCHES, counted: DataFrame | None = None,
) -> DataFrame:
    """The best rows of each query in each of ``LIBRARY_PARTS`` parts of the library.

    ``asked`` gets a block's queries with ``q_vector``, ``rows`` the library rows with ``l_<column>``; ``counted`` is as in ``packed``.
    What a task's blocks of queries found so far stays with them, so that a block of the library only adds rows that are better.
    """
    q, lib = packed(queries, "query_id", ["vector"], QUERY_BLOCK, "q"), packed(library, "match_id", l_cols, LIBRARY_BLOCK, "l", counted)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Asked] = {}
        at, now = None, None
        for f in frames:
            for i, a, j, b in zip(f["q_block"], f["q_rows"], f["l_block"], f["l_rows"], strict=True):
                if j != at:
                    at, now = j, rows(read_block(b))
                if i not in held:
                    held[i] = asked(read_block(a))
                held[i].meet(now)
        for block in held.values():
            yield block.frame()

    return meetings(q, lib.coalesce(LIBRARY_PARTS)).mapInPandas(meet, schema_of(returns))


def without_own(sim: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
    """Queries x library rows: a row with the query's own id is no match. ``ids`` ascend."""
    at = np.searchsorted(ids, own)
    while (same := (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own)).any():
        sim[same, at[same]] = -np.inf
        at += 1


class Best:
    """The k best library rows of each query so far, ties to the smaller id; a row with the query's own id or below ``least`` is no match."""

    def __init__(self, own: np.ndarray, k: int, least: float = -np.inf, scored: bool = False):
        self.own, self.k, self.least = own, k, least
        self.ids = np.full((len(own), k), np.iinfo(np.int64).max)
        self.sims = np.full((len(own), k), -np.inf)
        self.scores = np.zeros((len(own), k if scored else 0))

    def edge(self) -> np.ndarray:
        """What a row must reach to be among the best of a query."""
        return np.maximum(self.sims[:, -1], self.least)

    def add(
        self, sim: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
        may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    ) -> None:
        """Queries x library rows, all queries or those ``at`` some places; ``ids`` ascend, ``sim`` is overwritten.

        Rows that are no candidates have -inf, or ``may`` is false for the places of the query and of the row. ``score`` gives a
        second number for such places.
        """
        at = np.arange(len(self.own)) if at is None else at
        without_own(sim, self.own[at], ids)
        take, many = min(self.k, len(ids)), 4 * self.k * len(sim)
        edge = self.edge()[at]
        hit = sim >= edge[:, None]
        if np.count_nonzero(hit) > many:
            sim[np.isnan(sim)] = -np.inf
            if may is not None:
                sim[~may(at[:, None], np.arange(len(ids)))] = -np.inf
            edge = np.maximum(edge, np.partition(sim, len(ids) - take, axis=1)[:, len(ids) - take])
            hit = sim >= edge[:, None]
            if np.count_nonzero(hit) > many:
                # of many equal rows the first k are enough
                tie = sim == edge[:, None]
                hit &= ~tie | (tie.cumsum(1, dtype=np.int32) <= self.k)
        row, col = np.nonzero(hit)
        found = sim[row, col]
        kept = found > -np.inf if may is None else (found > -np.inf) & may(at[row], col)
        row, col, found = (x[kept] for x in (row, col, found))
        if not len(row):
            return
        # by query: what it has, then what it found
        first = np.flatnonzero(np.diff(row, prepend=-1))
        times = np.diff(np.append(first, len(row)))
        changed, row, place = at[row[first]], np.repeat(np.arange(len(first)), times), self.k + np.arange(len(row)) - np.repeat(first, times)

        def joined(held: np.ndarray, new: np.ndarray, none: float) -> np.ndarray:
            out = np.full((len(changed), self.k + times.max()), none, held.dtype)
            out[:, : self.k], out[row, place] = held[changed], new
            return out

        sims, all_ids = joined(self.sims, found, -np.inf), joined(self.ids, ids[col], np.iinfo(np.int64).max)
        order = np.argsort(-sims, 1)
        best = np.take_along_axis(sims, order[:, : self.k + 1], 1)
        tied = ((best[:, 1:] == best[:, :-1]) & (best[:, 1:] > -np.inf)).any(1)
        order[tied] = np.lexsort((all_ids[tied], -sims[tied]))
        order = order[:, : self.k]
        self.sims[changed], self.ids[changed] = (np.take_along_axis(x, order, 1) for x in (sims, all_ids))
        if score is not None:
            self.scores[changed] = np.take_along_axis(joined(self.scores, score(changed[row], col), 0.0), order, 1)

    def frame(self) -> pd.DataFrame:
        kept = self.sims > -np.inf
        out = {"query_id": np.repeat(self.own, kept.sum(1)), "match_id": self.ids[kept], "similarity": self.sims[kept]}
        return pd.DataFrame(out | ({"score": self.scores[kept]} if self.scores.size else {}))


def best_rows(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best matches of each query, ties to the smaller id."""
    found = found.sort_values(["query_id", "similarity", "match_id"], ascending=[True, False, True])
    return found[found.groupby("query_id", dropna=False).cumcount() < k]


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_list())


def tiles(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    return (frame.iloc[i : i + size] for i in range(0, len(frame), size))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of one side times rows of the other; equal rows have equal products wherever they stand.

    At the edge of a matrix the library adds up in another order, which would decide between copies, so both sides are filled up.
    """
    whole = lambda x: np.vstack([x, np.zeros((-len(x) % 64, x.shape[1]))]) if len(x) % 64 else x
    return (whole(a) @ whole(b).T)[: len(a), : len(b)]


def shortened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in single precision and their lengths, which bound what that leaves out.

    One with a component that is no number meets nothing and is zero, one without end (beyond 1e15) may meet anything.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((x * x).sum(1))
    endless = ~(length < 1e15)
    short = np.where(endless[:, None], 0, x).astype(np.float32)
    return short, np.where(np.isnan(x).any(1), 0.0, np.where(endless, np.inf, length))


def peaks(a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The largest product of each row of ``a`` with a row of ``b``; ``room`` is written over."""
    out = np.empty(len(a), np.float32)
    for i in range(0, len(a), QUERY_PIECE):
        part = a[i : i + QUERY_PIECE]
        # rows of b first: the maximum of whole lines is cheaper than that of a line
        np.max(np.matmul(b, part.T, out=room[: len(b) * len(part)].reshape(len(b), len(part))), axis=0, out=out[i : i + QUERY_PIECE])
    return out


class Rows:
    """A block of library rows in tiles. With ``lists``, rows of a list stand together; ids ascend in a tile.

    ``whole`` are other vectors of the rows, by which what is found gets its second number.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, lists: np.ndarray | None = None, whole: np.ndarray | None = None):
        order = np.argsort(ids if lists is None else lists, kind="stable")
        order = order[np.lexsort((ids[order], np.arange(len(ids)) // LIBRARY_TILE))]
        self.x, self.ids = x[order], ids[order]
        self.lists, self.whole = (None if part is None else part[order] for part in (lists, whole))
        self.short, length = shortened(self.x)
        self.tiles = [slice(i, min(i + LIBRARY_TILE, len(ids))) for i in range(0, len(ids), LIBRARY_TILE)]
        self.longest = [length[t].max() for t in self.tiles]


class Tile:
    """Some queries of a block and their best rows so far; ``probed``, bits of lists for each query, names the rows it is compared with."""

    def __init__(self, x: np.ndarray, best: Best, probed: np.ndarray | None = None):
        self.x, self.best, self.probed = x, best, probed
        self.short, length = shortened(x)
        # of a row's length; beside tiny lengths single precision leaves out more than that share
        self.lost = max(ROUNDING, 4e-7 * x.shape[1]) * np.maximum(length, 1e-15)

    def meet(self, rows: Rows) -> None:
        probed = None if self.probed is None else np.unpackbits(self.probed, axis=1).view(bool)
        who, short = np.arange(len(self.x)), self.short
        room = np.empty(LIBRARY_TILE * QUERY_PIECE, np.float32)
        for tile, longest in zip(rows.tiles, rows.longest, strict=True):
            if probed is not None:
                asks = probed[:, np.unique(rows.lists[tile])].any(1)
                who, short = (np.arange(len(self.x)), self.short) if asks.all() else (np.flatnonzero(asks), self.short[asks])
            # an endless length lets all pass
            lost = self.lost[who] * max(longest, 1e-15) + 1e-30
            near = who[~(peaks(short, rows.short[tile], room) < self.best.edge()[who] - lost) | np.isinf(lost)]
            if len(near):
                self.compare(rows, tile, near, probed)

    def compare(self, rows: Rows, tile: slice, near: np.ndarray, probed: np.ndarray | None) -> None:
        score = may = None
        if rows.whole is not None:
            score = lambda at, col: np.add.accumulate(self.x[at] * rows.whole[tile][col], 1)[:, -1]
        if probed is not None:
            lists = rows.lists[tile]
            may = lambda at, col: probed[at, lists[col]]
        self.best.add(products(self.x[near], rows.x[tile]), rows.ids[tile], near, score, may)


class Asked:
    """A block of queries in tiles."""

    def __init__(self, tiles: list[Tile]):
        self.tiles = tiles

    def meet(self, rows: Rows) -> None:
        for t in self.tiles:
            t.meet(rows)

    def frame(self) -> pd.DataFrame:
        return pd.concat([t.best.frame() for t in self.tiles])


def exact_search(queries: DataFrame, library: DataFrame, k: int, least: float = -np.inf) -> DataFrame:
    """``(query_id, match_id, similarity, rank)``: every ``(match_id, vector)`` is compared with every ``(query_id, vector)``.

    A library row with the query's own id or a similarity below ``least`` is no match.
    """

    def asked(a: pd.DataFrame) -> Asked:
        return Asked([Tile(stacked(t["q_vector"]), Best(t["query_id"].to_numpy(), k, least)) for t in tiles(a, QUERY_TILE)])

    def rows(b: pd.DataFrame) -> Rows:
        return Rows(stacked(b["l_vector"]), b["match_id"].to_numpy())

    return top_matches(best_in_blocks(queries, library, ["vector"], asked, rows), k)


def codes(vectors: pd.Series) -> pd.DataFrame:
    """Vectors as one byte a component and a factor, with the lengths of what that leaves out and of the vector itself.

    A vector with a component that is no number meets nothing, one without end (beyond 1e15) has no code and may meet anything.
    """
    x = stacked(vectors).astype(float)
    x[np.isnan(x).any(1)] = 0.0
    endless = ~(np.abs(x).max(1, initial=0.0) < 1e15)
    x[endless] = 0.0
    top = np.abs(x).max(1, initial=0.0)
    scale = (np.where(top > 1e-30, top, 1.0) / 127).astype(np.float32)
    steps = scale[:, None].astype(float)
    code = np.rint(x / steps).clip(-127, 127).astype(np.int8)
    length = lambda v: np.where(endless, 1e30, np.sqrt((v * v).sum(1)))
    return pd.DataFrame({"code": [r.tobytes() for r in code], "scale": scale, "rest": length(x - code * steps), "length": length(x)})


def coded(df: DataFrame, key: str) -> DataFrame:
    """The codes of ``(key, vector)``, written once since their number and their blocks are read; a null or a null component meets nothing."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["vector"].notna()].reset_index(drop=True)
            if len(f):
                yield pd.concat([f[[key]], codes(f["vector"])], axis=1)

    return stored(df.select(key, "vector").mapInPandas(encode, f"{key} long, code binary, scale float, rest double, length double"))


def stored(df: DataFrame, rows_of_a_file: int = 0) -> DataFrame:
    """The table written and read again, with any number of rows in a file by default."""
    from plumbline.streaming.run import shared_folder

    folder = shared_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_of_a_file).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def factor(code: pd.Series, scale: pd.Series, first: pd.Series, second: pd.Series) -> np.ndarray:
    """Decoded rows with two more components, so that one product gives the bound."""
    decoded = np.frombuffer(b"".join(code), np.int8).reshape(len(code), -1) * scale.to_numpy(np.float32)[:, None]
    return np.hstack([decoded, np.stack([first, second], 1).astype(np.float32)])


def possible_rows(queries: DataFrame, library: DataFrame, threshold: float) -> DataFrame:
    """``(id, asks)``: queries (``asks``) and library rows whose similarity to any row of the other side may reach the threshold.

    With a = a' + e and b = b' + f, where a' and b' are what the codes hold, ab = a'b' + eb + a'f is at most a'b' + |e||b| + (|a| + |e|)|f|.
    What leaves a block is bounded by its rows, not by its pairs.
    """

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("match_id")
        own, ids = a["query_id"].to_numpy(), b["match_id"].to_numpy()
        lost = a["q_rest"] + ROUNDING * a["q_length"]
        asked = factor(a["q_code"], a["q_scale"], lost, a["q_length"] + lost)
        asks, meets = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for j in range(0, len(b), CODE_LIBRARY_TILE):
            t = b.iloc[j : j + CODE_LIBRARY_TILE]
            rows = factor(t["l_code"], t["l_scale"], t["l_length"], t["l_rest"]).T
            for i in range(0, len(a), CODE_QUERY_TILE):
                bound = asked[i : i + CODE_QUERY_TILE] @ rows
                without_own(bound, own[i : i + CODE_QUERY_TILE], ids[j : j + len(t)])
                near = np.flatnonzero(bound.max(1) >= threshold)
                asks[i + near] = True
                meets[j : j + len(t)] |= (bound[near] >= threshold).any(0)
        return pd.DataFrame({"id": np.concatenate([own[asks], ids[meets]]), "asks": np.arange(asks.sum() + meets.sum()) < asks.sum()})

    columns = ["code", "scale", "rest", "length"]
    return meet_in_blocks(coded(queries, "query_id"), coded(library, "match_id"), columns, columns, kernel, CODE_QUERY_BLOCK, CODE_LIBRARY_BLOCK, {"id": "long", "asks": "boolean"})


def may_match(queries: DataFrame, library: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that can have a match above zero; their ids are written once, since the sizes and both sides need them."""
    ids = stored(possible_rows(queries, library, threshold).distinct())
    side = lambda df, key, asks: df.join(ids.filter(asks).select(F.col("id").alias(key)), key, "left_semi")
    return side(queries, "query_id", F.col("asks")), side(library, "match_id", ~F.col("asks"))


def top_matches(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "match_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(queries: DataFrame, library: DataFrame, k: int, how: str, threshold: float = 0.0) -> DataFrame:
    """``how`` is exact, approximate or hybrid; it is the caller's choice and never follows from the size."""
    from plumbline.operators.quantised import quantised_search, reranked_search

    if how == "exact" and threshold > 0:
        return exact_search(*may_match(queries, library, threshold), k, threshold)
    run = {"exact": exact_search, "hybrid": reranked_search, "approximate": quantised_search}[how]
    return run(queries, library, k).filter(F.col("similarity") >= threshold)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true matches that were found, one row."""
    hit = truth.join(found.select("query_id", "match_id").withColumn("hit", F.lit(1)), ["query_id", "match_id"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
