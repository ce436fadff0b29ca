"""MinHash near-dedup: many universal hash minima, bands, signature verification, and connected components.

1. Texts become sets of hashed word shingles. Equal sets form a class; only its smallest document goes on.
2. 384 minima in 64 bands of 6: two documents with a similarity of 0.75 miss each other with probability 4e-6.
3. Rows of a band key shared by several documents are kept. The smallest and largest document of a key are taken per
   task first and handed back by a join that can be split, so a key that a third of all documents share is no hot task.
4. Each document is paired with the smallest one under its key instead of with all. Pairs are sifted by set sizes and by
   128 one-byte minima (six standard deviations below the bound), and what is left is confirmed on full sets.
5. What these links leave apart is made up for exactly: under every key that still holds several components, those outside
   the largest one are compared with all others in tiles of bounded size that only let links out. Set sizes and the
   128 one-byte minima, 136 bytes a document, decide first which documents of a tile have a possible partner in it;
   only their full sets are brought to the tile. A large group of copies is one component by then, so it meets no more
   than its outsiders, and unlike documents that share a template cost tiles of minima, not of sets.
6. Components by alternating large-star and small-star.

Defined cases: null or blank texts have no shingles and are linked with nothing; texts with fewer words than a shingle
are one shingle; rows with a null id are not linked (component null, kept); rows that repeat an id are one document,
linked if any of their texts is; very long texts count whole; an empty table gives an empty table. Other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import portions, removed, spread_join, table, written
from plumbline.llm.components import components
from plumbline.registry import query

WORDS = 5
BANDS, ROWS = 64, 6
BRIEF = 128
CHUNK = 1 << 16
#: documents on either side of a tile, and the tile's coordinates
TILE, AXIS = 256, {"rows": "i", "cols": "j"}
PLACE = ("g", "i", "j", "id", "c")
NOBODY = pa.table({c: pa.array([], pa.int64()) for c in PLACE} | {"outside": pa.array([], pa.bool_())})
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.array([], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        out = out * M1 + h[k : k + n]
    return np.unique(mixed(out))


class Minima:
    """Universal hash functions x -> (a * x + b) mod 2^64, upper half, with odd a."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
        self.fold = rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Minima of non-empty sets, one row each."""
        out = np.empty((len(sets), BANDS * ROWS), np.uint32)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        start = 0
        while start < len(sets):
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), CHUNK)))
            x = np.concatenate(sets[start:stop])
            at = np.r_[0, np.cumsum(sizes[start:stop])[:-1]]
            for k in range(BANDS * ROWS):
                out[start:stop, k] = np.minimum.reduceat((x * self.a[k] + self.b[k]) >> np.uint64(32), at)
            start = stop
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        bands = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
        return mixed((bands * self.fold).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * M1)


def described(docs: DataFrame) -> DataFrame:
    """Written rows (doc_id, n, c1, c2, brief, keys) for documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Minima()
        for batch in portions(batches):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            full = [k for k, s in enumerate(sets) if len(s)]
            names = np.zeros((len(sets), 2), np.int64)
            brief, keys = [b""] * len(sets), [[]] * len(sets)
            if full:
                minima = family.of([sets[k] for k in full])
                bands = family.keys(minima).view(np.int64)
                short = mixed(minima[:, :BRIEF].astype(np.uint64)).astype(np.uint8)
                for row, k in enumerate(full):
                    names[k] = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64)
                    brief[k], keys[k] = short[row].tobytes(), bands[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]),
                 pa.array(brief, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "c1", "c2", "brief", "keys"])

    return written(docs.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, brief binary, keys array<long>"), "described")


def least_equal(percent: int) -> int:
    """Six standard deviations below the number of equal minima expected at the similarity."""
    j = percent / 100
    return int(BRIEF * j - 6 * (BRIEF * j * (1 - j)) ** 0.5)


def sifted(pairs: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, same) whose one-byte minima do not rule out the similarity."""
    bound = least_equal(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BRIEF) for c in ("brief_a", "brief_b")]
            same = (raw[0] == raw[1]).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same, pa.int64())], ["a", "b", "same"])
            yield out.filter(pa.array(same >= bound))

    both = spread_join(pairs, briefs.select(F.col("id").alias("a"), F.col("brief").alias("brief_a")), ["a"])
    both = spread_join(both, briefs.select(F.col("id").alias("b"), F.col("brief").alias("brief_b")), ["b"])
    return both.select("a", "b", "brief_a", "brief_b").mapInArrow(compare, "a long, b long, same long")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Written rows (id, s) with the full sets of the documents whose ids are listed.

    The join is asked to shuffle: how many documents are listed grows with the input, so they are never broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = [shingle_set(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

    listed = ids.select(F.col("id").alias("doc_id")).hint("merge")
    return written(docs.join(listed, "doc_id", "left_semi").mapInArrow(run, "id long, s binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity; written."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = spread_join(pairs.select("a", "b"), sets.select(F.col("id").alias("a"), F.col("s").alias("s_a")), ["a"])
    both = spread_join(both, sets.select(F.col("id").alias("b"), F.col("s").alias("s_b")), ["b"])
    return written(both.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long").distinct(), "links")


def possible(placed: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """Written rows (g, i, j, id, c, outside): the documents of each tile that may have a partner across it.

    Outsiders of a key's main component are dealt into rows of tiles, all members of keys with that main component into
    columns. A document stays in a tile if sizes and one-byte minima leave it a partner there of another component.
    """
    members = placed.select(F.col("main").alias("g"), "id", "c").distinct()
    outsiders = members.where("c <> g")
    sizes = members.groupBy("g").agg(F.ceil(F.count_if(F.col("c") != F.col("g")) / TILE).alias("rows"), F.ceil(F.count(F.lit(1)) / TILE).alias("cols"))
    bound = least_equal(percent)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = spread_join(rows, sizes, ["g"]).withColumn(AXIS[own], F.pmod(F.xxhash64("id"), F.col(own)))
        rows = spread_join(rows, briefs, ["id"])
        return rows.select("g", "id", "c", "n", "brief", AXIS[own], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(AXIS[other]))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            (c, n, raw), (c2, n2, raw2) = (
                (t.column(4).to_numpy(), t.column(5).to_numpy(), np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, BRIEF))
                for t in (left, right))
            near = np.zeros((len(c), len(c2)), bool)
            for k in range(len(c)):
                at = np.flatnonzero((100 * n[k] >= percent * n2) & (100 * n2 >= percent * n[k]) & (c2 != c[k]))
                near[k, at] = np.count_nonzero(raw2[at] == raw[k], axis=1) >= bound
            for rows, stay, outside in ((left, near.any(axis=1), True), (right, near.any(axis=0), False)):
                rows = rows.select(range(5)).rename_columns(PLACE).filter(pa.array(stay))
                parts.append(rows.append_column("outside", pa.array(np.full(rows.num_rows, outside))))
        return pa.concat_tables(parts) if parts else NOBODY

    left, right = side(dealt(outsiders, "rows", "cols"), "l", "n", "brief"), side(dealt(members, "cols", "rows"), "r", "n", "brief")
    tiles = left.groupBy("l_g", "l_i", "l_j").cogroup(right.groupBy("r_g", "r_i", "r_j"))
    return written(tiles.applyInArrow(compare, "g long, i long, j long, id long, c long, outside boolean").distinct(), "possible")


def side(rows: DataFrame, tag: str, *values: str) -> DataFrame:
    """One side of the tiles, with column names of its own, since both sides come from one table."""
    return rows.select(*[F.col(c).alias(f"{tag}_{c}") for c in (*PLACE, *values)])


def across(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between outsiders and members of the same tile (``possible``), confirmed on full sets. Written.

    Common shingles of all documents of a tile are counted at once; only links leave it.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, comps, sizes, flat = zip(*(unpacked(t) for t in (left, right)), strict=True)
            owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
            order = np.argsort(flat[0], kind="stable")
            hashes, owner[0] = flat[0][order], owner[0][order]
            low, high = np.searchsorted(hashes, flat[1], "left"), np.searchsorted(hashes, flat[1], "right")
            common = np.zeros((len(ids[0]), len(ids[1])), np.int32)
            for start in range(0, len(flat[1]), CHUNK):
                n = (high - low)[start : start + CHUNK]
                at = np.repeat(low[start : start + CHUNK] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cell = owner[0][at] * len(ids[1]) + np.repeat(owner[1][start : start + CHUNK], n)
                common += np.bincount(cell, minlength=common.size).reshape(common.shape).astype(np.int32)
            union = sizes[0][:, None] + sizes[1][None, :] - common
            linked = (common > 0) & (100 * common >= percent * union) & (comps[0][:, None] != comps[1][None, :])
            rows, cols = np.nonzero(linked)
            a, b = ids[0][rows], ids[1][cols]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    full = spread_join(tiles, sets, ["id"])
    left, right = side(full.where("outside"), "l", "s"), side(full.where("NOT outside"), "r", "s")
    met = left.groupBy("l_g", "l_i", "l_j").cogroup(right.groupBy("r_g", "r_i", "r_j"))
    return written(met.applyInArrow(compare, "a long, b long").distinct(), "across")


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, components, set sizes, all sets end to end) of a tile."""
    ids, comps, raw = rows.columns[3:]
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
    return ids.to_numpy(), comps.to_numpy(), np.array([len(x) for x in sets]), np.concatenate(sets)


def in_component(rows: DataFrame, found: DataFrame, key: str, name: str) -> DataFrame:
    """The rows with the component of ``key`` as ``name``; a node without links is its own."""
    named = found.select(F.col("id").alias(key), F.col("component").alias(name))
    return spread_join(rows, named, [key], "left").withColumn(name, F.coalesce(name, key))


def one_document(named: DataFrame) -> DataFrame:
    """Links (a, b) from an id whose texts are in classes of several heads to each of these heads; written."""
    places = named.where("doc_id IS NOT NULL").select("doc_id", "id").distinct()
    several = places.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("doc_id")
    return written(spread_join(places, several, ["doc_id"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "one-document")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every input row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    told = described(docs)
    usable = told.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("id")), "classes")
    # an id that heads several classes keeps the sizes and minima of each
    heads = written(spread_join(usable, classes, ["c1", "c2"]).where("doc_id = id").select("id", "n", "brief", "keys"), "heads")
    heads_of = told.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("c1")).alias("c1"), "c2")
    named = written(spread_join(heads_of, classes, ["c1", "c2"], "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("id")), "named")
    removed(told)
    removed(classes)
    bands = heads.select("id", "n", F.explode("keys").alias("key"))
    ends = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub <> far").select("key", "hub")
    shared = written(spread_join(bands, written(ends, "hubs"), ["key"]), "bands")
    briefs = written(heads.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", "brief").distinct(), "briefs")
    removed(heads)
    alike = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    hubs = shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), "n").distinct()
    sizes = briefs.select(F.col("id").alias("b"), F.col("n").alias("n_b")).distinct()
    hubs = spread_join(hubs, sizes, ["b"]).where(alike("n", "n_b")).select("a", "b").distinct()
    hubs = written(sifted(hubs, briefs, percent), "pairs")
    sets = sets_of(docs, briefs.select("id").distinct())
    links = confirmed(hubs, sets, percent).unionByName(one_document(named))
    found = components(links)

    placed = in_component(shared.select("key", "id"), found, "id", "c").distinct()
    main = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(
        F.max_by("c", F.struct("m", -F.col("c"))).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    placed = written(spread_join(placed, main, ["key"]), "placed")
    tiles = possible(placed, briefs, percent)
    more = across(tiles, sets, percent)
    for done in (placed, briefs, tiles, sets):
        removed(done)
    found = components(links.unionByName(more))

    out = in_component(named, found, "id", "component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""


@query("op2_minhash", SQL)
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
