"""Near-duplicate rows: an exact set-similarity join.

A row is a set of tokens, its filled cells and the words of its texts. Rows with equal sets are one class, so copies are
never paired. Sizes fall into bands a factor t wide, so a set only meets those of its own and the next smaller band.

Above ``BY_PARTS`` percent few tokens may differ, at most d in a band. The tokens are dealt by hash to d + 1 parts, so that two
similar sets have an equal part, which is their key (``pairs_by_parts``). A key names about 1 / (1 - t) tokens, and follows from the
set alone: the texts are read once for it and again only for the sets that met, and no token is shuffled.

Below, parts would be small and keys frequent. Tokens are ordered by rarity. Two sets that must share s tokens share the first k of
them among the first n - s + k of each, so the join key is a combination of k tokens from there: the larger k, the rarer a key and the
more keys a set has. k follows from the band alone, up to 4, as long as a set has few keys. Pairs which have too few tokens left after
the shared ones (position) are dropped.

Pairs whose sizes differ by more than the factor t (length) are dropped, the others confirmed on full sets. Nothing is capped.

Defined cases: rows without tokens are one class without links; null cells give no token; an id of several rows names no set of its
own and has no links; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From this percentage on, sets meet by equal parts.
BY_PARTS = 90
#: Bytes of text whose words are held at once.
SLICE_BYTES = 4_000_000


def row_tokens(df: DataFrame, cols: list[str]) -> Column:
    """The distinct ``column=value`` tokens of a row; texts give one for each word."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = []
    for c in cols:
        values = F.split(F.lower(F.col(c)), r"\s+") if isinstance(kinds[c], T.StringType) else F.array(F.col(c).cast("string"))
        values = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
        parts.append(F.transform(values, lambda v, c=c: F.concat(F.lit(f"{c}="), v)))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def classes(sets: DataFrame) -> DataFrame:
    """``(row_id, class_id, n)`` from ``(row_id, tokens)``: the smallest id with the same set, and the set's size."""
    keyed = sets.select("row_id", F.size("tokens").alias("n"), F.sha2(F.array_join("tokens", "\x1f"), 256).alias("_set"))
    heads = keyed.groupBy("_set").agg(F.min("row_id").alias("class_id"))
    return keyed.join(heads, "_set").select("row_id", "class_id", "n")


def by_rarity(sets: DataFrame) -> DataFrame:
    """The sets with their tokens ordered from the rarest to the most frequent one."""
    cells = sets.select("row_id", F.explode("tokens").alias("token"))
    counts = cells.groupBy("token").agg(F.count("*").alias("_f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_f", "token"))), lambda x: x["token"])
    # an extra key, so that the join does not reuse the layout by token and a hot token can be split
    tag = F.xxhash64("token").alias("_tag")
    return cells.select("*", tag).join(counts.select("*", tag), ["token", "_tag"]).groupBy("row_id").agg(ordered.alias("tokens"))


#: A set of the smaller side has about so many keys at most, if one token alone does not give more.
MOST_KEYS = 64
MOST_TOGETHER = 4


def _together(missing: Column) -> Column:
    """How many tokens make a key of sets that may miss so many of theirs: the most with few combinations."""
    out = F.lit(1)
    for k in range(2, MOST_TOGETHER + 1):
        most = max(d for d in range(MOST_KEYS) if math.comb(d + k, k) <= MOST_KEYS)
        out = F.when(missing <= most, k).otherwise(out)
    return out


def _combinations(prefix: Column, k: Column) -> Column:
    """``(key, pos)`` of every combination of k tokens: a hash, and the place of its last token."""
    start = F.array(F.struct(F.lit(0).alias("n"), F.lit(42).cast("bigint").alias("key"), F.lit(-1).alias("pos")))

    def step(acc: Column, x: Column) -> Column:
        longer = F.transform(F.filter(acc, lambda c: c["n"] < k), lambda c: F.struct((c["n"] + 1).alias("n"), F.xxhash64(c["key"], x["token"]).alias("key"), x["pos"].alias("pos")))
        return F.concat(acc, longer)

    placed = F.transform(prefix, lambda t, i: F.struct(t.alias("token"), i.alias("pos")))
    return F.transform(F.filter(F.aggregate(placed, start, step), lambda c: c["n"] == k), lambda c: F.struct(c["key"].alias("key"), c["pos"].alias("pos")))


def cells(df: DataFrame, row_id: str, cols: list[str]) -> DataFrame:
    """``(row_id, <column>...)`` as ``token_ids`` reads them: texts in lower case, other values as text in an array."""
    kinds = {f.name: f.dataType for f in df.schema}
    cell = lambda c: F.lower(c) if isinstance(kinds[c], T.StringType) else F.array(F.col(c).cast("string"))
    return df.select(F.col(row_id).alias("row_id"), *[cell(c).alias(c) for c in cols])


def token_ids(columns: list, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and second number of every distinct token, by row; both are hashes of 64 bits, with keys that follow from the column's name.

    ``columns`` are Arrow arrays of texts or of lists of tokens. Equal values of two columns are two tokens.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pandas.util import hash_array

    rows, first, second = [], [], []
    for column, name in zip(columns, names, strict=True):
        # the blanks of a Java pattern
        lists = column if pa.types.is_list(column.type) else pc.ascii_split_whitespace(column)
        row, word = pc.list_parent_indices(lists), pc.list_flatten(lists)
        full = pc.fill_null(pc.not_equal(word, ""), False)
        row, words = row.filter(full).to_numpy(zero_copy_only=False), word.filter(full).dictionary_encode()
        if not len(row):
            continue
        # a row names a word once: rows and places in the dictionary are small numbers
        values, size = words.dictionary.to_numpy(zero_copy_only=False), len(words.dictionary)
        both = row.astype(np.int64) * size + words.indices.to_numpy(zero_copy_only=False)
        both.sort()
        row, word = np.divmod(both[np.append(True, both[1:] != both[:-1])], size)
        rows.append(row)
        for out, salt in ((first, b"1"), (second, b"2")):
            key = hashlib.blake2b(name.encode(), digest_size=8, salt=salt).hexdigest()
            out.append(hash_array(values, hash_key=key, categorize=False)[word])
    row, one, two = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rows, np.int64), (first, np.uint64), (second, np.uint64)))
    if len(rows) > 1:
        order = np.argsort(row, kind="stable")
        row, one, two = row[order], one[order], two[order]
    return row, one, two


def slices(batch) -> Iterator:
    """Parts of an Arrow batch with a bounded number of bytes, if one row has not more."""
    size = max(1, int(SLICE_BYTES * batch.num_rows / max(1, batch.nbytes)))
    return (batch.slice(i, size) for i in range(0, batch.num_rows, size))


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest size of each band up to the size ``most``, and the number of its parts.

    A set is not similar to one that is larger than the next band allows. A band without a difference between similar sets, which
    would then be equal, has no parts.
    """
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 100 // percent + 1)
    largest = np.array(edges[1:]) - 1
    differ = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
    return np.array(edges[:-1]), np.where(differ > 0, differ + 1, 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random, from 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_keys(row: np.ndarray, one: np.ndarray, two: np.ndarray, band: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every row's parts, where it falls into so many in a band, and where the keys of a row begin."""
    starts = np.append(0, np.cumsum(parts))
    has = parts[row] > 0
    row, one, two = row[has], one[has], two[has]
    part = (one % parts[row].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(starts[-1], np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, starts[row] + part, mixed(two))
        # equal sums meet in one part of one band only
        place = np.arange(starts[-1]) - np.repeat(starts[:-1], parts)
        keys = mixed(sums + mixed((np.repeat(band, parts) * 2**32 + place).astype(np.uint64) + np.uint64(1)))
    return keys.view(np.int64), starts


def described(rows: DataFrame, names: list[str], percent: int) -> DataFrame:
    """``(row_id, n, s1, s2, own, low)`` of ``cells``: the size of a row's set, two numbers that name it, and its keys in its band and the one below."""

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for t in slices(batch):
                row, one, two = token_ids(t.columns[1:], names)
                n = np.bincount(row, minlength=t.num_rows)
                s1, s2 = np.zeros(t.num_rows, np.uint64), np.zeros(t.num_rows, np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(s1, row, one)
                    np.add.at(s2, row, two)
                edges, parts = bands(percent, max(1, n.max(initial=0)))
                band = np.searchsorted(edges, n, "right") - 1
                lists = []
                for b in (band, band - 1):
                    keys, starts = part_keys(row, one, two, b, np.where(b >= 0, parts[np.maximum(b, 0)], 0))
                    lists.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys)))
                values = [t.column(0), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (s1, s2)), *lists]
                yield pa.RecordBatch.from_arrays(values, ["row_id", "n", "s1", "s2", "own", "low"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(describe, f"row_id {kind}, n int, s1 long, s2 long, own array<long>, low array<long>")


def whole_sets(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(row_id, s1, s2, tokens)`` of ``cells``: a row's tokens as the ids of their hashes."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for t in slices(batch):
                row, one, two = token_ids(t.columns[1:], names)
                starts = np.searchsorted(row, np.arange(t.num_rows + 1))
                s1, s2 = np.zeros(t.num_rows, np.uint64), np.zeros(t.num_rows, np.uint64)
                with np.errstate(over="ignore"):
                    np.add.at(s1, row, one)
                    np.add.at(s2, row, two)
                tokens = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(one.view(np.int64)))
                yield pa.RecordBatch.from_arrays([t.column(0), *(pa.array(x.view(np.int64)) for x in (s1, s2)), tokens], ["row_id", "s1", "s2", "tokens"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"row_id {kind}, s1 long, s2 long, tokens array<long>")


def pairs_by_parts(heads: DataFrame, rows: DataFrame, names: list[str], percent: int) -> DataFrame:
    """As ``similar_pairs``, from the ``described`` heads of classes; only the ``rows`` of heads that met are read again."""
    from plumbline.operators.search import stored

    head = lambda name, *keys: heads.select(F.col("row_id").alias(name), *[F.col(c).alias(c + name) for c in ("n", "s1", "s2")], F.explode(F.concat(*keys)).alias("key"))
    met = head("x", "own", "low").join(head("y", "own"), "key")
    # the larger set first, ties by id
    met = met.where((F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y"))))
    met = met.where(F.col("ny") * 100 >= F.col("nx") * percent)
    # read for the ids of both sides and for the pairs
    pairs = stored(met.select("x", "s1x", "s2x", "nx", "y", "s1y", "s2y", "ny").distinct())
    asked = stored(pairs.select(F.explode(F.array("x", "y")).alias("row_id")).distinct())
    full = whole_sets(rows.join(asked, "row_id", "left_semi"), names).dropDuplicates(["row_id", "s1", "s2"])
    side = lambda name: full.select(F.col("row_id").alias(name), *[F.col(c).alias(c + name) for c in ("s1", "s2")], F.col("tokens").alias(f"t{name}"))
    checked = pairs.join(side("x"), ["x", "s1x", "s2x"]).join(side("y"), ["y", "s1y", "s2y"])
    checked = checked.select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("shared"), (F.col("nx") + F.col("ny")).alias("both"))
    return near_ones(checked, percent)


def near_ones(checked: DataFrame, percent: int) -> DataFrame:
    near = checked.where(F.col("shared") * (100 + percent) >= percent * F.col("both"))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", (F.col("both") - F.col("shared")).alias("size"))


def similar_pairs(sets: DataFrame, percent: int = 95) -> DataFrame:
    """``(a, b, shared, size)``: all pairs of sets with 100 shared >= percent * size, a < b; size is that of the union.

    ``sets`` holds ``(row_id, tokens)``, distinct ids, equal sets once.
    """
    if percent >= BY_PARTS:
        rows = sets.select("row_id", "tokens")
        return pairs_by_parts(described(rows, [""], percent), rows, [""], percent)
    ordered = by_rarity(sets).withColumn("n", F.size("tokens"))
    scale = -math.log(percent / 100)
    band = F.floor(F.log("n") / scale + 1e-9) if percent < 100 else F.col("n").cast("bigint")
    # no size of a band is below its edge, none reaches the next one
    edge = lambda b: F.greatest(F.lit(1), F.ceil(F.exp(b * scale) * (1 - 1e-8))) if percent < 100 else b
    part = lambda x, over: F.ceil(x * percent / over).cast("int")
    shared = lambda sizes: part(sizes, 100 + percent)
    low, high = edge(F.col("band")), edge(F.col("band") + 1)
    k = F.least(_together(high - shared(2 * high)), shared(2 * low)).cast("int")

    def keyed(side: DataFrame, needed: Column) -> DataFrame:
        """The keys of every set in a band, whose partner there makes it share so many tokens."""
        cut = side.withColumn("k", k).withColumn("prefix", F.transform(F.slice("tokens", F.lit(1), F.col("n") - needed + F.col("k")), lambda t: F.xxhash64(t)))
        return cut.select("row_id", "n", "k", "band", F.inline(_combinations(F.col("prefix"), F.col("k"))))

    own = ordered.select("row_id", "n", "tokens", band.alias("band"))
    larger = keyed(own.withColumn("band", F.explode(F.array("band", F.col("band") - 1))), shared(F.col("n") + F.greatest(low, part(F.col("n"), 100))))
    smaller = keyed(own, shared(2 * F.col("n")))
    large = larger.select(F.col("row_id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), "k", "band", "key")
    small = smaller.select(F.col("row_id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), "band", "key")
    met = large.join(small, ["key", "band"])
    # the larger set first, ties by id
    met = met.where((F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y"))))
    met = met.where(F.col("ny") * 100 >= F.col("nx") * percent)
    # 100 s >= p (nx + ny - s) for s shared tokens, if these are the first k of them
    left = F.col("k") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    met = met.where(left * (100 + percent) >= percent * (F.col("nx") + F.col("ny")))
    pairs = met.select("x", "y").distinct()
    full = ordered.select("row_id", "tokens")
    checked = pairs.join(full.withColumnsRenamed({"row_id": "x", "tokens": "tx"}), "x").join(full.withColumnsRenamed({"row_id": "y", "tokens": "ty"}), "y")
    checked = checked.select("x", "y", F.size(F.array_intersect("tx", "ty")).alias("shared"), (F.size("tx") + F.size("ty")).alias("both"))
    return near_ones(checked, percent)


def near_duplicate_rows(df: DataFrame, row_id: str, cols: list[str], percent: int = 95) -> DataFrame:
    """``(row_id, n_tokens, class_id, links)``: the class of equal rows and to how many other classes it is similar."""
    if percent >= BY_PARTS:
        from plumbline.operators.search import stored

        rows = cells(df, row_id, cols)
        # read for the classes, the heads and both sides of their meeting
        sets = stored(described(rows, cols, percent))
        name = ["n", "s1", "s2"]
        member = sets.select("row_id", *name).join(sets.groupBy(*name).agg(F.min("row_id").alias("class_id")), name)
        # equal sets have equal keys
        heads = sets.where("n > 0").groupBy(*name).agg(F.min("row_id").alias("row_id"), F.first("own").alias("own"), F.first("low").alias("low"))
        member, pairs = member.select("row_id", "class_id", "n"), pairs_by_parts(heads, rows, cols, percent)
        several = sets.where("n > 0").groupBy("row_id").agg(F.count("*").alias("_rows")).where("_rows > 1")
        for end in ("a", "b"):
            pairs = pairs.join(several.select(F.col("row_id").alias(end)), end, "left_anti")
    else:
        sets = df.select(F.col(row_id).alias("row_id"), row_tokens(df, cols).alias("tokens"))
        member = classes(sets)
        heads = sets.join(member.where("row_id = class_id AND n > 0").select("row_id"), "row_id", "left_semi")
        pairs = similar_pairs(heads, percent)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return member.join(ends, "class_id", "left").select(
        "row_id", F.col("n").cast("bigint").alias("n_tokens"), "class_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
