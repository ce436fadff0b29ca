"""Designed samples and near-duplicate rows against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sample_design as sd
from plumbline.operators import similar_rows as sr


def design_input(spark, n=4000):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        cluster = "hot" if i % 3 == 0 else None if i % 400 == 1 else "rare" if i % 500 == 2 else f"c{rnd.randint(0, 5)}"
        rows.append((i, cluster, rnd.choice([None, 2020, 2021, 2022]), rnd.choice([None, 0.0, rnd.random() * 10])))
    return rows, spark.createDataFrame(rows, "id long, cluster string, period int, score double")


def test_designed_sample(spark):
    rows, df = design_input(spark)
    out = [tuple(r) for r in sd.designed_sample(df, "cluster", "period", "score", "id", 900).collect()]
    assert len(out) == 900
    sizes = collections.Counter(r[1] for r in rows)
    copies = collections.Counter(r[0] for r in out)
    times = {c: min(5, max(2, int(0.01 * len(rows) / n))) for c, n in sizes.items() if n < 0.01 * len(rows)}
    assert set(times) == {None, "rare"} and all(copies[r[0]] == times[r[1]] for r in rows if r[1] in times)
    worst = sorted(rows, key=lambda r: (-(r[3] or 0), r[0]))[:4]
    assert {r[0] for r in out if r[4] == "outlier"} == {r[0] for r in worst if r[1] not in times}
    # quotas: one for each stratum, the rest by largest remainder
    n = collections.Counter(r[1:3] for r in rows if r[1] not in times and r not in worst)
    wanted = 900 - sum(1 for r in out if r[4] != "quota")
    text = lambda x: "" if x is None else f"={x}"
    share = {s: divmod((wanted - len(n)) * (k - 1), sum(n.values()) - len(n)) for s, k in n.items()}
    first = sorted(n, key=lambda s: (-share[s][1], text(s[0]), text(s[1])))[: wanted - len(n) - sum(q for q, _ in share.values())]
    assert collections.Counter(r[1:3] for r in out if r[4] == "quota") == {s: 1 + share[s][0] + (s in first) for s in n}
    assert all(c == 1 for i, c in copies.items() if rows[i][1] not in times)
    again = sd.designed_sample(df.repartition(7), "cluster", "period", "score", "id", 900)
    assert sorted(out, key=repr) == sorted((tuple(r) for r in again.collect()), key=repr)


def test_designed_sample_cases(spark):
    rows, df = design_input(spark, 600)
    with pytest.raises(ValueError, match="cannot be drawn"):
        sd.designed_sample(df, "cluster", "period", "score", "id", 2)
    with pytest.raises(ValueError, match="cannot be drawn"):
        sd.designed_sample(df, "cluster", "period", "score", "id", 10_000)
    assert sd.designed_sample(df.limit(0), "cluster", "period", "score", "id", 0).count() == 0
    fixed = sum(1 for r in sd.designed_sample(df, "cluster", "period", "score", "id", 300).collect() if r["reason"] != "quota")
    # too few left for one in each stratum: still exact
    assert sd.designed_sample(df, "cluster", "period", "score", "id", fixed + 3).count() == fixed + 3


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_pairs(spark, percent):
    """Families of near sets, one token in nearly all of them, and sets of one size that share only frequent tokens."""
    rnd = random.Random(percent)
    sets = {}
    for f in range(25):
        base = {f"f{f}t{k}" for k in range(rnd.randint(2, 60))} | {"hot"}
        for _ in range(rnd.randint(1, 5)):
            s = set(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 12)):
                s.discard(rnd.choice(sorted(s)))
                s.add(f"n{rnd.randint(0, 500)}")
            sets[len(sets)] = s
    for _ in range(150):
        sets[len(sets)] = {"hot", f"w{rnd.randint(0, 3)}", f"v{rnd.randint(0, 3)}", f"u{rnd.randint(0, 40)}"}
    unique = {}
    for i, s in sets.items():
        unique.setdefault(frozenset(s), i)
    df = spark.createDataFrame([(i, sorted(s)) for s, i in unique.items()], "row_id long, tokens array<string>")
    got = {(r["a"], r["b"]): (r["shared"], r["size"]) for r in sr.similar_pairs(df, percent).collect()}
    want = {}
    for x, i in unique.items():
        for y, j in unique.items():
            if i < j and 100 * len(x & y) >= percent * len(x | y):
                want[i, j] = (len(x & y), len(x | y))
    assert got == want and want


def test_near_duplicate_rows_cases(spark):
    rows = [(1, "a B  c", 5.0, None), (2, "A b C", 5.0, None), (3, None, None, None), (4, "", None, None), (5, "a b c d", 5.0, 1), (6, " a\tb\nc ", 5.0, None)]
    df = spark.createDataFrame(rows, "id long, text string, x double, y int")
    got = {r["row_id"]: (r["n_tokens"], r["class_id"], r["links"]) for r in sr.near_duplicate_rows(df, "id", ["text", "x", "y"], 60).collect()}
    assert got == {1: (4, 1, 1), 2: (4, 1, 1), 3: (0, 3, 0), 4: (0, 3, 0), 5: (6, 5, 1), 6: (4, 1, 1)}
    assert sr.near_duplicate_rows(df.limit(0), "id", ["text"]).count() == 0
    copies = spark.range(3000).select(F.col("id"), F.lit("the same text in every row").alias("text"))
    assert {(r["class_id"], r["links"]) for r in sr.near_duplicate_rows(copies, "id", ["text"]).collect()} == {(0, 0)}


@pytest.mark.parametrize("percent", [90, 95, 99, 100])
def test_similar_sizes_share_a_band_and_a_part(percent):
    """sets of similar sizes fall into one band or its neighbour, and differ by fewer tokens than there are parts."""
    edges, parts = sr.bands(percent, 400)
    band = lambda n: max(i for i, e in enumerate(edges) if e <= n)
    for small in range(1, 381):
        for large in range(small, small * 100 // percent + 1):
            assert band(large) - band(small) in (0, 1)
            shared = -(-percent * (small + large) // (100 + percent))
            if shared <= small and (small, large) != (shared, shared):
                assert small + large - 2 * shared < parts[band(small)]


def test_tokens_are_those_of_the_columns(spark):
    """the same words as by the pattern, in texts with odd blanks and letters, in several slices."""
    texts = ["a\x0bB\x0cc\ra", "x\x1cy z\u00a0w", " \u0130I \u03a3\u03a3 \u1e9e ", None, "", "\u2003 q\u2003q", "text=1 1"] * 3
    df = spark.createDataFrame([(i, t, t, None if i % 3 else i / 2) for i, t in enumerate(texts)], "id long, text string, other string, x double")
    got = {r["row_id"]: (r["n_tokens"], r["class_id"]) for r in sr.near_duplicate_rows(df, "id", ["text", "other", "x"]).collect()}
    sets = {r["id"]: tuple(r["t"]) for r in df.select("id", sr.row_tokens(df, ["text", "other", "x"]).alias("t")).collect()}
    assert got == {i: (len(t), min(j for j, u in sets.items() if u == t)) for i, t in sets.items()}


def near_texts(rnd, n=300):
    """Texts of 1 to 200 words of a small vocabulary, with copies and copies that differ by some words; an id of two rows."""
    texts = []
    for _ in range(n):
        words = [f"w{int(rnd.paretovariate(0.5)) % 5000}" for _ in range(rnd.randint(1, 200))]
        texts.append(words)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rnd.randint(0, 1 + len(words) // 25)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randint(0, 99)}"
            texts.append(copy)
    rnd.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_duplicate_texts(spark):
    """against brute force; the rows are read for their keys and for the sets that met, which were five times and more."""
    rows = near_texts(random.Random(9))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    got = {r["row_id"]: (r["n_tokens"], r["class_id"], r["links"]) for r in sr.near_duplicate_rows(df.mapInPandas(counted, df.schema), "id", ["text"]).collect()}
    assert reads.value <= 2 * len(rows)
    sets = {i: frozenset(t.split()) for i, t in rows}
    head = {}
    for i, s in sorted(sets.items()):
        head.setdefault(s, i)
    links = collections.Counter(i for i, s in sets.items() if head[s] == i for j, u in sets.items() if head[u] == j and i != j and 100 * len(s & u) >= 95 * len(s | u))
    assert got == {i: (len(s), head[s], links[head[s]]) for i, s in sets.items()}
    assert sum(links.values()) > 50
    # a linked row that comes twice
    twice = next(i for i in links if links[i] == 1)
    other = next(j for j, u in sets.items() if j != twice and head[u] == j and 100 * len(sets[twice] & u) >= 95 * len(sets[twice] | u))
    again = {r["row_id"]: r["links"] for r in sr.near_duplicate_rows(df.unionByName(df.where(f"id = {twice}")), "id", ["text"]).collect()}
    assert again[twice] == 0 and again[other] == links[other] - 1
