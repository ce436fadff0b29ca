"""Keys of several tokens in the set-similarity join."""

import itertools

from plumbline.operators import similar_rows as sr


def test_frequent_tokens_meet_by_several(spark):
    """Sets of few frequent tokens: only those that share a combination meet, and no pair is lost."""
    sets = [tuple(sorted((f"a{i}", f"b{j}", f"c{m}", f"d{n}", f"e{o}"))) for i, j, m, n, o in itertools.product(range(6), range(6), range(6), range(3), range(2))]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "row_id long, tokens array<string>")
    found = sr.similar_pairs(df, 60)
    # four of five tokens: each set has (5 + 5 + 5 + 2 + 1) others
    assert found.count() == len(sets) * 18 // 2
    met = next(n for n in str(found._jdf.queryExecution().analyzed()).splitlines() if "Join Inner" in n and "key" in n)
    assert "band" in met
    keys = sr._combinations(sr.F.transform(sr.F.array(*[sr.F.lit(c) for c in "pqrst"]), lambda t: sr.F.xxhash64(t)), sr.F.lit(3))
    rows = spark.range(1).select(sr.F.inline(keys)).collect()
    assert len({r["key"] for r in rows}) == 10 and sorted({r["pos"] for r in rows}) == [2, 3, 4]
