"""Blocks of the vector search: memory of a block, ties, rows that are no candidates."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import quantised as qs
from plumbline.operators import search as vs
from plumbline.operators import signatures as sg
from plumbline.plans import signatures as _  # noqa: F401
from plumbline.registry import QUERIES


def test_probing_keeps_no_vector_per_list():
    """What a block holds while it picks lists is a number for each query and list, whatever the length of the vectors."""
    rng = np.random.default_rng(5)
    index = qs.Index(rng.normal(size=(18, 64)), rng.normal(size=(18, 18, 64)), np.zeros((64, 1, 1)))
    x = rng.normal(size=(4096, 64))
    tracemalloc.start()
    index.probe(x, 275)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_best_against_sorting():
    """Tiles in any order, many equal rows, rows without a similarity."""
    rng = np.random.default_rng(6)
    own = np.arange(40)
    sim = rng.integers(0, 3, size=(40, 300)).astype(float)
    sim[:, 17], sim[3, :], sim[5, 100:] = np.nan, -np.inf, -np.inf
    want = []
    for q in own:
        rows = [(-sim[q, i], i) for i in range(300) if i != q and np.isfinite(sim[q, i])]
        want += [(q, i, -s) for s, i in sorted(rows)[:4]]
    for parts in ([range(300)], [range(200, 300), range(90, 200), range(90)], [range(i, 300, 7) for i in range(7)]):
        best = vs.Best(own, 4)
        for part in parts:
            best.add(sim[:, list(part)].copy(), np.array(part))
        got = best.frame()
        assert list(zip(got["query_id"], got["match_id"], got["similarity"], strict=True)) == want


def sides(spark, x, parts=4):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(parts)
    return rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "match_id")


def grouped_vectors(rng, n=600, dim=16):
    """Groups of near and of equal vectors among unlike ones, of unequal lengths."""
    x = rng.normal(size=(n, dim))
    x[100:160] = x[100] + rng.normal(size=(60, dim)) * 0.2
    x[200:240] = x[200]
    return x * rng.uniform(0.1, 1.5, size=(n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)


def test_bounds_are_never_below_the_similarity():
    """Vectors of all lengths, zero ones and those without an end; a vector that is no number meets nothing."""
    x = grouped_vectors(np.random.default_rng(7)) * np.logspace(-12, 6, 600)[:, None]
    x[300], x[301, 3], x[302, 3] = 0.0, np.inf, np.nan
    c = vs.codes(pd.Series(list(x)))
    lost = c["rest"] + vs.ROUNDING * c["length"]
    bound = vs.factor(c["code"], c["scale"], lost, c["length"] + lost) @ vs.factor(c["code"], c["scale"], c["length"], c["rest"]).T
    assert (bound[:301, :301] >= x[:301] @ x[:301].T).all() and (bound[303:, 303:] >= x[303:] @ x[303:].T).all()
    assert (bound[302] == 0).all() and (bound[301, :300] > 0).all()


def test_threshold_first_meets_codes(spark, monkeypatch):
    """The same matches as with whole vectors everywhere, over several blocks and tiles, and few whole vectors are left to meet."""
    for name, size in {"CODE_QUERY_BLOCK": 250, "CODE_LIBRARY_BLOCK": 400, "CODE_QUERY_TILE": 32, "CODE_LIBRARY_TILE": 50}.items():
        monkeypatch.setattr(vs, name, size)
    q, lib = sides(spark, grouped_vectors(np.random.default_rng(8)))
    lib = lib.unionByName(spark.createDataFrame([(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16)], lib.schema))
    plain = vs.exact_search(q, lib.filter("match_id < 1000"), 5).filter("similarity >= 0.7")
    want = sorted((r["query_id"], r["match_id"], r["rank"]) for r in plain.collect())
    got = sorted((r["query_id"], r["match_id"], r["rank"]) for r in vs.search(q, lib, 5, "exact", 0.7).collect())
    assert got == want and len(want) > 100
    left = vs.may_match(q, lib, 0.7)
    assert left[0].count() < 400 and left[1].count() < 400
    assert vs.search(q, lib.limit(0), 5, "exact", 0.7).count() == 0


def test_alignment_reads_the_matches_once(spark):
    """A search behind the matches would run twice."""
    m = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (4, 2, 0.7)], "query_id long, match_id long, similarity double")
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            reads.add(len(f))
            yield f

    past = spark.createDataFrame([(2, "a", 50.0), (2, "b", 70.0), (3, "c", 50.0)], "match_id long, dim_name string, score double")
    now = spark.createDataFrame([(1, "a", 60.0), (1, "b", 60.0), (4, "b", 90.0)], "query_id long, dim_name string, score double")
    out = sg.alignment(m.mapInPandas(counted, m.schema), past, now).collect()
    assert {(r["query_id"], r["match_id"]): round(r["alignment"], 6) for r in out} == {(1, 2): 0.65, (1, 3): 0.5, (4, 2): 0.8}
    assert reads.value == 3


def test_blocks_meet_without_a_shuffle(spark, monkeypatch, capsys):
    """rows were copied for every block of the other side; now each is written once and read for the meetings, which give the same matches."""
    written = []
    plain = vs.stored
    monkeypatch.setattr(vs, "stored", lambda df, **a: (written.append(plain(df, **a)), written[-1])[1])
    x = grouped_vectors(np.random.default_rng(9))

    def kernel(a, b):
        return pd.DataFrame({"query_id": a["query_id"], "match_id": b["match_id"].min(), "similarity": float(len(b))})

    met = vs.meet_in_blocks(*sides(spark, x), ["vector"], ["vector"], kernel, 40, 30)
    met.explain()
    assert not {"Exchange", "Generate"} & set(capsys.readouterr().out.replace("(", " ").split())
    sums = met.groupBy("query_id").sum("similarity").collect()
    assert len(sums) == 600 and {r[1] for r in sums} == {600.0}
    assert [len({f for (f,) in t.selectExpr("_metadata.file_path").collect()}) for t in written] == [t.count() for t in written]
    assert written[0].count() <= 15 and written[1].count() <= 20


def test_copies_tie_wherever_they_stand(spark):
    """at the edge of a matrix product the sum is taken in another order, which put one copy before another with a smaller id."""
    x = np.random.default_rng(10).normal(size=(1037, 64))
    x[5::9] = x[5]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = list(range(5, 1037, 9))
    want = {(q, m, r) for q in copies for r, m in enumerate([c for c in copies[:6] if c != q][:5], 1)}
    for found in (vs.exact_search(*sides(spark, x), k=5).filter("similarity > 0.99"), vs.search(*sides(spark, x), k=5, how="exact", threshold=0.9)):
        assert {(r["query_id"], r["match_id"], r["rank"]) for r in found.collect()} == want


def test_rows_below_the_threshold_do_not_leave_a_meeting():
    sim = np.array([[0.9, 0.2, 0.7, 0.69], [0.1, 0.2, 0.3, 0.4]])
    best = vs.Best(np.array([10, 11]), 3, 0.7)
    best.add(sim[:, :2].copy(), np.array([0, 1]))
    best.add(sim[:, 2:].copy(), np.array([2, 3]))
    assert best.frame().values.tolist() == [[10, 0, 0.9], [10, 2, 0.7]]


@pytest.mark.parametrize("name", ["sig_10_history_advice", "sig_05_similar_patterns", "flt_05_similarity_threshold", "sig_15_prescreen"])
def test_queries_above_a_threshold_read_blocks(spark, sf, capsys, name):
    """F18 to F21: no row is copied for every block of the other side."""
    QUERIES[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "CoGroups" not in plan and "explode" not in plan


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """A table of 20 unlike vectors in 30 copies each: every row has more matches than a query keeps, in every block."""
    folder = str(tmp_path_factory.mktemp("copies"))
    x = np.random.default_rng(11).normal(size=(20, 64))
    rows = [(20 * c + i, v.tolist(), i) for c in range(30) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def rows_before_the_cut(monkeypatch, name, spark, folder):
    """The result, and how many rows of a search were shuffled to be cut to the best."""
    seen, plain = [], vs.top_matches
    monkeypatch.setattr(vs, "top_matches", lambda found, k: (seen.append(found), plain(found, k))[1])
    out = sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(vs, "top_matches", plain)
    return out, seen[0].count()


@pytest.mark.parametrize("name", ["sig_10_history_advice", "sig_05_similar_patterns", "flt_05_similarity_threshold", "sig_15_prescreen"])
def test_a_query_leaves_each_part_with_its_best_rows(spark, copies, monkeypatch, name):
    """F18 to F21: k rows of every query left every one of the library's blocks, whose number grows with the rows."""
    want, one_block = rows_before_the_cut(monkeypatch, name, spark, copies)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 150)
    monkeypatch.setattr(vs, "LIBRARY_BLOCK", 30)
    got, left = rows_before_the_cut(monkeypatch, name, spark, copies)
    assert got == want and len(got) > 500
    assert one_block == 5 * 600 and left <= vs.LIBRARY_PARTS * one_block


def test_best_rows_of_two_blocks():
    found = pd.DataFrame({"query_id": [1, 1, 2, 1, 1, 2], "match_id": [5, 6, 7, 4, 8, 3], "similarity": [0.9, 0.7, 0.8, 0.9, 0.8, 0.1]})
    assert vs.best_rows(found, 2).values.tolist() == [[1, 4, 0.9], [1, 5, 0.9], [2, 7, 0.8], [2, 3, 0.1]]


def odd_vectors(rng, n=3000, dim=24):
    """Unlike vectors, copies, tiny, huge and endless ones, a zero one and one that is no number."""
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:140] = x[100]
    x[200:210] *= 1e-25
    x[300:310] *= 1e20
    x[400], x[401, 3], x[402, 3] = 0.0, np.inf, np.nan
    return x


def best_by_sorting(x, ids, k, may):
    with np.errstate(invalid="ignore"):
        sim = vs.products(x, x)
    sim[np.isnan(sim) | (ids[:, None] == ids) | ~may] = -np.inf
    out = {}
    for q, row in enumerate(sim):
        order = np.lexsort((ids, -row))[:k]
        out[q] = [(int(ids[j]), row[j]) for j in order if row[j] > -np.inf]
    return out


@pytest.mark.parametrize("probing", [False, True])
def test_few_whole_products(monkeypatch, probing):
    """F1, F3 to F5: every pair was multiplied in double precision, list by list. The rows that are found stay the same."""
    rng = np.random.default_rng(12)
    x, ids = odd_vectors(rng), rng.permutation(3000)
    lists = rng.integers(0, 30, 3000)
    mask = rng.random((3000, 30)) < 0.85 if probing else np.ones((3000, 30), bool)
    multiplied, plain = [], vs.products
    want = best_by_sorting(x, ids, 5, mask[:, lists])
    monkeypatch.setattr(vs, "products", lambda a, b: (multiplied.append(len(a) * len(b)), plain(a, b))[1])
    monkeypatch.setattr(vs, "LIBRARY_TILE", 64)
    monkeypatch.setattr(vs, "QUERY_PIECE", 100)
    tile = vs.Tile(x, vs.Best(ids, 5, scored=probing), np.packbits(mask, axis=1) if probing else None)
    with np.errstate(all="ignore"):
        for part in np.array_split(np.arange(3000), 4):
            tile.meet(vs.Rows(x[part], ids[part], lists[part] if probing else None, 2 * x[part] if probing else None))
    best = tile.best
    for q, rows in want.items():
        assert [(i, s) for i, s in zip(best.ids[q], best.sims[q], strict=True) if s > -np.inf] == rows
    if probing:
        at = {i: row for row, i in enumerate(ids)}
        for q in range(0, 90):
            for i, score in zip(best.ids[q], best.scores[q], strict=True):
                assert score == pytest.approx(2 * x[q] @ x[at[i]], nan_ok=True)
    assert sum(multiplied) < 0.5 * 3000 * 3000


def test_queries_beside_no_list_of_a_tile_are_passed_over(monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 8))
    lists = np.repeat(np.arange(4), 100)
    mask = lists[:, None] == np.arange(4)
    met, plain = [], vs.peaks
    monkeypatch.setattr(vs, "LIBRARY_TILE", 50)
    monkeypatch.setattr(vs, "peaks", lambda a, b, room: (met.append(len(a) * len(b)), plain(a, b, room))[1])
    tile = vs.Tile(x, vs.Best(np.arange(400), 3), np.packbits(mask, axis=1))
    order = rng.permutation(400)
    tile.meet(vs.Rows(x[order], order, lists[order]))
    assert sum(met) == 400 * 100
    assert (lists[tile.best.ids] == lists[:, None]).all()


def test_candidates_leave_their_block_scored(spark, sf, capsys):
    """the vectors of both sides were shuffled for each of three times k candidates of a query."""
    QUERIES["jon_10_hybrid_search"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Join" not in plan


def test_reranked_ids_of_several_rows(spark):
    """F1: an id of several rows is scored with each of them, as the join of candidates and rows says."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(300, 8))
    ids = np.arange(300)
    ids[250:270] = ids[:20]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>")
    q, lib = rows.withColumnRenamed("id", "query_id"), rows.withColumnRenamed("id", "match_id")
    index = qs.fit_index(lib)
    near = qs.quantised_search(q, lib, 12, 0.85, index).select("query_id", "match_id")
    scored = near.join(q.withColumnRenamed("vector", "qv"), "query_id").join(lib.withColumnRenamed("vector", "lv"), "match_id")
    scored = scored.select("query_id", "match_id", vs.dot(scored["qv"], scored["lv"]).alias("similarity"))
    want = sorted(map(tuple, vs.top_matches(scored, 4).collect()))
    assert sorted(map(tuple, qs.reranked_search(q, lib, 4, 0.85, index).collect())) == want
    # none repeated
    one = lambda df, key: df.where(f"{key} >= 20 and {key} < 250")
    few = sorted(map(tuple, qs.reranked_search(one(q, "query_id"), one(lib, "match_id"), 4, 1.0, index).collect()))
    near = qs.quantised_search(one(q, "query_id"), one(lib, "match_id"), 12, 1.0, index).select("query_id", "match_id")
    scored = near.join(q.withColumnRenamed("vector", "qv"), "query_id").join(lib.withColumnRenamed("vector", "lv"), "match_id")
    assert few == sorted(map(tuple, vs.top_matches(scored.select("query_id", "match_id", vs.dot(scored["qv"], scored["lv"]).alias("similarity")), 4).collect()))


def test_nearest_on_a_line():
    rng = np.random.default_rng(15)
    points, centres = rng.normal(size=(5000, 1)), rng.normal(size=(40, 1))
    centres[30:] = centres[0]
    want = ((points - centres.T) ** 2).argmin(1)
    assert (qs.nearest_of(points, centres) == want).all()
    points[7] = np.nan
    want[7] = 0
    assert (qs.nearest_of(points, centres) == want).all()


@pytest.mark.parametrize("name", ["jon_09_recall", "jon_10_recall"])
def test_recall_over_many_blocks(spark, sf, monkeypatch, name):
    """both searches leave every part of the library with the best rows of a query, however many blocks it has."""
    want, one_block = rows_before_the_cut(monkeypatch, name, spark, sf)
    monkeypatch.setattr(vs, "QUERY_BLOCK", 150)
    monkeypatch.setattr(vs, "LIBRARY_BLOCK", 30)
    got, left = rows_before_the_cut(monkeypatch, name, spark, sf)
    assert got == want == [(2500, True)]
    assert left <= vs.LIBRARY_PARTS * one_block
