"""Conversation repair, centroid clustering and language identification against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.clusters import cluster, nearest, op12_centroid_clusters, transformed, walsh, with_inertia
from plumbline.llm.common import table
from plumbline.llm.conversations import damaged, op11_conversation_repair, repair
from plumbline.llm.languages import ContextTrees, held_out, identify, learn, op13_language_id
from tests.llm.cases import docs, empty_docs, frame

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """Rows (conv_id, turn, role, text) after the planted damage, in order."""
    out = []
    for cid, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (cid, turn))
        fate = zlib.crc32(key.encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(cid, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit: rows are (role, text, doomed, truncated)."""
    memo = {}

    def rest(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        options = []
        if i == len(rows) and state in "_a":
            options.append((0, "", ()))
        follow = {"_": "su", "s": "u", "u": "a", "a": "u"}[state]
        forced = {"u": "user", "a": "assistant"}
        for role in "ua":
            if role in follow and inserts < 3:
                c, a, r = rest(i, role, inserts + 1)
                options.append((c + 3, "I" + a, ((forced[role], ""), *r)))
        if i < len(rows):
            role, text, doomed, truncated = rows[i]
            c, a, r = rest(i + 1, state, 0)
            options.append((c + 4, "D" + a, r))
            if not doomed:
                extra = 3 if truncated else 0
                if role[:1] and role[:1] in follow:
                    c, a, r = rest(i + 1, role[:1], 0)
                    options.append((c + extra, "K" + a, ((role, text), *r)))
                for to in "ua":
                    if to in follow:
                        c, a, r = rest(i + 1, to, 0)
                        options.append((c + extra + 3, "R" + a, ((forced[to], text), *r)))
        memo[i, state, inserts] = min(options, default=(math.inf, "", ()))
        return memo[i, state, inserts]

    return rest(0, "_", 0)


def expected(rows, damaging=True):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows) if damaging else [(*r[:2], *(" " if x is None else x for x in r[2:])) for r in rows]:
        groups[r[0]].append(r[1:])
    out = {}
    for cid, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{len(r[2])}:{r[2]}".encode()).hexdigest()))
        seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            stripped = text.strip(BLANK)
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit, repaired = cheapest(marked)
        out[cid] = {
            "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **faults,
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()}
    return out


def summaries(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def odd_conversations(seed=5):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "", None, "tool", "sys", "ümlaut"]
    texts = ["Hi.", "Yes!", "What?", "no end", "", " \t", None, "Hi.", "été.", "Done. \n", "日本語。", "a\nb."]
    rows = []
    for cid in [*range(60), None, 2**60 + 1]:
        turn = rnd.choice([0, 5])
        for _ in range(rnd.randint(1, 9)):
            rows.append((cid, None if rnd.random() < 0.1 else turn, rnd.choice(roles), rnd.choice(texts)))
            turn += rnd.choice([0, 1, 1, 1, 2])
    return rows + rows[:3]


def test_conversations_against_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert summaries(op11_conversation_repair(spark, sf)) == expected(rows)
    rows = odd_conversations()
    odd = frame(spark, rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert summaries(repair(damaged(odd), turns=False)) == expected(rows)


def test_repaired_turns(spark):
    rows = odd_conversations(6)
    wanted = expected(rows, damaging=False)
    out = repair(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    assert summaries(spark.createDataFrame([r for r in out if r["edit"] is None], repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).schema).drop("position", "edit", "role", "text")) == wanted
    for cid, want in wanted.items():
        edits = sorted((r["position"], r["edit"], r["role"], r["text"]) for r in out if r["conv_id"] == cid and r["edit"])
        assert "".join(e[1] for e in edits) == want["audit"]
        kept = [f"{role}:{text}" for _, edit, role, text in edits if edit != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == want["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(k[:1] for k in kept))


def test_conversation_cases(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair(frame(spark, [], schema)).count() == 0
    gone = spark.createDataFrame([(7, 1, "user", "Hi.", False)], schema + ", present boolean")
    assert summaries(repair(gone, turns=False)) == {7: {
        "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}


def test_giant_conversation_spans_batches(spark):
    """One conversation of many Arrow batches, with repeated turns far apart and one very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        n = 6001
        rows = spark.range(n).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
            F.concat(F.when(F.col("id") % 3000 == 10, "again").otherwise(F.col("id").cast("string")), F.when(F.col("id") == 77, F.repeat(F.lit("x"), 3_000_000)).otherwise(""), F.lit(".")).alias("text"))
        r = repair(rows, turns=False).collect()
        assert len(r) == 1 and (r[0]["duplicate"], r[0]["illegal"], r[0]["truncated"]) == (1, 0, 0)
        # the repeated user turn goes and its place is filled; the last user turn gets an answer
        assert r[0]["cost"] == 4 + 3 + 3 and r[0]["audit"] == "K" * 3010 + "DI" + "K" * 2990 + "I"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def kmeans(rows, k=8, rounds=10, seed=3, scale=1024):
    """{vec_id: [(cluster, distance), ...]} and the centroids, in plain Python."""
    kept = []
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(assign(v)[1], []).append(v)
        cents = [[sum(c) // len(own[j]) for c in zip(*own[j])] if j in own else old for j, old in enumerate(cents)]
    return [(i, *assign(v)[::-1]) for i, v in kept], cents


def test_op12_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want, cents = kmeans(rows)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    per = {j: sum(d for _, c, d in want if c == j) for j in range(len(cents))}
    got = op12_centroid_clusters(spark, sf).collect()
    assert sorted(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in got) == sorted(
        (i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in want)


def test_cluster_cases(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25]) for _ in range(64)]) for i in range(40)]
    rows += [(1, rows[0][1]), (1, rows[1][1]), (None, rows[2][1]), (50, None), (51, [0.1] * 63), (52, [0.1] * 65), (53, []), (54, [None] + [0.0] * 63),
             (55, [float("nan")] + [0.0] * 63), (56, [0.0] * 63 + [float("inf")]), (57, [1e300] + [0.0] * 63), (58, [3e6] + [0.0] * 63), (59, [-3e6] + [0.5] * 63)]
    df = frame(spark, rows, "vec_id long, embedding array<double>").repartition(3)
    want, _ = kmeans([r for r in rows if r[0] != 57])
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance")) for r in cluster(df).collect()]
    assert sorted(got) == sorted(want)
    assert with_inertia(cluster(df)).select("inertia").distinct().collect()[0][0] == sum(d for _, _, d in want)
    few = cluster(df.where("vec_id IN (3, 4)"))
    assert sorted(r["cluster"] for r in few.collect()) == [0, 1]
    assert with_inertia(cluster(df.limit(0))).count() == 0
    huge = with_inertia(cluster(spark.createDataFrame([(i, [(-1.0) ** i * 8e15] * 64) for i in range(3)], "vec_id long, embedding array<double>"), k=1)).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in huge} == {(0, None, None)}


@pytest.mark.parametrize("reach", [3, 1000, 1 << 23, 1 << 40])
def test_progressive_search_is_exact(reach):
    rng = np.random.default_rng(reach)
    v, c = rng.integers(-reach, reach, (300, 64)), rng.integers(-reach, reach, (8, 64))
    c[5] = c[2]
    v[:20] = c[rng.integers(0, 8, 20)]
    d = ((v[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(2)
    best, distance = nearest(v, c)
    assert best.tolist() == [min((x, j) for j, x in enumerate(r))[1] for r in d.tolist()]
    assert [int(x) for x in distance] == [min(r) for r in d.tolist()]
    h = walsh(64)
    assert (h @ h.T == 64 * np.eye(64)).all() and [(np.diff(r) != 0).sum() for r in h] == list(range(64))
    assert (transformed(v, h) == v @ h.T).all()


def plain_ppm(counted, text, order, kept, alphabet):
    """Bits of a text by the definition: counted[context][byte], contexts as bytes with -1 for the edge."""
    def chances(context):
        if context == ():
            shorter = {b: 1 / 256 for b in range(256)}
        else:
            shorter = chances(context[1:])
        own = counted.get(context)
        if not own or (context and context not in kept):
            return shorter
        n, q = sum(own.values()), len(own)
        left = sum(p for b, p in shorter.items() if b not in own)
        whole = n + (q if left > 0 else 0)
        return {b: own[b] / whole if b in own else q / whole * p / left for b, p in shorter.items()}

    bits, padded = 0.0, (-1,) * order + tuple(text)
    for i, b in enumerate(text):
        context = padded[i:i + order]
        # the longest kept run of contexts; walking stops at the first that is missing
        depth = 0
        while depth < order and context[order - depth - 1:] in kept:
            depth += 1
        bits -= math.log2(chances(context[order - depth:])[b])
    return bits


def test_code_lengths_by_definition():
    order, rnd = 3, random.Random(2)
    texts = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"banana bandana", b"an ban"]}
    counted, grams, owners, counts = {k: {} for k in texts}, [], [], []
    for j, (lang, own) in enumerate(texts.items()):
        tally = {}
        for t in own:
            padded = (-1,) * order + tuple(t)
            for i, b in enumerate(t):
                window = padded[i:i + order + 1]
                tally[window] = tally.get(window, 0) + 1
                for d in range(order + 1):
                    counted[lang].setdefault(window[order - d:order], {}).setdefault(b, 0)
                    counted[lang][window[order - d:order]][b] += 1
        for window, n in tally.items():
            code = 0
            for s in window:
                code = code << 9 | (s + 1)
            grams.append(code)
            owners.append(j)
            counts.append(n)
    total = {}
    for lang in texts:
        for c, own in counted[lang].items():
            total[c] = total.get(c, 0) + sum(own.values())
    kept = {c for c, n in total.items() if c and n >= 2}
    trees = ContextTrees(list(texts), order, np.array(grams), np.array(owners), np.array(counts), 2, 10**6)
    samples = [b"", b"abra", b"banana", b"xyz\xff", bytes(rnd.choice(b"abncdr z") for _ in range(300))]
    got = trees.code_lengths(samples) / 65536
    for t, row in zip(samples, got, strict=True):
        for lang, bits in zip(texts, row, strict=True):
            assert abs(bits - plain_ppm(counted[lang], t, order, kept, 256)) < 1e-4 * (len(t) + 1)


def test_pieces_do_not_change_code_lengths(monkeypatch):
    rnd = random.Random(4)
    grams = np.unique([sum(rnd.randrange(1, 257) << 9 * k for k in range(3)) for _ in range(50)])
    trees = ContextTrees(["x", "y"], 2, grams, np.arange(len(grams)) % 2, np.full(len(grams), 3), 1, 1000)
    texts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 0, 700, 3, 0, 2000, 64, 0)]
    whole = trees.code_lengths(texts)
    monkeypatch.setattr("plumbline.llm.languages.PIECE", 64)
    assert (trees.code_lengths(texts) == whole).all()
    assert [trees.code_lengths([t]).tolist()[0] for t in texts] == whole.tolist()


def test_languages_held_out(spark, sf):
    given = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    got = op13_language_id(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    judged = [(r["lang_pred"], given[r["doc_id"]]["lang"]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in judged) >= 0.98 * len(judged)


def test_language_cases(spark, sf):
    train = table(spark, sf, "documents").where(~held_out(F.col("doc_id")))
    trees = learn(train.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "texte", None, "s", 0)], train.schema)))
    assert trees.langs == ["de", "en", "es", "fr"]
    judged = {}
    for r in identify(docs(spark), trees).collect():
        judged.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert judged[6] == judged[7] == judged[8] == judged[15] == [("und", 0.0)]
    assert len(judged[13]) == 2 and len(set(judged[13])) == 1 and len(judged[None]) == 2 and judged[1][0][0] == "en"
    numbers = spark.createDataFrame([(1, "123 456!"), (2, "été 1"), (3, "la " * 400_000)], "doc_id long, text string")
    assert [(r["lang_pred"] == "und") for r in identify(numbers, trees).orderBy("doc_id").collect()] == [True, False, False]
    assert identify(empty_docs(spark), trees).count() == 0
    none = learn(train.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in identify(docs(spark), none).collect()} == {("und", 0.0)}
    # beyond the bound a sample by hash is learnt
    small = learn(train, sample_bytes=20_000)
    assert small.langs == trees.langs
