"""URL filters, top-k search and archives against brute force, with the awkward cases."""

import hashlib
import random

from pyspark.sql import functions as F

from plumbline.llm.topk import top_k
from plumbline.llm.url_filters import judge_urls
from plumbline.llm.warc import build_index, capture_key, look_up, parse, read_records, record, write_archives
from tests.llm.cases import frame

URLS = [
    None, "", "no scheme", "http://", "http://A.B.org/x?y", "https://b.org", "http://b.org/x/y/z#f", "http://xb.org/x/y", "ftp://b.org/x/yy", "http://c.b.org/x",
    "http://org/", "http://b.org?x/y", "http://b.org/x\n/y", "http://u@b.org:80/x", "http://b..org/x", "http://é.b.org/x/é", "http://b.org/x/y", "http://b.org/x/y",
]


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def judged(url, rules):
    rest = (url or "").partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    host = lower(host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None, key=lambda f: f[:2] + (f[3],))
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    rnd = random.Random(1)
    hosts, paths = ["org", "b.org", "a.b.org", "c.b.org", "com", "x.com"], ["/", "/x", "/x/y", "/x/y/z", "/é", ""]
    rules = list({(h, p): v for h, p, v in [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(20)]}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = URLS + [f"http://{rnd.choice(['', 'a.', 'q.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', 'x', '/y', '?q'])}" for _ in range(300)]
    pages = frame(spark, list(enumerate(urls)), "page_id long, url string")
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), run_rows=3)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_url_cases(spark):
    pages = frame(spark, [(None, "http://b.org/x"), (1, "http://b.org/x"), (1, "http://b.org/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("b.org", "/x", "allow"), ("B.org", "/x", "block")], "host string, path string, verdict string")
    rows = judge_urls(pages, rules).collect()
    assert len(rows) == 4 and sum(r["verdict"] == "block" for r in rows) == 3
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def brute_top(rows, k, asked):
    out = []
    for q, x in rows:
        if not asked(q):
            continue
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4 if i % 9 else 3)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)] + [(2000, [1e9] * 4), (2001, [-1e9] * 4)]
    odd = [(3000, None), (3001, []), (3002, [1.0, None, 0.0, 0.0]), (3003, [float("nan")] * 4), (3004, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    vectors = frame(spark, rows + odd, "vec_id long, embedding array<double>")
    whole = [(i, [int(x * 256 // 1) for x in v]) for i, v in rows]
    got = top_k(vectors, F.col("vec_id") % 10 == 0, k=5, tile_rows=32)
    assert sorted(map(tuple, got.collect())) == brute_top(whole, 5, lambda q: q % 10 == 0)


def test_top_k_cases(spark):
    few = frame(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(few, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 1, 256 * 512)]
    assert top_k(few.limit(0), F.col("vec_id") == 0).count() == 0
    huge = frame(spark, [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


BIG = "<html>" + "é" * 600 + "</html>"
PAGES = [
    (1, "http://a.org/1", BIG), (2, "http://a.org/2", BIG), (3, "http://b.a.org/", BIG), (4, None, "small"), (5, "http://a.org/ x\r\ny", "small"), (6, "http://c.org/", None),
    (7, "", ""), (8, "http://a.org/1", "z" * 1000), (9, "http://a.org/1", "z" * 1000), (9, "http://a.org/1", "z" * 1000), (None, "http://d.org/", BIG), (10, "http://é.org/ü", "\r\n\r\nx"),
]


def test_archives_round_trip(spark, tmp_path):
    pages = frame(spark, PAGES, "page_id long, url string, html string")
    folder = tmp_path.as_uri()
    captures = write_archives(pages, f"{folder}/archive", archive_bytes=500)
    shards = build_index(captures, f"{folder}/index", block_rows=2)
    found = look_up(pages.select(capture_key().alias("key")), shards, f"{folder}/index")
    rows = read_records(found, f"{folder}/archive").collect()
    assert len(rows) == len(PAGES)
    data = lambda h: (h or "").encode()
    want = []
    for i, _, h in PAGES:
        same = [j for j, _, g in PAGES if data(g) == data(h) and len(data(h)) >= 1000]
        last = max((j for j in same if j is not None), default=None)
        again = len(same) > 1 and i != last
        want.append((i, "revisit" if again else "response", hashlib.sha1(data(h)).hexdigest(), last if again else None, None if again else data(h)))
    got = [(r["page_id"], r["record_type"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = look_up(spark.createDataFrame([("nothing)/ 0",), ("~",), ("",)], "key string"), shards, f"{folder}/index")
    assert none.count() == 0


def test_archives_of_nothing(spark, tmp_path):
    pages = frame(spark, [], "page_id long, url string, html string")
    folder = tmp_path.as_uri()
    shards = build_index(write_archives(pages, f"{folder}/archive"), f"{folder}/index")
    assert look_up(pages.select(capture_key().alias("key")), shards, f"{folder}/index").count() == 0


def test_record_is_one_member():
    member = record(3, "http://a.org/ b", b"x\r\n\r\ny", hashlib.sha1(b"x\r\n\r\ny").hexdigest(), None, 6)
    assert parse(member)[0] == 3 and parse(member)[5] == b"x\r\n\r\ny" and parse(member)[4] == "http://a.org/%20b"
