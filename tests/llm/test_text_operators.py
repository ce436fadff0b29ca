"""Operators on documents against brute force and the public libraries, with the awkward cases."""

import collections
import hashlib
import random
import re
import struct
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import decontamination
from plumbline.llm.common import table
from plumbline.llm.components import components
from plumbline.llm.decontamination import Items, find_items, plain
from plumbline.llm.lines import drop_repeated_lines
from plumbline.llm.minhash import TILE, across, described, near_duplicates, possible, sets_of
from plumbline.llm.sentencepieces import PieceTransducer, encode_documents, fields
from plumbline.llm.suffixes import without_repeats
from plumbline.llm.token_counts import RankMerger, count_tokens
from plumbline.llm.toxicity import HELD_OUT, Scorer, fit, fold, score_toxicity
from tests.llm.cases import DOCS, NUMBERED, docs, empty_docs, frame

WORD_BPE, PIECE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rnd = random.Random(7)
    fixed = ["", "aaaaaaaaaa aaa", "I'll DON'T ΣΑΣ Σ İ é é 한글 日本語 ▁x ▁▁ a▁b 🎉", "  many    blanks \t\n x", "\x00\x7f", "x" * 800, "<s></s><unk> <0x41>", "<|endoftext|>a<|startoftext|>", "   ", "½ ² 12345"]
    letters = [*range(32, 127), *range(160, 0x250), *range(0x370, 0x400), *range(0x4E00, 0x4E40), 10, 32, 32]
    return fixed + ["".join(chr(rnd.choice(letters)) for _ in range(rnd.randint(1, 60))) for _ in range(400)] + ["".join(rnd.choice("abth er in▁ ") for _ in range(50)) for _ in range(200)]


def test_token_counts_are_the_librarys():
    texts = odd_texts()
    library = Tokenizer.from_file(WORD_BPE)
    assert RankMerger(WORD_BPE).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op6_query(spark, sf):
    from plumbline.llm.token_counts import op6_token_counts

    library = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in op6_token_counts(spark, sf).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 2048)


def test_token_count_cases(spark):
    rows = count_tokens(docs(spark), WORD_BPE).collect()
    assert len(rows) == len(DOCS)
    assert [(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (6, 7)] == [(0, 0), (0, 0)]
    assert count_tokens(empty_docs(spark), WORD_BPE).count() == 0


def test_pieces_are_the_librarys():
    library, ours, texts = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), PieceTransducer(PIECE_BPE), odd_texts()
    ids = ours.encode(texts)
    assert ids == library.encode(texts)
    assert [ours.decode(x) for x in ids] == [library.decode(x) for x in ids]
    assert all(ours.decode(x) == t.replace("▁", " ") for t, x in zip(texts, ids, strict=True))


def message(*parts):
    """A protocol-buffer message from (number, value) parts."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for key, value in parts:
        if isinstance(value, float):
            out += number(key << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(key << 3) + number(value)
        else:
            out += number(key << 3 | 2) + number(len(value)) + value
    return out


def character_map(entries):
    """The model file's form of a map: a double array, here with one block of 256 units a node, and the replacements."""
    pool, starts = b"", {}
    for source, target in entries.items():
        starts[source.encode()] = len(pool)
        pool += target.encode() + b"\0"
    nodes = sorted({k[:n] for k in starts for n in range(len(k) + 1)})
    block = {name: 256 * (1 + k) for k, name in enumerate(nodes)}
    units = [1 << 31] * (256 * (1 + len(nodes)))  # a label no byte has
    for name in nodes:
        at = block[name[:-1]] ^ name[-1] if name else 0
        units[at] = (at ^ block[name]) << 10 | (name in starts) << 8 | (name[-1] if name else 0)
        if name in starts:
            units[block[name]] = 1 << 31 | starts[name]
    raw = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(raw)) + raw + pool


CHARACTERS = {"½": "1/2", "²": "2", "İ": "i", "\t": " ", "\n": " ", "é": "e", "e\u0301": "e", "ab": "ba", "abt": "T", "\x7f": "", "¨": " x", "한": "글글"}


def piece_model(path, kind, characters, squeeze, prefix=1, bytewise=True):
    """A vocabulary file: the given merge vocabulary, or unigram pieces with scores of which many are equal."""
    rules = message((1, b"own"), (2, character_map(CHARACTERS) if characters else b""), (3, prefix), (4, int(squeeze)), (5, 1))
    if kind == 2:
        with open(PIECE_BPE, "rb") as f:
            parts = [(n, rules if n == 3 else v) for n, v in fields(f.read())]
    else:
        rnd = random.Random(3)
        units = ["▁", "▁the", "in▁a", "th", "er", "a", "b", "e", "t", "h", "r", "i", "n", "▁a", "▁▁", "1", "2", "/", "12", "aaa", "日本", "x" * 7, "T"]
        units = list(dict.fromkeys(units + ["".join(rnd.choice("abtherin▁") for _ in range(rnd.randint(2, 4))) for _ in range(300)]))
        parts = [(1, message((1, b"<unk>"), (2, 0.0), (3, 2))), (1, message((1, b"<s>"), (2, 0.0), (3, 3)))]
        parts += [(1, message((1, b"<0x%02X>" % k), (2, 0.0), (3, 6))) for k in range(256) if bytewise]
        parts += [(1, message((1, u.encode()), (2, -float(rnd.choice([1, 2, 3, 4]) * len(u) + rnd.choice([0, 0.25, rnd.random()]))), (3, 1))) for u in units]
        parts += [(2, message((3, 1), (35, int(bytewise)))), (3, rules)]
    with open(path, "wb") as f:
        f.write(message(*parts))
    return str(path)


@pytest.mark.parametrize("case", [
    (1, False, False), (1, True, True), (1, True, False, 0), (1, False, True, 0, False), (1, True, True, 1, False), (2, True, False), (2, True, True), (2, False, True, 0)])
def test_vocabularies_of_all_kinds_are_the_librarys(tmp_path, case):
    path = piece_model(tmp_path / "own.model", *case)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), PieceTransducer(path)
    texts = odd_texts() + ["abtab ab", "¨ ¨a", " ▁ ", "ab" * 300 + " the in a" * 400, "zz日本zz zz"]
    ids = ours.encode([*texts, None])
    assert ids.pop() == []
    assert ids == library.encode(texts)
    assert [ours.decode(x) for x in ids] == [library.decode(x) for x in ids]


def test_op8_query(spark, sf):
    from plumbline.llm.sentencepieces import op8_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in op8_sentencepiece(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_pieces"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_piece_cases(spark):
    rows = encode_documents(docs(spark), PIECE_BPE).collect()
    assert len(rows) == len(DOCS) and [r["ids"] for r in rows if r["doc_id"] in (6, 7)] == [[], []]
    assert encode_documents(empty_docs(spark), PIECE_BPE).count() == 0


def test_lines_against_brute_force(spark):
    rnd = random.Random(2)
    pool = ["A rather long line that repeats", "  a rather LONG line that repeats\t", "short", "another line of enough characters é", ""]
    rows = [(i, "\n".join(rnd.choice([*pool, f"line number {rnd.randint(0, 9999)} is unique"]) for _ in range(rnd.randint(0, 8)))) for i in range(60)]
    rows += [(None, pool[0]), (61, None), (61, None)]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -1 if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(low(i))
    out = {}
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and low(i) != max(held[key(x)]))]
        out[i] = (len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept))
    got = drop_repeated_lines(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == out
    assert drop_repeated_lines(empty_docs(spark)).count() == 0


def shingles(text):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    """Chains and groups of near copies around the bound, and documents that only share a passage."""
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.randint(1, 9)):
            copy = list(base)
            for _ in range(rnd.randint(0, 1 + len(base) // 40)):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randint(0, 9999)}"
            rows.append(" ".join(copy))
            if g % 3 == 0:
                base = copy
    passage = [f"p{k}" for k in range(30)]
    rows += [" ".join([f"q{k}_{j}" for j in range(30)] + passage) for k in range(25)]
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_minhash_against_brute_force(spark):
    rows = near_copies() + [r for r in DOCS if r[0] is None] + [(9003, None), (9004, ""), (9005, " \t\n")] + [(9001, "one two"), (9002, "ONE  two")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(i for i in sets if sets[i])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert len({find(i) for i in ids}) < len(ids)


def test_minhash_cases(spark):
    rows = near_duplicates(docs(spark)).collect()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(DOCS) and found[2] == 1 and found[5] == 4 and found[13] == 4 and found[10] == 9 and found[6] == 6 and found[8] == 8
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(None, 5), (7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted((i, find(i)) for i in root)


@pytest.mark.parametrize(("size", "keep_first"), [(200, False), (30, True), (8, False)])
def test_suffixes_against_brute_force(spark, size, keep_first):
    rnd = random.Random(size)
    passages = ["".join(rnd.choice("abcdefgh é\n") for _ in range(rnd.randint(size // 2, 3 * size))) for _ in range(6)]
    rows = [(i, "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcxyz ") for _ in range(rnd.randint(0, size)))]) for _ in range(rnd.randint(0, 6)))) for i in range(50)]
    rows += [(100, "a" * (3 * size)), (101, "ab" * size), (102, None), (103, ""), (None, passages[0])]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen = collections.defaultdict(list)
    for k, (_, t) in enumerate(ordered):
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            seen[b[s : s + size]].append((k, s))
    want = {}
    for k, (i, t) in enumerate(ordered):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            places = seen[b[s : s + size]]
            if len(places) > 1 and not (keep_first and places[0] == (k, s)):
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    got = without_repeats(docs(spark, rows), min_bytes=size, keep_first=keep_first).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got} == want


def test_suffix_cases(spark):
    rows = without_repeats(docs(spark), min_bytes=100, keep_first=False).collect()
    assert len(rows) == len(DOCS) and all(r["n_removed"] == r["n_bytes"] for r in rows if r["doc_id"] == 13)
    assert without_repeats(empty_docs(spark)).count() == 0


def test_op7_query(spark, sf):
    from plumbline.llm.suffixes import op7_suffix_dedup

    texts = [(r["doc_id"], r["text"].encode()) for r in table(spark, sf, "documents").collect()]
    seen = collections.Counter(b[s : s + 200] for _, b in texts for s in range(len(b) - 199))
    want = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in op7_suffix_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want


def distance(item, text):
    """Least edits between an item and any substring of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, x in enumerate(text, 1):
            now.append(min(row[j - 1] + (c != x), row[j] + 1, now[-1] + 1))
        row = now
    return min(row)


def test_items_against_brute_force(spark, sf):
    rnd = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").orderBy("item_id").limit(5).collect()]
    index, texts = Items(items), []
    for _ in range(30):
        s = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, len(s) // 10)):
            k = rnd.randrange(len(s))
            s[k : k + 1] = rnd.choice(["", "x", s[k] + "y"])
        texts.append("before " * rnd.randint(0, 5) + "".join(s) + " after" * rnd.randint(0, 5))
    got = {r["doc_id"]: {f["item_id"]: f["edits"] for f in r["found"]} for r in find_items(docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        near = {item: distance(plain(x), plain(t)) for item, x in items}
        assert got[i] == {item: d for (item, d), e in zip(near.items(), index.edits, strict=True) if d <= e}
    assert any(got.values()) and not all(len(g) for g in got.values())


def test_item_cases(spark):
    items = frame(spark, [(1, NUMBERED), (2, None), (3, "short"), (None, NUMBERED), (4, NUMBERED.upper())], "item_id long, text string")
    rows = find_items(docs(spark), items).collect()
    assert len(rows) == len(DOCS) and all({f["item_id"] for f in r["found"]} == ({1, 4, None} if r["doc_id"] in (4, 5, 13) else set()) for r in rows)
    in_blocks = find_items(docs(spark), items, block_chars=300).collect()
    assert [sorted(map(str, r["found"])) for r in in_blocks] == [sorted(map(str, r["found"])) for r in rows]
    long = [(1, "y" * 600_000 + " " + NUMBERED + " " + "z" * 600_000)]
    assert [f["start"] for f in find_items(docs(spark, long), items.where("item_id = 1")).first()["found"]] == [600_001]
    assert find_items(empty_docs(spark), items).count() == 0 and find_items(docs(spark), items.limit(0)).where(F.size("found") > 0).count() == 0


def test_op1_query(spark, sf):
    from plumbline.llm.decontamination import op1_decontamination

    items = [(r["item_id"], plain(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    texts = [(r["doc_id"], plain(r["text"])) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]
    # all texts in one row of the edit-distance table, with more borders between them than edits are allowed
    lens = np.array([len(t) + 200 for _, t in texts])
    begins = np.cumsum(lens) - lens
    joined = np.array([ord(c) for _, t in texts for c in t + "\0" * 200], np.int32)
    want = {i: {} for i, _ in texts}
    for item, text in items:
        if len(text) < 10:
            continue
        most = min(int(len(text) * 0.08), (len(text) - 10) // 10)
        row, step = np.zeros(len(joined) + 1, np.int32), np.arange(len(joined) + 1, dtype=np.int32)
        for i, c in enumerate(text, 1):
            now = row + 1
            np.minimum(now[1:], row[:-1] + (joined != ord(c)), out=now[1:])
            row = np.minimum.accumulate(now - step) + step
        for (doc, _), edits in zip(texts, np.minimum.reduceat(row[1:], begins), strict=True):
            if edits <= most:
                want[doc][item] = int(edits)
    got = {r["doc_id"]: r for r in op1_decontamination(spark, sf).collect()}
    assert len(got) == len(texts) and any(want.values())
    for doc, found in want.items():
        r = got[doc]
        assert (r["contaminated"], r["item_ids"], r["least_edits"]) == (bool(found), sorted(found), min(found.values(), default=None)), doc


def test_repetitive_text_in_bounded_memory():
    """What is held follows neither how often a text repeats an item's q-grams nor where the runs of counting end."""
    index = Items([(1, "a" * 1000), (2, "a" * 990 + "bcd" * 10), (3, "abc" * 60)])
    text = "a" * 20_000 + "abc" * 200
    tracemalloc.start()
    found = index.search([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000
    assert found[0][0] == (1, 0, 1000, 0) and [f[0] for f in found[0]] == [1, 2, 3]


def test_counting_in_short_runs(monkeypatch):
    rnd = random.Random(12)
    items = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(12, 90)))) for i in range(12)]
    texts = ["".join(rnd.choice("ab ") for _ in range(400)) + items[k % 12][1] + "b" * k for k in range(20)]
    whole = Items(items).search(texts)
    monkeypatch.setattr(decontamination, "ENTRIES", 40)
    monkeypatch.setattr(decontamination, "CELLS", 100)
    assert Items(items).search(texts) == whole and all(whole)


def test_near_duplicates_of_an_id_with_two_texts(spark):
    """All rows of an id get one component, also blank ones and those whose text no other document has."""
    other = " ".join(f"other{k}" for k in range(60))
    rows = [(1, NUMBERED), (2, other), (2, NUMBERED), (3, other + " more"), (4, "all by itself here"), (5, NUMBERED), (5, "")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, rows)).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 1, False)]


def test_near_duplicates_of_an_id_that_heads_two_classes(spark):
    """Either text of the smallest id links, whichever of its rows is met first."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(1, one), (1, two), (1, one), (2, one + " more"), (3, two + " more"), (4, two + " more words")]
    got = near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_tiles_hold_only_possible_partners(spark):
    """Unlike documents that share a template under one key bring their sets to no tile, and no link between them is lost."""
    template = [f"t{k}" for k in range(60)]
    own = [[f"d{i}_{k}" for k in range(90)] for i in range(1000)]
    rows = [(i, " ".join(template + w)) for i, w in enumerate(own)]
    near = [(7, 700), (8, 800), (512, 999)]
    rows = [(i, rows[dict((b, a) for a, b in near)[i]][1] + " end" if i in [b for _, b in near] else t) for i, t in rows]
    frame = docs(spark, rows)
    told = described(frame)
    briefs = told.select(F.col("doc_id").alias("id"), "n", "brief")
    placed = told.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("id"), F.col("doc_id").alias("c"), F.lit(0).cast("long").alias("main"))
    tiles = possible(placed, briefs, 75)
    linked = {i for pair in near for i in pair}
    assert {r["id"] for r in tiles.collect()} == linked
    # every document was in four tiles on either side before; now the six stand once on each side
    assert tiles.count() == 2 * len(linked) and 2 * len(rows) * -(-len(rows) // TILE) == 8000
    found = across(tiles, sets_of(frame, briefs.select("id")), 75).collect()
    assert {tuple(sorted(r)) for r in found} == set(near)


def test_near_duplicates_hot_group_with_outsiders(spark):
    """A large group of near copies, and documents that share bands with it but only link with each other."""
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base + [f"tail{i}"])) for i in range(400)]
    for g in range(20):
        half = base[:140] + [f"o{g}_{k}" for k in range(60)]
        rows += [(1000 + 10 * g + k, " ".join(half + [f"x{k}"])) for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: 0 if i < 1000 else i - i % 10 for i, _ in rows}


def test_toxicity_held_out_accuracy(spark, sf):
    """Texts with planted words are told from others by their held-out labels."""
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in ("ba", "ro", "ti", "mel", "su") for b in ("ran", "dol", "ki", "ment", "sa", "vor", "lin", "tu")]
    rows = []
    for i in range(900):
        t = [rnd.choice(words) for _ in range(rnd.randint(10, 80))]
        bad = i % 6 == 0
        for _ in range(rnd.randint(1, 3) if bad else 0):
            t[rnd.randrange(len(t))] = rnd.choice(["nastyword", "vileinsult", "awfulslur"])
        rows.append((i, " ".join(t), int(bad)))
    frame_ = docs(spark, [(i, t) for i, t, _ in rows])
    labels = frame(spark, [(i, y) for i, _, y in rows] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    model = fit(frame_, labels)
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(frame_, model).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.97 * len(rows)
    odd = score_toxicity(docs(spark), model).collect()
    assert len(odd) == len(DOCS) and all(0 <= r["score"] <= 1 for r in odd) and not any(r["predicted"] for r in odd if r["doc_id"] in (6, 7, 8))
    assert score_toxicity(empty_docs(spark), model).count() == 0


def test_toxicity_learns_from_few_labels(spark):
    """Which words are telling follows their rates, not how many labels there are."""
    rnd = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ro", "ti", "mel", "su") for b in ("ran", "dol", "ki", "ment", "sa", "vor", "lin", "tu")]
    rows = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(40)]
        for w in ["nastyword", "vileinsult", "awfulslur"] if i % 8 == 0 else []:
            t.insert(rnd.randrange(len(t)), w)
        rows.append((i, " ".join(t), int(i % 8 == 0)))
    frame_ = docs(spark, [(i, t) for i, t, _ in rows])
    model = fit(frame_, frame(spark, [(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(frame_, model).collect()}
    assert all(got[i] for i, _, y in rows if y) and sum(got[i] for i, _, y in rows if not y) <= 5


@pytest.mark.parametrize(("size", "least"), [("sf0.001", {"en": 0.8}), ("sf0.01", {"en": 0.8}), ("sf0.1", {"en": 0.8, "de": 0.8, "fr": 0.8})])
def test_toxicity_held_out_recall_by_language(spark, size, least):
    """Each language has toxic words of its own; few labels suffice for the ten plain insults of English."""
    given = f"/root/testdata/{size}"
    documents, labels = table(spark, given, "documents"), table(spark, given, "labels")
    held = documents.join(labels, "doc_id").where(fold() == HELD_OUT)
    rows = score_toxicity(held, fit(documents, labels), keep=("lang", "toxic")).collect()
    for lang, share in least.items():
        found = [r["predicted"] for r in rows if r["lang"] == lang and r["toxic"]]
        assert found and sum(found) >= share * len(found), lang
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(clean) <= 0.05 * len(clean)


def test_toxicity_without_labels(spark):
    model = fit(docs(spark), frame(spark, [], "doc_id long, toxic int"))
    assert {r["predicted"] for r in score_toxicity(docs(spark), model).collect()} == {0}
    only_toxic = fit(docs(spark), frame(spark, [(k, 1) for k in range(1, 17)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in score_toxicity(docs(spark), only_toxic).collect()} == {0}


def without_lines(rows):
    """{id: text} less the lines that a larger id keeps, by definition."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -1 if i is None else i
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(low(i))
    return [(i, "\n".join(x for x in (t or "").split("\n") if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and low(i) != max(held[key(x)])))) for i, t in rows]


def near_groups(rows):
    """Sets of ids that are linked by near copies, by definition."""
    groups = []
    for i, t in rows:
        mine = shingles(t)
        near = [g for g in groups if i is not None and any(j == i or mine and s and 100 * len(mine & s) >= 75 * len(mine | s) for j, s in g)]
        if i is not None:
            groups = [g for g in groups if g not in near] + [sum(near, []) + [(i, mine)]]
    return [{j for j, _ in g} for g in groups]


def test_pipeline_stages(spark, sf):
    """Every stage against a plain version on its own input, row by row: toxic texts, lines, near copies, passages, null ids."""
    import corpus_pipeline

    given = table(spark, sf, "documents").collect()
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").collect() if r["toxic"]}
    item = table(spark, sf, "benchmark").first()["text"]
    line = "a line of some length that many documents hold"
    rows = [(r["doc_id"], r["text"]) for r in given] + [(i + 10_000 if i is not None else None, t) for i, t in DOCS]
    rows += [(20_000 + k, f"{NUMBERED[: 40 + k]} {k}\n{line}\n" + " ".join(f"own{k}_{j}" for j in range(40))) for k in range(4)]
    # near copies around a line that also stands elsewhere
    rows += [(20_010, NUMBERED + " x1\n" + line), (20_011, " ".join(f"left{k}" for k in range(30)) + " before " + item + " after")]
    now = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda out: sorted(out, key=repr)
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        out = stage(spark, now, sf)
        assert stage(spark, now.limit(0), sf).count() == 0
        after = out.collect()
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
            assert order((r["doc_id"], r["ids"], r["n_tokens"], r["decoded"]) for r in after) == order(
                (i, library.encode(t or ""), len(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in before)
            break
        assert out.dtypes == now.dtypes
        if name == "toxicity":
            model = fit(now, table(spark, sf, "labels"))
            scorer = Scorer(model.ordinary, model.toxic)
            want = [(i, t) for i, t in before if model.chances[scorer.evidence(t)] < 0.3]
            assert {i for i, _ in before} - {i for i, _ in want} & toxic
        elif name == "line dedup":
            want = without_lines(before)
            assert want != before
        elif name == "near dedup":
            groups = near_groups(before)
            want = [(i, t) for i, t in before if i is None or any(i == max(g) for g in groups)]
            assert len(want) < len(before)
        else:
            want = [(i, t) for i, t in before if i != 20_011 and not any(plain(r["text"]) in plain(t) for r in table(spark, sf, "benchmark").collect())]
            assert 20_011 in {i for i, _ in before}
            # edited passages may go as well, nothing else
            assert all(i in {r["doc_id"] for r in given} for i, _ in set(want) - {(r["doc_id"], r["text"]) for r in after})
            want = [x for x in want if x in {(r["doc_id"], r["text"]) for r in after}]
        assert order((r["doc_id"], r["text"]) for r in after) == order(want), name
        assert name != "line dedup" or all(r["n_chars"] == len(r["text"]) for r in after)
        now = spark.createDataFrame(after, now.schema)


def test_no_line_is_lost_between_the_stages(spark, sf):
    """Of near copies and strangers that share lines, every shared line stays somewhere."""
    import corpus_pipeline

    rnd = random.Random(8)
    shared = [f"shared line number {k} of enough characters" for k in range(6)]
    rows = []
    for g in range(8):
        base = " ".join(f"g{g}w{k}" for k in range(80))
        lines = rnd.sample(shared, 2)
        rows += [(rnd.randrange(10**6), "\n".join([base + f" end{c}", *lines])) for c in range(rnd.randint(1, 4))]
    rows += [(7, shared[0])]
    now = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        now = stage(spark, now, sf)
    left = {x for r in now.collect() for x in r["text"].split("\n")}
    assert {x for _, t in rows for x in t.split("\n")} & set(shared) <= left
