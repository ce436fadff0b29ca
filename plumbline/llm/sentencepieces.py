"""SentencePiece encoding and decoding as a shortest path through weighted transducers.

Three machines are composed lazily with each input: the normaliser (the model's own map of longest matches, blanks to the
word mark, a mark in front, surplus blanks away), the lexicon (every piece, and characters outside it by their bytes),
and the weights. A unigram vocabulary weighs a piece by its negative score and a character outside the lexicon by 10
more than the dearest piece; the path is summed in single precision as in the library, so that near ties fall alike.

A merge vocabulary has no such sums, so its third machine is an acceptor of neighbouring pieces. For a merge
vocabulary the weight of two neighbours is 0 if merging their joined text gives just these two, and infinite if not; a
sequence of pieces is the library's encoding exactly if all neighbours have weight 0, because the first merge across a
border of the sequence would also happen in the joined text of the two pieces beside it. So the tropical shortest path
has weight 0 and is unique, also for every prefix, and one live state (the last piece) per position is enough.

No piece has a word mark after another character, so words are paths of their own; their results are kept in bounded
tables, which only save work.

Defined cases: a null or empty text has no pieces and decodes to the empty text; characters outside the lexicon
become byte pieces, or without byte pieces one unknown piece for each run of them (unigram vocabularies; a merge
vocabulary without byte pieces is refused); the word mark itself decodes to a blank, as in the library; long words are handled like others;
repeated rows are encoded alike; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import portions, table
from plumbline.registry import query

MARK = "▁"
KNOWN_WORDS, KNOWN_PAIRS, WORD_CHARS = 300_000, 600_000, 40
BATCH_BYTES = 1_000_000
#: piece ids stay below PIECES, and those of single characters outside the lexicon below PAIR
PIECES, PAIR = 1 << 20, 1 << 22
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, MERGES = 1, 2
UNKNOWN_COST = np.float32(10)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Normaliser:
    """The model's map of longest matches, its rule for surplus blanks, and word marks for blanks."""

    def __init__(self, rules: dict[int, int | bytes]):
        if not rules.get(5, 1):
            raise ValueError("a normaliser that keeps blanks as they are is not handled")
        self.prefix = MARK if rules.get(3, 1) else ""
        self.squeeze = bool(rules.get(4, 1))
        self.arcs = self.compiled(rules.get(2) or b"")
        self.longest = max(map(len, self.arcs), default=0)
        firsts = "".join(sorted({k[0] for k in self.arcs}))
        self.first = re.compile(f"[{re.escape(firsts)}]") if firsts else None

    @staticmethod
    def compiled(blob: bytes) -> dict[str, str]:
        """The map's entries, read level by level from its double array; a unit holds label, leaf flag and offset."""
        if not blob:
            return {}
        size = int.from_bytes(blob[:4], "little")
        units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        pool = blob[4 + size :]

        def below(at: np.ndarray) -> np.ndarray:
            unit = units[at]
            return at ^ ((unit >> 10) << ((unit >> 6) & 8))

        arcs, names, base = {}, [b""], below(np.array([0]))
        labels = np.arange(1, 256)
        while len(base):
            child = base[:, None] ^ labels
            inside = child < len(units)
            row, col = np.nonzero(inside & ((units[np.where(inside, child, 0)] & 0x800000FF) == labels))
            at = child[row, col]
            names = [names[r] + bytes([c + 1]) for r, c in zip(row, col, strict=True)]
            base = below(at)
            for k in np.flatnonzero((units[at] >> 8) & 1):
                start = int(units[base[k]] & 0x7FFFFFFF)
                arcs[names[k].decode()] = pool[start : pool.index(0, start)].decode()
        return arcs

    def mapped(self, text: str) -> Iterator[str]:
        """The text in parts, each the replacement of a longest match or text without one."""
        plain = at = 0
        while found := self.first.search(text, at):
            at = found.start()
            for size in range(min(self.longest, len(text) - at), 0, -1):
                if (other := self.arcs.get(text[at : at + size])) is not None:
                    yield from (text[plain:at], other)
                    plain = at = at + size
                    break
            else:
                at += 1
        yield text[plain:]

    def __call__(self, text: str) -> str:
        if self.first:
            text = "".join(self.mapped(text))
        if self.squeeze:
            text = re.sub("  +", " ", text.strip(" "))
        text = self.prefix + text.replace(" ", MARK) if text else ""
        return text.rstrip(MARK) if self.squeeze else text


class PieceTransducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in parts if k == 2)))
        rules = dict(fields(next(v for k, v in parts if k == 3)))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES) or trainer.get(24):
            raise ValueError("expected a unigram or merge vocabulary with word marks in front")
        self.normal = Normaliser(rules)
        self.bytewise = bool(trainer.get(35))
        if self.kind == MERGES and not self.bytewise:
            raise ValueError("expected byte pieces in a merge vocabulary")
        self.unknown = 0
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.spelling: list[bytes] = []
        for k, piece in enumerate(dict(fields(v)) for n, v in parts if n == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            spelling = b""
            if kind == NORMAL:
                if self.kind == MERGES and MARK in text.lstrip(MARK):
                    raise ValueError("a piece has a word mark inside")
                self.ids[text] = k
                self.scores[text] = struct.unpack("<f", piece.get(2, bytes(4)))[0]
                spelling = text.replace(MARK, " ").encode()
            elif kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = k
                spelling = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown = k
                spelling = " ⁇ ".encode()
            elif kind != CONTROL:
                raise ValueError(f"kind {kind} of piece {text!r} is not handled")
            self.spelling.append(spelling)
        self.names = {k: text for text, k in self.ids.items()}
        # the lexicon read backwards from each position; under "" the piece that is complete
        self.lexicon: dict = {}
        for text, k in self.ids.items():
            node = self.lexicon
            for c in reversed(text):
                node = node.setdefault(c, {})
            node[""] = k
        if self.kind == UNIGRAM:
            # the lexicon read forwards, with the weight beside the complete piece
            self.lexicon = {}
            for text, k in self.ids.items():
                node = self.lexicon
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = (np.float32(self.scores[text]), k)
            self.outside = np.float32(min(self.scores.values(), default=0)) - UNKNOWN_COST
        self.first_byte, self.last_byte = min(self.byte_ids), max(self.byte_ids)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the adjacent pair of highest score, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, pair: int) -> bool:
        """Whether the weight of two neighbours (left * PAIR + right) is 0. Others than pieces are PIECES + character."""
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        left, right = (self.names.get(k) or chr(k - PIECES) for k in divmod(pair, PAIR))
        free = self.pairs[pair] = self.merged(left + right) == [left, right]
        return free

    def paths(self, words: list[str]) -> Iterator[tuple[int, ...]]:
        """The ids along the shortest path of each word. Words in order share the states of common beginnings."""
        pairs, before = self.pairs, ""
        last, size = [0], [0]
        for word in words:
            same = 0
            for same, (a, b) in enumerate(zip(before, word)):  # noqa: B007
                if a != b:
                    break
            else:
                same = min(len(before), len(word))
            del last[same + 1 :], size[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                node, start, state = self.lexicon, end, -1
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        if start:
                            pair = last[start] * PAIR + piece
                            free = pairs.get(pair)
                            if free is None:
                                free = self.neighbours(pair)
                            if not free:
                                continue
                        state = piece
                        break
                if state < 0:
                    state, start = PIECES + ord(word[end - 1]), end - 1
                last.append(state)
                size.append(end - start)
            before, end = word, len(word)
            out: list[int] = []
            while end:
                state = last[end]
                if state < PIECES:
                    out.append(state)
                else:
                    out += [self.byte_ids[b] for b in reversed(chr(state - PIECES).encode())]
                end -= size[end]
            yield tuple(reversed(out))

    def shortest(self, text: str) -> list[int]:
        """The ids along the shortest path of a whole normalised text under the weights of a unigram vocabulary.

        A position keeps the best arc that ends there: of equal ones that which starts first.
        """
        best: list[np.float32 | None] = [np.float32(0)] + [None] * len(text)
        arc = [(0, -1)] * (len(text) + 1)
        for start in range(len(text)):
            here, node, single = best[start], self.lexicon, False
            for end in range(start, len(text)):
                node = node.get(text[end])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    single = single or end == start
                    total = here + piece[0]
                    if best[end + 1] is None or total > best[end + 1]:
                        best[end + 1], arc[end + 1] = total, (start, piece[1])
            if not single:
                total = here + self.outside
                if best[start + 1] is None or total > best[start + 1]:
                    best[start + 1], arc[start + 1] = total, (start, -1)
        out: list[int] = []
        end, before = len(text), False
        while end:
            start, piece = arc[end]
            if piece >= 0:
                out.append(piece)
            elif self.bytewise:
                out += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
            elif not before:
                out.append(self.unknown)
            before, end = piece < 0, start
        return out[::-1]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if self.kind == UNIGRAM:
            return [self.shortest(self.normal(t or "")) for t in texts]
        known = self.known
        words = [self.words.findall(self.normal(t)) if t else [] for t in texts]
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = sorted({w for own in words for w in own if w not in known})
        found = dict(zip(new, self.paths(new), strict=True))
        known.update((w, ids) for w, ids in found.items() if len(w) <= WORD_CHARS)
        found = {w: ids for w, ids in found.items() if len(w) > WORD_CHARS}
        return [[i for w in own for i in (known.get(w) or found[w])] for own in words]

    def decode(self, ids: list[int]) -> str:
        raw = [self.spelling[i] for i in ids]
        if self.normal.prefix or self.normal.squeeze:
            # pieces lose the mark in front, up to the first that shows if blanks are squeezed, else the first alone
            for k, i in enumerate(ids):
                if raw[k][:1] == b" " and i in self.names:
                    raw[k] = raw[k][1:]
                if raw[k] or not self.normal.squeeze:
                    break
        return b"".join(raw).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, ids, n_byte_pieces, decoded) and the columns ``keep``. ``path`` is the model file, at the same place on all workers."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    kept = [(n, t) for n, t in rows.dtypes if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in portions(batches, BATCH_BYTES):
            ids = machine.encode(batch.column("text").to_pylist())
            at = np.cumsum([0] + [len(x) for x in ids])
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, at[-1])
            bytewise = np.r_[0, np.cumsum(machine.bytewise & (flat >= machine.first_byte) & (flat <= machine.last_byte))]
            decoded = [machine.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n, _ in kept), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                 pa.array(bytewise[at[1:]] - bytewise[at[:-1]], pa.int64()), pa.array(decoded, pa.string())],
                [*(n for n, _ in kept), "ids", "n_byte_pieces", "decoded"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kept) + ", ids array<int>, n_byte_pieces long, decoded string")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, byte pieces, digests of the ids (joined by commas) and of the decoded text."""
    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_byte_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
