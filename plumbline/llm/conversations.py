"""Conversation structure repair: cheapest edits by a streamed dynamic program over sorted turns.

One shuffle brings a conversation's rows together. Sorted from the last turn to the first, they stream through a
dynamic program whose whole state is four costs: what the rest of the conversation costs from each state of the grammar
``(s?(ua)+)?`` (nothing yet, after the system turn, after a user turn, after an assistant turn). Each row leaves with a
pointer of one byte, two bits for each state, that names the cheapest edit there, the ASCII-least among equals. Sorted
back within the same tasks, the rows stream once more, following the pointers from the start and hashing what is kept. Both
streams carry their state across Arrow batches, and Spark's sorts spill rows and pointers, so a conversation of any
length needs one batch of memory (and its audit, one byte for each edit). Lost executors only repeat their tasks.

Repeated turns are found before the shuffle of texts, over digests that are counted per task first: the result is a
small table of marks, each of which precedes its rows in the stream and says how many of them are repetitions.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only choice for blank and repeated rows), Insert an empty
user or assistant turn 3; a truncated row that is not deleted costs 3 more. The grammar fixes the role of an inserted or
reroled turn, so an audit names one result.

Defined cases: a null role or text reads as one blank; null turns come before all others and count in no gap; rows of
unlike contents that share a turn are in the order of the md5 of their contents; a null ``conv_id`` is a conversation
of its own; roles other than system, user and assistant are judged by their initial, an empty one is legal nowhere; a
conversation without rows left has zeros, an empty audit and the hash of nothing; an empty table gives an empty table.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, spread_join, table
from plumbline.registry import query

#: States of the grammar: nothing yet, after s, after u, after a. Where an inserted or reroled turn leads, and its role.
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = (USER, USER, ASSISTANT, USER)
FORCED_ROLE = ("user", "user", "assistant", "user")
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LETTERS = "DIKR"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Costs after the last row: from u an assistant turn is missing, from s two turns are.
END = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("blank", "duplicate", "truncated")


@cache
def step(after: tuple[int, ...], initial: str, doomed: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their minimum, and the row's pointer byte.

    Costs differ by a few inserts at most, so few tuples ever occur and the cache makes this a table of a finite automaton.
    """
    extra = TRUNCATED if truncated else 0
    options = []
    for state in range(4):
        own = {"D": DELETE + after[state]}
        if not doomed:
            own["R"] = REROLE + extra + after[FORCED[state]]
            if (initial, state) in KEPT:
                own["K"] = extra + after[KEPT[initial, state]]
        options.append(own)
    costs = [min(own.values()) for own in options]
    for state in (USER, ASSISTANT, USER, START, SYSTEM):
        costs[state] = min(costs[state], INSERT + costs[FORCED[state]])
    byte = 0
    for state, own in enumerate(options):
        own["I"] = INSERT + costs[FORCED[state]]
        byte |= LETTERS.index(min(c for c, cost in own.items() if cost == costs[state])) << 2 * state
    least = min(costs)
    return tuple(c - least for c in costs), byte


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated or reroled.

    A dropped row stays with ``present`` false, so that its conversation is not forgotten.
    """
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = rows.withColumn("fate", F.crc32(key) % 20)
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")


def _digest(*columns: str) -> Column:
    """128 bits over the columns, each with its length before it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return F.md5(F.concat(*[p for c in parts for p in (F.char_length(c).cast("string"), F.lit(":"), c)]))


def _marks(rows: DataFrame) -> DataFrame:
    """For every (conversation, turn, contents) with repetitions, how many of its rows repeat an earlier one."""
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    runs = rows.where("present AND NOT blank").select("conv_id", "turn", "contents", _digest("conv_id", "role", "text").alias("whole"))
    runs = runs.groupBy("conv_id", "turn", "contents", "whole").agg(F.count(F.lit(1)).alias("n"))
    firsts = runs.groupBy("whole").agg(F.min(place).alias("first"), F.sum("n").alias("total")).where("total > 1").drop("total")
    repeated = F.col("n") - F.when(place == F.col("first"), 1).otherwise(0)
    return spread_join(runs, firsts, ["whole"]).select("conv_id", "turn", "contents", repeated.alias("repeats")).where("repeats > 0")


def _backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pointers for rows that come from the last to the first; marks are used up."""
    conv, costs, repeats, seq = None, END, 0, 0
    for frame in frames:
        out = []
        for cid, has, turn, role, text, present, blank, cut, marked in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
            if cid != conv:
                conv, costs, repeats = cid, END, 0
            seq += 1
            if marked:
                repeats = marked
                continue
            fault, pointer = -1, 0
            if present:
                if blank:
                    fault = 0
                elif repeats:
                    fault, repeats = 1, repeats - 1
                elif cut:
                    fault = 2
                costs, pointer = step(costs, role[:1], fault in (0, 1), fault == 2)
            out.append((cid, seq, has, turn, role, text, present, fault, pointer))
        yield pd.DataFrame(out, columns=["cid", "seq", "has", "turn", "role", "text", "present", "fault", "pointer"])


class _Repair:
    """One conversation while its rows pass from the first to the last."""

    def __init__(self, cid: str):
        self.cid, self.state, self.cost, self.audit, self.sha, self.turns = cid, START, 0, bytearray(), hashlib.sha256(), 0
        self.faults, self.illegal, self.initial = [0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0

    def emit(self, letter: str, role: str, text: str) -> tuple:
        self.audit += letter.encode()
        if letter == "D":
            self.cost += DELETE
        else:
            self.sha.update(f"{chr(10) if self.turns else ''}{role}:{text}".encode())
            self.turns += 1
            self.cost += {"K": 0, "R": REROLE, "I": INSERT}[letter]
        return self.cid, len(self.audit), letter, role, text

    def insert(self) -> tuple:
        role, self.state = FORCED_ROLE[self.state], FORCED[self.state]
        return self.emit("I", role, "")

    def row(self, has: bool, turn: int, role: str, text: str, fault: int, pointer: int) -> Iterator[tuple]:
        if has and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault >= 0:
            self.faults[fault] += 1
        while (letter := LETTERS[pointer >> 2 * self.state & 3]) == "I":
            yield self.insert()
        if letter == "R":
            role, self.state = FORCED_ROLE[self.state], FORCED[self.state]
        elif letter == "K":
            self.state = KEPT[role[:1], self.state]
        if letter != "D" and fault == 2:
            self.cost += TRUNCATED
        yield self.emit(letter, role, text)

    def finish(self) -> Iterator[tuple]:
        while self.state in (SYSTEM, USER):
            yield self.insert()

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return (self.cid, None, None, None, None, gaps, *self.faults, self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())


SUMMARY = ["gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
EDITS = ["position", "edit", "role", "text"]


def repair(rows: DataFrame, turns: bool = True) -> DataFrame:
    """The repaired conversations, as edits and summaries in one table.

    ``rows`` holds ``conv_id``, ``turn``, ``role``, ``text`` and, if wished, ``present`` (false: not a turn, but its
    conversation is reported). Each edit is a row (conv_id, position from 1, edit, role, text), deleted turns included;
    each conversation closes with one row whose ``edit`` is null and which holds ``gaps``, the faults by kind,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``. With ``turns`` false only these are returned.
    """
    id_type = rows.schema["conv_id"].dataType
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], present.alias("present"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    clean = clean.select("*", (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), _digest("role", "text").alias("contents"))
    marks = _marks(clean).select("conv_id", "turn", *[F.lit("").alias(c) for c in ("role", "text")], *[F.lit(False).alias(c) for c in ("present", "blank", "cut")], "contents", "repeats")
    stream = clean.select("*", F.lit(0).cast("long").alias("repeats")).unionByName(marks)
    stream = stream.repartition("conv_id").sortWithinPartitions(
        F.desc_nulls_last("conv_id"), F.desc_nulls_last("turn"), F.desc("contents"), F.desc("repeats"))
    stream = stream.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("cid"), F.col("turn").isNotNull().alias("has"),
        F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "present", "blank", "cut", "repeats")
    back = stream.mapInPandas(_backward, "cid string, seq long, has boolean, turn long, role string, text string, present boolean, fault int, pointer int")

    def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        columns = ["cid", *EDITS, *SUMMARY]
        blank = (None,) * len(SUMMARY)
        for frame in frames:
            out: list[tuple] = []
            for cid, has, turn, role, text, here, fault, pointer in zip(
                    *(frame[c].tolist() for c in ("cid", "has", "turn", "role", "text", "present", "fault", "pointer")), strict=True):
                if now is None or now.cid != cid:
                    if now is not None:
                        out += [(*e, *blank) for e in now.finish() if turns] + [now.summary()]
                    now = _Repair(cid)
                if here:
                    out += [(*e, *blank) for e in now.row(has, turn, role, text, fault, pointer) if turns]
            yield pd.DataFrame(out, columns=columns, dtype=object)
        if now is not None:
            yield pd.DataFrame([(*e, *blank) for e in now.finish() if turns] + [now.summary()], columns=columns, dtype=object)

    longs = ", ".join(f"{c} long" for c in SUMMARY[:-2])
    done = back.sortWithinPartitions(F.desc("seq")).mapInPandas(
        forward, f"cid string, position long, edit string, role string, text string, {longs}, audit string, repaired_sha256 string")
    cid = F.when(F.col("cid") != "", F.expr("substring(cid, 2)")).cast(id_type)
    done = done.select(cid.alias("conv_id"), *EDITS, *SUMMARY)
    return done if turns else done.drop(*EDITS)


SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(bytes, lambda a, b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295) % 20 AS fate
  FROM keyed),
turns AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, copy,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0)),
placed AS (
  SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || length(text) || ':' || text), copy)),
judged AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
priced AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 ELSE 0 END AS extra, left(role, 1) AS r FROM judged),
rest AS (
  SELECT c.conv_id, coalesce(n, 0) AS i, {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS e, {'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']} AS s,
    {'c': 3, 'a': 'I', 'o': ['assistant:']} AS u, {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, max(i) AS n FROM judged GROUP BY conv_id) m ON c.conv_id IS NOT DISTINCT FROM m.conv_id
  UNION ALL
  SELECT conv_id, i, list_min([ce, {'c': hu.c + 3, 'a': 'I' || hu.a, 'o': list_prepend('user:', hu.o)}]) AS e,
    list_min([cs, {'c': hu.c + 3, 'a': 'I' || hu.a, 'o': list_prepend('user:', hu.o)}]) AS s, hu AS u, ha AS a
  FROM (
    SELECT *, list_min([cu, {'c': ca.c + 3, 'a': 'I' || ca.a, 'o': list_prepend('assistant:', ca.o)}]) AS hu,
      list_min([ca, {'c': cu.c + 3, 'a': 'I' || cu.a, 'o': list_prepend('user:', cu.o)}]) AS ha
    FROM (
      SELECT conv_id, i,
        list_min([{'c': e.c + 4, 'a': 'D' || e.a, 'o': e.o}, ru,
          {'c': CASE r WHEN 's' THEN s.c WHEN 'u' THEN u.c ELSE 1000000 END + extra, 'a': 'K' || CASE r WHEN 's' THEN s.a ELSE u.a END,
           'o': list_prepend(own, CASE r WHEN 's' THEN s.o ELSE u.o END)}]) AS ce,
        list_min([{'c': s.c + 4, 'a': 'D' || s.a, 'o': s.o}, ru, ku]) AS cs,
        list_min([{'c': a.c + 4, 'a': 'D' || a.a, 'o': a.o}, ru, ku]) AS ca,
        list_min([{'c': u.c + 4, 'a': 'D' || u.a, 'o': u.o}, {'c': a.c + 3 + extra, 'a': 'R' || a.a, 'o': list_prepend('assistant:' || text, a.o)},
          {'c': CASE r WHEN 'a' THEN a.c ELSE 1000000 END + extra, 'a': 'K' || a.a, 'o': list_prepend(own, a.o)}]) AS cu
      FROM (
        SELECT t.conv_id, t.i - 1 AS i, e, s, u, a, extra, r, text, role || ':' || text AS own,
          {'c': u.c + 3 + extra, 'a': 'R' || u.a, 'o': list_prepend('user:' || text, u.o)} AS ru,
          {'c': CASE r WHEN 'u' THEN u.c ELSE 1000000 END + extra, 'a': 'K' || u.a, 'o': list_prepend(role || ':' || text, u.o)} AS ku
        FROM rest JOIN priced t ON rest.conv_id IS NOT DISTINCT FROM t.conv_id AND rest.i = t.i)))),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM priced GROUP BY conv_id)
SELECT rest.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(array_to_string(e.o, chr(10))) AS repaired_sha256
FROM rest LEFT JOIN counted ON rest.conv_id IS NOT DISTINCT FROM counted.conv_id WHERE rest.i = 0
"""


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), turns=False)
