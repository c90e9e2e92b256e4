"""Repair of the structure of conversations by cheapest edits.

Rows go to the partition of their conversation, are sorted by turn and stream through one
pass.  The dynamic programme over roles is carried from Arrow batch to Arrow batch; what has
to wait for a conversation's end (one number a row, and the rows themselves) is spooled to the
task's own temporary file once it is large, so memory does not follow the conversation.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import text_batches

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated row adds.
TRUNCATED = 3
#: States of the roles written so far: none, an opening system row, a user's row last, an assistant's row last.
START, SYSTEM, USER, ASSISTANT = range(4)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: The state after a row that an edit gives its role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Roles that have to be inserted at the end.
ENDING = {START: "", SYSTEM: INSERT + INSERT, USER: INSERT, ASSISTANT: ""}
#: Bytes of a conversation that wait in memory; more go to the task's temporary file.
SPOOL = 4 << 20
_BLANKS = " \t\n\x0b\f\r"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, alive: a fixed twentieth of the rows each dropped, emptied, stripped of ``[.!?]``, repeated, or made a user's.

    The remainder of crc32 of ``conv_id:turn`` by 20 decides; a null reads as one space.
    Dropped rows stay with ``alive`` false, so that their conversation is known.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    dealt = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), kind.alias("_kind"))
    hurt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_time")
    return dealt.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("_kind") != 0).alias("alive"), times).drop("_time")


def _edits(state: int, initial: str, unfit: bool, truncated: bool) -> Iterator[tuple[str, int, int]]:
    """The edits that take a row in a state: their initials, cost, and the state they leave."""
    for inserts in range(3):  # a third one would come back to the state of the first
        before, price = INSERT * inserts, COST[INSERT] * inserts
        yield before + DELETE, price + COST[DELETE], state
        if not unfit:
            stays = price + TRUNCATED * truncated
            yield before + REROLE, stays + COST[REROLE], NEXT[state]
            if initial == "s" and state == START:
                yield before + KEEP, stays, SYSTEM
            elif initial in "ua" and initial == NAME[NEXT[state]][0]:
                yield before + KEEP, stays, NEXT[state]
        state = NEXT[state]


class Automaton:
    """The dynamic programme, whose steps are remembered.

    A column holds, for each state that can still win, the least cost (above the column's
    least) and the rank of its audit among those of the others.  Audits that have taken the
    same rows end with an edit of a row, so none begins another and ranks decide ties for
    good.  As columns are relative and states out of reach of the best are dropped, there are
    few of them, and a step is looked up, not computed.
    """

    def __init__(self) -> None:
        self.columns: list[dict[int, tuple[int, int]]] = [{START: (0, 0)}]
        self.number = {self._key(self.columns[0]): 0}
        self.known: dict[tuple, int] = {}
        self.steps: list[tuple[int, int, dict[int, tuple[int, str]]]] = []

    @staticmethod
    def _key(column: dict[int, tuple[int, int]]) -> tuple:
        return tuple(sorted(column.items()))

    def step(self, column: int, row: tuple[str, bool, bool]) -> int:
        """The number of the step from a column over a row (initial, unfit, truncated)."""
        at = self.known.get((column, row))
        if at is None:
            at = self.known[column, row] = len(self.steps)
            self.steps.append(self._make(self.columns[column], row))
        return at

    def _make(self, column: dict[int, tuple[int, int]], row: tuple[str, bool, bool]) -> tuple[int, int, dict[int, tuple[int, str]]]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in column.items():
            for edits, price, to in _edits(state, *row):
                found = (cost + price, rank, edits, state)
                best[to] = min(found, best.get(to, found))
        cost = {s: x[0] for s, x in best.items()}
        far = 1 << 60
        user, assistant = cost.get(USER, far), cost.get(ASSISTANT, far)
        # what another state can do, a user or assistant state can do for so much more at most
        reach = {START: min(assistant + 4, user + 7), SYSTEM: min(assistant, user + 3), USER: assistant + 3, ASSISTANT: user + 3}
        left = [s for s in best if cost[s] <= reach[s]]
        least = min(cost[s] for s in left)
        ranks = {s: i for i, s in enumerate(sorted(left, key=lambda s: best[s][1:3]))}
        after = {s: (cost[s] - least, ranks[s]) for s in left}
        number = self.number.setdefault(self._key(after), len(self.columns))
        if number == len(self.columns):
            self.columns.append(after)
        return number, least, {s: (best[s][3], best[s][2]) for s in left}

    def end(self, column: int) -> tuple[int, int]:
        """The winning state after all rows, and its cost above the column's least."""
        cost, _, _, state = min((c + COST[INSERT] * len(ENDING[s]), rank, ENDING[s], s) for s, (c, rank) in self.columns[column].items())
        return state, cost


class _Conversation:
    """One conversation while its rows stream by."""

    def __init__(self, name: tuple, automaton: Automaton) -> None:
        self.name, self.automaton = name, automaton
        self.column = self.cost = self.rows = self.distinct = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.first = self.last = self.initial = None
        self.steps = SpooledTemporaryFile(max_size=SPOOL)
        self.texts = SpooledTemporaryFile(max_size=SPOOL)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.distinct += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        initial = role[:1]
        if self.rows:
            self.faults["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.initial, self.rows = initial, self.rows + 1
        if fault:
            self.faults[fault] += 1
        at = self.automaton.step(self.column, (initial if initial in ("s", "u", "a") else "-", fault in ("blank", "duplicate"), fault == "truncated"))
        self.column, more, _ = self.automaton.steps[at]
        self.cost += more
        self.steps.write(at.to_bytes(4, "little"))
        pickle.dump((role, text), self.texts, -1)

    def audit(self) -> str:
        """The initials of the cheapest edits, by the steps from the last row to the first."""
        state, more = self.automaton.end(self.column)
        self.cost += more
        out, stop, block = bytearray(ENDING[state].encode()), self.rows, 1 << 16
        while stop:
            start = max(0, stop - block)
            self.steps.seek(4 * start)
            for at in np.frombuffer(self.steps.read(4 * (stop - start)), "<u4")[::-1].tolist():
                state, edits = self.automaton.steps[at][2][state]
                out += edits[::-1].encode()
            stop = start
        out.reverse()
        return out.decode()

    def repaired(self, audit: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of each row after the edits."""
        self.texts.seek(0)
        state = START
        for edit in audit:
            role, text = ("", "") if edit == INSERT else pickle.load(self.texts)
            if edit == DELETE:
                continue
            state = SYSTEM if edit == KEEP and state == START and role[:1] == "s" else NEXT[state]
            yield edit, role if edit == KEEP else NAME[state], text

    def close(self) -> None:
        self.steps.close()
        self.texts.close()


_OUT = ["unnamed", "conv_id", "place", "edit", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_SCHEMA = "unnamed boolean, conv_id long, place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton, now, out, held = Automaton(), None, [], 0

    def finish(c: _Conversation) -> Iterator[tuple]:
        audit = c.audit()
        for place, (edit, role, text) in enumerate(c.repaired(audit)):
            yield (*c.name, place, edit, role, text, *[0] * 6, None)
        gaps = 0 if c.first is None else c.last - c.first + 1 - c.distinct
        yield (*c.name, -1, None, None, None, gaps, *c.faults.values(), c.cost, audit)
        c.close()

    def frame() -> pd.DataFrame:
        return pd.DataFrame(out, columns=_OUT)

    def ended() -> Iterator[pd.DataFrame]:
        nonlocal out, held
        for row in finish(now):
            out.append(row)
            held += 200 + len(row[5] or "")
            if held > SPOOL:
                yield frame()
                out, held = [], 0

    for batch in batches:
        columns = [batch[c].tolist() for c in ("_unnamed", "_conv", "_alive", "_no_turn", "_turn", "role", "text", "_fault")]
        for unnamed, conv, alive, no_turn, turn, role, text, fault in zip(*columns, strict=True):
            if now is None or now.name != (unnamed, conv):
                if now is not None:
                    yield from ended()
                now = _Conversation((unnamed, conv), automaton)
            if alive:
                now.add(None if no_turn else turn, role, text, fault or None)
    if now is not None:
        yield from ended()
    if out:
        yield frame()


def repair(rows: DataFrame) -> DataFrame:
    """Repaired rows of each conversation, and one row that reports on it.

    rows: conv_id, turn, role, text, and ``alive`` if some only name their conversation.

    Returns in the order of each conversation: unnamed (conv_id is null), conv_id, place (from
    0; -1 in the report), edit (K, R or I), role, text, and in reports gaps, blank, duplicate,
    truncated, illegal, cost and audit (K, R, D, I in order).  The roles of a repaired
    conversation are an optional system row and pairs of user and assistant, or nothing.

    One shuffle, by conversation; the duplicates' window and the stream share it.  A hot
    conversation streams through one task in bounded memory.  Rows without a turn come first;
    rows of one turn stand by role and text; repeated rows are duplicates; nulls of role and
    text read as one space; all rows without conv_id are one conversation; an empty table
    gives an empty one; further columns are left out whatever their names.
    """
    if "alive" not in rows.columns:
        rows = rows.withColumn("alive", F.lit(True))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    core = F.rtrim(text, F.lit(_BLANKS))
    named = rows.select(
        F.col("conv_id").isNull().alias("_unnamed"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"), F.col("alive").alias("_alive"),
        F.col("turn").isNull().alias("_no_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"),
        F.when(F.col("alive"), F.coalesce(F.col("role").cast("string"), F.lit(" "))).otherwise("").alias("role"), F.when(F.col("alive"), text).otherwise("").alias("text"),
        F.when(core == "", "blank").alias("_blank"), F.when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("").alias("_truncated"),
    )
    same = Window.partitionBy("_unnamed", "_conv", "_alive", "role", "text").orderBy(F.desc("_no_turn"), "_turn")
    seen = named.repartition("_unnamed", "_conv").withColumn("_again", F.row_number().over(same) > 1)
    faults = seen.withColumn("_fault", F.coalesce("_blank", F.when(F.col("_again"), "duplicate"), "_truncated"))
    lined = faults.sortWithinPartitions("_unnamed", "_conv", F.desc("_no_turn"), "_turn", "role", "text", "_again")
    return text_batches(lined.select("_unnamed", "_conv", "_alive", "_no_turn", "_turn", "role", "text", "_fault")).mapInPandas(_stream, _SCHEMA)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha, empty = hashlib.sha256(), True
    for batch in batches:
        hashes = []
        for place, role, text in zip(batch["place"].tolist(), batch["role"].tolist(), batch["text"].tolist(), strict=True):
            if place < 0:
                hashes.append(sha.hexdigest())
                sha, empty = hashlib.sha256(), True
            else:
                sha.update(("" if empty else "\n").encode() + role.encode() + b":" + text.encode())
                empty = False
        reports = batch[batch["place"] < 0].drop(columns=["place", "role", "text"])
        yield reports.assign(repaired_sha256=hashes)


def repair_report(rows: DataFrame) -> DataFrame:
    """The reports of ``repair``, with the sha256 of each conversation's repaired ``role:text`` lines; the nulls, ties and empty tables of ``repair``."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    repaired = repair(rows).select("unnamed", "conv_id", "place", "role", "text", *counts, "audit")
    schema = "unnamed boolean, conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"
    out = repaired.mapInPandas(_digest, schema)
    return out.select(F.when(~F.col("unnamed"), F.col("conv_id")).alias("conv_id"), *counts, "audit", "repaired_sha256")


SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda h: CAST(('0x' || h) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM r, range(1, 3) AS n(n) WHERE kind <> 0 AND (n = 1 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM p),
f AS (SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS previous,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
put(state, edits, price, held, lines) AS (VALUES
  (0, '', 0, 0, []), (0, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']),
  (1, '', 0, 1, []), (1, 'I', 3, 2, ['user:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 3, 3, ['assistant:']), (2, 'II', 6, 2, ['assistant:', 'user:']),
  (3, '', 0, 3, []), (3, 'I', 3, 2, ['user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])),
w AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM f
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS k FROM (
      SELECT w.conv_id, f.i, e.edit, w.cost + p.price + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost,
        w.audit || p.edits || e.edit AS audit,
        CASE WHEN e.edit = 'D' THEN p.held WHEN e.edit = 'K' AND f.initial = 's' THEN 1 WHEN p.held = 2 THEN 3 ELSE 2 END AS state,
        w.lines || p.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE WHEN p.held = 2 THEN 'assistant:' ELSE 'user:' END || f.text] END AS lines
      FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
        JOIN put AS p ON p.state = w.state
        JOIN (VALUES ('D'), ('R'), ('K')) AS e(edit) ON e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R'
          OR f.initial = 's' AND p.held = 0 OR f.initial = 'u' AND p.held <> 2 OR f.initial = 'a' AND p.held = 2)))
  WHERE k = 1),
n AS (SELECT conv_id, max(i) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT w.conv_id, w.cost + CASE w.state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END AS cost, w.audit || CASE w.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
        w.lines || CASE w.state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS lines, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal
      FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS k FROM z)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND best.k = 1
"""
