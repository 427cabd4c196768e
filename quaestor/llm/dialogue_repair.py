"""Repair of conversations' structure at least cost, by layers of reachable grammar states.

A repaired conversation is empty, or an optional system turn and then user and assistant turns in pairs. A turn can be
kept (cost 0), given the role user or assistant (1) or deleted (2), and a turn without text can be inserted anywhere
(5); a truncated turn that isn't deleted costs 5 more, and blank and repeated turns have to go. The grammar's four
states (start, system, user, assistant) are a bitset, and a word of 64 bits holds sixteen of them: the states from
which the rest of the conversation can be finished at the least cost of any state, at one more, and so on. An edit of
cost c moves all layers at once by c places. No state is ever more than twelve behind the best one, so a word and the
best cost say all there is to know before a turn. Words are worked out from the last turn backwards; the first layer
that holds the start gives the cost, and the trace forwards takes at each turn the least edit in ASCII order that the
words still allow at that cost.

Conversations meet by one shuffle. In each partition turns are sorted by conversation and turn, backwards and then
forwards, and run through as streams: memory doesn't grow with a conversation, sorts spill. A conversation is one
task's, as its digest is that of one text in order.

Null roles and texts are one space. A null conversation id is a conversation of its own, null turns stand first,
and equal turns are ordered by role and text. A role's initial is its first character; a row without one, or with another
than s, u and a, can't be kept. Conversations without rows have no edits. Columns besides the four are not read, and a
table without rows gives none.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import held

SPACE = " \t\n\x0b\f\r"
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs

START, SYSTEM, USER, ASSISTANT = range(4)
LAYERS, LANE, ALL = 16, 0x1111111111111111, (1 << 64) - 1
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a turn given a role, or an inserted one, leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _before(word: int, initial: str) -> int:
    """In every layer, the states from which a turn with that initial leads into one of the layer's."""
    out = 0
    for a, b in STEP.get(initial, {}).items():
        out |= (word >> b & LANE) << a
    return out


def _before_any(word: int) -> int:
    return _before(word, "u") | _before(word, "a")


def _with_inserts(word: int) -> int:
    for _ in range(LAYERS // INSERT):
        word |= _before_any(word) << 4 * INSERT & ALL
    return word


#: After the last turn: start and assistant are finished, the others by inserted turns.
END = _with_inserts(LANE << START | LANE << ASSISTANT)


def step_back(word: int, base: int, initial: str, must: bool, truncated: bool) -> tuple[int, int]:
    """The layers before a turn, from those after it, and the cost of the lowest layer."""
    out = word << 4 * DELETE
    if not must:
        extra = TRUNCATED if truncated else 0
        out |= _before(word, initial) << 4 * extra | _before_any(word) << 4 * (extra + RELABEL)
    out = _with_inserts(out & ALL)
    while not out & 15:
        out, base = out >> 4 | 15 << 60, base + 1
    return out, base


def least(word: int, state: int) -> int:
    """The first layer that holds a state."""
    bits = word >> state & LANE
    return ((bits & -bits).bit_length() - 1) // 4


class Trace:
    """The least audit of one conversation, turn by turn."""

    def __init__(self):
        self.state, self.left, self.begun = START, 0, False

    def begin(self, word: int, base: int) -> int:
        """The whole cost, from the layers before the first turn."""
        self.left, self.begun = base + least(word, START), True
        return self.left

    def _insert(self) -> str:
        self.state, self.left = NEXT[self.state], self.left - INSERT
        return NAMES[self.state]

    def turn(self, initial: str, must: bool, truncated: bool, own: tuple[int, int], after: tuple[int, int]) -> list[tuple[str, str | None]]:
        """(edit, new role) of the turns inserted before a turn, and of itself."""
        out, extra = [], TRUNCATED if truncated else 0
        rest = lambda at, state: at[1] + least(at[0], state)
        while True:
            if self.left == DELETE + rest(after, self.state):
                self.left -= DELETE
                return [*out, ("D", None)]
            if self.left == INSERT + rest(own, NEXT[self.state]):
                out.append(("I", self._insert()))
                continue
            kept = STEP.get(initial, {}).get(self.state)
            if kept is not None and self.left == extra + rest(after, kept):
                self.state, self.left = kept, self.left - extra
                return [*out, ("K", None)]
            self.state, self.left = NEXT[self.state], self.left - extra - RELABEL
            return [*out, ("R", NAMES[self.state])]

    def end(self) -> list[tuple[str, str]]:
        out = []
        while self.left:
            out.append(("I", self._insert()))
        return out


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversations, damaged by the crc32 of `conversation:turn` modulo 20: 0 marks the row as not present,
    1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    Nulls count as one space there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(times))
    return rows.drop("col")


def _faults(text: Column, nth: Column) -> Column:
    """A row's first fault: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    solid = F.rtrim(text, F.lit(SPACE))
    return F.when(solid == "", 1).when(nth > 1, 2).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


FAULTS = ("", "blank", "duplicate", "truncated")
ROWS = "conv_id long, turn long, role string, text string, present boolean, fault int, nth int"
WORDS = f"{ROWS}, own binary, own_base long, after binary, after_base long"
EDITS = "conv_id long, turn long, edit string, role string, text string, fault int, was string, place long"


def _back(batches):
    """Adds to each row the layers before and after it; rows come conversation by conversation, the last turn first."""
    conv, word, base = object(), END, 0
    for batch in batches:
        own, after = ([], []), ([], [])
        for c, initial, present, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "initial", "present", "fault"))):
            if c != conv:
                conv, word, base = c, END, 0
            after[0].append(word.to_bytes(8, "little"))
            after[1].append(base)
            if present:
                word, base = step_back(word, base, initial, fault in (1, 2), fault == 3)
            own[0].append(word.to_bytes(8, "little"))
            own[1].append(base)
        columns = [batch.column(x.split()[0]) for x in ROWS.split(", ")]
        columns += [pa.array(own[0], pa.binary()), pa.array(own[1], pa.int64()), pa.array(after[0], pa.binary()), pa.array(after[1], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in WORDS.split(", ")])


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kind = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def _forward(batches):
    """The edits of each conversation in order; rows come with their layers, the first turn first. A conversation
    begins with a row without an edit."""
    conv, trace, place, out = object(), Trace(), 0, []

    def put(turn, edit, role, text, fault, was):
        nonlocal place
        out.append((conv, turn, edit, role, text, fault, was, place))
        place += 1

    def insert(turns):
        for edit, role in turns:
            put(None, edit, role, "", 0, None)

    for batch in batches:
        for c, turn, role, text, present, fault, _, own, own_base, after, after_base in zip(*(x.to_pylist() for x in batch.columns)):
            if c != conv:
                insert(trace.end())
                conv, trace, place = c, Trace(), -1
                put(None, None, None, None, 0, None)
            if not present:
                continue
            own, after = (int.from_bytes(own, "little"), own_base), (int.from_bytes(after, "little"), after_base)
            if not trace.begun:
                trace.begin(*own)
            *before, (edit, new) = trace.turn(role[:1], fault in (1, 2), fault == 3, own, after)
            insert(before)
            put(turn, edit, None if edit == "D" else new or role, None if edit == "D" else text, fault, role)
        yield _table(out, EDITS)
        out.clear()
    insert(trace.end())
    yield _table(out, EDITS)


def _edits(df: DataFrame, present: str | None = "present") -> DataFrame:
    """All edits; a partition holds whole conversations, in order."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce(F.col(present), F.lit(False)).alias("present") if present else F.lit(True).alias("present"))
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", _faults(F.col("text"), F.col("nth")))
    backwards = [F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")]
    back = rows.sortWithinPartitions("conv_id", *backwards).withColumn("initial", F.substring("role", 1, 1)).mapInArrow(held.task(_back), WORDS)
    return back.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth").mapInArrow(held.task(_forward), EDITS)


def repair(df: DataFrame, present: str | None = None) -> DataFrame:
    """conv_id, place (from 0, along the edits), turn, edit (K, R, D or I), role, text, fault for each edit of the
    conversations in conv_id, turn, role and text; deleted turns have neither role nor text. `present` names a column
    that says which rows are there."""
    name = F.nullif(F.element_at(F.array(*map(F.lit, FAULTS)), F.col("fault") + 1), F.lit(""))
    return _edits(df, present).where("edit IS NOT NULL").select("conv_id", "place", "turn", "edit", "role", "text", name.alias("fault"))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FOLLOW = {"su", "ua", "au"}


class _Audit:
    """What the edits of one conversation come to."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost, self.audit = conv, [0, 0, 0, 0], 0, 0, []
        self.low = self.last_turn = self.last = None
        self.turns, self.digest, self.empty = 0, hashlib.sha256(), True

    def add(self, turn, edit, role, text, fault, was) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": RELABEL, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == 3 and edit != "D" else 0)
        if edit != "I":
            self.faults[fault] += 1
            self.illegal += self.last is not None and self.last + was[:1] not in FOLLOW
            self.last = was[:1]
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.turns += turn != self.last_turn
                self.last_turn = turn
        if edit != "D":
            self.digest.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.last_turn - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _audits(batches):
    now = None
    for batch in batches:
        out = []
        for conv, turn, edit, role, text, fault, was, _ in zip(*(x.to_pylist() for x in batch.columns)):
            if edit is None:
                out += [now.row()] if now else []
                now = _Audit(conv)
            else:
                now.add(turn, edit, role, text, fault, was)
        yield _table(out, AUDITS)
    yield _table([now.row()] if now else [], AUDITS)


def audits(df: DataFrame, present: str | None = None) -> DataFrame:
    """One row for each conversation: counts of faults, the cost, the edits' initials and the digest of what is left."""
    return _edits(df, present).mapInArrow(held.task(_audits), AUDITS)


#: DuckDB SQL for audits(damage(conversations)). A recursion over turns keeps, for each state, the least (cost, audit,
#: repaired text). crc32 is worked out bit by bit.
ORACLE = r"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations),
kinds AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, CAST(i AS INTEGER), 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
    ), 4294967295::BIGINT) % 20 AS kind FROM raw),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
counted AS (
    SELECT k, turn, role, text, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST) AS nth
    FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
placed AS (
    SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, nth) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
    FROM counted),
faults AS (
    SELECT *, CASE WHEN solid = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(initial) OVER (PARTITION BY k ORDER BY i) AS last
    FROM placed),
walk AS (
    SELECT k, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS b, {'c': 1000000::BIGINT, 'a': '', 't': ''} AS s,
        {'c': 5::BIGINT, 'a': 'I', 't': 'user:'} AS u, {'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS a
    FROM convs
    UNION ALL
    SELECT k, i, b, s, u, list_sort([a, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}])[1] AS a
    FROM (
        SELECT k, i, b, s, a, list_sort([u,
            {'c': b.c + 5, 'a': b.a || 'I', 't': b.t || CASE WHEN b.t = '' THEN '' ELSE chr(10) END || 'user:'},
            {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'},
            {'c': a.c + 5, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}])[1] AS u
        FROM (
            SELECT walk.k, faults.i,
                {'c': b.c + 2, 'a': b.a || 'D', 't': b.t} AS b,
                list_sort([{'c': s.c + 2, 'a': s.a || 'D', 't': s.t},
                    {'c': b.c + bar + CASE WHEN initial = 's' THEN 0 ELSE 1000000 END, 'a': b.a || 'K', 't': own}])[1] AS s,
                list_sort([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t},
                    {'c': b.c + bar + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': b.a || 'K', 't': own},
                    {'c': s.c + bar + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': s.a || 'K', 't': s.t || chr(10) || own},
                    {'c': a.c + bar + CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END, 'a': a.a || 'K', 't': a.t || chr(10) || own},
                    {'c': b.c + bar + 1, 'a': b.a || 'R', 't': 'user:' || text},
                    {'c': s.c + bar + 1, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text},
                    {'c': a.c + bar + 1, 'a': a.a || 'R', 't': a.t || chr(10) || 'user:' || text}])[1] AS u,
                list_sort([{'c': a.c + 2, 'a': a.a || 'D', 't': a.t},
                    {'c': u.c + bar + CASE WHEN initial = 'a' THEN 0 ELSE 1000000 END, 'a': u.a || 'K', 't': u.t || chr(10) || own},
                    {'c': u.c + bar + 1, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text}])[1] AS a
            FROM walk JOIN (SELECT *, role || ':' || text AS own, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000000 END AS bar FROM faults) faults
                ON walk.k = faults.k AND faults.i = walk.i + 1))),
ends AS (SELECT k, list_sort([b, a])[1] AS best FROM walk WHERE (k, i) IN (SELECT (k, max(i)) FROM walk GROUP BY k)),
facts AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (last || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
FROM convs JOIN ends ON convs.k = ends.k LEFT JOIN facts ON convs.k = facts.k
"""
