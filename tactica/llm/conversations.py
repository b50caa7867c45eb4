"""Repair of conversations' structure by a cheapest-edit dynamic programme over a sorted stream.

Rows are dealt by conversation and sorted by turn within their task; one map reads them from the last
turn to the first and carries the programme's four costs from batch to batch. A row leaves behind two
bytes, its kind and the best edit in each state, which go to a temporary file together with its text
where a conversation outgrows ``HELD``; the first row decides, and one pass back over what was left
gives edits and repaired rows in order. A task holds one batch and one block of one conversation.

Whole conversations have role initials ``(s?(ua)+)?``. Of equally cheap repairs the one whose edits'
initials come first in ASCII order is taken; as D, I, K and R differ, the first edit in which two
repairs differ decides, so the choice is made row by row.
"""

from __future__ import annotations

import functools
import hashlib
import marshal
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Costs of edits; an undeleted truncated row costs one more.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: What stands before: nothing, system, user, assistant. The role that may be given or put next, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of initials, and faults in the order in which they count.
INITIALS, FAULTS = ("s", "u", "a"), ("blank", "duplicate", "truncated")
#: Bytes of a block of a conversation; a second one sends the first to a file.
HELD = 8 << 20
#: Repaired rows of an output batch.
ROWS = 10_000
END = (0, 4, 2, 0)  # costs when no row is left


@functools.cache
def step(costs: tuple[int, ...], kind: int, deleted: bool, truncated: bool) -> tuple[tuple[int, ...], int, int]:
    """(costs before the row, less their least; that least; the row's edit in each state, two bits each).

    ``kind``: 1 to 3 for the states that the row's own role leads to, 0 for another role. Costs differ by
    a few units, so the distinct calls are few.
    """
    plain = []  # without an insertion before the row
    for state, then in enumerate(costs):
        options = [(DELETE + then, "D")]
        if not deleted:
            if kind == NEXT[state] or (kind == SYSTEM and state == START):
                options.append((truncated * TRUNCATED + costs[kind], "K"))
            options.append((REROLE + truncated * TRUNCATED + costs[NEXT[state]], "R"))
        plain.append(min(options))
    found = list(plain)
    for state in (ASSISTANT, USER):
        found[state] = min(plain[state], (INSERT + plain[NEXT[state]][0], "I"))
    for state in (START, SYSTEM):
        found[state] = min(plain[state], (INSERT + found[NEXT[state]][0], "I"))
    least = min(c for c, _ in found)
    return tuple(c - least for c, _ in found), least, sum("DIKR".index(e) << 2 * state for state, (_, e) in enumerate(found))


class Conversation:
    """One conversation, read from its last row to its first."""

    def __init__(self, conv):
        self.conv, self.costs, self.cost, self.rows = conv, END, 0, 0
        self.faults, self.illegal, self.follower = [0, 0, 0], 0, None
        self.last = self.first = self.turn = None
        self.turns = 0
        self.kinds, self.backs, self.kept, self.size = bytearray(), bytearray(), [], 0
        self.file, self.blocks = None, []

    def add(self, turn, role: str, text: str, fault: int) -> None:
        kind = INITIALS.index(role[0]) + 1 if role and role[0] in INITIALS else 0
        self.rows += 1
        if fault:
            self.faults[fault - 1] += 1
        if self.follower is not None and (kind, self.follower) not in ((1, 2), (2, 3), (3, 2)):
            self.illegal += 1
        self.follower = kind
        if turn is not None:
            if self.last is None:
                self.last = turn
            self.turns += turn != self.turn
            self.turn = self.first = turn
        self.costs, more, back = step(self.costs, kind, fault in (1, 2), fault == 3)
        self.cost += more
        self.kinds.append(kind)
        self.backs.append(back)
        self.kept.append((turn, role, text))
        self.size += len(text) + 100
        if self.size > HELD:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # nameless: gone with the task
        block = marshal.dumps((bytes(self.kinds), bytes(self.backs), self.kept))
        self.blocks.append((self.file.tell(), len(block)))
        self.file.write(block)
        self.kinds, self.backs, self.kept, self.size = bytearray(), bytearray(), [], 0

    def _forward(self):
        """(kind, back, row) from the first turn to the last."""
        yield from zip(reversed(self.kinds), reversed(self.backs), reversed(self.kept), strict=True)
        for at, size in reversed(self.blocks):
            self.file.seek(at)
            kinds, backs, kept = marshal.loads(self.file.read(size))
            yield from zip(reversed(kinds), reversed(backs), reversed(kept), strict=True)

    def edits(self) -> Iterator[tuple[str, object, str, str]]:
        """(edit, turn, role, text after it) in order; deleted rows as they were. Inserted rows have no turn."""
        state = START
        for kind, back, (turn, role, text) in self._forward():
            while (edit := "DIKR"[back >> 2 * state & 3]) == "I":
                state = NEXT[state]
                yield "I", None, ROLES[state], ""
            if edit == "K":
                state = kind
            elif edit == "R":
                state = NEXT[state]
                role = ROLES[state]
            yield edit, turn, role, text
        while state not in (START, ASSISTANT):
            state = NEXT[state]
            yield "I", None, ROLES[state], ""

    def summary(self) -> tuple:
        audit, digest, any_line = [], hashlib.sha256(), False
        for edit, _, role, text in self.edits():
            audit.append(edit)
            if edit != "D":
                digest.update(("\n" if any_line else "").encode() + f"{role}:{text}".encode())
                any_line = True
        gaps = self.last - self.first + 1 - self.turns if self.last is not None else 0
        return self.conv, gaps, *self.faults, self.illegal, self.cost + self.costs[START], "".join(audit), digest.hexdigest()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    now = None
    for b in batches:
        columns = [b[c].to_pylist() for c in ("conv", "turn", "role", "text", "fault", "present")]
        for conv, turn, role, text, fault, present in zip(*columns, strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                    now.close()
                now = Conversation(conv)
            if present:
                now.add(turn, role, text, fault)
    if now is not None:
        yield now
        now.close()


SPACES = "concat(' ', char(9), char(10), char(11), char(12), char(13))"


def sorted_rows(conversations: DataFrame, present: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text, fault (0, or the number of the first fault), present: dealt by conversation and
    sorted by turn from the last to the first, in one exchange: repeated rows are found among the rows that
    the same exchange has brought together.

    Order: by turn, nulls first, then role and text. Null roles and texts count as one space. Rows that are
    not ``present`` only tell that there is such a conversation.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"))
    earlier = F.row_number().over(Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    dealt = rows.repartition("conv").withColumn("again", earlier)
    end = F.expr(f"right(trim(TRAILING {SPACES} FROM text), 1)")
    fault = F.when(end == "", 1).when(F.col("again"), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    order = ["conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("again").desc()]  # of equal rows the repeated ones are later
    return dealt.sortWithinPartitions(*order).select("conv", "turn", "role", "text", fault.cast("int").alias("fault"), "present")


def audit(conversations: DataFrame, present: Column | None = None, **columns: str) -> DataFrame:
    """One row for each conversation, those without a present row included: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Null conversations are one conversation; equal turns are ordered by role and text; an empty table gives
    an empty result; other columns are not looked at. ``audit`` has a letter for each edit.
    """
    rows = sorted_rows(conversations, present, **columns)
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv_type, size = [], None, 0

        def watched():
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field("conv").type
                yield b

        def flush():
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for c in _conversations(watched()):
            done.append(c.summary())
            size += c.rows
            if len(done) >= ROWS or size > 100 * ROWS:
                yield flush()
                done, size = [], 0
        if done:
            yield flush()

    longs = ", ".join(f"{c} long" for c in names[1:7])
    return rows.mapInArrow(run, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, present: Column | None = None, **columns: str) -> DataFrame:
    """The repaired conversations, one row for each of their rows: conv_id, position (from 0), turn (null: inserted),
    role, text, edit (K kept, R given another role, I inserted)."""
    rows = sorted_rows(conversations, present, **columns)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, types = [], None

        def watched():
            nonlocal types
            for b in batches:
                types = [b.schema.field("conv").type, pa.int64(), b.schema.field("turn").type, *[pa.string()] * 3]
                yield b

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["conv_id", "position", "turn", "role", "text", "edit"])

        for c in _conversations(watched()):
            left = (e for e in c.edits() if e[0] != "D")
            for k, (edit, turn, role, text) in enumerate(left):
                done.append((c.conv, k, turn, role, text, edit))
                if len(done) >= ROWS:
                    yield flush()
                    done = []
        if done:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kinds['conv']}, position long, turn {kinds['turn']}, role string, text string, edit string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a faulty source would deliver them, by a checksum of conversation and turn (modulo 20):
    0 drops a row (``present`` is false), 1 empties its text, 2 takes its full stops, exclamation and question
    marks, 3 repeats it, 4 makes it the user's. Nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("what"))
    what = F.col("what")
    return rows.select(
        "conv_id", "turn", F.when(what == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).when(what != 0, F.col("text")).otherwise("").alias("text"),
        (what != 0).alias("present"), F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def query(spark, sf_dir):
    return audit(damage(table(spark, sf_dir, "conversations")), F.col("present"))


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _option(cost: str, letter: str, line: str, then: str, able: str = "true") -> str:
    return f"{{'k': CASE WHEN {able} THEN {then}.k + {cost} ELSE 1000000000 END, 'a': '{letter}' || {then}.a, 'r': {line} || {then}.r}}"


def _plain(state: int) -> str:
    to = NEXT[state]
    keep = "CASE x.kind WHEN 1 THEN s1.k WHEN 2 THEN s2.k ELSE s3.k END"
    legal = "x.kind IN (1, 2)" if state == START else f"x.kind = {to}"
    kept = (f"{{'k': CASE WHEN NOT x.must AND {legal} THEN {keep} + x.more ELSE 1000000000 END, 'a': 'K' || CASE x.kind WHEN 1 THEN s1.a WHEN 2 THEN s2.a ELSE s3.a END, "
            f"'r': x.line || CASE x.kind WHEN 1 THEN s1.r WHEN 2 THEN s2.r ELSE s3.r END}}")  # fmt: skip
    return _least(_option("3", "D", "''", f"s{state}"), kept, _option("2 + x.more", "R", f"chr(10) || '{ROLES[to]}:' || x.text", f"s{to}", "NOT x.must"))


def _put(state: int, then: str) -> str:
    return _option("2", "I", f"chr(10) || '{ROLES[NEXT[state]]}:'", then)


_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
ORACLE = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
keyed AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
marked AS MATERIALIZED (SELECT g, conv_id, turn, role, text, xor(list_reduce(list_transform(range(length(key)), lambda i: ascii(key[i + 1])::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 20 AS what FROM keyed, tab),
after AS MATERIALIZED (SELECT g, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE what <> 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS p, right(rtrim(text, {_TRIM}), 1) AS last, coalesce(list_position(['s', 'u', 'a'], left(role, 1)), 0) AS kind FROM after),
faulty AS MATERIALIZED (SELECT *, lead(kind) OVER (PARTITION BY g ORDER BY p) AS follower, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
x AS MATERIALIZED (SELECT g, p, kind, role, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more, chr(10) || role || ':' || text AS line FROM faulty),
fold AS (SELECT g, max(p) + 1 AS p, {{'k': 0, 'a': '', 'r': ''}} AS s0, {{'k': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s1, {{'k': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS s2, {{'k': 0, 'a': '', 'r': ''}} AS s3 FROM x GROUP BY g
  UNION ALL SELECT g, p, {_least('b0', _put(START, 'c2'))}, {_least('b1', _put(SYSTEM, 'c2'))}, c2, c3 FROM (
    SELECT *, {_least('b2', _put(USER, 'b3'))} AS c2, {_least('b3', _put(ASSISTANT, 'b2'))} AS c3 FROM (
      SELECT x.g, x.p, {', '.join(f'{_plain(s)} AS b{s}' for s in range(4))} FROM fold JOIN x ON x.g = fold.g AND x.p = fold.p - 1))),
told AS (SELECT g, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, {', '.join(f"count(*) FILTER (fault = '{f}') AS {f}" for f in FAULTS)},
  count(*) FILTER (follower IS NOT NULL AND (kind, follower) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal FROM faulty GROUP BY g)
SELECT conv_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('gaps', *FAULTS, 'illegal'))}, CAST(coalesce(s0.k, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM marked) LEFT JOIN told USING (g) LEFT JOIN (SELECT g, s0 FROM fold WHERE p = 1) USING (g)"""
