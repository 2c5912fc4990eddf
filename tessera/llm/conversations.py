"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow the grammar s?(ua)+ or nothing.

Nodes of the edit lattice are (turn index, grammar state). Dijkstra walks it without ever building it, by the key
(cost, audit), where the audit is the string of edits so far; the first accepting end node that is popped has the least
cost and, of equal costs, the ASCII-least audit. An edit's letter and the state decide where it leads, so no two paths to
a node have equal audits and no audit of equal cost is the beginning of another.

A conversation streams through its task in order twice, by one shuffle: first narrow rows, of which a letter each is
kept for the lattice, then the texts, edited and hashed as they come. Long conversations are cut into slices of SLICE
rows: from the last slice on each slice is solved from every state, with the cost of the rest as the price of leaving it.
What a task holds of a conversation is its audit, four letters a row while it is being decided, and one text.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of texts.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of one slice of the lattice.
SLICE = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn; the last and first accept.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
ROLE_AT = {1: "system", 2: "user", 3: "assistant"}
ACCEPTING = (0, 3)
NEVER = 1 << 60
END = tuple(0 if q in ACCEPTING else NEVER for q in range(4))

#: Bits of a row's code: its role's initial (index into INITIALS), then its faults.
INITIALS = "suax"
BLANK, CUT, SEEN, GONE = 4, 8, 16, 32


@lru_cache(maxsize=1 << 14)
def cheapest(turns: str, state: int = 0, ends: tuple[int, ...] = END, last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest edits of ``turns`` from ``state``; of equal costs the ASCII-least audit.

    A turn is a letter of its role's initial (s, u, a or x), upper case if it is truncated, or - if it has to go.
    ``ends`` prices leaving in each state. Where ``last`` is false more turns follow, and what may be inserted before
    them belongs to them.
    """
    n, heap, settled = len(turns), [(0, "", 0, state)], set()
    while heap:
        cost, audit, at, q = heapq.heappop(heap)
        if at > n:
            return cost, audit, q
        if (at, q) in settled:
            continue
        settled.add((at, q))
        if at == n:
            if ends[q] < NEVER:
                heapq.heappush(heap, (cost + ends[q], audit, n + 1, q))
            if not last:
                continue
        else:
            turn = turns[at]
            heapq.heappush(heap, (cost + DELETE, audit + "D", at + 1, q))
            if turn != "-":
                own = cost + (TRUNCATED if turn.isupper() else 0)
                if (to := KEPT[q].get(turn.lower())) is not None:
                    heapq.heappush(heap, (own, audit + "K", at + 1, to))
                heapq.heappush(heap, (own + REROLE, audit + "R", at + 1, FORCED[q]))
        heapq.heappush(heap, (cost + INSERT, audit + "I", at, FORCED[q]))
    raise AssertionError("deleting and inserting always end")


def plan(turns: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, slice by slice from its end."""
    cuts = [turns[at : at + SLICE] for at in range(0, len(turns), SLICE)] or [""]
    ends, solved = END, []
    for k in range(len(cuts) - 1, -1, -1):
        own = [cheapest(cuts[k], q, ends, k == len(cuts) - 1) for q in range(4 if k else 1)]
        solved.append(own)
        ends = tuple(o[0] for o in own)
    state, audit = 0, []
    for own in reversed(solved):
        audit.append(own[state][1])
        state = own[state][2]
    return ends[0], "".join(audit)


class _Talk:
    """One conversation on its way through a task: rows in order, then texts in the same order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.audit, self.cost = conv_id, [], None, 0
        self.low = self.high = self.turn = self.digest = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.at = self.state = self.place = 0
        self.initial = ""

    def row(self, turn, digest, code) -> None:
        if code & GONE:
            return
        again = bool(self.turns) and turn == self.turn and digest == self.digest
        if turn is not None and (self.high is None or turn != self.high):
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        initial = INITIALS[code & 3]
        self.illegal += bool(self.turns) and self.initial + initial not in ("su", "ua", "au")
        self.turn, self.digest, self.initial = turn, digest, initial
        if code & BLANK:
            self.blank += 1
        elif again or code & SEEN:
            self.duplicate += 1
        else:
            self.truncated += bool(code & CUT)
            self.turns.append(initial.upper() if code & CUT else initial)
            return
        self.turns.append("-")

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = plan("".join(self.turns))
            self.turns = []

    def _put(self, edit, role, text):
        self.place += 1
        return self.place - 1, edit, role, text

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, FORCED[self.state]
            yield self._put("I", ROLE_AT[self.state], "")

    def text(self, role, text, code):
        """What stands in the repaired conversation up to this row: (place, edit, role, text)."""
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[self.state][INITIALS[code & 3]]
            yield self._put("K", role, text)
        elif edit == "R":
            self.state = FORCED[self.state]
            yield self._put("R", ROLE_AT[self.state], text)

    def rest(self):
        self.decide()
        return self._inserted()

    def summary(self, digest: str) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, digest


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"
_TYPES = {"long": pa.int64(), "string": pa.string()}
#: Rows and bytes of text of one batch of results.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20


def _walk(batches, whole_turns: bool):
    """Summaries, or the turns of the repaired conversations, of rows sorted by conversation, kind and order."""
    fields = [f.split() for f in (TURNS if whole_turns else SUMMARY).split(", ")]
    schema, out, held, talk, sha = pa.schema([(n, _TYPES[t]) for n, t in fields]), [], 0, None, None

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def take(turns):
        size = 0
        for place, edit, role, text in turns:
            if whole_turns:
                out.append((talk.conv_id, place, edit, role, text))
                size += len(text) + len(role)
            else:
                sha.update((("\n" if place else "") + role + ":" + text).encode())
        return size

    def ended():
        size = take(talk.rest())
        if not whole_turns:
            out.append(talk.summary(sha.hexdigest()))
            size += len(talk.audit)
        return size

    for rows in batches:
        for conv_id, kind, turn, digest, code, role, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if talk is None or conv_id != talk.conv_id:
                held += ended() if talk else 0
                talk, sha = _Talk(conv_id), hashlib.sha256()
            if kind == 0:
                talk.row(turn, digest, code)
            else:
                talk.decide()
                held += take(talk.text(role, text, code))
            if len(out) >= OUT_ROWS or held >= OUT_BYTES:
                if out:
                    yield batch()
                out, held = [], 0
    if talk:
        ended()
    if out:
        yield batch()


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of ``convs`` damaged by crc32(``conv_id:turn``) % 20, nulls as one space there and in role and text.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it
    a user's. Dropped rows stay as rows whose ``present`` is false, so that their conversation is known.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(by == 1, "").when(by == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    rows = convs.select("conv_id", "turn", F.when(by == 4, "user").otherwise(name("role")).alias("role"), text.alias("text"), (by != 0).alias("present"), by.alias("by"))
    return rows.withColumn("copy", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("by", "copy")


def _ordered(rows: DataFrame, present: Column) -> DataFrame:
    """Each row twice, narrow and with its text, sorted by conversation, kind and order."""
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), present.alias("present"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 32))
    body, start = F.rtrim(F.col("text"), F.lit(SPACE)), F.substring("role", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    faults = F.when(body == "", BLANK).when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    coded = base.select("conv_id", "turn", "role", "text", digest.alias("digest"), (initial + faults + F.when(F.col("present"), 0).otherwise(GONE)).alias("code"))
    rank = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = coded.filter(F.col("code") < GONE).groupBy("conv_id", "digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest"), "first")
    narrow = coded.drop("text").join(first, F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("digest") == F.col("first_digest")), "left")
    seen = F.when(F.col("first").isNotNull() & (rank > F.col("first")), SEEN).otherwise(0)
    narrow = narrow.select("conv_id", F.lit(0).alias("kind"), "turn", "digest", (F.col("code") + seen).alias("code"), "role", F.lit(None).cast("string").alias("text"))
    both = narrow.unionByName(coded.filter(F.col("code") < GONE).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "code", "role", "text"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")


def repaired(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``): SUMMARY's columns.

    Rows stand by turn, nulls first; ties by role, then by a digest of role and text. A null role or text is one space. A
    row's first fault counts: blank, duplicate (role and text seen earlier), truncated. Roles count by their first
    letter. ``gaps`` ignores null turns; a null ``conv_id`` is a conversation of its own. Rows where ``present`` doesn't
    hold only name their conversation; one without other rows has zeros, an empty audit and the hash of nothing. Other
    columns are ignored; an empty table gives an empty result.
    """
    return _ordered(rows, F.lit(True) if present is None else present).mapInArrow(lambda b: _walk(b, False), SUMMARY)


def repaired_turns(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, place`` (from 0), the ``edit`` that put it there, ``role, text``.

    Conversations whose rows all go have none.
    """
    return _ordered(rows, F.lit(True) if present is None else present).mapInArrow(lambda b: _walk(b, True), TURNS)
