"""Repair of conversation structure by a generalised LR parse with edits.

The rows of a conversation, in order of turn, should read as an optional system
message and then pairs of a user's and an assistant's message. The role grammar

    C -> (empty) | P | s P        P -> u a | P u a

is parsed by its LR tables on a graph-structured stack. Before and after every
row the parser may also insert a user's or an assistant's message of no text;
a row is kept, given another role or deleted. Each of these is a weighted edit,
so the stack forks, and equal tops meet again as the one with the least (cost,
audit), where the audit is the string of the edits' initials: what can follow a
top depends on its state alone, and with equal costs no audit of the same rows
begins another one, so the rest cannot change the order of the two. A stack is
at most four entries high and there are six states to stand on, whatever the
length of the conversation. A top also carries the running SHA-256 of what it
has said, so a conversation is read once, row by row, and never held.

Faults of a row, the first that applies: ``blank`` (no character but white
space), ``duplicate`` (role and text seen in an earlier row), ``truncated``
(ends in none of ``.!?``). Blank and duplicate rows must be deleted; a truncated
row that stays costs extra.

Rows are dealt by conversation and sorted by Spark, which spills. One
conversation is read by one task, since its digest is a chain over its rows; the
task holds its audit (a letter a row) and 16 bytes of each row to know duplicates.

Defined results: a null role or text is one space; a null turn sorts first and
counts in no gap; rows of the same turn are taken by role, then text, so
repeated rows stand next to each other; a null conversation is one of its own; a
role's initial is its first character, and an empty role has none; a
conversation without rows (all dropped) has zeros, an empty audit and the hash of
the empty string; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, read, short_batches
from tidewater.llm.registry import register

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ENDS = ".!?"
ROLES = {"u": "user", "a": "assistant"}

#: LR tables of the role grammar: what a state shifts to, how many entries the
#: rule of a complete state takes off, where P leads from the entry below it,
#: and where the input may end.
SHIFT = {0: {"s": 1, "u": 3}, 1: {"u": 3}, 2: {"u": 5}, 3: {"a": 6}, 4: {"u": 5}, 5: {"a": 7}}
REDUCE = {6: 2, 7: 3}
GOTO = {0: 2, 1: 4}
FINAL = (0, 2, 4)

OUT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
       "audit string, repaired_sha256 string")


class Edit:
    """The last edit of an audit, and what came before it."""

    __slots__ = ("before", "letter", "depth")

    def __init__(self, before: Edit | None, letter: str):
        self.before, self.letter, self.depth = before, letter, before.depth + 1 if before else 1


def spell(edit: Edit | None) -> str:
    letters = []
    while edit:
        letters.append(edit.letter)
        edit = edit.before
    return "".join(reversed(letters))


def comes_first(a: Edit | None, b: Edit | None) -> bool:
    """Whether audit ``a`` sorts before ``b``; audits share their beginnings, so
    only what lies behind the fork is looked at."""
    long = (a.depth if a else 0) - (b.depth if b else 0)
    for _ in range(long):
        a = a.before
    for _ in range(-long):
        b = b.before
    first = long < 0  # of two that agree so far, the shorter
    while a is not b:
        if a.letter != b.letter:
            first = a.letter < b.letter
        a, b = a.before, b.before
    return first


class Top:
    """A top of the stack: LR state, the entry below, the least cost, its audit
    and the digest of what it says (``any``: says anything)."""

    __slots__ = ("state", "below", "cost", "audit", "said", "any")

    def __init__(self, state, below, cost, audit, said, any_):
        self.state, self.below, self.cost, self.audit, self.said, self.any = state, below, cost, audit, said, any_


def shift(top: Top, token: str) -> tuple[int, Top] | None:
    """The state after a token and the entry it stands on, complete rules
    reduced; none if the token cannot follow."""
    state, below = SHIFT[top.state].get(token), top
    if state is None:
        return None
    if state in REDUCE:
        for _ in range(REDUCE[state] - 1):
            below = below.below
        state = GOTO[below.state]
    return state, below


class Parser:
    """The tops between two rows, by state."""

    def __init__(self):
        self.tops = {0: Top(0, None, 0, None, hashlib.sha256(), False)}
        self._insert()

    @staticmethod
    def _offer(tops: dict, state: int, below, cost: int, before: Edit | None, letter: str, source: Top, role: str | None) -> bool:
        """Put a top in its place unless the one there is better. ``role`` is
        that of the message it adds to ``source``; none adds none."""
        old = tops.get(state)
        if old is not None and cost > old[0]:
            return False
        audit = Edit(before, letter)
        if old is not None and cost == old[0] and not comes_first(audit, old[1]):
            return False
        tops[state] = (cost, audit, below, source, role)
        return True

    @staticmethod
    def _said(source: Top, role: str | None, text: str):
        if role is None:
            return source.said, source.any
        said = source.said.copy()
        said.update(f"{chr(10) if source.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        return said, True

    def _insert(self) -> None:
        """Insert messages wherever that reaches a state at less than it has."""
        todo = sorted(self.tops.values(), key=lambda t: t.cost)
        while todo:
            top = todo.pop(0)
            if self.tops[top.state] is not top:
                continue
            for token in SHIFT[top.state]:
                if token not in ROLES:
                    continue
                state, below = shift(top, token)
                here = {state: (old.cost, old.audit)} if (old := self.tops.get(state)) else {}
                if self._offer(here, state, below, top.cost + INSERT, top.audit, "I", top, ROLES[token]):
                    cost, audit, below, source, role = here[state]
                    self.tops[state] = Top(state, below, cost, audit, *self._said(source, role, ""))
                    todo.append(self.tops[state])

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        extra = TRUNCATED if truncated else 0
        offers: dict = {}
        for top in self.tops.values():
            self._offer(offers, top.state, top.below, top.cost + DELETE, top.audit, "D", top, None)
            if must_go:
                continue
            for token in SHIFT[top.state]:
                state, below = shift(top, token)
                if token == role[:1]:
                    self._offer(offers, state, below, top.cost + extra, top.audit, "K", top, role)
                if token in ROLES:
                    self._offer(offers, state, below, top.cost + REROLE + extra, top.audit, "R", top, ROLES[token])
        self.tops = {state: Top(state, below, cost, audit, *self._said(source, to, text))
                     for state, (cost, audit, below, source, to) in offers.items()}
        self._insert()

    def best(self) -> Top:
        ends = [self.tops[s] for s in FINAL if s in self.tops]
        best = ends[0]
        for top in ends[1:]:
            if top.cost < best.cost or top.cost == best.cost and comes_first(top.audit, best.audit):
                best = top
        return best


class Conversation:
    """What is known of a conversation after the rows read so far."""

    def __init__(self, conv_id):
        self.conv_id, self.parser, self.seen = conv_id, Parser(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def row(self, turn, role: str, text: str, blank: bool, truncated: bool) -> None:
        if turn is not None:
            if self.turns == 0:
                self.first = turn
            if self.turns == 0 or turn != self.last:
                self.turns += 1
            self.last = turn
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        again = key in self.seen
        self.seen.add(key)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.parser.row(role, text, blank or again, truncated and not (blank or again))

    def result(self) -> tuple:
        best = self.parser.best()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, spell(best.audit),
                best.said.hexdigest())


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in OUT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    now, done = None, []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there", "blank", "truncated")]
        for conv_id, turn, role, text, there, blank, truncated in zip(*cols, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if there:
                now.row(turn, role, text, blank, truncated)
        if done:
            yield batch()
            done = []
    if now is not None:
        done.append(now.result())
        yield batch()


def _in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and there (false: a row that only names its
    conversation), without nulls but those of id and turn."""
    there = F.col("there") if "there" in rows.columns else F.lit(True)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), there.alias("there"))


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of a table conv_id,
    turn, role, text (and ``there``, see :func:`damage`)."""
    short_batches(rows.sparkSession)
    words = F.btrim(F.col("text"), F.lit(SPACES))
    marked = _in_order(rows).withColumns({
        "blank": words == "", "truncated": F.instr(F.lit(ENDS), F.right(words, F.lit(1))) == 0})
    dealt = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_repair, OUT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, edits, at, place, last = None, "", 0, 0, ""
    for b in batches:
        out = []

        def say(role, text, conv_id):
            nonlocal place, last
            out.append((conv_id, place, role, text))  # noqa: B023
            place, last = place + 1, role[:1]

        def insert(conv_id):
            nonlocal at
            while edits[at:at + 1] == "I":
                at += 1
                say("assistant" if last == "u" else "user", "", conv_id)

        cols = [b.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")]
        for conv_id, audit, role, text in zip(*cols, strict=True):
            if audit is not None:
                conv, edits, at, place, last = conv_id, audit, 0, 0, ""
                insert(conv)
                continue
            edit = edits[at]
            at += 1
            if edit != "D":
                say(role if edit == "K" else "assistant" if last == "u" else "user", text, conv)
            insert(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The messages of the repaired conversations: conv_id, place, role, text.
    ``verdicts`` is what :func:`repair` says of ``rows``; each conversation's
    audit is dealt to it as a row that stands before its own."""
    short_batches(rows.sparkSession)
    own = _in_order(rows).filter("there").drop("there").withColumn("audit", F.lit(None).cast("string"))
    heads = verdicts.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    dealt = own.unionByName(heads).withColumn("kind", F.col("audit").isNull())
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return dealt.mapInArrow(_apply, "conv_id bigint, place bigint, role string, text string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows broken by a hash of conversation and turn, with ``there``: false for
    a dropped row, which still names its conversation."""
    plain = _in_order(rows)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("there"), F.explode(times).alias("copy")).drop("copy")


@register("op13_conversation_repair")
def op13_conversation_repair(spark, sf_dir):
    """Every conversation, damaged and repaired."""
    return repair(damage(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
