"""Faults in the turns of an investigation's exchange of messages, and the cheapest edits that make it well-formed.

Two secondary-sorted streams. The first deals the messages without their text by user and sorts them from the last turn to the
first; it carries the least cost of well-forming all later turns from each state of the wanted order, across Arrow batches, and
keeps two bytes of choices (three bits a state) for every message. At a user's first message the choices are followed in the turns'
order. A giant exchange spills its choices to a file of the task. The second stream deals the texts by user, sorts them by turn
behind the user's edits, and applies them, holding one message at a time.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.llm.common import WHITE, slices
from fraudloom.session import materialize

#: Costs of editing a message, and of leaving one that breaks off.
DELETE, REROLE, INSERT, BROKEN = 4, 3, 3, 3
#: States of the wanted order ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a message of the fitting role, user or assistant, leads to from each state; and from which states a role fits.
FITTING = (USER, USER, ASSISTANT, USER)
FITS = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
#: Choices in the order in which ties are broken: delete, insert, keep, keep a system message at the start, change the role.
EDITS = "DIKKR"
LEGAL = ("su", "ua", "au")
SPILL = 1 << 21  # choices held before they go to a file
_FAR = 1 << 40


def _least(base: list[tuple[int, int]]) -> tuple[tuple[int, ...], int, int]:
    """Relative costs by state, the least cost, and choices, once messages may be inserted before; ``base``: (cost, choice) otherwise."""
    best = list(base)
    for _ in range(2):  # a third insertion in a row would come back to a state
        best = [min(best[s], (INSERT + best[FITTING[s]][0], 1)) for s in range(4)]
    low = min(c for c, _ in best)
    return tuple(c - low for c, _ in best), low, sum(choice << 3 * s for s, (_, choice) in enumerate(best))


def ending() -> tuple[tuple[int, ...], int, int]:
    """Behind the last message: an exchange may end with nothing or after the assistant."""
    return _least([(0 if s in (START, ASSISTANT) else _FAR, 0) for s in range(4)])


@cache
def step(after: tuple[int, ...], role: str, must_go: bool, broken: bool) -> tuple[tuple[int, ...], int, int]:
    """What holds before a message, given the relative costs behind it. Costs differ by a few units, so few cases are ever computed."""
    base = []
    for s in range(4):
        edits, extra = [(DELETE + after[s], 0)], BROKEN if broken else 0
        if not must_go:
            edits.append((REROLE + extra + after[FITTING[s]], 4))
            if s in FITS.get(role, ()):
                edits.append((extra + after[FITTING[s]], 2))
            if role == "s" and s == START:
                edits.append((extra + after[SYSTEM], 3))
        base.append(min(edits))
    return _least(base)


class Choices:
    """Two bytes a message in the order they come, read from the last to the first; beyond ``spill`` they go to a file of the task."""

    def __init__(self, spill: int = SPILL) -> None:
        self.held, self.file, self.blocks, self.spill = array("H"), None, 0, spill

    def add(self, choice: int) -> None:
        self.held.append(choice)
        if len(self.held) >= self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.held.tofile(self.file)
            self.held, self.blocks = array("H"), self.blocks + 1

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.held)
        for block in range(self.blocks - 1, -1, -1):
            self.file.seek(block * 2 * self.spill)
            held = array("H")
            held.fromfile(self.file, self.spill)
            yield from reversed(held)


class Exchange:
    """One user's messages, met from the last to the first: counts, least costs so far, and choices."""

    def __init__(self, user, spill: int = SPILL) -> None:
        self.user, self.choices = user, Choices(spill)
        self.costs, self.total, _ = ending()
        self.turn = self.high = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role: str, blank: bool, broken: bool, known: bool, copies: int) -> None:
        """A message met ``copies`` times at one turn; ``known`` if an earlier turn has it too."""
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.high = turn if self.high is None else self.high
        initial = role[:1]
        for copy in range(copies, 0, -1):
            again = not blank and (known or copy > 1)
            self.blank += blank
            self.duplicate += again
            self.truncated += broken and not blank and not again
            self.illegal += self.initial is not None and initial + self.initial not in LEGAL
            self.initial = initial
            self.costs, more, choice = step(self.costs, initial, blank or again, broken)
            self.total += more
            self.choices.add(choice)

    def summary(self) -> tuple:
        edits, state = [], START
        for choice in self.choices.backwards():
            while (edit := choice >> 3 * state & 7) == 1:
                edits.append("I")
                state = FITTING[state]
            edits.append(EDITS[edit])
            state = state if edit == 0 else SYSTEM if edit == 3 else FITTING[state]
        while state not in (START, ASSISTANT):
            edits.append("I")
            state = FITTING[state]
        gaps = self.high - self.turn + 1 - self.turns if self.turns else 0
        return self.user, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.total + self.costs[START], "".join(edits)


def _last_sign(content: Column) -> Column:
    return F.right(F.rtrim(content, F.lit(WHITE)), F.lit(1))


def exchange_faults(messages: DataFrame) -> DataFrame:
    """One row per user: faults, and the cheapest edits, of the user's messages (see ``repair_exchanges``).

    Columns: ``user_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` (longs) and ``audit``.
    """
    spark, user = messages.sparkSession, messages.schema["user_id"].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = _last_sign(F.col("content"))
    kept = messages.select("user_id", F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("content", 256)).alias("digest"),
                           (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("broken")).repartition(n, "user_id")
    # All below stays where the user's messages are: copies at one turn fold, and an earlier turn with the same message shows.
    once = kept.groupBy("user_id", "turn", "role", "digest", "blank", "broken").agg(F.count(F.lit(1)).alias("copies"))
    seen = Window.partitionBy("user_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = once.withColumn("known", F.row_number().over(seen) > 1)
    order = ["user_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("digest")]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Exchange | None = None
        for batch in batches:
            done = []
            for user_id, *message in zip(*[c.to_pylist() for c in batch.columns]):
                if at is None or user_id != at.user:
                    done += [at.summary()] if at else []
                    at = Exchange(user_id)
                at.add(*message)
            yield _rows(done)
        if at:
            yield _rows([at.summary()])

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = {"user_id": to_arrow_type(user), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string()}

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], list(kinds))

    kind = f"user_id {user.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
    sorted_rows = marked.sortWithinPartitions(*order).select("user_id", "turn", "role", "blank", "broken", "known", "copies")
    return sorted_rows.mapInArrow(stream, kind)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def apply_edits(messages: DataFrame, faults: DataFrame) -> DataFrame:
    """The messages after the edits of ``audit``, in order: ``user_id``, ``position``, ``turn``, ``role``, ``content``, ``edit``.

    Inserted messages have a null ``turn``, the role that the order wants and no text; deleted ones are left out. Rows of one user
    stand together in one partition, by position.
    """
    user, n = messages.schema["user_id"].dataType, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = messages.select("user_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", F.unhex(F.sha2("content", 256)).alias("digest"), "content")
    plans = faults.select("user_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("binary"), F.col("audit"))
    order = ["user_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = texts.union(plans.toDF(*texts.columns)).repartition(n, "user_id").sortWithinPartitions(*order)

    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(user), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["user_id", "position", "turn", "role", "content", "edit"]

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        user_id, edits, at, position, state = None, "", 0, 0, START

        def put(turn, role: str, content: str, edit: str) -> None:
            nonlocal position, state
            out.append((user_id, position, turn, role, content, edit))
            position, state = position + 1, SYSTEM if edit == "K" and role[:1] == "s" else FITTING[state]

        def wanted() -> str:
            return "assistant" if state == USER else "user"

        def insert() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                put(None, wanted(), "", "I")
                at += 1

        for batch in batches:
            for part in slices(batch):
                for user_id_, kind, turn, role, content in zip(*[c.to_pylist() for c in part.columns]):
                    if kind == 0:
                        insert()
                        user_id, edits, at, position, state = user_id_, content, 0, 0, START
                        continue
                    insert()
                    edit, at = edits[at], at + 1
                    if edit == "K":
                        put(turn, role, content, edit)
                    elif edit == "R":
                        put(turn, wanted(), content, edit)
                columns, out = list(zip(*out)) or [()] * len(kinds), []
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        insert()
        columns = list(zip(*out)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = f"user_id {user.simpleString()}, position long, turn long, role string, content string, edit string"
    return dealt.select("user_id", "kind", "turn", "role", "content").mapInArrow(stream, kind)


def exchange_digest(repaired: DataFrame) -> DataFrame:
    """(``user_id``, ``digest``): SHA-256 in lowercase hex of a user's ``role:content``, joined by newlines.

    ``repaired`` must come from ``apply_edits`` (rows of a user together, in order); one message is held at a time.
    """
    user = repaired.schema["user_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(user)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = None
        at, held = None, False

        def rows(done: list[tuple]) -> pa.RecordBatch:
            users, digests = zip(*done) if done else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(users, arrow), pa.array(digests, pa.string())], ["user_id", "digest"])

        for batch in batches:
            done = []
            for part in slices(batch):
                for user_id, position, role, content in zip(*[c.to_pylist() for c in part.columns]):
                    if position == 0:
                        done += [(at, made.hexdigest())] if held else []
                        at, held, made = user_id, True, hashlib.sha256()
                    made.update(f"{chr(10) if position else ''}{role}:{content}".encode())
            yield rows(done)
        if held:
            yield rows([(at, made.hexdigest())])

    return repaired.select("user_id", "position", "role", "content").mapInArrow(stream, f"user_id {user.simpleString()}, digest string")


def _plain(messages: DataFrame) -> DataFrame:
    return messages.select("user_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                           F.coalesce(F.col("content").cast("string"), F.lit(" ")).alias("content"))


def repair_exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults of every user's exchange (``exchange_faults``) and the repaired exchanges (``apply_edits``).

    ``messages``: ``user_id`` (any type), ``turn`` (integer), ``role``, ``content``: what an investigation of a user exchanges with a
    model. The engine stores no such messages today, only the fields they are made of, so any other table with these four works as
    well. Other columns are left out.

    Messages stand by turn (null first), then role, then digest of the content. A message's first fault counts: blank (nothing but
    ``[\x20\x09-\x0D]``), duplicate (role and content met earlier), truncated (the last other sign is none of ``.!?``). ``gaps`` is the
    number of turns missing between the first and the last; ``illegal`` counts neighbours whose roles' initials are not su, ua or au.
    The edits are the cheapest that give initials ``(s?(ua)+)?``: keep (0), change the role to user or assistant (3), delete (4; blank
    and duplicate messages must go), insert an empty message of user or assistant (3); a truncated message that stays adds 3.
    ``audit`` has the edits' initials in order; of equal costs, the least in ASCII order. A role without an initial of s, u or a, the
    empty one included, cannot be kept.

    Null roles and contents are one space; null users form one exchange. Repeated rows are duplicates. A user whose messages all go has no
    repaired row; an empty table gives empty results. A user's messages are streamed through one task without being held.
    """
    plain = _plain(messages)
    faults = materialize(exchange_faults(plain), "exchange-faults")
    return faults, apply_edits(plain, faults)
