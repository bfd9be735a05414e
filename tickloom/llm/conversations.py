"""Repair of conversations: the cheapest edits that make the roles follow ``(s?(ua)+)?``.

A row of a conversation is blank (no visible character), a duplicate (role and text as an earlier row) or truncated (no
full stop, exclamation or question mark at its end); the first fault counts. Edits are Keep (0), Rerole to user or
assistant (3), Delete (4, required for blank rows and duplicates) and Insert of an empty message (3); a truncated row that is
not deleted costs 3 more. Of equally cheap edits those count whose initials come first in ASCII.

The search is a depth-first branch-and-bound over (row, state of the pattern): an explicit stack, lower bounds for every
suffix from a backward pass over costs, the incumbent as (cost, audit), and a dominance table that keeps the best prefix of
every node and drops others. A node leaves the stack when its prefix is dominated or its cost and bound exceed the
incumbent; the incumbent is proved when the stack is empty.

A conversation's rows come sorted through one task as a stream, because a hash of the repaired text depends on all of it in
order. Up to ``SEGMENT`` rows are searched at once. A longer conversation is searched segment by segment: from each state
that can be reached to each state at the segment's end, prefixes joined by the same order; edits of equal cost are never
prefixes of each other, so this gives the same result. What stays in memory then is a segment, four prefixes (a character per
row and a running hash) and 16 bytes per distinct message, whatever the size of the texts.

Odd rows: nulls in role and text become one space, so they are blank or have no usable role; null turns come first and
count for no gap; a null conversation is one conversation. Rows of one turn are taken by role and text. A conversation
none of whose rows is ``present`` has zeros, an empty audit and an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import ship

ship(__name__)

RAW_SPACE = "\t\n\x0b\x0c\r "
ENDS = ".!?"
RED, DEL, INS, TRUNCATED = 3, 4, 3, 3
SEGMENT = 256
KNOWN = 100_000  # results of searches that a task remembers; conversations with the same faults and roles share one

# States of the pattern: 0 nothing yet, 1 after the system message, 2 after user, 3 after assistant.
ACCEPT = (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WANTED = ("u", "u", "a", "u")  # the only role of user and assistant that may follow a state
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60


def edits_at(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of what can be done with a row in a state.

    A code is ``D`` for a row that has to go, else the initial of its role (``o`` for others), a capital if truncated.
    """
    yield "D", DEL, state
    if code == "D":
        return
    extra = TRUNCATED if code.isupper() else 0
    after = NEXT.get((state, code.lower()))
    if after is not None:
        yield "K", extra, after
    target = WANTED[state]
    if code.lower() != target:  # to change a role to itself is never cheapest
        yield "R", RED + extra, NEXT[state, target]


def suffix_bounds(codes: str, goal: Sequence[int], trailing: bool) -> list[list[int]]:
    """For every row and state what the rest costs at least to reach a state of ``goal``; it knows nothing of ties."""
    def with_inserts(row: list[int]) -> list[int]:
        for _ in range(2):
            row = [min(row[s], INS + row[NEXT[s, WANTED[s]]]) for s in range(4)]
        return row

    last = [0 if s in goal else FAR for s in range(4)]
    bounds = [with_inserts(last) if trailing else last]
    for code in reversed(codes):
        row = [min(cost + bounds[-1][after] for _, cost, after in edits_at(code, s)) for s in range(4)]
        bounds.append(with_inserts(row))
    return bounds[::-1]


def search(codes: str, start: int, goal: Sequence[int], trailing: bool) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``start`` to a state of ``goal`` over all rows.

    Without ``trailing`` nothing is inserted after the last row.
    """
    bounds, rows = suffix_bounds(codes, goal, trailing), len(codes)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bounds[i][state]
        if least >= FAR or (best and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)]))):
            continue
        if (i, state) in reached and reached[i, state] <= (cost, audit):
            continue
        reached[i, state] = (cost, audit)
        if i == rows and state in goal and (best is None or (cost, audit) < best):
            best = (cost, audit)
        steps = [] if i == rows else [(letter, paid, after, i + 1) for letter, paid, after in edits_at(codes[i], state)]
        if i < rows or trailing:
            steps.append(("I", INS, NEXT[state, WANTED[state]], i))
        # The stack gives the last one first: promising before dear, then by letter.
        steps.sort(key=lambda step: (step[1] + bounds[step[3]][step[2]], step[0]), reverse=True)
        stack += [(to, after, cost + paid, audit + letter) for letter, paid, after, to in steps]
    return best


def applied(messages: Sequence[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves, from a state on."""
    rows = iter(messages)
    for letter in audit:
        if letter == "I":
            target = WANTED[state]
            yield letter, NAMES[target], ""
            state = NEXT[state, target]
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else WANTED[state]
        yield letter, role if letter == "K" else NAMES[initial], text
        state = NEXT[state, initial]


def code_of(role: str, text: str, seen: set[bytes]) -> tuple[str, str | None]:
    """The code of a row and its fault; remembers the row in ``seen``."""
    mark = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    known = mark in seen
    seen.add(mark)
    visible = text.rstrip(RAW_SPACE)
    if not visible:
        return "D", "blank"
    if known:
        return "D", "duplicate"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return (initial, None) if visible[-1] in ENDS else (initial.upper(), "truncated")


class _Text:
    """The hash of the repaired text so far; copies are cheap."""

    def __init__(self, hasher=None, begun: bool = False):
        self.hasher, self.begun = hasher or sha256(), begun

    def followed(self, rows: Iterator[tuple[str, str, str]]) -> _Text:
        after = _Text(self.hasher.copy(), self.begun)
        for _, role, text in rows:
            after.hasher.update(b"\n" * after.begun + f"{role}:{text}".encode())
            after.begun = True
        return after

    def result(self) -> str:
        return self.hasher.hexdigest()


class _Messages:
    """The repaired messages so far."""

    def __init__(self, rows: tuple = ()):
        self.rows = rows

    def followed(self, rows: Iterator[tuple[str, str, str]]) -> _Messages:
        return _Messages((*self.rows, *rows))

    def result(self) -> list[dict]:
        return [{"edit": e, "role": r, "text": t} for e, r, t in self.rows]


class Conversation:
    """One conversation, fed row by row in order."""

    def __init__(self, output, known: dict, segment: int = SEGMENT):
        self.known, self.segment, self.seen, self.codes, self.rows = known, segment, set(), "", []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.lowest = self.highest = None
        self.turns = 0
        # The best prefix that ends in each state: cost, audit, repaired text.
        self.prefixes = {0: (0, "", output())}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if len(self.rows) == self.segment:
            self._join({s: (s,) for s in range(4)}, False)
        code, fault = code_of(role, text, self.seen)
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.lowest = turn if self.lowest is None else self.lowest
            self.turns += turn != self.highest
            self.highest = turn
        self.codes += code
        self.rows.append((role, text))

    def _join(self, goals: dict, trailing: bool) -> None:
        """Continue every prefix over the rows at hand; the least one per goal stays."""
        least = {}
        for state, (cost, audit, output) in self.prefixes.items():
            for name, goal in goals.items():
                found = self._found(state, goal, trailing)
                if found and (name not in least or (cost + found[0], audit + found[1]) < least[name][:2]):
                    least[name] = (cost + found[0], audit + found[1], state, found[1], output)
        self.prefixes = {
            name: (cost, audit, output.followed(applied(self.rows, edits, state)))
            for name, (cost, audit, state, edits, output) in least.items()
        }
        self.codes, self.rows = "", []

    def _found(self, state: int, goal: tuple[int, ...], trailing: bool) -> tuple[int, str] | None:
        key = (self.codes, state, goal, trailing)
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = search(*key)
        return self.known[key]

    def finish(self) -> dict:
        self._join({"end": ACCEPT}, True)
        cost, audit, output = self.prefixes["end"]
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired": output.result()}


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, messages: bool = False, segment: int = SEGMENT,
) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    ``repaired`` is the SHA-256 of the repaired ``role:text`` lines, or with ``messages`` the list of (edit, role, text), which
    then is held in memory as a whole. Rows whose column ``present`` is not true only name their conversation.
    """
    kept = F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))
    blank = F.lit(" ")
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, blank).alias("role"),
        F.coalesce(text, blank).alias("text"), kept.alias("present"),
    )
    # Nulls of a conversation's id sort together, and so do the rows of each.
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    together = plain.repartition("conv_id").sortWithinPartitions(*order)
    out = T.ArrayType(T.StructType.fromDDL("edit string, role string, text string")) if messages else T.StringType()
    schema = T.StructType([
        T.StructField("conv_id", rows.schema[conv_id].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("audit", T.StringType()), T.StructField("repaired", out),
    ])
    names = [f.name for f in schema]
    output = _Messages if messages else _Text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, done, known, kind = None, None, [], {}, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present")]
            for conv, at, who, said, there in zip(*columns):
                if now is None or conv != key:
                    if now is not None:
                        done.append({"conv_id": key, **now.finish()})
                    key, now = conv, Conversation(output, known, segment)
                if there:
                    now.add(at, who, said)
            if done:
                yield _batch(done, kind, names, messages)
                done = []
        if now is not None:
            yield _batch([{"conv_id": key, **now.finish()}], kind, names, messages)

    return together.mapInArrow(run, schema)


def _batch(done: list[dict], kind: pa.DataType, names: Sequence[str], messages: bool) -> pa.RecordBatch:
    repaired = pa.list_(pa.struct([(c, pa.string()) for c in ("edit", "role", "text")])) if messages else pa.string()
    types = {"conv_id": kind, "audit": pa.string(), "repaired": repaired}
    return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], types.get(n, pa.int64())) for n in names], names=list(names))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in four damaged, as crc32 of ``conv_id:turn`` modulo 20 says: (conv_id, turn, role, text, present).

    0 drops a row (``present`` is false), 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3
    repeats it, 4 makes it the user's. Nulls become one space, in the text that is hashed too.
    """
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    marked = rows.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
        (F.crc32(named.cast("binary")) % 20).cast("int").alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), F.explode(copies).alias("copy")
    ).drop("copy")
