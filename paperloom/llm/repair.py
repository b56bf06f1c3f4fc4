"""Repair of conversation structure by cheapest edits, with block tables for the dynamic programme."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.storage import written

#: White space, as the contract of the registered query has it, and what ends a text.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: What edits cost, and what a truncated turn adds that isn't deleted.
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A role that comes
#: next leads on; the one that may be inserted or set is the user's or, after a user, the assistant's.
STATES = 4
MOVES = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT = (2, 2, 3, 2)
SET = ("user", "user", "assistant", "user")
#: States in which a conversation may end.
FINAL = (0, 3)
#: Symbols of turns: "0" must go, then for each class of role a whole one and a truncated one; "9" is no turn.
CLASSES, PAD, SYMBOLS = "sua", 9, 10
#: Symbols of a block, turns of a segment at most, and characters that end one.
BLOCK, SEGMENT_TURNS, SEGMENT_CHARS = 4, 1_024, 4_000_000
NEVER = 10**9
SEGMENT = (
    "conv_id long, part int, seg int, symbols string, roles array<string>, texts array<string>, first_turn long, last_turn long, "
    "turns long, blank long, duplicate long, truncated long, illegal long, opens string, closes string"
)


def _closed(cost: list[int]) -> tuple[int, ...]:
    """The costs from each state on, if turns may be inserted first."""
    for _ in range(STATES):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return tuple(min(c, NEVER) for c in cost)


def _turn(symbol: int) -> tuple[str, int] | None:
    """(class of role, cost of staying) of a symbol, None if it must go."""
    return None if symbol == 0 else ((CLASSES + "?")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2))


def _before(cost: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs from each state on ahead of a turn, given those behind it."""
    if symbol == PAD:
        return cost
    kept, out = _turn(symbol), []
    for s in range(STATES):
        best = DELETE + cost[s]
        if kept:
            best = min(best, REROLE + kept[1] + cost[NEXT[s]])
            to = MOVES.get(kept[0], (None,) * STATES)[s]
            best = best if to is None else min(best, kept[1] + cost[to])
        out.append(best)
    return _closed(out)


class BlockTables:
    """Transitions of normalised cost vectors for every turn and for every block of BLOCK turns.

    A cost vector has the cheapest cost to the end from each state; its smallest entry is taken off
    and kept apart. Few vectors occur, as inserts bound what states can differ by, so a table of
    (vector, block) has the vector ahead of a block, and what is added, for the one behind it.
    """

    def __init__(self):
        self.end = _closed([0 if s in FINAL else NEVER for s in range(STATES)])
        units = [tuple(0 if s == to else NEVER for s in range(STATES)) for to in range(STATES)]
        self.vectors, self.number = [], {}
        todo = [self.add(v) for v in (self.end, *units)]
        steps, added = [], []
        while len(steps) < len(self.vectors):
            ahead = [_before(self.vectors[len(steps)], x) for x in range(SYMBOLS)]
            added.append([min(v) for v in ahead])
            steps.append([self.add(v) for v in ahead])
        self.first, self.units = todo[0], todo[1:]
        self.step, self.plus = np.array(steps, np.int32), np.array(added, np.int32)
        ahead, plus = self.step, self.plus  # blocks of one turn; a longer one is a turn ahead of a block
        for _ in range(BLOCK - 1):
            more = self.step[ahead]  # (vector, block, turn ahead of it)
            plus = plus[:, :, None] + self.plus[ahead]
            ahead, plus = (np.swapaxes(x, 1, 2).reshape(len(self.vectors), -1) for x in (more, plus))
        self.ahead, self.ahead_plus = ahead, plus

    def add(self, cost: tuple[int, ...]) -> int:
        """The number of a vector without its smallest entry."""
        least = min(cost)
        known = tuple(NEVER if c >= NEVER else c - least for c in cost)
        if known not in self.number:
            self.number[known] = len(self.vectors)
            self.vectors.append(known)
        return self.number[known]

    @staticmethod
    def blocks(symbols: str) -> list[int]:
        """The blocks of a row of symbols, as numbers; the last one is filled with no turns."""
        filled = symbols + str(PAD) * (-len(symbols) % BLOCK)
        return [int(filled[i : i + BLOCK]) for i in range(0, len(filled), BLOCK)]

    def behind(self, blocks: list[int], vector: int) -> tuple[list[int], int, int]:
        """From the last block to the first: (the vector behind each block, the one ahead of all, what is added)."""
        out, total = [0] * len(blocks), 0
        for i in range(len(blocks) - 1, -1, -1):
            out[i] = vector
            total += int(self.ahead_plus[vector, blocks[i]])
            vector = int(self.ahead[vector, blocks[i]])
        return out, vector, total

    def summary(self, symbols: str) -> list[int]:
        """What a row of turns costs from each state to each state, by rows of 4."""
        to = []
        for vector in self.units:
            _, ahead, total = self.behind(self.blocks(symbols), vector)
            to.append([NEVER if c >= NEVER else c + total for c in self.vectors[ahead]])
        return [to[j][s] for s in range(STATES) for j in range(STATES)]

    def ahead_of(self, summary: np.ndarray, vector: int) -> int:
        """The vector ahead of a row of turns with this summary, given the one behind it."""
        cost = summary.reshape(STATES, STATES) + np.array(self.vectors[vector])
        return self.add(tuple(min(int(c), NEVER) for c in cost.min(axis=1)))

    @lru_cache(maxsize=200_000)  # noqa: B019 - one instance a worker
    def trace(self, block: int, vector: int, state: int) -> tuple[str, int]:
        """(edits, state behind): the ASCII-least cheapest edits of a block from a state.

        The block is expanded again from the vector behind it. Going forwards, the first edit
        in ASCII order that leaves the remaining cost at its least is on the least cheapest way.
        """
        turns = [int(x) for x in f"{block:0{BLOCK}d}"]
        at = [vector]
        for x in reversed(turns):
            at.append(int(self.step[at[-1], x]))
        at.reverse()
        edits = ""
        for i, x in enumerate(turns):
            if x == PAD:
                continue
            here, behind, kept = self.vectors[at[i]], self.vectors[at[i + 1]], _turn(x)
            plus = int(self.plus[at[i + 1], x])
            while True:
                left = here[state] + plus
                to = MOVES.get(kept[0], (None,) * STATES)[state] if kept else None
                if DELETE + behind[state] == left:
                    edits += "D"
                elif INSERT + here[NEXT[state]] == here[state]:
                    edits, state = edits + "I", NEXT[state]
                    continue
                elif to is not None and kept[1] + behind[to] == left:
                    edits, state = edits + "K", to
                else:
                    edits, state = edits + "R", NEXT[state]
                break
        return edits, state


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of a table of conversations (conv_id, turn, role, text), damaged by crc32(`conv_id:turn`) % 20.

    Null roles, texts and turns (in the checksum) are one space. 0 drops a row, 1 empties its text, 2 takes `[.!?]` out, 3 repeats
    it, 4 sets its role to user.
    """
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    number = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text, role = or_space("text"), or_space("role")
    text = F.when(number == 1, "").when(number == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(number == 0, 0).when(number == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(number == 4, "user").otherwise(role).alias("role"), text.alias("text"), times.alias("times"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, known, turn, role, text, head, mark and fault (1 blank, 2 said at an earlier turn, 3 truncated, else 0).

    A text that is repeated within its turn is told when the rows are in order.
    """
    or_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    number = F.col("turn").cast("long")
    said = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("turn"),
        or_space("role").alias("role"), or_space("text").alias("text"),
    ).where("conv_id IS NOT NULL")
    said = said.withColumn("mark", F.sha2(F.concat(F.length("role"), F.lit(" "), "role", "text"), 256))
    # one row a text that is said at several turns, summed up before it is shuffled; the join deals its rows
    at = F.struct("known", "turn")
    firsts = said.groupBy("conv_id", "mark").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    said = said.join(written(firsts.select("conv_id", "mark", "first"), "firsts"), ["conv_id", "mark"], "left")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(trimmed == "", 1).when(at > F.col("first"), 2)
        .when(~F.right(trimmed, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    )
    return said.select("conv_id", "known", "turn", "role", "text", F.left("text", F.lit(100)).alias("head"), "mark", fault.alias("fault"))


class _Segment:
    """Turns of one conversation in a row, as they come."""

    def __init__(self, conv_id: int, number: int):
        self.conv_id, self.number, self.chars = conv_id, number, 0
        self.symbols, self.roles, self.texts, self.turns = [], [], [], []
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.symbols.append("0" if fault in (1, 2) else str(1 + 2 * (CLASSES + "?").index(role[:1] if role[:1] and role[:1] in CLASSES else "?") + (fault == 3)))
        self.roles.append(role), self.texts.append(text), self.turns.append(turn)
        self.faults[fault] += 1
        self.chars += len(role) + len(text)

    def row(self, part: int) -> tuple:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return (
            self.conv_id, part, self.number, "".join(self.symbols), self.roles, self.texts, known[0] if known else None, known[-1] if known else None,
            len(set(known)), *self.faults[1:], illegal, initials[0], initials[-1],
        )


#: Initials of roles that may follow each other.
LEGAL = ("su", "ua", "au")


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of conversations and turns, as segments of bounded size."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"first_turn": "Int64", "last_turn": "Int64"})
    held, number, last = None, 0, None
    for b in batches:
        rows, chars = [], 0
        columns = (b[c] for c in ("conv_id", "known", "turn", "role", "text", "mark", "fault"))
        for conv_id, known, turn, role, text, mark, fault in zip(*columns, strict=True):
            if held and (conv_id != held.conv_id or len(held.symbols) >= SEGMENT_TURNS or held.chars > SEGMENT_CHARS):
                rows.append(held.row(part))
                chars += held.chars
                held = None
                if chars > SEGMENT_CHARS:
                    yield frame(rows)
                    rows, chars = [], 0
            if held is None:
                held, number = _Segment(conv_id, number), number + 1
            same = (conv_id, known, turn, mark)
            held.add(turn if known else None, role, text, 2 if same == last and fault != 1 else fault)
            last = same
        if rows:
            yield frame(rows)
    if held:
        yield frame([held.row(part)])


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[["conv_id", "part", "seg"]].assign(summary=[tables().summary(s) for s in b["symbols"]])


def _vectors_behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cost vector behind each segment, from a conversation's last one to its first."""
    table, last, vector = tables(), None, 0
    for b in batches:
        out = []
        for conv_id, summary in zip(b["conv_id"], b["summary"], strict=True):
            vector = table.first if conv_id != last else vector
            out.append(list(table.vectors[vector]))
            vector, last = table.ahead_of(np.asarray(summary, dtype=np.int64), vector), conv_id
        yield b[["conv_id", "part", "seg"]].assign(behind=out)


class _Conversation:
    """The edits of one conversation, segment by segment, and its digests."""

    def __init__(self, conv_id: int):
        self.conv_id, self.state, self.sha, self.begun = conv_id, 0, hashlib.sha256(), False
        self.audit, self.cost = [], 0
        self.turns, self.low, self.high, self.closes = 0, None, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}

    def _edit(self, edits: str, given: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit, role, text) of each edit; a deleted turn has its own role and text."""
        for e in edits:
            if e == "I":
                role, text, kept = SET[self.state], "", None
                self.cost += INSERT
            else:
                symbol, role, text = next(given)
                kept = _turn(int(symbol))
                self.cost += DELETE if e == "D" else kept[1] + REROLE * (e == "R")
            if e == "R":
                role = SET[self.state]
            if e != "D":
                self.state = MOVES[kept[0]][self.state] if e == "K" else NEXT[self.state]
                self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
                self.begun = True
            yield e, role, text

    def take(self, segment, behind: int) -> Iterator[tuple[str, str | None, str | None]]:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.counts[name] += int(getattr(segment, name))
        if self.closes is not None:
            self.counts["illegal"] += self.closes + segment.opens not in LEGAL
        self.closes = segment.closes
        if not pd.isna(segment.first_turn):
            self.turns += int(segment.turns) - (self.high == int(segment.first_turn))
            self.low = int(segment.first_turn) if self.low is None else self.low
            self.high = int(segment.last_turn)
        blocks = tables().blocks(segment.symbols)
        given = zip(segment.symbols, segment.roles, segment.texts, strict=True)
        for block, vector in zip(blocks, tables().behind(blocks, behind)[0], strict=True):
            edits, state = tables().trace(block, vector, self.state)
            yield from self._edit(edits, given)
            self.audit.append(edits)
            assert self.state == state

    def finish(self) -> Iterator[tuple[str, str | None, str | None]]:
        while self.state not in FINAL:
            self.audit.append("I")
            yield from self._edit("I", iter(()))

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return (self.conv_id, gaps, *self.counts.values(), self.cost, "".join(self.audit), self.sha.hexdigest())


DIGESTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "conv_id long, position long, edit string, role string, text string"


def _walk(whole_turns: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """From a conversation's first segment to its last, each with the vector behind it: digests or repaired turns."""
    names = [c.split()[0] for c in (TURNS if whole_turns else DIGESTS).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, behind, place = None, 0, 0
        for b in batches:
            rows, chars = [], 0

            def edited(conversation: _Conversation, edits: Iterator) -> int:
                nonlocal place
                size = 0
                for edit, role, text in edits:
                    if whole_turns and edit != "D":
                        rows.append((conversation.conv_id, place, edit, role, text))  # noqa: B023 - used at once
                        place += 1
                        size += len(text)
                return size

            for r in b.itertuples(index=False):
                if held and r.conv_id != held.conv_id:
                    edited(held, held.finish())
                    rows += [] if whole_turns else [held.row()]
                    held = None
                if held is None:
                    held, place = _Conversation(r.conv_id), 0
                if r.behind is not None:
                    behind = tables().add(tuple(int(c) for c in r.behind))
                    continue
                chars += edited(held, held.take(r, behind))
                if chars > SEGMENT_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, chars = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held:
            rows = [(held.conv_id, place + i, e, role, text) for i, (e, role, text) in enumerate(held.finish())]
            yield pd.DataFrame(rows if whole_turns else [held.row()], columns=names)

    return run


def _repair(rows: DataFrame, whole_turns: bool) -> DataFrame:
    order = ["conv_id", "known", "turn", "role", "head", "mark"]
    sorted_rows = _faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(sorted_rows.mapInPandas(_segments, SEGMENT), "segments")
    key = "conv_id long, part int, seg int"
    thin = held.select("conv_id", "part", "seg", "symbols").mapInPandas(_summaries, f"{key}, summary array<long>")
    thin = thin.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
    behind = thin.mapInPandas(_vectors_behind, f"{key}, behind array<long>")
    # the vector goes ahead of its segment, so both need no join
    both = held.withColumn("behind", F.lit(None).cast("array<long>")).unionByName(behind, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg", F.col("behind").isNull())
    return both.mapInPandas(_walk(whole_turns), TURNS if whole_turns else DIGESTS)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns of the repaired conversations, from position 0.

    The cheapest edits make a conversation's roles `(s?(ua)+)?` by initials: Keep costs 0, Rerole to
    user or assistant 1, Delete 2, Insert of an empty user or assistant 5; a turn that is truncated
    (the last character that isn't white space isn't one of `.!?`) and not deleted adds 5; blank turns
    and ones whose role and text came before must be deleted. Of equally cheap edits those stand
    whose initials in order are ASCII-least.

    Turns go by number, null first, ties by role, the text's first 100 characters and a hash of it. Null
    roles and texts are one space. Repeated rows are duplicates. A role that is none of the three by
    its initial can't be kept. Rows without a conversation id belong to no conversation and are left
    out. Very long texts stay whole, a conversation's number of turns is unbounded: rows are dealt
    by ranges of turns into segments of at most SEGMENT_TURNS, a row of four-by-four costs each goes to the
    conversation's other segments, and its segments then stream through one task, which holds one of
    them at a time. No rows give no rows. Other columns are not read.
    """
    return _repair(rows, whole_turns=True)


def repair_digests(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    Edits and odd rows as in `repaired_turns`; audit is the edits' initials, and repaired_sha256
    the hex digest of the repaired `role:text`, newline-joined. gaps are turn numbers that are missing
    between the smallest and the largest; illegal counts neighbours whose roles' initials are not su, ua
    or au. `ids` may have conversations (conv_id, repeated or not) without rows: their counts are 0.
    """
    found = _repair(rows, whole_turns=False)
    if ids is None:
        return found
    every = ids.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    or_else: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    rest = (F.coalesce(c, or_else.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:])
    return every.join(found, "conv_id", "left").select("conv_id", *rest)


def repaired_digests_of_damaged(conversations: DataFrame) -> DataFrame:
    """`repair_digests` of the damaged conversations, one row for every conversation of the table."""
    return repair_digests(damaged(conversations), conversations.select("conv_id"))
