"""Chat formatting from a declarative template, with DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MOVES = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}
#: Turns that the machine takes before their states are put to those before.
BLOCK = 64
#: Goes before the name of the state that a move leads to which the machine doesn't have.
WRONG = "!"


@dataclass(frozen=True)
class ChatTemplate:
    """How a turn is written, and a finite-state machine over roles.

    Every turn is `open` role `middle` text `close`. No reserved string occurs in what a role or
    text becomes: a backslash goes after its first character, and backslashes are doubled.

    `moves` says to which state a role leads from a state. A role that has no move leads to its own
    state, marked as wrong, and so do all roles after it: such a conversation is written to its
    end but isn't valid. A conversation is valid if it ends in one of the `final` states. The
    texts of turns that lead to a state in `learned` are learned.
    """

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    also_reserved: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: dict(MOVES))
    final: tuple[str, ...] = ("assistant",)
    learned: tuple[str, ...] = ("assistant",)

    def states(self, turns: Column) -> Column:
        """The states that the roles of an array of turns lead to, one after each turn.

        Turns go in blocks, so that what is added to is a block's states or the list of blocks, and not the list of all.
        """
        moves = F.create_map(*(F.lit(x) for (state, role), to in self.moves.items() for x in (f"{state}>{role}", to)))
        last = lambda seen: F.element_at(seen, -1)

        def step(seen: Column, turn: Column) -> Column:
            move = F.try_element_at(moves, F.concat(last(seen), F.lit(">"), turn["role"]))
            return F.concat(seen, F.array(F.coalesce(move, F.concat(F.lit(WRONG), turn["role"]))))

        def block(done: Column, own: Column) -> Column:
            after = F.aggregate(own, F.array(last(last(done))), step)
            return F.concat(done, F.array(F.slice(after, F.lit(2), F.size(own))))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1)), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda i: F.slice(turns, i, F.lit(BLOCK)))
        done = F.aggregate(blocks, F.array(F.array(F.lit(self.start))), block)
        return F.flatten(F.slice(done, F.lit(2), F.size(blocks)))

    def segments(self, turn: Column, state: Column) -> Column:
        """What the machine emits when a turn leads to a state: segments of (text, loss)."""
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        learned = F.ltrim(state, F.lit(WRONG)).isin(*self.learned)
        return F.array(
            segment(F.concat(F.lit(self.open), self.escaped(turn["role"]), F.lit(self.middle)), F.lit(False)),
            segment(self.escaped(turn["text"]), learned),
            segment(F.lit(self.close), F.lit(False)),
        )

    def escaped(self, text: Column) -> Column:
        reserved = (self.open, self.middle, self.close, *self.also_reserved)
        heads = "|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in reserved)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({heads})", r"$1\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


CHAT = ChatTemplate()


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: ChatTemplate = CHAT,
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted.

    segments is an array of (text, loss) that the template's state machine emits: a learned turn's
    text is a segment of its own with loss true, and what stands around it is not learned.
    formatted is all segments in a row. valid: the roles have moves from the start to a final
    state; conversations that don't are formatted all the same, for the caller to keep or drop.

    Turns go by number, null last, ties by role and text; repeated rows are turns of their own.
    Null roles and texts are empty, and rows without a conversation id are one conversation. Very
    long texts are formatted whole. No rows give no rows. Other columns are not read. A
    conversation is one row here and must fit in a task; no more than that is gathered in one place.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(turn_col).cast("long")
    turn = F.struct(number.isNull().alias("last"), number.alias("turn"), role.alias("role"), text.alias("text"))
    turns = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    turns = turns.withColumn("states", template.states(F.col("turns")))
    out = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.element_at("states", -1).isin(*template.final).alias("valid"),
        F.flatten(F.zip_with("turns", "states", template.segments)).alias("segments"),
    )
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: ChatTemplate = CHAT) -> Column:
    """The turns that a formatted conversation holds, as an array of (role, text)."""
    literal = lambda s: f"\\Q{s}\\E"
    parts = F.split(formatted, literal(template.close))
    halves = lambda p: F.split(F.substr(p, F.lit(len(template.open) + 1)), literal(template.middle))
    turn = lambda p: F.struct(
        template.unescaped(halves(p)[0]).alias("role"), template.unescaped(halves(p)[1]).alias("text")
    )
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def learned_text(segments: Column, template: ChatTemplate = CHAT) -> Column:
    """The text under the loss mask, as it was before escaping, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


def conversation_digests(rows: DataFrame, template: ChatTemplate = CHAT) -> DataFrame:
    """What the formatted conversations hold, read back from them, one row per conversation.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and valid. Odd rows
    are taken as in format_conversations.
    """
    done = format_conversations(rows, template=template)
    turns, learned = read_turns(F.col("formatted"), template), learned_text(F.col("segments"), template)
    read = done.select("conv_id", "valid", "formatted", turns.alias("turns"), learned.alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
