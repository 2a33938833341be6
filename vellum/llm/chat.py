"""Chat formatting by a declarative template and a finite-state machine over roles, in DataFrame functions only.

A template lists the parts of one turn; each part names its text and whether it counts for the loss. Control strings
inside roles and texts are escaped reversibly: the escape character becomes "\\s" and the "<|" that opens each control
string becomes "<\\p" (a role's line break "\\n"), so after an escape character always stands a letter, and no control
string is left that the template didn't write.

The machine reads the roles in order. A turn whose role has no transition from the present state makes the
conversation invalid from there on (first_bad_turn, 0-based; null if none); it is formatted all the same, and so is a
conversation that ends in a state outside the accepting ones (valid is false, first_bad_turn null).

Order: turn, then role, then text, so ties and repeated rows have one order; a null turn comes first. Null role or
text: empty. Null conv_id: one conversation of its own. No rows in, no rows out. Other columns are ignored.
A conversation is one value of text, so its turns meet in one task; nothing else is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESC = "\\"


@dataclass(frozen=True)
class Template:
    """Parts of a turn: (what, loss). What: "{role}", "{text}" or a literal. Loss holds for the roles in loss_roles."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    parts: tuple[tuple[str, bool], ...] = (("<|im_start|>", False), ("{role}", False), ("\n", False), ("{text}", True), ("<|im_end|>\n", False))
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    accepting: tuple[str, ...] = ("assistant",)


def lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return lit_replace(lit_replace(c, ESC, ESC + "s"), "<|", "<" + ESC + "p")


def escape_role(c: Column) -> Column:
    return lit_replace(escape(c), "\n", ESC + "n")


def unescape(c: Column) -> Column:
    return lit_replace(lit_replace(c, "<" + ESC + "p", "<|"), ESC + "s", ESC)


def unescape_role(c: Column) -> Column:
    return lit_replace(lit_replace(lit_replace(c, ESC + "n", "\n"), "<" + ESC + "p", "<|"), ESC + "s", ESC)


def next_state(state: Column, role: Column, template: Template) -> Column:
    """Null where the machine has no such transition."""
    moves = {f"{a}\x00{r}": b for a, to in template.transitions.items() for r, b in to.items()}
    table = F.create_map(*[F.lit(x) for kv in moves.items() for x in kv])
    return F.element_at(table, F.concat(state, F.lit("\x00"), role))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation: conv_id, segments array<struct<text, loss>> in order, formatted (the segments' texts
    joined), n_turns, valid, first_bad_turn."""
    t = template or Template()
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), turn_order).alias("ts"))

    def part(what: str, loss: bool, turn: Column) -> Column:
        piece = escape_role(turn["role"]) if what == "{role}" else escape(turn["text"]) if what == "{text}" else F.lit(what)
        return F.struct(piece.alias("text"), (turn["role"].isin(*t.loss_roles) if loss else F.lit(False)).alias("loss"))

    start = F.struct(F.lit(t.start).alias("state"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("bad"))

    def step(acc: Column, turn: Column) -> Column:
        to = F.when(acc["bad"].isNull(), next_state(acc["state"], turn["role"], t))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["at"] + 1).alias("at"), F.coalesce(acc["bad"], F.when(to.isNull(), acc["at"])).alias("bad"))

    machine = ordered.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.flatten(F.transform("ts", lambda x: F.array(*[part(w, loss, x) for w, loss in t.parts]))).alias("segments"),
        F.aggregate("ts", start, step).alias("end"),
    )
    return machine.select(
        "conv_id",
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end.bad").isNull() & F.col("end.state").isin(*t.accepting)).alias("valid"),
        F.col("end.bad").alias("first_bad_turn"),
    )


def turn_order(a: Column, b: Column) -> Column:
    """turn (null first), role, text."""

    def less(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1)

    by_turn = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1).otherwise(less(a["turn"], b["turn"]))
    return F.coalesce(by_turn, less(a["role"], b["role"]), less(a["text"], b["text"]), F.lit(0))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns in formatted text: array<struct<role, text>>, unescaped."""
    t = template or Template()
    pieces = F.split(formatted, "\\Q" + t.close + "\\E", -1)
    bodies = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(body: Column) -> Column:
        inner = F.substr(body, F.lit(len(t.open) + 1))
        at = F.instr(inner, "\n")
        return F.struct(unescape_role(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + 1)).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """What stands under the loss mask, unescaped, joined with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
