"""Chat formatting: a finite-state machine over roles checks the turn order, and a declarative template turns a
conversation into segments with a loss flag each. DataFrame functions only.

The output is the list of segments; their texts, joined, are the training text. Control strings of the template
never appear inside an escaped text, because every one of them begins with ``<`` or ``[`` and these two (and the
escape character ``&``) are written as references. ``read_back`` takes a formatted text apart again by its marks.

Defined cases: null text or role is empty; a null turn comes first; turns with one number are ordered by role, then
text; repeated rows are turns of their own; rows with a null conversation id form one conversation. A
conversation that breaks the turn order is formatted all the same and has ``valid`` false, with the number of the
first turn that breaks it. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and per role whether its text counts in the loss.

    ``moves`` are the transitions of the machine: state -> {role: next state}; a missing pair breaks the order.
    ``final`` are the states in which a conversation may end.
    """

    head: str = "[TURN "
    head_end: str = "]"
    tail: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )


LLM_CHAT = Template()


def escape(text: Column) -> Column:
    for plain, reference in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    for plain, reference in reversed(_ESCAPES):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


def _mark(role: Column) -> Column:
    """An escaped role; the mark's closing bracket cannot be part of it either."""
    return F.replace(escape(role), F.lit("]"), F.lit("&#93;"))


def _machine(roles: Column, template: Template) -> Column:
    """``struct(state, at, broken)`` after all roles; a broken order leaves the state as it is."""
    table = F.create_map(*[F.lit(x) for s, row in template.moves.items() for r, t in row.items() for x in (f"{s}\n{r}", t)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\n"), role))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["broken"], F.when(to.isNull(), acc["at"])).alias("broken"),
        )

    return F.aggregate(roles, begin, step)


def format_conversations(turns: DataFrame, template: Template = LLM_CHAT) -> DataFrame:
    """``conv_id, valid, broken_at, segments array<struct<text, loss boolean>>`` of ``turns(conv_id, turn, role, text)``.

    Every turn makes three segments: its opening mark with the role, its escaped text, its closing mark. Only texts
    of the template's loss roles carry the loss flag. A conversation's output is one value, so its turns come
    together in one row; conversations are spread over tasks by their id.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        plain = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(template.head), _mark(t["role"]), F.lit(template.head_end)).alias("text"), plain.alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.tail).alias("text"), plain.alias("loss")),
        )

    checked = whole.withColumn("machine", _machine(F.transform("turns", lambda t: t["role"]), template))
    good = F.col("machine.broken").isNull() & F.col("machine.state").isin(*template.final)
    return checked.select(
        "conv_id", good.alias("valid"), F.col("machine.broken").alias("broken_at"), F.flatten(F.transform("turns", segments)).alias("segments")
    )


def formatted_text(segments: Column | str) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = LLM_CHAT) -> Column:
    """``array<struct<role, text>>`` parsed from a formatted text, unescaped."""
    parts = F.split(text, _quoted(template.tail), -1)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        inner = F.substring(x, F.lit(len(template.head) + 1), F.length(x))
        at = F.instr(inner, template.head_end)
        return F.struct(
            unescape(F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("&#93;"), F.lit("]"))).alias("role"),
            unescape(F.substring(inner, at + len(template.head_end), F.length(inner))).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(segments: Column | str) -> Column:
    """All text under the loss mask, unescaped and joined."""
    kept = F.filter(F.col(segments) if isinstance(segments, str) else segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
