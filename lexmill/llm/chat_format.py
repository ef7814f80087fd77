"""Chat formatting by a finite-state machine over roles.

A declarative template names the states a role leads to, the accepting states, and each role's text before and after a
turn with the turn's loss flags. The machine runs over a conversation's turns in order; a valid conversation becomes text
segments, each with its loss flag, an invalid one a row that says why. All of it is built-in expressions; the only
shuffle brings a conversation's turns together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import tidy


#: White space of any script, and the byte order mark.
BLANK = r"[\s\x0B\x{85}\p{Z}\x{FEFF}]"


@dataclass(frozen=True)
class Role:
    """What surrounds a role's turn, and whether its text and its end are learned."""

    before: str
    after: str
    loss: bool = False
    end_loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<|system|>\n", "<|end|>\n"),
            "user": Role("<|user|>\n", "<|end|>\n"),
            "assistant": Role("<|assistant|>\n", "<|end|>\n", True, True),
        }
    )
    #: (state, role): next state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: frozenset[str] = frozenset({"assistant"})
    start: str = "start"


def chat_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """conv_id, segment (0, 1, ...), role, text, loss and error ("" for segments) in the order of the text.

    An invalid conversation is one row with segment -1, the reason in error, and otherwise empty. Reasons, the first that
    holds: "missing turn or role" (nulls), "two texts for a turn", "blank turn" (null or white-space text), "ROLE after
    STATE", "ends after STATE". Rows repeated in full count once. Rows without conv_id belong to no conversation and are
    left out. An empty table gives an empty result; texts are kept whole, of any length, also where they hold a marker of the
    template: segments are apart, so that a tokeniser can take a turn's text as ordinary text. Extra columns are ignored,
    whatever their names.
    """
    turns, _ = tidy(turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    moves = F.create_map(*(F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\x00{r}", to)))
    grouped = (
        turns.filter("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("turn", "role", "text")))).alias("turns"))
    )

    def step(acc, t):
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\x00"), t["role"]))
        bad = F.concat(F.coalesce(t["role"], F.lit("")), F.lit(" after "), acc["state"])
        return F.struct(
            F.when(acc["error"] != "", acc["state"]).otherwise(F.coalesce(to, acc["state"])).alias("state"),
            F.when(acc["error"] != "", acc["error"]).when(to.isNull(), bad).otherwise("").alias("error"),
        )

    ran = F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit("").alias("error")), step)
    numbers = F.transform("turns", lambda t: t["turn"])
    error = (
        F.when(F.exists("turns", lambda t: t["turn"].isNull() | t["role"].isNull()), "missing turn or role")
        .when(F.size(F.array_distinct(numbers)) < F.size("turns"), "two texts for a turn")
        .when(F.exists("turns", lambda t: F.trim(F.regexp_replace(F.coalesce(t["text"], F.lit("")), BLANK, "")) == ""), "blank turn")
        .when(F.col("ran.error") != "", F.col("ran.error"))
        .when(~F.col("ran.state").isin(*template.accepting), F.concat(F.lit("ends after "), F.col("ran.state")))
        .otherwise("")
    )

    def pick(role, what):
        return F.element_at(F.create_map(*(F.lit(x) for r, v in template.roles.items() for x in (r, getattr(v, what)))), role)

    def parts(t):
        piece = lambda text, loss: F.struct(t["role"].alias("role"), text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(pick(t["role"], "before"), F.lit(False)), piece(t["text"], pick(t["role"], "loss")), piece(pick(t["role"], "after"), pick(t["role"], "end_loss"))
        )

    told = grouped.withColumn("ran", ran).select("conv_id", "turns", error.alias("error"))
    nothing = F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("loss")))
    pieces = F.when(F.col("error") == "", F.flatten(F.transform("turns", parts))).otherwise(nothing)
    out = told.select("conv_id", "error", F.posexplode(pieces).alias("segment", "p"))
    return out.select("conv_id", F.when(F.col("error") == "", F.col("segment")).otherwise(-1).alias("segment"), "p.role", "p.text", "p.loss", "error")
