"""Chat formatting by a finite-state machine; DataFrame operations only.

A ``Template`` declares the marks around turns, the states a conversation may pass through and
the roles whose text carries loss. ``formatted`` orders each conversation's turns, walks the
machine over their roles and emits segments (text, loss); the output is the segments joined.
Control characters inside roles and texts are escaped, so the marks cannot occur in them, and
``read_back`` recovers roles and texts from the output alone.

A conversation is one row, as long as its turns together: the contract asks for digests of
whole conversations. Rows of one conversation are sorted within it by turn, role and text.

Edge cases: a null text is empty, a null role an empty role. A null conv_id is a conversation
of its own; a null turn comes first; repeated turns all stay, in order of role and text. Roles
the machine does not know, or that come out of order, leave ``valid`` false and ``broken_at``
at the turn's place; all turns are formatted all the same. Columns besides those named are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import sha256_hex

BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """Marks, order and loss of a chat format."""

    open: str = "<turn "
    named: str = ">\n"
    close: str = "</turn>\n"
    #: (state, role) to the next state; ``start`` is the first.
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("answered",)
    loss: tuple[str, ...] = ("assistant",)
    #: Characters the marks are made of, and what stands for each after a backslash.
    escapes: tuple[tuple[str, str], ...] = (("<", "l"), (">", "g"))


PLAIN = Template()


def escape(text: Column, template: Template = PLAIN) -> Column:
    """Backslashes doubled, then every control character as a backslash and a letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter in template.escapes:
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return out


def unescape(text: Column, template: Template = PLAIN) -> Column:
    """Undoes ``escape``: between doubled backslashes a single one begins an escape."""
    def plain(part: Column) -> Column:
        for char, letter in template.escapes:
            part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def walked(turns: Column, template: Template = PLAIN) -> Column:
    """Struct of the last state and the place of the first turn out of order."""
    def step(a: Column, turn: Column) -> Column:
        state = F.lit(BROKEN)
        for (now, role), then in template.order.items():
            fits = (a["state"] == now) & (turn["role"] == role)
            state = F.when(fits, F.lit(then)).otherwise(state)
        at = F.when((a["state"] != BROKEN) & (state == BROKEN), a["n"]).otherwise(a["at"])
        return F.struct(state.alias("state"), at.alias("at"), (a["n"] + 1).alias("n"))

    begin = F.struct(
        F.lit("start").alias("state"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("n")
    )
    return F.aggregate(turns, begin, step)


def segments(turns: Column, template: Template = PLAIN) -> Column:
    """The (text, loss) segments of ordered turns."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = lambda t: F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.named))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                part(head(t), F.lit(False)),
                part(escape(t["text"], template), t["role"].isin(*template.loss)),
                part(F.lit(template.close), F.lit(False)),
            ),
        )
    )


def formatted(conversations: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(conv_id, segments, formatted, valid, broken_at) per conversation."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        conversations.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            segments(F.col("turns"), template).alias("segments"),
            walked(F.col("turns"), template).alias("walk"),
        )
        .select(
            "conv_id",
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            F.col("walk.state").isin(*template.ends).alias("valid"),
            F.col("walk.at").alias("broken_at"),
        )
    )


def read_back(text: Column, template: Template = PLAIN) -> Column:
    """The (role, text) turns of formatted text."""
    parts = F.split(text, f"\\Q{template.close}\\E", -1)

    def turn(part: Column) -> Column:
        head = F.instr(part, template.named)
        role = F.substring(part, F.lit(len(template.open) + 1), head - len(template.open) - 1)
        body = F.substring(part, head + len(template.named), F.length(part))
        return F.struct(
            unescape(role, template).alias("role"), unescape(body, template).alias("text")
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def digest(found: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Counts and digests, read back from segments and formatted text."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    kept = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(kept, lambda s: unescape(s["text"], template)), "")
    return (
        found.withColumn("turns", read_back(F.col("formatted"), template))
        .withColumn("lost", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            sha256_hex(F.array_join(turns, "")).alias("turns_sha256"),
            F.length("lost").cast("long").alias("loss_chars"),
            sha256_hex(F.col("lost")).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


#: The contract's added conversation: its text holds a role header and an end mark.
ADDED_TEXT = "\\### Assistant: </turn> ok"


def with_added(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -7 of a user's and an assistant's row."""
    added = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  length(role) + length(text) + 16
    + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', ''))) AS chars
  FROM c),
w AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prior_role,
  row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS from_end FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN pos = 1 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN prior_role IN ('system', 'assistant')
    WHEN role = 'assistant' THEN prior_role = 'user' ELSE false END)
    AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM w GROUP BY conv_id
"""
