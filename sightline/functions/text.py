"""Column expressions for the text a case is shown as."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K


def fill(template: str, **parts: Column | str) -> Column:
    """A text format with columns in its ``{name}`` places; NULL if one is NULL."""
    out: list[Column] = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            value = parts[piece[1:-1]]
            out.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def fixed(value: Column, digits: int) -> Column:
    """A number with ``digits`` decimals, rounded half to even on its exact value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def number(value: Column) -> Column:
    """A measurement as displayed: 0, whole from 100, one decimal from 1, else two."""
    size = F.abs(value)
    pattern = F.when(size >= 100, "0").when(size >= 1, "0.0").otherwise("0.00")
    return F.when(value == 0, "0").otherwise(
        F.call_function("format_number", value.cast("double"), pattern)
    )


def shown(value: Column) -> Column:
    """The displayed number as a number, so decisions can be read off the text."""
    return number(value).cast("double")


def as_percent(figure: Column) -> Column:
    """A displayed share (``number``'s text) as a whole percentage."""
    return F.concat(
        F.bround(figure.cast("double") * 100).cast("int").cast("string"), F.lit("%")
    )


def plain(value: Column, kind: str) -> Column:
    """The string if the whole of it has its kind's shape, else NULL."""
    return F.when(value.rlike(rf"\A(?:{K.PLAIN_PATTERNS[kind]})\z"), value)


def percentile_text(percentile: Column) -> Column:
    top = F.greatest(F.lit(1), F.bround((1 - percentile) * 100).cast("int"))
    return (
        F.when(percentile.isNull(), "-")
        .when(percentile >= 0.99, "top 1%")
        .otherwise(F.concat(F.lit("top "), top.cast("string"), F.lit("%")))
    )


def header_text(value: Column, size: int = 128) -> Column:
    return F.substring(value, 1, size)


def seconds(ms: Column) -> Column:
    return fixed(ms / 1000, 1)


def context_sentence(
    sight_checked: Column,
    last_seen_ms: Column,
    fired_ms_ago: Column,
    was_running: Column,
    allies: Column,
    enemies: Column,
) -> Column:
    """What the actor could have known; parts that are unknown are left out."""
    checked = F.coalesce(sight_checked, F.lit(False))
    seen = fill(K.CONTEXT_SEEN, s=seconds(last_seen_ms))
    facing = F.coalesce(enemies.cast("string"), F.lit("None"))
    return F.concat_ws(
        "; ",
        F.when(checked & last_seen_ms.isNull(), K.CONTEXT_NEVER_SEEN).when(checked, seen),
        fill(K.CONTEXT_FIRED, s=seconds(fired_ms_ago)),
        F.when(was_running, K.CONTEXT_RUNNING),
        fill(K.CONTEXT_ALIVE, a=allies, b=facing),
    )


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(
        F.replace(text, F.lit(","), F.lit("")), F.lit(K.NUMBER_PATTERN), F.lit(0)
    )


def unseen_numbers(sentence: Column, evidence: Column) -> Column:
    """Figures a sentence states that the evidence does not show.

    A share of 0.74 may be cited as 74%; whole numbers under 10 are ignored.
    """
    shown_tokens = number_tokens(evidence)
    shares = F.filter(
        shown_tokens, lambda t: ~t.endswith("%") & (t.cast("double") <= 1)
    )
    as_percent = F.transform(
        shares,
        lambda t: F.concat(
            F.bround(t.cast("double") * 100).cast("int").cast("string"), F.lit("%")
        ),
    )
    known = F.array_union(shown_tokens, as_percent)

    def invented(token: Column) -> Column:
        bare = F.rtrim(token, F.lit("%"))
        small = bare.rlike(r"^\d+$") & (F.length(F.ltrim(bare, F.lit("0"))) < 2)
        return (
            ~small
            & ~F.array_contains(known, token)
            & ~F.array_contains(known, bare)
        )

    return F.filter(number_tokens(sentence), invented)


def measurement_rows(text: Column) -> Column:
    """Measurements parsed back out of rendered text: an array of structs."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(K.MEASUREMENT_PATTERN))

    def part(line: Column, group: int) -> Column:
        return F.regexp_extract(line, K.MEASUREMENT_PATTERN, group)

    return F.transform(
        lines,
        lambda s: F.struct(
            part(s, 1).alias("name"),
            part(s, 2).cast("double").alias("value"),
            part(s, 3).cast("double").alias("base"),
            part(s, 4).alias("side"),
            part(s, 5).cast("double").alias("notable"),
            part(s, 6).cast("double").alias("strong"),
        ),
    )
