"""Column expressions for categories, levels, verdicts and deterministic choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K


def three_valued_label(listed: Column, session_has_listed: Column) -> Column:
    """cheater (listed) / unknown (shares a session with one) / clean."""
    return (
        F.when(F.coalesce(listed, F.lit(False)), "cheater")
        .when(F.coalesce(session_has_listed, F.lit(False)), "unknown")
        .otherwise("clean")
    )


def is_sniper(weapon: Column) -> Column:
    return F.coalesce(weapon.isin(*K.SNIPERS), F.lit(False))


def weapon_kind(weapon: Column) -> Column:
    return (
        F.when(weapon.isin(*K.SNIPERS), "sniper")
        .when(weapon.isin(*K.RIFLES), "rifle")
        .otherwise("other")
    )


def aimed_weapon(weapon: Column) -> Column:
    """False for knives, grenades and the like; an unknown weapon counts as aimed."""
    return ~F.coalesce(weapon.rlike(K.NOT_AIMED), F.lit(False))


def listed_in(items: Column, entity: Column) -> Column:
    return F.coalesce(F.array_contains(items, entity), F.lit(False))


def severity_rank(severity: Column) -> Column:
    """0 is the worst."""
    rank = F.lit(99)
    for n, name in enumerate(reversed(K.SEVERITIES)):
        rank = F.when(severity == name, n).otherwise(rank)
    return rank


def level(value: Column, notable: Column, strong: Column, higher: Column) -> Column:
    """strong / notable / NULL: how far outside the clean range a value sits."""
    past_strong = F.when(higher, value > strong).otherwise(value < strong)
    past_notable = F.when(higher, value > notable).otherwise(value < notable)
    return F.when(past_strong, "strong").when(past_notable, "notable")


def line_band(value: Column, notable: Column, strong: Column, higher: Column) -> Column:
    """Subgroup of a measurement against its lines (the line itself counts as past)."""
    past_strong = F.when(higher, value >= strong).otherwise(value <= strong)
    past_notable = F.when(higher, value >= notable).otherwise(value <= notable)
    return (
        F.when(value.isNull() | notable.isNull(), "no measurement")
        .when(past_strong, "past 99% line")
        .when(past_notable, "past 95% line")
        .otherwise("inside clean range")
    )


def sniper_band(share: Column) -> Column:
    return (
        F.when(share < 0.2, "rifler")
        .when(share < K.SNIPER_HEAVY, "mixed")
        .otherwise("awp_main")
    )


def verdict_for(probability: Column) -> Column:
    return (
        F.when(probability < K.CLEAN_BELOW, "clean")
        .when(probability > K.CHEATING_ABOVE, "cheating")
        .otherwise("unclear")
    )


def target_probability(weight: Column, kills: Column) -> Column:
    low, high = K.UNCLEAR_PROBABILITY
    return (
        F.when(
            weight >= K.DECISIVE,
            F.least(F.lit(95), F.lit(62) + F.bround(weight * 10).cast("int")),
        )
        .when(
            weight > 0,
            F.lit(low) + F.bround(weight * (high - low) / K.DECISIVE).cast("int"),
        )
        .when(kills < 10, K.FEW_KILLS_PROBABILITY)
        .otherwise(K.CLEAN_PROBABILITY)
    )


def corroborated(points: Column) -> Column:
    """Whether evidence points may carry an accusation rather than a doubt.

    ``points`` is an array of structs with ``weight`` and ``from_rule``.
    """
    lines = F.filter(points, lambda p: ~p["from_rule"])
    rules = F.filter(points, lambda p: p["from_rule"])
    beyond = F.exists(rules, lambda p: p["weight"] >= K.RULE_WEIGHTS["impossible"])
    strong = F.exists(lines, lambda p: p["weight"] >= K.WEIGHTS["strong"])
    return beyond | (strong & ((F.size(lines) >= 2) | (F.size(rules) > 0)))


def split_for(key: Column, share: float = 0.2) -> Column:
    """val / train by CRC-32 of the key: the same half on every run."""
    bucket = F.crc32(F.encode(key, "utf-8")) % 1000
    return F.when(bucket < share * 1000, "val").otherwise("train")


def stable_choice(key: Column, options: Sequence[str]) -> Column:
    """One of ``options``, always the same one for a key."""
    pool = F.array(*[F.lit(o) for o in options])
    return F.element_at(pool, (F.pmod(F.xxhash64(key), F.lit(len(options))) + 1).cast("int"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def seek_command(tick: Column, before: int = 128) -> Column:
    return F.concat(
        F.lit("demo_gototick "),
        F.greatest(tick - before, F.lit(0)).cast("long").cast("string"),
    )


def alias_ids(rank: Column) -> Column:
    return F.concat(F.lit("Player_"), (rank - 1).cast("string"))


def annotation_errors(
    probability: Column,
    cheat_type: Column,
    reasons: Column,
    caveats: Column,
    *,
    max_reasons: int = 3,
    max_caveats: int = 2,
    max_sentence: int = 160,
) -> Column:
    """What is wrong with a human verdict, as an array of messages (empty: nothing)."""
    def said(a: Column) -> Column:
        return F.filter(F.transform(a, lambda s: F.trim(s)), lambda s: F.length(s) > 0)

    given, notes = said(reasons), said(caveats)
    long_ones = F.exists(
        F.concat(given, notes), lambda s: F.length(s) > max_sentence
    )
    nameless = (verdict_for(probability) == "cheating") & (cheat_type == "none")
    return F.array_compact(
        F.array(
            F.when(F.size(given) == 0, "give at least one reason"),
            F.when(F.size(given) > max_reasons, f"at most {max_reasons} reasons"),
            F.when(F.size(notes) > max_caveats, f"at most {max_caveats} caveats"),
            F.when(long_ones, f"keep each sentence under {max_sentence} characters"),
            F.when(
                nameless,
                "name the cheat, or lower the probability below the cheating band",
            ),
        )
    )
