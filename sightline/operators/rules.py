"""Hard-limit rules: each turns samples and anchors into evidence rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.labels import severity_rank
from sightline.functions.text import fill, fixed
from sightline.operators.joins import at_tick
from sightline.operators.motion import ENTITY
from sightline.operators.ordered import (
    CHUNK_TICKS,
    attach_row,
    number_by_range,
    runs,
    runs_in_chunks,
    with_halo,
)
from sightline.operators.quantiles import quantiles
from sightline.session import staged

EVIDENCE_COLUMNS = (
    "session_id",
    "entity_id",
    "trigger",
    "tick_start",
    "tick_end",
    "layer",
    "name",
    "value",
    "unit",
    "threshold",
    "baseline",
    "severity",
    "tick",
    "note",
)


@dataclass(frozen=True)
class Lines:
    """Where each rule begins; calibrated from a clean population."""

    spin_speed_dps: float = K.RULE_LINES["spin_speed_dps"]
    spin_min_ticks: int = K.RULE_LINES["spin_min_ticks"]
    alias_min_step_deg: float = K.RULE_LINES["alias_min_step_deg"]
    alias_min_ticks: int = K.RULE_LINES["alias_min_ticks"]
    snap_speed_dps: float = K.RULE_LINES["snap_speed_dps"]
    max_pitch_deg: float = K.RULE_LINES["max_pitch_deg"]
    clean_speed_p9999: float = K.RULE_LINES["clean_speed_p9999"]
    clean_snap_p9999: float = K.RULE_LINES["clean_snap_p9999"]


def rolling_median(
    df: DataFrame,
    value: Column,
    rows: int,
    *,
    name: str = "rolling",
    seq: str = "seq",
    width: int = CHUNK_TICKS,
) -> DataFrame:
    """Median over the last ``rows`` rows of an entity; NULL until that many exist."""
    halo = with_halo(df.withColumn("_rv", value), seq, back=rows - 1, width=width)
    return _median_in_chunks(halo, rows, name, seq).filter("_own").drop("_own", "_chunk", "_rv")


def _median_in_chunks(halo: DataFrame, rows: int, name: str, seq: str) -> DataFrame:
    w = W.partitionBy(*ENTITY, "_chunk").orderBy(seq).rowsBetween(1 - rows, 0)
    full = F.count(F.lit(1)).over(w) == rows
    return halo.withColumn(name, F.when(full, F.percentile("_rv", F.lit(0.5)).over(w)))


def sustained_runs(
    deltas: DataFrame, line: float, rows: int, *, width: int = CHUNK_TICKS
) -> DataFrame:
    """Runs of at least ``rows`` rows whose rolling median speed is above a line."""
    speed = F.coalesce("yaw_speed", F.lit(0.0))
    # one row more than the median looks back on, for the run: both in one shuffle
    halo = with_halo(deltas.withColumn("_rv", speed), "seq", back=rows, width=width)
    return runs_in_chunks(
        _median_in_chunks(halo, rows, "rolling", "seq"),
        ENTITY,
        "seq",
        F.col("rolling") > line,
        {
            "tick_start": ("min", F.col("tick")),
            "tick_end": ("max", F.col("tick")),
            "peak": ("max", F.col("rolling")),
        },
        min_length=rows,
    )


def flips(deltas: DataFrame, min_step: float, *, width: int = CHUNK_TICKS) -> DataFrame:
    """``flip``: a large turn whose direction differs from the previous row's."""
    halo = with_halo(deltas, "seq", back=1, width=width)
    return _flips_in_chunks(halo, min_step).filter("_own").drop("_own", "_chunk")


def _flips_in_chunks(halo: DataFrame, min_step: float) -> DataFrame:
    w = W.partitionBy(*ENTITY, "_chunk").orderBy("seq")
    sign = F.signum("d_yaw")
    flip = (F.abs("d_yaw") > min_step) & (sign != F.lag(sign).over(w))
    return halo.withColumn("flip", F.coalesce(flip, F.lit(False)))


def alternating_runs(
    deltas: DataFrame, min_step: float, rows: int, *, width: int = CHUNK_TICKS
) -> DataFrame:
    # a row for the turn before and one for the run: both in one shuffle
    halo = with_halo(deltas, "seq", back=2, width=width)
    return runs_in_chunks(
        _flips_in_chunks(halo, min_step),
        ENTITY,
        "seq",
        F.col("flip"),
        {
            "tick_start": ("min", F.col("tick")),
            "tick_end": ("max", F.col("tick")),
            "peak": ("max", F.abs("d_yaw")),
        },
        min_length=rows,
    )


def anchor_speeds(deltas: DataFrame, anchors: DataFrame) -> DataFrame:
    """Speed on the anchor's own tick, for every anchor whose tick exists."""
    at = deltas.select("session_id", "entity_id", "tick", "yaw_speed")
    return at_tick(anchors.select("session_id", "entity_id", "tick"), at)


def out_of_range_runs(
    samples: DataFrame, limit: float, *, width: int = CHUNK_TICKS
) -> DataFrame:
    tilt = F.abs(F.col("pitch").cast("double"))
    return runs(
        samples,
        ENTITY,
        "seq",
        tilt > limit,
        {
            "tick_start": ("min", F.col("tick")),
            "tick_end": ("max", F.col("tick")),
            "peak": ("max", tilt),
        },
        width=width,
    )


def _evidence(
    df: DataFrame,
    *,
    trigger: str,
    name: str,
    value: Column,
    unit: str,
    threshold: float,
    baseline: float | None,
    severity: str,
    note: Column,
    tick_start: Column,
    tick_end: Column,
    tick: Column,
) -> DataFrame:
    return df.select(
        "session_id",
        "entity_id",
        F.lit(trigger).alias("trigger"),
        tick_start.cast("long").alias("tick_start"),
        tick_end.cast("long").alias("tick_end"),
        F.lit("hard_limits").alias("layer"),
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(baseline).cast("double").alias("baseline"),
        F.lit(severity).alias("severity"),
        tick.cast("long").alias("tick"),
        note.alias("note"),
    )


def _span(df: DataFrame) -> dict[str, Column]:
    return {
        "tick_start": F.col("tick_start"),
        "tick_end": F.col("tick_end"),
        "tick": F.col("tick_start"),
    }


def spinbot(deltas: DataFrame, anchors: DataFrame, lines: Lines) -> DataFrame:
    found = sustained_runs(deltas, lines.spin_speed_dps, lines.spin_min_ticks)
    return _evidence(
        found,
        trigger="spinbot",
        name="sustained_spin",
        value=F.round("peak", 1),
        unit="deg/s",
        threshold=lines.spin_speed_dps,
        baseline=lines.clean_speed_p9999,
        severity="impossible",
        note=fill(
            K.NOTE_SPIN,
            peak=fixed(F.col("peak"), 0),
            s=fixed(F.col("length") / float(K.TICK_RATE), 2),
            line=f"{lines.spin_speed_dps:.0f}",
        ),
        **_span(found),
    )


def aliased_spin(deltas: DataFrame, anchors: DataFrame, lines: Lines) -> DataFrame:
    found = alternating_runs(deltas, lines.alias_min_step_deg, lines.alias_min_ticks)
    return _evidence(
        found,
        trigger="aliased_spin",
        name="aliased_spin",
        value=F.col("length"),
        unit="ticks",
        threshold=lines.alias_min_ticks,
        baseline=None,
        severity="impossible",
        note=fill(
            K.NOTE_ALIASED,
            step=f"{lines.alias_min_step_deg:.0f}",
            n=F.col("length"),
            limit=f"{K.MAX_MEASURABLE_SPEED:.0f}",
        ),
        **_span(found),
    )


def kill_tick_snap(deltas: DataFrame, anchors: DataFrame, lines: Lines) -> DataFrame:
    found = anchor_speeds(deltas, anchors).filter(
        F.col("yaw_speed") > lines.snap_speed_dps
    )
    return _evidence(
        found,
        trigger="kill_tick_snap",
        name="kill_tick_snap",
        value=F.round("yaw_speed", 1),
        unit="deg/s",
        threshold=lines.snap_speed_dps,
        baseline=lines.clean_snap_p9999,
        severity="strong",
        note=fill(
            K.NOTE_SNAP,
            speed=fixed(F.col("yaw_speed"), 0),
            clean=f"{lines.clean_snap_p9999:.0f}",
        ),
        tick_start=F.col("tick") - K.TICK_RATE,
        tick_end=F.col("tick") + K.TICK_RATE // 2,
        tick=F.col("tick"),
    )


def impossible_pitch(deltas: DataFrame, anchors: DataFrame, lines: Lines) -> DataFrame:
    found = out_of_range_runs(deltas, lines.max_pitch_deg)
    return _evidence(
        found,
        trigger="impossible_pitch",
        name="impossible_pitch",
        value=F.round("peak", 2),
        unit="deg",
        threshold=lines.max_pitch_deg,
        baseline=None,
        severity="impossible",
        note=fill(
            K.NOTE_PITCH,
            peak=fixed(F.col("peak"), 1),
            limit=f"{lines.max_pitch_deg:.0f}",
        ),
        **_span(found),
    )


Rule = Callable[[DataFrame, DataFrame, Lines], DataFrame]
RULES: dict[str, Rule] = {
    "spinbot": spinbot,
    "aliased_spin": aliased_spin,
    "kill_tick_snap": kill_tick_snap,
    "impossible_pitch": impossible_pitch,
}


def run_rules(
    deltas: DataFrame,
    anchors: DataFrame,
    *,
    lines: Lines = Lines(),
    rules: Mapping[str, Rule] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Evidence rows of every rule over all sessions at once.

    Each rule reads ``deltas`` again, so it is staged once, unless it is ``stored`` as it comes.
    """
    deltas = deltas if stored else staged(deltas)
    out: DataFrame | None = None
    for rule in (rules or RULES).values():
        found = rule(deltas, anchors, lines)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no rules to run")
    return out


def worst_hits(evidence: DataFrame, top: int = K.RULE_EVIDENCE_PER_CASE) -> DataFrame:
    """Per entity the worst hit of each rule with its episode count, most severe first."""
    rank = severity_rank(F.col("severity"))
    tall = evidence.withColumn("rank", rank)
    worst = tall.groupBy("session_id", "entity_id", "name").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.min(
            F.struct(
                "rank",
                (-F.col("value")).alias("neg"),
                "tick",
                "value",
                "unit",
                "severity",
                "threshold",
                "note",
            )
        ).alias("w"),
    )
    order = W.partitionBy("session_id", "entity_id").orderBy(
        "rank", F.desc("value"), "name"
    )
    more = F.when(
        F.col("episodes") > 1,
        F.concat(
            F.col("w.note"),
            F.lit(" — "),
            F.col("episodes").cast("string"),
            F.lit(" such episodes this match"),
        ),
    ).otherwise(F.col("w.note"))
    # one row per rule name remains, so the window is as small as the rule registry
    return (
        worst.select(
            "session_id",
            "entity_id",
            "name",
            "episodes",
            "w.rank",
            "w.value",
            "w.unit",
            "w.severity",
            "w.threshold",
            "w.tick",
            more.alias("note"),
        )
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= top)
    )


def ranked_findings(evidence: DataFrame) -> DataFrame:
    """Every finding with its ``place`` in the entity's report: severity, then value."""
    keyed = evidence.withColumns(
        {"_rank": severity_rank(F.col("severity")), "_neg": -F.col("value")}
    )
    return number_by_range(
        keyed, ENTITY, ["_rank", "_neg", "name", "tick"], "place"
    ).drop("_rank", "_neg")


def entity_extremes(
    deltas: DataFrame, anchors: DataFrame, *, sustain: int = 16, min_step: float = 90.0
) -> DataFrame:
    """Per entity: the most extreme value of each rule's measurement."""
    smooth = rolling_median(deltas, F.coalesce("yaw_speed", F.lit(0.0)), sustain)
    base = smooth.groupBy(*ENTITY).agg(
        F.max("rolling").alias("sustained_speed"),
        F.max("yaw_speed").alias("single_tick_speed"),
        F.max(F.abs(F.col("pitch").cast("double"))).alias("max_abs_pitch"),
    )
    longest = (
        alternating_runs(deltas, min_step, 1)
        .groupBy(*ENTITY)
        .agg(F.max("length").alias("longest_flip_run"))
    )
    at = (
        anchor_speeds(deltas, anchors)
        .groupBy(*ENTITY)
        .agg(F.max("yaw_speed").alias("max_anchor_speed"))
    )
    return (
        base.join(longest, list(ENTITY), "left")
        .join(at, list(ENTITY), "left")
        .withColumn("longest_flip_run", F.coalesce("longest_flip_run", F.lit(0)))
    )


def calibrate(
    extremes: DataFrame, *, sustain: int = 16, quantile_method: str = "linear"
) -> DataFrame:
    """Rule lines from a clean population's extremes, and how many exceed them."""
    tall = extremes.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for c in K.CALIBRATION
                ]
            )
        )
    )
    wanted = sorted({q for q, _ in K.CALIBRATION.values()})
    names = {q: f"q{i}" for i, q in enumerate(wanted)}
    found = quantiles(
        tall,
        ["feature"],
        "value",
        {n: q for q, n in names.items()},
        method=quantile_method,
    )

    def line(feature: str) -> Column:
        q, headroom = K.CALIBRATION[feature]
        picked = F.max(F.when(F.col("feature") == feature, F.col(names[q])))
        return F.coalesce(picked, F.lit(0.0)) * headroom

    lines = found.agg(
        F.least(
            F.bround(line("sustained_speed") / 10) * 10,
            F.lit(K.MAX_MEASURABLE_SPEED * 0.9),
        ).alias("spin_speed_dps"),
        (F.bround(line("max_anchor_speed") / 10) * 10).alias("snap_speed_dps"),
        F.greatest(line("longest_flip_run").cast("int") + 2, F.lit(6)).alias(
            "alias_min_ticks"
        ),
    )
    return attach_row(extremes, lines).groupBy(
        "spin_speed_dps", "snap_speed_dps", "alias_min_ticks"
    ).agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("sustained_speed") > F.col("spin_speed_dps")).alias(
            "above_spin"
        ),
        F.count_if(F.col("max_anchor_speed") > F.col("snap_speed_dps")).alias(
            "above_snap"
        ),
        F.count_if(F.col("longest_flip_run") >= F.col("alias_min_ticks")).alias(
            "above_alias"
        ),
        F.max("max_abs_pitch").alias("max_abs_pitch"),
    )


def rule_hits(evidence: DataFrame, roster: DataFrame) -> DataFrame:
    """Hits per rule for every entity of the roster (zero where none)."""
    wide = (
        evidence.groupBy(*ENTITY)
        .pivot("trigger", list(RULES))
        .agg(F.count(F.lit(1)))
    )
    out = roster.join(wide, list(ENTITY), "left")
    for rule in RULES:
        out = out.withColumn(rule, F.coalesce(rule, F.lit(0)))
    return out.withColumn("any_rule", F.greatest(*RULES) > 0)


def rule_hit_rates(hits: DataFrame) -> DataFrame:
    """Share of entities each rule fires on, per label."""
    return hits.groupBy("label").agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.avg((F.col(r) > 0).cast("int")).alias(r) for r in RULES],
        F.avg(F.col("any_rule").cast("int")).alias("any_rule"),
    )


def flag_precision(hits: DataFrame) -> DataFrame:
    """Of the flagged entities with a usable label, the share that is positive."""
    usable = F.col("any_rule") & (F.col("label") != "unknown")
    positive = F.when(usable, (F.col("label") == "cheater").cast("int"))
    return hits.agg(
        F.count_if(usable).alias("flagged"),
        F.avg(positive).alias("precision"),
        F.count_if(F.col("any_rule") & (F.col("label") == "clean")).alias(
            "clean_flagged"
        ),
    )
