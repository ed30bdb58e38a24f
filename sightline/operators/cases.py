"""Case documents: top moments, evidence points, verdicts, the guard, and the text.

Cases of all entities are built by joins; what a case nests (a few moments, a few
rule hits, a short trajectory) is bounded before it is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions import text as T
from sightline.functions.labels import (
    alias_ids,
    corroborated,
    fingerprint,
    level,
    seek_command,
    severity_rank,
    split_for,
    stable_choice,
    target_probability,
    verdict_for,
)
from sightline.operators.features import approach_point, on_approach
from sightline.operators.ordered import attach_row, number_by_range

ENTITY = ("session_id", "entity_id")

MOMENT_FIELDS = {
    "window_uid": "string",
    "tick": "long",
    "weapon": "string",
    "headshot": "boolean",
    "distance": "double",
    "walls_penetrated": "int",
    "through_smoke": "boolean",
    "reaction_ms": "double",
    "angle_at_first_visible": "double",
    "aim_through_wall_share": "double",
    "speed_at_kill": "double",
    "corrections": "int",
    "visible_before_kill": "boolean",
    "sight_checked": "boolean",
    "last_seen_ms": "double",
    "victim_fired_ms_ago": "double",
    "victim_was_running": "boolean",
    "allies_alive": "int",
    "enemies_alive": "int",
}


def rank_moments(features: DataFrame) -> Column:
    """Place of a window within its entity: aimed through cover most, then closest."""
    order = W.partitionBy(*ENTITY).orderBy(
        F.desc_nulls_last("aim_through_wall_share"),
        F.asc_nulls_last("angle_at_first_visible"),
        "window_uid",
    )
    return F.row_number().over(order)


def top_moments(features: DataFrame, k: int = K.MOMENTS_PER_CASE) -> DataFrame:
    """The ``k`` windows per entity most worth a look, with ``place``."""
    return features.withColumn("place", rank_moments(features)).filter(
        F.col("place") <= k
    )


#: What an entity could have known when a window's anchor came.
CONTEXT = (
    "sight_checked",
    "last_seen_ms",
    "victim_fired_ms_ago",
    "victim_was_running",
    "allies_alive",
    "enemies_alive",
)


def moments_in_context(
    features: DataFrame, windows: DataFrame, k: int = K.MOMENTS_PER_CASE
) -> DataFrame:
    """:func:`top_moments` with their tick and context, as ``sessions.session_windows`` has them.

    Merged: a row per window lies in so small a file that it would be broadcast through the driver.
    """
    known = [c for c in CONTEXT if c in windows.columns]
    return top_moments(features, k).join(
        windows.select("window_uid", "tick", *known).hint("merge"), "window_uid"
    )


def trajectories(
    moments: DataFrame,
    window_ticks: DataFrame,
    *,
    stride: int = K.TRAJECTORY_STRIDE,
    span_ms: tuple[float, float] = K.TRAJECTORY_MS,
) -> DataFrame:
    """Sampled approach of each given window: window_uid, trajectory."""
    sampled = window_ticks.filter(on_approach(stride, span_ms)).join(
        moments.select("window_uid"), "window_uid", "left_semi"
    )
    return sampled.groupBy("window_uid").agg(
        F.sort_array(F.collect_list(approach_point())).alias("trajectory")
    )


def position_tracks(
    window_ticks: DataFrame, *, stride: int = 8, span_ms: tuple[float, float] = K.TRAJECTORY_MS
) -> DataFrame:
    """Both entities' sampled positions per window, as one array."""
    point = F.struct(
        F.col("t_ms").cast("int").alias("ms"),
        *[F.col(c) for c in ("x", "y", "z", "yaw")],
        *[F.col(f"target_{c}") for c in "xyz"],
        F.col("target_visible").alias("visible"),
    )
    return (
        window_ticks.filter(
            F.col("t_ms").between(*span_ms)
            & (F.col("tick_offset") % stride == 0)
            & F.col("x").isNotNull()
            & F.col("y").isNotNull()
        )
        .groupBy("window_uid")
        .agg(F.sort_array(F.collect_list(point)).alias("path"))
    )


def reference_row(baselines: DataFrame, lines: DataFrame) -> DataFrame:
    """The reference population as one row of two maps (one entry per measurement)."""
    base = baselines.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "baseline"))).alias(
            "baselines"
        )
    )
    edge = F.struct("feature", F.struct("notable", "strong").alias("line"))
    edges = lines.agg(F.map_from_entries(F.collect_list(edge)).alias("lines"))
    return attach_row(base, edges)


def report_places(entities: DataFrame) -> DataFrame:
    """``place`` of each entity in its session's report, and its ``alias``.

    Flagged entities come first, then higher scores, unscored ones last; aliases number
    a session's entities by the text of their ids. A session's roster is small.
    """
    session = W.partitionBy("session_id")
    identity = F.col("entity_id").cast("string")
    order = session.orderBy(F.desc("flagged"), F.desc_nulls_last("score"), identity)
    return entities.withColumns(
        {
            "place": F.row_number().over(order),
            "alias": alias_ids(F.row_number().over(session.orderBy(identity))),
        }
    )


def session_text(entities: DataFrame, *, min_windows: int = K.MIN_WINDOWS) -> DataFrame:
    """One text per session: a line for each entity in report order, then flagged ones' reasons.

    ``entities``: session_id, entity_id, name, kills, n_windows, score, percentile, flagged
    and flag_reasons. A score of too few windows has a star. A roster is small, so a
    session's lines are gathered; names are cut to their column.
    """
    few = F.col("score").isNotNull() & (F.col("n_windows") < min_windows)
    label = F.coalesce("name", F.col("entity_id").cast("string"))
    shown = F.coalesce(T.fixed(F.col("score"), 2), F.lit("-"))
    line = F.concat(
        F.when(F.col("flagged"), "! ").otherwise("  "),
        F.rpad(label, 22, " "),
        F.lpad(F.col("kills").cast("string"), 6, " "),
        F.lpad(F.concat(shown, F.when(few, "*").otherwise("")), 8, " "),
        F.lit("  "),
        T.percentile_text(F.col("percentile")),
    )
    why = F.when(
        F.col("flagged"),
        F.concat(F.lit("! "), label, F.lit(": "), F.array_join("flag_reasons", "; ")),
    )
    gathered = (
        report_places(entities)
        .select("session_id", "place", line.alias("line"), why.alias("why"), few.alias("few"))
        .groupBy("session_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("place", "line", "why"))).alias("rows"),
            F.max("few").alias("few"),
        )
    )
    head = F.concat(
        F.lit("  "), F.rpad(F.lit("entity"), 22, " "), F.lit(" kills   score  of clean")
    )
    note = F.when(F.col("few"), F.array(F.lit("* few windows"))).otherwise(
        F.array().cast("array<string>")
    )
    parts = F.concat(
        F.array(head),
        F.transform("rows", lambda r: r["line"]),
        note,
        F.array_compact(F.transform("rows", lambda r: r["why"])),
    )
    return gathered.select("session_id", F.array_join(parts, "\n").alias("text"))


def report_documents(
    entities: DataFrame,
    kills: DataFrame,
    findings: DataFrame,
    rounds: DataFrame,
    *,
    per_entity: int = K.MOMENTS_PER_CASE,
) -> DataFrame:
    """One nested report per session: its rounds and its entities in report order.

    ``kills`` and ``findings`` carry ``place``, from 1, per entity. At most ``per_entity``
    kills go in, and every finding (``rules.ranked_findings``, which stays the table to read
    where one entity's findings may not fit a row).
    ``rounds``: session_id, number, start, end.
    """

    def nested(table: DataFrame, name: str) -> DataFrame:
        columns = [c for c in table.columns if c not in (*ENTITY, "place")]
        listed = F.array_sort(F.collect_list(F.struct("place", *columns)))
        return table.groupBy(*ENTITY).agg(listed.alias(name))

    keys = list(ENTITY)
    whole = (
        report_places(entities)
        .join(nested(kills.filter(F.col("place") <= per_entity), "kills"), keys, "left")
        .join(nested(findings, "findings"), keys, "left")
    )
    order = ["place", *[c for c in whole.columns if c not in ("session_id", "place")]]
    people = whole.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("entities")
    )
    played = rounds.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "start", "end"))).alias("rounds")
    )
    return people.join(played, "session_id", "left")


def case_documents(
    entities: DataFrame,
    moments: DataFrame,
    reference: DataFrame,
    *,
    rule_hits: DataFrame | None = None,
    approach: DataFrame | None = None,
    features: Sequence[str] = tuple(K.FEATURE_LABELS),
) -> DataFrame:
    """One nested row per entity.

    ``entities``: entity features plus ``score`` (and optionally ``map``, ``rank``).
    ``moments``: :func:`top_moments`; ``rule_hits``: ``rules.worst_hits``. ``approach``:
    :func:`trajectories`, where moments do not carry their ``trajectory``.
    ``reference``: one row (see :func:`reference_row`), so it is broadcast.
    """
    present = [f for f in features if f in entities.columns]
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value"))
            for f in present
        ]
    )
    known = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    def optional(df: DataFrame, name: str, kind: str) -> Column:
        c = F.col(name) if name in df.columns else F.lit(None)
        return c.cast(kind).alias(name)

    told = moments
    if approach is not None:
        told = told.join(approach, "window_uid", "left")
    elif "trajectory" not in moments.columns:
        told = told.withColumn(
            "trajectory",
            F.lit(None).cast(
                "array<struct<ms:int,angle:double,visible:boolean,speed:double>>"
            ),
        )
    packed = told.select(
        *ENTITY,
        F.struct(
            "place",
            *[optional(moments, n, k) for n, k in MOMENT_FIELDS.items()],
            "trajectory",
        ).alias("m"),
    )
    nested = packed.groupBy(*ENTITY).agg(F.collect_list("m").alias("moments"))
    places = F.sequence(F.lit(1), F.size("moments"))
    by_place = F.transform(
        places, lambda n: F.filter("moments", lambda m: m["place"] == n)[0]
    )
    nested = nested.withColumn("moments", by_place)

    hit_type = (
        "array<struct<place:int,name:string,severity:string,value:double,"
        "tick:bigint,note:string>>"
    )
    out = entities.select(
        *ENTITY,
        *[c for c in ("label",) if c in entities.columns],
        optional(entities, "map", "string"),
        optional(entities, "rank", "string"),
        F.col("n_kills").alias("kills"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        known.alias("features"),
    ).join(nested, list(ENTITY), "left")
    if rule_hits is not None:
        hits = rule_hits.groupBy(*ENTITY).agg(
            F.sort_array(
                F.collect_list(
                    F.struct("place", "name", "severity", "value", "tick", "note")
                )
            ).alias("rule_evidence")
        )
        out = out.join(hits, list(ENTITY), "left")
    else:
        out = out.withColumn("rule_evidence", F.lit(None).cast(hit_type))
    def filled(name: str) -> Column:
        return F.coalesce(name, F.array().cast(out.schema[name].dataType))

    return attach_row(out, reference).withColumns(
        {"moments": filled("moments"), "rule_evidence": filled("rule_evidence")}
    )


# --- evidence points --------------------------------------------------------------


def _point(reason: Column, weight: Column, kind: Column, from_rule: bool) -> Column:
    return F.struct(
        reason.alias("reason"),
        weight.cast("double").alias("weight"),
        kind.alias("kind"),
        F.lit(from_rule).alias("from_rule"),
    )


def _measurements(features: Sequence[str]) -> Column:
    """Measurements of the case next to the reference: an array of structs.

    One lambda then serves every measurement, which keeps the plan small.
    """
    rows = []
    for f in features:
        said, direction = K.FEATURE_LABELS[f]
        line = F.col("lines")[f]
        rows.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.lit(said).alias("said"),
                F.lit(direction).alias("direction"),
                F.col("features")[f].alias("value"),
                F.col("baselines")[f].alias("base"),
                line["notable"].alias("notable"),
                line["strong"].alias("strong"),
            )
        )
    return F.transform(
        F.filter(F.array(*rows), lambda r: r["value"].isNotNull()),
        lambda r: F.struct(
            r["feature"].alias("feature"),
            r["said"].alias("said"),
            r["direction"].alias("direction"),
            T.number(r["value"]).alias("value"),
            T.number(r["base"]).alias("base"),
            T.number(r["notable"]).alias("notable"),
            T.number(r["strong"]).alias("strong"),
        ),
    )


def _check_points() -> Column:
    """A point for every check whose displayed value is past its displayed line."""
    table = F.create_map(
        *[
            part
            for feature, higher, kind, sentence in K.CHECKS
            for part in (
                F.lit(feature),
                F.struct(
                    F.lit(higher).alias("higher"),
                    F.lit(kind).alias("kind"),
                    F.lit(sentence).alias("sentence"),
                ),
            )
        ]
    )

    def point(m: Column) -> Column:
        check = table[m["feature"]]
        share = m["feature"].endswith("_share")
        value, base = m["value"], F.coalesce(m["base"], m["notable"])
        found = level(
            value.cast("double"),
            m["notable"].cast("double"),
            m["strong"].cast("double"),
            check["higher"],
        )
        reason = F.replace(
            F.replace(
                check["sentence"],
                F.lit("{value}"),
                F.when(share, T.as_percent(value)).otherwise(value),
            ),
            F.lit("{base}"),
            F.when(share, T.as_percent(base)).otherwise(base),
        )
        weight = F.when(found == "strong", K.WEIGHTS["strong"]).otherwise(
            K.WEIGHTS["notable"]
        )
        return F.when(found.isNotNull(), _point(reason, weight, check["kind"], False))

    shown = F.filter(
        _measurements([c[0] for c in K.CHECKS]), lambda m: m["notable"].isNotNull()
    )
    return F.array_compact(F.transform(shown, point))


def aimed_through_cover(m: Column, wall_aim: float = K.WALL_AIM_KILL) -> Column:
    share = F.coalesce(m["aim_through_wall_share"], F.lit(0.0))
    return F.coalesce(m["sight_checked"], F.lit(False)) & (share >= wall_aim)


def seen_or_heard(m: Column) -> Column:
    return (
        m["last_seen_ms"].isNotNull()
        | m["victim_fired_ms_ago"].isNotNull()
        | F.coalesce(m["victim_was_running"], F.lit(False))
    )


def _awareness_point(wall_aim: float) -> Column:
    unexplained = F.size(
        F.filter("moments", lambda m: aimed_through_cover(m, wall_aim) & ~seen_or_heard(m))
    )
    reason = T.fill(K.AWARENESS_REASON, n=unexplained, all=F.size("moments"))
    weight = F.lit(K.WEIGHTS["notable"])
    return F.when(unexplained >= 2, _point(reason, weight, F.lit("wallhack"), False))


def _rule_points() -> Column:
    def weight(severity: Column) -> Column:
        out = F.lit(K.WEIGHTS["notable"])
        for name, w in K.RULE_WEIGHTS.items():
            out = F.when(severity == name, w).otherwise(out)
        return out

    return F.transform(
        "rule_evidence",
        lambda e: _point(
            F.concat(F.lit(f"{K.RULE_REASON}: "), e["note"]),
            weight(e["severity"]),
            F.lit("aimbot"),
            True,
        ),
    )


def evidence_points(wall_aim: float = K.WALL_AIM_KILL) -> Column:
    """Points worth citing, heaviest first; equal weights keep their order."""
    every = F.concat(
        _check_points(), F.array_compact(F.array(_awareness_point(wall_aim))), _rule_points()
    )
    placed = F.transform(
        every,
        lambda p, i: F.struct((-p["weight"]).alias("w"), i.alias("i"), p.alias("p")),
    )
    return F.transform(F.array_sort(placed), lambda s: s["p"])


def counted(points: Column) -> Column:
    """Points that count: for a heavy sniper the perception ones do not."""
    heavy = F.coalesce(F.col("features")["sniper_share"], F.lit(0.0)) >= K.SNIPER_HEAVY
    return F.filter(points, lambda p: ~heavy | (p["kind"] != "wallhack"))


def standard_caveats(wall_aim: float = K.WALL_AIM_KILL) -> Column:
    covered = F.filter("moments", lambda m: aimed_through_cover(m, wall_aim))
    explained = (F.size(covered) > 0) & F.forall(covered, seen_or_heard)
    heavy = F.coalesce(F.col("features")["sniper_share"], F.lit(0.0)) >= K.SNIPER_HEAVY
    return F.array_compact(
        F.array(
            F.when(
                F.col("kills") < 10, T.fill(K.CAVEAT_FEW_KILLS, n=F.col("kills"))
            ),
            F.when(explained, K.CAVEAT_EXPLAINED),
            F.when(heavy, K.CAVEAT_SNIPER),
        )
    )


def case_key() -> Column:
    return F.concat_ws(
        "/", F.col("session_id").cast("string"), F.col("entity_id").cast("string")
    )


def split_case_key(key: Column) -> Column:
    """A case key back as (session_id, entity_id): the entity is what follows the last slash."""
    parts = F.split(key, "/", -1)
    session = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    return F.struct(session.alias("session_id"), F.element_at(parts, -1).alias("entity_id"))


def targets(cases: DataFrame, *, wall_aim: float = K.WALL_AIM_KILL) -> DataFrame:
    """Adds the verdict a case's own evidence supports.

    ``wall_aim``: share of an approach aimed through cover from which a moment asks how the
    entity knew.

    verdict, probability, cheat_type, reasons (at most 3), caveats (at most 2). The
    probability comes first and the word follows; an accusation on a single line is
    held at unclear.
    """
    key = case_key()
    # the points are a long expression: they get their own projection
    scored = cases.withColumn("points", evidence_points(wall_aim)).withColumn(
        "counted", counted(F.col("points"))
    )
    weight = F.aggregate("counted", F.lit(0.0), lambda acc, p: acc + p["weight"])
    scored = scored.withColumn("weight", weight).withColumn(
        "_p", target_probability(F.col("weight"), F.col("kills"))
    )
    accused = verdict_for(F.col("_p")) == "cheating"
    held = accused & ~corroborated(F.col("counted"))
    scored = scored.withColumn(
        "verdict", F.when(held, "unclear").otherwise(verdict_for(F.col("_p")))
    ).withColumn(
        "probability",
        F.when(held, F.least(F.col("_p"), F.lit(K.UNCLEAR_PROBABILITY[1])))
        .otherwise(F.col("_p")),
    )
    kinds = F.array_distinct(F.transform("counted", lambda p: p["kind"]))
    signal = F.when(
        F.size("points") > 0,
        F.concat(F.lit("the strongest signal: "), F.get(F.col("points"), F.lit(0))["reason"]),
    )
    said = (
        F.when(
            F.col("verdict") == "cheating",
            F.slice(F.transform("counted", lambda p: p["reason"]), 1, 3),
        )
        .when(
            F.col("verdict") == "unclear",
            F.array_compact(F.array(stable_choice(key, K.UNCLEAR_PHRASES), signal)),
        )
        .otherwise(F.array(stable_choice(key, K.CLEAN_PHRASES)))
    )
    return scored.withColumns(
        {
            "cheat_type": F.when(
                F.col("verdict") == "cheating",
                F.when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, F.lit(0))),
            ).otherwise("none"),
            "reasons": said,
            "caveats": F.slice(standard_caveats(wall_aim), 1, 2),
        }
    ).drop("_p")


def features_for(generation: int) -> list[str]:
    """Measurements one generation of the format shows, in order."""
    return [
        f
        for f in K.FEATURE_LABELS
        if K.FEATURE_SINCE.get(f, 1) <= generation <= K.FEATURE_UNTIL.get(f, generation)
    ]


def guard(
    cases: DataFrame,
    generation: int = K.LATEST_FORMAT,
    *,
    verdict: str = "verdict",
    probability: str = "probability",
    cheat_type: str = "cheat_type",
) -> DataFrame:
    """Hold a given accusation that the shown measurements do not corroborate.

    Adds shown_verdict, shown_probability, shown_type and held_note (NULL when the
    verdict stands).
    """
    visible = set(features_for(generation))
    hidden = [f for f in K.FEATURE_LABELS if f not in visible]
    seen = cases.withColumn("_whole", F.col("features")).withColumn(
        "features", F.map_filter("features", lambda k, v: ~k.isin(hidden))
    )
    seen = seen.withColumn("_counted", counted(evidence_points()))
    lines = F.filter("_counted", lambda p: ~p["from_rule"])
    strong = F.size(F.filter(lines, lambda p: p["weight"] >= K.WEIGHTS["strong"]))
    held = (F.col(verdict) == "cheating") & ~corroborated(F.col("_counted"))
    basis = (
        F.when((strong == 1) & (F.size(lines) == 1), K.HELD_ONE_LINE)
        .when((strong == 0) & (F.size(lines) > 0), K.HELD_NOTABLE)
        .otherwise(K.HELD_OTHER)
    )
    named = F.when(F.col(cheat_type) == "none", "").otherwise(
        F.concat(F.lit(", "), F.col(cheat_type))
    )
    said = F.concat(F.col(probability).cast("string"), F.lit("%"), named)
    note = T.fill(K.HELD_NOTE, said=said, basis=basis)
    out = seen.withColumns(
        {
            "shown_verdict": F.when(held, "unclear").otherwise(F.col(verdict)),
            "shown_probability": F.when(
                held, F.least(F.col(probability), F.lit(K.UNCLEAR_PROBABILITY[1]))
            ).otherwise(F.col(probability)),
            "shown_type": F.when(held, "none").otherwise(F.col(cheat_type)),
            "held_note": F.when(held, note),
        }
    )
    # the caller's own measurements stay as they were
    return out.drop("_counted", "features").withColumnRenamed("_whole", "features")


# --- text -------------------------------------------------------------------------


def _measurement_lines(features: Sequence[str]) -> Column:
    def line(m: Column) -> Column:
        side = F.when(m["direction"] == "higher", "below").otherwise("above")
        edges = F.concat(
            F.lit(" (clean "),
            m["base"],
            F.lit("; 95% of clean players are "),
            side,
            F.lit(" "),
            m["notable"],
            F.lit(", 99% "),
            side,
            F.lit(" "),
            m["strong"],
            F.lit(")"),
        )
        plain = F.concat(
            F.lit(" (clean "), m["base"], F.lit(", "), m["direction"], F.lit(" is suspicious)")
        )
        tail = F.coalesce(edges, plain, F.lit(""))
        return F.concat(F.lit("- "), m["said"], F.lit(": "), m["value"], tail)

    return F.transform(_measurements(features), line)


def _moment_lines(m: Column, n: Column) -> Column:
    gun = T.plain(m["weapon"], "weapon")
    head = F.coalesce(m["headshot"], F.lit(False))
    walls = F.coalesce(m["walls_penetrated"], F.lit(0))
    reaction, first = m["reaction_ms"], m["angle_at_first_visible"]
    fixes = m["corrections"]
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("tick "), m["tick"].cast("string")),
        F.when(
            gun.isNotNull(), F.concat(gun, F.when(head, " headshot").otherwise(""))
        ).when(head, "headshot"),
        F.concat(T.fixed(m["distance"], 0), F.lit(" m away")),
        F.when(walls == 1, "shot through a wall").when(
            walls > 1,
            F.concat(F.lit("shot through "), walls.cast("string"), F.lit(" walls")),
        ),
        F.when(m["through_smoke"], "shot through smoke"),
        F.when(
            reaction < 1990,
            F.concat(
                F.lit("killed "),
                T.fixed(reaction, 0),
                F.lit(" ms after the enemy appeared"),
            ),
        )
        .when(
            reaction.isNotNull(), "enemy was visible the whole 2 s before the kill"
        )
        .when(~m["visible_before_kill"], "enemy never became visible before dying"),
        F.concat(
            F.lit("crosshair "), T.fixed(first, 1), F.lit("° off when they appeared")
        ),
        F.concat(
            T.fixed(m["aim_through_wall_share"] * 100, 0),
            F.lit("% of the approach aimed through cover"),
        ),
        F.concat(
            fixes.cast("string"),
            F.when(fixes == 1, " aim correction").otherwise(" aim corrections"),
        ),
    )
    context = T.context_sentence(
        m["sight_checked"],
        m["last_seen_ms"],
        m["victim_fired_ms_ago"],
        m["victim_was_running"],
        m["allies_alive"],
        m["enemies_alive"],
    )
    points = F.coalesce(m["trajectory"], F.array().cast("array<struct<ms:int,angle:double,visible:boolean,speed:double>>"))
    table = F.transform(
        points,
        lambda p: F.concat(
            F.lit("   "),
            F.format_string("%+6d", p["ms"]),
            F.lit("ms "),
            F.lpad(T.fixed(p["angle"], 1), 7, " "),
            F.lit("°  "),
            F.when(p["visible"], "visible").otherwise("hidden"),
            F.when(p["ms"] == 0, "  <- shot").otherwise(""),
        ),
    )
    return F.concat(
        F.array(F.concat(n.cast("string"), F.lit(". "), parts)),
        F.when(
            context != "", F.array(F.concat(F.lit("   context: "), context))
        ).otherwise(F.array().cast("array<string>")),
        F.when(
            F.size(points) > 0, F.array(F.lit("     time   off-target  enemy"))
        ).otherwise(F.array().cast("array<string>")),
        table,
    )


def render_case(generation: int = K.LATEST_FORMAT) -> Column:
    """The case as text, line by line; strings the source supplied pass a whitelist."""
    who = F.coalesce(
        T.plain(F.col("entity_id").cast("string"), "player"), F.lit("unknown")
    )
    place, rank = T.plain(F.col("map"), "map"), T.plain(F.col("rank"), "rank")
    header = F.concat(
        F.lit("PLAYER "),
        who,
        F.lit(" — "),
        F.col("kills").cast("string"),
        F.lit(" kills"),
        F.coalesce(F.concat(F.lit(" on "), place), F.lit("")),
        F.coalesce(F.concat(F.lit(", lobby rank "), rank), F.lit("")),
    )
    measured = _measurement_lines(features_for(generation))
    rules = F.transform(
        "rule_evidence",
        lambda e: F.concat(
            F.lit("- ["),
            e["severity"],
            F.lit("] "),
            e["note"],
            F.lit(" (tick "),
            e["tick"].cast("string"),
            F.lit(")"),
        ),
    )
    none = F.array().cast("array<string>")
    kills = F.flatten(F.transform("moments", lambda m, i: _moment_lines(m, i + 1)))
    return F.array_join(
        F.concat(
            F.array(
                header,
                F.concat(F.lit("Behaviour model score: "), T.fixed(F.col("score"), 2)),
                F.lit(""),
                F.lit("MEASUREMENTS (player vs typical clean player)"),
            ),
            measured,
            F.when(
                F.size("rule_evidence") > 0,
                F.concat(
                    F.array(F.lit(""), F.lit("HARD-LIMIT CHECKS TRIGGERED")), rules
                ),
            ).otherwise(none),
            F.when(
                F.size("moments") > 0,
                F.concat(F.array(F.lit(""), F.lit("MOST SUSPICIOUS KILLS")), kills),
            ).otherwise(none),
        ),
        "\n",
    )


# --- flags, reports, training rows --------------------------------------------------


def flags(
    entities: DataFrame,
    evidence: DataFrame,
    grid: DataFrame,
    *,
    quantile: float = K.FLAG_QUANTILE,
    min_windows: int = K.MIN_WINDOWS,
) -> DataFrame:
    """``flagged`` and ``flag_reasons``: a strong rule hit, or a score past the line.

    ``grid``: a clean score grid (level, cut) that holds ``quantile``.
    """
    worst = evidence.groupBy(*ENTITY).agg(
        F.min(severity_rank(F.col("severity"))).alias("_worst"),
        F.count(F.lit(1)).alias("findings"),
    )
    line = grid.filter(F.abs(F.col("level") - quantile) < 1e-9).agg(
        F.max("cut").alias("_line")
    )
    rows = attach_row(entities.join(worst, list(ENTITY), "left"), line)
    by_rule = F.coalesce(F.col("_worst") <= 1, F.lit(False))
    by_score = F.coalesce(
        (F.col("score") >= F.col("_line")) & (F.col("n_windows") >= min_windows),
        F.lit(False),
    )
    reasons = F.array_compact(
        F.array(
            F.when(by_rule, "hard-limit finding"),
            F.when(by_score, "score above the clean line"),
        )
    )
    return rows.withColumns(
        {
            "flagged": by_rule | by_score,
            "flag_reasons": reasons,
            "findings": F.coalesce("findings", F.lit(0)),
        }
    ).drop("_worst", "_line")


def kill_reports(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Every anchor of every entity with its rank, score and seek command.

    One row per anchor: an entity's report is this table filtered, so no entity's
    anchors are ever gathered in one place.
    """
    ranked = features.withColumns(
        {
            "_wall": -F.coalesce("aim_through_wall_share", F.lit(-1.0)),
            "_angle": F.coalesce("angle_at_first_visible", F.lit(1e6)),
        }
    )
    placed = number_by_range(
        ranked, ENTITY, ["_wall", "_angle", "window_uid"], "place"
    ).drop("_wall", "_angle")
    return placed.join(
        scores.select("window_uid", "score"), "window_uid", "left"
    ).withColumn("command", seek_command(F.col("tick")))


def training_rows(
    cases: DataFrame, annotations: DataFrame | None, system: str, *, share: float = 0.2
) -> DataFrame:
    """Chat rows: system, evidence, answer; a fresh human verdict replaces ours.

    ``cases`` carry the target columns; ``annotations``: session_id, entity_id,
    evidence_sha, verdict, probability, answer. An annotation made on evidence that
    has changed since is stale and not used.
    """
    answer = F.to_json(
        F.struct("verdict", "probability", "cheat_type", "reasons", "caveats")
    )
    rows = cases.withColumn("evidence", render_case()).withColumns(
        {"generated_answer": answer, "sha": fingerprint(F.col("evidence"))}
    )
    if annotations is None:
        rows = rows.withColumns(
            {
                "human_answer": F.lit(None).cast("string"),
                "human_verdict": F.lit(None).cast("string"),
                "human_probability": F.lit(None).cast("int"),
                "human_sha": F.lit(None).cast("string"),
            }
        )
    else:
        human = annotations.select(
            *ENTITY,
            F.col("answer").alias("human_answer"),
            F.col("verdict").alias("human_verdict"),
            F.col("probability").alias("human_probability"),
            F.col("evidence_sha").alias("human_sha"),
        )
        rows = rows.join(human, list(ENTITY), "left")
    fresh = F.coalesce(F.col("human_sha") == F.col("sha"), F.lit(False))
    used = F.when(fresh, F.col("human_answer")).otherwise(F.col("generated_answer"))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return rows.select(
        *ENTITY,
        *[c for c in ("label",) if c in cases.columns],
        split_for(F.col("session_id").cast("string"), share).alias("split"),
        F.array(
            message("system", F.lit(system)),
            message("user", F.col("evidence")),
            message("assistant", used),
        ).alias("messages"),
        F.when(fresh, "human").otherwise("generated").alias("target_source"),
        (F.col("human_sha").isNotNull() & ~fresh).alias("stale"),
        F.when(fresh, F.col("human_verdict")).otherwise(F.col("verdict")).alias(
            "verdict"
        ),
        F.col("verdict").alias("generated"),
        F.when(
            fresh, F.abs(F.col("human_probability") - F.col("probability"))
        ).otherwise(F.lit(0)).alias("gap"),
    )
