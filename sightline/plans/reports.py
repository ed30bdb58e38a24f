"""Queries for documents built from the analysis: cases, verdicts, replays, sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.text import measurement_rows
from sightline.operators import cases as Z
from sightline.operators import evaluate as E
from sightline.operators import features as X
from sightline.operators import reference as P
from sightline.operators import replay as Y
from sightline.operators import rules as R
from sightline.operators import sampling as U
from sightline.operators import tensors as N
from sightline.operators.joins import compare_tables, state_of
from sightline.operators.ordered import attach_row, tick_chunk
from sightline.plans import adapters as A
from sightline.plans import space as SP
from sightline.plans import windows as Q
from sightline.plans.registry import query
from sightline.plans.series import _INTERVALS_SQL, _intervals
from sightline.session import ensure_checkpoint_dir, staged
from sightline.sources import manifest as MF
from sightline.sources import sinks

STRICT = R.Lines(
    spin_speed_dps=6500.0,
    spin_min_ticks=4,
    alias_min_step_deg=120.0,
    alias_min_ticks=4,
    snap_speed_dps=10500.0,
    max_pitch_deg=88.95,
)


@query(
    "session_id:l entity_id:l place:l window_uid:s",
    f"""WITH {A.WINDOWS_SQL}, {Q.AIM_SQL}, {Q.GEO_SQL}, {Q.PERCEPTION_SQL},
r AS (SELECT session_id, entity_id, window_uid, row_number() OVER (PARTITION BY session_id, entity_id
    ORDER BY round(aim_through_wall_share, 9) DESC NULLS LAST, round(angle_at_first_visible, 9) ASC NULLS LAST, window_uid) AS place
  FROM aim JOIN perc USING (window_uid))
SELECT * FROM r WHERE place <= 3""",
)
def top_moments(spark, d):
    rows = Q.full_features(A.stored_samples(spark, d)).withColumns(
        {
            c: F.round(c, 9)
            for c in ("aim_through_wall_share", "angle_at_first_visible")
        }
    )
    return Z.top_moments(rows)


def _cases(spark, d):
    """Cases with moments, approaches, strict rule hits and the clean reference."""
    s = A.stored_samples(spark, d)
    windows, ticks = Q.shot_windows(s)
    return _cases_of(s, ticks, windows.select("window_uid", "tick"))


def _context_cases(spark, d):
    """The same of whole sessions: sight by rays where there is a mesh, moments in context."""
    windows, ticks = SP._session_windows(spark, d)
    s = A.stored_samples(spark, d)
    return _cases_of(s, A.with_label(ticks), staged(windows))


def _cases_of(s, ticks, windows):
    features = staged(
        X.window_features(ticks, A.SEGMENTS, burst_gap=A.BURST_GAP, radius=A.RADIUS, stride=2)
    )
    entities = staged(X.entity_features(features, min_arrivals=2))
    # a moment is shown with fewer columns than its entity is measured by
    shown = [c for c in features.columns if c in (*Z.ENTITY, *Z.MOMENT_FIELDS, "trajectory")]
    moments = staged(
        Z.moments_in_context(
            features.select(*shown).withColumns(
                {
                    c: F.round(c, 9)
                    for c in ("aim_through_wall_share", "angle_at_first_visible")
                }
            ),
            windows,
        ).withColumn("trajectory", F.when(F.col("place") <= 2, F.col("trajectory")))
    )
    reference = Z.reference_row(
        P.clean_baselines(entities, Q.BASELINE_FEATURES),
        P.clean_lines(entities, Q.BASELINE_FEATURES),
    )
    scores = P.entity_scores(_scored(features)).select(
        "session_id", "entity_id", "score"
    )
    hits = R.worst_hits(Q.evidence(s, STRICT))
    return Z.case_documents(
        entities.join(scores, ["session_id", "entity_id"], "left"),
        moments,
        reference,
        rule_hits=hits,
    )


def _scored(features):
    z = (
        F.coalesce("peak_speed_engage", F.lit(0.0)) / 4000
        - 1
        + F.col("corrections") * 0.1
    )
    return features.withColumn("score", 1 / (1 + F.exp(-z)))


def _num(x: str) -> str:
    return (
        f"CASE WHEN {x} = 0 THEN '0' WHEN abs({x}) >= 100 THEN format('{{:.0f}}', {x}) "
        f"WHEN abs({x}) >= 1 THEN format('{{:.1f}}', {x}) ELSE format('{{:.2f}}', {x}) END"
    )


def _shown(x: str) -> str:
    return f"CAST({_num(x)} AS DOUBLE)"


_FEATURE_LIST = ", ".join(Q.BASELINE_FEATURES)
_FEATURE_CASTS = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in Q.BASELINE_FEATURES)
_EVIDENCE_STRICT = Q.evidence_sql(STRICT)[len(A.DELTAS_SQL) :]
TARGET_SQL = f"""{Q.ENTITY_PREFIX}, {Q.REFERENCE_SQL}, {Q.SCORE_SQL}{_EVIDENCE_STRICT},
tall AS (UNPIVOT (SELECT session_id, entity_id, n_kills, sniper_share AS snipes, {_FEATURE_CASTS} FROM entities)
  ON {_FEATURE_LIST} INTO NAME feature VALUE v),
lev AS (SELECT t.*, b.baseline, l.notable, l.strong, feature IN ('corrections_mean', 'visible_share') AS lower,
    {_shown("t.v")} AS sv, {_shown("l.notable")} AS sn, {_shown("l.strong")} AS ss
  FROM tall t LEFT JOIN lines l USING (feature) LEFT JOIN baselines b USING (feature)),
pts0 AS (SELECT session_id, entity_id, snipes, CASE WHEN feature IN ('wall_aim_share', 'never_visible_share') THEN 'wallhack' ELSE 'aimbot' END AS kind,
    CASE WHEN (lower AND sv < ss) OR (NOT lower AND sv > ss) THEN 1.0 WHEN (lower AND sv < sn) OR (NOT lower AND sv > sn) THEN 0.4 END AS weight, false AS from_rule
  FROM lev WHERE feature IN ('wall_aim_share', 'never_visible_share', 'straight_share', 'corrections_mean', 'fast_kills', 'snap_kills')),
hitw AS (SELECT session_id, entity_id, name, min(CASE severity WHEN 'impossible' THEN 0 ELSE 1 END) AS rank, max(value) AS value FROM evidence GROUP BY 1, 2, 3),
hit3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, entity_id ORDER BY rank, value DESC, name) AS rn FROM hitw) WHERE rn <= 3),
pts AS (SELECT * FROM pts0 WHERE weight IS NOT NULL
  UNION ALL SELECT session_id, entity_id, NULL, 'aimbot', CASE rank WHEN 0 THEN 2.0 ELSE 1.0 END, true FROM hit3),
cnt AS (SELECT * FROM pts WHERE NOT (coalesce(snipes, 0) >= 0.5 AND kind = 'wallhack')),
agg AS (SELECT session_id, entity_id, sum(weight) AS weight, count(DISTINCT kind) AS kinds, min(kind) AS kind, count(*) AS n_counted,
    count(*) FILTER (NOT from_rule) AS n_lines, count(*) FILTER (from_rule) AS n_rules,
    coalesce(bool_or(from_rule AND weight >= 2), false) AS beyond, coalesce(bool_or(NOT from_rule AND weight >= 1), false) AS strong FROM cnt GROUP BY 1, 2),
npts AS (SELECT session_id, entity_id, count(*) AS n_points FROM pts GROUP BY 1, 2),
tg AS (SELECT e.session_id, e.entity_id, e.n_kills AS kills, coalesce(e.sniper_share, 0) AS snipes, coalesce(a.weight, 0) AS weight, coalesce(p.n_points, 0) AS n_points, coalesce(n_counted, 0) AS n_counted,
    kinds, kind, coalesce(beyond, false) OR (coalesce(strong, false) AND (n_lines >= 2 OR n_rules > 0)) AS corroborated,
    coalesce(n_lines, 0) AS n_lines,
    CASE WHEN coalesce(a.weight, 0) >= 1 THEN least(95, 62 + CAST(round_even(10 * a.weight, 0) AS INTEGER))
      WHEN a.weight > 0 THEN 30 + CAST(round_even(30 * a.weight, 0) AS INTEGER)
      WHEN e.n_kills < 10 THEN 15 ELSE 10 END AS p
  FROM entities e LEFT JOIN agg a USING (session_id, entity_id) LEFT JOIN npts p USING (session_id, entity_id)),
target AS (SELECT *, CASE WHEN p > 65 AND corroborated THEN 'cheating' WHEN p < 25 THEN 'clean' ELSE 'unclear' END AS verdict,
    CASE WHEN p > 65 AND NOT corroborated THEN least(p, 60) ELSE p END AS probability FROM tg)"""


@query(
    "session_id:l entity_id:l kills:l weight:d verdict:s probability:l cheat_type:s "
    "n_points:l n_reasons:l n_caveats:l",
    f"""{TARGET_SQL}
SELECT *, CASE WHEN verdict <> 'cheating' THEN 'none' WHEN kinds > 1 THEN 'mixed' ELSE kind END AS cheat_type,
  CASE verdict WHEN 'cheating' THEN least(3, n_counted) WHEN 'unclear' THEN 1 + (n_points > 0)::INT ELSE 1 END AS n_reasons,
  (kills < 10)::INT + (snipes >= 0.5)::INT AS n_caveats FROM target""",
)
def targets(spark, d):
    return Z.targets(_cases(spark, d)).withColumns(
        {
            "n_points": F.size("points"),
            "n_reasons": F.size("reasons"),
            "n_caveats": F.size("caveats"),
        }
    )


_HEARD = "(last_seen_ms IS NOT NULL OR victim_fired_ms_ago IS NOT NULL OR running)"
_COVERED = "checked AND coalesce(share, 0) >= 0"


@query(
    "session_id:l entity_id:l contexts:s awareness:s caveat:s",
    f"""WITH {A.WINDOWS_SQL}, {SP._SESSION_SQL}, {Q.GEO_SQL.replace("geo AS (", "geoflag AS (")},
geo AS (SELECT g.* REPLACE (CASE WHEN g.session_id % 2 = 1 THEN g.target_visible
      WHEN s.window_uid IS NOT NULL THEN c.window_uid IS NOT NULL END AS target_visible)
  FROM geoflag g LEFT JOIN (SELECT window_uid, tick_offset FROM seg WHERE kind = 'tick') s USING (window_uid, tick_offset)
  LEFT JOIN (SELECT window_uid, tick_offset FROM clear WHERE kind = 'tick') c USING (window_uid, tick_offset)),
{Q.PERCEPTION_SQL},
m AS (SELECT w.session_id, w.entity_id, w.window_uid, w.session_id % 2 = 0 AS checked, p.aim_through_wall_share AS share, r.last_seen_ms, fr.victim_fired_ms_ago,
    rn.window_uid IS NOT NULL AS running, allies_alive, enemies_alive, count(*) OVER (PARTITION BY w.session_id, w.entity_id) AS n_kills,
    row_number() OVER (PARTITION BY w.session_id, w.entity_id
      ORDER BY round(aim_through_wall_share, 9) DESC NULLS LAST, round(angle_at_first_visible, 9) ASC NULLS LAST, w.window_uid) AS place
  FROM win w JOIN perc p USING (window_uid) LEFT JOIN rays r USING (window_uid) LEFT JOIN fr USING (window_uid)
  LEFT JOIN rn USING (window_uid) LEFT JOIN ac USING (window_uid)),
t AS (SELECT *, concat_ws('; ', CASE WHEN checked AND last_seen_ms IS NULL THEN '{K.CONTEXT_NEVER_SEEN}'
      WHEN checked THEN 'last saw this enemy ' || format('{{:.1f}}', last_seen_ms / 1000) || 's before the kill' END,
    'the enemy had fired ' || format('{{:.1f}}', victim_fired_ms_ago / 1000) || 's before', CASE WHEN running THEN '{K.CONTEXT_RUNNING}' END,
    allies_alive || 'v' || coalesce(enemies_alive::VARCHAR, 'None') || ' at the time') AS said FROM m WHERE place <= 3 AND n_kills >= 5),
g AS (SELECT session_id, entity_id, string_agg('   context: ' || said, '|' ORDER BY place) FILTER (said <> '') AS contexts, count(*) AS kills,
    count(*) FILTER ({_COVERED} AND NOT {_HEARD}) AS blind, count(*) FILTER ({_COVERED}) AS covered FROM t GROUP BY 1, 2)
SELECT session_id, entity_id, coalesce(contexts, '') AS contexts,
  CASE WHEN blind >= 2 THEN 'in ' || blind || ' of the ' || kills || ' {K.AWARENESS_REASON.split("} ")[-1]}' END AS awareness,
  CASE WHEN covered > 0 AND blind = 0 THEN '{K.CAVEAT_EXPLAINED}' END AS caveat FROM g""",
)
def session_targets(spark, d):
    """What the cases of whole sessions say about what their entity could have known.

    Every moment asks (``wall_aim=0``), as few approaches in these tables are aimed through cover.
    """
    cases = _context_cases(spark, d)
    judged = Z.targets(cases.withColumn("text", Z.render_case()), wall_aim=0.0)
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("   context: "))
    about = F.filter(
        F.transform("points", lambda p: p["reason"]), lambda x: x.contains(" kills that stand out ")
    )
    explained = F.filter("caveats", lambda x: x == K.CAVEAT_EXPLAINED)
    return judged.select(
        "session_id",
        "entity_id",
        F.array_join(lines, "|").alias("contexts"),
        F.get(about, F.lit(0)).alias("awareness"),
        F.get(explained, F.lit(0)).alias("caveat"),
    )


@query(
    "session_id:l entity_id:l shown_verdict:s shown_probability:l held:b",
    f"""{TARGET_SQL},
j AS (SELECT t.*, e.score > 0.6 AS accuses FROM target t JOIN escore e USING (session_id, entity_id))
SELECT session_id, entity_id, CASE WHEN NOT accuses THEN 'clean' WHEN corroborated THEN 'cheating' ELSE 'unclear' END AS shown_verdict,
  CASE WHEN NOT accuses THEN 10 WHEN corroborated THEN 90 ELSE 60 END AS shown_probability, accuses AND NOT corroborated AS held FROM j""",
)
def guarded(spark, d):
    accuses = F.col("score") > 0.6
    judged = _cases(spark, d).withColumns(
        {
            "verdict": F.when(accuses, "cheating").otherwise("clean"),
            "probability": F.when(accuses, 90).otherwise(10),
            "cheat_type": F.when(accuses, "mixed").otherwise("none"),
        }
    )
    return Z.guard(judged).withColumn("held", F.col("held_note").isNotNull())


@query(
    "session_id:l entity_id:l header:s score_line:s measurements:l moments:l",
    f"""{Q.ENTITY_PREFIX}, {Q.SCORE_SQL},
m AS (SELECT session_id, entity_id, least(3, count(*)) AS moments FROM aim GROUP BY 1, 2)
SELECT e.session_id, e.entity_id, 'PLAYER ' || e.entity_id || ' — ' || e.n_kills || ' kills' AS header,
  'Behaviour model score: ' || format('{{:.2f}}', s.score) AS score_line, m.moments,
  9 + (arrival_shot_share IS NOT NULL)::INT + (zero_motion_share IS NOT NULL)::INT + (angle_at_first_visible_median IS NOT NULL)::INT - 1 AS measurements
FROM entities e JOIN escore s USING (session_id, entity_id) JOIN m USING (session_id, entity_id)""",
)
def case_text(spark, d):
    lines = F.split("text", "\n")
    return (
        _cases(spark, d)
        .withColumn("text", Z.render_case())
        .withColumns(
            {
                "header": lines[0],
                "score_line": lines[1],
                "measurements": F.size(F.filter(lines, lambda s: s.startswith("- ") & ~s.startswith("- ["))),
                "moments": F.size(F.filter(lines, lambda s: s.rlike(r"^\d+\. tick "))),
            }
        )
    )


@query(
    "session_id:l entity_id:l label:s kills:l features:l rule_hits:l document:s",
    None,
)
def case_documents(spark, d):
    cases = _cases(spark, d)
    whole = F.to_json(F.struct(*cases.columns))
    return cases.select(
        "session_id",
        "entity_id",
        "label",
        "kills",
        whole.alias("document"),
        F.size("rule_evidence").alias("rule_hits"),
        F.size("features").alias("features"),
    )


@query(
    "session_id:l document:s",
    f"""WITH {Q.EVIDENCE_SQL},
f AS (SELECT session_id, entity_id, name, value, row_number() OVER (PARTITION BY session_id, entity_id
  ORDER BY CASE severity WHEN 'impossible' THEN 0 ELSE 1 END, value DESC, name,
  CASE WHEN name = 'kill_tick_snap' THEN tick_start + 64 ELSE tick_start END) AS place FROM evidence),
fl AS (SELECT session_id, entity_id, string_agg(place || ' ' || name || ' ' || CAST(floor(value) AS BIGINT), ',' ORDER BY place) AS findings FROM f GROUP BY 1, 2),
k AS (SELECT session_id, entity_id, tick, weapon, row_number() OVER (PARTITION BY session_id, entity_id ORDER BY tick) AS place FROM samples WHERE anchor),
kl AS (SELECT session_id, entity_id, string_agg(place || ' ' || tick || ' ' || weapon, ',' ORDER BY place) AS kills FROM k WHERE place <= 3 GROUP BY 1, 2),
rd AS (SELECT session_id, round AS number, min(tick) AS s, max(tick) AS e FROM samples GROUP BY 1, 2),
rl AS (SELECT session_id, string_agg(number || ' ' || s || ' ' || e, ',' ORDER BY number) AS rounds FROM rd GROUP BY 1),
e AS (SELECT session_id, entity_id, count(*) FILTER (anchor) > 11 AS flagged, CASE WHEN entity_id % 3 > 0 THEN count(*) END AS score FROM samples GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY flagged DESC, score DESC NULLS LAST, CAST(entity_id AS VARCHAR)) AS place FROM e),
l AS (SELECT session_id, string_agg(place || ' ' || entity_id || ' [' || coalesce(kills, '') || '] [' || coalesce(findings, '') || ']', ';' ORDER BY place) AS people
  FROM p LEFT JOIN kl USING (session_id, entity_id) LEFT JOIN fl USING (session_id, entity_id) GROUP BY 1)
SELECT session_id, people || ' | ' || rounds AS document FROM l JOIN rl USING (session_id)""",
)
def report_documents(spark, d):
    """Nested reports with every finding, read out in the order of their lists."""
    s = A.stored_samples(spark, d)
    by_tick = W.partitionBy("session_id", "entity_id").orderBy("tick")
    kills = s.filter("anchor").select(
        "session_id", "entity_id", "tick", "weapon", F.row_number().over(by_tick).alias("place")
    )
    findings = R.ranked_findings(Q.evidence(s)).select("session_id", "entity_id", "name", "value", "place")
    rounds = s.groupBy("session_id", F.col("round").alias("number")).agg(
        F.min("tick").alias("start"), F.max("tick").alias("end")
    )
    entities = s.groupBy("session_id", "entity_id").agg(
        (F.count_if("anchor") > 11).alias("flagged"),
        F.when(F.col("entity_id") % 3 > 0, F.count(F.lit(1))).alias("score"),
    )
    found = Z.report_documents(entities, kills, findings, rounds)

    def text(rows, *columns):
        shown = lambda r, c: F.floor(r[c]) if c == "value" else r[c]
        line = lambda r: F.concat_ws(" ", *[shown(r, c).cast("string") for c in columns])
        empty = F.array().cast("array<string>")
        return F.array_join(F.coalesce(F.transform(rows, line), empty), ",")

    def person(e):
        return F.concat(
            F.concat_ws(" ", e["place"].cast("string"), e["entity_id"].cast("string")),
            F.lit(" ["),
            text(e["kills"], "place", "tick", "weapon"),
            F.lit("] ["),
            text(e["findings"], "place", "name", "value"),
            F.lit("]"),
        )

    people = F.array_join(F.transform("entities", person), ";")
    rounds_text = text(F.col("rounds"), "number", "start", "end")
    return found.select(
        "session_id", F.concat(people, F.lit(" | "), rounds_text).alias("document")
    )


@query(
    "name:s shown:l past95:l past99:l of_shown:d of_all:d",
    f"""{TARGET_SQL},
named AS (SELECT *, CASE feature WHEN 'straight_share' THEN 'flicks that never change direction' WHEN 'corrections_mean' THEN 'aim corrections per kill'
    WHEN 'wall_aim_share' THEN 'time aimed at an enemy they could not see' WHEN 'visible_share' THEN 'time the victim was actually visible'
    WHEN 'fast_kills' THEN 'kills within 50 ms of the enemy appearing' WHEN 'snap_kills' THEN 'non-sniper kills with a turn over 175 deg/s on the kill tick'
    WHEN 'never_visible_share' THEN 'kills where the victim was never visible first' END AS name FROM lev WHERE feature NOT IN ('sniper_share', 'snap_max'))
SELECT name, count(*) AS shown, count(*) FILTER (CASE WHEN lower THEN sv < sn ELSE sv > sn END) AS past95,
  count(*) FILTER (CASE WHEN lower THEN sv < ss ELSE sv > ss END) AS past99,
  count(*) FILTER (CASE WHEN lower THEN sv < sn ELSE sv > sn END) / count(*) AS of_shown,
  count(*) FILTER (CASE WHEN lower THEN sv < sn ELSE sv > sn END) / (SELECT count(*) FROM entities) AS of_all
FROM named GROUP BY 1""",
)
def external_population_check(spark, d):
    """Measurements parsed back out of every case text, counted against their lines."""
    texts = staged(
        _cases(spark, d).select(Z.render_case().alias("text"))
    )
    rows = texts.select(F.inline(measurement_rows(F.col("text"))))
    total = texts.agg(F.count(F.lit(1)).alias("_entities"))
    checked = attach_row(E.measurement_check(rows), total)
    return checked.withColumn("of_all", F.col("past95") / F.col("_entities"))


@query(
    "session_id:l entity_id:l target_source:s stale:b messages:l verdict:s generated:s",
    f"""{TARGET_SQL}
SELECT session_id, entity_id, CASE WHEN entity_id % 4 = 0 THEN 'human' ELSE 'generated' END AS target_source,
  entity_id % 4 = 2 AS stale, 3 AS messages, CASE WHEN entity_id % 4 = 0 THEN 'clean' ELSE verdict END AS verdict, verdict AS generated
FROM target""",
)
def training_messages(spark, d):
    done = staged(Z.targets(_cases(spark, d)))
    texts = done.select("session_id", "entity_id", Z.render_case().alias("text"))
    human = texts.filter(F.col("entity_id") % 2 == 0).select(
        "session_id",
        "entity_id",
        F.when(
            F.col("entity_id") % 4 == 0, F.substring(F.sha2("text", 256), 1, 16)
        )
        .otherwise("another text")
        .alias("evidence_sha"),
        F.lit("clean").alias("verdict"),
        F.lit(5).alias("probability"),
        F.lit("{}").alias("answer"),
    )
    return Z.training_rows(done, human, "You review players.").withColumn(
        "messages", F.size("messages")
    )


# --- replays ---------------------------------------------------------------------------


@query(
    "session_id:l number:l entity_id:l t0:l side:s ticks:l xs:s hps:s",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL},
v AS (SELECT s.session_id, iv.number, s.entity_id, s.tick, s.team, CASE WHEN is_alive THEN CAST(round(x) AS INTEGER) END AS x,
    CASE WHEN is_alive THEN health ELSE 0 END AS hp
  FROM samples s JOIN iv ON iv.session_id = s.session_id AND s.tick >= iv.start AND s.tick < iv."end" WHERE s.tick % 4 = 0),
p AS (SELECT session_id, number, entity_id, min(team) AS team FROM v GROUP BY 1, 2, 3),
g AS (SELECT session_id, number, (start + 3) // 4 * 4 AS t0, unnest(range((start + 3) // 4 * 4, "end", 4)) AS tick FROM iv)
SELECT p.session_id, p.number, p.entity_id, min(g.t0) AS t0, CASE min(p.team) WHEN 2 THEN 'T' ELSE 'CT' END AS side, count(*) AS ticks,
  string_agg(coalesce(v.x::VARCHAR, '-'), '|' ORDER BY g.tick) AS xs, string_agg(coalesce(v.hp::VARCHAR, '-'), '|' ORDER BY g.tick) AS hps
FROM p JOIN g USING (session_id, number) LEFT JOIN v ON v.session_id = p.session_id AND v.number = p.number AND v.entity_id = p.entity_id AND v.tick = g.tick
GROUP BY 1, 2, 3""",
)
def replay_grid(spark, d):
    s = A.stored_samples(spark, d)
    intervals = staged(_intervals(s))
    values = staged(Y.replay_values(s, intervals))

    def joined(c):
        return F.array_join(F.col(c).cast("array<string>"), "|", "-")

    return Y.replay_grid(values, intervals).withColumns(
        {"ticks": F.size("x"), "xs": joined("x"), "hps": joined("hp")}
    )


@query(
    "session_id:l number:l tick:l target_id:l killer_id:l weapon:s x:l y:l",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL},
k AS (SELECT s.session_id, iv.number, s.tick, s.target_id, s.entity_id AS killer_id, s.weapon FROM samples s
  JOIN iv ON iv.session_id = s.session_id AND s.tick >= iv.start AND s.tick < iv."end" WHERE s.anchor)
SELECT k.*, CAST(round(p.x) AS BIGINT) AS x, CAST(round(p.y) AS BIGINT) AS y
FROM k ASOF LEFT JOIN samples p ON p.session_id = k.session_id AND p.entity_id = k.target_id AND k.tick >= p.tick""",
)
def replay_deaths(spark, d):
    s = A.stored_samples(spark, d)
    return Y.replay_deaths(A.anchors(s), s, staged(_intervals(s)))


def _played(s, intervals):
    """What a replay reads of the samples it shows, with their rounds."""
    kept = ["session_id", "entity_id", "tick", "team", "x", "y", "z", "yaw", "health"]
    kept += ["is_alive", "shot", "anchor", "target_id", "weapon"]
    return Y.played(s.select(*kept), intervals)


@query(
    "session_id:l number:l players:l events:l t0:l",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL},
i AS (SELECT s.*, iv.number, iv.start FROM samples s JOIN iv ON iv.session_id = s.session_id AND s.tick >= iv.start AND s.tick < iv."end"),
p AS (SELECT session_id, number, count(DISTINCT entity_id) AS players, min((start + 3) // 4 * 4) AS t0 FROM i WHERE tick % 4 = 0 GROUP BY 1, 2),
e AS (SELECT session_id, number, count(*) AS events FROM (SELECT * FROM i WHERE anchor UNION ALL SELECT * FROM i WHERE shot AND weapon <> 'knife') GROUP BY 1, 2)
SELECT p.session_id, p.number, players, coalesce(events, 0) AS events, t0 FROM p LEFT JOIN e USING (session_id, number)""",
)
def replay_documents(spark, d):
    s = A.stored_samples(spark, d)
    intervals = staged(_intervals(s))
    shown = staged(_played(s, intervals))
    grid = Y.replay_grid(Y.replay_values(shown, intervals), intervals)
    shots = Y.replay_shots(shown.filter("shot"), intervals).select(
        "session_id",
        "number",
        F.lit("shot").alias("kind"),
        "tick",
        "entity_id",
        F.lit(None).cast("int").alias("x"),
        F.lit(None).cast("int").alias("y"),
    )
    deaths = Y.replay_deaths(shown.filter("anchor"), s, intervals).select(
        "session_id",
        "number",
        F.lit("death").alias("kind"),
        "tick",
        F.col("target_id").alias("entity_id"),
        "x",
        "y",
    )
    docs = Y.replay_documents(grid, intervals, shots.unionByName(deaths))
    return docs.select(
        "session_id",
        "number",
        "t0",
        F.size("players").alias("players"),
        F.coalesce(F.size("events"), F.lit(0)).alias("events"),
    )


@query(
    "session_id:l number:l t0:l players:s events:s spans:s objectives:s",
    f"""WITH {A.SAMPLES_SQL}, {_INTERVALS_SQL},
i AS (SELECT s.*, iv.number, iv."end" FROM samples s JOIN iv ON iv.session_id = s.session_id AND s.tick >= iv.start AND s.tick < iv."end"),
p0 AS (SELECT session_id, number, entity_id, CASE min(team) WHEN 2 THEN 'T' ELSE 'CT' END AS side,
    min(tick // 4 * 4) AS t0 FROM i WHERE tick % 4 = 0 GROUP BY 1, 2, 3),
p AS (SELECT p0.session_id, p0.number, min((iv.start + 3) // 4 * 4) AS t0, string_agg(entity_id || ' ' || side, '|' ORDER BY entity_id) AS players
  FROM p0 JOIN iv USING (session_id, number) GROUP BY 1, 2),
d AS (SELECT k.session_id, k.number, 'death' AS kind, k.tick, k.target_id AS entity_id, CAST(round(a.x) AS BIGINT) AS x, CAST(round(a.y) AS BIGINT) AS y
  FROM (SELECT * FROM i WHERE anchor) k ASOF LEFT JOIN samples a ON a.session_id = k.session_id AND a.entity_id = k.target_id AND k.tick >= a.tick),
ev AS (SELECT * FROM d UNION ALL SELECT session_id, number, 'shot', tick, entity_id, NULL, NULL FROM i WHERE shot AND weapon <> 'knife'),
e AS (SELECT session_id, number, string_agg(tick || ' ' || kind || ' ' || entity_id || ' ' || coalesce(x::VARCHAR, '-') || ' ' || coalesce(y::VARCHAR, '-'), '|'
    ORDER BY tick, kind, entity_id, x NULLS FIRST, y NULLS FIRST) AS events FROM ev GROUP BY 1, 2),
ends AS (SELECT session_id, entity_id % 3 AS id, tick AS over FROM samples WHERE anchor),
paired AS (SELECT b.*, (SELECT min(over) FROM ends n WHERE n.session_id = b.session_id AND n.id = b.entity_id % 3 AND n.over >= b.tick) AS over
  FROM i b WHERE shot),
sp AS (SELECT session_id, number, tick, least(coalesce(over, least("end", tick + 8)), "end") AS until,
    CASE WHEN entity_id % 2 = 0 THEN 'smoke' ELSE 'fire' END AS kind, CAST(round(x) AS BIGINT) AS x, CAST(round(y) AS BIGINT) AS y FROM paired),
sl AS (SELECT session_id, number, string_agg(tick || '-' || until || ' ' || kind || ' ' || x || ' ' || y, '|' ORDER BY tick, until, kind, x, y) AS spans FROM sp GROUP BY 1, 2),
ob AS (SELECT s.session_id, s.tick, s.entity_id, CAST(round(any_value(s.x)) AS BIGINT) AS x, CAST(round(any_value(s.y)) AS BIGINT) AS y, arg_min(iv.number, iv."end") AS number
  FROM samples s JOIN iv ON iv.session_id = s.session_id AND iv."end" > s.tick WHERE s.is_freeze GROUP BY 1, 2, 3),
ol AS (SELECT session_id, number, string_agg(tick || ' plant ' || entity_id || ' ' || x || ' ' || y, '|' ORDER BY tick, entity_id, x, y) AS objectives FROM ob GROUP BY 1, 2)
SELECT p.session_id, p.number, t0, players, coalesce(events, '') AS events, coalesce(spans, '') AS spans, coalesce(objectives, '') AS objectives
FROM p LEFT JOIN e USING (session_id, number) LEFT JOIN sl USING (session_id, number) LEFT JOIN ol USING (session_id, number)""",
)
def replay_scenes(spark, d):
    """Whole round documents, every list read out in its order: smokes, fires and objectives too."""
    s = A.stored_samples(spark, d)
    intervals = staged(_intervals(s))
    shown = staged(_played(s, intervals))
    grid = Y.replay_grid(Y.replay_values(shown, intervals), intervals)
    place = [F.round(c).cast("int").alias(c) for c in "xy"]
    nowhere = [F.lit(None).cast("int").alias(c) for c in "xy"]
    shots = Y.replay_shots(shown.filter("shot"), intervals).select(
        "session_id", "number", F.lit("shot").alias("kind"), "tick", "entity_id", *nowhere
    )
    planted = s.filter("is_freeze").select(
        "session_id", "tick", "entity_id", F.lit("plant").alias("kind")
    )
    deaths, objectives = Y.replay_places(shown.filter("anchor"), planted, s, intervals)
    thrown = F.when(F.col("entity_id") % 2 == 0, "smoke").otherwise("fire")
    keys = ["session_id", "tick", (F.col("entity_id") % 3).alias("entityid")]
    begun = shown.filter("shot").select(*keys, "number", "start", "end", thrown.alias("kind"), *place)
    spans = Y.replay_spans(begun, shown.filter("anchor").select(*keys), intervals, cap=8)
    docs = Y.replay_documents(grid, intervals, shots.unionByName(deaths), spans, objectives)

    def text(name, line):
        listed = F.transform(name, line)
        return F.array_join(F.coalesce(listed, F.array().cast("array<string>")), "|").alias(name)

    def spot(r, *columns):
        return F.concat_ws(" ", *[F.coalesce(r[c].cast("string"), F.lit("-")) for c in columns])

    return docs.select(
        "session_id",
        "number",
        "t0",
        text("players", lambda p: spot(p, "entity_id", "side")),
        text("events", lambda e: spot(e, "tick", "kind", "entity_id", "x", "y")),
        text("spans", lambda x: F.concat(spot(x, "tick"), F.lit("-"), spot(x, "until", "kind", "x", "y"))),
        text("objectives", lambda e: spot(e, "tick", "kind", "entity_id", "x", "y")),
    )


# --- entity reports --------------------------------------------------------------------


@query(
    "session_id:l entity_id:l flagged:b reasons:s findings:l",
    f"""WITH {A.WINDOWS_SQL}, {Q.AIM_SQL}, {Q.SCORE_SQL}{_EVIDENCE_STRICT},
w AS (SELECT session_id, entity_id, min(CASE severity WHEN 'impossible' THEN 0 ELSE 1 END) AS worst, count(*) AS findings FROM evidence GROUP BY 1, 2),
l AS (SELECT quantile_cont(score, 0.9) AS line FROM escore WHERE label = 'clean'),
f AS (SELECT e.*, coalesce(worst <= 1, false) AS by_rule, score >= line AND n_windows >= 5 AS by_score, coalesce(findings, 0) AS findings
  FROM escore e LEFT JOIN w USING (session_id, entity_id), l)
SELECT session_id, entity_id, by_rule OR by_score AS flagged, findings,
  concat_ws('; ', CASE WHEN by_rule THEN 'hard-limit finding' END, CASE WHEN by_score THEN 'score above the clean line' END) AS reasons FROM f""",
)
def entity_report(spark, d):
    s = A.stored_samples(spark, d)
    _, ticks = A.windows(s)
    aim = X.window_features(A.with_label(ticks.drop("shot")), A.SEGMENTS)
    scores = staged(P.entity_scores(_scored(aim)))
    grid = P.score_reference(scores, levels=(0.9,))
    return Z.flags(scores, Q.evidence(s, STRICT), grid).withColumn(
        "reasons", F.array_join("flag_reasons", "; ")
    )


@query(
    "session_id:l entity_id:l window_uid:s place:l score:d command:s",
    f"""WITH {A.WINDOWS_SQL}, {Q.AIM_SQL}, {Q.GEO_SQL}, {Q.PERCEPTION_SQL}, {Q.SCORE_SQL},
r AS (SELECT session_id, entity_id, window_uid, row_number() OVER (PARTITION BY session_id, entity_id
    ORDER BY round(aim_through_wall_share, 9) DESC NULLS LAST, round(angle_at_first_visible, 9) ASC NULLS LAST, window_uid) AS place
  FROM aim JOIN perc USING (window_uid))
SELECT r.*, s.score, 'demo_gototick ' || greatest(w.tick - 128, 0) AS command
FROM r JOIN wscore s USING (window_uid) JOIN win w USING (window_uid)""",
)
def kill_reports(spark, d):
    ticks = staged(Q.shot_ticks(A.stored_samples(spark, d)))
    features = staged(
        X.window_features(ticks, A.SEGMENTS, burst_gap=A.BURST_GAP, radius=A.RADIUS).withColumns(
            {
                c: F.round(c, 9)
                for c in ("aim_through_wall_share", "angle_at_first_visible")
            }
        )
    )
    at = ticks.filter(F.col("tick_offset") == 0).select(
        "window_uid", F.col("anchor_tick").alias("tick")
    )
    return Z.kill_reports(features.join(at, "window_uid"), _scored(features))


@query(
    "user_id:l event_id:l event_type:s value:d",
    """SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id,
  arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type,
  arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1""",
)
def latest_annotation(spark, d):
    log = A.table(spark, d, "events").select(
        "user_id", "ts", "event_id", "event_type", "value"
    )
    return sinks.latest_rows(log, ["user_id"], ["ts", "event_id"])


@query(
    "session_id:s players:l flagged:l",
    f"""WITH {A.WINDOWS_SQL}, {Q.AIM_SQL}, {Q.SCORE_SQL}
SELECT session_id, count(*) AS players, count(*) FILTER (score > 0.6) AS flagged FROM escore GROUP BY 1""",
)
def report_catalogue(spark, d):
    """Reports written as JSON documents and listed again."""
    scores = P.entity_scores(Q.window_scores(spark, d))
    player = F.struct(
        F.col("entity_id").cast("string").alias("player_id"),
        (F.col("score") > 0.6).alias("flagged"),
        "score",
        F.lit("").alias("judge_evidence"),
    )
    reports = scores.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(
        F.lit("m").alias("map_name"), F.collect_list(player).alias("players")
    )
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{id(reports)}"
    sinks.write_json(reports, folder)
    return sinks.report_catalogue(spark, folder)


@query("name:s folder:s bytes:l sha256:s", None)
def source_manifest(spark, d):
    files = MF.file_manifest(spark, d, "*.parquet", content=True)
    return MF.unique_contents(files)


# --- sweeps ------------------------------------------------------------------------------

_SWEEP_SQL = f"""WITH {A.WINDOWS_SQL}, {Q.GEO_SQL}, {Q.ARRIVAL_SQL},
arows AS (SELECT k.window_uid, k.session_id, k.entity_id, k.label, a.tick_offset AS arrived, a.opening, a.sweep AS dps
  FROM (SELECT * FROM ar2 WHERE tick_offset = 0) k
  LEFT JOIN (SELECT * FROM ar2 WHERE enters AND tick_offset <= opening) a USING (window_uid)),
opt AS (SELECT unnest([-1.0, 50.0, 3000.0]) AS dps),
pw AS (SELECT window_uid, session_id, entity_id, label, o.dps, max(opening) AS opening, max(arrived) FILTER (o.dps < 0 OR r.dps >= o.dps) AS arrived
  FROM arows r CROSS JOIN opt o GROUP BY ALL),
pe AS (SELECT session_id, entity_id, label, dps, count(*) AS n_kills, count(arrived) AS ak, count(*) FILTER (arrived = opening) AS ash
  FROM pw GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT *, CASE WHEN ak >= min_arrival AND ak > 0 THEN ash / ak END AS share FROM pe CROSS JOIN (SELECT unnest([1, 2]) AS min_arrival)),
l AS (SELECT dps, min_arrival, quantile_cont(share, 0.95) AS line95, quantile_cont(share, 0.99) AS line99
  FROM t WHERE label = 'clean' AND share IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT t.dps, t.min_arrival, line95, line99, count(*) FILTER (label = 'clean' AND share IS NOT NULL) / count(*) FILTER (label = 'clean') AS coverage,
    avg((share > line95)::INT) FILTER (label = 'clean') AS clean_past, avg((share > line95)::INT) FILTER (label = 'cheater') AS cheat_past,
    sum(ash) FILTER (label = 'clean' AND share IS NOT NULL) / sum(ak) FILTER (label = 'clean' AND share IS NOT NULL) AS clean_pooled
  FROM t JOIN l ON l.dps = t.dps AND l.min_arrival = t.min_arrival GROUP BY ALL)
SELECT *, cheat_past / nullif(clean_past, 0) AS lift,
  coalesce((SELECT min(s) FROM (SELECT unnest(range(61)) AS n) n, (SELECT unnest(range(61)) AS s) s WHERE n >= r.min_arrival AND s <= n AND n > 0 AND s / n > r.line95), 60) AS crossing_count
FROM r"""


@query(
    "dps:d min_arrival:l line95:d line99:d coverage:d clean_past:d cheat_past:d "
    "clean_pooled:d lift:d crossing_count:l",
    _SWEEP_SQL,
)
def sweep_lines(spark, d):
    table = X.arrival_table(Q.shot_ticks(A.stored_samples(spark, d)), A.BURST_GAP, A.RADIUS)
    return E.arrival_sweep(staged(table), (None, 50.0, 3000.0), (1, 2), min_clean=3)


_SNAP_SQL = f"""WITH {A.WINDOWS_SQL}, {Q.AIM_SQL},
o AS (SELECT * FROM (SELECT unnest([175.0, 4000.0]) AS dps) CROSS JOIN (SELECT unnest(['all', 'nonsniper']) AS scope)),
c AS (SELECT session_id, entity_id, label, dps, scope, count(*) AS n_kills, avg((weapon = 'awp')::INT) AS sniper_share,
    count(*) FILTER (speed_at_kill > dps AND (scope = 'all' OR weapon <> 'awp')) AS snap FROM aim CROSS JOIN o GROUP BY ALL HAVING count(*) >= 5),
b AS (SELECT *, CASE WHEN sniper_share < 0.2 THEN 'rifler' WHEN sniper_share < 0.5 THEN 'mixed' ELSE 'awp_main' END AS band FROM c)"""


@query(
    "dps:d scope:s band:s n:l line95:d line99:d",
    f"""{_SNAP_SQL}
SELECT dps, scope, band, count(*) AS n, quantile_cont(snap, 0.95) AS line95, quantile_cont(snap, 0.99) AS line99
FROM b WHERE label = 'clean' GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
)
def per_band_lines(spark, d):
    return E.band_lines(_snap_counts(spark, d), min_clean=10)


def _snap_counts(spark, d):
    _, ticks = A.windows(A.stored_samples(spark, d))
    kills = X.window_features(A.with_label(ticks.drop("shot")), A.SEGMENTS)
    return staged(E.snap_counts(kills, (175.0, 4000.0)))


@query(
    "dps:d scope:s line95:d entities:l clean_past:d cheat_past:d lift:d crossing:l",
    f"""{_SNAP_SQL},
l AS (SELECT dps, scope, greatest(quantile_cont(snap, 0.95), 2) AS line95 FROM b WHERE label = 'clean' GROUP BY 1, 2)
SELECT b.dps, b.scope, line95, count(*) AS entities, avg((snap > line95)::INT) FILTER (label = 'clean') AS clean_past,
  avg((snap > line95)::INT) FILTER (label = 'cheater') AS cheat_past,
  avg((snap > line95)::INT) FILTER (label = 'cheater') / nullif(avg((snap > line95)::INT) FILTER (label = 'clean'), 0) AS lift,
  CAST(floor(line95) AS INTEGER) + 1 AS crossing
FROM b JOIN l ON l.dps = b.dps AND l.scope = b.scope GROUP BY ALL""",
)
def snap_past_rates(spark, d):
    counts = _snap_counts(spark, d)
    lines = E.band_lines(counts, line_mode="pooled", floors=(2.0, 3.0), min_clean=10)
    return E.past_rates(counts, lines, pooled=True)


@query(
    "line:d low:l crossing:l",
    """WITH l AS (SELECT DISTINCT round(l_discount + l_tax, 2) AS line FROM lineitem)
SELECT line, 5 AS low, coalesce((SELECT min(s) FROM (SELECT unnest(range(5, 61)) AS n) n, (SELECT unnest(range(61)) AS s) s
  WHERE s <= n AND s / n > l.line), 60) AS crossing FROM l""",
)
def crossing_count(spark, d):
    lines = (
        A.table(spark, d, "lineitem")
        .select(F.round(F.col("l_discount") + F.col("l_tax"), 2).alias("line"))
        .distinct()
    )
    return lines.select(
        "line",
        F.lit(5).alias("low"),
        E.crossing_count(F.col("line"), F.lit(5)).alias("crossing"),
    )


# --- tensors ------------------------------------------------------------------------------

# channels are stored as float32
_CHANNEL_SQL = """CAST(CAST(sign(coalesce(d_yaw, 0)) * ln(1 + abs(coalesce(d_yaw, 0)))
  * (yaw_speed IS NOT NULL)::INT AS REAL) AS DOUBLE)"""


@query(
    "window_uid:s size:l valid:l yaw_sum:d4 off_sum:d3",
    f"""WITH {A.WINDOWS_SQL}, {Q.GEO_SQL}
SELECT window_uid, count(*) AS size, count(yaw_speed) AS valid, sum({_CHANNEL_SQL}) AS yaw_sum,
  sum(CAST(CAST(sign(coalesce(target_yaw_error, 180)) * ln(1 + abs(coalesce(target_yaw_error, 180))) AS REAL) AS DOUBLE)) AS off_sum FROM geo GROUP BY 1""",
)
def tensor_channels(spark, d):
    ticks = Q.geometry_ticks(A.stored_samples(spark, d))
    tensors = N.sequence_channels(ticks, size=A.PRE + A.POST + 1)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))

    return tensors.select(
        "window_uid",
        F.size("ch_d_yaw").alias("size"),
        total("ch_valid").alias("valid"),
        total("ch_d_yaw").alias("yaw_sum"),
        total("ch_target_yaw").alias("off_sum"),
    )


def _mean_turn():
    return lambda x: x[:, 0, :].astype("float64").mean(axis=1)


@query(
    "window_uid:s score:d4",
    f"""WITH {A.WINDOWS_SQL}
SELECT window_uid, 1 / (1 + exp(-avg({_CHANNEL_SQL}))) AS score FROM wt GROUP BY 1""",
)
def batch_scores(spark, d):
    _, ticks = A.windows(A.stored_samples(spark, d))
    tensors = N.sequence_channels(ticks, size=A.PRE + A.POST + 1)
    return N.score_windows(tensors, _mean_turn)


# a Gaussian classifier on pooled channels, fitted by its closed form
_POOLED_SQL = f"""WITH {A.WINDOWS_SQL},
ch AS (SELECT window_uid, session_id, label, {_CHANNEL_SQL} AS yc, (yaw_speed IS NOT NULL)::INT AS vc,
    {_CHANNEL_SQL.replace("d_yaw", "d_pitch")} AS pc FROM wt),
pool AS (SELECT window_uid, min(session_id) AS session_id, CASE min(label) WHEN 'cheater' THEN 1 WHEN 'clean' THEN 0 END AS y,
    avg(yc) AS f1, avg(pc) AS f2, avg(vc) AS f3, max(abs(yc)) AS f4, max(abs(pc)) AS f5, CAST(max(vc) AS DOUBLE) AS f6 FROM ch GROUP BY 1)"""


def _gauss_sql(by: str, learned: str) -> str:
    """Scores of ``pool`` rows; ``fit`` has the learned rows of each ``by``."""
    return f"""lng AS (UNPIVOT {learned} ON f1, f2, f3, f4, f5, f6 INTO NAME f VALUE v),
spread AS (SELECT {by}, 1e-9 * max(s) AS e FROM (SELECT {by}, f, var_pop(v) AS s FROM lng GROUP BY ALL) GROUP BY ALL),
st AS (SELECT {by}, y, f, avg(v) AS m, var_pop(v) + min(e) AS s FROM lng JOIN spread USING ({by}) GROUP BY ALL),
pr AS (SELECT {by}, y, ln(count(*)) AS p FROM {learned} GROUP BY ALL),
al AS (UNPIVOT (SELECT * EXCLUDE (y), y AS truth FROM pool) ON f1, f2, f3, f4, f5, f6 INTO NAME f VALUE v),
jl AS (SELECT window_uid, {by}, truth, y, min(p) + sum(-0.5 * ln(s) - power(v - m, 2) / (2 * s)) AS j
  FROM al JOIN st USING ({by}, f) JOIN pr USING ({by}, y) GROUP BY ALL),
jj AS (SELECT window_uid, {by}, truth, max(j) FILTER (y = 1) - max(j) FILTER (y = 0) AS odds FROM jl GROUP BY ALL)"""


def _pooled(spark, d):
    _, ticks = A.windows(A.stored_samples(spark, d))
    label = A.label_of(F.col("entity_id"), F.col("session_id"))
    return staged(
        N.pooled_channels(N.sequence_channels(ticks, size=A.PRE + A.POST + 1)).withColumn(
            "y", F.when(label == "cheater", 1).when(label == "clean", 0)
        )
    )


def _gauss():
    from pyspark.ml.classification import NaiveBayes

    return NaiveBayes(modelType="gaussian", featuresCol="_x", labelCol="y")


@query(
    "window_uid:s score:d4",
    f"""{_POOLED_SQL},
fit AS (SELECT * FROM pool WHERE y IS NOT NULL),
{_gauss_sql("one", "(SELECT *, 1 AS one FROM fit)").replace("y AS truth FROM pool", "y AS truth, 1 AS one FROM pool")}
SELECT window_uid, 1 / (1 + exp(-odds)) AS score FROM jj""",
)
def fitted_scores(spark, d):
    """A scorer learned from labelled windows, stored, loaded again and applied to all of them."""
    pooled = _pooled(spark, d)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorer-{uuid.uuid4().hex}"
    N.fit_window_scorer(pooled, F.col("y"), path, estimator=_gauss())
    return N.score_pooled(pooled.drop("y"), path)


@query("doc_id:l fold:l y:d score:d", None)
def oof_scores(spark, d):
    from pyspark.ml.classification import LogisticRegression

    from sightline.plans.documents import scored

    rows = scored(spark, d).withColumn("words", F.sqrt("n_chars"))
    return N.out_of_fold_scores(
        rows,
        ["n_chars", "words"],
        F.col("y"),
        group="doc_id",
        key="doc_id",
        folds=3,
        make_model=lambda: LogisticRegression(
            maxIter=10, featuresCol="_x", labelCol="y"
        ),
    )


@query(
    "window_uid:s fold:l y:d score:d4",
    f"""{_POOLED_SQL.replace("pool AS", "every AS")},
told AS (SELECT * FROM every WHERE y IS NOT NULL),
dealt AS (SELECT session_id, (row_number() OVER (ORDER BY count(*) DESC, session_id) - 1) % 6 AS turn FROM told GROUP BY 1),
pool AS (SELECT told.*, CASE WHEN turn < 3 THEN turn ELSE 5 - turn END AS fold FROM told JOIN dealt USING (session_id)),
fit AS (SELECT p.* EXCLUDE (fold), g.fold FROM pool p JOIN (SELECT unnest(range(3)) AS fold) g ON p.fold <> g.fold),
{_gauss_sql("fold", "fit")}
SELECT window_uid, fold, truth AS y, 1 / (1 + exp(-odds)) AS score FROM jj""",
)
def fold_scores(spark, d):
    """Windows scored by models that saw nothing of their session; folds alike in rows."""
    pooled = _pooled(spark, d).filter(F.col("y").isNotNull())
    names = [c for c in pooled.columns if c.startswith(("mean_", "peak_"))]
    return N.out_of_fold_scores(
        pooled,
        names,
        F.col("y"),
        group="session_id",
        key="window_uid",
        folds=3,
        make_model=_gauss,
        fold_of=U.balanced_folds,
    )


@query(
    "session_id:l entity_id:l n_rows:l picked:l total:d",
    f"""WITH {A.SAMPLES_SQL},
k AS (SELECT session_id, entity_id, tick, row_number() OVER (PARTITION BY session_id, entity_id ORDER BY tick) - 1 AS p,
    count(*) OVER (PARTITION BY session_id, entity_id) AS n FROM samples WHERE anchor),
i AS (SELECT DISTINCT session_id, entity_id, n, CASE WHEN n <= 6 THEN k.p ELSE i * (n - 1) // 5 END AS p FROM k, (SELECT unnest(range(6)) AS i))
SELECT session_id, entity_id, k.n AS n_rows, count(*) AS picked, sum(tick) AS total FROM k JOIN i USING (session_id, entity_id, p)
WHERE k.n >= 5 GROUP BY 1, 2, 3""",
)
def entity_bags(spark, d):
    rows = A.samples(spark, d).filter("anchor").select("session_id", "entity_id", "tick")
    bags = U.bags(
        rows,
        ["session_id", "entity_id"],
        "tick",
        ["tick"],
        chunk=tick_chunk("tick"),
        size=6,
    )

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    return bags.withColumns({"picked": total("mask"), "total": total("tick")})


@query(
    "line95:d line99:d entities:l shown:l past95:l past99:l of_shown:d of_all:d passes:b",
    f"""{Q.ENTITY_PREFIX},
l AS (SELECT quantile_cont(wall_aim_share, 0.95) AS line95, quantile_cont(wall_aim_share, 0.99) AS line99 FROM entities WHERE label = 'clean'),
r AS (SELECT line95, line99, count(*) AS entities, count(wall_aim_share) AS shown, count(*) FILTER (wall_aim_share > line95) AS past95,
    count(*) FILTER (wall_aim_share > line99) AS past99 FROM entities, l WHERE label = 'unknown' GROUP BY ALL)
SELECT *, past95 / nullif(shown, 0) AS of_shown, past95 / entities AS of_all, past95 / entities <= 0.01 AS passes FROM r""",
)
def criterion_check(spark, d):
    """A line on one measurement needs that one of every entity, and no other."""
    entities = staged(Q.measured(A.stored_samples(spark, d), "label", "wall_aim_share"))
    unknown = entities.filter(F.col("label") == "unknown")
    return E.criterion_check(entities, unknown, "wall_aim_share")


@query(
    "session_id:l entity_id:l place:l name:s value:d",
    f"""WITH {Q.EVIDENCE_SQL}
SELECT session_id, entity_id, name, value, row_number() OVER (PARTITION BY session_id, entity_id
  ORDER BY CASE severity WHEN 'impossible' THEN 0 ELSE 1 END, value DESC, name,
  CASE WHEN name = 'kill_tick_snap' THEN tick_start + 64 ELSE tick_start END) AS place FROM evidence""",
)
def ranked_findings(spark, d):
    return R.ranked_findings(Q.evidence(A.stored_samples(spark, d)))


@query(
    "window_uid:s points:l first_ms:l ax:d vx:d",
    f"""WITH {A.WINDOWS_SQL}, {Q.GEO_SQL}
SELECT window_uid, count(*) AS points, min(CAST(trunc(t_ms) AS BIGINT)) AS first_ms, sum(x) AS ax, sum(tx) AS vx
FROM geo WHERE tick_offset % 2 = 0 GROUP BY 1""",
)
def position_tracks(spark, d):
    s = A.stored_samples(spark, d)
    _, ticks = A.windows(s)
    where = {c: f"target_{c}" for c in "xyz"}
    both = state_of(ticks, s, "target_id", where).withColumn(
        "target_visible", F.lit(None).cast("boolean")
    )
    tracks = Z.position_tracks(both, stride=2)

    def total(c):
        return F.aggregate(
            F.filter(F.transform("path", lambda p: p[c]), lambda x: x.isNotNull()),
            F.lit(0.0),
            lambda a, x: a + x,
        )

    any_target = F.exists("path", lambda p: p["target_x"].isNotNull())
    return tracks.withColumns(
        {
            "points": F.size("path"),
            "first_ms": F.array_min(F.transform("path", lambda p: p["ms"])),
            "ax": total("x"),
            "vx": F.when(any_target, total("target_x")),
        }
    )


@query(
    "session_id:l entity_id:l status:s",
    f"""WITH {A.SAMPLES_SQL},
a AS (SELECT session_id, entity_id, count(*) AS n FROM samples GROUP BY 1, 2),
b AS (SELECT session_id, entity_id, count(*) AS n FROM samples WHERE is_alive GROUP BY 1, 2)
SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.entity_id, b.entity_id) AS entity_id,
  CASE WHEN a.n IS NULL THEN 'only_fresh' WHEN b.n IS NULL THEN 'only_stored' WHEN a.n = b.n THEN 'equal' ELSE 'differs' END AS status
FROM a FULL JOIN b ON a.session_id = b.session_id AND a.entity_id = b.entity_id""",
)
def stored_versus_fresh(spark, d):
    s = A.stored_samples(spark, d)
    by = ["session_id", "entity_id"]
    stored = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    fresh = s.filter("is_alive").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return compare_tables(stored, fresh, by, ["n"])
