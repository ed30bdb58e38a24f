"""Evaluation: ranking metrics, separation, profiles, sweeps, agreement, subgroups.

Every ranking metric starts from a score histogram (distinct scores with positive
and negative counts), so its ordered part is over distinct values cut into value
chunks, never over all rows in one task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import constants as K
from sightline.functions.labels import is_sniper, sniper_band
from sightline.operators.ordered import attach_row, number_by_range
from sightline.operators.quantiles import cumulative_counts, quantiles, unpivot
from sightline.operators.sampling import floor_share
from sightline.session import staged


def score_histogram(
    rows: DataFrame,
    score: Column,
    positive: Column,
    keys: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Distinct scores per key with ``pos`` and ``neg`` counts (or weights)."""
    w = F.lit(1) if weight is None else weight
    return (
        rows.withColumns({"_s": score.cast("double"), "_y": positive})
        .filter(F.col("_s").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_s"))
        .groupBy(*keys, F.col("_s").alias("score"))
        .agg(
            F.sum(F.when(F.col("_y"), w).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("_y"), 0).otherwise(w)).alias("neg"),
        )
    )


def roc_auc(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive scores above a negative; a tie counts half."""
    below = cumulative_counts(hist, keys, "score", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    total = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return below.groupBy(*keys).agg(
        F.max("pos_total").alias("positives"),
        F.max("neg_total").alias("negatives"),
        F.try_divide(wins, total).alias("auc"),
    )


def _from_top(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and false positives when everything at or above a score is taken."""
    below = cumulative_counts(hist, keys, "score", ["pos", "neg"])
    return below.withColumns(
        {
            "tp": F.col("pos_total") - F.col("pos_below"),
            "fp": F.col("neg_total") - F.col("neg_below"),
        }
    )


def pr_auc(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by its recall step."""
    cut = _from_top(hist, keys)
    step = F.try_divide(
        F.col("pos") * F.col("tp").cast("double"), F.col("tp") + F.col("fp")
    )
    return cut.groupBy(*keys).agg(
        F.try_divide(F.sum(step), F.max("pos_total").cast("double")).alias("pr_auc")
    )


def tpr_at_fpr(
    hist: DataFrame, limits: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Highest recall with the false-positive rate at or under each limit."""
    cut = _from_top(hist, keys)
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("neg_total").cast("double"))
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("pos_total").cast("double"))
    return cut.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(fpr <= x, tpr)), F.lit(0.0)).alias(
                f"tpr_at_{int(round(x * 100))}pct"
            )
            for x in limits
        ]
    )


def brier(rows: DataFrame, probability: Column, positive: Column) -> DataFrame:
    miss = probability - positive.cast("int")
    return rows.agg(F.avg(miss * miss).alias("brier"))


def bootstrap_auc(
    rows: DataFrame,
    score: Column,
    positive: Column,
    *,
    replicates: int = 200,
    seed: int = 0,
) -> DataFrame:
    """90% interval of the AUC by a Poisson bootstrap of the score histogram.

    n rows of one score and label are drawn Poisson(n) times in a replicate: rows are counted
    first, and only distinct scores meet replicates. n is cut into powers of two, for each of
    which a number from a digest of (place of the score, label, power, replicate) is looked up in
    the distribution function; what lies above the largest table is drawn from the normal
    limit. A retried task draws the same.
    """
    hist = score_histogram(rows, score, positive)
    placed = number_by_range(hist, [], ["score"], "place")
    counted = placed.select(
        "place",
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("label"), F.col("pos").alias("n")),
                F.struct(F.lit(0).alias("label"), F.col("neg").alias("n")),
            )
        ),
    ).filter("n > 0")
    powers = len(poisson_tables())
    # the number of rows of each power, and at last what is above all
    parts = [F.col("n").bitwiseAND(F.lit(1 << p)) for p in range(powers)]
    parts.append(F.shiftleft(F.shiftright("n", powers), powers))
    drawn = (
        counted.select("place", "label", F.posexplode(F.array(*parts)).alias("power", "of"))
        .filter("of > 0")
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("_d", F.md5(F.concat_ws("/", "place", "label", "power", "replicate", F.lit(seed))))
        .withColumn("w", poisson_weight(F.col("power"), F.col("of"), F.col("_d")))
    )
    weighted = (
        drawn.groupBy("replicate", F.col("place").cast("double").alias("score"))
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("w")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("label") == 0, F.col("w")).otherwise(0)).alias("neg"),
        )
        .filter("pos + neg > 0")
    )
    # read twice: for the totals of chunks, and below them
    aucs = roc_auc(staged(weighted), ["replicate"]).filter(F.col("auc").isNotNull())
    return quantiles(
        aucs, [], "auc", {"low": 0.05, "median": 0.5, "high": 0.95}, counts=True
    )


#: Powers of two that have a table; a count of 2^POWERS and more adds a normal part.
POWERS = 10


def poisson_tables() -> list[list[float]]:
    """Distribution functions of Poisson(1), Poisson(2), Poisson(4), ... at 0, 1, 2, ...

    Each goes on until it leaves less than a step of the 32-bit numbers looked up in it.
    """
    tables = []
    for power in range(POWERS):
        mean = float(1 << power)
        n, mass, cumulative, steps = 0, math.exp(-mean), 0.0, []
        while n <= mean or 1.0 - cumulative > 1e-11 and mass > 1e-16:
            cumulative += mass
            steps.append(cumulative)
            n += 1
            mass *= mean / n
        tables.append(steps)
    return tables


def _uniform(digest_: Column, at: int) -> Column:
    return F.conv(F.substring(digest_, at, 8), 16, 10).cast("double") / float(1 << 32)


def poisson_weight(power: Column, of: Column, digest_: Column) -> Column:
    """How often ``of`` rows are drawn: by the table of their power, or by the normal limit."""
    # one literal, folded into the plan
    tables = F.from_json(F.lit(json.dumps(poisson_tables())), "array<array<double>>")
    u, v = _uniform(digest_, 1), _uniform(digest_, 9)
    looked = F.size(F.filter(F.element_at(tables, power + 1), lambda x: x <= u))
    normal = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)
    many = F.greatest(F.round(of + F.sqrt(of.cast("double")) * normal), F.lit(0.0))
    return F.when(power < POWERS, looked).otherwise(many).cast("long")


def feature_separation(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: medians by label and the single-feature AUC."""
    labelled = features.filter(F.col("label").isin("cheater", "clean"))
    tall = unpivot(labelled, ["label"], columns)
    mids = quantiles(tall, ["feature", "label"], "value", {"mid": 0.5})
    hist = score_histogram(
        tall, F.col("value"), F.col("label") == "cheater", ["feature"]
    )
    auc = roc_auc(hist, ["feature"]).select("feature", "auc")
    return (
        mids.groupBy("feature")
        .agg(
            F.max(F.when(F.col("label") == "cheater", F.col("mid"))).alias(
                "cheater_median"
            ),
            F.max(F.when(F.col("label") == "clean", F.col("mid"))).alias(
                "clean_median"
            ),
        )
        .join(auc, "feature")
        .withColumn("separation", F.abs(F.col("auc") - 0.5))
    )


def time_profile(window_ticks: DataFrame, keys: Sequence[str] = ("label",)) -> DataFrame:
    """Median, mean and 90th percentile of speed at each offset."""
    by = [*keys, "t_ms"]
    marks = quantiles(window_ticks, by, "yaw_speed", {"lo": 0.5, "hi": 0.9})
    means = window_ticks.groupBy(*by).agg(F.avg("yaw_speed").alias("mid"))
    return means.join(marks, by, "left")


def partial_correlation(y: str, x: str, control: str, rows: DataFrame) -> DataFrame:
    """Correlation of y and x, and what remains of it beside a straight-line control."""
    whole = rows.filter(
        F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(control).isNotNull()
    )
    r = whole.agg(
        F.corr(y, x).alias("r_yx"),
        F.corr(y, control).alias("r_yc"),
        F.corr(x, control).alias("r_xc"),
        F.regr_slope(y, control).alias("slope"),
        F.regr_intercept(y, control).alias("intercept"),
    )
    rest = F.sqrt((1 - F.pow("r_yc", 2)) * (1 - F.pow("r_xc", 2)))
    return r.withColumn(
        "partial",
        F.try_divide(F.col("r_yx") - F.col("r_yc") * F.col("r_xc"), rest),
    )


def confusion(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def agreement(
    rows: DataFrame, a: str, b: str, gap: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Share of rows where two labels agree, and the mean absolute gap of two numbers."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(a) == F.col(b)).cast("int")).alias("agree"),
        F.avg(F.abs(gap)).alias("mean_gap"),
    )


def subgroup_slices(
    rows: DataFrame, slices: Sequence[str], aggs: Sequence[Column]
) -> DataFrame:
    """The same aggregates overall and for each slice column, in one pass.

    Output: ``slice`` ("all" or the column's name), ``subgroup``, the aggregates.
    """
    sets = [[], *[[s] for s in slices]]
    grouped = rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(s) for s in slices]
    ).agg(*aggs, *[F.grouping(s).alias(f"_g_{s}") for s in slices])
    name, value = F.lit("all"), F.lit("all")
    for s in slices:
        here = F.col(f"_g_{s}") == 0
        name = F.when(here, s).otherwise(name)
        value = F.when(here, F.col(s).cast("string")).otherwise(value)
    return grouped.withColumns({"slice": name, "subgroup": value}).drop(
        *slices, *[f"_g_{s}" for s in slices]
    )


def crossing_count(line: Column, low: Column, cap: int = 60) -> Column:
    """Fewest hits out of n (low..cap) that put a share past a line; ``cap`` if none.

    For n tries the first share past the line takes floor(line * n) + 1 hits.
    """
    tries = F.when(low <= cap, F.sequence(low, F.lit(cap)))

    def first(n: Column) -> Column:
        guess = F.floor(line * n).cast("int")
        # the product may round across a whole number: test the neighbours
        return F.array_min(
            F.filter(
                F.array(guess - 1, guess, guess + 1, guess + 2),
                lambda k: (k >= 0) & (k <= n) & (k / n > line),
            )
        )

    return F.coalesce(F.array_min(F.transform(tries, first)), F.lit(cap)).cast("int")


def arrival_sweep(
    arrivals: DataFrame,
    speeds: Sequence[float | None],
    supports: Sequence[int],
    *,
    min_kills: int = K.MIN_KILLS,
    min_clean: int = 30,
) -> DataFrame:
    """Lines and past-rates for every (sweep speed, minimum support) pair.

    ``arrivals`` is :func:`features.arrival_table` with a label. Per window only the
    fastest qualifying arrival matters, so all speeds are counted in one grouped
    pass over windows and the supports are tried on the per-entity counts.
    """
    keys = ["session_id", "entity_id", "label"]
    tags = [f"s{i}" for i in range(len(speeds))]
    latest = [
        F.max(
            F.when(
                F.lit(True) if dps is None else F.col("dps") >= dps, F.col("arrived")
            )
        ).alias(t)
        for t, dps in zip(tags, speeds, strict=True)
    ]
    per_window = arrivals.groupBy("window_uid", *keys).agg(
        F.max("opening").alias("opening"), *latest
    )
    per_entity = (
        per_window.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_kills"),
            *[F.count(t).alias(f"ak_{t}") for t in tags],
            *[
                F.count_if(F.col(t) == F.col("opening")).alias(f"ash_{t}")
                for t in tags
            ],
        )
        .filter(F.col("n_kills") >= min_kills)
    )
    options = F.array(
        *[
            F.struct(
                F.lit(None if dps is None else float(dps)).cast("double").alias("dps"),
                F.lit(k).alias("min_arrival"),
                F.col(f"ak_{t}").alias("ak"),
                F.col(f"ash_{t}").alias("ash"),
            )
            for t, dps in zip(tags, speeds, strict=True)
            for k in supports
        ]
    )
    tall = per_entity.select("label", F.inline(options)).withColumn(
        "share",
        F.when(
            (F.col("ak") >= F.col("min_arrival")) & (F.col("ak") > 0),
            F.col("ash") / F.col("ak"),
        ),
    )
    tall = tall.withColumn("dps", F.coalesce("dps", F.lit(-1.0)))
    by = ["dps", "min_arrival"]
    lines = quantiles(
        tall.filter(F.col("label") == "clean"),
        by,
        "share",
        {"line95": 0.95, "line99": 0.99},
        counts=True,
    ).filter(F.col("n") >= min_clean)
    # one row per combination: a handful of rows, broadcast by its size
    past = tall.join(F.broadcast(lines.drop("n")), by)
    clean, cheat = F.col("label") == "clean", F.col("label") == "cheater"
    shown, over = F.col("share").isNotNull(), F.col("share") > F.col("line95")

    def rate(who: Column) -> Column:
        return F.avg(F.when(who & shown, over.cast("int")))

    out = past.groupBy(*by, "line95", "line99").agg(
        F.try_divide(F.count_if(clean & shown), F.count_if(clean)).alias("coverage"),
        rate(clean).alias("clean_past"),
        rate(cheat).alias("cheat_past"),
        F.try_divide(
            F.sum(F.when(clean & shown, F.col("ash"))),
            F.sum(F.when(clean & shown, F.col("ak"))),
        ).alias("clean_pooled"),
    )
    return out.withColumns(
        {
            "lift": F.try_divide(F.col("cheat_past"), F.col("clean_past")),
            "crossing_count": crossing_count(
                F.col("line95"), F.col("min_arrival")
            ),
        }
    )


def snap_counts(
    kills: DataFrame, speeds: Sequence[float], *, min_kills: int = K.MIN_KILLS
) -> DataFrame:
    """Per entity and (speed, scope): kills over the speed, sniper share and band."""
    keys = ["session_id", "entity_id", "label"]
    sniper = is_sniper(F.col("weapon"))
    wide = (
        kills.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_kills"),
            F.avg(sniper.cast("int")).alias("sniper_share"),
            *[
                F.count_if(
                    (F.col("speed_at_kill") > s) & (F.lit(scope == "all") | ~sniper)
                ).alias(f"c{i}_{scope}")
                for i, s in enumerate(speeds)
                for scope in ("all", "nonsniper")
            ],
        )
        .filter(F.col("n_kills") >= min_kills)
    )
    options = F.array(
        *[
            F.struct(
                F.lit(float(s)).alias("dps"),
                F.lit(scope).alias("scope"),
                F.col(f"c{i}_{scope}").alias("snap"),
            )
            for i, s in enumerate(speeds)
            for scope in ("all", "nonsniper")
        ]
    )
    return wide.select(
        *keys,
        "n_kills",
        "sniper_share",
        sniper_band(F.col("sniper_share")).alias("band"),
        F.inline(options),
    )


def band_lines(
    counts: DataFrame,
    *,
    line_mode: str = "per_band",
    floors: tuple[float, float] | None = None,
    min_clean: int = 30,
) -> DataFrame:
    """Clean lines of a count per (speed, scope), pooled or inside each band.

    Bands with too few clean entities have no line.
    """
    by = ["dps", "scope", "band"]
    rows = counts.filter(F.col("label") == "clean")
    if line_mode == "pooled":
        rows = rows.withColumn("band", F.lit("all"))
    lines = quantiles(
        rows, by, "snap", {"line95": 0.95, "line99": 0.99}, counts=True
    ).filter(F.col("n") >= min_clean)
    if floors:
        lines = lines.withColumns(
            {
                "line95": F.greatest("line95", F.lit(floors[0])),
                "line99": F.greatest("line99", F.lit(floors[1])),
            }
        )
    return lines


def past_rates(counts: DataFrame, lines: DataFrame, *, pooled: bool) -> DataFrame:
    """Share of clean and positive entities past their line, and the lift."""
    by = ["dps", "scope"] if pooled else ["dps", "scope", "band"]
    grid = lines.drop("n", "band") if pooled else lines.drop("n")
    rows = counts.join(F.broadcast(grid), by)
    over = (F.col("snap") > F.col("line95")).cast("int")
    out = rows.groupBy(*by).agg(
        F.max("line95").alias("line95"),
        F.count(F.lit(1)).alias("entities"),
        F.avg(F.when(F.col("label") == "clean", over)).alias("clean_past"),
        F.avg(F.when(F.col("label") == "cheater", over)).alias("cheat_past"),
    )
    return out.withColumns(
        {
            "lift": F.try_divide(F.col("cheat_past"), F.col("clean_past")),
            # a count crosses with the next whole number
            "crossing": F.floor("line95").cast("int") + 1,
        }
    )


def zero_hit_bound(n: Column, alpha: float = 0.05) -> Column:
    """Upper bound of a rate after zero hits in n tries."""
    return 1 - F.pow(F.lit(alpha), F.try_divide(F.lit(1.0), n))


def marks_gate(
    entities: DataFrame,
    *,
    ceiling: float = K.MARK_CLEAN_CEILING,
    lift: float = K.MARK_MIN_LIFT,
) -> DataFrame:
    """Share of entities with a mark per label, its spread, and whether the gates pass."""
    marks = quantiles(entities, ["label"], "marks", {"median": 0.5, "p90": 0.9})
    rates = entities.groupBy("label").agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg((F.col("marks") > 0).cast("int")).alias("with_mark"),
    )
    clean = rates.agg(
        F.max(F.when(F.col("label") == "clean", F.col("with_mark"))).alias("_clean")
    )
    out = attach_row(rates.join(marks, "label"), clean)
    return out.withColumn(
        "passes",
        F.when(F.col("label") == "clean", F.col("with_mark") <= ceiling).otherwise(
            F.col("with_mark") >= F.col("_clean") * lift
        ),
    ).drop("_clean")


def population_summary(
    reports: DataFrame, *, line: float = 0.9, percentiles: Mapping[str, float] | None = None
) -> DataFrame:
    """An outside population per map, and over all maps where ``map`` is NULL.

    ``reports``: map, entity (a total order), flagged, percentile (NULL counts as 0),
    ruled (a strong finding), verdict (NULL: no answer) and held. A chosen percentile is
    the value at place floor(n * share) of the ordered percentiles, from 0. The whole is
    counted beside the maps by a second row per entity, before anything is gathered.
    """
    wanted = percentiles or {"median": 0.5, "p90": 0.9}
    place = F.coalesce("percentile", F.lit(0.0))
    both = reports.select(
        F.explode(F.array(F.col("map").cast("string"), F.lit(None))).alias("map"),
        "entity",
        "flagged",
        "ruled",
        "held",
        place.alias("at"),
        F.coalesce("verdict", F.lit("none")).alias("verdict"),
    ).withColumn("_all", F.col("map").isNull())
    keyed = both.withColumn("_map", F.coalesce("map", F.lit("")))
    ranked = number_by_range(keyed, ["_all", "_map"], ["at", "entity"], "_rn", count="_n")
    at_share = lambda q: F.max(F.when(F.col("_rn") - 1 == floor_share(F.col("_n"), q), F.col("at")))
    said = lambda v: F.count_if(F.col("verdict") == v)
    return ranked.groupBy("_all", "map").agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(F.col("at") >= line).alias("by_score"),
        F.count_if("ruled").alias("ruled"),
        *[said(v).alias(v) for v in ("cheating", "unclear", "clean", "none")],
        F.count_if("held").alias("held"),
        *[at_share(q).alias(n) for n, q in wanted.items()],
    ).drop("_all")


def measurement_check(rows: DataFrame) -> DataFrame:
    """Per parsed measurement: how many were shown and how many are past each line."""
    below = F.col("side") == "below"

    def past(line: str) -> Column:
        over = F.when(below, F.col("value") > F.col(line)).otherwise(
            F.col("value") < F.col(line)
        )
        return F.count_if(over)

    out = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("shown"),
        past("notable").alias("past95"),
        past("strong").alias("past99"),
        F.max("notable").alias("notable"),
        F.max("strong").alias("strong"),
    )
    return out.withColumn("of_shown", F.try_divide(F.col("past95"), F.col("shown")))



def coverage(answers: DataFrame, cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many of the cases the answers cover: covered, cases, share."""
    answered = answers.select(*keys).distinct().withColumn("_a", F.lit(1))
    rows = cases.select(*keys).distinct().join(answered, list(keys), "left")
    return rows.agg(
        F.count("_a").alias("covered"),
        F.count(F.lit(1)).alias("cases"),
        F.try_divide(F.count("_a"), F.count(F.lit(1))).alias("share"),
    )


def answer_summary(rows: DataFrame, keys: Sequence[str] = ("judge",)) -> DataFrame:
    """Rates of judges' answers against targets and labels, one row per judge.

    ``rows``: verdict, probability, invented (a count), seconds, target_verdict,
    target_probability, label, score. Invalid answers count only in ``valid``.
    """
    keys = list(keys)
    ok = F.col("verdict") != "invalid"
    accuses = (F.col("verdict") == "cheating").cast("int")
    clean, listed = F.col("label") == "clean", F.col("label") == "cheater"
    commits = ok & (F.col("verdict") != "unclear")
    right = (listed == (F.col("verdict") == "cheating")).cast("int")

    def among(who: Column, c: Column) -> Column:
        return F.avg(F.when(ok & who, c))

    p, t, s = (
        F.when(ok, F.col(c).cast("double"))
        for c in ("probability", "target_probability", "score")
    )
    rates = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg(ok.cast("int")).alias("valid"),
        among(
            F.lit(True), (F.col("verdict") == F.col("target_verdict")).cast("int")
        ).alias("matches_target"),
        among(clean, accuses).alias("accuses_clean"),
        among(listed, accuses).alias("convicts_listed"),
        among(F.lit(True), (F.col("verdict") == "unclear").cast("int")).alias("unclear"),
        F.avg(F.when(commits, right)).alias("right_when_committing"),
        F.corr(p, t).alias("follows_evidence"),
        F.corr(p, s).alias("_ps"),
        F.corr(s, t).alias("_st"),
        F.coalesce(F.sum(F.when(ok, F.col("invented"))), F.lit(0)).alias("invented"),
    )
    pt, ps, st = F.col("follows_evidence"), F.col("_ps"), F.col("_st")
    rest = F.sqrt((1 - pt * pt) * (1 - st * st))
    hist = score_histogram(rows.filter(ok), F.col("probability"), listed, keys)
    auc = roc_auc(hist, keys).select(*keys, "auc")
    pace = quantiles(rows, keys, "seconds", {"seconds_median": 0.5})
    return (
        rates.withColumn("leans_on_score", F.try_divide(ps - pt * st, rest))
        .drop("_ps", "_st")
        .join(auc, keys, "left")
        .join(pace, keys, "left")
    )


def criterion_check(
    reference: DataFrame, external: DataFrame, value: str, *, ceiling: float = 0.01
) -> DataFrame:
    """A measurement's lines from the reference, tried on a disjoint external sample.

    One row: line95, line99, entities, shown, past95, past99, their shares, and
    whether the share of all entities past the 95% line stays under ``ceiling``.
    """
    lines = quantiles(
        reference.filter(F.col("label") == "clean"),
        [],
        value,
        {"line95": K.NOTABLE_QUANTILE, "line99": K.STRONG_QUANTILE},
    )
    rows = attach_row(external.select(F.col(value).alias("_v")), lines)
    out = rows.agg(
        F.max("line95").alias("line95"),
        F.max("line99").alias("line99"),
        F.count(F.lit(1)).alias("entities"),
        F.count("_v").alias("shown"),
        F.count_if(F.col("_v") > F.col("line95")).alias("past95"),
        F.count_if(F.col("_v") > F.col("line99")).alias("past99"),
    )
    of_all = F.try_divide(F.col("past95"), F.col("entities"))
    return out.withColumns(
        {
            "of_shown": F.try_divide(F.col("past95"), F.col("shown")),
            "of_all": of_all,
            "passes": of_all <= ceiling,
        }
    )


def subgroup_correlation(
    rows: DataFrame, a: str, b: str, keys: Sequence[str]
) -> DataFrame:
    """Correlation of a score with a confounder inside each subgroup."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r")
    )
