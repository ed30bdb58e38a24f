import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import evaluate as E
from sightline.operators import sampling as U
from sightline.operators import tensors as N
from sightline.operators.ordered import tick_chunk
from tests.conftest import rows


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(9)
    data = [(i, round(rng.gauss(0.5 if i % 3 else 0.9, 0.4), 1), i % 3 == 0) for i in range(300)]
    return data, spark.createDataFrame(data, "id long, score double, y boolean").repartition(4)


def brute_auc(data):
    pos = [s for _, s, y in data if y]
    neg = [s for _, s, y in data if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_is_pairwise(scored):
    data, df = scored
    got = E.roc_auc(E.score_histogram(df, F.col("score"), F.col("y"))).first()
    assert got.auc == pytest.approx(brute_auc(data))
    assert (got.positives, got.negatives) == (100, 200)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1.0, True)], "score double, y boolean")
    assert E.roc_auc(E.score_histogram(df, F.col("score"), F.col("y"))).first().auc is None


def test_precision_and_recall(scored):
    data, df = scored
    hist = E.score_histogram(df, F.col("score"), F.col("y"))
    cuts = sorted({s for _, s, _ in data}, reverse=True)
    average = best = 0.0
    for c in cuts:
        tp = sum(y for _, s, y in data if s >= c)
        fp = sum(not y for _, s, y in data if s >= c)
        here = sum(y for _, s, y in data if s == c)
        average += here / 100 * tp / (tp + fp)
        if fp / 200 <= 0.1:
            best = max(best, tp / 100)
    assert E.pr_auc(hist).first().pr_auc == pytest.approx(average)
    assert E.tpr_at_fpr(hist, (0.1,)).first().tpr_at_10pct == pytest.approx(best)


def test_bootstrap_is_repeatable_and_brackets_the_auc(scored):
    data, df = scored
    args = (F.col("score"), F.col("y"))
    a = E.bootstrap_auc(df, *args, replicates=60).first()
    b = E.bootstrap_auc(df.repartition(7), *args, replicates=60).first()
    assert a == b and a.n == 60
    assert a.low < brute_auc(data) < a.high


def test_poisson_draws_have_the_mean_and_variance_of_their_counts(spark):
    counts = [1, 2, 3, 7, 64, 700, 1023, 5000]
    drawn = (
        spark.createDataFrame([(n,) for n in counts], "n long")
        .crossJoin(spark.range(4000))
        .select("n", *[F.col("n").bitwiseAND(F.lit(1 << p)).alias(f"p{p}") for p in range(E.POWERS)], F.expr(f"(n >> {E.POWERS}) << {E.POWERS}").alias(f"p{E.POWERS}"), "id")
    )
    weight = F.lit(0)
    for p in range(E.POWERS + 1):
        digest = F.md5(F.concat_ws("/", "n", "id", F.lit(p)))
        own = E.poisson_weight(F.lit(p), F.col(f"p{p}"), digest)
        weight = weight + F.when(F.col(f"p{p}") > 0, own).otherwise(0)
    for r in drawn.groupBy("n").agg(F.avg(weight).alias("mean"), F.var_samp(weight).alias("var")).collect():
        assert abs(r["mean"] - r.n) < 5 * (r.n / 4000) ** 0.5, r
        assert 0.88 < r["var"] / r.n < 1.12, r


def test_bootstrap_meets_replicates_with_scores_and_not_with_rows(spark):
    rows_ = spark.range(20_000).select((F.col("id") % 10).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("y"))
    plan = E.score_histogram(rows_, F.col("s"), F.col("y"))
    assert plan.count() == 10
    found = E.bootstrap_auc(rows_, F.col("s"), F.col("y"), replicates=50).first()
    whole = E.roc_auc(plan).first().auc
    assert found.low < whole < found.high and found.high - found.low < 0.05


def test_crossing_count(spark):
    def brute(line, low, cap=60):
        return min((s for n in range(low, cap + 1) for s in range(n + 1) if s / n > line), default=cap)

    lines = [0.0, 0.1, 0.29, 0.4857, 0.5, 2 / 3, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(x,) for x in lines], "line double")
    for r in df.select("line", E.crossing_count(F.col("line"), F.lit(5)).alias("n")).collect():
        assert r.n == brute(r.line, 5)


def test_zero_hits_bound(spark):
    got = spark.range(1).select(E.zero_hit_bound(F.lit(300.0)).alias("b")).first().b
    assert got == pytest.approx(1 - 0.05 ** (1 / 300))


def test_bags_are_even_and_padded(spark):
    df = spark.createDataFrame([(e, t) for e, n in ((1, 100), (2, 7), (3, 4)) for t in range(n)], "e long, t long")
    got = {r.e: r for r in U.bags(df, ["e"], "t", ["t"], chunk=tick_chunk("t", 16)).collect()}
    assert set(got) == {1, 2}
    assert got[1].t == [float(i * 99 // 15) for i in range(16)]
    assert got[2].t == [float(i) for i in range(7)] + [0.0] * 9
    assert sum(got[2].mask) == 7


def test_splits_keep_groups_together(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 40).alias("g"))
    got = U.group_split(df, "g")
    per = got.groupBy("g").agg(F.countDistinct("split").alias("n")).filter("n > 1")
    assert got.count() == 2000 and per.count() == 0
    sizes = {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert sizes == {"train": 28, "val": 6, "test": 6}
    again = U.group_split(df.repartition(9), "g")
    assert rows(again, "id", "split") == rows(got, "id", "split")


@pytest.mark.parametrize("n", [90, 170, 340])
def test_shares_are_cut_exactly(spark, n):
    """90 * 0.7 is 62.99... as a double, but 63 of 90 groups are 0.7 of them."""
    got = U.group_split(spark.range(n), "id").groupBy("split").count()
    train, val = n * 7 // 10, n * 85 // 100
    assert {r.split: r["count"] for r in got.collect()} == {"train": train, "val": val - train, "test": n - val}


def test_queue_takes_turns(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b", i in (0, 7)) for i in range(8)], "id long, s string, v boolean")
    got = U.interleave(df, ["s"], "id", F.col("v"))
    first = [r.id for r in got.orderBy("half", "turn", "s").collect()][:2]
    assert first == [0, 7]
    assert rows(got.filter("half = 1 and s = 'a'"), "turn") == [(i,) for i in range(1, 6)]


def test_tensors_drop_short_windows_and_mask(spark):
    data = [("w", 0, 1, "clean", o, 3.0, -1.0, None if o == 0 else 5.0) for o in range(-2, 1)]
    data += [("short", 0, 1, "clean", o, 3.0, -1.0, 5.0) for o in range(-1, 1)]
    df = spark.createDataFrame(
        data, "window_uid string, session_id long, entity_id long, label string, tick_offset int, d_yaw double, d_pitch double, yaw_speed double"
    )
    got = N.sequence_channels(df, size=3).collect()
    assert [r.window_uid for r in got] == ["w"]
    assert got[0].ch_valid == [1.0, 1.0, 0.0]
    assert got[0].ch_d_yaw[2] == 0.0 and got[0].ch_d_yaw[0] == pytest.approx(1.3862943)


def test_blend_ranks(spark):
    a = spark.createDataFrame([(1, 0.0, 0.1), (2, 1.0, 0.2), (3, 1.0, 0.9)], "id long, y double, score double")
    b = a.withColumn("score", -F.col("score"))
    assert rows(N.blend(a, b, "id"), "id", "score") == [(1, 0.5), (2, 0.5), (3, 0.5)]


@pytest.mark.parametrize("k", [2, 5])
def test_balanced_folds_differ_by_one_group_at_most(spark, k):
    from collections import Counter

    from sightline.operators.sampling import balanced_folds

    sizes = {None: 9, "hot": 60, **{f"g{i}": 1 + i % 7 for i in range(40)}}
    df = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g string, i int")
    found = balanced_folds(df, "g", k).collect()
    assert len(found) == sum(sizes.values()) and len({(r.g, r.fold) for r in found}) == len(sizes)
    rows_ = Counter(r.fold for r in found)
    assert set(rows_) == set(range(k)) and max(rows_.values()) - min(rows_.values()) <= 60
    # without the hot group's fold the others are alike
    rest = sorted(rows_.values())[:-1]
    assert max(rest) - min(rest) <= 9


def test_fitted_scorer_is_its_stored_coefficients(spark, tmp_path):
    """Pooled by hand, learned from labelled rows only, and scored by what was stored."""
    import math

    from pyspark.ml import PipelineModel

    data = [(f"w{i}", [0.1 * i, -0.3 * (i % 5)], [1.0, float(i % 2)], None if i % 4 == 3 else i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(data, "window_uid string, ch_a array<float>, ch_b array<float>, told boolean")
    pooled = N.pooled_channels(df)
    assert pooled.columns == ["window_uid", "told", "mean_a", "mean_b", "peak_a", "peak_b"]
    by = {r.window_uid: r for r in pooled.collect()}
    for w, a, b, _ in data:
        assert by[w].mean_a == pytest.approx(sum(a) / 2) and by[w].peak_a == pytest.approx(max(map(abs, a)))
        assert by[w].mean_b == sum(b) / 2 and by[w].peak_b == 1.0
    path = str(tmp_path / "scorer")
    N.fit_window_scorer(pooled, F.col("told"), path)
    N.fit_window_scorer(pooled.filter("told IS NOT NULL"), F.col("told"), str(tmp_path / "told"))
    model, told = (PipelineModel.load(p).stages[-1] for p in (path, str(tmp_path / "told")))
    assert list(model.coefficients) == pytest.approx(list(told.coefficients))
    scored = N.score_pooled(pooled, path)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    for r in scored.collect():
        x = (r.mean_a, r.mean_b, r.peak_a, r.peak_b)
        z = model.intercept + sum(c * v for c, v in zip(model.coefficients, x, strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert scored.count() == 40


def test_out_of_fold_scores_with_balanced_folds(spark):
    """Every group is scored once, by one fold, and folds hold alike many rows."""
    from collections import Counter

    from sightline.operators.sampling import balanced_folds

    data = [(i, f"g{i % 7}", float(i % 2), float(i % 2) if i % 5 else None) for i in range(70)]
    df = spark.createDataFrame(data, "id long, g string, y double, f double")
    got = N.out_of_fold_scores(df, ["f"], F.col("y"), group="g", key="id", folds=3, fold_of=balanced_folds).collect()
    assert sorted(r.id for r in got) == list(range(70))
    fold = {}
    for r in got:
        assert fold.setdefault(f"g{r.id % 7}", r.fold) == r.fold
    sizes = Counter(r.fold for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 10
    assert all((r.score > 0.5) == (r.y == 1) for r in got if r.id % 5)
