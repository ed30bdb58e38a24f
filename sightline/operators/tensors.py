"""Windows as fixed-shape channel arrays, batch scoring, out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.angles import signed_log
from sightline.operators.joins import complete_groups
from sightline.operators.ordered import number_by_range
from sightline.operators.sampling import group_folds
from sightline.session import staged

BASE_CHANNELS = ("d_yaw", "d_pitch", "valid")
TARGET_CHANNELS = ("target_yaw", "target_pitch", "log_distance", "target_visible")


def sequence_channels(
    window_ticks: DataFrame, *, size: int, labels: Sequence[str] | None = None
) -> DataFrame:
    """One row per complete window with an ``array<float>`` of ``size`` per channel.

    Turns are signed-log and zero where the speed is not valid; an unknown target is
    pushed off to 180 / 90 degrees instead of reading as dead centre.
    """
    rows = window_ticks
    if labels is not None:
        rows = rows.filter(F.col("label").isin(*labels))
    valid = F.col("yaw_speed").isNotNull().cast("double")

    def known(name: str, other: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(other))

    channels = {
        "d_yaw": signed_log(known("d_yaw", 0.0)) * valid,
        "d_pitch": signed_log(known("d_pitch", 0.0)) * valid,
        "valid": valid,
    }
    if {"target_yaw_error", "target_visible"} <= set(window_ticks.columns):
        seen = F.col("target_yaw_error").isNotNull().cast("double")
        channels |= {
            "target_yaw": signed_log(known("target_yaw_error", 180.0)),
            "target_pitch": signed_log(known("target_pitch_error", 90.0)),
            "log_distance": F.log1p(known("target_distance", 0.0)) * seen,
            "target_visible": F.coalesce(
                F.col("target_visible").cast("double"), F.lit(0.0)
            ),
        }
    ids = [c for c in ("session_id", "entity_id", "label") if c in rows.columns]
    # channels are made before rows are dealt by window: they are narrower than what they come from
    made = [c.cast("float").alias(f"c_{n}") for n, c in channels.items()]
    rows = rows.select("window_uid", *ids, "tick_offset", *made)
    rows = complete_groups(rows, ["window_uid"], size)
    packed = F.struct("tick_offset", *[f"c_{n}" for n in channels])
    grouped = rows.groupBy("window_uid").agg(
        *[F.first(c).alias(c) for c in ids],
        F.sort_array(F.collect_list(packed)).alias("_rows"),
    )
    return grouped.select(
        "window_uid",
        *ids,
        *[
            F.transform("_rows", _field(f"c_{n}")).alias(f"ch_{n}")
            for n in channels
        ],
    )


def _field(name: str) -> Callable[[Column], Column]:
    return lambda row: row[name]


Scorer = Callable[["object"], "object"]


def score_windows(
    tensors: DataFrame,
    make_scorer: Callable[[], Scorer],
    *,
    batch_size: int = 1024,
    name: str = "score",
) -> DataFrame:
    """Probability per window from a scorer over ``(n, channels, ticks)`` arrays.

    ``make_scorer`` runs once per Python worker and returns a function from a batch
    to n logits; batches arrive through Arrow.
    """
    import pandas as pd

    channels = [c for c in tensors.columns if c.startswith("ch_")]

    def run(batches: Iterable[tuple]) -> Iterable:
        import numpy as np

        scorer = make_scorer()
        for batch in batches:
            n = len(batch[0])
            out = np.empty(n)
            for i in range(0, n, batch_size):
                stack = [np.stack(c.iloc[i : i + batch_size].to_list()) for c in batch]
                x = np.stack(stack, axis=1).astype("float32")
                out[i : i + batch_size] = np.asarray(scorer(x), dtype=float).reshape(-1)
            yield pd.Series(1.0 / (1.0 + np.exp(-out)))

    def wrapped(batches):
        yield from run(batches)

    # pandas is imported only here, so the types that tell the kind of UDF are set here
    wrapped.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.Series],
    }
    udf = F.pandas_udf(wrapped, T.DoubleType())
    return tensors.withColumn(name, udf(*[F.col(c) for c in channels]))


def pooled_channels(tensors: DataFrame) -> DataFrame:
    """``mean_x`` and ``peak_x`` (largest magnitude) of every channel ``ch_x``, in place of its array."""
    channels = [c for c in tensors.columns if c.startswith("ch_")]

    def mean(c: str) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return total / F.size(c)

    def peak(c: str) -> Column:
        return F.array_max(F.transform(c, lambda x: F.abs(x))).cast("double")

    return tensors.select(
        *[c for c in tensors.columns if c not in channels],
        *[mean(c).alias(f"mean_{c[3:]}") for c in channels],
        *[peak(c).alias(f"peak_{c[3:]}") for c in channels],
    )


def fit_window_scorer(
    pooled: DataFrame, label: Column, path: str, *, estimator: object | None = None
) -> None:
    """Fit a classifier on :func:`pooled_channels` and store it at ``path``.

    ``label`` is 1, 0 or NULL; rows without one are not learned from. Training is
    distributed (``pyspark.ml``). ``estimator`` reads ``_x`` and ``y``; the default is a
    regularised logistic regression.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    inputs = [c for c in pooled.columns if c.startswith(("mean_", "peak_"))]
    known = staged(
        pooled.select(label.cast("double").alias("y"), *inputs).filter(F.col("y").isNotNull())
    )
    fit = estimator or LogisticRegression(regParam=0.01, featuresCol="_x", labelCol="y")
    stages = [VectorAssembler(inputCols=inputs, outputCol="_x"), fit]
    Pipeline(stages=stages).fit(known).write().overwrite().save(path)


def score_pooled(pooled: DataFrame, path: str, *, name: str = "score") -> DataFrame:
    """Probability per row from the scorer stored at ``path``; no Python runs in tasks."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    scored = PipelineModel.load(path).transform(pooled)
    return scored.select(*pooled.columns, vector_to_array("probability")[1].alias(name))


def out_of_fold_scores(
    rows: DataFrame,
    features: Sequence[str],
    label: Column,
    *,
    group: str,
    key: str,
    folds: int = 5,
    make_model: Callable[[], object] | None = None,
    fold_of: Callable[[DataFrame, str, int], DataFrame] = group_folds,
) -> DataFrame:
    """Each row scored by a model that never saw its group: key, fold, y, score.

    Missing values are filled with 0 and flagged by a second column per feature.
    Training is distributed (``pyspark.ml``) and reads a stored table; the loop is over the
    few folds. ``fold_of`` deals groups to folds: ``group_folds`` or ``balanced_folds``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    make = make_model or (
        lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=0, featuresCol="_x", labelCol="y")
    )
    filled = fold_of(rows, group, folds).select(
        key,
        "fold",
        label.cast("double").alias("y"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        *[F.col(f).isNull().cast("double").alias(f"{f}_missing") for f in features],
    )
    inputs = [*features, *[f"{f}_missing" for f in features]]
    data = VectorAssembler(inputCols=inputs, outputCol="_x").transform(filled)
    data = staged(data.select(key, "fold", "y", "_x"))
    out: DataFrame | None = None
    for fold in range(folds):
        model = make().fit(data.filter(F.col("fold") != fold))
        scored = model.transform(data.filter(F.col("fold") == fold)).select(
            key,
            "fold",
            "y",
            vector_to_array("probability")[1].alias("score"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def rank_normal(scores: DataFrame, score: str, key: str, name: str) -> DataFrame:
    """Scores replaced by their place in 0..1; ties are told apart by key."""
    placed = number_by_range(scores, [], [score, key], "_rn", count="_n")
    return placed.withColumn(
        name, F.try_divide(F.col("_rn") - 1, (F.col("_n") - 1).cast("double"))
    ).drop("_rn", "_n")


def blend(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Mean of two models' rank-normalised scores."""
    left = rank_normal(a, "score", key, "_a").select(key, "y", "_a")
    right = rank_normal(b, "score", key, "_b").select(key, "_b")
    return left.join(right, key).select(
        key, "y", ((F.col("_a") + F.col("_b")) / 2).alias("score")
    )
