import numpy as np
import pytest

from sightline.operators.quantiles import (
    cumulative_counts,
    feature_quantiles,
    histogram,
    quantiles,
)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(0)
    groups = {
        "even": rng.normal(0, 1, 101),
        "ties": rng.integers(-3, 4, 300).astype(float),
        "wide": 10.0 ** rng.uniform(-9, 9, 57) * rng.choice([-1, 1], 57),
        "one": np.array([4.2]),
    }
    data = [(k, float(v)) for k, vs in groups.items() for v in vs]
    data += [("even", None), ("even", float("nan"))]
    return groups, spark.createDataFrame(data, "g string, v double").repartition(5)


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "nearest"])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.9, 0.99, 1.0])
def test_every_method_matches_numpy(values, method, q):
    groups, df = values
    got = {r.g: r.x for r in quantiles(df, ["g"], "v", {"x": q}, method=method).collect()}
    for g, vs in groups.items():
        if method == "nearest":
            want = np.sort(vs)[int(np.floor(q * (len(vs) - 1) + 0.5))]
        else:
            want = np.quantile(vs, q, method=method)
        assert got[g] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_counts_and_global_quantile(values):
    groups, df = values
    n = {r.g: r.n for r in quantiles(df, ["g"], "v", {"x": 0.5}, counts=True).collect()}
    assert n == {g: len(v) for g, v in groups.items()}
    whole = np.concatenate(list(groups.values()))
    got = quantiles(df, [], "v", {"x": 0.25}).collect()[0].x
    assert got == pytest.approx(np.quantile(whole, 0.25))


def test_several_columns_at_once(spark):
    df = spark.createDataFrame(
        [(1, float(i), float(i * i)) for i in range(11)], "k int, a double, b double"
    )
    got = feature_quantiles(df, ["k"], {"am": ("a", 0.5), "b9": ("b", 0.9)}).collect()[0]
    assert (got.am, got.b9) == (5.0, 81.0)


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles(df, ["g"], "v", {"x": 0.5}).count() == 0


def test_cumulative_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 5, 5)], "value double")
    got = cumulative_counts(histogram(df, []), [], "value", ["n"])
    found = {r.value: (r.n_below, r.n_total) for r in got.collect()}
    assert found == {1.0: (0, 6), 2.0: (2, 6), 5.0: (3, 6)}
