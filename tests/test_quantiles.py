import numpy as np
import pytest

from daymark.operators.quantiles import quantiles

WANTED = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "top": 1.0}


def _groups():
    rng = np.random.default_rng(11)
    return {
        "wide": np.exp(rng.normal(0, 6, 700)) * rng.choice([-1, 1], 700),
        "ties": np.concatenate([np.full(400, 7.0), rng.integers(0, 5, 300).astype(float)]),
        "lone": np.array([1e300] + [float(v) for v in rng.normal(0, 1e-9, 200)]),
        "flat": np.full(50, -0.25),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
    }


@pytest.mark.parametrize("bins,small", [(8, 5), (1024, 4096)])
def test_every_rank_is_exact(spark, bins, small):
    groups = _groups()
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    rows += [("one", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "series_id string, price double")
    got = {r["series_id"]: r for r in quantiles(
        df, "price", WANTED, ["series_id"], bins, small).collect()}
    assert set(got) == {*groups, "none"}
    assert all(got["none"][name] is None for name in WANTED)
    for key, values in groups.items():
        want = np.quantile(values, list(WANTED.values()))
        assert np.allclose([got[key][name] for name in WANTED], want, rtol=1e-12, atol=0), key


def test_no_rows_give_no_rows(spark):
    df = spark.createDataFrame([], "series_id string, price double")
    assert quantiles(df, "price", WANTED, ["series_id"]).count() == 0
