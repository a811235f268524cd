import datetime as dt

import numpy as np
import pytest
from conftest import DAY0, encoded, wavy
from pyspark.sql import functions as F

from daymark.operators import arma as R
from daymark.operators import attribution as A
from daymark.operators import boosting as B
from daymark.operators import features as X
from daymark.operators import models as M
from daymark.operators import splits as V
from daymark.operators.solvers import elastic_net, lasso_aic
from daymark.operators.trees import Cuts, Paths, TreeParams, fit_boosted


def test_lasso_knot_meets_the_optimality_conditions_and_beats_a_grid():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 25))
    x[:, 24] = x[:, 0] + x[:, 1]  # a redundant column must not break the path
    y = x[:, :3] @ np.array([3.0, -2.0, 1.0]) + rng.normal(size=200) + 7
    w, b = lasso_aic(x, y)
    corr = (x - x.mean(0)).T @ (y - x @ w - b)
    level = np.abs(corr[w != 0])
    assert np.ptp(level) < 1e-6 and np.abs(corr).max() <= level[0] + 1e-6
    xc, yc = x - x.mean(0), y - y.mean()
    noise = ((yc - xc @ np.linalg.lstsq(xc, yc, rcond=None)[0]) ** 2).sum() / (200 - 26)
    aic = lambda v: ((yc - xc @ v) ** 2).sum() / noise + 2 * np.count_nonzero(v)
    grid = [aic(elastic_net(x, y[:, None], lam / 200, 1.0, 3000)[0][:, 0])
            for lam in np.geomspace(1, 500, 40)]
    assert aic(w) <= min(grid) + 1e-6
    with pytest.raises(ValueError):
        lasso_aic(x[:20], y[:20])


def _seen(spark, feats, window, every, **more):
    """Block -> (training days, test days), as the fits get them."""

    def spans(train, test):
        import pandas as pd
        return pd.DataFrame({"train": [train["day"].tolist()], "test": [test["day"].tolist()]})

    rows = M.run_rows(feats, window, every, **more)
    got = M.run_blocks(rows, window, spans, "train array<date>, test array<date>").collect()
    return rows, sorted((r["train"], r["test"]) for r in got)


def test_runs_are_not_merged_into_few_tasks(spark):
    def where(train, test):
        import pandas as pd
        from pyspark import TaskContext
        return pd.DataFrame({"task": [TaskContext.get().partitionId()], "n": [len(test)]})

    feats = X.build_features(encoded(spark, 60)).cache()
    got = M.run_blocks(M.run_rows(feats, 10, 4, run_days=4), 10, where, "task int, n int").collect()
    # 43 origins in runs of one block; by their bytes all of them would fit in one task.
    assert sum(r["n"] for r in got) == 43 and len(got) == 11
    assert len({r["task"] for r in got}) >= 9


def test_walk_forward_blocks_see_exactly_their_window(spark):
    feats = X.build_features(encoded(spark, 40)).cache()
    first = (DAY0 + dt.timedelta(days=7)).date()
    for run_days in (None, 4, 7, 12, 100):
        _, got = _seen(spark, feats, 10, 4, run_days=run_days)
        assert len(got) == 6
        for b, (train, test) in enumerate(got):
            assert train == [first + dt.timedelta(days=4 * b + i) for i in range(10)]
            assert test[0] == train[-1] + dt.timedelta(days=1)
            assert len(test) == min(4, 33 - 10 - 4 * b)


def test_a_training_day_is_sent_less_than_twice(spark):
    feats = X.build_features(encoded(spark, 120)).cache()
    for every in (1, 3, 7):
        rows, got = _seen(spark, feats, 20, every)
        assert rows.count() < 2 * feats.count()
        assert sum(len(test) for _, test in got) == feats.count() - 20


def test_blocks_are_calendar_days_and_windows_count_present_days(spark):
    feats = X.build_features(encoded(spark, 60))
    lost = [(DAY0 + dt.timedelta(days=n)).date() for n in (25, 26, 27, 28, 40)]
    feats = feats.filter(~F.col("day").isin(lost)).cache()
    days = sorted(r["day"] for r in feats.select("day").collect())
    for run_days in (None, 5):
        _, got = _seen(spark, feats, 10, 5, run_days=run_days)
        blocks = {}
        for i, day in enumerate(days[10:], 10):
            blocks.setdefault((day - days[10]).days // 5, []).append(i)
        assert got == sorted(([days[j] for j in range(b[0] - 10, b[0])], [days[j] for j in b])
                             for b in blocks.values())


def test_open_origins_alone_are_fitted_again(spark):
    feats = X.build_features(encoded(spark, 60)).cache()
    wanted = [(DAY0 + dt.timedelta(days=n)).date() for n in (30, 31, 55)]
    todo = feats.filter(F.col("day").isin(wanted)).select("series_id", F.col("day").alias("origin"))
    out = M.run_walk_forward(feats, M.window_mean, "m", 10, 1, todo=todo)
    full = M.run_walk_forward(feats, M.window_mean, "m", 10, 1)
    pick = lambda f: sorted((r["origin"], r["hour"], r["y_pred"]) for r in f.collect())
    assert pick(out) == pick(full.filter(F.col("origin").isin(wanted))) and out.count() == 72
    _, got = _seen(spark, feats, 10, 1, todo=todo)
    assert [test for _, test in got] == [[d] for d in wanted]


def test_walk_forward_over_absent_and_bounded_origins(spark):
    feats = X.build_features(encoded(spark, 40)).cache()
    first = (DAY0 + dt.timedelta(days=7)).date()
    out = M.run_walk_forward(feats, M.window_mean, "mean", 10, 4)
    assert out.count() == 24 * (33 - 10)
    empty = M.run_walk_forward(feats, M.window_mean, "mean", 100)
    assert empty.count() == 0 and empty.columns[:3] == ["series_id", "origin", "hour"]
    bounded = M.run_walk_forward(feats, M.window_mean, "mean", 10, 1,
                                 first + dt.timedelta(days=20), first + dt.timedelta(days=22))
    assert bounded.select("origin").distinct().count() == 3


def test_forecasts_ignore_everything_from_the_origin_on(spark):
    df = wavy(spark, 60)
    late = F.to_date("ts") >= F.lit((DAY0 + dt.timedelta(days=50)).date())
    moved = df.withColumn("price", F.when(late, F.col("price") * 3).otherwise(F.col("price")))
    cut = F.col("origin") <= F.lit((DAY0 + dt.timedelta(days=50)).date())
    for fit in (lambda f: M.fit_seasonal_arx(f, 28, 7),
                lambda f: M.run_walk_forward(X.build_features(f), M.window_mean, "m", 20, 1)):
        a, b = [fit(x).filter(cut).orderBy("origin", "hour").toPandas()["y_pred"] for x in (df, moved)]
        assert len(a) and np.allclose(a, b)


def test_arx_equals_least_squares_on_the_same_rows(spark):
    df = wavy(spark, 60)
    got = M.fit_seasonal_arx_daily(df, 28, 7).orderBy("origin").toPandas()
    pdf = df.toPandas()
    daily = pdf.groupby(pdf["ts"].dt.date)[["price", "exog_1", "exog_2"]].mean().to_numpy()
    y, x1, x2 = daily.T
    t = np.arange(8, len(y))
    z = np.column_stack([y[t - 1] - y[t - 2], y[t - 7] - y[t - 8], x1[t] - x1[t - 1], x2[t] - x2[t - 1]])
    dy = y[t] - y[t - 1]
    want = []
    for i in range(28, len(t)):
        s = i - i % 7
        beta = np.linalg.lstsq(z[s - 28:s], dy[s - 28:s], rcond=None)[0]
        want.append(y[t[i] - 1] + z[i] @ beta)
    np.testing.assert_allclose(got["y_pred"], want, atol=1e-6)


def test_moving_average_terms_are_recovered():
    rng = np.random.default_rng(11)
    n = 40_000
    dx, e = rng.normal(size=(n, 1, 2)), rng.normal(size=n)
    want = [0.4, 0.2, 1.5, -0.7, -0.5, 0.3]
    dy = np.zeros(n)
    for t in range(7, n):
        dy[t] = (want[0] * dy[t - 1] + want[1] * dy[t - 7] + dx[t, 0] @ want[2:4] + e[t]
                 + want[4] * e[t - 1] + want[5] * e[t - 7])
    dy = dy[:, None]
    long_in = R.long_inputs(dy, dx)
    rows = np.arange(100, n)
    fit = R.fit_arma(dy, dx, long_in, rows)
    np.testing.assert_allclose(fit.short[0, :4], want[:4], atol=0.02)
    np.testing.assert_allclose(fit.short[0, 4:], want[4:], atol=0.02)
    assert R.normal_gap(dy, dx, long_in, rows, fit).max() < 1e-9
    fit.short[0, 4] += 0.1
    assert R.normal_gap(dy, dx, long_in, rows, fit).max() > 1e-3


def test_arma_equals_two_regressions_and_forecasts_unknown_days(spark):
    df = wavy(spark, 130)
    last = (DAY0 + dt.timedelta(days=129)).date()
    gap = (DAY0 + dt.timedelta(days=120)).date()
    df = df.filter(F.to_date("ts") != F.lit(gap)).withColumn(
        "price", F.when(F.to_date("ts") < F.lit(last), F.col("price")))
    for run_days in (7, 28, 500):
        got = R.fit_seasonal_arma(df, 60, 7, daily=True, run_days=run_days).orderBy("origin").toPandas()
        if run_days == 7:
            want = got
        assert got["origin"].tolist() == want["origin"].tolist()
        np.testing.assert_allclose(got["y_pred"], want["y_pred"], atol=1e-8)
    assert got["origin"].iloc[-1] == last and np.isnan(got["y_true"].iloc[-1])
    assert gap not in set(got["origin"])
    hourly = R.fit_seasonal_arma(df, 60, 7)
    assert hourly.filter(F.col("origin") == F.lit(last)).count() == 24
    # The first block by hand: two least-squares fits on the 45 days before it.
    pdf = wavy(spark, 130).toPandas()
    y, a, b = pdf.groupby(pdf["ts"].dt.date)[["price", "exog_1", "exog_2"]].mean().to_numpy().T
    d = lambda v: np.concatenate([[np.nan], np.diff(v)])
    dy, da, db = d(y), d(a), d(b)
    start = 84  # the first multiple of seven with 60 usable days before it
    t = np.arange(start - 60, start)
    inputs = lambda t: np.column_stack([dy[t - k] for k in range(1, 16)] + [
        x[t - k] for k in range(16) for x in (da, db)])
    phi = np.linalg.lstsq(inputs(t), dy[t], rcond=None)[0]
    left = lambda t: dy[t] - inputs(t) @ phi
    short = lambda t: np.column_stack([dy[t - 1], dy[t - 7], da[t], db[t], left(t - 1), left(t - 7)])
    beta = np.linalg.lstsq(short(t), dy[t], rcond=None)[0]
    days = np.arange(start, start + 7)
    np.testing.assert_allclose(want["y_pred"][:7], y[days - 1] + short(days) @ beta, atol=1e-6)
    assert want["origin"].iloc[0] == (DAY0 + dt.timedelta(days=start)).date()


def test_lasso_recipe_beats_the_window_mean(spark):
    # 320 days: more training rows than features.
    feats = X.build_features(wavy(spark, 320)).cache()
    lasso = M.fit_lasso_aic_daily(feats, 290, 30).toPandas()
    mean = M.run_walk_forward(feats, M.window_mean, "mean", 290, 30, daily=True).toPandas()
    mae = lambda f: (f["y_true"] - f["y_pred"]).abs().mean()
    assert len(lasso) == len(mean) == 313 - 290
    assert mae(lasso) < 0.8 * mae(mean)


def test_lasso_coefficients_attribute_its_forecasts(spark):
    names = X.feature_names()
    feats = X.build_features(wavy(spark, 310)).cache()
    days = sorted(r["day"] for r in feats.select("day").collect())
    past, live = feats.filter(F.col("day") < days[-5]), feats.filter(F.col("day") >= days[-5])
    coefs = M.lasso_coefficients(past, names, 290, targets_per_task=7).cache()
    assert coefs.count() == 25 * len(names)
    out = A.attribute_linear(M.lasso_inputs(live, names, coefs), coefs)
    sums = out.groupBy("target", "hour", "day").agg(
        (F.sum("value") + F.first("expected")).alias("z"))
    level = coefs.select("target", "hour", "y_centre", "y_width").distinct()
    got = sums.join(level, (sums.target == level.target) & sums.hour.eqNullSafe(level.hour)).select(
        "day", F.coalesce(sums.hour, F.lit(24)).alias("h"),
        (F.sinh("z") * F.col("y_width") + F.col("y_centre")).alias("p"))
    got = {(r["day"], r["h"]): r["p"] for r in got.collect()}
    arr = lambda rows, c: np.array([r[c] for r in rows], float)
    train, test = past.orderBy("day").collect()[-290:], live.orderBy("day").collect()
    y = arr(train, "y")
    want = M.lasso_recipe(arr(train, "x"), np.column_stack([y, y.mean(axis=1)]), arr(test, "x"))
    assert np.allclose([[got[r["day"], h] for h in range(25)] for r in test], want)


SMALL = TreeParams(trees=4, depth=2, rate=0.5, bins=8, min_leaf=3)


def test_trees_are_refitted_on_earlier_days_only(spark):
    days = lambda n: (DAY0 + dt.timedelta(days=n)).date()
    feats = X.build_features(wavy(spark, 40)).cache()
    pick = lambda rows: {(r["origin"], r["hour"] if "hour" in r else 0): r["y_pred"] for r in rows}
    for daily in (True, False):
        walk = lambda f: B.gbt_walk_forward(f, 20, 7, SMALL, daily=daily, run_days=7).collect()
        out = walk(feats)
        assert sorted({r["origin"] for r in out}) == [days(n) for n in range(27, 40)]
        assert len(out) == 13 * (1 if daily else 24)
        # The second block starts on day 34: later prices change no forecast up to its first day's.
        late = F.col("day") >= F.lit(days(34))
        moved = feats.withColumn("y", F.when(late, F.transform("y", lambda v: v * 3)).otherwise(F.col("y")))
        assert pick(out) == pick(walk(moved))
        block = B.fit_gbt(feats.filter(F.col("day").between(days(14), days(33))), SMALL)
        want = pick(B.arm_forecasts(B.score_gbt(block, feats.filter(late)), daily).collect())
        got = {k: v for k, v in pick(out).items() if k[0] >= days(34)}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert B.gbt_walk_forward(feats, 100, 7, SMALL, daily=True).count() == 0


def plain_trees(x, y, p):
    """One target, node by node: every split tried in turn, medians of the residuals."""
    edges = []
    for f in range(x.shape[1]):
        seen = np.unique(x[:, f])
        cut = seen[:-1]
        if len(seen) > p.bins:
            ranked = np.sort(x[:, f])
            cut = np.unique([ranked[i * (len(x) - 1) // p.bins] for i in range(1, p.bins)])
            cut = cut[cut < seen[-1]]
        edges += [(f, c) for c in cut]
    left, losses = y - np.median(y), []
    for _ in range(p.trees):
        parts = [np.arange(len(y))]
        for _ in range(p.depth):
            grown = []
            for rows in parts:
                s = np.sign(left[rows])
                best, chosen = s.sum() ** 2 / max(len(rows), 1) + 1e-6, None
                for f, c in edges:
                    go = x[rows, f] <= c
                    if go.sum() < p.min_leaf or (~go).sum() < p.min_leaf:
                        continue
                    gain = s[go].sum() ** 2 / go.sum() + s[~go].sum() ** 2 / (~go).sum()
                    if gain > best + 1e-9:
                        best, chosen = gain, go
                grown += [rows] if chosen is None else [rows[chosen], rows[~chosen]]
            parts = grown
        for rows in parts:
            if len(rows):
                left[rows] -= p.rate * np.median(left[rows])
        losses.append(np.abs(left).sum())
    return left, losses


@pytest.mark.parametrize("n", [70, 200])
def test_trees_equal_a_plain_fit(n):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(size=(n, 3)), rng.integers(0, 3, n), np.zeros(n)])
    y = np.column_stack([np.round(3 * x[:, 0] + x[:, 3] + rng.normal(0, 0.3, n), 1),
                         np.abs(x[:, 1]), np.full(n, 2.0)])
    p = TreeParams(trees=6, depth=3, rate=0.5, bins=10, min_leaf=5)
    seen = []
    fit = fit_boosted(Cuts(x, p.bins), y, p, lambda t, left: seen.append(np.abs(left).sum(axis=0)))
    for j in range(3):
        left, losses = plain_trees(x, y[:, j], p)
        np.testing.assert_allclose([s[j] for s in seen], losses, atol=1e-9)
        np.testing.assert_allclose(y[:, j] - fit.predict(x)[:, j], left, atol=1e-9)
        assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:]))
    assert (fit.cover.sum(axis=2) == n).all()
    with pytest.raises(ValueError):
        TreeParams(trees=0)


def test_inputs_without_a_split_leave_the_median():
    x, y = np.ones((30, 4)), np.arange(30.0)[:, None]
    fit = fit_boosted(Cuts(x, 8), y, SMALL)
    assert np.allclose(fit.predict(x), 14.5) and (fit.feature == -1).all()


def test_each_series_has_trees_of_its_own(spark):
    a, b = wavy(spark, 40), wavy(spark, 40, seed=5, series="b")
    both = X.build_features(a.unionByName(b)).cache()
    alone = X.build_features(b).cache()
    pick = lambda f: sorted((r["target"], r["hour"] or 0, r["base"], r["value"])
                            for r in f.filter("series_id = 'b'").collect())
    assert pick(B.fit_gbt(both, SMALL)) == pick(B.fit_gbt(alone, SMALL, targets_per_task=25))
    report = B.fit_certificate(B.fit_gbt(both, SMALL).cache(), both).collect()
    assert len(report) == 50
    assert all((r["loss_rises"], r["wrong_leaves"], r["lost_rows"]) == (0, 0, 0)
               and r["n_trees"] == 4 and r["base_gap"] < 1e-9 for r in report)
    broken = B.fit_gbt(both, SMALL).withColumn("value", F.transform("value", lambda v: v - 9))
    assert all(r["wrong_leaves"] and r["loss_rises"] for r in B.fit_certificate(broken, both).collect())


def test_tree_search_picks_a_trial_and_refits_it(spark):
    feats = X.build_features(wavy(spark, 60).unionByName(wavy(spark, 60, seed=9, series="b"))).cache()
    roles = V.tuning_window(feats, 10, 30)
    trials = B.tree_trials(4, trees=(2, 6))
    assert trials == B.tree_trials(4, trees=(2, 6))
    scores = B.search_trees(roles, feats, trials, trials_per_task=2).cache()
    best = {r["series_id"]: r for r in B.best_trees(scores).collect()}
    table = scores.toPandas()
    for series, rows in table.groupby("series_id"):
        assert len(rows) == 4 and best[series]["n_trials"] == 4
        assert best[series]["trial"] == rows.sort_values(["mae", "trial"])["trial"].iloc[0]
    tuned = B.gbt_walk_forward(feats, 30, 7, B.best_trees(scores), daily=True)
    p = best["b"]
    own = TreeParams(p["trees"], p["depth"], p["rate"], p["bins"], p["min_leaf"])
    alone = B.gbt_walk_forward(feats.filter("series_id = 'b'"), 30, 7, own, daily=True)
    got = tuned.filter("series_id = 'b'")
    assert got.count() == alone.count() > 0 and got.exceptAll(alone).count() == 0
    assert tuned.select("series_id").distinct().count() == 2


def test_a_live_day_is_forecast_by_stored_trees(spark):
    df = wavy(spark, 40)
    feats = X.build_features(df).cache()
    day = (DAY0 + dt.timedelta(days=39)).date()
    models = B.fit_gbt(feats.filter(F.col("day") < F.lit(day)), SMALL).cache()
    known = B.forecast_day_fitted(models, df, day).orderBy("hour").collect()
    hidden = df.withColumn("price", F.when(F.to_date("ts") < F.lit(day), F.col("price")))
    blind = B.forecast_day_fitted(models, hidden, day).orderBy("hour").collect()
    assert [r["y_pred"] for r in known] == [r["y_pred"] for r in blind]
    assert len(blind) == 24 and all(r["y_true"] is None for r in blind)
    want = B.arm_forecasts(B.score_gbt(models, feats.filter(F.col("day") == F.lit(day)))).orderBy("hour")
    assert [r["y_pred"] for r in blind] == [r["y_pred"] for r in want.collect()]


def test_search_is_seeded_and_picks_the_smallest_error(spark):
    feats = X.build_features(wavy(spark, 60)).cache()
    roles = V.tuning_window(feats, 10, 30)
    trials = M.random_trials(6)
    assert trials == M.random_trials(6)
    scores = M.search(roles, feats, trials, 2).toPandas()
    best = M.best_trial(M.search(roles, feats, trials, 3)).collect()[0]
    assert len(scores) == 6 and best["trial"] == scores.loc[scores["mae"].idxmin(), "trial"]


def _brute(paths, x, n):
    """Shapley values by enumerating every coalition of the features of one row."""
    from itertools import combinations
    from math import factorial

    def value(known):
        out = 0.0
        for feature, low, high, share, leaf in zip(
                paths.feature, paths.low, paths.high, paths.share, paths.value):
            p = leaf
            for f, lo, hi, z in zip(feature, low, high, share):
                if f >= 0:
                    p *= float(lo < x[f] <= hi) if f in known else z
            out += p
        return out

    phi = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(others, k):
                phi[i] += factorial(k) * factorial(n - k - 1) / factorial(n) * (
                    value({*s, i}) - value(set(s)))
    return phi, value(set())


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_tree_attributions_equal_all_coalitions(depth):
    rng = np.random.default_rng(depth)
    x = rng.uniform(0, 1, (150, 4))
    y = (x[:, 0] * x[:, 1] + (x[:, 2] > 0.5) + rng.normal(0, 0.05, 150))[:, None]
    fit = fit_boosted(Cuts(x, 6), y, TreeParams(3, depth, 0.5, 6, 4))
    paths = Paths.of(fit, 0)
    values, expected = paths.attributions(x)
    np.testing.assert_allclose(values.sum(axis=1) + expected + fit.base[0],
                               fit.predict(x)[:, 0], atol=1e-9)
    # Cover shares make the expected value the mean over the training rows.
    assert expected + fit.base[0] == pytest.approx(fit.predict(x).mean())
    for row, v in zip(x[:12], values):
        phi, base = _brute(paths, row, 4)
        np.testing.assert_allclose(v, phi, atol=1e-12)
        assert base == pytest.approx(expected)


def test_tree_models_freeze_score_and_explain(spark, tmp_path):
    df = wavy(spark, 40)
    feats = X.build_features(df).cache()
    cut = F.lit((DAY0 + dt.timedelta(days=33)).date())
    train, live = feats.filter(F.col("day") < cut), feats.filter(F.col("day") >= cut)
    path = str(tmp_path / "frozen")
    B.freeze(train, df, 20, path, SMALL)
    meta = spark.read.parquet(f"{path}/metadata").collect()[0]
    assert meta["n_train_days"] == 20 and meta["frozen_on"] < live.agg(F.min("day")).collect()[0][0]
    assert B.score_frozen(path, live).count() == 24 * live.count()
    assert B.score_frozen(path, live, daily=True).count() == live.count()
    models = B.load_frozen(spark, path)
    attr = B.attribute_trees(models, live, X.feature_names(), run_days=3).cache()
    assert attr.count() == 25 * live.count() * len(X.feature_names())
    pred = B.score_gbt(models, live).select(
        "series_id", "target", "hour", F.col("origin").alias("day"),
        F.col("y_pred").alias("prediction"))
    A.require_additive(attr, pred)
    assert A.additivity(attr, pred).count() == 25
    assert A.conservation(attr).filter("abs(grouped - ungrouped) > 1e-9").count() == 0
