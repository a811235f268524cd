"""Small dense solvers that run inside a task on one bounded training window."""

from __future__ import annotations

import numpy as np

MAD_NORMAL = 0.6744897501960817


def centre_scale(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and scaled MAD per column; a zero MAD scales by one."""
    med = np.median(a, axis=0)
    mad = np.median(np.abs(a - med), axis=0) / MAD_NORMAL
    return med, np.where(mad > 0, mad, 1.0)


def lasso_aic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and intercept at the knot of the lasso path with the smallest AIC.

    Follows the piecewise-linear path of Efron et al. (2004): variables enter when their
    correlation reaches the current level and leave when their coefficient crosses zero. AIC
    uses the residual variance of the full least-squares fit, so more rows than columns are
    needed.
    """
    n, p = x.shape
    if n <= p + 1:
        raise ValueError(f"lasso_aic: {n} rows cannot estimate the noise of {p} features")
    mx, my = x.mean(axis=0), float(y.mean())
    xc, yc = x - mx, y - my
    gram, corr, yy = xc.T @ xc, xc.T @ yc, float(yc @ yc)
    full = np.linalg.lstsq(xc, yc, rcond=None)[0]
    noise = float(((yc - xc @ full) ** 2).sum()) / (n - p - 1)
    if noise <= 0:
        return full, my - float(mx @ full)
    w, active, barred = np.zeros(p), [], gram.diagonal() <= 1e-12 * max(gram.diagonal().max(), 1.0)
    inverse = np.zeros((0, 0))  # of the active block of the Gram matrix, updated step by step
    best, best_w = yy / noise, w.copy()
    start = np.abs(np.where(barred, 0.0, corr))
    level, enter = float(start.max()), int(np.argmax(start))
    floor = 1e-9 * max(level, 1.0)
    target = corr.copy()
    for _ in range(8 * p):
        if enter >= 0:
            border = gram[active, enter]
            part = inverse @ border
            spare = gram[enter, enter] - border @ part
            if spare < 1e-7 * gram[enter, enter]:
                barred[enter] = True  # a combination of the variables already in
            else:
                grown = np.empty((len(active) + 1,) * 2)
                grown[:-1, :-1] = inverse + np.outer(part, part) / spare
                grown[:-1, -1] = grown[-1, :-1] = -part / spare
                grown[-1, -1] = 1 / spare
                inverse, active = grown, [*active, enter]
        if not active:
            break
        step_dir = inverse @ np.sign(corr[active])
        drift = gram[:, active] @ step_dir
        outside = np.ones(p, dtype=bool)
        outside[active] = False
        outside &= ~barred
        gamma, enter, leave = level, -1, -1
        for sign in (1.0, -1.0):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = (level - sign * corr) / (1.0 - sign * drift)
            g = np.where(outside & (g > 1e-12), g, np.inf)
            j = int(np.argmin(g))
            if g[j] < gamma:
                gamma, enter = float(g[j]), j
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = np.where(step_dir != 0, -w[active] / step_dir, np.inf)
        cross = np.where(cross > 1e-12, cross, np.inf)
        i = int(np.argmin(cross))
        if cross[i] < gamma:
            gamma, enter, leave = float(cross[i]), -1, i
        w[active] += gamma * step_dir
        corr = corr - gamma * drift
        level -= gamma
        if leave >= 0:
            w[active[leave]] = 0.0
            rest = np.arange(len(active)) != leave
            inverse = inverse[np.ix_(rest, rest)] - np.outer(
                inverse[rest, leave], inverse[leave, rest]) / inverse[leave, leave]
            active = active[:leave] + active[leave + 1:]
        rss = yy - w @ target - w @ corr
        aic = rss / noise + 2 * np.count_nonzero(w)
        if aic < best:
            best, best_w = aic, w.copy()
        if level <= floor or (enter < 0 and leave < 0):
            break
    else:
        raise ArithmeticError("the path did not reach its end")
    return best_w, my - float(mx @ best_w)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1: float, sweeps: int = 60
                ) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coordinate descent for all target columns at once: coefficients, intercepts, and whether
    the last sweep moved no coefficient by more than 1e-4 of the targets' scale."""
    n = len(x)
    mx, my = x.mean(axis=0), y.mean(axis=0)
    gram, corr = (x - mx).T @ (x - mx), (x - mx).T @ (y - my)
    w = np.zeros((x.shape[1], y.shape[1]))
    ridge, cut = n * alpha * (1 - l1), n * alpha * l1
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rho = corr[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - cut, 0) / (gram[j, j] + ridge)
            moved = max(moved, float(np.abs(new - w[j]).max()))
            w[j] = new
        if moved < 1e-7:
            break
    return w, my - mx @ w, moved <= 1e-4 * max(float(y.std()), 1e-12)
