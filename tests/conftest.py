import datetime as dt
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("8", {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


HOURLY = "series_id string, ts timestamp_ntz, price double, exog_1 double, exog_2 double"
LONG = "series_id string, origin date, hour int, y_true double, y_pred double, model string"
DAY0 = dt.datetime(2020, 1, 1)


def encoded(spark, days=15, skip=(), series="a"):
    """price = day*100 + hour, exog_1 = day*10 + hour, exog_2 = day + 0.1*hour."""
    rows = [(series, DAY0 + dt.timedelta(days=d, hours=h), d * 100.0 + h, d * 10.0 + h, d + 0.1 * h)
            for d in range(days) for h in range(24) if (d, h) not in skip]
    return spark.createDataFrame(rows, HOURLY)


def wavy(spark, days, seed=42, series="a"):
    """Daily sinusoid with noise; exog_1 follows the price, exog_2 is independent."""
    rng = np.random.default_rng(seed)
    n = days * 24
    price = 40 + 12 * np.sin(2 * np.pi * (np.arange(n) % 24) / 24) + rng.normal(0, 4, n)
    e1, e2 = price + rng.normal(0, 2, n), rng.normal(100, 10, n)
    rows = [(series, DAY0 + dt.timedelta(hours=i), float(price[i]), float(e1[i]), float(e2[i]))
            for i in range(n)]
    return spark.createDataFrame(rows, HOURLY)


def members_frame(spark, spec, days=30, seed=7, skip=()):
    """Forecasts ``truth + N(bias, noise)`` per member, one shared truth. spec: {name: (bias, noise)}."""
    rng = np.random.default_rng(seed)
    truth = rng.normal(50, 10, (days, 24))
    rows = []
    for name, (bias, noise) in spec.items():
        pred = truth + rng.normal(bias, noise, truth.shape) if noise else truth + bias
        rows += [("a", (DAY0 + dt.timedelta(days=d)).date(), h, float(truth[d, h]),
                  float(pred[d, h]), name)
                 for d in range(days) if d not in skip for h in range(24)]
    return spark.createDataFrame(rows, LONG), truth
