"""The decaying baseline does not depend on its blocks, and no task holds a whole channel."""

import numpy as np
import pandas as pd
import pytest

from sampledeck.operators import stats
from sampledeck.plans.observation import Signal


@pytest.mark.parametrize("block", [1, 7, 64, 65536])
def test_blocks_change_nothing(spark, block):
    g = np.random.default_rng(3)
    v = g.standard_normal(200) + 5
    v[[0, 1, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 90, 199]] = np.nan
    frame = spark.createDataFrame(pd.DataFrame({"idat": np.arange(200), "ichan": 0, "ipol": 0, "v": v})).repartition(3)
    found = stats.decay_baseline(Signal(frame, None), 8.0, block=block).data.orderBy("idat").toPandas()["v"].to_numpy(float)
    expected = v - pd.Series(v).ewm(alpha=1 / 8, adjust=False).mean().to_numpy()
    np.testing.assert_allclose(found, expected, atol=1e-12)
