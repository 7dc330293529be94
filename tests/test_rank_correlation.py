"""Rank correlation over all rows of a table."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import crosssection as X


@pytest.mark.parametrize("listed", [0, 1000])
def test_partial_rank_correlation_adds_up_by_value(spark, listed):
    dice = np.random.default_rng(5)
    d = pd.DataFrame({"a": dice.integers(0, 6, 900).astype(float), "c": dice.integers(0, 4, 900).astype(float)})
    d["b"] = np.round(d["a"] * 2 - d["c"] + dice.normal(0, 3, 900), 1)
    got = X.partial_rank_correlation(spark.createDataFrame(d), "a", "b", "c", listed).first()
    r = d.rank().corr()
    xy, xz, yz = r.loc["a", "b"], r.loc["a", "c"], r.loc["b", "c"]
    assert got.n == 900 and got.ic == pytest.approx(xy, abs=1e-9)
    assert got.partial_ic == pytest.approx((xy - xz * yz) / np.sqrt((1 - xz**2) * (1 - yz**2)), abs=1e-9)
