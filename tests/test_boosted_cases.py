"""Rows with equal features are one weighted case of the boosted baseline."""

import math

import pytest
from pyspark.sql import functions as F

from copresence.operators import models


@pytest.mark.parametrize("pca", [None, 2])
def test_rows_of_equal_features_are_one_case(spark, monkeypatch, pca):
    seen, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    rows = [(i, float(1 + i % 4), float(1 + i % 5), float((i % 4) * 10 + (i * 7) % 13)) for i in range(800)]
    df = spark.createDataFrame([*rows, (800, None, 1.0, 5.0), (801, 1.0, 1.0, None)], "k int, a double, b double, y double")
    model, errors = models.gbt_baseline(df, ["k"], ["a", "b"], "y", pca, iters=3)
    assert seen == [20]
    for part, data in zip(("train", "test"), models.split(df.dropna(), ["k"], [0.9, 0.1])):
        plain = model.transform(data).select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).first()[0]
        assert math.isclose(errors.where(F.col("part") == part).first().rmse, plain, rel_tol=1e-9)
