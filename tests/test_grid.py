import os

import pytest
from pyspark.sql import functions as F

from stockyard.plans import models

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_grid_of_small_panels(spark, monkeypatch):
    """Few rows are one partition, however many a shuffle has, and fits side by side give what one after another gives."""
    monkeypatch.setattr(models, "GRID", ((2, 2, 0.1), (1, 1, 0.5)))
    panel = models._panel(spark, SF)
    assert panel.rdd.getNumPartitions() == 1 and models._few(panel, 10).rdd.getNumPartitions() == 1
    assert models._few(spark.range(100, numPartitions=8), 30).rdd.getNumPartitions() == 4
    got = {(r.iterations, r.depth, r.step): r.mean_rmse for r in models.boosted_grid_cv(spark, SF).collect()}
    p = panel.filter("train")
    a, b = p.agg(F.min("date"), F.max("date")).first()
    p = p.withColumn("fold", F.floor(4 * F.datediff("date", F.lit(a)) / ((b - a).days + 1)))
    for it, depth, step in models.GRID:
        rmse = []
        for f in (1, 2, 3):
            e = models._fit(p.filter(F.col("fold") < f), it, depth, step).transform(p.filter(F.col("fold") == f))
            d = [(max(0.0, r.forecast) - r.q) ** 2 for r in e.collect()]
            rmse.append((sum(d) / len(d)) ** 0.5)
        assert got[it, depth, step] == pytest.approx(sum(rmse) / 3, rel=1e-9)
    assert len(got) == 2
