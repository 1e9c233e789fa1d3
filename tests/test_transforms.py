"""Box-Cox derivatives against numerical integrals, over small, large and negative arguments."""

import numpy as np
from pyspark.sql import functions as F

from sgspark.functions import transforms


def test_box_cox_derivatives(spark):
    values = [-40.0, -3.0, -0.2, 0.0, 1e-9, 0.4, 2.0, 30.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t double")
    for power in (1.3, -0.7, 1e-12):
        got = rows.select("i", *[d.alias(f"d{k}") for k, d in enumerate(transforms.box_cox_derivatives(F.col("t"), power, 3))]).orderBy("i").collect()
        nodes, weights = np.polynomial.legendre.leggauss(200)
        u, w = (nodes + 1) / 2, weights / 2
        for row, t in zip(got, values, strict=True):
            for k in range(4):
                if t is None:
                    assert row[f"d{k}"] is None
                else:
                    want = t ** (k + 1) * (w * u**k * np.exp(power * t * u)).sum()
                    assert np.isclose(row[f"d{k}"], want, rtol=1e-11, atol=0)
