from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from metricloom.operators import clustering


def test_silhouette_sends_one_row_per_point_and_side(spark):
    points = spark.range(3000).select(F.lit("g").alias("group_id"), F.col("id").cast("string").alias("row_id"), (F.col("id") % 5).cast("string").alias("cluster"),
                                      F.array(F.rand(1), F.rand(2)).alias("features"))
    one = clustering.paired(clustering.feature_blocks(points, clustering.BLOCK_POINTS))
    assert one.count() == 1
    rows = one.mapInArrow(clustering._kernel(), clustering.PARTIAL).collect()
    assert len(rows) == 3000 and all(sum(r.n) == 2999 and len(r.n) == len(r.distance) == len(r.other) == 5 for r in rows)
    assert np.isfinite([x for r in rows for x in r.distance]).all()
