"""Small tables give as many neighbours as asked (operator 2)."""

import numpy as np

from netvigil.llm import ann_forest


def test_small_tables_give_all_neighbours_asked(spark):
    for n in (12, 22, 30):
        x = np.random.default_rng(n).standard_normal((n, 64))
        df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann_forest.search(df, df).groupBy("query_id").count().collect()
        assert len(got) == n and {r["count"] for r in got} == {min(ann_forest.NEAREST, n - 1)}
