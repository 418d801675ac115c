"""Statistics of images against plain restatements."""

import numpy as np
import pandas as pd

from pixelloom.operators import stats
from pixelloom.plans.rel import SparkRel
from pixelloom.plans.run import PIXEL_SCHEMA, _rows


def relation(spark, **images):
    return SparkRel(spark.createDataFrame(pd.concat(_rows(int(i[1:]), img) for i, img in images.items()), PIXEL_SCHEMA))


def shares(img, k):
    levels = np.clip(np.floor(img[..., k] * 255 + 0.5), 0, 255).astype(int)
    return levels, [float((levels <= v).sum()) / levels.size for v in range(256)]


def test_histogram_match_moves_levels_without_pairs_of_levels(spark):
    rng = np.random.default_rng(11)
    large, small, dark, ramp = rng.random((260, 300, 4)), rng.random((5, 3, 4)), rng.random((40, 9, 4)) * 0.3, np.repeat(np.linspace(-0.1, 1.1, 64).reshape(8, 8, 1), 4, 2)
    sources, targets = {"i1": large, "i2": small, "i3": dark}, {"i1": dark, "i2": ramp, "i4": small}
    done = stats.histogram_match(relation(spark, **sources), relation(spark, **targets)).df
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 2
    got = done.toPandas()
    assert sorted(got["image_id"].unique()) == [1, 2]  # those of both sides
    for i in (1, 2):
        one = got[got["image_id"] == i].sort_values(["y", "x"])
        img, other = sources[f"i{i}"], targets[f"i{i}"]
        assert len(one) == img.shape[0] * img.shape[1] and (one["a"] == img[..., 3].ravel()).all()
        for k, c in enumerate("rgb"):
            (levels, a), (_, b) = shares(img, k), shares(other, k)
            to = np.array([min(range(256), key=lambda t, v=v: (abs(a[v] - b[t]), t)) for v in range(256)])
            assert (one[c] == to[levels].ravel() / 255).all()


def test_nearest_levels_take_the_lowest_on_ties():
    source, target = np.zeros(256, int), np.zeros(256, int)
    source[[10, 20]] = 1
    target[[7, 30, 90, 200]] = 1, 0, 2, 1  # shares 1/4, 3/4 and 1; a half lies between
    to = stats.nearest_levels(source, target)
    assert to[9] == 0 and to[10] == 7 and to[19] == 7 and to[20] == 200
