"""Density clusters with cells of many points, against all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from fleetspan.operators import clustering as CL


@pytest.mark.parametrize("held", [64, 4])
def test_dense_cells_are_split_not_paired(spark, monkeypatch, held):
    monkeypatch.setattr(CL, "HELD", held)
    rng = np.random.default_rng(6)
    # neighbouring dense cells: some closer than eps at one corner only, some just too far apart
    blobs = [rng.uniform(0, 0.3, (220, 2)) + at for at in ((0, 0), (0.72, 0.0), (1.65, 0.0), (0.0, 1.2), (5, 5))]
    pts = np.vstack([*blobs, rng.uniform(-1, 6, (40, 2)), [[0.5, 0.15], [0.5, 0.15], [2.2, 0.1]]])
    eps, need = 0.5, 12
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= need
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    got = CL.dbscan(df, "id", "x", "y", eps, need).orderBy("id").toPandas()
    assert (got.is_core.to_numpy() == core).all()
    assert ((got.cluster.to_numpy() >= 0) == ((d <= eps) & core[None]).any(1)).all()
    comp = np.arange(len(pts))
    while True:
        new = np.array([comp[(d[i] <= eps) & core].min() if core[i] else comp[i] for i in range(len(pts))])
        if (new == comp).all():
            break
        comp = new
    pairs = pd.DataFrame({"a": comp[core], "b": got.cluster.to_numpy()[core]}).drop_duplicates()
    assert pairs.a.is_unique and pairs.b.is_unique and len(pairs) > 1
    for i in np.flatnonzero(~core & (got.cluster.to_numpy() >= 0)):  # a rim point belongs to a cluster with a core point nearby
        assert got.cluster[i] in set(got.cluster[(d[i] <= eps) & core])
