from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from pathlore.operators import drift as D


@pytest.mark.parametrize("total", [9, 40])
def test_growing_sizes_from_running_counts(spark, total, monkeypatch):
    rng, first = random.Random(total), datetime(2024, 1, 1)
    rows = []
    for a, kinds in (("a", 6), ("b", 3)):
        for w in range(total):
            day = first + timedelta(days=rng.randrange(90))
            rows.append((a, w, day, day + timedelta(days=rng.randrange(9)) if rng.random() < 0.9 else None, rng.randrange(kinds) / 7))
    df = spark.createDataFrame(rows, "activity string, window long, start timestamp, end timestamp, entropy double")
    key = ["activity", "pop_size", "pos1"]
    asked = []
    monkeypatch.setattr(D, "ks_two_sample", lambda *a, **k: asked.append(1))
    got = D.ks_drift(df, 2, growing=True).toPandas().sort_values(key, ignore_index=True)
    assert not asked  # every window was copied to every size
    monkeypatch.undo()
    monkeypatch.setattr(D, "DISTINCT", 0)
    want = D.ks_drift(df, 2, growing=True).toPandas().sort_values(key, ignore_index=True)
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        if c in ("d", "p_value"):
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy())
        else:
            assert got[c].equals(want[c])
