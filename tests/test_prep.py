from __future__ import annotations

import random

import pytest

from skyrill.operators import prep


@pytest.mark.parametrize("to_mag", [True, False])
def test_tasks_follow_the_rows(spark, monkeypatch, to_mag):
    """A task sorts a bounded number of rows; epochs without a valid row tell the start and nothing else."""
    rng = random.Random(5)
    rows = [(o, rng.choice("gr"), rng.randrange(400) / 4, rng.choice([-1.0, 5.0, 7.5]), rng.choice([0.0, 0.5, 1.0, None])) for o in range(60) for _ in range(50)]
    rows += [(60, "g", -3.0, 1.0, 0.0), (60, "g", 4.0, 1.0, 1.0), (61, "g", 1.0, 1.0, 0.0)]
    rows = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "object long, band string, mjd double, flux double, err double, pos long").cache()
    monkeypatch.setattr(prep, "TASK_ROWS", 150, raising=False)
    out = prep.prepare(df, to_mag)
    assert out.rdd.getNumPartitions() >= 20
    want = []
    for o in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == o]
        best = {}
        for _, band, mjd, flux, err, pos in mine:
            if err is not None and err > 0 and (flux > 0 or not to_mag):
                k = (band, max(0, round(mjd * 1e6)))
                best[k] = min(best.get(k, (9e9,)), (err, pos, mjd, flux))
        epochs = sorted(b[2] for b in best.values())
        want += [(o, k[0], b[2] - min(r[2] for r in mine), b[2]) for k, b in best.items() if b[2] >= epochs[len(epochs) // 2] - prep.BULK_DAYS]
    got = [(r.object, r.band, r.t, r.mjd) for r in out.collect()]
    assert sorted(got) == sorted(want) and any(r[0] == 60 and r[2] == 7.0 for r in got)
