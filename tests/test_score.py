"""Scoring from Arrow buffers, and forecasts of rows without whole inputs."""

import numpy as np
import pyarrow as pa
import pytest

from fieldcast.operators import score
from fieldcast.plans import jobs

SCHEMA = "site string, year int, sat array<array<double>>, weather array<array<double>>, soil array<double>"


def rows():
    one = [[1.0, 2.0], [3.0, 4.0]]
    return [
        ("whole", 1, one, [[5.0]], [1.0, 2.0]),
        ("null", 1, None, [[5.0]], [1.0, 2.0]),
        ("empty", 1, [], [[5.0]], [1.0, 2.0]),
        ("ragged", 1, [[1.0], [2.0, 3.0]], [[5.0]], [1.0, 2.0]),
        ("longer", 1, [*one, [5.0, 6.0]], [[5.0], [7.0]], [1.0, 2.0]),
        ("hole", 1, [[None, 2.0]], [[5.0]], [1.0, 2.0]),
        ("no row", 1, [None], [[5.0]], [1.0, 2.0]),
    ]


def test_shapes_and_tensors_of_slices():
    a = pa.array([[[1.0, 2.0]], None, [[3.0, 4.0]], [[5.0], [6.0, 7.0]], []])
    assert score.shapes(a, 2).tolist() == [[1, 2], [0, 0], [1, 2], [2, 0], [0, 0]]
    assert score.shapes(a.slice(2), 2).tolist() == [[1, 2], [2, 0], [0, 0]]
    assert score.tensor(a.take(pa.array([0, 2])), (1, 2)).tolist() == [[[1, 2]], [[3, 4]]]
    assert score.tensor(a.slice(2, 1), (1, 2)).tolist() == [[[3, 4]]]


def test_rows_are_scored_by_shape(spark):
    got = {r["site"]: r for r in score.score(spark.createDataFrame(rows(), SCHEMA).repartition(2), score.stand_in_scorer).collect()}
    assert {s for s, r in got.items() if r["pi"] is None} == {"null", "empty", "ragged", "no row"}
    model = score.stand_in_scorer()
    for s in ("whole", "longer"):
        x = [np.array([got[s][k]], float) for k in ("sat", "weather", "soil")]
        for name, v in zip(("pi", "sigma", "mu"), model(*x)):
            assert got[s][name] == pytest.approx(v[0].tolist())
    assert all(np.isnan(got["hole"]["mu"][0]) for _ in (0,))
    assert score.score(spark.createDataFrame([], SCHEMA), score.stand_in_scorer).count() == 0


def test_a_worker_keeps_its_model(monkeypatch):
    monkeypatch.setattr(score, "_KEPT", {})
    made = []
    load = lambda: made.append(1) or "model"
    assert score._model(load, "a") == score._model(load, "a") == "model" and len(made) == 1
    score._model(load, "b")
    assert len(made) == 2 and set(score._KEPT) == {"b"}


def test_shares_of_the_modalities(spark):
    d = spark.createDataFrame([("a", 1, [[0.2]], [[50.0]], [1.0]), ("b", 1, [[0.9]], [[50.0]], [1.0]), ("c", 1, [[0.2]], [[50.0]], [5.0])], SCHEMA)
    means = score.feature_means(d)
    assert [m.tolist() for m in means] == [[pytest.approx(1.3 / 3)], [50.0], [pytest.approx(7 / 3)]]
    got = {r["site"]: r["shares"] for r in score.score(d, score.stand_in_scorer, means=means).collect()}
    assert all(sum(s) == pytest.approx(1) and s[1] == 0 for s in got.values())
    assert got["b"][0] > got["a"][0] and got["c"][2] > got["a"][2]


def test_a_row_without_inputs_has_a_status(spark):
    history = spark.createDataFrame([("whole", 1, 3.0, 4.0)], "site string, year int, observed_yield double, historical_avg double")
    d = spark.createDataFrame(rows()[:3], SCHEMA)
    for more in ({}, {"explain": True}):
        got = {r["site"]: r for r in jobs.forecast(d, history, score.stand_in_scorer, **more).collect()}
        assert got["whole"]["status"] == "ok" and got["whole"]["risk"] == "Low Risk" and got["whole"]["observed_yield"] == 3.0
        for s in ("null", "empty"):
            assert got[s]["status"] == "no input" and all(got[s][c] is None for c in ("predicted_yield", "lower_bound", "upper_bound", "std", "risk", "report"))
    assert got["whole"]["advice"] and got["null"]["advice"] is None
    none = jobs.forecast(d.filter("site = 'null'"), history, score.stand_in_scorer, explain=True).collect()
    assert [r["status"] for r in none] == ["no input"]
