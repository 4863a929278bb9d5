import datetime as dt

import numpy as np
import pandas as pd
import pytest

from stagecast.operators import bias, cdf, clean, extremes, lookup
from tests.small import INIT, Dist, forecast, historical, make_tables, prepared


def january(n, year=2001):
    return [dt.datetime(year + i // 31, 1, 1 + i % 31) for i in range(n)]


def one_month(spark, sim, obs, members=(), records=()):
    """A station whose data all lie in January."""
    return make_tables(
        spark, [("A", 10)],
        [(t, "A", float(v)) for t, v in zip(january(len(obs)), obs)],
        [(t, 10, float(v)) for t, v in zip(january(len(sim)), sim)],
        [(INIT + pd.Timedelta(hours=3 * i), 10, INIT, 1, None if v is None else float(v)) for i, v in enumerate(members)],
        [(t, 10, float(v)) for t, v in records],
    )


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(11)
    return {
        "smooth": (rng.gamma(2, 20, 300).round(3) + 0.1, rng.gamma(3, 4, 90).round(2) + 50),
        "plateau": (rng.random(200) * 40 + 1, np.r_[rng.random(20), 80 + rng.random(20)]),
        "constant obs": (rng.random(60) * 10 + 1, np.full(30, 7.0)),
        "constant sim": (np.full(30, 5.0), rng.random(40) * 9),
        "edges": (np.arange(1, 65, dtype=float), np.arange(0, 33, dtype=float)),
        "tiny": (np.array([2.0, 9.0]), np.array([4.0])),
    }


@pytest.mark.parametrize("name", ["smooth", "plateau", "constant obs", "constant sim", "edges", "tiny"])
def test_history_equals_numpy(spark, samples, name):
    sim, obs = samples[name]
    tables = one_month(spark, sim, obs)
    got = bias.corrected_simulation(tables, bias.fit(tables)).toPandas().sort_values("datetime")
    sim = np.maximum(sim, 0.1)
    assert np.allclose(got.corrected, historical(sim, sim, prepared(obs)), rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", ["smooth", "plateau", "constant obs", "constant sim", "edges", "tiny"])
def test_forecast_equals_numpy(spark, samples, name):
    sim, obs = samples[name]
    low, high = sim.min(), sim.max()
    values = np.r_[low / 2, low, high, high * 1.5, np.linspace(low, high, 41)]
    tables = one_month(spark, sim, obs, values)
    got = bias.corrected_forecast(tables, bias.fit(tables)).toPandas().sort_values("datetime")
    assert np.allclose(got.corrected, forecast(values, np.maximum(sim, 0.1), prepared(obs)), rtol=0, atol=1e-9)
    assert got.min_factor.iloc[0] == 0.5 and got.max_factor.iloc[3] == 1.5


def test_plateau_direction(spark):
    """At the share of a flat stretch history takes its far end, the forecast its near end."""
    sim, obs = np.arange(1.0, 5.0), np.r_[np.full(2, 0.0), np.full(2, 50.0)]
    s, o = Dist(sim), Dist(prepared(obs))
    at = s.right[np.flatnonzero(s.cdf == 0.5)[0]]
    assert np.sum(o.cdf == 0.5) > 1
    tables = one_month(spark, sim, obs, [at])
    rows = spark.createDataFrame([(float(at),)], "value double").crossJoin(bias.fit(tables).mapping)
    far = bias.map_historical(rows, "value", "m").first().m
    near = bias.map_forecast(rows, "value", "m").first().m
    assert far == pytest.approx(o.right[np.flatnonzero(o.cdf == 0.5)[-1]])
    assert near == pytest.approx(o.right[np.flatnonzero(o.cdf == 0.5)[0]])


def test_undefined_forecast_keeps_the_clipped_value(spark):
    """Probability 0 against an empty lowest bin has no image: the value stays as it was."""
    sim = np.arange(5.0, 21.0)  # minimum on a bin edge
    assert np.isclose(sim.min() / Dist(sim).step % 1, 0)
    base, other = [(dt.datetime(2001, 2, 1), "A", 0.0)], [(t, "A", 40.0 + i) for i, t in enumerate(january(20))]
    tables = make_tables(
        spark, [("A", 10)], base + other, [(t, 10, float(v)) for t, v in zip(january(len(sim)), sim)],
        [(INIT, 10, INIT, 1, 5.0), (INIT, 10, INIT, 2, 2.5)],
    )
    got = {r.member: r.corrected for r in bias.corrected_forecast(tables, bias.fit(tables)).collect()}
    assert got == {1: 5.0, 2: 2.5}


def test_missing_members_stay_missing(spark, samples):
    sim, obs = samples["smooth"]
    tables = one_month(spark, sim, obs, [None, 3.0, None])
    model = bias.fit(tables)
    assert [r.corrected is None for r in bias.corrected_forecast(tables, model).orderBy("datetime").collect()] == [True, False, True]
    assert [r.mapped is None for r in bias.mapped_forecast(tables, model).orderBy("datetime").collect()] == [True, False, True]


def test_station_with_an_unobserved_month_has_no_history(spark):
    sim = [(dt.datetime(2001, m, d), 10, float(m * d)) for m in (1, 2) for d in range(1, 20)]
    obs = [(dt.datetime(2001, m, d), h, float(d)) for h, months in (("A", (1,)), ("B", (1, 2))) for m in months for d in range(1, 20)]
    members = [(INIT, 10, INIT, 1, 5.0)]
    tables = make_tables(spark, [("A", 10), ("B", 10)], obs, sim, members)
    model = bias.fit(tables)
    assert {r.hydroweb for r in bias.corrected_simulation(tables, model).collect()} == {"B"}
    # Its forecast month was observed, so the forecast alone can be corrected.
    assert {r.hydroweb for r in bias.corrected_forecast(tables, model).collect()} == {"A", "B"}


def test_first_or_last_month(spark):
    rng = np.random.default_rng(5)
    sim = [(dt.datetime(2001, m, d), 10, float(m * 10 + d)) for m in (1, 2) for d in range(1, 28)]
    obs = [(dt.datetime(2001, m, d), "A", float(rng.random() * m * 7)) for m in (1, 2) for d in range(1, 28)]
    members = [(INIT, 10, INIT, 1, 25.0), (INIT + pd.Timedelta(days=10), 10, INIT, 1, 25.0)]
    tables = make_tables(spark, [("A", 10)], obs, sim, members)
    model = bias.fit(tables)
    first = {r.mapped for r in bias.mapped_forecast(tables, model, 0).collect()}
    last = {r.mapped for r in bias.mapped_forecast(tables, model, -1).collect()}
    assert len(first) == len(last) == 1 and first != last
    with pytest.raises(ValueError):
        bias.mapped_forecast(tables, model, 1)


def test_records_over_new_year(spark):
    days = [dt.datetime(2001, 12, 30), dt.datetime(2001, 12, 31), dt.datetime(2002, 1, 1)]
    both = [(dt.datetime(2001, m, d), float(m + d)) for m in (1, 12) for d in range(1, 28)]
    tables = make_tables(
        spark, [("A", 10)], [(t, "A", v) for t, v in both], [(t, 10, v) for t, v in both], [],
        [(t, 10, 9.0) for t in days] + [(dt.datetime(2002, 5, 1), 11, 9.0)],
    )
    model = bias.fit(tables)
    assert bias.corrected_records(tables.records, model).count() == 3
    assert bias.corrected_records(tables.records, model, compat=True).count() == 0


def test_record_month_without_observation_is_dropped(spark, samples):
    sim, obs = samples["smooth"]
    tables = one_month(spark, sim, obs, (), [(dt.datetime(2002, 1, 2), 4.0), (dt.datetime(2002, 2, 2), 4.0)])
    got = bias.corrected_records(tables.records, bias.fit(tables)).collect()
    assert [r.datetime.month for r in got] == [1]


def test_large_lookups_and_hot_keys_give_the_same(spark, samples, monkeypatch):
    """The shuffled path with cut groups against the broadcast path."""
    sim, obs = samples["smooth"]
    tables = one_month(spark, sim, obs, np.linspace(1, 90, 50), [(dt.datetime(2002, 1, 2), 4.0)])

    def results():
        model = bias.fit(tables)
        maxima = extremes.annual_maxima(tables, model)
        frames = (
            bias.corrected_simulation(tables, model), bias.corrected_forecast(tables, model), maxima,
            bias.corrected_records(tables.records, model), clean.observed_levels(tables.observed),
            cdf.month_cdf(tables.observed, "hydroweb", "waterlevel", True),
        )
        return [f.toPandas().sort_values(list(f.columns)).reset_index(drop=True) for f in frames]

    plain = results()
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookup, "HOT_ROWS", 7)
    for a, b in zip(plain, results()):
        pd.testing.assert_frame_equal(a, b)


def test_shift_and_floor(spark):
    tables = one_month(spark, [0.0, 5.0, float("nan")], [100.0, 100.05, 130.0])
    assert sorted(r.level for r in clean.observed_levels(tables.observed).collect()) == pytest.approx([0.1, 0.1, 30.0])
    assert sorted(r.level for r in clean.observed_levels(tables.observed, False).collect()) == pytest.approx([100, 100.05, 130])
    assert sorted(r.value for r in clean.simulated(tables.simulation).collect()) == [0.1, 5.0]
