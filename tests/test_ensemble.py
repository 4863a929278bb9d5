import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagecast.operators import alerts, bias, ensemble, extremes, lookup
from stagecast.schemas import ENSEMBLE, RETURN_PERIODS
from stagecast.sinks import writers
from tests.small import INIT, make_tables

HOUR = pd.Timedelta(hours=1)


def corrected(spark, rows):
    """Rows (hours after start, member, value) of one run as corrected ensemble rows."""
    data = [("A", 10, INIT.to_pydatetime(), (INIT + h * HOUR).to_pydatetime(), m, v) for h, m, v in rows]
    return spark.createDataFrame(
        data, "hydroweb string, reachid int, initialized timestamp_ntz, datetime timestamp_ntz, member int, corrected double"
    )


def flat_tables(spark, members, stations=(("A", 10),), years=(2000, 2001, 2002), spread=True):
    """Simulation equals observation, so correction changes little; thresholds come from the years."""
    days = [dt.datetime(y, 1, d) for y in years for d in range(1, 29)]
    level = {t: float(t.day + (t.year - 2000) * 5 if spread else 7.0) for t in days}
    observed = [(t, h, level[t]) for h, _ in stations for t in days]
    simulated = [(t, r, level[t]) for r in sorted({r for _, r in stations}) for t in days]
    return make_tables(spark, list(stations), observed, simulated, members)


def state(tables):
    model = bias.fit(tables)
    return model, extremes.return_periods(extremes.annual_maxima(tables, model))


def test_statistics_equal_pandas(spark):
    rng = np.random.default_rng(2)
    values = rng.random((4, 52)).round(4)
    values[1, 6] = np.nan                     # incomplete moment with a high-resolution value
    values[2, 51] = np.nan                    # complete moment without one
    values[3, [0, 51]] = np.nan               # neither: left out
    rows = [(3 * i, m + 1, None if np.isnan(v) else float(v)) for i in range(4) for m, v in enumerate(values[i])]
    got = ensemble.ensemble_stats(corrected(spark, rows)).orderBy("datetime").toPandas()
    assert len(got) == 3
    for i in (0, 2):
        want = pd.Series(values[i][:51]).quantile([1, 0.75, 0.5, 0.25, 0]).to_numpy()
        assert np.allclose(got.loc[i, ["flow_max", "flow_75", "flow_avg", "flow_25", "flow_min"]].to_numpy(float), want)
    assert np.isnan(got.flow_max[1]) and got.high_res[1] == values[1, 51] and np.isnan(got.high_res[2])
    ordered = got.loc[0, ["flow_min", "flow_25", "flow_avg", "flow_75", "flow_max"]].to_numpy(float)
    assert (np.diff(ordered) >= 0).all()


def test_daily_maximum_equals_resample(spark):
    rows = [(h, m, float(h * m % 17)) for h in range(0, 96, 6) if not 48 <= h < 72 for m in (1, 2)]
    rows += [(3, 3, 1.0)]                     # a member with rows on the first day only
    got = ensemble.daily_maximum(corrected(spark, rows)).toPandas()
    wide = pd.DataFrame(rows, columns=["h", "m", "v"]).assign(t=lambda d: INIT + d.h * HOUR).pivot(index="t", columns="m", values="v")
    want = wide.resample("D").max()
    table = got.assign(day=pd.to_datetime(got.day)).pivot(index="day", columns="member", values="max_value")
    assert np.allclose(table.to_numpy(float), want.to_numpy(float), equal_nan=True)
    assert len(got) == 4 * 3


def test_wide_and_back(spark):
    rows = [(INIT + 3 * i * HOUR, 10, INIT, m, None if m == 7 else float(i * 100 + m)) for i in range(3) for m in range(1, 53)]
    tables = flat_tables(spark, rows)
    wide = ensemble.ensemble_wide(tables.ensemble)
    assert wide.columns == ["datetime", "reachid", "initialized"] + [f"ensemble_{m:02d}" for m in range(1, 53)]
    assert wide.where("ensemble_07 is null and ensemble_52 is not null").count() == 3
    back = ensemble.ensemble_long(wide).select(*tables.ensemble.columns)
    assert back.exceptAll(tables.ensemble).count() == 0 and back.count() == 156


def test_records_come_from_the_first_member_at_the_start(spark):
    rows = [(INIT + h * HOUR, 10, INIT, m, float(h + m)) for h in (0, 3) for m in (1, 2)]
    got = ensemble.forecast_records(flat_tables(spark, rows).ensemble).collect()
    assert [(r.datetime, r.value) for r in got] == [(INIT.to_pydatetime(), 1.0)]


def members(above, days=1, high=1e4, low=0.5):
    return [(INIT + pd.Timedelta(days=d), 10, INIT, m, high if m <= above else low) for d in range(days) for m in range(1, 53)]


@pytest.mark.parametrize("above, alert", [(52, "R100"), (21, "R100"), (20, "R0"), (0, "R0")])
def test_forty_percent(spark, above, alert):
    """21 of 52 are 40.38 %, 20 of 52 are 38.46 %."""
    tables = flat_tables(spark, members(above))
    model, thresholds = state(tables)
    row = ensemble.exceedance_daily(tables, model, thresholds).first()
    shares = [row[f"pct_{rp}"] for rp in RETURN_PERIODS]
    assert shares == sorted(shares, reverse=True) and 0 <= shares[-1] and shares[0] <= 100
    assert row.pct_100 == pytest.approx(above * 100 / 52)
    assert alerts.warnings_wide(tables, model, INIT).first().wd01 == alert


def test_gap_day_and_short_forecast(spark):
    rows = [r for r in members(52, days=9) if r[0] != INIT + pd.Timedelta(days=4)]
    tables = flat_tables(spark, rows)
    model, thresholds = state(tables)
    row = alerts.warnings_wide(tables, model, INIT, thresholds).first()
    assert [row[f"wd{d:02d}"] for d in range(1, 16)] == ["R100"] * 4 + ["R0"] + ["R100"] * 4 + [None] * 6


def test_equal_years_alert_everywhere(spark):
    tables = flat_tables(spark, members(0), spread=False)
    model, thresholds = state(tables)
    row = thresholds.first()
    assert row.degenerate and [row[f"return_period_{rp}"] for rp in RETURN_PERIODS] == [0.0] * 6
    assert alerts.warnings_wide(tables, model, INIT).first().wd01 == "R100"
    assert alerts.warning_status(tables, model, thresholds, INIT).first().status == "degenerate"


def test_boundary_row_counts_in_both_windows(spark):
    rows = [(INIT + h * HOUR, 10, INIT, m, 1e4 if h == 24 else 0.5) for h in range(0, 76, 3) for m in range(1, 53)]
    tables = flat_tables(spark, rows)
    model, thresholds = state(tables)
    got = ensemble.probability_table(tables, model, thresholds).orderBy("window").collect()
    # 51 members against a divisor of 52: 98 percent at most.
    assert [(r.window, r.r100, r.label) for r in got] == [(0, 98, "Jan 28"), (1, 98, "Jan 29"), (2, 0, "Jan 30")]


def test_window_without_complete_rows_is_zero(spark):
    rows = [(INIT + h * HOUR, 10, INIT, m, None if m == 7 and 24 <= h <= 48 else 1e4) for h in range(0, 76, 3) for m in range(1, 53)]
    tables = flat_tables(spark, rows)
    model, thresholds = state(tables)
    assert [r.r2 for r in ensemble.probability_table(tables, model, thresholds).orderBy("window").collect()] == [98, 0, 98]


def test_dates_of_a_run(spark):
    rows = bias.forecast_rows(flat_tables(spark, members(1)).ensemble)
    got = ensemble.forecast_dates(bias.forecast_runs(rows)).orderBy("day_no").collect()
    assert [r.date for r in got] == [(INIT + pd.Timedelta(days=i)).date() for i in range(15)]


def test_failed_stations_get_r0_on_all_days(spark):
    tables = flat_tables(spark, members(52, days=14), stations=(("A", 10), ("B", 10), ("C", 12), ("D", 14)))
    # B lacks observations, C's reach has no forecast, D's reach has no simulation.
    tables = tables.__class__(
        tables.station, tables.observed.where("hydroweb <> 'B'"), tables.simulation.where("reachid <> 14"),
        tables.ensemble, tables.records,
    )
    model, thresholds = state(tables)
    got = {r.hydroweb: [r[f"wd{d:02d}"] for d in range(1, 16)] for r in alerts.warnings_wide(tables, model, INIT, thresholds).collect()}
    assert got == {"A": ["R100"] * 14 + [None], **{h: ["R0"] * 14 + [None] for h in "BCD"}}
    status = {r.hydroweb: r.status for r in alerts.warning_status(tables, model, thresholds, INIT).collect()}
    assert status == {"A": "ok", "B": "month without observation", "C": "no forecast", "D": "no simulation"}


def test_only_the_asked_date_is_scored(spark):
    later = INIT + pd.Timedelta(days=1)
    rows = members(52) + [(later, 10, later, m, 0.5) for m in range(1, 53)]
    tables = flat_tables(spark, rows)
    model, thresholds = state(tables)
    assert alerts.warnings_wide(tables, model, INIT, thresholds).first().wd01 == "R100"
    assert alerts.warnings_wide(tables, model, later, thresholds).first().wd01 == "R0"


def test_thresholds_rise_and_match_the_formula(spark):
    df = spark.createDataFrame([("A", y, float(v)) for y, v in enumerate((3, 9, 4, 7))], "hydroweb string, year int, max_value double")
    row = extremes.return_periods(df).first()
    peaks = np.array([3.0, 9, 4, 7])
    for rp in RETURN_PERIODS:
        want = -np.log(-np.log(1 - 1 / rp)) * peaks.std() * 0.7797 + peaks.mean() - 0.45 * peaks.std()
        assert row[f"return_period_{rp}"] == pytest.approx(want, rel=1e-12)
    levels = [row[f"return_period_{rp}"] for rp in RETURN_PERIODS]
    assert levels == sorted(levels)


def test_bands(spark):
    thresholds = spark.createDataFrame([("A", 1.04, 2.0, 3.0, 4.0, 5.0, 6.26)], "hydroweb string, " + ", ".join(f"return_period_{rp} double" for rp in RETURN_PERIODS))
    stats = spark.createDataFrame([("A", INIT.to_pydatetime(), 1.5, 1.2, 0.9)], "hydroweb string, initialized timestamp_ntz, flow_max double, flow_avg double, high_res double")
    got = extremes.return_period_bands(thresholds, stats).orderBy("rp").collect()
    assert [(r.lower, r.upper) for r in got] == [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, 5.0), (5.0, 6.3), (6.3, 8.0)]
    assert all(r.visible for r in got)


def test_map_layers(spark):
    tables = flat_tables(spark, members(52, days=2), stations=(("A", 10), ("C", 12)))
    model, thresholds = state(tables)
    warning = alerts.warnings_wide(tables, model, INIT, thresholds)
    joined = alerts.water_level_alerts(tables.station, warning, "2002-01-28")
    assert joined.count() == 2 and alerts.water_level_alerts(tables.station, warning, "2002-01-29").count() == 0
    layer = alerts.alerts_for_day(joined, 2)
    assert {(r.hydroweb, r.alert) for r in layer.collect()} == {("A", "R100"), ("C", "R0")}
    assert [r.hydroweb for r in alerts.alerts_by_class(layer, "R0").collect()] == ["C"]
    assert [r.hydroweb for r in alerts.alerts_active(layer).collect()] == ["A"]
    assert alerts.alerts_for_day(joined, 15).where(F.col("alert").isNotNull()).count() == 0
    assert alerts.alerts_by_day(joined).count() == 30
    with pytest.raises(ValueError):
        alerts.alerts_for_day(joined, 16)


def test_geojson(spark):
    import json

    tables = flat_tables(spark, members(52, days=2), stations=tuple((f"S{i}", 10) for i in range(7)))
    model, thresholds = state(tables)
    joined = alerts.water_level_alerts(tables.station, alerts.warnings_wide(tables, model, INIT, thresholds), INIT)
    rows = alerts.features(joined)
    feature = json.loads(rows.first().feature)
    assert feature["type"] == "Feature" and feature["geometry"] == {"type": "Point", "coordinates": [-2.5, 1.5]}
    assert feature["properties"]["wd01"] == "R100" and feature["properties"]["wd14"] is None


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_one_collection_of_any_size(spark, tmp_path, n):
    """Features as they come, some twice, over many partitions: one valid document."""
    import json

    rows = spark.range(n).selectExpr("concat('S', id) AS hydroweb", "concat('{\"id\":', id, '}') AS feature").repartition(7)
    rows = rows.unionByName(rows.where("hydroweb = 'S0'"))
    path, target = str(tmp_path / "parts"), str(tmp_path / "layer.json")
    writers.write_collection(alerts.collection_lines(rows), path)
    writers.join_parts(spark, path, target)
    with open(target) as opened:
        layer = json.load(opened)
    assert layer["type"] == "FeatureCollection" and len(layer["features"]) == n + (n > 0)
    assert {f["id"] for f in layer["features"]} == set(range(n))


def test_a_million_features_are_one_collection(spark, tmp_path):
    import json

    rows = spark.range(1_000_000).selectExpr("CAST(id AS STRING) AS hydroweb", "concat('{\"id\":', id, '}') AS feature")
    path, target = str(tmp_path / "parts"), str(tmp_path / "layer.json")
    writers.write_collection(alerts.collection_lines(rows), path)
    writers.join_parts(spark, path, target)
    with open(target) as opened:
        layer = json.load(opened)
    assert len(layer["features"]) == 1_000_000 and sum(f["id"] for f in layer["features"]) == 999_999 * 500_000


def test_repeated_rows_leave_the_statistics_alone(spark):
    rng = np.random.default_rng(5)
    tables = flat_tables(spark, [(INIT + pd.Timedelta(hours=6 * k), 10, INIT, m, float(v)) for k in range(3) for m, v in enumerate(rng.random(52) * 40, 1)])
    model, thresholds = state(tables)
    twice = type(tables)(tables.station, tables.observed, tables.simulation, tables.ensemble.unionByName(tables.ensemble), tables.records)
    results = []
    for t in (tables, twice):
        results.append([
            sorted(map(str, ensemble.ensemble_stats(bias.corrected_forecast(t, model)).collect())),
            sorted(map(str, ensemble.complete_rows(t.ensemble).collect())),
            sorted(map(str, ensemble.probability_table(t, model, thresholds).collect())),
            sorted(map(str, ensemble.exceedance_daily(t, model, thresholds).collect())),
        ])
    assert results[0] == results[1] and results[0][0] and results[0][1] and "None" not in results[0][0][0]


def test_wide_form_takes_one_shuffle(spark):
    wide = ensemble.ensemble_wide(flat_tables(spark, [(INIT, 10, INIT, 1, 1.0)]).ensemble)
    assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_packed_moments_hold_every_row(spark):
    later = INIT + 3 * HOUR
    rows = [
        (INIT, 10, INIT, 1, 1.0), (INIT, 10, INIT, 1, 3.0), (INIT, 10, INIT, 7, None), (INIT, 10, INIT, 52, 5.0),
        (INIT, 10, INIT, 53, 6.0), (INIT, 10, INIT, None, 7.0), (later, 10, INIT, 0, None), (later, None, INIT, 2, 8.0),
    ]
    moments = ensemble.packed(flat_tables(spark, rows).ensemble)
    got = {(r.datetime, r.reachid, r.member, r.value) for r in ensemble.unpacked(moments).collect()}
    assert got == {(t.to_pydatetime(), r, m, v) for t, r, _, m, v in rows if (m, v) != (1, 1.0)}
    assert [tuple(r) for r in ensemble.packed_records(moments).collect()] == [(INIT.to_pydatetime(), 10, 3.0)]


def test_a_member_counts_once_however_many_rows_it_has(spark):
    rows = [(1, 1, 0), (1, 1, 3), (1, 1, 3), (1, 52, 1), (1, None, 6), (1, None, 6), (1, 99, 2), (1, 5, None), (2, None, None)]
    got = ensemble.exceedance_counts(spark.createDataFrame(rows, "k int, member int, level int"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 4, 3, 2, 1, 1, 1), (2, 0, 0, 0, 0, 0, 0)]


def test_daily_maxima_meet_days_not_members(spark):
    moment = dt.datetime(2002, 1, 28)
    rows = [("a", moment, moment + dt.timedelta(days=d), m, v) for d, m, v in [(0, 1, 2.0), (0, 1, 3.0), (2, 1, None), (3, 52, 4.0), (1, 99, 5.0)]]
    daily = ensemble.daily_maximum(spark.createDataFrame(rows, "hydroweb string, initialized timestamp_ntz, datetime timestamp_ntz, member int, corrected double"))
    assert "member" not in daily._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [hydroweb")[1].split("]")[0]
    got = {(r.day.day, r.member): r.max_value for r in daily.collect()}
    value = {(28, 1): 3.0, (31, 52): 4.0, (29, 99): 5.0}
    assert got == {(d, m): value.get((d, m)) for d in (28, 29, 30, 31) for m in (1, 52, 99)}


@pytest.mark.parametrize("broadcast", [lookup.BROADCAST_BYTES, 0])
def test_forecast_statistics_correct_the_places_they_read(spark, monkeypatch, broadcast):
    """As of all corrected members, for stations whose correction keeps the order of values and one whose doesn't."""
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(8)
    days = [dt.datetime(y, 1, d) for y in (2000, 2001, 2002) for d in range(1, 29)]
    # Classes are 8, so 8 to 16 has steps of 1 and the lowest value lies on an edge; observations of A start above the first class.
    simulated = [(t, r, v) for r in (10, 20) for t, v in zip(days, [8.0, 16.0, *rng.uniform(8, 16, 82).tolist()])]
    observed = [(t, h, v) for h, base in (("A", 104.0), ("B", 100.0), ("C", 100.0)) for t, v in zip(days, [base, base + 8, *rng.uniform(base, base + 8, 82).tolist()])]
    rows = [(INIT + 3 * i * HOUR, r, INIT, m, float(v)) for r in (10, 20) for i in range(4) for m, v in enumerate(rng.uniform(-2, 25, 52).round(2), 1)]
    rows = [(t, r, s, m, 8.0 if m % 5 == 0 else v) for t, r, s, m, v in rows if (m, t) != (9, INIT)]
    rows += [(INIT + 3 * HOUR, 10, INIT, 4, 8.0), (INIT + 3 * HOUR, 10, INIT, 4, 8.5), (INIT + 6 * HOUR, 20, INIT, 52, None)]
    tables = make_tables(spark, [("A", 10), ("B", 10), ("C", 20)], [*observed, (dt.datetime(2001, 2, 1), "A", 100.0)], simulated, rows)
    model = bias.fit(tables)
    runs = bias.forecast_runs(bias.forecast_rows(tables.ensemble))
    flags = {r.hydroweb: r.ordered for r in bias.with_order(bias.run_mapping(runs, model)).collect()}
    assert flags == {"A": False, "B": True, "C": True}
    got = ensemble.forecast_stats(tables, model)
    want = ensemble.ensemble_stats(bias.corrected_forecast(tables, model))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 12
    shuffled = got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [hydroweb")[1].split("\n")[0]
    assert "ensemble_" not in shuffled and "AS _25" in shuffled


def test_a_station_of_two_reaches_has_no_order(spark):
    rows = [(INIT, r, INIT, m, float(m + r)) for r in (10, 20) for m in range(1, 53)]
    tables = flat_tables(spark, rows, stations=(("A", 10), ("A", 20), ("B", 20)))
    model = bias.fit(tables)
    got, want = ensemble.forecast_stats(tables, model), ensemble.ensemble_stats(bias.corrected_forecast(tables, model))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 2


def test_windows_are_made_of_moments_before_their_members(spark):
    tables = flat_tables(spark, members(52, days=3))
    model, thresholds = state(tables)
    plan = ensemble.probability_table(tables, model, thresholds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("explode(array_distinct") < plan.index("Join Inner")  # the top comes first


def test_a_packed_row_has_few_slots(spark):
    """Each row that is packed is compared with the slots of its strip only; together they hold all members, in order."""
    moments = [(INIT.to_pydatetime(), r, m, None if m == 20 else float(100 * r + m)) for r in (10, 12) for m in [*range(52, 0, -1), 7, 33, 60] if m != 30]
    given = spark.createDataFrame([(t, r, t, m, v) for t, r, m, v in moments], ENSEMBLE)
    rows = ensemble.packed(given)
    assert sum(c.startswith(("ensemble_", "slot_")) for c in rows.columns) == 13 and rows.where("usual").count() == 2 * 4
    got = [(r.reachid, r.member, r.value) for r in ensemble.unpacked(rows.coalesce(1).sortWithinPartitions("reachid", "datetime", "strip")).collect()]
    for reach in (10, 12):
        own = [(m, v) for r, m, v in got if r == reach and m <= 52]
        assert own == [(m, None if m == 20 else 100.0 * reach + m) for m in range(1, 53) if m != 30]
    assert sorted(((r, v) for r, m, v in got if m == 60)) == [(10, 1060.0), (12, 1260.0)]
