"""The same results as plain SQL for an independent engine.

Every query is the chain of named steps it needs. The steps keep the distributions in long form
and find the bin of a probability by an ASOF join, so they share no method with the Spark side
beyond the definitions themselves.
"""

from __future__ import annotations

import re

_RP = (2, 5, 10, 25, 50, 100)
_DAYS = range(1, 15)
_INIT = "TIMESTAMP '2002-01-28 00:00:00'"


def _r(expr: str) -> str:
    """Six digits, as on the Spark side (see ``rounded``)."""
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.53::DOUBLE) / 1000000.0::DOUBLE"


def _half_up(expr: str, digits: int) -> str:
    """Decimal rounding of the printed number."""
    return f"CAST(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, {digits})) AS DOUBLE)"


def _gumbel(spread: str, mean: str, rp) -> str:
    return (
        f"CASE WHEN {spread} <= 0 OR {rp} <= 1 THEN 0.0 ELSE "
        f"-ln(-ln(1.0 - 1.0 / CAST(greatest({rp}, 2) AS DOUBLE))) * {spread} * 0.7797 + {mean} - 0.45 * {spread} END"
    )


def _layout(source: str, key: str) -> str:
    return f"""
      SELECT *, (top - floor(lo)) / ceil(1 + 3.322 * log10(n)) AS s FROM (
        SELECT {key}, month, count(*) AS n, min(v) AS lo, max(v) AS hi,
               CASE WHEN ceil(max(v)) = floor(min(v)) THEN ceil(max(v)) + CAST(0.1 AS DOUBLE) ELSE ceil(max(v)) END AS top
        FROM {source} GROUP BY {key}, month)"""


def _binned(source: str, layout: str, key: str) -> str:
    return f"""
      SELECT *, CAST(g - CASE WHEN v < -s + g * s THEN 1 ELSE 0 END
                       + CASE WHEN v >= -s + (g + 1) * s THEN 1 ELSE 0 END AS INTEGER) AS bin
      FROM (SELECT r.*, p.s, p.n, floor(r.v / p.s) + 1 AS g FROM {source} r JOIN {layout} p USING ({key}, month))"""


def _shares(binned: str, key: str) -> str:
    return f"""
      SELECT {key}, month, bin, s, CAST(c AS BIGINT) AS c,
             CAST(sum(c) OVER w AS DOUBLE) / n AS cdf, CAST(sum(c) OVER w - c AS DOUBLE) / n AS prev,
             -s + bin * s AS left_edge, -s + (bin + 1) * s AS right_edge
      FROM (SELECT {key}, month, bin, any_value(s) AS s, any_value(n) AS n, count(*) AS c
            FROM {binned} GROUP BY {key}, month, bin)
      WINDOW w AS (PARTITION BY {key}, month ORDER BY bin ROWS UNBOUNDED PRECEDING)"""


def _forecast_prob(source: str, value: str) -> str:
    """Right-closed probability of a forecast value."""
    return f"""
      SELECT f.*, CASE WHEN f.{value} IS NULL THEN NULL WHEN c.bin IS NULL THEN 1.0
                       WHEN f.{value} <= c.left_edge THEN c.prev
                       ELSE least(1.0, (c.cdf - c.prev) / (c.right_edge - c.left_edge) * (f.{value} - c.left_edge) + c.prev) END AS p
      FROM {source} f ASOF LEFT JOIN sim_c c
        ON f.reachid = c.reachid AND f.month = c.month AND f.{value} <= c.right_edge"""


def _forecast_flow(source: str, value: str) -> str:
    """Value of a probability; undefined ones keep the value they had."""
    return f"""
      SELECT f.*, coalesce(CASE WHEN f.p IS NULL THEN NULL WHEN f.p <= 0 AND o.bin > 1 THEN NULL
               ELSE (o.right_edge - o.left_edge) / (o.cdf - o.prev) * (f.p - o.prev) + o.left_edge END, f.{value}) AS mapped
      FROM {source} f ASOF LEFT JOIN obs_c o ON f.hydroweb = o.hydroweb AND f.month = o.month AND f.p <= o.cdf"""


def _records(first: str, days: int) -> str:
    return f"""
      SELECT r.reachid, TIMESTAMP '{first}' + d.d * INTERVAL 1 DAY AS datetime,
             CAST((r.reachid * 613 + d.d * 7919) % 100000 AS DOUBLE) / 1000 AS value
      FROM reaches r, range({days}) d(d)"""


def _corrected_records(rows: str) -> dict[str, str]:
    return {
        f"{rows}_f": f"""
          SELECT st.hydroweb, r.reachid, r.datetime, r.value, month(r.datetime) AS month,
                 least(greatest(r.value, p.lo), p.hi) AS clipped,
                 CASE WHEN r.value < p.lo THEN r.value / p.lo ELSE 1.0 END
                 * CASE WHEN r.value > p.hi THEN r.value / p.hi ELSE 1.0 END AS factor
          FROM {rows} r JOIN station st USING (reachid)
          JOIN sim_p p ON p.reachid = r.reachid AND p.month = month(r.datetime)
          JOIN obs_p o ON o.hydroweb = st.hydroweb AND o.month = month(r.datetime)""",
        f"{rows}_q": _forecast_prob(f"{rows}_f", "clipped"),
        f"{rows}_m": _forecast_flow(f"{rows}_q", "clipped"),
        f"{rows}_c": f"SELECT hydroweb, datetime, value, mapped * factor AS corrected FROM {rows}_m",
    }


def _metric_values(s: str, o: str, tag: str) -> str:
    return f"""avg({s} - {o}) AS {tag}me, avg(({s} - {o}) * ({s} - {o})) AS {tag}mse,
      avg(abs(({s} - {o}) / {o})) AS {tag}mape, avg({s}) AS {tag}ms, avg({o}) AS {tag}mo,
      stddev_samp({s}) AS {tag}ss, stddev_samp({o}) AS {tag}so, var_pop({o}) AS {tag}vo, corr({s}, {o}) AS {tag}r"""


def _metric(name: str, t: str) -> str:
    bias = f"pow({t}ms / {t}mo - 1, 2)"
    r = f"pow({t}r - 1, 2)"
    return {
        "ME": f"{t}me",
        "RMSE": f"sqrt({t}mse)",
        "NRMSE (Mean)": f"sqrt({t}mse) / {t}mo",
        "MAPE": f"100.0 * {t}mape",
        "NSE": f"1 - {t}mse / {t}vo",
        "KGE (2009)": f"1 - sqrt({r} + pow({t}ss / {t}so - 1, 2) + {bias})",
        "KGE (2012)": f"1 - sqrt({r} + pow(({t}ss / {t}ms) / ({t}so / {t}mo) - 1, 2) + {bias})",
        "R (Pearson)": f"{t}r",
        "R (Spearman)": "spearman",
        "r2": f"{t}r * {t}r",
    }[name]


_level = " + ".join(f"CASE WHEN f.corrected > t.return_period_{rp} THEN 1 ELSE 0 END" for rp in _RP)
_thresholds = ", ".join(f"{_gumbel('spread', 'mean', rp)} AS return_period_{rp}" for rp in _RP)

STEPS: dict[str, str] = {
    "station": """
      SELECT 'HW-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS hydroweb,
             CAST(s_suppkey - s_suppkey % 2 AS INTEGER) AS reachid, r_name AS basin,
             'River-' || CAST(s_suppkey % 17 AS VARCHAR) AS river, s_name AS name,
             CAST((s_suppkey * 3701) % 18000 - 9000 AS DOUBLE) / 100 AS latitude,
             CAST((s_suppkey * 10103) % 36000 - 18000 AS DOUBLE) / 100 AS longitude,
             s_acctbal AS elevation, 'State-' || CAST(s_nationkey AS VARCHAR) AS state,
             n_name AS country, 'fixture' AS type
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "obs": """
      SELECT l_shipdate AS datetime, 'HW-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS hydroweb,
             100 + max(l_quantity) AS waterlevel
      FROM lineitem GROUP BY l_shipdate, l_suppkey""",
    "sim": """
      SELECT l_shipdate AS datetime, CAST(l_suppkey - l_suppkey % 2 AS INTEGER) AS reachid,
             CAST(floor(max(l_extendedprice)) AS DOUBLE) / 1000 AS value
      FROM lineitem GROUP BY l_shipdate, l_suppkey - l_suppkey % 2""",
    "reaches": "SELECT DISTINCT CAST(s_suppkey - s_suppkey % 2 AS INTEGER) AS reachid FROM supplier",
    "ens": f"""
      SELECT r.reachid, {_INIT} AS initialized, CAST(m.member AS INTEGER) AS member,
             {_INIT} + (3 * s.step) * INTERVAL 1 HOUR AS datetime,
             CASE WHEN member = 52 AND step >= 80 THEN NULL
                  WHEN member = 7 AND step % 40 = 13 THEN NULL
                  ELSE CAST(((r.reachid * 7919 + step * 104729 + member * 15485863) % 100000)
                            * (60 + 10 * ((r.reachid + (step // 8)) % 17)) AS DOUBLE) / 100000 END AS value
      FROM reaches r, range(120) s(step), range(1, 53) m(member)""",
    "ens3": """
      SELECT e.reachid, e.initialized - d.d * INTERVAL 1 DAY AS initialized, e.member,
             e.datetime - d.d * INTERVAL 1 DAY AS datetime, e.value + d.d AS value
      FROM ens e, range(3) d(d)""",
    "rec": _records("2002-01-08", 21),
    "rec2": _records("2001-12-20", 40),
    # distributions
    "lev": """
      SELECT hydroweb, datetime, month(datetime) AS month,
             greatest(waterlevel - min(waterlevel) OVER (PARTITION BY hydroweb), 0.1) AS v FROM obs""",
    "raw": "SELECT hydroweb, datetime, month(datetime) AS month, greatest(waterlevel, 0.1) AS v FROM obs",
    "sv": "SELECT reachid, datetime, month(datetime) AS month, greatest(value, 0.1) AS v FROM sim",
    "sim_p": _layout("sv", "reachid"),
    "sim_b": _binned("sv", "sim_p", "reachid"),
    "sim_c": _shares("sim_b", "reachid"),
    "obs_p": _layout("lev", "hydroweb"),
    "obs_b": _binned("lev", "obs_p", "hydroweb"),
    "obs_c": _shares("obs_b", "hydroweb"),
    "raw_p": _layout("raw", "hydroweb"),
    "raw_b": _binned("raw", "raw_p", "hydroweb"),
    "raw_c": _shares("raw_b", "hydroweb"),
    # corrected history
    "complete": """
      SELECT st.hydroweb, st.reachid, count(*) = count(o.s) AS complete
      FROM station st JOIN sim_p p USING (reachid)
      LEFT JOIN obs_p o ON o.hydroweb = st.hydroweb AND o.month = p.month
      GROUP BY st.hydroweb, st.reachid""",
    "sim_q": """
      SELECT b.reachid, b.datetime, b.month, b.v,
             (c.cdf - c.prev) / (c.right_edge - c.left_edge) * (b.v - c.left_edge) + c.prev AS p
      FROM sim_b b JOIN sim_c c USING (reachid, month, bin)""",
    "sim_st": "SELECT k.hydroweb, q.* FROM sim_q q JOIN complete k USING (reachid) WHERE k.complete",
    "cor": """
      SELECT q.hydroweb, q.datetime, q.v AS value,
             CASE WHEN o.bin IS NULL THEN -p.s + (ceil((p.top + 2 * p.s + p.s) / p.s) - 1) * p.s
                  ELSE (o.right_edge - o.left_edge) / (o.cdf - o.prev) * (q.p - o.prev) + o.left_edge END AS corrected
      FROM sim_st q JOIN obs_p p ON p.hydroweb = q.hydroweb AND p.month = q.month
      ASOF LEFT JOIN obs_c o ON q.hydroweb = o.hydroweb AND q.month = o.month AND q.p < o.cdf""",
    "cor_raw": """
      SELECT q.hydroweb, q.datetime, q.v AS value,
             CASE WHEN o.bin IS NULL THEN -p.s + (ceil((p.top + 2 * p.s + p.s) / p.s) - 1) * p.s
                  ELSE (o.right_edge - o.left_edge) / (o.cdf - o.prev) * (q.p - o.prev) + o.left_edge END AS corrected
      FROM sim_st q JOIN raw_p p ON p.hydroweb = q.hydroweb AND p.month = q.month
      ASOF LEFT JOIN raw_c o ON q.hydroweb = o.hydroweb AND q.month = o.month AND q.p < o.cdf""",
    "maxima": "SELECT hydroweb, CAST(year(datetime) AS INTEGER) AS year, max(corrected) AS max_value FROM cor GROUP BY ALL",
    "stats_max": """
      SELECT hydroweb, avg(max_value) AS mean,
             CASE WHEN min(max_value) = max(max_value) THEN 0.0 ELSE stddev_pop(max_value) END AS spread
      FROM maxima GROUP BY hydroweb""",
    "thr": f"SELECT hydroweb, mean, spread, {_thresholds}, spread <= 0 AS degenerate FROM stats_max",
    # corrected forecast
    "runs": """
      SELECT reachid, initialized, min(datetime) AS first_time, max(datetime) AS last_time
      FROM ens GROUP BY reachid, initialized""",
    "fc": """
      SELECT st.hydroweb, e.reachid, e.initialized, e.datetime, e.member, e.value, r.first_time, p.month,
             CASE WHEN e.value IS NOT NULL THEN least(greatest(e.value, p.lo), p.hi) END AS clipped,
             CASE WHEN e.value < p.lo THEN e.value / p.lo WHEN e.value IS NOT NULL THEN 1.0 END AS min_factor,
             CASE WHEN e.value > p.hi THEN e.value / p.hi WHEN e.value IS NOT NULL THEN 1.0 END AS max_factor
      FROM ens e JOIN runs r USING (reachid, initialized) JOIN station st USING (reachid)
      JOIN sim_p p ON p.reachid = e.reachid AND p.month = month(r.first_time)
      JOIN obs_p o ON o.hydroweb = st.hydroweb AND o.month = p.month""",
    "fc_last": """
      SELECT st.hydroweb, e.reachid, e.initialized, e.datetime, e.member, e.value, p.month
      FROM ens e JOIN runs r USING (reachid, initialized) JOIN station st USING (reachid)
      JOIN sim_p p ON p.reachid = e.reachid AND p.month = month(r.last_time)
      JOIN obs_p o ON o.hydroweb = st.hydroweb AND o.month = p.month""",
    "fc_last_q": _forecast_prob("fc_last", "value"),
    "fc_last_m": _forecast_flow("fc_last_q", "value"),
    "fc_raw_q": _forecast_prob("fc", "value"),
    "fc_raw_m": _forecast_flow("fc_raw_q", "value"),
    "fc_q": _forecast_prob("fc", "clipped"),
    "fc_m": _forecast_flow("fc_q", "clipped"),
    "fcc": "SELECT *, mapped * min_factor * max_factor AS corrected FROM fc_m",
    **_corrected_records("rec"),
    **_corrected_records("rec2"),
    # ensemble
    "st_all": """
      SELECT hydroweb, initialized, datetime, count(corrected) FILTER (member <= 51) AS n,
             quantile_cont(corrected, 0.75) FILTER (member <= 51) AS q75,
             quantile_cont(corrected, 0.5) FILTER (member <= 51) AS q50,
             quantile_cont(corrected, 0.25) FILTER (member <= 51) AS q25,
             max(corrected) FILTER (member <= 51) AS q100, min(corrected) FILTER (member <= 51) AS q0,
             max(corrected) FILTER (member = 52) AS high_res
      FROM fcc GROUP BY hydroweb, initialized, datetime""",
    "st_rows": """
      SELECT hydroweb, initialized, datetime, CASE WHEN n = 51 THEN q100 END AS flow_max,
             CASE WHEN n = 51 THEN q75 END AS flow_75, CASE WHEN n = 51 THEN q50 END AS flow_avg,
             CASE WHEN n = 51 THEN q25 END AS flow_25, CASE WHEN n = 51 THEN q0 END AS flow_min, high_res, n
      FROM st_all WHERE n = 51 OR high_res IS NOT NULL""",
    "st_done": "SELECT s.* FROM st_rows s WHERE s.hydroweb IN (SELECT hydroweb FROM thr)",
    "span": 'SELECT hydroweb, initialized, min(datetime) AS start_t, max(datetime) AS end_t FROM st_done GROUP BY ALL',
    "recent": """
      SELECT s.hydroweb, s.initialized, r.datetime, r.corrected
      FROM span s JOIN rec_c r ON r.hydroweb = s.hydroweb
       AND r.datetime BETWEEN s.start_t - INTERVAL 8 DAY AND s.start_t""",
    "extent": """
      SELECT s.hydroweb, s.initialized, coalesce(min(r.datetime), s.start_t) AS a, s.end_t AS b
      FROM span s LEFT JOIN recent r ON r.hydroweb = s.hydroweb AND r.initialized = s.initialized
      GROUP BY s.hydroweb, s.initialized, s.start_t, s.end_t""",
    "dmax": """
      SELECT hydroweb, initialized, CAST(datetime AS DATE) AS day, member, max(corrected) AS max_value
      FROM fcc GROUP BY ALL""",
    "exc": "SELECT d.hydroweb, d.initialized, d.day, "
           "CAST(date_diff('day', CAST(any_value(r.f) AS DATE), d.day) + 1 AS INTEGER) AS day_no, "
           + ", ".join(
               f"CAST(count(*) FILTER (d.max_value > t.return_period_{rp}) AS DOUBLE) * 100 / 52 AS pct_{rp}" for rp in _RP
           )
           + """
      FROM dmax d JOIN thr t USING (hydroweb)
      JOIN (SELECT hydroweb, initialized, min(day) AS f FROM dmax GROUP BY ALL) r USING (hydroweb, initialized)
      GROUP BY d.hydroweb, d.initialized, d.day""",
    "alert": "SELECT hydroweb, initialized, day_no, day, CASE "
             + " ".join(f"WHEN pct_{rp} >= 40 THEN 'R{rp}'" for rp in reversed(_RP))
             + " ELSE 'R0' END AS alert FROM exc WHERE day_no <= 14",
    "wide": "SELECT hydroweb, initialized, "
            + ", ".join(f"max(alert) FILTER (day_no = {d}) AS wd{d:02d}" for d in _DAYS)
            + f" FROM alert WHERE initialized = {_INIT} GROUP BY ALL",
    "warn": f"SELECT st.hydroweb, {_INIT} AS datetime, "
            + ", ".join(f"CASE WHEN w.initialized IS NULL THEN 'R0' ELSE w.wd{d:02d} END AS wd{d:02d}" for d in _DAYS)
            + ", CAST(NULL AS VARCHAR) AS wd15 FROM station st LEFT JOIN wide w USING (hydroweb)",
    "wla": f"""
      SELECT st.hydroweb, st.reachid, st.basin, st.river, st.name, st.latitude, st.longitude, st.state, st.country,
             w.datetime, {', '.join(f'w.wd{d:02d}' for d in _DAYS)}
      FROM station st JOIN warn w USING (hydroweb) WHERE w.datetime = {_INIT}""",
    "wla_day": "".join(
        (" UNION ALL " if d > 1 else "")
        + "SELECT hydroweb, reachid, basin, river, name, latitude, longitude, state, country, datetime, "
        + f"{d} AS day_no, " + (f"wd{d:02d}" if d <= 14 else "CAST(NULL AS VARCHAR)") + " AS alert FROM wla"
        for d in range(1, 16)
    ),
    # probability table
    "whole": "SELECT hydroweb, initialized, datetime FROM st_rows WHERE n = 51",
    "win": """
      SELECT s.hydroweb, s.initialized, s.start_t, CAST(i.i AS INTEGER) AS "window"
      FROM span s, range(0, 10000) i(i)
      WHERE i.i < floor(date_diff('second', s.start_t, s.end_t) / 86400.0)""",
    "pt_max": """
      SELECT w.hydroweb, w.initialized, w.start_t, w."window", f.member, max(f.corrected) AS mx
      FROM win w LEFT JOIN (fcc f SEMI JOIN whole k ON k.hydroweb = f.hydroweb AND k.initialized = f.initialized AND k.datetime = f.datetime)
        ON f.hydroweb = w.hydroweb AND f.initialized = w.initialized AND f.member <= 51
       AND f.datetime BETWEEN w.start_t + w."window" * INTERVAL 1 DAY AND w.start_t + (w."window" + 1) * INTERVAL 1 DAY
      GROUP BY ALL""",
    # pairs and metrics
    "pairs": """
      SELECT c.hydroweb, c.datetime, l.v AS obs, c.value AS sim, c.corrected
      FROM cor c JOIN lev l ON l.hydroweb = c.hydroweb AND l.datetime = c.datetime""",
    "ranked": """
      SELECT hydroweb,
             rank() OVER (PARTITION BY hydroweb ORDER BY corrected) + (count(*) OVER (PARTITION BY hydroweb, corrected) - 1) / 2.0 AS rs,
             rank() OVER (PARTITION BY hydroweb ORDER BY obs) + (count(*) OVER (PARTITION BY hydroweb, obs) - 1) / 2.0 AS ro
      FROM pairs""",
    "mv": f"""
      SELECT a.*, b.*, r.spearman FROM
        (SELECT hydroweb, {_metric_values('corrected', 'obs', 'c_')} FROM pairs GROUP BY hydroweb) a
        JOIN (SELECT hydroweb AS hw, {_metric_values('sim', 'obs', 'o_')} FROM pairs GROUP BY hydroweb) b ON a.hydroweb = b.hw
        JOIN (SELECT hydroweb AS hr, corr(rs, ro) AS spearman FROM ranked GROUP BY hydroweb) r ON a.hydroweb = r.hr""",
    "bands": "SELECT hydroweb, initialized, CAST(rp AS INTEGER) AS rp, lower, upper, max_visible > r2 AS visible FROM (SELECT *, "
             "unnest([2, 5, 10, 25, 50, 100]) AS rp, unnest([r2, r5, r10, r25, r50, r100]) AS lower, "
             "unnest([r5, r10, r25, r50, r100, trunc(greatest(2 * r100 - r25, y_max))]) AS upper FROM "
             "(SELECT s.hydroweb, s.initialized, max(s.flow_max) AS y_max, "
             "greatest(max(s.flow_max), max(s.flow_avg), max(s.high_res)) AS max_visible, "
             + ", ".join(f"round(any_value(t.return_period_{rp}), 1) AS r{rp}" for rp in _RP)
             + " FROM st_done s JOIN thr t USING (hydroweb) GROUP BY s.hydroweb, s.initialized))",
}


def _pairs_avg(key: str, name: str) -> str:
    return f"""
      SELECT hydroweb, {name}, {_r('o.obs')} AS obs, {_r('s.sim')} AS sim
      FROM (SELECT hydroweb, {key} AS {name}, avg(v) AS obs FROM lev GROUP BY ALL) o
      FULL JOIN (SELECT hydroweb, {key} AS {name}, avg(corrected) AS sim FROM cor GROUP BY ALL) s USING (hydroweb, {name})"""


_STATS = ("flow_max", "flow_75", "flow_avg", "flow_25", "flow_min", "high_res")
_stat_cols = ", ".join(f"{_r(c)} AS {c}" for c in _STATS)
_skill = ("ME", "RMSE", "NRMSE (Mean)", "NSE", "KGE (2009)", "KGE (2012)", "R (Pearson)", "R (Spearman)", "r2")
_compared = ("ME", "RMSE", "NRMSE (Mean)", "MAPE", "NSE", "KGE (2009)", "KGE (2012)")
_raw_map = "hydroweb, initialized, datetime, member, {v} AS value, {m} AS mapped".format(v=_r("value"), m=_r("mapped"))

_feature = (
    """
      SELECT CAST(to_json(struct_pack(
        id := hydroweb, type := 'Feature',
        properties := struct_pack(hydroweb := hydroweb, reachid := reachid, basin := basin, river := river, name := name,
          latitude := latitude, longitude := longitude, state := state, country := country,
          datetime := strftime(datetime, '%Y-%m-%dT%H:%M:%S'), """
                      + ", ".join(f"wd{d:02d} := wd{d:02d}" for d in _DAYS)
                      + """),
        geometry := struct_pack(type := 'Point', coordinates := [longitude, latitude]),
        bbox := [longitude, latitude, longitude, latitude])) AS VARCHAR) AS feature, hydroweb FROM wla"""
)

FINAL: dict[str, str] = {
    "station_dim": "SELECT *, upper(replace(replace(name, '-', ' '), '_', ' ')) AS display_name FROM station",
    "observed_load": "SELECT datetime, hydroweb, waterlevel FROM obs",
    "partition_route": """
      SELECT CAST(year(datetime) - year(datetime) % 10 AS INTEGER) AS decade, hydroweb, datetime, waterlevel FROM obs""",
    "forecast_load": """
      SELECT reachid, initialized, datetime, count(*) AS n_rows, max(value) AS largest,
             CASE WHEN count(value) FILTER (member <= 51) = 51 THEN CAST(51 AS BIGINT) END AS n_members
      FROM ens3 GROUP BY reachid, initialized, datetime""",
    "stored_records": "SELECT datetime, reachid, value FROM ens3 WHERE member = 1 AND datetime = initialized",
    "ensemble_scan": "SELECT reachid, datetime, member, value FROM ens",
    "stream_forecast_ingest": "SELECT datetime, reachid, initialized, member, value FROM ens3",
    "simulation_load": "SELECT datetime, reachid, value FROM sim WHERE datetime >= TIMESTAMP '2000-01-01' AND reachid IN (SELECT reachid FROM station)",
    "ensemble_wide": "SELECT datetime, reachid, initialized, "
                     + ", ".join(f"max(value) FILTER (member = {m}) AS ensemble_{m:02d}" for m in range(1, 53))
                     + " FROM ens GROUP BY datetime, reachid, initialized",
    "forecast_records": "SELECT datetime, reachid, value FROM ens WHERE member = 1 AND datetime = initialized",
    "altimetry_text": """
      SELECT 'R_' || upper(name) || '_exp' AS product, datetime, waterlevel FROM obs JOIN station USING (hydroweb)""",
    "observed_compile": "SELECT datetime, waterlevel, hydroweb, reachid FROM obs JOIN station USING (hydroweb)",
    "series_scan": "SELECT hydroweb, reachid, datetime, value FROM sim JOIN station USING (reachid)",
    "export_simulation": "SELECT datetime, value, reachid FROM sim",
    "export_observed": "SELECT datetime, waterlevel, hydroweb FROM obs",
    "export_corrected_sim": f"SELECT datetime, {_r('corrected')} AS corrected, hydroweb FROM cor_raw",
    "export_forecast_stats": f"SELECT initialized, datetime, {_stat_cols}, hydroweb FROM st_done",
    "clamp_floor": "SELECT reachid, datetime, v AS value FROM sv",
    "datum_shift": f"SELECT hydroweb, datetime, {_r('v')} AS level FROM lev",
    "monthly_extremes": """
      SELECT reachid, CAST(month AS INTEGER) AS month, min(v) AS min_value, max(v) AS max_value, count(*) AS n
      FROM sv GROUP BY ALL""",
    "monthly_histogram": f"SELECT reachid, CAST(month AS INTEGER) AS month, bin, {_r('s')} AS step, c AS \"rows\" FROM sim_c",
    "monthly_cdf": f"""
      SELECT hydroweb, CAST(month AS INTEGER) AS month, bin, {_r('right_edge')} AS right_edge, {_r('cdf')} AS cdf FROM obs_c""",
    "corrected_simulation": f"SELECT hydroweb, datetime, {_r('value')} AS value, {_r('corrected')} AS corrected FROM cor",
    "forecast_clip_factors": f"""
      SELECT hydroweb, initialized, datetime, member, {_r('value')} AS value, {_r('clipped')} AS clipped,
             {_r('min_factor')} AS min_factor, {_r('max_factor')} AS max_factor FROM fc""",
    "corrected_forecast_raw": f"SELECT {_raw_map} FROM fc_raw_m",
    "corrected_forecast_last_month": f"SELECT {_raw_map} FROM fc_last_m",
    "corrected_forecast": f"SELECT hydroweb, initialized, datetime, member, {_r('corrected')} AS corrected FROM fcc",
    "corrected_records": f"SELECT hydroweb, datetime, {_r('value')} AS value, {_r('corrected')} AS corrected FROM rec_c",
    "corrected_records_new_year": f"SELECT hydroweb, datetime, {_r('value')} AS value, {_r('corrected')} AS corrected FROM rec2_c",
    "annual_maxima": f"SELECT hydroweb, year, {_r('max_value')} AS max_value FROM maxima",
    "gumbel_quantile": f"""
      SELECT reachid, CAST(rp AS INTEGER) AS rp, {_r(_gumbel('spread', 'mean', 'rp'))} AS level FROM
        (SELECT reachid, stddev_pop(peak) AS spread, avg(peak) AS mean FROM
          (SELECT reachid, year(datetime) AS y, max(v) AS peak FROM sv GROUP BY ALL) GROUP BY reachid),
        (SELECT unnest([1, 2, 5, 10, 25, 50, 100]) AS rp)""",
    "return_periods": f"SELECT hydroweb, {_r('mean')} AS mean, {_r('spread')} AS spread, "
                      + ", ".join(f"{_r(f'return_period_{rp}')} AS return_period_{rp}" for rp in _RP)
                      + ", degenerate FROM thr",
    "return_period_bands": f"SELECT hydroweb, initialized, rp, {_r('lower')} AS lower, {_r('upper')} AS upper, visible FROM bands",
    "ensemble_complete_rows": """
      SELECT reachid, initialized, datetime, count(*) AS n_members FROM ens
      WHERE member <= 51 AND value IS NOT NULL GROUP BY ALL HAVING count(*) = 51""",
    "ensemble_stats": f"SELECT hydroweb, initialized, datetime, {_stat_cols} FROM st_rows",
    "ensemble_daily_max": f"SELECT hydroweb, initialized, day, member, {_r('max_value')} AS max_value FROM dmax",
    "exceedance_daily": "SELECT hydroweb, initialized, day_no, day, "
                        + ", ".join(f"{_r(f'pct_{rp}')} AS pct_{rp}" for rp in _RP) + " FROM exc",
    "alerts_long": "SELECT hydroweb, initialized, day_no, day, alert FROM alert",
    "warnings_wide": "SELECT * FROM warn",
    "warning_sink": "SELECT * FROM warn",
    "warning_status": f"""
      SELECT st.hydroweb, {_INIT} AS datetime,
             CASE WHEN k.complete IS NULL THEN 'no simulation' WHEN NOT k.complete THEN 'month without observation'
                  WHEN r.reachid IS NULL THEN 'no forecast'
                  WHEN NOT EXISTS (SELECT 1 FROM sim_p p WHERE p.reachid = st.reachid AND p.month = month(r.first_time))
                    THEN 'forecast month not simulated'
                  WHEN t.degenerate THEN 'degenerate' ELSE 'ok' END AS status
      FROM station st LEFT JOIN complete k USING (hydroweb) LEFT JOIN runs r ON r.reachid = st.reachid
      LEFT JOIN thr t ON t.hydroweb = st.hydroweb""",
    "probability_table": """
      SELECT m.hydroweb, m.initialized, m."window",
             CAST(CAST(m.start_t AS DATE) + m."window" AS DATE) AS day,
             strftime(CAST(m.start_t AS DATE) + m."window", '%b %d') AS label, """
                         + ", ".join(
                             f"CAST(round(count(*) FILTER (m.mx > t.return_period_{rp}) * 100.0 / 52) AS INTEGER) AS r{rp}"
                             for rp in _RP
                         )
                         + """ FROM pt_max m JOIN thr t USING (hydroweb)
      GROUP BY m.hydroweb, m.initialized, m."window", m.start_t""",
    "forecast_date_range": """
      SELECT reachid, initialized, CAST(d.d + 1 AS INTEGER) AS day_no,
             CAST(CAST(initialized AS DATE) + CAST(d.d AS INTEGER) AS DATE) AS date FROM runs, range(15) d(d)""",
    "water_level_alerts": "SELECT * FROM wla",
    "alerts_geojson": f"SELECT feature FROM ({_feature})",
    "alerts_collection": f"""
      SELECT '{{"type":"FeatureCollection","features":[' AS line
      UNION ALL SELECT CASE WHEN row_number() OVER (ORDER BY hydroweb) = 1 THEN '' ELSE ',' END || feature FROM ({_feature})
      UNION ALL SELECT ']}}'""",
    "alerts_for_day": "SELECT * EXCLUDE (day_no) FROM wla_day WHERE day_no = 1",
    "alerts_by_class": "SELECT * FROM wla_day WHERE alert = 'R100'",
    "alerts_active_classes": "SELECT * FROM wla_day WHERE alert IN ('R2', 'R5', 'R10', 'R25', 'R50', 'R100')",
    "daily_average": _pairs_avg("strftime(datetime, '%m/%d')", "day"),
    "monthly_average": _pairs_avg("CAST(month(datetime) AS INTEGER)", "month"),
    "climatology_band": f"""
      SELECT d.hydroweb, d.initialized, d.datetime, {_r('c.lo')} AS level_min, {_r('c.hi')} AS level_max
      FROM (SELECT hydroweb, initialized, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS datetime FROM extent) d
      LEFT JOIN (SELECT hydroweb, strftime(datetime, '%m-%d') AS md, min(v) AS lo, max(v) AS hi FROM lev GROUP BY ALL) c
        ON c.hydroweb = d.hydroweb AND c.md = strftime(d.datetime, '%m-%d')""",
    "sim_obs_pairs": f"SELECT hydroweb, datetime, {_r('obs')} AS obs, {_r('sim')} AS sim, {_r('corrected')} AS corrected FROM pairs",
    "skill_metrics": " UNION ALL ".join(
        f"SELECT hydroweb, '{m}' AS metric, {_r(_metric(m, 'c_'))} AS value FROM mv" for m in _skill
    ),
    "metrics_comparison": " UNION ALL ".join(
        f"SELECT hydroweb, '{m}' AS metric, {_r(_metric(m, 'o_'))} AS original, {_r(_metric(m, 'c_'))} AS corrected FROM mv"
        for m in _compared
    ),
    "historical_series": f"""
      SELECT hydroweb, 'simulation' AS series, datetime, {_half_up('corrected', 3)} AS value FROM cor
      UNION ALL SELECT hydroweb, 'observed', datetime, {_half_up('v', 3)} FROM lev""",
    "recent_records": f"SELECT hydroweb, initialized, datetime, {_r('corrected')} AS corrected FROM recent",
    "forecast_series": " UNION ALL ".join(
        f"SELECT hydroweb, initialized, '{c}' AS series, datetime, {_r(c)} AS value, CAST(NULL AS DOUBLE) AS upper "
        f"FROM st_done WHERE {c} IS NOT NULL" for c in _STATS
    ) + f"""
      UNION ALL SELECT hydroweb, initialized, 'records', datetime, {_r('corrected')}, NULL FROM recent
      UNION ALL SELECT b.hydroweb, b.initialized, 'return_period_' || CAST(b.rp AS VARCHAR), x.t, {_r('b.lower')}, {_r('b.upper')}
      FROM bands b JOIN (SELECT hydroweb, initialized, unnest([a, b]) AS t FROM extent) x USING (hydroweb, initialized)""",
    "reach_intersection": "SELECT DISTINCT reachid FROM sim WHERE reachid IN (SELECT reachid FROM station)",
    "stream_ingest": "SELECT * FROM readings",
    "stream_dedup": "SELECT DISTINCT * FROM readings",
    "stream_daily_max": """
      SELECT hydroweb, CAST(datetime AS DATE) AS day, max(waterlevel) AS max_level FROM readings
      GROUP BY hydroweb, CAST(datetime AS DATE)""",
}
_first = "hydroweb = (SELECT min(hydroweb) FROM station)"
FINAL["station_charts"] = (
    f"SELECT hydroweb, series, datetime, value FROM ({FINAL['historical_series']}) WHERE {_first} UNION ALL "
    + " UNION ALL ".join(
        f"SELECT hydroweb, '{c}', datetime, {_r(c)} FROM st_done WHERE {c} IS NOT NULL AND {_first}" for c in _STATS
    )
)
STEPS["readings"] = """
      SELECT 'HW-' || lpad(CAST(user_id % 10 AS VARCHAR), 6, '0') AS hydroweb, ts AS datetime, value AS waterlevel FROM events"""


def _needs(sql: str) -> list[str]:
    return [name for name in STEPS if re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b(?!\s*\.)", sql)]


def _chain(sql: str, done: dict[str, str]) -> None:
    for name in _needs(sql):
        if name not in done:
            _chain(STEPS[name], done)
            done[name] = STEPS[name]


def compose(final: str) -> str:
    """A query with the steps it needs in front, in order of use."""
    done: dict[str, str] = {}
    _chain(final, done)
    steps = ",\n    ".join(f"{name} AS ({body})" for name, body in done.items())
    return f"WITH {steps}\n{final}" if steps else final


def registry() -> dict[str, str]:
    return {name: compose(sql) for name, sql in FINAL.items()}
