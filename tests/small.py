"""Small hand-made tables and an independent NumPy/pandas calculation of the same results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from stagecast.schemas import ENSEMBLE, OBSERVED, RECORDS, SIMULATION, STATION
from stagecast.tables import Tables

INIT = pd.Timestamp("2002-01-28")


def station_frame(pairs):
    rows = [(h, r, "basin", "river", f"name-{h}", 1.5, -2.5, 10.0, "state", "country", "type") for h, r in pairs]
    return rows


def make_tables(spark, stations, observed, simulated, ensemble=(), records=()):
    """Rows: observed (time, station, level), simulated (time, reach, value), ..."""
    def moments(rows, *columns):
        return [tuple(pd.Timestamp(v).to_pydatetime() if i in columns else v for i, v in enumerate(r)) for r in rows]

    return Tables(
        spark.createDataFrame(station_frame(stations), STATION),
        spark.createDataFrame(moments(observed, 0), OBSERVED),
        spark.createDataFrame(moments(simulated, 0), SIMULATION),
        spark.createDataFrame(moments(ensemble, 0, 2), ENSEMBLE),
        spark.createDataFrame(moments(records, 0), RECORDS),
    )


class Dist:
    """Dense distribution of one month by NumPy."""

    def __init__(self, values):
        values = np.asarray(values, dtype=float)
        top, bottom = math.ceil(values.max()), math.floor(values.min())
        if top == bottom:
            top += 0.1
        self.classes = math.ceil(1 + 3.322 * math.log10(len(values)))
        self.step = (top - bottom) / self.classes
        self.edges = np.arange(-self.step, top + 2 * self.step, self.step)
        self.counts = np.histogram(values, self.edges)[0]
        self.right = self.edges[1:]
        self.cdf = np.cumsum(self.counts) / len(values)


def left_interp(x, y, at):
    """Linear interpolation whose segment is found with searchsorted on the left."""
    out = np.full(len(at), np.nan)
    for i, a in enumerate(at):
        hi = min(max(int(np.searchsorted(x, a)), 1), len(x) - 1)
        if x[hi] != x[hi - 1]:
            out[i] = (y[hi] - y[hi - 1]) / (x[hi] - x[hi - 1]) * (a - x[hi - 1]) + y[hi - 1]
    return out


def historical(values, sim, obs):
    s, o = Dist(sim), Dist(obs)
    return np.interp(np.interp(values, s.right, s.cdf), o.cdf, o.right)


def forecast(values, sim, obs):
    """Clip, map, scale."""
    values = np.asarray(values, dtype=float)
    s, o = Dist(sim), Dist(obs)
    low, high = min(sim), max(sim)
    clipped = np.clip(values, low, high)
    mapped = left_interp(o.cdf, o.right, left_interp(s.right, s.cdf, clipped))
    mapped = np.where(np.isnan(mapped), clipped, mapped)
    factor = np.where(values < low, values / low, 1.0) * np.where(values > high, values / high, 1.0)
    return mapped * factor


def prepared(levels):
    levels = np.asarray(levels, dtype=float)
    return np.maximum(levels - levels.min(), 0.1)
