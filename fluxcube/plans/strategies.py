"""Filling strategies on single series, in numpy: substitution, global least squares, local trends.

Times are days since 1970; missing cells are NaN. Fits are centred, as days are large numbers.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from fluxcube.plans.definitions import StrategyUnableToProcess

EPOCH = datetime.date(1970, 1, 1)


def iso(days: Iterable[float]) -> list[str]:
    return [(EPOCH + datetime.timedelta(int(d))).isoformat() for d in days]


def _step(days: np.ndarray, series: np.ndarray, filled: np.ndarray, kind: str, description: str, label: str) -> dict:
    """What was filled: `all` if the result owes nothing to the series itself."""
    time = ["all"] if filled.all() else iso(days[filled])
    return {"time": time, "function": kind, "description": description, "source": label}


@dataclass(frozen=True)
class SubstitutionStrategy:
    """Missing cells take the other series' values as they are."""

    type: str = "substitution"

    def fill(self, days: np.ndarray, series: np.ndarray, other: np.ndarray, label: str) -> tuple[np.ndarray, list[dict]]:
        filled = np.isnan(series) & ~np.isnan(other)
        return np.where(filled, other, series), [_step(days, series, filled, self.type, f"substituted with corresponding values from {label}", label)]


@dataclass(frozen=True)
class GlobalLSStrategy:
    """The other series, scaled (and shifted) to fit this one where both have data. Rank-deficient fits are of least norm."""

    allow_shift: bool = True
    allow_negative: bool = False
    type: str = "globalLS"

    def fill(self, days: np.ndarray, series: np.ndarray, other: np.ndarray, label: str) -> tuple[np.ndarray, list[dict]]:
        filled = np.isnan(series) & ~np.isnan(other)
        if not filled.any():
            return series, [{"time": [], "function": self.type, "description": "no missing values to fill", "source": label}]
        both = ~np.isnan(series) & ~np.isnan(other)
        if not both.any():
            raise StrategyUnableToProcess("no overlap between the series")
        x, y = other[both], series[both]
        if self.allow_shift:
            (a, b), *_ = np.linalg.lstsq(np.column_stack([x, np.ones_like(x)]), y, rcond=None)
            text = f"filled with values from {label}, scaled by {a:0.3f} and shifted by {b:0.3f} to match by least squares"
        else:
            a, b = (float(x @ y / (x @ x)) if (x != 0).any() else 0.0), 0.0
            text = f"filled with values from {label}, scaled by {a:0.3f} to match by least squares"
        fitted = a * other + b
        if self.allow_shift and not self.allow_negative and (fitted[~np.isnan(fitted)] < 0).any():
            raise StrategyUnableToProcess("harmonised values would be negative")
        return np.where(filled, fitted, series), [_step(days, series, filled, self.type, text, label)]


@dataclass(frozen=True)
class Gap:
    type: str  # start, end or gap
    first: int
    last: int


def get_gaps(series: np.ndarray) -> list[Gap]:
    """Runs of missing cells: at the start, at the end, then within."""
    missing = np.isnan(series)
    if missing.all():
        raise StrategyUnableToProcess("the series holds no data")
    edges = np.diff(np.concatenate(([0], missing.astype(np.int8), [0])))
    runs = list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))
    n = len(series)
    start = [Gap("start", a, b) for a, b in runs if a == 0]
    end = [Gap("end", a, b) for a, b in runs if b == n - 1]
    return [*start, *end, *[Gap("gap", a, b) for a, b in runs if a > 0 and b < n - 1]]


@dataclass(frozen=True)
class FitParameters:
    """A trend: a polynomial of `fit_degree` over `trend_length` steps beside a gap, if it has `min_trend_points` points; else
    one of `fallback_degree` with whatever there is."""

    fit_degree: int = 1
    fallback_degree: int = 0
    trend_length: int = 10
    trend_length_unit: str = "YS"
    min_trend_points: int = 5

    def fallback(self) -> FitParameters:
        return FitParameters(self.fallback_degree, self.fallback_degree, self.trend_length, self.trend_length_unit, 1)

    def window(self, day: float, forward: bool) -> tuple[float, float]:
        """Days from `day` on (or up to it) that belong to the trend; a calendar window, not a number of rows."""
        d = EPOCH + datetime.timedelta(int(day))
        steps = (self.trend_length - 1) * (1 if forward else -1)
        if self.trend_length_unit in ("YS", "YE", "Y"):
            other = d.replace(year=d.year + steps) if (d.month, d.day) != (2, 29) else d.replace(year=d.year + steps, day=28)
        elif self.trend_length_unit in ("MS", "ME", "M"):
            m = d.year * 12 + d.month - 1 + steps
            other = d.replace(year=m // 12, month=m % 12 + 1, day=min(d.day, 28))
        else:
            other = d + datetime.timedelta(steps)
        lo, hi = sorted((float(int(day)), float((other - EPOCH).days)))
        return lo, hi


def _trend(days: np.ndarray, series: np.ndarray, at: int, forward: bool, fit: FitParameters) -> float:
    """The trend's value at place `at`, the neighbour of a gap; NaN if there are too few points."""
    lo, hi = fit.window(days[at], forward)
    use = (days >= lo) & (days <= hi) & ~np.isnan(series)
    if use.sum() < max(1, fit.min_trend_points):
        return np.nan
    x, y = days[use] - days[at], series[use]
    scale = max(1.0, float(np.abs(x).max()))
    return float(np.polyfit(x / scale, y, min(fit.fit_degree, len(x) - 1))[-1])


def boundary_trend(days: np.ndarray, series: np.ndarray, gap: Gap, fit: FitParameters) -> tuple[float, float]:
    """Trend values beside a gap, left and right; a side that has none takes the other's."""

    def side(at: int, forward: bool) -> float:
        if not 0 <= at < len(series):
            return np.nan
        value = _trend(days, series, at, forward, fit)
        return _trend(days, series, at, forward, fit.fallback()) if np.isnan(value) else value

    left = side(gap.first - 1, False) if gap.type != "start" else np.nan
    right = side(gap.last + 1, True) if gap.type != "end" else np.nan
    return (right if np.isnan(left) else left), (left if np.isnan(right) else right)


def scaling_factor(days: np.ndarray, series: np.ndarray, other: np.ndarray, gap: Gap, fit: FitParameters) -> tuple[float, float]:
    """Trend of the series over trend of the other one, at both sides; 0 / 0 counts as 0."""
    ours, theirs = boundary_trend(days, series, gap, fit), boundary_trend(days, other, gap, fit)
    out = []
    for a, b in zip(ours, theirs):
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.float64(a) / np.float64(b)
        out.append(0.0 if a == 0 and not np.isfinite(x) else float(x))
    return out[0], out[1]


def fill_gap(days: np.ndarray, series: np.ndarray, other: np.ndarray, gap: Gap, factor: tuple[float, float]) -> np.ndarray:
    """The other series times the factor, which goes linearly from one side of the gap to the other; of one cell, the mean."""
    out = series.copy()
    at = slice(gap.first, gap.last + 1)
    t, left, right = days[at], days[gap.first], days[gap.last]
    weight = (t - left) / (right - left) if right > left else np.full(len(t), 0.5)
    scaled = other[at] * (factor[0] * (1 - weight) + factor[1] * weight)
    out[at] = np.where(np.isnan(series[at]), scaled, series[at])
    return out


@dataclass(frozen=True)
class LocalTrendsStrategy:
    """Each gap is filled by the other series, scaled so that local trends meet at the gap's sides."""

    fit_params: FitParameters = field(default_factory=FitParameters)
    allow_negative: bool = False
    type: str = "localTrends"

    def fill(self, days: np.ndarray, series: np.ndarray, other: np.ndarray, label: str) -> tuple[np.ndarray, list[dict]]:
        filled_any = np.isnan(series) & ~np.isnan(other)
        if not filled_any.any():
            return series, [{"time": [], "function": self.type, "description": "no missing values to fill", "source": label}]
        out, times, notes = series.copy(), np.zeros(len(series), bool), []
        for gap in get_gaps(series):
            at = slice(gap.first, gap.last + 1)
            if np.isnan(other[at]).all():
                continue
            factor = scaling_factor(days, series, other, gap, self.fit_params)
            if not self.allow_negative and any(f < 0 for f in factor):
                factor = scaling_factor(days, series, other, gap, self.fit_params.fallback())
            if not np.isfinite(factor).all() or not self.allow_negative and any(f < 0 for f in factor):
                continue  # no usable trend at this gap
            out = fill_gap(days, out, other, gap, factor)
            times[at] = ~np.isnan(other[at])
            span = iso([days[gap.first], days[gap.last]])
            shown = f"{factor[0]:0.2f}" if f"{factor[0]:0.2f}" == f"{factor[1]:0.2f}" else f"{factor[0]:0.2f} and {factor[1]:0.2f}"
            notes.append(f"{span[0]} to {span[1]}: factor {shown}")
        if not times.any():
            raise StrategyUnableToProcess("no gap could be filled")
        text = f"filled with local trend matched data from {label}; " + "; ".join(notes)
        return out, [_step(days, series, times, self.type, text, label)]
