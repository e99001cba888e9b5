import numpy as np
import pytest
from helpers import make, n, values

from fluxcube.meta import CubeError
from fluxcube.operators.gaps import gaps
from fluxcube.operators.select import Not
from fluxcube.plans import compose
from fluxcube.plans.definitions import PriorityDefinition, StrategyDefinition, StrategyUnableToProcess, matches
from fluxcube.plans.strategies import EPOCH, FitParameters, Gap, GlobalLSStrategy, LocalTrendsStrategy, SubstitutionStrategy, fill_gap, get_gaps, scaling_factor

YEARS = np.array([(np.datetime64(f"{y}-01-01") - np.datetime64(EPOCH)).astype(int) for y in range(1952, 2026)], float)
nan = np.nan


def series():
    out = np.full(74, nan)
    out[4:15] = np.linspace(6, 12, 11)
    out[21:25] = np.linspace(15, 4, 4)
    out[39:49] = np.linspace(5, 3, 10)
    out[49:54] = np.linspace(3, 4, 5)
    return out


def test_gaps_of_a_series():
    found = get_gaps(series())
    assert [(g.type, 1952 + g.first, 1952 + g.last) for g in found] == [("start", 1952, 1955), ("end", 2006, 2025), ("gap", 1967, 1972), ("gap", 1977, 1990)]
    with pytest.raises(StrategyUnableToProcess):
        get_gaps(np.full(3, nan))


def test_factors_and_filling():
    ts = np.array([1.0] * 5 + [nan] * 3 + [3.0] * 5)
    other = np.full(13, 2.0)
    days = YEARS[:13]
    factor = scaling_factor(days, ts, other, Gap("gap", 5, 7), FitParameters())
    assert factor == pytest.approx((0.5, 1.5))
    filled = fill_gap(days, ts, other, Gap("gap", 5, 7), factor)
    assert filled[[5, 7]] == pytest.approx([1, 3]) and filled[6] == pytest.approx(2, abs=1e-2)
    single = fill_gap(days, np.array([1.0, nan, 3.0]), np.full(3, 2.0), Gap("gap", 1, 1), (0.5, 1.5))
    assert single[1] == 2
    assert scaling_factor(days, np.where(np.isnan(ts), nan, 0.0), other * 0, Gap("gap", 5, 7), FitParameters()) == (0.0, 0.0)


def test_a_start_gap_takes_the_right_trend():
    line = np.linspace(1, 2, 74)
    out, steps = LocalTrendsStrategy().fill(YEARS, np.where(np.arange(74) < 4, nan, line), 2 * line, "B")
    assert out == pytest.approx(line, rel=1e-3) and steps[0]["time"] == ["1952-01-01", "1953-01-01", "1954-01-01", "1955-01-01"] and "0.50" in steps[0]["description"]


def test_trend_needs_points():
    few = np.array([nan, nan, 4.0, 4.0, nan, nan])
    out, _ = LocalTrendsStrategy().fill(YEARS[:6], few, np.full(6, 2.0), "B")
    assert out == pytest.approx(np.full(6, 4.0))
    with pytest.raises(StrategyUnableToProcess):
        LocalTrendsStrategy().fill(YEARS[:6], few, np.array([-2.0] * 6), "B")


def test_global_least_squares():
    ts = np.ones(10)
    ts[0] = nan
    out, steps = GlobalLSStrategy(allow_shift=False).fill(YEARS[:10], ts, np.full(10, 2.0), "B")
    assert out[0] == pytest.approx(1) and "0.500" in steps[0]["description"]
    ts, other = np.ones(20), np.full(20, 2.0)
    ts[0], ts[1:5], other[0:5] = nan, 0.5, 1.5
    out, steps = GlobalLSStrategy().fill(YEARS[:20], ts, other, "B")
    assert out[0] == pytest.approx(0.5) and "1.000" in steps[0]["description"] and "-1.000" in steps[0]["description"]
    other[0] = 0.5
    with pytest.raises(StrategyUnableToProcess):
        GlobalLSStrategy().fill(YEARS[:20], ts, other, "B")
    assert GlobalLSStrategy(allow_negative=True).fill(YEARS[:20], ts, other, "B")[0][0] == pytest.approx(-0.5, abs=0.01)
    with pytest.raises(StrategyUnableToProcess):
        GlobalLSStrategy().fill(YEARS[:2], np.array([1, nan]), np.array([nan, 1]), "B")


def test_selectors():
    assert matches({"area": ["A", "B"], "entity": "CO2"}, {"area": "A", "entity": "CO2"})
    assert not matches({"area": Not("A")}, {"area": "A"}) and not matches({"nope": 1}, {"area": "A"})


def two_sources(spark):
    rows = [("COL", "A", 2000, "CO2", 1.0), ("COL", "A", 2001, "CO2", n), ("COL", "B", 2000, "CO2", 2.0), ("COL", "B", 2001, "CO2", 2.0), ("COL", "B", 2002, "CO2", 2.0)]
    rows += [("ARG", "B", 2001, "CO2", 7.0), ("COL", "A", 2000, "CH4", 5.0), ("COL", "C", 2001, "CO2", 9.0)]
    return make(spark, rows)


PRIO = PriorityDefinition(["source"], [{"source": "A"}, {"source": "B"}])


def test_substitution_two_ways(spark):
    cube = two_sources(spark)
    fast = values(compose.compose_substitution(cube, PRIO), "area", "time", "variable")
    slow = compose.compose(cube, PRIO, StrategyDefinition([({}, SubstitutionStrategy())]))
    assert fast == values(slow, "area", "time", "variable") == {("COL", 2000, "CO2"): 1, ("COL", 2001, "CO2"): 2, ("COL", 2002, "CO2"): 2, ("ARG", 2001, "CO2"): 7, ("COL", 2000, "CH4"): 5}
    steps = {(r["area"], r["variable"]): r["steps"] for r in slow.processing.collect()}
    assert [s["source"] for s in steps[("COL", "CO2")]] == ["'A'", "'B'"] and steps[("COL", "CO2")][1]["time"] == ["2001-01-01", "2002-01-01"]
    assert compose.processing_info(slow).count() == 4


def test_exclusions_and_strategies(spark):
    cube = two_sources(spark)
    prio = PriorityDefinition(["source"], PRIO.priorities, exclude_input=[{"source": "A", "entity": "CO2"}], exclude_result=[{"area": "ARG"}])
    plan = StrategyDefinition([({"source": "A"}, GlobalLSStrategy()), ({}, SubstitutionStrategy())])
    done = compose.compose(cube, prio, plan)
    assert values(done, "area", "time", "variable") == {("COL", 2000, "CO2"): 2, ("COL", 2001, "CO2"): 2, ("COL", 2002, "CO2"): 2, ("COL", 2000, "CH4"): 5}
    steps = {(r["area"], r["variable"]): r["steps"] for r in done.processing.collect()}
    assert steps[("ARG", "CO2")] is None
    assert "excluded" in steps[("COL", "CO2")][0]["description"] and "unable" in steps[("COL", "CH4")][0]["description"]
    with pytest.raises(CubeError):
        PriorityDefinition(["source"], [{"area": "COL"}]).check()
    with pytest.raises(CubeError):
        PriorityDefinition(["source"], [{"source": ["A", "B"]}]).check()


def test_own_strategy_and_wrapper(spark):
    class Constant:
        type = "constant"

        def fill(self, days, series, other, label):
            return np.where(np.isnan(series), 42.0, series), [{"time": ["all"], "function": "constant", "description": "", "source": label}]

    done = compose.create_composite_source(
        two_sources(spark), PRIO, StrategyDefinition([({}, Constant())]), result_prio_coords={"source": {"value": "mix", "terminology": "T"}}, limit_coords={"variable": "CO2", "area": "COL"}, time_range=("2000", "2001"), metadata={"title": "x"}
    )
    assert values(done, "source", "time") == {("mix", 2000): 42, ("mix", 2001): 42} and done.meta.title == "x" and done.meta.long_names["source"] == "source (T)"
    with pytest.raises(NotImplementedError):
        done.require_no_processing_info()
    assert not done.remove_processing_info().has_processing_info()


def test_wrapper_keeps_steps_of_substitution(spark):
    plan, as_mix = StrategyDefinition([({}, SubstitutionStrategy())]), {"source": {"value": "mix"}}
    rows = [("COL", "A", 2000, "CO2", 1.0), ("COL", "B", 2000, "CO2", 2.0), ("COL", "B", 2001, "CO2", 2.0), ("ARG", "A", 2000, "CO2", n), ("ARG", "B", 2001, "CO2", 7.0), ("BOL", "A", 2000, "CO2", 3.0), ("BOL", "B", 2000, "CO2", 4.0)]
    prio = PriorityDefinition(["source"], PRIO.priorities, exclude_input=[{"area (ISO3)": "BOL", "source": "A"}])
    done = compose.create_composite_source(make(spark, rows), prio, plan, result_prio_coords=as_mix)
    assert values(done, "area", "time") == {("COL", 2000): 1, ("COL", 2001): 2, ("ARG", 2001): 7, ("BOL", 2000): 4}
    info = {(r["area"], r["source"]): (r["time"], r["description"]) for r in compose.processing_info(done).collect()}
    assert info[("COL", "'B'")][0] == ["2001-01-01"] and info[("COL", "'A'")][0] == ["2000-01-01"]
    assert "fully NaN" in info[("ARG", "'A'")][1] and "excluded" in info[("BOL", "'A'")][1]
    with pytest.raises(Exception, match="No priority fits"):
        compose.create_composite_source(make(spark, [*rows, ("PER", "C", 2000, "CO2", 9.0)]), PRIO, plan, result_prio_coords=as_mix).df.collect()


def test_gap_rows(spark):
    cube = make(spark, [("A", "S", y, "CO2", v) for y, v in ((2000, n), (2001, 1.0), (2002, n), (2003, n), (2004, 1.0), (2005, n))])
    got = sorted((r["gap_type"], r["first"].year, r["last"].year, r["n_cells"]) for r in gaps(cube).collect())
    assert got == [("end", 2005, 2005, 1), ("gap", 2002, 2003, 2), ("start", 2000, 2000, 1)]
