import pytest
from helpers import make, n, values

from fluxcube.meta import CubeError
from fluxcube.operators import downscale, gwp
from fluxcube.operators.convert import Conversion, ConversionRule, category_name, convert, parse_formula, read_conversion

GASES = ["CO2", "SF6", "CH4"]
AR4 = "KYOTOGHG (AR4GWP100)"


def gases(spark, ch4_col=1.0):
    rows = [(a, "S", y, g, ch4_col if (g, a) == ("CH4", "COL") else 1.0) for a in ("COL", "ARG") for y in (2000, 2012) for g in GASES]
    return make(spark, rows)


def test_gas_baskets(spark):
    full = values(gwp.gas_basket_contents_sum(gases(spark), AR4, GASES), "area", "time")
    assert set(full.values()) == {22826}
    part = gases(spark, n)
    assert values(gwp.gas_basket_contents_sum(part, AR4, GASES), "area", "time")[("COL", 2000)] == 22801
    assert values(gwp.gas_basket_contents_sum(part, AR4, GASES, skipna=False), "area", "time")[("COL", 2000)] is None
    assert values(gwp.gas_basket_contents_sum(part, "KYOTOGHG (AR6GWP100)", GASES), "area", "time")[("ARG", 2000)] == pytest.approx(1 + 25200 + 27.9)
    missing = part.with_df(part.df.where("not (area = 'ARG' and variable = 'CH4' and year(time) = 2012)"))
    got = values(gwp.gas_basket_contents_sum(missing, AR4, GASES, skipna_evaluation_dims="time"), "area", "time")
    assert got[("COL", 2000)] == 22801 and got[("ARG", 2012)] is None and got[("ARG", 2000)] == 22826
    with pytest.raises(KeyError):
        gwp.gas_basket_contents_sum(part, AR4, ["XX"])


def test_conversions_rename(spark):
    there = gwp.convert_to_gwp(gases(spark), "SF6", "SARGWP100")
    assert values(there.variable("SF6 (SARGWP100)"), "area")["COL"] == 23900
    assert gwp.gwp_context(there, "SF6 (SARGWP100)") == "SARGWP100"
    back = gwp.convert_to_mass(there, "SF6 (SARGWP100)")
    assert values(back.variable("SF6"), "area")["COL"] == pytest.approx(1)
    with pytest.raises(CubeError):
        gwp.convert_to_gwp(there, "SF6 (SARGWP100)", "AR4GWP100")
    with pytest.raises(CubeError):
        gwp.convert_to_mass(gases(spark), "SF6")
    like = gwp.convert_to_gwp_like(gases(spark), "CH4", there.meta.variables["SF6 (SARGWP100)"])
    assert values(like.variable("CH4 (SARGWP100)"), "area")["COL"] == 21
    bare, units = gwp.dequantify(there)
    assert gwp.quantify(bare, units).meta == there.meta


def test_baskets_are_added_and_checked(spark):
    cube = gases(spark)
    out = gwp.add_aggregates_variables(cube, [gwp.Basket("FGASES (AR4GWP100)", ["SF6"]), gwp.Basket(AR4, ["CO2", "CH4", "FGASES (AR4GWP100)"])])
    assert set(values(out.variable(AR4), "area", "time").values()) == {22826}
    wrong = out.with_df(out.df.selectExpr("area", "source", "time", "variable", f"if(variable = '{AR4}', 1.0, value) as value"))
    with pytest.raises(ValueError, match="differ"):
        gwp.add_aggregates_variables(wrong, [gwp.Basket(AR4, ["CO2", "CH4", "FGASES (AR4GWP100)"])])


def totals(spark, bol=3.0, scale=1.0):
    """A total for every year; its parts are known in 2002 and 2012."""
    total = {**{y: 6.0 for y in range(2000, 2011)}, 2011: 8.0, 2012: 8.0, **{2013 + k: 8 + 2 * k / 7 for k in range(8)}}
    rows = [("CAMB", "S", y, "CO2", scale * v) for y, v in total.items()]
    rows += [(a, "S", 2002, "CO2", scale * (bol if a == "BOL" else 1.0)) for a in ("COL", "ARG", "MEX", "BOL")]
    rows += [(a, "S", 2012, "CO2", scale * 2.0) for a in ("COL", "ARG", "MEX", "BOL")]
    return make(spark, rows), total


PARTS = ["COL", "ARG", "MEX", "BOL"]


def test_downscaling(spark):
    cube, total = totals(spark)
    got = values(downscale.downscale_timeseries(cube, "area", "CAMB", PARTS), "area", "time")
    for y, t in total.items():
        k = min(max(y, 2002), 2012) - 2002
        assert got[("COL", y)] == pytest.approx(t * (1 / 6 + (2 / 8 - 1 / 6) * k / 10), abs=0.01)
        assert got[("BOL", y)] == pytest.approx(t * (3 / 6 + (2 / 8 - 3 / 6) * k / 10), abs=0.01)
        assert sum(got[(a, y)] for a in PARTS) == pytest.approx(t)


def test_downscaling_checks(spark):
    cube, _ = totals(spark, bol=2.0)
    with pytest.raises(downscale.DownscalingError, match="deviate"):
        downscale.downscale_timeseries(cube, "area", "CAMB", PARTS)
    got = values(downscale.downscale_timeseries(cube, "area", "CAMB", PARTS, check_consistency=False), "area", "time")
    assert got[("COL", 2000)] == pytest.approx(1.2) and got[("BOL", 2000)] == pytest.approx(2.4)
    with pytest.raises(CubeError):
        downscale.downscale_timeseries(cube, "area", "CAMB", PARTS, skipna_evaluation_dims="time")
    zeros, _ = totals(spark, scale=0.0)
    assert set(values(downscale.downscale_timeseries(zeros, "area", "CAMB", PARTS), "area", "time").values()) == {0.0}
    lost = make(spark, [("CAMB", "S", 2000, "CO2", 5.0), ("COL", "S", 2000, "CO2", 0.0), ("CAMB", "S", 2001, "CO2", 5.0), ("COL", "S", 2001, "CO2", 5.0)])
    with pytest.raises(downscale.DownscalingError, match="zero basket content"):
        downscale.downscale_timeseries(lost, "area", "CAMB", ["COL"], check_consistency=False)


def test_downscaling_with_zeros_in_between(spark):
    rows = [("CAMB", "S", y, "CO2", v) for y, v in ((2000, 4.0), (2001, 0.0), (2002, 4.0))]
    rows += [(a, "S", y, "CO2", v) for a, vs in (("COL", (1.0, 0.0)), ("ARG", (3.0, 0.0))) for y, v in zip((2000, 2001), vs)]
    got = values(downscale.downscale_timeseries(make(spark, rows), "area", "CAMB", ["COL", "ARG"]), "area", "time")
    assert got[("COL", 2001)] == 0 and got[("COL", 2002)] == pytest.approx(1)


def test_gas_downscaling(spark):
    rows = [("COL", "S", y, AR4, 22826.0 * (2 if y == 2020 else 1)) for y in range(2000, 2021)] + [("COL", "S", 2002, g, 1.0) for g in GASES]
    got = values(downscale.downscale_gas_timeseries(make(spark, rows), AR4, GASES), "variable", "time")
    for g in GASES:
        assert got[(g, 2000)] == pytest.approx(1) and got[(g, 2019)] == pytest.approx(1) and got[(g, 2020)] == pytest.approx(2)


def test_downscaling_by_shares(spark):
    cube = make(spark, [("CAMB", "S", y, "CO2", 0.866) for y in (2000, 2001)])
    shares = spark.createDataFrame([("COL", "S", "CO2", 1.0), ("ARG", "S", "CO2", 5.0), ("MEX", "S", "CO2", 0.0)], "area string, source string, variable string, value double")
    got = values(downscale.downscale_timeseries_by_shares(cube, "area", "CAMB", ["COL", "ARG", "MEX"], shares), "area", "time")
    assert got[("COL", 2001)] == pytest.approx(0.866 / 6) and got[("ARG", 2000)] == pytest.approx(0.866 * 5 / 6) and got[("MEX", 2000)] == 0
    with pytest.raises(downscale.DownscalingError, match="in common"):
        downscale.downscale_timeseries_by_shares(cube, "area", "CAMB", ["COL"], shares.where("source = 'X'"))


def test_variables_without_shares_are_named(spark, caplog):
    cube = make(spark, [("ALL", "S", 2000, g, 10.0) for g in ("CO2", "CH4")])
    shares = spark.createDataFrame([("COL", "CO2", 1.0), ("BOL", "CO2", 3.0)], "area string, variable string, value double")
    got = values(downscale.downscale_timeseries_by_shares(cube, "area", "ALL", ["COL", "BOL"], shares), "area", "variable")
    assert got == {("ALL", "CO2"): 10, ("COL", "CO2"): 2.5, ("BOL", "CO2"): 7.5} and "CH4" in caplog.text


def test_formulas(tmp_path):
    assert parse_formula("2.B + 2.E") == {"2.B": 1, "2.E": 1} and parse_formula("-3+4") == {"3": -1, "4": 1} and parse_formula("2*1.A - 5") == {"1.A": 2, "5": -1}
    assert category_name({"3": -1, "4": 1}) == "A_(-3+4)"
    path = tmp_path / "rules.csv"
    path.write_text("# rules\nA,gas,B,comment\n1,,1,plain\n2+3,N2O CH4,2,some gases\n")
    rules = read_conversion(path)
    assert (rules.source, rules.target) == ("A", "B") and rules.rules[1] == ConversionRule({"2": 1, "3": 1}, {"2": 1}, {"gas": ("N2O", "CH4")}, "some gases")


def test_conversion(spark):
    cube = make(spark, [("COL", c, "S", 2000, g, v) for c, v in (("1", 1.0), ("2", 2.0), ("3", n)) for g in ("CO2", "N2O")], dims=("area", "category", "source"))
    rules = Conversion("A", "B", (ConversionRule({"1": 1}, {"1": 1}), ConversionRule({"2": 1, "3": 1}, {"2": 2}), ConversionRule({"3": 1}, {"3": 1}), ConversionRule({"1": 1}, {"4": 1}, {"gas": ("N2O",)})))
    got = values(convert(cube, "cat", rules, {"gas": "entity"}), "category", "variable")
    assert got == {("1", "CO2"): 1, ("1", "N2O"): 1, ("2", "CO2"): 1, ("2", "N2O"): 1, ("4", "N2O"): 1}
    with pytest.raises(CubeError, match="auxiliary"):
        convert(cube, "cat", rules)

def converted(spark, *rules, order=()):
    cube = make(spark, [("COL", c, "S", 2000, g, 1.0) for c in ("1", "2", "3") for g in ("CO2", "N2O")], dims=("area", "category", "source"))
    return values(convert(cube, "cat", Conversion("A", "B", rules, order), {"gas": "entity"}), "category", "variable")


@pytest.mark.parametrize("targets, scale", [("abcdefgh", 8), ("ab", 2), ("abcde", 5)])
def test_several_targets_make_one_category(spark, targets, scale):
    got = converted(spark, ConversionRule({"1": 1}, dict.fromkeys(targets, 1)))
    assert got == {(f"A_({'+'.join(targets)})", g): scale for g in ("CO2", "N2O")}
    assert set(converted(spark, ConversionRule({"1": 1, "2": 1}, dict.fromkeys(targets, 1))).values()) == {2 * scale}


def test_rules_that_apply(spark):
    assert converted(spark, ConversionRule({"1": 1}, {"x": -3, "y": 4}), ConversionRule({"1": 1}, {"z": -1})) == {}
    gas = {"gas": ("N2O",)}
    # a restricted rule with several targets ends them; with one target it doesn't, and the next one replaces its cells
    assert converted(spark, ConversionRule({"1": 1}, {"x": 1, "y": 4}, gas), ConversionRule({"2": 1}, {"x": 1})) == {("A_(x+4*y)", "N2O"): 1.25}
    assert converted(spark, ConversionRule({"1": 3}, {"x": 1}, gas), ConversionRule({"2": 5}, {"x": 1})) == {("x", "CO2"): 5, ("x", "N2O"): 5}
    assert converted(spark, ConversionRule({"1": 3}, {"x": 1}, {"gas": ("N2O", "CO2")}), ConversionRule({"9": 5}, {"x": 1}, gas)) == {("x", "CO2"): 3}
    assert converted(spark, ConversionRule({"1": 1}, {"x": 1}), ConversionRule({"2": 1}, {"x": 1, "y": 1}), ConversionRule({"3": 7}, {"y": 1})) == {("x", g): 1 for g in ("CO2", "N2O")} | {("y", g): 7 for g in ("CO2", "N2O")}

