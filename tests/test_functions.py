import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxcube.functions import codes
from fluxcube.functions.codes import CodeError, entity_name, ipcc_code, map_distinct, parse_code, parse_code_column, unit_name
from fluxcube.functions.missing import nan_to_null, safe_div
from fluxcube.functions.units import UnitError, UnitRegistry, registry, split_variable


@pytest.mark.parametrize(
    "code, expected",
    [("IPC1A", "1.A"), ("CATM0EL", "M.0.EL"), ("IPC1A1B23", "1.A.1.b.ii.3"), ("1A1Bii3", "1.A.1.b.ii.3"), ("IPC_1.A.1.B.ii.3", "1.A.1.b.ii.3"), ("IPCM1B1C", "M.1.B.1.c"), ("M.1.B.1.C.", "M.1.B.1.c"), ("MBKA", "M.BK.A")],
)
def test_ipcc_codes(code, expected):
    assert ipcc_code(code) == expected


@pytest.mark.parametrize("code", ["IPC", "IPD1A", "IPCM", "IPCA1", "IPC123", "IPC1AC", "IPC1A2_", "IPC1A2BB", "IPC1A2B3X", "IPC1A2B33A"])
def test_ipcc_codes_that_are_none(code):
    assert ipcc_code(code) == f"error_{code}"


@pytest.mark.parametrize("unit, entity, expected", [("GgCO2eq", "KYOTOGHG", "Gg CO2 / yr"), ("MtC", "CO", "Mt C / yr"), ("GgN2ON", "N2O", "Gg N / yr"), ("t", "CH4", "t CH4 / yr"), ("CO2eq", "FGASES", "error_CO2eq_FGASES"), ("", "FGASES", "error__FGASES"), ("GgCO2eq", "", "error_GgCO2eq_"), ("kt CO\u2082eq", "N2O", "kt CO2 / yr"), ("GgNH3N", "NH3", "Gg N / yr"), ("GgN2ON", "CH4", "GgN2ON CH4 / yr"), ("Gg", "KYOTOGHG (AR6GWP100)", "Gg KYOTOGHG / yr")])
def test_units_of_entities(unit, entity, expected):
    assert unit_name(unit, entity) == expected


def test_entities():
    assert [entity_name(x) for x in ("CO2", "KYOTOGHG", "KYOTOGHGAR4")] == ["CO2", "KYOTOGHG (SARGWP100)", "KYOTOGHG (AR4GWP100)"]


ZERO = ["IE", "NO", "-", "NO,NE", "NO, NE", "IE, NE, NO", "NA,IE,NO"]
MISSING = ["NE", "NE0", "C", "NaN", "nan", "NA, NE", "NA,NE", "FX", "", "N/A"]


def test_notation_keys(spark):
    assert all(parse_code(c) == 0 for c in ZERO) and all(parse_code(c) is None for c in MISSING)
    assert parse_code("12.5 (3)") == 12.5
    with pytest.raises(CodeError):
        parse_code("abc")
    odd = ["1d", "1f", "2.5D", "1 000", "0x10", "--1", "e5", "1_", "_1", "1__0", "."]
    texts = [*ZERO, *MISSING, "12.5 (3)", "-4e2", "abc", None, *odd, "1_000.5", ".5", "5.", "+3", "Infinity", "-inf", "1E-3"]
    for t in odd:
        with pytest.raises(CodeError):
            parse_code(t)
    value, bad = parse_code_column(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", value.alias("v"), bad.alias("bad")).collect()
    for r in rows:
        if r["t"] in ["abc", *odd]:
            assert r["bad"]
        else:
            assert not r["bad"] and r["v"] == (None if r["t"] is None else parse_code(r["t"]))


def test_bad_codes_are_logged(caplog):
    assert ipcc_code("XX9") == "error_XX9" and unit_name("CO2eq", "FGASES") == "error_CO2eq_FGASES"
    assert "'XX9'" in caplog.text and "'CO2eq'" in caplog.text


def test_division_and_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-2.0, 0.0), (3.0, 2.0), (float("nan"), 1.0)], "a double, b double")
    got = [r[0] for r in df.select(safe_div(nan_to_null(F.col("a")), F.col("b"))).collect()]
    assert got == [math.inf, None, -math.inf, 1.5, None]


@pytest.mark.parametrize("text", ["Gg CO2 / yr", "CO2 Gg / year", "CO2 * gigagram / year", "kt CO2 / a", "Gg CO2 / a"])
def test_spellings_of_a_unit(text):
    assert registry.factor(text, "Gg CO2 / yr") == pytest.approx(1)


def test_conversions():
    assert registry.factor("kt CH4 / day", "Gg CH4 / yr") == pytest.approx(365.25)
    assert registry.factor("Gg C / yr", "Gg CO2 / yr") == pytest.approx(44 / 12)
    assert registry.factor("Gg SF6 / yr", "Gg CO2 / yr", "AR4GWP100") == 22800
    assert registry.factor("Gg CO2 / yr", "Gg CH4 / yr", "AR6GWP100") == pytest.approx(1 / 27.9)
    assert registry.parse("").dims == ()
    for bad in (("Gg CH4 / yr", "Gg CO2 / yr", None), ("Gg CH4", "Gg CH4 / yr", None), ("Gg Unknown / yr", "Gg CO2 / yr", None), ("Gg CH4 / yr", "Gg CO2 / yr", "NOGWP")):
        with pytest.raises(UnitError):
            registry.factor(*bad)
    own = UnitRegistry()
    own.define_gas("XF9", AR4GWP100=10.0)
    assert own.factor("t XF9 / yr", "t CO2 / yr", "AR4GWP100") == 10


@given(st.sampled_from(["CH4", "N2O", "SF6", "NF3"]), st.sampled_from(["AR4GWP100", "AR5GWP100", "AR6GWP100"]), st.sampled_from(["Gg", "t", "Mt", "kg"]))
def test_there_and_back(gas, context, mass):
    there = registry.factor(f"{mass} {gas} / yr", "Gg CO2 / yr", context)
    assert there * registry.factor("Gg CO2 / yr", f"{mass} {gas} / yr", context) == pytest.approx(1)


def test_names_of_variables():
    assert split_variable("CH4 (AR4GWP100)") == ("CH4", "AR4GWP100") and split_variable("CH4") == ("CH4", None)


def test_mapping_distinct_values(spark):
    df = spark.createDataFrame([("IPC1A", 1), ("IPC1A", 2), (None, 3), ("1B", 4)], "code string, k int")
    assert [r[0] for r in map_distinct(df, ["code"], ["code"], ipcc_code).orderBy("k").collect()] == ["1.A", "1.A", None, "1.B"]
    assert [r[0] for r in map_distinct(df, ["code"], ["code"], {"1B": "x"}).orderBy("k").collect()] == ["IPC1A", "IPC1A", None, "x"]


def test_mapping_many_distinct_values(spark, monkeypatch):
    monkeypatch.setattr(codes, "MOST_BROADCAST", 3)
    df = spark.createDataFrame([(f"1A{k % 9 + 1}" if k % 10 else None, k) for k in range(40)], "code string, k int")
    got = map_distinct(df, ["code"], ["code"], ipcc_code)
    assert [r[0] for r in got.orderBy("k").collect()] == [ipcc_code(f"1A{k % 9 + 1}") if k % 10 else None for k in range(40)]
