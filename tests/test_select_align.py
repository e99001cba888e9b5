import pytest
from helpers import day, make, n, values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fluxcube.meta import CubeError, DimensionNotExistingError, VariableMeta
from fluxcube.operators import align, select
from fluxcube.operators.select import Not


def cube(spark):
    return make(spark, [(a, "S", y, "CO2", float(i * 10 + y - 2000)) for i, a in enumerate(("ARG", "BOL", "COL")) for y in range(2000, 2005)])


def test_loc(spark):
    c = cube(spark)
    assert values(select.loc(c, {"area (ISO3)": "BOL", "time": slice("2001", "2002")}), "time") == {2001: 11, 2002: 12}
    assert select.loc(c, {"area": "BOL"}).meta.dims == ("source",)
    assert select.loc(c, {"area": ["BOL"]}).meta.dims == ("area", "source")
    assert set(values(select.loc(c, {"area": Not("BOL"), "time": "2003"}), "area")) == {"ARG", "COL"}
    assert set(values(select.loc(c, {"area": Not(["BOL", "ARG"])}), "area")) == {"COL"}
    with pytest.raises(KeyError):
        select.loc(c.with_domains(), {"area": Not("XXX")})
    for wrong in ("XXX", ["ARG", "XXX"], Not("XXX")):
        with pytest.raises(KeyError):
            select.loc(c, {"area": wrong}, strict=True)
    assert set(values(select.loc(c, {"area": Not("BOL"), "time": slice("2003", None)}, strict=True), "area")) == {"ARG", "COL"}
    with pytest.raises(DimensionNotExistingError):
        select.loc(c, {"category": "1"})
    with pytest.raises(CubeError, match="doesn't match"):
        select.select_no_scalar_dimension(c, {"area": "BOL"})


def test_aliases(spark):
    c = select.expand_dims(cube(spark), "category", "1", "IPCC2006")
    assert c.meta.resolve("cat") == c.meta.resolve("category (IPCC2006)") == "category"
    assert c.meta.alias_translations()["cat"] == "category (IPCC2006)"
    with pytest.raises(CubeError):
        select.expand_dims(c, "category", "2")


def test_assign(spark):
    c = cube(spark)
    got = values(select.assign(c, {"area": "BOL", "time": "2003"}, 99.0), "area", "time")
    assert got[("BOL", 2003)] == 99 and got[("BOL", 2002)] == 12 and len(got) == 15


def test_filter_rows_counts_null_as_no_match(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "x string, k int")
    assert [r["k"] for r in select.filter_rows(df, remove={"r": {"x": "a"}}).orderBy("k").collect()] == [2, 3]
    assert [r["k"] for r in select.filter_rows(df, keep={"r": {"x": ["a", "b"]}}).orderBy("k").collect()] == [1, 3]


def test_fillna_and_combine_first(spark):
    a = make(spark, [("ARG", "S", 2000, "CO2", 1.0), ("ARG", "S", 2001, "CO2", n)])
    b = make(spark, [("ARG", "S", 2001, "CO2", 5.0), ("BOL", "S", 2000, "CO2", 6.0), ("ARG", "S", 2000, "CO2", 7.0)])
    assert values(align.fillna(a, b), "area", "time") == {("ARG", 2000): 1, ("ARG", 2001): 5}
    assert values(align.combine_first(a, b), "area", "time") == {("ARG", 2000): 1, ("ARG", 2001): 5, ("BOL", 2000): 6}
    tons = b.with_df(b.df, b.meta.with_(variables={"CO2": VariableMeta("CO2", "t CO2 / yr")}))
    assert values(align.combine_first(a, tons), "area", "time")[("BOL", 2000)] == pytest.approx(0.006)


def test_merge(spark):
    a = make(spark, [("ARG", "S", y, "CO2", 100.0) for y in (2000, 2001)])
    near = a.with_df(a.df.withColumn("value", a.df["value"] * 1.009))
    far = a.with_df(a.df.withColumn("value", a.df["value"] * 1.09))
    assert set(values(align.merge(a, near), "time").values()) == {100}
    with pytest.raises(align.MergeError, match="ARG"):
        align.merge(a, far)
    with pytest.warns(UserWarning):
        assert set(values(align.merge(a, far, error_on_discrepancy=False), "time").values()) == {100}
    negative = a.with_df(a.df.withColumn("value", -a.df["value"]))
    align.merge(negative, far)  # relative to the signed first value
    with pytest.raises(align.MergeError):
        align.merge(negative, far, absolute=True)
    with pytest.raises(CubeError):
        align.merge(a, select.expand_dims(a, "category", "1"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), st.integers(2000, 2003), st.one_of(st.none(), st.floats(-5, 5))), min_size=1, max_size=6, unique_by=lambda t: t[:2]))
def test_merge_with_itself_changes_nothing(spark, rows):
    c = make(spark, [(a, "S", y, "CO2", v) for a, y, v in rows])
    assert values(align.merge(c, c), "area", "time") == values(c, "area", "time")


def test_set(spark):
    c = make(spark, [("ARG", "S", 2000, "CO2", 1.0), ("BOL", "S", 2000, "CO2", 2.0), ("ARG", "S", 2001, "CO2", n)])
    with pytest.raises(CubeError, match="hold data"):
        align.set_values(c, "area", "ARG", 5.0)
    with pytest.raises(CubeError, match="exist"):
        align.set_values(c, "area", "ARG", 5.0, existing="error")
    with pytest.raises(KeyError):
        align.set_values(c, "area", "COL", 5.0, new="error")
    assert values(align.set_values(c, "time", "2001", 5.0), "area", "time") == {("ARG", 2000): 1, ("BOL", 2000): 2, ("ARG", 2001): 5, ("BOL", 2001): 5}
    assert values(align.set_values(c, "area", "ARG", 5.0, existing="fillna"), "area", "time")[("ARG", 2001)] == 5
    new = spark.createDataFrame([(day(2000), 9.0), (day(2001), None)], "time date, value double")
    got = values(align.set_values(c, "area", ["ARG", "COL"], new, existing="overwrite"), "area", "time")
    assert got == {("ARG", 2000): 9, ("ARG", 2001): None, ("COL", 2000): 9, ("COL", 2001): None, ("BOL", 2000): 2}


def test_arithmetic(spark):
    from fluxcube.operators import arithmetic

    a = make(spark, [("ARG", "S", y, "CO2", v) for y, v in ((2000, 4.0), (2001, 0.0), (2002, n))])
    b = make(spark, [("ARG", "S", y, "CO2", v) for y, v in ((2000, 2000.0), (2001, 0.0))], units={"CO2": "t CO2 / yr"})
    assert values(arithmetic.combine(a, b, "+"), "time") == {2000: 6, 2001: 0}
    ratio = arithmetic.combine(a, b, "/")
    assert values(ratio, "time") == {2000: 2, 2001: n} and ratio.meta.variables["result"].unit == ""
    assert values(arithmetic.combine(ratio, a, "*"), "time") == {2000: 8, 2001: n, 2002: n} or values(arithmetic.combine(ratio, a, "*"), "time") == {2000: 8, 2001: n}
    assert values(arithmetic.combine(a, b, "-", join="left"), "time") == {2000: 2, 2001: 0, 2002: n}
    with pytest.raises(CubeError, match="axes"):
        arithmetic.combine(a, b, "+", join="exact")
    with pytest.raises(CubeError, match="product"):
        arithmetic.combine(a, b, "*")
    wide = arithmetic.to_frame(a, "time").first()
    assert wide["2000-01-01"] == 4
