import pytest
from helpers import make, n, values

from fluxcube.meta import CubeError, DimensionNotExistingError
from fluxcube.operators import aggregate
from fluxcube.operators.aggregate import Rule


def ab(spark):
    """For each a: b1 has no data, b2 has [missing, 1, 2] along c."""
    rows = [(a, b, c, 2000, "CO2", v) for a in ("1", "2") for b, vs in (("1", [n, n, n]), ("2", [n, 1.0, 2.0])) for c, v in zip("123", vs)]
    return make(spark, rows, dims=("a", "b", "c"), attrs={})


def grid(cube):
    got = values(cube, "a", "b", "c")
    return [got.get(("1", b, c)) for b in "12" for c in "123"]


@pytest.mark.parametrize("dims, expected", [("b", [0, n, n, 0, 1, 2]), (("a", "b"), [0, n, n, 0, 1, 2]), (("b", "c"), [n, n, n, n, 1, 2]), ((), [n, n, n, n, 1, 2]), ("c", [0, 0, 0, n, 1, 2])])
def test_fill_all_na(spark, dims, expected):
    assert grid(aggregate.fill_all_na(ab(spark), dims)) == expected


@pytest.mark.parametrize(
    "options, expected",
    [
        ({"skipna": True, "min_count": 0}, [0, 1, 2]),
        ({}, [0, 1, 2]),
        ({"skipna": True}, [n, 1, 2]),
        ({"skipna": True, "min_count": 1}, [n, 1, 2]),
        ({"skipna": True, "min_count": 2}, [n, n, n]),
        ({"skipna": False}, [n, n, n]),
        ({"skipna_evaluation_dims": "a"}, [0, 1, 2]),
        ({"skipna_evaluation_dims": "c"}, [n, 1, 2]),
    ],
)
def test_sums(spark, options, expected):
    got = values(aggregate.sum_cells(ab(spark), "b", **options), "a", "c")
    assert [got[("1", c)] for c in "123"] == expected


def test_null_rows_and_absent_rows_are_the_same(spark):
    cube = ab(spark)
    sparse = cube.with_df(cube.df.where("value is not null"), cube.meta.with_(domains={"b": ("1", "2"), "c": ("1", "2", "3"), "a": ("1", "2")}))
    for options in ({"skipna": False}, {"skipna": True}, {"skipna_evaluation_dims": "c"}):
        a = values(aggregate.sum_cells(cube, "b", **options), "a", "c", drop_null=True)
        b = values(aggregate.sum_cells(sparse, "b", **options), "a", "c", drop_null=True)
        assert a == b


def test_arguments(spark):
    cube = ab(spark)
    with pytest.raises(CubeError):
        aggregate.sum_cells(cube, "b", reduce_to_dim="a")
    with pytest.raises(CubeError):
        aggregate.sum_cells(cube, "b", skipna=True, skipna_evaluation_dims="a")
    with pytest.raises(DimensionNotExistingError):
        aggregate.sum_cells(cube, "nope")


def test_count_and_any_and_coverage(spark):
    cube = ab(spark)
    assert values(aggregate.count(cube, ["b", "c"]), "a") == {"1": 2, "2": 2}
    assert values(aggregate.any_cell(cube, ["b", "c"]), "a") == {"1": True, "2": True}
    got = {(r["b"], r["c"]): r["coverage"] for r in aggregate.coverage(cube, "b", "c").collect()}
    assert got == {("1", "1"): 0, ("1", "2"): 0, ("1", "3"): 0, ("2", "1"): 0, ("2", "2"): 2, ("2", "3"): 2}
    wide = {r["b"]: (r["1"], r["2"], r["3"]) for r in aggregate.coverage(cube, "b", "c", pivot=True).collect()}
    assert wide == {"1": (0, 0, 0), "2": (0, 2, 2)}
    with pytest.raises(CubeError):
        aggregate.coverage(cube)


def test_sum_over_entities_needs_units_that_convert(spark):
    cube = make(spark, [("COL", "S", 2000, "CO2", 1.0), ("COL", "S", 2000, "CH4", 2.0)], units={"CO2": "Gg CO2 / yr", "CH4": "Gg CO2 / yr"})
    assert values(aggregate.sum_cells(cube, "entity"), "area") == {"COL": 3.0}
    with pytest.raises(ValueError):
        aggregate.sum_cells(make(spark, [("COL", "S", 2000, "CO2", 1.0), ("COL", "S", 2000, "CH4", 2.0)]), "entity")


def test_aggregates_in_levels(spark):
    cube = make(spark, [(a, "S", 2000, v, x) for a, x in (("COL", 1.0), ("ARG", 2.0), ("BOL", 4.0)) for v in ("CO2", "CH4")])
    rules = [Rule("CA", ["COL", "ARG"]), Rule("ALL", ["CA", "BOL"]), Rule("B", ["BOL", "XXX"], sel={"entity": "CH4"})]
    assert [[r.target for r in level] for level in aggregate.levels(rules)] == [["CA", "B"], ["ALL"]]
    got = values(aggregate.add_aggregates_coordinates(cube, {"area": rules}), "area", "variable")
    assert got[("CA", "CO2")] == 3 and got[("ALL", "CH4")] == 7 and got[("B", "CH4")] == 4 and ("B", "CO2") not in got


def test_existing_aggregates_are_checked(spark):
    rows = [("COL", "S", 2000, "CO2", 1.0), ("ARG", "S", 2000, "CO2", 2.0), ("CA", "S", 2000, "CO2", 3.5)]
    with pytest.raises(ValueError, match="differ by more"):
        aggregate.add_aggregates_coordinates(make(spark, rows), {"area": [Rule("CA", ["COL", "ARG"])]})
    kept = aggregate.add_aggregates_coordinates(make(spark, rows), {"area": [Rule("CA", ["COL", "ARG"], tolerance=0.2)]})
    assert values(kept, "area")["CA"] == 3.5
