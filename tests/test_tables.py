import datetime

import pytest
from helpers import make, values
from pyspark.sql import functions as F

from fluxcube.functions.codes import CodeError
from fluxcube.meta import CubeError, CubeMeta
from fluxcube.operators.validate import ValidationError, ensure_valid, findings, row_report
from fluxcube.sources import interchange, inventory, store, tables
from fluxcube.streaming import ingest

WIDE = "country,category,gas,unit,1991,2000,2010\nAUS,IPC1,CO2,Gg,4.1,5,6\nZAM,IPC2,CH4,Mt,7,8,9\n"
OPTIONS = dict(
    coords_cols={"unit": "unit", "entity": "gas", "area": "country", "category": "category"},
    coords_terminologies={"area": "ISO3", "category": "IPCC2006", "scenario": "general"},
    coords_defaults={"source": "TESTcsv2021", "scenario": "HISTORY"},
    coords_value_mapping={"unit": "COMPACT", "entity": "COMPACT", "category": "COMPACT"},
)


def rows(data):
    return sorted((r["area"], r["entity"], r["unit"], r["category"], r["time"].year, r["value"]) for r in data.df.collect())


def test_wide_and_long_give_the_same(spark, tmp_path):
    wide, long = tmp_path / "wide.csv", tmp_path / "long.csv"
    wide.write_text(WIDE)
    long.write_text("country,category,gas,unit,year,emissions,other\n" + "".join(f"{a},{c},{g},{u},{y},{v},x\n" for a, c, g, u, vs in (("AUS", "IPC1", "CO2", "Gg", (4.1, 5, 6)), ("ZAM", "IPC2", "CH4", "Mt", (7, 8, 9))) for y, v in zip((1991, 2000, 2010), vs)))
    a = tables.read_wide_csv(spark, str(wide), **OPTIONS)
    b = tables.read_long_csv(spark, str(long), **{**OPTIONS, "coords_cols": {**OPTIONS["coords_cols"], "time": "year", "data": "emissions"}})
    assert rows(a) == rows(b) == [("AUS", "CO2", "Gg CO2 / yr", "1", 1991, 4.1), ("AUS", "CO2", "Gg CO2 / yr", "1", 2000, 5), ("AUS", "CO2", "Gg CO2 / yr", "1", 2010, 6), ("ZAM", "CH4", "Mt CH4 / yr", "2", 1991, 7), ("ZAM", "CH4", "Mt CH4 / yr", "2", 2000, 8), ("ZAM", "CH4", "Mt CH4 / yr", "2", 2010, 9)]
    w = tables.to_wide(a)
    assert w.columns == ["source", "scenario (general)", "area (ISO3)", "entity", "unit", "category (IPCC2006)", "1991", "2000", "2010"]
    cube = tables.to_cube(a)
    assert cube.meta.attrs == {"area": "area (ISO3)", "cat": "category (IPCC2006)", "scen": "scenario (general)"}
    ensure_valid(cube, rows=True)
    assert tables.expected_cells(a) == 2 * 2 * 1 * 1 * 3 * 2


def test_filters_and_secondary_categories(spark):
    df = spark.createDataFrame(
        [("AUS", "IPC1", "TOTAL", "CO2", "Gg", "4000"), ("AUS", "IPC0", "TOTAL", "KYOTOGHG", "MtCO2eq", "8"), ("USA", "IPC2", "TOTAL", "CO2", "Gg", "1"), ("ZAM", "IPC2", "SUB", "CH4", "Gg", "1"), ("ZAM", "IPC2", "TOTAL", "CO2", "Gg", "12")],
        ["country", "category", "classification", "gas", "unit", "1991"],
    )
    data = tables.convert_wide(
        df,
        coords_cols={**OPTIONS["coords_cols"], "sec_cats__Class": "classification"},
        coords_terminologies={**OPTIONS["coords_terminologies"], "sec_cats__Class": "class"},
        coords_defaults={**OPTIONS["coords_defaults"], "sec_cats__Type": "fugitive"},
        coords_value_mapping=OPTIONS["coords_value_mapping"],
        filter_keep={"f1": {"category": ["IPC0", "IPC2"]}, "f2": {"sec_cats__Class": "TOTAL"}},
        filter_remove={"f1": {"entity": "CH4"}, "f2": {"area": ["USA", "FRA"]}},
    )
    assert rows(data) == [("AUS", "CO2", "Gg CO2 / yr", "1", 1991, 4000), ("AUS", "KYOTOGHG (SARGWP100)", "Mt CO2 / yr", "0", 1991, 8), ("ZAM", "CO2", "Gg CO2 / yr", "2", 1991, 12)]
    assert data.dimensions["Class"] == "Class (class)" and data.df.first()["Type"] == "fugitive"


def test_units_are_made_equal(spark):
    df = spark.createDataFrame([("AUS", "1", "CH4", "Gg", "4.1"), ("AUS", "2", "CH4 (SARGWP100)", "GgCO2eq", "147"), ("DEU", "1", "SF6", "Gg", "4.1"), ("DEU", "2", "SF6", "t", "1000")], ["country", "category", "gas", "unit", "1991"])
    data = tables.convert_wide(df, **{**OPTIONS, "coords_value_mapping": {"unit": "COMPACT"}})
    got = [(e, u, pytest.approx(v)) for _, e, u, _, _, v in rows(data)]
    assert got == [("CH4", "Gg CH4 / yr", 4.1), ("CH4", "Gg CH4 / yr", 7), ("SF6", "Gg SF6 / yr", 4.1), ("SF6", "Gg SF6 / yr", 1)]


def test_coordinates_codes_and_errors(spark):
    df = spark.createDataFrame([("AUS", "XX", "Energy", "CO2", "Gg", "IE"), ("ZAM", "XX", "IPPU", "CO2", "Gg", "8")], ["country", "category", "name", "gas", "unit", "1991"])
    options = {**OPTIONS, "add_coords_cols": {"category_name": ["name", "category"]}, "coords_value_filling": {"category": {"category_name": {"Energy": "1", "IPPU": "2"}}}, "coords_value_mapping": {"unit": "COMPACT"}}
    data = tables.convert_wide(df, **options)
    cube = tables.to_cube(data)
    assert cube.meta.coords["category_name"] == ("category", {"1": "Energy", "2": "IPPU"}) and values(cube, "category") == {"1": 0, "2": 8}
    with pytest.raises(CodeError, match="String values"):
        tables.convert_wide(df, **options, convert_str=False)
    with pytest.raises(CubeError, match="not found"):
        tables.convert_wide(df, **{**OPTIONS, "coords_cols": {**OPTIONS["coords_cols"], "source": "nope"}, "coords_defaults": {}})
    with pytest.raises(CubeError, match="Mandatory"):
        tables.convert_wide(df, **{**OPTIONS, "coords_defaults": {}})
    with pytest.raises(CubeError, match="unknown"):
        tables.convert_wide(df, **{**OPTIONS, "coords_defaults": {"source": "x", "Class": "y"}})
    with pytest.raises(CubeError, match="More than one unit"):
        tables.to_cube(tables.Interchange(data.df.union(data.df.withColumn("unit", F.lit("t CO2 / yr"))), data.dimensions))


def test_interchange_files(spark, tmp_path):
    df = spark.createDataFrame([("AUS", "IPC1", "CO2", "Gg", 4.5), ("ZAM", "IPC2", "CH4", "Gg", None)], "country string, category string, gas string, unit string, `1991` double")
    data = tables.convert_wide(df, **OPTIONS, meta_data={"title": "t", "publication_date": datetime.date(2099, 12, 31)})
    path = interchange.write_interchange(tmp_path / "out", data)
    text = (tmp_path / "out.csv").read_text()
    assert text.splitlines()[1] == '"TESTcsv2021","HISTORY","AUS","CO2","Gg CO2 / yr","1",4.5' and text.splitlines()[2].endswith(',""')
    again = interchange.read_interchange(spark, path)
    assert rows(again) == rows(data) or [r for r in rows(again) if r[-1] is not None] == [r for r in rows(data) if r[-1] is not None]
    assert again.attrs["publication_date"] == datetime.date(2099, 12, 31) and again.dimensions == dict(data.dimensions)
    interchange.write_interchange(tmp_path / "again", again)
    assert (tmp_path / "again.csv").read_text() == text
    (tmp_path / "out.csv").unlink()
    with pytest.raises(FileNotFoundError):
        interchange.read_interchange(spark, path)


def test_store(spark, tmp_path):
    cube = make(spark, [("COL", "S", 2000, "CO2", 1.0), ("COL", "S", 2000, "CH4", 2.0)])
    path = str(tmp_path / "cube")
    store.save_cube(cube, path)
    back = store.open_cube(spark, path)
    assert values(back, "variable") == {"CO2": 1, "CH4": 2} and back.meta.variables == cube.meta.variables
    store.save_cube(make(spark, [("COL", "S", 2000, "CH4", 3.0), ("COL", "S", 2000, "SF6", 4.0)]), path, mode="append")
    assert values(store.open_cube(spark, path), "variable") == {"CO2": 1, "CH4": 3, "SF6": 4}
    plan = store.open_cube(spark, path).variable("CO2").df._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "variable" in plan


def test_inventory_sheets(spark):
    header = inventory.header_units(["Category", "CO2 (kt)", "CH4", "odd"], regexp_entity=r"^(\w+)", regexp_unit=r"\((\w+)\)", manual_units={"odd": "t"}, manual_entities={"odd": "N2O"})
    assert header == [("Category", ""), ("CO2", "kt"), ("CH4", ""), ("N2O", "t")]
    df = inventory.add_units(spark.createDataFrame([("1", "2", None, "4")], "a string, b string, c string, d string"), header)
    got = sorted((r["entity"], r["unit"], r["data"], r["time"]) for r in inventory.sheet_to_long(df, 1990, ["Category"]).collect() if r["data"])
    assert got == [("CO2", "kt", "2", "1990"), ("N2O", "t", "4", "1990")]


def test_validation(spark):
    cube = make(spark, [("COL", "S", 2000, "CO2", 1.0)])
    ensure_valid(cube, rows=True)
    bad = cube.with_df(cube.df.union(cube.df), cube.meta.with_(dims=("area",), attrs={"area": "area", "publication_date": "x", "foo": 1, "contact": "me", "references": "r"}))
    rules = {r for _, r, _ in findings(bad)}
    assert {"required_dimension", "attribute_format", "publication_date", "unknown_attribute", "contact", "references"} <= rules
    with pytest.raises(ValidationError, match="source"):
        ensure_valid(bad)
    assert row_report(cube.with_df(cube.df.union(cube.df))).first()["duplicate_cells"] == 1


def test_metadata():
    meta = CubeMeta(("area",), {}, {"area": "area (ISO3)"}).with_attrs(title="t", contact="a@b.c").with_attrs(contact=None)
    assert meta.title == "t" and meta.contact is None
    assert CubeMeta.from_json(meta.to_json()).attrs == {"title": "t"}


def test_stream(spark, tmp_path):
    t = datetime.datetime
    rows_ = [("a", t(2024, 1, 1, 5), 1), ("a", t(2024, 1, 1, 20), 2), ("b", t(2024, 1, 2), 5), ("a", t(2024, 2, 1), 9)]
    schema = "k string, ts timestamp, v long"
    spark.createDataFrame(rows_, schema).write.parquet(str(tmp_path / "in"))
    events = ingest.read_events(spark, str(tmp_path / "in"), schema)
    ingest.stream_into(ingest.windowed_totals(events, "ts", "v", ["k"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["k"], r["time"].isoformat()): r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "2024-01-01"): 3, ("b", "2024-01-02"): 5}  # February's window is still open


def test_stream_with_late_events(spark, tmp_path):
    t = datetime.datetime
    schema = "k string, ts timestamp, v long"
    batches = [[("a", t(2024, 1, 1, 5), 1), ("b", t(2024, 1, 2), 5)], [("a", t(2024, 1, 9), 9)], [("a", t(2024, 1, 1, 20), 2)]]
    for k, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        totals = ingest.windowed_totals(ingest.read_events(spark, str(tmp_path / "in"), schema), "ts", "v", ["k"], late="30 days")
        ingest.upsert_into(totals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)  # started again, it goes on
    rows_ = ingest.read_upserts(spark, str(tmp_path / "out"), "k string, time date, value long, n long", ["k"]).collect()
    assert {(r["k"], r["time"].isoformat()): (r["value"], r["n"]) for r in rows_} == {("a", "2024-01-01"): (3, 2), ("b", "2024-01-02"): (5, 1), ("a", "2024-01-09"): (9, 1)}
    assert len(rows_) == 3
