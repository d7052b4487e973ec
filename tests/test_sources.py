from panelcast.functions.codes import code, measures
from panelcast.operators import relate
from panelcast.plans.collect import collect_panels, sorted_panel
from panelcast.sources import releases
from panelcast.sources.stages import Stages


def test_release_columns():
    assert len(releases.release_codes(2010)) == len(releases.release_codes(2021)) == 482
    assert code("S0101", 2, 1) in releases.release_codes(2016)
    assert code("S0101", 5, 1) in releases.release_codes(2017)


def test_codebook(spark):
    out = releases.codebook(spark, {"S0101": ((1, 3), (1, 19))}).collect()
    assert [r["metric"] for r in out] == ["S0101_C01_001E", "S0101_C01_019E", "S0101_C03_001E", "S0101_C03_019E"]


def test_lookups(spark, tmp_path):
    crlf = tmp_path / "county.csv"
    crlf.write_bytes(b"CA,06,001,Alameda County,H1\r\nCA,06,003,Alpine County,H1\r\n")
    got = releases.read_lookup(spark, str(crlf), ["FIPS", "Name", "class"], columns=[2, 3, 4]).collect()
    assert [tuple(r) for r in got] == [("001", "Alameda County", "H1"), ("003", "Alpine County", "H1")]
    piped = tmp_path / "place.csv"
    piped.write_text("STATEFP|PLACEFP|NAME|NAMELSAD\n06|00296|Adelanto|Adelanto city\n06|21796|El Cerrito|El Cerrito city\n")
    places = releases.read_lookup(spark, str(piped), ["FIPS", "Name"], sep="|", header=True, columns=[1, 2])
    names = spark.createDataFrame([("El Cerrito",), ("Adelanto",)], "Name string")
    kept = relate.build_holdout([places, places.where("1 = 0")], names, exclude=["21796"])
    assert [r["FIPS"] for r in kept.collect()] == ["00296"]


def test_releases_to_panels_through_csv(spark, tmp_path):
    base = [code("S0101", 1, 1), code("S0101", 1, 2)]
    old = tmp_path / "2010.csv"
    old.write_text(f"state,place,{base[0]},{base[1]},S0101_C02_001E\n06,00296,200,10.5,7\n08,00001,100,-888888888,3\n")
    new = tmp_path / "2018.csv"
    new.write_text(f"place,state,{base[1]},{base[0]},S0101_C05_001E\n00296,06,22,210,9\n00001,08,5,90,0\n")
    by_year = releases.read_releases(spark, {2010: str(old), 2018: str(new)})
    holdout = spark.createDataFrame([("06", "00296")], "state string, place string")
    names = spark.createDataFrame([("00296", "Adelanto")], "FIPS string, Name string")
    training, held = collect_panels(by_year, holdout, names)
    rows = {(r["year"], r["place"]): r.asDict() for r in training.collect() + held.collect()}
    assert rows[2010, "Adelanto"][base[1]] == 21.0
    assert rows[2010, "Adelanto"]["S0101_C03_001E"] == 7.0
    assert rows[2018, "Adelanto"]["state"] == "06"
    assert rows[2010, "00001"][base[1]] == 0.0
    assert "S0101_C05_001E" not in training.columns and "S0101_C05_001E" not in held.columns

    target = str(tmp_path / "panel")
    releases.write_csv(sorted_panel(training), target)
    schema = releases.panel_schema(measures(training))
    back = releases.read_panel(spark, target, schema)
    assert [tuple(r) for r in back.orderBy("year").collect()] == [tuple(r) for r in sorted_panel(training).collect()]
    assert back.first()["place"] == "00001"


def test_stages(spark, tmp_path):
    stages = Stages(spark, str(tmp_path / "stages"))
    df = spark.createDataFrame([(2010, "06", "00296", 1.5), (2011, "06", "00296", 2.5)],
                               "year int, state string, place string, m double")
    back = stages.save(df, "panel")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    stats = spark.createDataFrame([("m", 2.0, 0.5, -4.0)], "metric string, mean double, sd double, zero_value double")
    stages.save_stats(stats, "scaler")
    assert stages.load_stats("scaler").first() == stats.first()


def test_cells_that_are_no_numbers(spark, tmp_path):
    path = tmp_path / "2018.csv"
    path.write_text("state,place,S0101_C01_001E\n06,00001,(X)\n06,00002,-\n06,00003,12.5\n06,00004,\n")
    got = {r["place"]: r["S0101_C01_001E"] for r in releases.read_release(spark, str(path), 2018).collect()}
    assert got == {"00001": None, "00002": None, "00003": 12.5, "00004": None}
