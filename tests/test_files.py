"""Sources, sinks, the whole plan and the command line."""

import gzip
import json
import zipfile

import pytest

from parcelwise.plans import planner, tables
from parcelwise.operators import report
from parcelwise.sources import gpkg, inputs, xlsx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    rows = tables.points(spark, SF).selectExpr("cast(point_id as string) as business_code", "lat as latitude", "lon as longitude", "cast(label as double) as weight")
    return rows.orderBy(rows.business_code.cast("int")).collect()


@pytest.fixture(scope="module")
def road_file(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("map") / "road_network.gpkg"
    lines = [(r.road_id, [(v.lon, v.lat) for v in r.geometry], r.highway, r.oneway, r.junction) for r in tables.roads(spark, SF).collect()]
    gpkg.write_gpkg(str(path), lines)
    return path


def test_xlsx_round_trip(spark, orders, tmp_path):
    path = tmp_path / "orders.xlsx"
    path.write_bytes(xlsx.workbook(["business_code", "latitude", "longitude", "note", "ok"], [[int(r.business_code), r.latitude, r.longitude, None if i % 2 else "a<b & ü", True] for i, r in enumerate(orders)]))
    got = inputs.read_orders(spark, str(path))
    assert got.dtypes == [("business_code", "string"), ("latitude", "double"), ("longitude", "double"), ("note", "string"), ("ok", "boolean")]
    rows = got.collect()
    assert [(r.business_code, r.latitude, r.longitude) for r in rows] == [(r.business_code, r.latitude, r.longitude) for r in orders]
    assert rows[0].note == "a<b & ü" and rows[1].note is None and rows[0].ok is True


def test_shared_strings_and_gaps(spark, tmp_path):
    data = xlsx.workbook(["latitude", "longitude", "c"], [[1.0, 2.0, "x"]])
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        pass
    import io

    src, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in src.namelist():
            text = src.read(name).decode()
            if name.endswith("sheet1.xml"):
                text = text.replace('<c r="C2" t="inlineStr"><is><t xml:space="preserve">x</t></is></c>', '<c r="E2" t="s"><v>1</v></c><c r="C2" t="s"><v>0</v></c>')
            z.writestr(name, text)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx.MAIN[1:-1]}"><si><r><t>sha</t></r><r><t>red</t></r></si><si><t>far</t></si></sst>')
    (tmp_path / "s.xlsx").write_bytes(out.getvalue())
    assert inputs.read_orders(spark, str(tmp_path / "s.xlsx")).first().c == "shared"


def test_column_names():
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(xlsx.column_name(i) + "7") == i for i in range(800))


def test_bad_orders(spark, tmp_path):
    with pytest.raises(ValueError, match="lack"):
        path = str(tmp_path / "x.parquet")
        spark.createDataFrame([(1,)], "latitude int").write.parquet(path)
        inputs.read_orders(spark, path)
    rows = spark.createDataFrame([(float("nan"), 1.0)], "latitude double, longitude double")
    with pytest.raises(Exception, match="no sound coordinate"):
        inputs.points_of(rows).collect()


def test_depots(spark):
    got = inputs.parse_depots(spark, "  40.5,-73.25  41,-74 ").collect()
    assert [tuple(r) for r in got] == [(0, 40.5, -73.25), (1, 41.0, -74.0)]
    for bad in ("", "1,2,3", "a,b", "1"):
        with pytest.raises(Exception, match="no depot coordinate"):
            inputs.parse_depots(spark, bad).collect()
    assert inputs.depot_text((1.0, 2.0), "3,4 5,6") == "3,4 5,6" and inputs.depot_text((1.0, 2.0), None) == "1.0,2.0"
    with pytest.raises(ValueError, match="at least one"):
        inputs.depot_text(None, " ")


def test_gpkg(spark, road_file):
    whole = inputs.read_roads(spark, (-75.0, 39.0, -72.0, 42.0), str(road_file)).collect()
    want = {r.road_id: r for r in tables.roads(spark, SF).collect()}
    assert {r.road_id: r for r in whole} == want
    part = inputs.read_roads(spark, (-73.75, 40.20, -73.40, 40.42), str(road_file)).count()
    assert 0 < part < len(want)
    with pytest.raises(FileNotFoundError):
        inputs.read_roads(spark, (0, 0, 1, 1))
    assert gpkg.line_of(gpkg.packed_line([(1.5, 2.5), (3.0, 4.0)])) == [(1.5, 2.5), (3.0, 4.0)]


def test_gpkg_stretches(spark, road_file, tmp_path, monkeypatch):
    whole = gpkg.RoadsReader(str(road_file), "lines", None, 5)
    parts = whole.partitions()
    found = [[r[0] for r in whole.read(p)] for p in parts]
    assert len(parts) == 5 and all(found) and sorted(x for f in found for x in f) == sorted(r.road_id for r in tables.roads(spark, SF).collect())
    monkeypatch.setattr(gpkg.RoadsReader, "mounted", lambda self: None)  # as from another store
    far = gpkg.RoadsReader(f"file://{road_file}", "lines", [-73.75, 40.20, -73.40, 40.42], 5)
    assert [(p.first, p.last) for p in far.partitions()] == [(None, None)] and 0 < len(list(far.read(far.partitions()[0]))) < 46
    monkeypatch.undo()
    gpkg.write_gpkg(f"{tmp_path}/none.gpkg", [])
    none = gpkg.RoadsReader(f"{tmp_path}/none.gpkg", "lines", None, 3)
    assert [list(none.read(p)) for p in none.partitions()] == [[]]


def test_durations(spark, tmp_path):
    (tmp_path / "d.csv").write_text("start_id,end_id,duration\n2,1,5.0\n1,2,6.0\n3,3,0\n")
    got = {(r.a, r.b): r.duration for r in inputs.read_durations(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {(1, 2): 6.0, (3, 3): 0.0}
    found = spark.createDataFrame([(1, 2, 6.0), (4, 5, None)], "a long, b long, duration double")
    more = spark.createDataFrame([(1, 2, 9.0), (1, 3, 7.0)], "a long, b long, duration double")
    path = f"{tmp_path}/kept"
    inputs.add_durations(spark, path, found)
    inputs.add_durations(spark, path, more)
    assert {(r.a, r.b): r.duration for r in inputs.read_durations(spark, path).collect()} == {(1, 2): 6.0, (1, 3): 7.0}


def test_cached_map(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return planner.road_tables(tables.roads(spark, SF))

    for box in ((1.0001, 2, 3, 4), (1.0002, 2, 3, 4), (1.001, 2, 3, 4)):
        nodes, edges = inputs.cached_map(spark, str(tmp_path), box, build)
        assert nodes.count() == 400 and edges.count() == 1330
    assert len(made) == 2


def test_plan(spark, orders, tmp_path):
    df = spark.createDataFrame(orders)
    settings = planner.Settings(most_rounds=6)
    stats, rows = planner.plan(df, tables.depots(spark, SF), tables.roads(spark, SF), settings)
    stats, out = stats.collect(), rows.collect()
    assert sorted(r.business_code for r in out) == sorted(r.business_code for r in orders) and "weight" in rows.columns
    by = {r.label: r for r in stats}
    for label in {r.label for r in out}:
        own = sorted(r.route_series for r in out if r.label == label)
        assert own == list(range(1, len(own) + 1)) and by[label].count_orders == len(own)
        assert by[label].total_working_time == pytest.approx(round(by[label].travel_time + by[label].delivery_time, 2))
        assert by[label].time_to_first_point <= by[label].travel_time + 0.01
    assert all(r.total_working_time < 15.1 for r in stats)

    table = spark.createDataFrame(stats)
    path = report.export_json(table, rows, f"{tmp_path}/json")
    document = json.loads(gzip.open(path.removeprefix("file://")).read())
    assert document["version"] == 1.0 and len(document["routes"]) == len(stats) and len(document["orders"]) == len(out)
    with zipfile.ZipFile(report.export_workbooks(table, rows, f"{tmp_path}/books")) as z:
        assert set(z.namelist()) == {"all_routes.xlsx", "all_address.xlsx", *(f"route_{r.label}.xlsx" for r in stats)}
        first = list(xlsx.sheet_rows(z.read(f"route_{stats[0].label}.xlsx")))
        at = first[0].index("route_series")
        assert [r[at] for r in first[1:]] == list(range(1, stats[0].count_orders + 1))
    report.export_tables(table, rows, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/orders").count() == len(out)
    points = rows.selectExpr("point_id", "latitude as lat", "longitude as lon", "label")
    page = open(report.export_map(points, tables.depots(spark, SF), f"{tmp_path}/map")).read()
    assert page.count('"label"') == len(out) and page.count('"depot": true') == 5


def test_command_line(spark, orders, road_file, tmp_path, capsys):
    path = tmp_path / "orders.xlsx"
    path.write_bytes(xlsx.workbook(["business_code", "latitude", "longitude"], [[r.business_code, r.latitude, r.longitude] for r in orders[:60]]))
    args = ["--orders", str(path), "--roads", str(road_file), "--warehouse-coords", "40.5,-73.5 40.2,-73.8", "--output", str(tmp_path / "out")]
    assert planner.main(args) == 0
    said = capsys.readouterr().out.strip().splitlines()[-1]
    assert said.startswith("<done>") and len(json.loads(gzip.open(said[6:-7]).read())["orders"]) == 60
    assert planner.main(["--orders", str(path)]) == 1
    assert capsys.readouterr().out.strip().splitlines()[-1].startswith("<error>at least one depot")


def files_of(folder):
    return sorted(str(p) for p in folder.rglob("*.parquet"))


def test_a_second_plan_searches_nothing(spark, orders, tmp_path, monkeypatch):
    df, depots = spark.createDataFrame(orders[:50]), tables.depots(spark, SF)
    settings = planner.Settings(most_rounds=2, durations=f"{tmp_path}/durations")
    first, rows = planner.plan(df, depots, tables.roads(spark, SF), settings)
    plain, _ = planner.plan(df, depots, tables.roads(spark, SF), planner.Settings(most_rounds=2))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, plain.collect()))
    kept = files_of(tmp_path / "durations")
    assert kept and spark.read.parquet(settings.durations).groupBy("start_id", "end_id").count().where("count > 1").isEmpty()
    monkeypatch.setattr(planner.paths, "pair_seconds", None)
    monkeypatch.setattr(planner.report, "pair_seconds", None)
    again, _ = planner.plan(df, depots, tables.roads(spark, SF), settings)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    assert files_of(tmp_path / "durations") == kept


def test_command_line_with_a_cache(spark, orders, road_file, tmp_path, capsys, monkeypatch):
    path = tmp_path / "orders.csv"
    path.write_text("business_code,latitude,longitude\n" + "".join(f"{r.business_code},{r.latitude!r},{r.longitude!r}\n" for r in orders[:25]))
    args = ["--orders", str(path), "--roads", str(road_file), "--warehouse-coords", "40.5,-73.5 40.2,-73.8", "--rounds", "4", "--patience", "2", "--seed", "1", "--cache", f"{tmp_path}/kept", "--output"]
    for kind, name in (("json", "result.json.gz"), ("tables", "")):
        assert planner.main([*args, f"{tmp_path}/{kind}", "--format", kind]) == 0
        assert capsys.readouterr().out.strip().splitlines()[-1] == f"<done>{tmp_path}/{kind}{'/' * bool(name)}{name}</done>"
        monkeypatch.setattr(planner.paths, "pair_seconds", None)
        monkeypatch.setattr(planner, "build_network", None)
    held = {p.name for p in (tmp_path / "kept").iterdir()}
    assert len(held) == 1 and {p.name for p in (tmp_path / "kept" / held.pop()).iterdir()} == {"nodes", "edges", "durations"}
    assert spark.read.parquet(f"{tmp_path}/tables/orders").count() == 25


def test_formats(spark, tmp_path):
    stats = spark.createDataFrame([(1, 2)], "label long, count_orders long")
    rows = spark.createDataFrame([(0, 40.1, -73.9, 1, 1), (1, 40.2, -73.8, 1, 2)], "point_id long, latitude double, longitude double, label long, route_series int")
    depots = spark.createDataFrame([(40.5, -73.5)], "lat double, lon double")
    found = {kind: write(stats, rows, f"{tmp_path}/{kind}", depots) for kind, write in planner.EXPORTS.items()}
    assert found == {"json": f"{tmp_path}/json/result.json.gz", "map": f"{tmp_path}/map/map.html", "tables": f"{tmp_path}/tables", "workbooks": f"{tmp_path}/workbooks/result.zip"}
    assert open(found["map"]).read().count('"label"') == 2 and spark.read.parquet(f"{found['tables']}/orders").count() == 2


def test_large_results_are_refused(spark):
    rows = spark.range(3).selectExpr("id as point_id", "id as label")
    with pytest.raises(ValueError, match="export_tables"):
        report.result_document(rows, rows, 2)
