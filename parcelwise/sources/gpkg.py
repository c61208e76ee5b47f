"""Roads of a GeoPackage as a Python data source with a box pushed down to its R-tree."""

from __future__ import annotations

import os
import shutil
import sqlite3
import struct
import tempfile
from contextlib import closing
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VERTEX = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
ROADS = T.StructType([T.StructField("road_id", T.LongType()), T.StructField("geometry", T.ArrayType(VERTEX)), T.StructField("highway", T.StringType()), T.StructField("oneway", T.StringType()), T.StructField("junction", T.StringType())])
# Bytes of a GeoPackage geometry's envelope by its code.
ENVELOPES = (0, 32, 48, 48, 64)


def line_of(blob: bytes) -> list[tuple[float, float]]:
    """The vertices of a GeoPackage LineString."""
    if blob[:2] != b"GP":
        raise ValueError("no GeoPackage geometry")
    at = 8 + ENVELOPES[blob[3] >> 1 & 7]
    order = "<" if blob[at] else ">"
    kind, n = struct.unpack_from(order + "II", blob, at + 1)
    if kind % 1000 != 2:
        raise ValueError(f"geometry type {kind} is no LineString")
    width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    values = struct.unpack_from(f"{order}{n * width}d", blob, at + 9)
    return [(values[i], values[i + 1]) for i in range(0, n * width, width)]


def packed_line(line: list[tuple[float, float]]) -> bytes:
    flat = [x for p in line for x in p]
    return b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack(f"<BII{len(flat)}d", 1, 2, len(line), *flat)


class Stretch(InputPartition):
    """Roads of ids from `first` to `last`; all of them where both are None."""

    def __init__(self, first: int | None = None, last: int | None = None):
        self.first, self.last = first, last


class RoadsReader(DataSourceReader):
    """A file on a path that driver and executors share is read in place, in stretches of ids; one in another store is
    copied to the worker's disk first, so it is read by a single task."""

    def __init__(self, path: str, layer: str, box: list[float] | None, parts: int):
        self.path, self.layer, self.box, self.parts = path, layer, box, parts
        self.quoted = '"' + layer.replace('"', '""') + '"'

    def mounted(self) -> str | None:
        path = self.path.removeprefix("file://")
        return path if "://" not in path and os.path.exists(path) else None

    def partitions(self):
        if not self.mounted():
            return [Stretch()]
        with closing(in_place(self.mounted())) as db:
            first, last = db.execute(f"select min({self.key(db)}), max({self.key(db)}) from {self.quoted}").fetchone()
        if first is None:
            return [Stretch()]
        step = (last - first) // self.parts + 1
        return [Stretch(i, min(i + step - 1, last)) for i in range(first, last + 1, step)]

    def read(self, partition):
        if path := self.mounted():
            with closing(in_place(path)) as db:
                yield from self.rows(db, partition)
            return
        with tempfile.TemporaryDirectory() as folder:
            system, name = fs.FileSystem.from_uri(self.path)
            with system.open_input_stream(name) as source, open(f"{folder}/roads.gpkg", "wb") as out:
                shutil.copyfileobj(source, out, 16 << 20)
            with closing(in_place(f"{folder}/roads.gpkg")) as db:
                yield from self.rows(db, partition)

    def key(self, db: sqlite3.Connection) -> str:
        named = next((r[1] for r in db.execute(f"pragma table_info({self.quoted})") if r[5]), "rowid")
        return f'"{named}"'

    def rows(self, db: sqlite3.Connection, stretch: Stretch):
        key, names = self.key(db), {r[1] for r in db.execute(f"pragma table_info({self.quoted})")}
        geometry = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", [self.layer]).fetchone()[0]
        tags = ", ".join(f'"{c}"' if c in names else "null" for c in ("highway", "oneway", "junction"))
        tests, args = [], []
        if stretch.first is not None:
            tests, args = [f"{key} between ? and ?"], [stretch.first, stretch.last]
        tree = f"rtree_{self.layer}_{geometry}"
        if self.box and db.execute("select 1 from sqlite_master where name = ?", [tree]).fetchone():
            tests.append(f'{key} in (select id from "{tree}" where maxx >= ? and minx <= ? and maxy >= ? and miny <= ?)')
            args += [self.box[0], self.box[2], self.box[1], self.box[3]]
        where = f" where {' and '.join(tests)}" if tests else ""
        for fid, blob, *found in db.execute(f'select {key}, "{geometry}", {tags} from {self.quoted}{where}', args):
            if blob is not None:
                yield (fid, line_of(blob), *found)


def in_place(path: str) -> sqlite3.Connection:
    """A file opened for reading only, without locks or side files."""
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro&immutable=1", uri=True)


class RoadsGpkg(DataSource):
    """road_id, geometry, highway, oneway, junction of layer `lines`.

    Option `box` (min_lon,min_lat,max_lon,max_lat) is looked up in the layer's R-tree,
    which compares extents; `operators.roads.box_filter` is the exact test. Option
    `layer` names another layer, `parts` the number of tasks that read a shared file.
    """

    @classmethod
    def name(cls) -> str:
        return "roads_gpkg"

    def schema(self) -> T.StructType:
        return ROADS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        box = [float(x) for x in self.options["box"].split(",")] if self.options.get("box") else None
        return RoadsReader(self.options["path"], self.options.get("layer", "lines"), box, int(self.options.get("parts", "8")))


def write_gpkg(path: str, roads: list[tuple]) -> None:
    """A small GeoPackage of (road_id, [(lon, lat)], highway, oneway, junction), with an R-tree."""
    db = sqlite3.connect(path)
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint)")
    db.execute("create table gpkg_contents (table_name text, data_type text, identifier text, srs_id integer)")
    db.execute("insert into gpkg_geometry_columns values ('lines', 'geom', 'LINESTRING', 4326, 0, 0)")
    db.execute("insert into gpkg_contents values ('lines', 'features', 'lines', 4326)")
    db.execute("create table lines (fid integer primary key, geom blob, highway text, oneway text, junction text)")
    db.execute("create virtual table rtree_lines_geom using rtree(id, minx, maxx, miny, maxy)")
    for fid, line, *tags in roads:
        db.execute("insert into lines values (?, ?, ?, ?, ?)", [fid, packed_line(line), *tags])
        xs, ys = [p[0] for p in line], [p[1] for p in line]
        db.execute("insert into rtree_lines_geom values (?, ?, ?, ?, ?)", [fid, min(xs), max(xs), min(ys), max(ys)])
    db.commit()
    db.close()
