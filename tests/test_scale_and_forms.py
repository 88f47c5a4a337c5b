"""What small grids don't show: many keys, hot keys, several tiles; and file forms that have no query."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.database import Database
from cellweave.operators import focal, iterate, learn, terrain, zonal
from cellweave.plans.components import connected_components
from cellweave.plans.registry import create
from cellweave.plans.scratch import discard, scratch_dir, written
from cellweave.sources import converters, files, formats, vectors
from test_operators import dijkstra, to_array, to_grid


def test_running_count_without_reuse_of_exchanges(spark):
    keep = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        t = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("k"))
        got = zonal.running_count(t, F.col("k")).orderBy("key").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", keep)
    n = np.array([r.n for r in got])
    assert n.sum() == 200_000 and len(n) > 80_000
    assert [r.before for r in got] == (np.cumsum(n) - n).tolist()


def test_by_key_with_hot_keys(spark):
    t = spark.range(3000).select((F.col("id") % 10).cast("int").alias("row"), F.col("id").cast("int").alias("col"), F.when(F.col("id") < 2000, 0.0).when(F.col("id") < 2100, None).otherwise(F.col("id").cast("double")).alias("v"))
    table = t.where("v is not null").groupBy("v").agg(F.count("*").alias("n")).withColumn("twice", F.col("v") * 2)
    got = zonal.by_key(t, table, "v").collect()
    assert len(got) == 3000
    assert all((r.twice, r.n) == ((None, None) if r.v is None else (2 * r.v, 2000 if r.v == 0 else 1)) for r in got)


def test_components_of_a_long_path(spark):
    order = list(range(0, 600, 2)) + list(range(599, 0, -2))
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(900, 901), (902, 902), (None, 3)], "src long, dst long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == dict.fromkeys(range(600), 0) | {900: 900, 901: 900, 902: 902}


def test_written_tables_go(spark):
    import os

    t = written(spark.range(5))
    path = t._scratch.removeprefix("file://")
    assert t.count() == 5 and os.path.isdir(path) and t._scratch.startswith(scratch_dir(spark))
    discard(t)
    assert not os.path.exists(path)


def test_costs_over_many_tiles(spark):
    rng = np.random.default_rng(3)
    friction = rng.integers(0, 5, (70, 90)).astype(float)
    friction[30, 5:85] = 0  # a wall, so that paths go round
    seeds = np.zeros((70, 90))
    seeds[2, 3] = seeds[60, 80] = 1
    want = dijkstra(seeds, friction)
    t = iterate.cost_surface(iterate._seeds(to_grid(spark, seeds)), to_grid(spark, friction), tile=16)
    got = np.full((70, 90), np.inf)
    for r in t.collect():
        got[r.row, r.col] = r.cost
    assert np.allclose(got, want)


def test_shortest_path(spark):
    rng = np.random.default_rng(5)
    friction = rng.uniform(1, 4, (20, 25))
    start, end = np.zeros((20, 25)), np.zeros((20, 25))
    start[1, 2] = end[17, 20] = 1
    on = to_array(create("SPDIST")(to_grid(spark, friction), source_row=1, source_col=2, dest_row=17, dest_col=20), (20, 25))
    total = dijkstra(start, friction)[17, 20]
    cells = sorted(zip(*np.nonzero(on == 1)), key=lambda rc: dijkstra(start, friction)[rc])
    assert cells[0] == (1, 2) and cells[-1] == (17, 20)
    along = sum(friction[b] * math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(cells, cells[1:]))
    assert abs(along - total) < 1e-9 and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(cells, cells[1:]))


@pytest.mark.parametrize("size", [3, 5, 9])
def test_windows_over_many_tiles(spark, size):
    rng = np.random.default_rng(size)
    m = rng.integers(0, 7, (31, 44)).astype(float)
    m[rng.random(m.shape) < 0.15] = np.nan
    g, h = to_grid(spark, m), size // 2

    def plain(f):
        out = np.full(m.shape, np.nan)
        for r, c in zip(*np.nonzero(~np.isnan(m))):
            w = m[max(0, r - h) : r + h + 1, max(0, c - h) : c + h + 1].ravel()
            out[r, c] = f(np.sort(w[~np.isnan(w)]))
        return out

    def entropy(w):
        p = np.unique(w, return_counts=True)[1] / len(w)
        return -(p * np.log(p)).sum()

    def most(w):
        values, n = np.unique(w, return_counts=True)
        return values[n.argmax()]

    t = focal.tiled(g.df, h, lambda images: {"s": images["v"][h : len(images["v"]) - h, h : len(images["v"]) - h] * 2}, ["s"], tile=8)
    assert np.allclose(to_array(t, m.shape, "s"), m * 2, equal_nan=True)
    for got, want in ((create("WINDOW")(g, statistic="std", window_size=size), plain(np.std)), (create("FILTER")(g, filter_type="Mode", kernel_size=size), plain(most)), (create("WINDOW")(g, statistic="median", window_size=size), plain(np.median)), (create("PATTERN")(g, metric="Entropy", kernel_size=size), plain(entropy))):
        assert np.allclose(to_array(got, m.shape), want, equal_nan=True)


def test_kendall_by_blocks(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 40, (30, 40)).astype(float), rng.normal(size=(30, 40)).round(1)
    x[:12] = 7  # more than a third of one value
    y += x / 30
    got = terrain.kendall(to_grid(spark, x), to_grid(spark, y), blocks=16).head()
    a, b = x.ravel(), y.round(12).ravel()
    b = y.ravel()
    dx, dy = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    tau = (dx * dy).sum() / math.sqrt(np.abs(dx).sum() * np.abs(dy).sum())
    assert got.n == 1200 and abs(got.tau - tau) < 1e-12 and 0 <= got.p <= 1
    assert terrain._concordance(a[:300], b[:300]) == int((dx[:300, :300] * dy[:300, :300]).sum()) // 2


def test_knn_regression_uses_all_samples(spark):
    rng = np.random.default_rng(2)
    y, x1, x2 = rng.normal(size=(3, 12, 15))
    mask = (rng.random((12, 15)) < 0.5).astype(float)
    got = learn.knn_regression(to_grid(spark, y), [to_grid(spark, x1), to_grid(spark, x2)], to_grid(spark, mask), 3)
    p = np.stack([x1.ravel(), x2.ravel()], axis=1)
    s = np.flatnonzero(mask.ravel())
    want = np.empty(180)
    for k in range(180):
        d = np.sqrt(((p[s] - p[k]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:3]
        w = 1 / np.maximum(d[near], 1e-12)
        want[k] = y.ravel()[s[near[0]]] if d[near[0]] < 1e-10 else (w * y.ravel()[s[near]]).sum() / w.sum()
    assert np.allclose(to_array(got, (12, 15)).ravel(), want)


def test_nearest_rows_of_hot_cells(spark):
    """Small cells, groups and many equal arrays against all pairs."""
    from cellweave.operators.nearness import nearest_rows

    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(150, 3)), np.tile([[0.5, 0.5, 0.5]], (80, 1)), rng.normal(size=(30, 3)) * 0.01 + 4])
    q = np.vstack([rng.normal(size=(120, 3)) * 2, np.tile([[0.5, 0.5, 0.4]], (90, 1))])
    samples = spark.createDataFrame([(k // 20, k % 20, v.tolist(), float(k)) for k, v in enumerate(x)], "row int, col int, a array<double>, v double")
    queries = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(q)], "row int, col int, a array<double>")
    got = {r.row: [(b.row, b.col, b.v) for b in r.best] for r in nearest_rows(queries, samples, 4, bound=16, group=25).collect()}
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    for k in range(len(q)):
        want = np.argsort(d[k], kind="stable")[:4]
        assert got[k] == [(int(i) // 20, int(i) % 20, float(i)) for i in want]


def test_upper_tail():
    z = np.linspace(-9, 9, 2001)
    want = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
    assert np.allclose(terrain._upper_tail(z), want, rtol=1e-10, atol=1e-16)


def test_contours_are_thinned(spark):
    m = np.full((8, 12), np.nan)
    m[2, 1:9] = 5  # straight east, then straight south
    m[3:7, 8] = 5
    m[6, 0:2] = 3
    got = create("TINPREP")(to_grid(spark, m)).orderBy("chain", "no").collect()
    assert [(r.x, r.y, r.value) for r in got if r.value == 3] == [(0, -6, 3), (1, -6, 3)]
    five = [(r.x, -r.y) for r in got if r.value == 5]
    assert five[0] == (1, 2) and five[-1] == (8, 6) and 3 <= len(five) <= 4 and got[0].chain == 2 * 12 + 1


def test_utm_there_and_back(spark):
    places = spark.createDataFrame([(9.0, 48.0), (6.5, 0.5), (11.9, 71.0), (7.7, -33.0)], "lon double, lat double")
    for epsg in (32632, 32732):
        x, y = terrain._from_geographic(F.col("lon"), F.col("lat"), epsg)
        lon, lat = terrain._to_geographic(F.col("x"), F.col("y"), epsg)
        for r in places.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert abs(r.lon - r.lon2) < 2e-8 and abs(r.lat - r.lat2) < 2e-8  # two millimetres
    # The meridian's arc from the equator to 48 degrees on WGS 84, and the false origin.
    x, y = terrain._from_geographic(F.lit(9.0), F.lit(48.0), 32632)
    r = places.select(x.alias("x"), y.alias("y")).head()
    e2, steps = 2 / 298.257223563 - 1 / 298.257223563**2, 20000
    phi = np.radians((np.arange(steps) + 0.5) * 48 / steps)
    arc = (6378137.0 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum() * np.radians(48 / steps)
    assert abs(r.x - 500000) < 1e-6 and abs(r.y - 0.9996 * arc) < 1e-3
    with pytest.raises(ValueError):
        create("PROJECT")(to_grid(spark, np.ones((3, 3))), target_epsg=2056)


def test_breakout_of_too_many_classes(spark):
    with pytest.raises(ValueError, match="more than"):
        create("BREAKOUT")(to_grid(spark, np.arange(100.0).reshape(10, 10)), max_classes=20)


# Forms


def as_files(spark, parts, name="x"):
    return spark.createDataFrame([(f"/f/{name}.{k}" if k else f"/f/{name}", bytearray(v)) for k, v in parts.items()], "path string, content binary")


def test_written_forms_read_back():
    rng = np.random.default_rng(1)
    m = rng.integers(0, 200, (2, 4, 6)).astype(float)
    transform = (100.0, 500.0, 10.0, -10.0, 0.0, 0.0)
    holes = m.copy()
    holes[0, 1, 2] = np.nan
    for read, write, data in (
        (formats.read_envi, formats.write_envi, holes), (formats.read_ers, formats.write_ers, holes), (formats.read_netcdf, formats.write_netcdf, holes), (formats.read_tiff, formats.write_tiff, holes), (formats.read_lan, formats.write_lan, m),
        (formats.read_rst, formats.write_rst, holes[:1]), (formats.read_surfer, formats.write_surfer, holes[:1]), (formats.read_grass, formats.write_grass, holes[:1]), (formats.read_ascii, formats.write_ascii, holes[:1]),
    ):
        parts = write(data, transform, -9999.0)
        assert np.array_equal(read(parts), data, equal_nan=True), read.__name__
        assert np.array_equal(formats.read_any(parts), data, equal_nan=True), read.__name__
    three = rng.integers(0, 255, (3, 5, 7)).astype(float)
    assert np.array_equal(formats.read_bitmap(formats.write_bitmap(three, transform, 0.0)), three)


def test_packed_tiffs():
    import zlib

    m = np.arange(24, dtype=np.uint8).reshape(4, 6) // 5

    def lzw(data):
        """Clear, a code per byte, clear often enough that codes stay nine bits, end."""
        codes = []
        for k in range(0, len(data), 200):
            codes += [256, *data[k : k + 200]]
        bits = "".join(f"{c:09b}" for c in [*codes, 257])
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))

    runs = lambda data: b"".join(bytes([len(data[k : k + 128]) - 1]) + data[k : k + 128] for k in range(0, len(data), 128))
    diff = np.diff(m, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8)
    for packing, body, predictor in ((1, m.tobytes(), 1), (5, lzw(m.tobytes()), 1), (8, zlib.compress(diff.tobytes()), 2), (32773, runs(m.tobytes()), 1)):
        entries = [(256, 4, 6), (257, 4, 4), (258, 3, 8), (259, 3, packing), (273, 4, 8 + 2 + 12 * 9 + 4), (277, 3, 1), (278, 4, 4), (279, 4, len(body)), (317, 3, predictor)]
        b = b"II*\0" + struct.pack("<IH", 8, 9) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in entries) + bytes(4) + body
        assert np.array_equal(formats.read_any({"tif": b})[0], m), packing
    long = bytes(np.random.default_rng(0).integers(0, 3, 9000, dtype=np.uint8))
    table, last, codes, wide, bits = {bytes([i]): i for i in range(256)}, b"", [], 9, f"{256:09b}"
    for byte in long:  # a full encoder, so that code widths grow
        if last + bytes([byte]) in table:
            last += bytes([byte])
            continue
        bits += f"{table[last]:0{wide}b}"
        table[last + bytes([byte])] = len(table) + 2
        n = len(table) + 2
        wide = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        last = bytes([byte])
        if n >= 4094:
            bits += f"{table[last]:0{wide}b}" + f"{256:0{wide}b}"
            table, wide, last = {bytes([i]): i for i in range(256)}, 9, b""
    bits += f"{table[last]:0{wide}b}" if last else ""
    bits += f"{257:0{wide}b}"
    bits += "0" * (-len(bits) % 8)
    assert files._unpacked_lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == long


def test_pictures():
    rng = np.random.default_rng(4)
    for shape in ((1, 13, 21), (3, 17, 9)):
        m = (np.cumsum(rng.integers(-6, 7, shape), axis=2) % 256).astype(float)
        assert np.abs(formats.read_any(formats.write_jpeg(m, None, 0.0)) - m).max() <= 2
    # Two units of 16 x 16 cells with a restart between them: four grey blocks each, colours by half, all blocks even.
    head = formats.write_jpeg(np.zeros((3, 8, 8)), None, 0.0)["jpg"]
    start = head.index(b"\xff\xc0")
    head = head[:start] + struct.pack(">BBHBHHB", 0xFF, 0xC0, 17, 8, 16, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]) + b"\xff\xdd\x00\x04\x00\x01" + head[start + 19 :]
    head = head[: head.index(b"\xff\xda") + 14]

    def unit(numbers):
        bits = ""
        before = [0, 0, 0]
        for k, x in zip((0, 0, 0, 0, 1, 2), numbers):
            step, before[k] = x - before[k], x
            size = abs(step).bit_length()
            bits += f"{size:04b}" + (f"{step if step > 0 else step + (1 << size) - 1:0{size}b}" if size else "") + "0" * 8
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")

    b = head + unit([80, -40, 160, 0, 0, 0]) + b"\xff\xd0" + unit([8, 16, 24, 32, 80, 0]) + b"\xff\xd9"
    got = formats.read_jpeg({"jpg": b})
    assert got.shape == (3, 16, 32) and got[0, 0, 0] == 138 and got[0, 0, 8] == 123 and got[0, 8, 0] == 148 and got[0, 8, 8] == 128
    assert got[0, 15, 31] == 132 and got[2, 15, 31] == round(132 + 17.72) and got[1, 0, 16] == round(129 - 3.44136)
    for cut in (40, 120, len(b) - 12):
        with pytest.raises(ValueError):
            formats.read_jpeg({"jpg": b[:cut]})


def test_read_only_forms(spark):
    head = bytearray(484)
    head[:3], head[199] = b"ASD", 0
    struct.pack_into("<H", head, 204, 5)
    assert formats.read_asd({"asd": bytes(head) + np.arange(5, dtype="<f4").tobytes()}).tolist() == [[[0, 1, 2, 3, 4]]]
    psd = b"8BPS\0\1" + bytes(6) + struct.pack(">HIIHH", 1, 2, 3, 8, 1) + bytes(12) + struct.pack(">H", 1) + struct.pack(">HH", 2, 4) + b"\xfe\x07" + b"\x02\x01\x02\x03"
    assert formats.read_psd({"psd": psd}).tolist() == [[[7, 7, 7], [1, 2, 3]]]
    assert formats.read_matrix({"csv": b"1,2,\n4,,6\n"})[0].tolist()[1][0] == 4 and np.isnan(formats.read_matrix({"csv": b"1,2,\n4,,6\n"})[0, 0, 2])
    months = formats.read_months({"txt": b"x y jan feb\n1 10 5 6\n2 10 7 8\n1 9 1 2\n"})
    assert months.shape == (2, 2, 2) and months[0, 0].tolist() == [5, 7] and months[1, 1, 0] == 2 and np.isnan(months[0, 1, 1])
    raw = np.arange(6, dtype=">i2").reshape(3, 2)
    cells = create("NDVI3G")(as_files(spark, {"bin": raw.tobytes()}), rows=2, cols=3)
    assert to_array(cells, (2, 3)).tolist() == raw.T.tolist()
    rain = np.arange(12, dtype=">f4").reshape(2, 2, 3)
    rain[0, 0, 0] = -99999
    cells = create("GPCIDRISI")(as_files(spark, {"bin": b"size".ljust(12) + rain.tobytes()}), rows=2, cols=3)
    assert cells.where("band = 1 and v = 11").count() == 1 and cells.where("v is null").count() == 1
    profile = lambda col, south, values: (f"{1:6d}{col:6d}{len(values):6d}{1:6d}" + f"{0.0:24.15E}{south:24.15E}{0.0:24.15E}" + f"{0.0:24.15E}{0.0:24.15E}" + "".join(f"{v:6d}" for v in values)).ljust(1024)
    a = " " * 816 + f"{30.0:12.6E}{30.0:12.6E}{1.0:12.6E}" + f"{1:6d}{2:6d}"
    dem = (a.ljust(1024) + profile(1, 0.0, [1, 2, 3]) + profile(2, 30.0, [5, -32767])).encode()
    got = formats.read_dem({"dem": dem})[0]
    assert got[:, 0].tolist() == [3, 2, 1] and np.isnan(got[0, 1]) and got[1, 1] == 5 and np.isnan(got[2, 1])


def test_vector_forms():
    parts = [(3.0, [(0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 0.0)]), (4.5, [(5.0, 5.0), (6.0, 7.25)])]
    points = [(1.0, [(1.5, 2.5)]), (2.0, [(3.0, -4.0)])]
    for read, write in ((vectors.read_gen, vectors.write_gen), (vectors.read_dxf, vectors.write_dxf), (vectors.read_kml, vectors.write_kml), (vectors.read_mif, vectors.write_mif), (vectors.read_shape, vectors.write_shape)):
        assert read(write(parts)) == parts, read.__name__
        assert read(write(points)) == points, read.__name__
        assert vectors.parts_of(vectors.edges_of(parts + points)) == parts + points
    old = "0\nSECTION\n2\nENTITIES\n0\nPOLYLINE\n30\n9\n70\n1\n0\nVERTEX\n10\n0\n20\n0\n0\nVERTEX\n10\n1\n20\n0\n0\nSEQEND\n0\nLINE\n10\n0\n20\n1\n11\n2\n21\n3\n0\nENDSEC\n"
    assert vectors.read_dxf({"dxf": old.encode()}) == [(9.0, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), (0.0, [(0.0, 1.0), (2.0, 3.0)])]


def test_files_are_written_and_read(spark, tmp_path):
    m = np.arange(20.0).reshape(4, 5)
    out = create("ENVIIDRIS")(to_grid(spark, m), direction="export")
    converters.write_files(out, f"file://{tmp_path}/envi")
    back = create("ENVIIDRIS")(converters.read_files(spark, f"file://{tmp_path}/envi/*"))
    assert np.array_equal(to_array(back, (4, 5)), m)
    with pytest.raises(ValueError):
        create("ECWIDRIS")
    with pytest.raises(Exception, match="isn't read"):
        create("LANDSAT")(as_files(spark, {"jp2": b"\0\0\0\x0cjP"})).collect()


def test_csv_columns_are_widened(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,2,3,x\n2,2.5,y,\n,4,5,z\n")
    db = Database(spark)
    db.import_csv("wide", str(tmp_path / "t.csv"))
    assert db.column_types("wide") == {"a": "bigint", "b": "double", "c": "string", "d": "string"}
    assert [tuple(r) for r in db.table("wide").collect()] == [(1, 2.0, "3", "x"), (2, 2.5, "y", None), (None, 4.0, "5", "z")]


def test_macros(spark):
    macro = create("MACROMODELER")()
    macro.add("OVERLAY", ["a", "b"], "s", operation="Add")
    out = create("RUNMACRO")(macro.save(), {"a": to_grid(spark, np.ones((2, 2))), "b": to_grid(spark, np.ones((2, 2)))})
    assert to_array(out["s"], (2, 2)).tolist() == [[2, 2], [2, 2]]
