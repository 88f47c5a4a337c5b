"""Iterative, learning and file operators against NumPy or by hand, on small grids."""

import heapq
import json
import math

import numpy as np
import pytest

from cellweave.functions import catalogue
from cellweave.functions.database import Database
from cellweave.operators import iterate, learn, regrid, terrain, zonal
from cellweave.operators.nearness import lowest, nearest_points, squared_distances
from cellweave.plans import registry
from cellweave.plans.grid import Grid
from cellweave.plans.pipeline import Pipeline
from cellweave.plans.registry import create
from cellweave.sources import files
from cellweave.streaming.windows import tumbling


def to_grid(spark, m, cell=1.0):
    rows = [(r, c, None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(m)]
    return Grid(spark.createDataFrame(rows, "row int, col int, v double"), *m.shape, (0.0, 0.0, cell, -cell, 0.0, 0.0))


def to_array(x, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in (x.df if isinstance(x, Grid) else x).collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


def dijkstra(seeds, friction):
    cost, heap = np.full(friction.shape, np.inf), []
    for r, c in zip(*np.nonzero(seeds)):
        cost[r, c] = 0
        heap.append((0.0, r, c))
    heapq.heapify(heap)
    while heap:
        d, r, c = heapq.heappop(heap)
        if d > cost[r, c]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                i, j = r + a, c + b
                if (a or b) and 0 <= i < cost.shape[0] and 0 <= j < cost.shape[1] and friction[i, j] > 0 and d + friction[i, j] * math.hypot(a, b) < cost[i, j]:
                    cost[i, j] = d + friction[i, j] * math.hypot(a, b)
                    heapq.heappush(heap, (cost[i, j], i, j))
    return cost


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def test_cost(spark, rng):
    friction = rng.integers(0, 5, (17, 23)).astype(float)
    seeds = (rng.random((17, 23)) < 0.02).astype(float)
    want = dijkstra(seeds, friction)
    t = iterate.cost_surface(iterate._seeds(to_grid(spark, seeds)), to_grid(spark, friction), tile=6)
    assert np.allclose(np.where(np.isinf(want), -1, want), to_array(t.selectExpr("row", "col", "case when cost < double('infinity') then cost else -1 end as v"), want.shape))
    assert np.allclose(to_array(create("COST")(to_grid(spark, seeds), to_grid(spark, friction)), want.shape), np.where(np.isinf(want), -1, want))


def label(m, offsets):
    out, n = np.zeros(m.shape, int), 0
    for start in zip(*np.nonzero(m)):
        if not out[start]:
            n += 1
            stack = [start]
            out[start] = n
            while stack:
                r, c = stack.pop()
                for a, b in offsets:
                    i, j = r + a, c + b
                    if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] and m[i, j] and not out[i, j]:
                        out[i, j] = n
                        stack.append((i, j))
    return out


def test_group(spark, rng):
    m = (rng.random((20, 20)) < 0.5).astype(float)
    assert (to_array(create("GROUP")(to_grid(spark, m)), m.shape) == label(m, iterate.FOUR)).all()
    assert (to_array(create("GROUP")(to_grid(spark, m), connectivity="8-connected"), m.shape) == label(m, iterate.EIGHT)).all()


def test_flow(spark, rng):
    dem = rng.permutation(150).reshape(10, 15).astype(float)
    g = to_grid(spark, dem)
    direction = to_array(iterate.flow_direction(g), dem.shape)
    steps = {v: k for k, v in iterate.FLOW_CODES.items()}
    acc = np.ones(dem.shape)
    for k in np.argsort(-dem.ravel()):
        r, c = divmod(int(k), 15)
        if direction[r, c] > 0:
            a, b = steps[int(direction[r, c])]
            assert dem[r + a, c + b] < dem[r, c]
            acc[r + a, c + b] += acc[r, c]
    assert np.allclose(to_array(create("FLOW")(g), dem.shape, "accumulation"), acc)
    pours = np.zeros(dem.shape)
    pours[np.unravel_index(acc.argmax(), acc.shape)] = 5
    shed = to_array(create("WATERSHED")(iterate.flow_direction(g), to_grid(spark, pours)), dem.shape)
    assert (shed == 5).sum() == acc.max()
    filled = to_array(create("PITREMOVAL")(g), dem.shape)
    assert (filled >= dem).all()


def test_path(spark):
    f = np.ones((6, 7))
    f[1:5, 3] = 0
    p = to_array(create("SPDIST")(to_grid(spark, f), source_row=2, source_col=1, dest_row=2, dest_col=5), f.shape)
    assert p[2, 1] == p[2, 5] == 1 and p[2, 3] == 0 and p.sum() >= 5


def test_ranks_and_scan(spark, rng):
    m = rng.integers(0, 9, (12, 12)).astype(float)
    m[3, 3] = np.nan
    top = to_array(create("TOPRANK")(to_grid(spark, m), num_cells=31), m.shape)
    assert np.nansum(top) == 31 and np.nanmin(m[top == 1]) >= np.nanmax(m[top == 0]) - 0
    v = m[~np.isnan(m)]
    dw = create("DURBINWATSON")(to_grid(spark, m)).head()
    assert math.isclose(dw.dw, (np.diff(v) ** 2).sum() / (v**2).sum())
    c = zonal.running_count(to_grid(spark, m).valid(), __import__("pyspark").sql.functions.col("v")).orderBy("key").collect()
    assert [r.before for r in c] == [int((v < r.key).sum()) for r in c]


def test_unknown_parameters():
    with pytest.raises(ValueError):
        create("OVERLAY").arguments({"op": 1})
    with pytest.raises(ValueError):
        create("OVERLAY").arguments({"operation": "multiply"})
    assert create("OVERLAY").arguments({"operation": 2})["operation"] == "Multiply"
    with pytest.raises(ValueError):
        create("NOTHING")
    assert len(registry.names()) > 200 and "gis" in registry.groups()


def test_learning(spark, rng):
    m = rng.normal(size=(2, 15, 15)) + np.where(np.arange(15)[None, None, :] < 8, 0, 6)
    bands = [to_grid(spark, x) for x in m]
    px = learn.pixels(bands).cache()
    truth = np.where(np.arange(15)[None, :] < 8, 1.0, 2.0) * np.ones((15, 1))
    labels = to_grid(spark, truth).df.where("(row + col) % 2 = 0")
    for op in ("KNN", "CTA", "DECISIONFOREST", "SVM", "MULTILOGISTICREG", "MLP", "RBFNN", "SOM", "FUZZYARTMAP"):
        got = to_array(create(op)(px, labels, **({"max_epochs": 20} if op in ("SOM", "MLP") else {})), truth.shape)
        assert (got == truth).mean() > 0.9, op
    sig = [(c, mean, cov, n / 200) for c, n, mean, cov in learn.class_moments(learn.training(px, labels), 2)]
    for op in ("MINDIST", "MAHALCLASS", "MAXLIKE", "FISHER"):
        assert (to_array(create(op)(px, sig), truth.shape) == truth).mean() > 0.95, op
    pc = create("PCA")(px, num_components=2, standardize=False).collect()
    flat = m.reshape(2, -1)
    assert np.isclose(np.var([r.c1 for r in pc], ddof=1), np.linalg.eigvalsh(np.cov(flat)).max())
    em = [(1, [0.0, 1.0]), (2, [1.0, 0.0])]
    f = create("HYPERUNMIX")(px, em).head()
    assert np.isclose(sum(f.fractions), 1) and min(f.fractions) >= 0
    k = to_array(create("KMEANS")(px, num_classes=2), truth.shape)
    assert max((k == truth).mean(), (3 - k == truth).mean()) > 0.95
    assert create("WEIGHT")([[1, 2], ["1/2", 1]])["weights"] == pytest.approx([2 / 3, 1 / 3])


def test_files(spark, tmp_path, rng):
    m = rng.normal(size=(2, 4, 5))
    f = spark.createDataFrame([("x", bytearray(files.encode_tiff(m, (10.0, 20.0, 2.0, -2.0, 0, 0), -9999.0)))], "path string, content binary")
    t = create("GEOTIFF")(f)
    assert np.allclose(to_array(t.where("band = 1"), (4, 5)), m[1])
    raw = m.transpose(1, 0, 2).astype("<f4").tobytes()
    flat = create("GENERICRASTER")(spark.createDataFrame([(bytearray(b"hdr" + raw),)], "content binary"), cols=5, rows=4, bands=2, data_type="Float32", header_bytes=3)
    assert np.allclose(to_array(flat.where("band = 0"), (4, 5)), m[0], atol=1e-6)
    g = to_grid(spark, m[0])
    files.write_ascii_grid(g, str(tmp_path / "a"))
    assert np.allclose(to_array(files.from_ascii_grid(files.ascii_lines(g)), (4, 5)), m[0])
    pixels = rng.integers(0, 255, (3, 2, 3)).astype(np.uint8)
    line = b"".join(bytes(r[:, ::-1].tobytes()).ljust(12, b"\0") for r in pixels.transpose(1, 2, 0)[::-1])
    import struct

    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHH", 40, 3, 2, 1, 24) + bytes(24) + line
    b = create("BMPIDRIS")(spark.createDataFrame([(bytearray(bmp),)], "content binary"))
    assert (to_array(b.where("band = 0"), (2, 3)) == pixels[0]).all()
    assert files.detect_driver("x.TIF") == "GTiff" and files.detect_driver("x.nc") == "netCDF"


def test_pipeline(spark, rng):
    a, b = rng.random((5, 5)), rng.random((5, 5))
    p = Pipeline().add("OVERLAY", ["a", "b"], "s", operation="Add").add("NORMALIZE", ["s"], "n")
    out = Pipeline.load(p.save()).run({"a": to_grid(spark, a), "b": to_grid(spark, b)})
    n = to_array(out["n"], (5, 5))
    assert np.isclose(n.min(), 0) and np.isclose(n.max(), 1) and json.loads(p.save())[0]["module"] == "OVERLAY"
    with pytest.raises(RuntimeError, match="Step 0"):
        p.run({"a": to_grid(spark, a)})


def test_database(spark, tmp_path):
    db = Database(spark)
    db.create_table("t", spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string"))
    db.update("t", {"name": "upper(name)"}, "id = 2")
    db.insert("t", spark.createDataFrame([(3, "z")], "id long, name string"))
    db.delete_rows("t", "id = 1")
    db.calculate_field("t", "twice", "id * 2")
    assert [tuple(r) for r in db.query("SELECT * FROM {t} ORDER BY id").collect()] == [(2, "Y", 4), (3, "z", 6)]
    assert db.row_count("t") == 2 and db.tables() == ["t"] and db.column_types("t")["id"] == "bigint"
    db.export_csv("t", str(tmp_path / "c"))
    db.import_csv("u", str(tmp_path / "c"))
    assert db.column_types("u") == {"id": "bigint", "name": "string", "twice": "bigint"}
    assert db.filter("u", "id > 2").count() == 1 and db.drop_table("u")


def test_regrid(spark, rng):
    m = rng.random((8, 8))
    d = create("DISAGGREGATE")(create("PYRAMID")(to_grid(spark, m), num_levels=1)[0], to_grid(spark, m))
    means = m.reshape(4, 2, 4, 2).mean(axis=(1, 3))
    assert np.allclose(to_array(d, (8, 8)).reshape(4, 2, 4, 2).sum(axis=(1, 3)), means)
    pts = [(k, float(x), float(y), float(k)) for k, (x, y) in enumerate(rng.random((60, 2)) * 400 - 200)]
    near = nearest_points(to_grid(spark, m), spark.createDataFrame(pts, "id long, x double, y double, value double"), 3).collect()
    for r in range(8):
        for c in range(8):
            want = sorted((math.hypot(x - c, y + r), k) for k, x, y, _ in pts)[:3]
            assert sorted((round(n.d, 9), n.id) for n in near if (n.row, n.col) == (r, c)) == [(round(a, 9), b) for a, b in want]


def test_generalize(spark, rng):
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((80, 2)) * 10)]
    kept = []
    for k, x, y in pts:
        if all(math.hypot(x - a, y - b) >= 1.5 for _, a, b in kept):
            kept.append((k, x, y))
    got = create("GENERALIZE")(spark.createDataFrame(pts, "id long, x double, y double"), min_distance=1.5)
    assert sorted(r.id for r in got.collect()) == [k for k, *_ in kept]


def test_generalize_dense_points(spark, rng, monkeypatch):
    """Many points, and many at one place, within reach of each other: no table is larger than that of the points."""
    xy = np.vstack([rng.random((1500, 2)) * 4, np.repeat(rng.random((5, 2)) * 4, 100, axis=0)])
    pts = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)), xy)]
    kept = []
    for k, x, y in sorted(pts):
        if all((x - a) ** 2 + (y - b) ** 2 >= 1 for _, a, b in kept):
            kept.append((k, x, y))
    sizes, write = [], iterate.written

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(iterate, "written", counted)
    odd = [(5000, None, 1.0), (5001, math.nan, 1.0), (5002, math.inf, 1.0)]
    got = create("GENERALIZE")(spark.createDataFrame(pts + odd, "id long, x double, y double"), min_distance=1.0).collect()
    assert sorted(r.id for r in got) == [k for k, *_ in kept] + [5000, 5001, 5002]
    assert max(sizes) <= len(pts)


@pytest.mark.parametrize("gaps", [False, True])
def test_teleconnections(spark, rng, gaps):
    m = rng.random((5, 4, 12))
    m[1:, :, 5] += 3
    m[3, 2] = 1.0  # no variance: it can't be a base
    if gaps:
        m[1, 1, 4] = m[4, 0, 0] = np.nan  # cells that lack a step take no part
    frame = spark.createDataFrame([(r, c, t, None if math.isnan(v) else float(v)) for (r, c, t), v in np.ndenumerate(m)], "row int, col int, t int, v double")
    maps = {(g.mode, g.row, g.col): (g.pattern, g.r2) for g in create("EOT")(frame, num_modes=2).collect()}
    bases = create("EOT")(frame, num_modes=2, output="bases").collect()
    x = {p: m[p] - m[p].mean() for p in np.ndindex(5, 4) if not np.isnan(m[p]).any()}
    for k in range(2):
        square = {p: v @ v for p, v in x.items()}
        score = {p: sum((b @ v) ** 2 / (square[p] * square[q]) for q, v in x.items() if square[q] > 1e-15) for p, b in x.items() if square[p] > 1e-15}
        top = max(score, key=lambda p: (round(score[p], 10), -p[0], -p[1]))
        assert (bases[k].mode, bases[k].row, bases[k].col) == (k + 1, *top) and np.isclose(bases[k].total_r2, score[top]) and np.allclose(bases[k].series, x[top])
        for p, v in x.items():
            assert np.allclose(maps.pop((k + 1, *p)), (v @ x[top] / square[top], (v @ x[top]) ** 2 / (square[top] * square[p]) if square[p] > 1e-15 else 0.0))
        x = {p: v - v @ x[top] / square[top] * x[top] for p, v in x.items()}
    assert not maps


@pytest.mark.parametrize("k,radius", [(1, 0.0), (3, 0.0), (4, 55.0)])
def test_nearest_of_clusters(spark, rng, k, radius):
    """Clusters in a corner, in one place and far off, in leaves of few points and blocks that are split."""
    pts = [(n, *(3.0 + 2 * rng.random(2))) for n in range(150)] + [(200 + n, 101.0, 77.0) for n in range(80)] + [(300 + n, *(rng.random(2) * 400)) for n in range(60)] + [(400, 9e5, 9e5), (401, None, 1.0), (402, math.nan, 1.0)]
    frame = spark.createDataFrame([(int(i), x if x is None else float(x), y if y is None else float(y), float(i) / 7) for i, x, y in pts], "id long, x double, y double, value double")
    grid = Grid(spark.createDataFrame([(r, c, 1.0) for r, c in np.ndindex(20, 24) if (r + c) % 7], "row int, col int, v double"), 20, 24, (0.0, 300.0, 15.0, -15.0, 0.0, 0.0))
    got = {}
    for r in nearest_points(grid, frame, k, radius, bound=16, block=8).collect():
        got.setdefault((r.row, r.col), []).append((r.d, r.id, r.value))
    place = [(i, x, y) for i, x, y in pts if x is not None and not math.isnan(x)]
    for r, c in np.ndindex(20, 24):
        want = sorted((math.sqrt((c * 15.0 - x) ** 2 + (300 - r * 15.0 - y) ** 2), i) for i, x, y in place)[:k]
        want = [(d, i) for d, i in want if not radius or d <= radius] if (r + c) % 7 else []
        own = sorted(got.get((r, c), []))
        assert [i for _, i, _ in own] == [i for _, i in want] and np.allclose([d for d, *_ in own], [d for d, _ in want])
        assert all(v == i / 7 for _, i, v in own)


def test_straight_distances(spark, rng):
    """The transform against all pairs, on grids with gaps, for any reach."""
    at = np.sort(rng.choice(500, 60, replace=False)) * 1.5
    height, places = rng.integers(0, 9000, 60).astype(float), np.arange(-20.0, 800.0, 3.0)
    assert np.allclose(lowest(at, height, places), ((places[:, None] - at) ** 2 + height).min(axis=1))
    cells = [(r, c) for r, c in np.ndindex(23, 31) if rng.random() < 0.9]
    feature = {p for p in cells if rng.random() < 0.02}
    grid = Grid(spark.createDataFrame([(r, c, float((r, c) in feature)) for r, c in cells], "row int, col int, v double"), 23, 31, (0.0, 0.0, 10.0, -25.0, 0.0, 0.0))
    for reach in (math.inf, 60.0):
        got = {(r.row, r.col): r.d for r in squared_distances(grid, grid.df.where("v > 0"), reach).collect()}
        want = {(r, c): min(((r - a) * 25.0) ** 2 + ((c - b) * 10.0) ** 2 for a, b in feature) for r, c in cells}
        assert got == {p: d for p, d in want.items() if d <= reach * reach}
    assert squared_distances(grid, grid.df.limit(0)).count() == 0


def test_query_without_sql_runs(spark):
    got = catalogue.queries()["cca"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["row", "col", "u1", "u2", "v1", "v2"]
    s = got.selectExpr("corr(u1, u2) ab", "corr(v1, v2) cd", "abs(corr(u1, v1)) one", "abs(corr(u2, v2)) two", "corr(u1, v2) x").head()
    assert max(map(abs, (s.ab, s.cd, s.x))) < 1e-3 and s.one >= s.two - 1e-9


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = tumbling(source, "1 day", method="sum").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tumbled").agg({"n": "sum"}).head()[0] == 1000


def test_viewshed(spark, rng):
    dem = rng.integers(0, 20, (13, 14)).astype(float)
    orow, oc, eye = 6, 5, dem[6, 5] + 1.7
    want = np.ones(dem.shape)
    for r in range(13):
        for c in range(14):
            n = max(abs(r - orow), abs(c - oc))
            if n:
                angle = (dem[r, c] - eye) / math.hypot(r - orow, c - oc)
                for s in range(1, n):
                    i, j = (o + int(math.copysign(math.floor(abs(d * s / n) + 0.5), d)) for o, d in ((orow, r - orow), (oc, c - oc)))
                    if (dem[i, j] - eye) / math.hypot(i - orow, j - oc) > angle:
                        want[r, c] = 0
    got = to_array(create("VIEWSHED")(to_grid(spark, dem), observer_x=5.5, observer_y=-6.5), dem.shape)
    assert (got == want).all()
    many = terrain.viewshed(to_grid(spark, dem), 5.5, -6.5, 1.7, 0.0, wedge_cells=7)
    assert (to_array(many, dem.shape) == want).all()
    far = np.array([[math.hypot(r - orow, c - oc) <= 4 for c in range(14)] for r in range(13)])
    assert (to_array(terrain.viewshed(to_grid(spark, dem), 5.5, -6.5, 1.7, 4.0, wedge_cells=40), dem.shape) == want * far).all()


def test_pollination(spark, rng):
    land = rng.integers(1, 4, (9, 9)).astype(float)
    nest, flower, reach = {1: 0.5, 2: 0.9}, {1: 0.3, 3: 0.8}, 2.0
    n, f = (np.vectorize(lambda v, t=t: t.get(int(v), 0.0))(land) for t in (nest, flower))
    cells = [(r, c) for r in range(9) for c in range(9)]
    w = {(a, b): math.exp(-math.dist(a, b) / (reach / 2)) for a in cells for b in cells if math.dist(a, b) <= reach}
    out = np.zeros(land.shape)
    for a in cells:
        near = [b for b in cells if (a, b) in w]
        flowers = sum(f[b] * w[a, b] for b in near)
        supply = n[a] * flowers / sum(w[a, b] for b in near)
        for b in near:
            if flowers > 0:
                out[b] += supply * f[b] * w[a, b] / flowers
    got = to_array(create("POLLINATION")(to_grid(spark, land), nesting=tuple(nest.items()), floral=tuple(flower.items()), foraging_distance=reach), land.shape)
    assert np.allclose(got, out)


def test_anisotropic_cost(spark, rng):
    f, s = rng.integers(1, 5, (8, 9)).astype(float), np.zeros((8, 9))
    s[3, 3] = 1
    plain = to_array(create("COST")(to_grid(spark, s), to_grid(spark, f)), f.shape)
    free = to_array(create("VARCOST")(to_grid(spark, s), to_grid(spark, f), to_grid(spark, np.full(f.shape, -1.0))), f.shape)
    east = to_array(create("VARCOST")(to_grid(spark, s), to_grid(spark, f), to_grid(spark, np.full(f.shape, 90.0))), f.shape)
    assert np.allclose(plain, free)
    assert east[3, 4] <= f[3, 4] and east[3, 2] <= 1 / f[3, 2] + 1e-12 and (east >= 0).all()


def test_path_and_triangles(spark):
    back, cost = np.zeros((4, 4)), np.arange(16.0).reshape(4, 4)
    back[3, 3], back[2, 2], back[1, 1] = 32, 32, 32
    p = to_array(create("PATHWAY")(to_grid(spark, cost), to_grid(spark, back), row=3, col=3), back.shape)
    assert p.sum() == 4 and all(p[k, k] for k in range(4))
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 8.0, 0.0, 8.0), (3, 0.0, -8.0, 16.0), (4, 8.0, -8.0, 24.0), (5, 4.0, -3.0, 10.0)], "id long, x double, y double, value double")
    z = to_array(create("TINSURF")(create("TIN")(pts), to_grid(spark, np.zeros((9, 9)))), (9, 9))
    r, c = np.indices((9, 9))
    assert np.allclose(z, c + 2 * r)  # all points lie on one plane


def test_outlines(spark, rng):
    m = (rng.random((8, 8)) < 0.5).astype(float)
    edges = create("RASTERVECTOR")(to_grid(spark, m))
    back = create("VECTORRASTER")(edges.where("value = 1"), to_grid(spark, m))
    assert (to_array(back, m.shape) == m).all()


def test_segments(spark):
    m = np.zeros((10, 10))
    m[:, 5:] = 50
    m[2, 2] = 200
    px = learn.pixels([to_grid(spark, m)])
    for op, extra in (("SEGMENT", {"similarity_threshold": 5.0, "min_segment_size": 3}), ("SEGMENTATION", {"spatial_bandwidth": 2.0, "spectral_bandwidth": 10.0, "min_region_size": 3})):
        s = to_array(create(op)(px, cols=10, **extra), m.shape)
        assert len(np.unique(s)) == 2 and len(np.unique(s[:, :5])) == 1
