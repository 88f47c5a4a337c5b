"""SQL for operators that iterate, look far or use signatures: the same results by other means, mostly recursion.

Graph walks use recursive tables with a key, whose rows are replaced while they fall. The grids' SQL comes first, as in
the catalogue.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..plans.grid import KEY
from ..plans.registry import create
from . import catalogue
from .catalogue import SIZE, add, grid, with_grids

ROOT2 = "SQRT(2.0)"
#: The eight steps: row, column and length in cells.
EIGHT = f", o AS (SELECT * FROM (VALUES (0, 1, 1.0), (1, 1, {ROOT2}), (1, 0, 1.0), (1, -1, {ROOT2}), (0, -1, 1.0), (-1, -1, {ROOT2}), (-1, 0, 1.0), (-1, 1, {ROOT2})) t(dr, dc, len))"


def R(e: str, name: str = "v") -> str:
    return f"ROUND(CAST({e} AS DOUBLE) + 0.0, 6) AS {name}"


def recursive(names: str, body: str) -> str:
    return with_grids(dict.fromkeys(names), body).replace("WITH ", "WITH RECURSIVE ", 1)


def register() -> None:
    _costs()
    _components()
    _flow()
    _far()
    _series()
    _spectra()
    _signatures()
    _new_queries()
    _least_squares()
    _nearness()


def put(name: str, sql: str) -> None:
    if name not in catalogue.QUERIES:
        raise KeyError(name)
    catalogue.ORACLES[name] = sql


def _surface(name: str, seeds: str, toll: str) -> str:
    """A table of least costs and their sources, from seeds (row, col, src) over w (row, col, fr, ...); the least source of equal costs."""
    return f""", {name}(row, col, cost, src) USING KEY (row, col) AS (
    SELECT row, col, CAST(0 AS DOUBLE) AS cost, CAST(src AS DOUBLE) AS src FROM ({seeds})
    UNION SELECT n.row, n.col, n.m.c, n.m.s FROM (SELECT t.row, t.col, MIN({{'c': x.cost + {toll}, 's': x.src}}) AS m FROM {name} x JOIN w y ON y.row = x.row AND y.col = x.col CROSS JOIN o JOIN w t ON t.row = x.row + o.dr AND t.col = x.col + o.dc WHERE t.fr > 0 AND x.cost + {toll} IS NOT NULL GROUP BY t.row, t.col) n
    LEFT JOIN recurring.{name} AS r ON r.row = n.row AND r.col = n.col WHERE r.row IS NULL OR n.m.c < r.cost OR (n.m.c = r.cost AND n.m.s < r.src))"""


def _costs() -> None:
    both = EIGHT + ", w AS (SELECT row, col, f.v AS fr, s.v AS src FROM f JOIN s USING (row, col))"
    seeds = "SELECT row, col, src FROM w WHERE src <> 0"
    costs = both + _surface("d", seeds, "t.fr * o.len * 10")
    out = " SELECT w.row, w.col, {} FROM w LEFT JOIN d ON d.row = w.row AND d.col = w.col"
    put("cost", recursive("sf", costs + out.format(R("COALESCE(cost, -1)"))))
    put("allocate", recursive("sf", costs + out.format(R("COALESCE(cost, -1)") + ", COALESCE(d.src, 0) AS allocation")))
    put("costgrow", recursive("sf", costs + out.format("COALESCE(d.src, 0) AS v")))
    plain = EIGHT + ", w AS (SELECT row, col, 1.0 AS fr, v AS src FROM s)"
    put("distance", recursive("s", plain + _surface("d", seeds, "o.len * 10") + out.format(R("COALESCE(cost, -1)"))))
    put("hinterland", recursive("s", plain + _surface("d", seeds, "o.len") + out.format("COALESCE(d.src, 0) AS v")))
    turned = EIGHT + ", w AS (SELECT row, col, f.v AS fr, s.v AS src, a.v AS way FROM f JOIN s USING (row, col) JOIN a USING (row, col))"
    bend = "COS(ATAN2(o.dc, -o.dr) - RADIANS(t.way))"
    drag = f"(CASE WHEN ABS({bend}) > 1e-12 THEN POWER(t.fr, {bend}) ELSE 1 END)"
    put("varcost", recursive("sfa", turned + _surface("d", seeds, f"{drag} * (o.len * 10)") + out.format(R("COALESCE(cost, -1)"))))
    path = EIGHT + ", w AS (SELECT row, col, v AS fr FROM f)"
    path += _surface("d", "SELECT row, col, 1 AS src FROM w WHERE row = 0 AND col = 0", "t.fr * o.len * 10")
    back = "(CASE WHEN y.fr > 0 THEN y.fr * o.len * 10 END)"
    # The last cell of a path may be a barrier if it's where the path starts, so the way back may enter one.
    path += _surface("e", "SELECT row, col, 1 AS src FROM w WHERE row = 30 AND col = 40", back).replace("WHERE t.fr > 0 AND x.cost + (CASE", "WHERE x.cost + (CASE")
    path += ", g AS (SELECT MAX(cost) AS total FROM d WHERE row = 30 AND col = 40)"
    put("spdist", recursive("f", path + " SELECT w.row, w.col, CAST(CASE WHEN ABS(d.cost + e.cost - total) <= 1e-9 * (1 + total) THEN 1 ELSE 0 END AS DOUBLE) AS v FROM w CROSS JOIN g LEFT JOIN d ON d.row = w.row AND d.col = w.col LEFT JOIN e ON e.row = w.row AND e.col = w.col"))
    put("spdist_places", recursive("f", path + " SELECT w.row, w.col, CAST(CASE WHEN ABS(d.cost + e.cost - total) <= 1e-9 * (1 + total) THEN 1 ELSE 0 END AS DOUBLE) AS v FROM w CROSS JOIN g LEFT JOIN d ON d.row = w.row AND d.col = w.col LEFT JOIN e ON e.row = w.row AND e.col = w.col"))
    steps, last = "", "z0"
    for k in range(1, 5):
        now = f"z{k}"
        steps += f", y{k} AS (SELECT x.row + o.dr AS row, x.col + o.dc AS col, MAX(x.front * EXP(-0.1 * o.len * 10 / 10)) AS x FROM {last} x CROSS JOIN o WHERE x.front > 0 GROUP BY 1, 2), {now} AS (SELECT row, col, fr, GREATEST(best, COALESCE(x / CASE WHEN fr > 0 THEN fr END, 0)) AS best, CASE WHEN x / CASE WHEN fr > 0 THEN fr END > best THEN x / fr ELSE 0 END AS front FROM {last} LEFT JOIN y{k} USING (row, col))"
        last = now
    put("disperse", with_grids("sf", EIGHT + ", z0 AS (SELECT row, col, f.v AS fr, s.v AS best, s.v AS front FROM f JOIN s USING (row, col))" + steps + f" SELECT row, col, {R('best')} FROM z4"))


def _labels(cells: str, steps: str = "o", same: str = "TRUE") -> str:
    """Table l (id, label): the least number that cells n (id, row, col, v) reach."""
    return f""", n AS ({cells}), l(id, label) USING KEY (id) AS (SELECT id, id AS label FROM n
    UNION SELECT m.id, m.label FROM (SELECT b.id, MIN(x.label) AS label FROM l x JOIN n a ON a.id = x.id CROSS JOIN {steps} JOIN n b ON b.row = a.row + dr AND b.col = a.col + dc AND {same} GROUP BY b.id) m JOIN recurring.l AS r ON r.id = m.id WHERE m.label < r.label)"""


def _components() -> None:
    ids = f"SELECT row, col, v, row * {SIZE} + col AS id FROM {{}}"
    four = ", q AS (SELECT * FROM o WHERE dr = 0 OR dc = 0)"
    number = " , k AS (SELECT id, DENSE_RANK() OVER (ORDER BY label) AS no FROM l) SELECT row, col, CAST(COALESCE(no, 0) AS DOUBLE) AS v FROM s LEFT JOIN k ON k.id = s.row * {0} + s.col".format(SIZE)
    put("group_4", recursive("s", EIGHT + four + _labels(ids.format("s WHERE v <> 0"), "q") + number))
    put("group_8", recursive("s", EIGHT + _labels(ids.format("s WHERE v <> 0")) + number))
    put(
        "areafilter",
        recursive("c", EIGHT + _labels(ids.format("c"), "o", "a.v = b.v") + """, t AS (SELECT row, col, v, label FROM n JOIN l USING (id)), small AS (SELECT label FROM t GROUP BY 1 HAVING COUNT(*) < 4),
        h AS (SELECT x.label, y.v, COUNT(*) AS k FROM t x JOIN small USING (label) CROSS JOIN o JOIN t y ON y.row = x.row + dr AND y.col = x.col + dc WHERE y.label <> x.label GROUP BY 1, 2),
        m AS (SELECT label, v AS new, ROW_NUMBER() OVER (PARTITION BY label ORDER BY k DESC, v) AS r FROM h) SELECT row, col, COALESCE(new, v) AS v FROM t LEFT JOIN m ON m.label = t.label AND r = 1"""),
    )


    put(
        "segment",
        recursive("a", EIGHT + four + _labels(ids.format("a"), "q", "ABS(a.v - b.v) <= 30") + """, t AS (SELECT row, col, v, label FROM n JOIN l USING (id)), g AS (SELECT label, COUNT(*) AS k, AVG(v) AS m FROM t GROUP BY 1),
        h AS (SELECT DISTINCT x.label, y.label AS other FROM t x CROSS JOIN q JOIN t y ON y.row = x.row + dr AND y.col = x.col + dc WHERE y.label <> x.label),
        b AS (SELECT h.label, other, ROW_NUMBER() OVER (PARTITION BY h.label ORDER BY (g.m - j.m) * (g.m - j.m), other) AS r FROM h JOIN g ON g.label = h.label AND g.k < 25 JOIN g j ON j.label = other),
        e AS (SELECT label AS x, other AS y FROM b WHERE r = 1 UNION SELECT other, label FROM b WHERE r = 1), z(id, top) USING KEY (id) AS (SELECT label AS id, label AS top FROM g
        UNION SELECT m.id, m.top FROM (SELECT e.y AS id, MIN(z.top) AS top FROM z JOIN e ON e.x = z.id GROUP BY 1) m JOIN recurring.z AS r ON r.id = m.id WHERE m.top < r.top) SELECT row, col, CAST(top AS DOUBLE) AS v FROM t JOIN z ON z.id = t.label"""),
    )


def _flow() -> None:
    dirs = f", e8 AS (SELECT * FROM (VALUES (0, 1, 1, 10.0, 0), (1, 1, 2, SQRT(200.0), 1), (1, 0, 4, 10.0, 2), (1, -1, 8, SQRT(200.0), 3), (0, -1, 16, 10.0, 4), (-1, -1, 32, SQRT(200.0), 5), (-1, 0, 64, 10.0, 6), (-1, 1, 128, SQRT(200.0), 7)) t(dr, dc, code, d, k)), f8 AS (SELECT a.row, a.col, code, dr, dc, (a.v - b.v) / d AS fall, ROW_NUMBER() OVER (PARTITION BY a.row, a.col ORDER BY (a.v - b.v) / d DESC, k) AS r FROM a CROSS JOIN e8 JOIN a b ON b.row = a.row + dr AND b.col = a.col + dc), dir AS (SELECT a.row, a.col, a.row * {SIZE} + a.col AS id, CAST(CASE WHEN fall > 0 THEN code ELSE 0 END AS DOUBLE) AS v, CASE WHEN fall > 0 THEN (a.row + dr) * {SIZE} + a.col + dc END AS next FROM a LEFT JOIN f8 ON f8.row = a.row AND f8.col = a.col AND r = 1)"
    acc = ", walk(start, cur) AS (SELECT id, id FROM dir UNION ALL SELECT start, next FROM walk JOIN dir ON dir.id = cur WHERE next IS NOT NULL), acc AS (SELECT cur AS id, CAST(COUNT(*) AS DOUBLE) AS acc FROM walk GROUP BY 1)"
    put("flow", recursive("a", dirs + acc + " SELECT row, col, COALESCE(v, 0) AS v, acc AS accumulation FROM dir JOIN acc USING (id)"))
    put("watershed", recursive("as", dirs + f", p AS (SELECT row * {SIZE} + col AS id, v AS pour FROM s WHERE v <> 0), walk(start, cur) AS (SELECT id, id FROM dir UNION ALL SELECT start, next FROM walk JOIN dir ON dir.id = cur WHERE next IS NOT NULL AND cur NOT IN (SELECT id FROM p)), hit AS (SELECT start, pour FROM walk JOIN p ON p.id = cur) SELECT row, col, COALESCE(pour, 0) AS v FROM dir LEFT JOIN hit ON start = dir.id"))
    put("pathway", recursive("a", dirs + f", path(id) AS (SELECT id FROM dir WHERE row = 20 AND col = 20 UNION SELECT next FROM path JOIN dir USING (id) WHERE next IS NOT NULL) SELECT row, col, CAST(CASE WHEN dir.id IN (SELECT id FROM path) THEN 1 ELSE 0 END AS DOUBLE) AS v FROM dir"))
    put("pathway_place", recursive("a", dirs + f", path(id) AS (SELECT id FROM dir WHERE row = 20 AND col = 20 UNION SELECT next FROM path JOIN dir USING (id) WHERE next IS NOT NULL) SELECT row, col, CAST(CASE WHEN dir.id IN (SELECT id FROM path) THEN 1 ELSE 0 END AS DOUBLE) AS v FROM dir"))
    from .cases import _stencil

    gx, gy = "((z3 + 2 * z6 + z9 - z1 - 2 * z4 - z7) / 80)", "((z7 + 2 * z8 + z9 - z1 - 2 * z2 - z3) / 80)"
    tilt = f"SIN(ATAN(SQRT({gx} * {gx} + {gy} * {gy})))"
    put("slopelength", recursive("a", dirs + acc + _stencil("a") + f" SELECT z.row, z.col, {R(f'CASE WHEN z.row BETWEEN 1 AND {SIZE - 2} AND z.col BETWEEN 1 AND {SIZE - 2} THEN COALESCE(POWER(acc * 10 / 22.13, 0.4) * POWER({tilt} / 0.0896, 1.3), 0) ELSE 0 END')} FROM z JOIN dir ON dir.row = z.row AND dir.col = z.col JOIN acc USING (id)"))
    put("pitremoval", with_grids("a", EIGHT + " SELECT x.row, x.col, GREATEST(ANY_VALUE(x.v), MIN(y.v)) AS v FROM a x CROSS JOIN o LEFT JOIN a y ON y.row = x.row + dr AND y.col = x.col + dc GROUP BY 1, 2"))


def _far() -> None:
    """Sight lines, windows and kernels."""
    eye = "20"  # the observer's row and column, at x 1200 and y 4800
    put("viewshed", with_grids("a", f", e AS (SELECT v + 1.7 AS h FROM a WHERE row = {eye} AND col = {eye}), t AS (SELECT row, col, row - {eye} AS dr, col - {eye} AS dc, (v - h) / SQRT(CAST((row - {eye}) * (row - {eye}) + (col - {eye}) * (col - {eye}) AS DOUBLE)) AS angle FROM a, e WHERE row <> {eye} OR col <> {eye}), p AS (SELECT t.*, UNNEST(RANGE(1, GREATEST(ABS(dr), ABS(dc)))) AS s, GREATEST(ABS(dr), ABS(dc)) AS n FROM t), m AS (SELECT p.row, p.col, MAX(q.angle) AS hi, ANY_VALUE(p.angle) AS own FROM p JOIN t q ON q.row = CAST(ROUND(p.dr / CAST(n AS DOUBLE) * s) AS INT) + {eye} AND q.col = CAST(ROUND(p.dc / CAST(n AS DOUBLE) * s) AS INT) + {eye} GROUP BY 1, 2) SELECT a.row, a.col, CAST(CASE WHEN hi > own THEN 0 ELSE 1 END AS DOUBLE) AS v FROM a LEFT JOIN m USING (row, col)"))
    kernel = ", k AS (SELECT dr, dc, EXP(-SQRT(dr * dr + dc * dc) / 1.5) AS w FROM range(-3, 4) t(dr), range(-3, 4) u(dc) WHERE dr * dr + dc * dc <= 9)"
    put("pollination", with_grids("c", kernel + f", t AS (SELECT row, col, CASE v WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 ELSE 0 END AS n, CASE v WHEN 1 THEN 0.3 WHEN 3 THEN 0.8 ELSE 0 END AS f FROM c), x AS (SELECT t.row, t.col, ANY_VALUE(t.n) AS n, ANY_VALUE(t.f) AS f, SUM(u.f * w) AS xw, SUM(w) AS w FROM t CROSS JOIN k JOIN t u ON u.row = t.row + dr AND u.col = t.col + dc GROUP BY 1, 2), g AS (SELECT row, col, f, CASE WHEN xw > 0 THEN n * xw / w / xw ELSE 0 END AS g FROM x) SELECT a.row, a.col, {R('ANY_VALUE(a.f) * SUM(b.g * w)')} FROM g a CROSS JOIN k JOIN g b ON b.row = a.row + dr AND b.col = a.col + dc GROUP BY 1, 2"))
    harm = ", k AS (SELECT dr, dc, 1 - SQRT(dr * dr + dc * dc) / 3.0 AS w FROM range(-3, 4) t(dr), range(-3, 4) u(dc) WHERE dr * dr + dc * dc <= 9), h AS (SELECT s.row + dr AS row, s.col + dc AS col, SUM(s.v * w) AS t FROM s CROSS JOIN k WHERE s.v > 0 GROUP BY 1, 2)"
    d = "POWER(COALESCE(t, 0) * CASE v WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.9 ELSE 0 END, 2.5)"
    put("habitat_quality", with_grids("cs", harm + f" SELECT c.row, c.col, {R(f'CASE v WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 ELSE 0 END * (1 - {d} / ({d} + POWER(0.5, 2.5)))')} FROM c LEFT JOIN h USING (row, col)"))
    axes, best = [], []
    for k, (part, order, step) in enumerate((("row", "col", "10.0"), ("col", "row", "10.0"), ("row - col", "col", "SQRT(200.0)"), ("row + col", "col", "SQRT(200.0)"))):
        over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {{}})"
        for n, fn, frame in (("a", "LAST_VALUE", "UNBOUNDED PRECEDING AND 1 PRECEDING"), ("b", "FIRST_VALUE", "1 FOLLOWING AND UNBOUNDED FOLLOWING")):
            axes += [f"{fn}(CASE WHEN v <> 0 THEN {e} END IGNORE NULLS) {over.format(frame)} AS {n}{k}{c}" for e, c in (("v", "z"), (order, "p"))]
        da, db = f"(({order} - a{k}p) * {step})", f"((b{k}p - {order}) * {step})"
        best.append(f"SELECT row, col, ABS(b{k}z - a{k}z) / ({da} + {db}) AS slope, {k} AS k, (a{k}z * {db} + b{k}z * {da}) / ({da} + {db}) AS z FROM t WHERE a{k}z IS NOT NULL AND b{k}z IS NOT NULL")
    put("intercon", with_grids("s", f", t AS (SELECT *, {', '.join(axes)} FROM s), u AS ({' UNION ALL '.join(best)}), m AS (SELECT row, col, z, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY slope DESC, k) AS r FROM u) SELECT s.row, s.col, {R('CASE WHEN s.v <> 0 THEN s.v ELSE COALESCE(z, 0) END')} FROM s LEFT JOIN m ON m.row = s.row AND m.col = s.col AND r = 1"))
    c, s = math.cos(math.radians(30)), math.sin(math.radians(30))
    half = SIZE / 2
    put("transform", with_grids("a", f", t AS (SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col FROM range({SIZE}) x(i), range({SIZE}) y(j)) SELECT t.row, t.col, a.v FROM t LEFT JOIN a ON a.col = FLOOR((t.col - {half}) * CAST({c!r} AS DOUBLE) + (t.row - {half}) * CAST({s!r} AS DOUBLE) + {half} + 0.5) AND a.row = FLOOR((t.row - {half}) * CAST({c!r} AS DOUBLE) - (t.col - {half}) * CAST({s!r} AS DOUBLE) + {half} + 0.5)"))
    place = lambda n: f"LEAST({SIZE // 2 - 1}.0, GREATEST(0.0, ({n} + 0.5) * 0.5 - 0.5))"
    put("landsat_upsample", with_grids("a", f", l AS (SELECT row // 2 AS row, col // 2 AS col, AVG(v) AS v FROM a GROUP BY 1, 2), t AS (SELECT i, j, {place('i')} AS fr, {place('j')} AS fc FROM range({SIZE}) x(i), range({SIZE}) y(j)), w AS (SELECT i, j, FLOOR(fr) + p AS r, FLOOR(fc) + q AS c, (CASE WHEN p = 1 THEN fr - FLOOR(fr) ELSE 1 - fr + FLOOR(fr) END) * (CASE WHEN q = 1 THEN fc - FLOOR(fc) ELSE 1 - fc + FLOOR(fc) END) AS w FROM t, range(2) x(p), range(2) y(q)) SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, CASE WHEN MAX(CASE WHEN w > 0 AND l.v IS NULL THEN 1 ELSE 0 END) = 0 THEN ROUND(SUM(w * l.v), 6) END AS v FROM w LEFT JOIN l ON l.row = w.r AND l.col = w.c GROUP BY i, j"))
    put("ortho", with_grids("ab", f" SELECT b.row, b.col, a.v FROM b LEFT JOIN a ON a.row = CAST(ROUND(b.row + (b.row - {half}) * (COALESCE(b.v, 0) / 7000.0)) AS INT) AND a.col = CAST(ROUND(b.col + (b.col - {half}) * (COALESCE(b.v, 0) / 7000.0)) AS INT)"))
    radius = "6378137.0"
    lat = lambda y: f"DEGREES(2 * ATAN(EXP({y} / {radius})) - PI() / 2)"
    extent = f", e AS (SELECT DEGREES(1000 / {radius}) AS x0, DEGREES({1000 + SIZE * 10} / {radius}) AS x1, {lat(f'{5000.0 - SIZE * 10}')} AS y0, {lat('5000.0')} AS y1), k AS (SELECT *, (x1 - x0) / {SIZE} AS size FROM e), t AS (SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, x0 + j * size + size / 2 AS lon, y1 - i * size - size / 2 AS lat FROM k, range({2 * SIZE}) x(i), range({SIZE}) y(j) WHERE i < ROUND((y1 - y0) / size))"
    put("project", with_grids("a", extent + f" SELECT t.row, t.col, a.v FROM t LEFT JOIN a ON a.col = FLOOR((RADIANS(lon) * {radius} - 1000) / 10) AND a.row = FLOOR((LN(TAN(PI() / 4 + RADIANS(lat) / 2)) * {radius} - 5000) / -10)"))
    from .cases import POINTS

    put("trend", with_grids("a", POINTS + f", z AS (SELECT REGR_SXX(x, y) AS yy, REGR_SXX(y, x) AS xx, REGR_SXY(x, y) AS xy, REGR_SXY(value, x) AS xv, REGR_SXY(value, y) AS yv, AVG(x) AS mx, AVG(y) AS my, AVG(value) AS mv FROM pt), k AS (SELECT (xv * yy - yv * xy) / (xx * yy - xy * xy) AS bx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS by_, mx, my, mv FROM z) SELECT row, col, ROUND(mv + bx * (1000 + col * 10 - mx) + by_ * (5000 - row * 10 - my), 6) AS v FROM a, k"))
    at = " JOIN pc ON pc.row = {0}.row AND pc.col = {0}.col WHERE {0}.v IS NOT NULL"
    put("species_distribution", with_grids("ap", POINTS + "".join(f", q{g} AS (SELECT QUANTILE_CONT({g}.v, 0.05) AS lo, QUANTILE_CONT({g}.v, 0.95) AS hi FROM {g}{at.format(g)})" for g in "ap") + " SELECT row, col, ((CASE WHEN a.v BETWEEN qa.lo AND qa.hi THEN 1 ELSE 0 END) + (CASE WHEN p.v BETWEEN qp.lo AND qp.hi THEN 1 ELSE 0 END)) / 2.0 AS v FROM a JOIN p USING (row, col), qa, qp"))


def _series() -> None:
    from .cases import _series_sql

    def arrays(salt: int, n: int, name: str) -> str:
        return f", {name}s AS ({_series_sql(salt)}), {name} AS (SELECT k.row, k.col, CAST(i AS INT) AS t, COALESCE(v, 0) AS v FROM (SELECT DISTINCT row, col FROM {name}s) k CROSS JOIN range({n}) r(i) LEFT JOIN {name}s ON {name}s.row = k.row AND {name}s.col = k.col AND {name}s.t = i)"

    two = "WITH z AS (SELECT 1)" + arrays(0, 24, "y") + arrays(3, 24, "x") + ", j AS (SELECT row, col, t, y.v AS y, x.v AS x FROM y JOIN x USING (row, col, t))"
    put("multi_reg", two + f" SELECT row, col, {R('COALESCE(REGR_R2(y, x), 0)', 'r2')} FROM j GROUP BY 1, 2")
    put("mlr", two + f", c AS (SELECT row, col, CORR(y, t) AS a, CORR(y, x) AS b, CORR(t, x) AS c FROM j GROUP BY 1, 2) SELECT row, col, {R('(a * a + b * b - 2 * a * b * c) / (1 - c * c)', 'r2')} FROM c")
    root = "SQRT(3.0)"
    low = [f"((1 + {root}) / 8)", f"((3 + {root}) / 8)", f"((3 - {root}) / 8)", f"((1 - {root}) / 8)"]
    high = [f"({'-' if k % 2 else ''}{x})" for k, x in enumerate(reversed(low))]
    body, last = "WITH z AS (SELECT 1)" + arrays(0, 24, "y") + ", l0 AS (SELECT row, col, t, v AS s FROM y)", "l0"
    for j in range(3):
        taps = lambda f, gap=2**j: " + ".join(f"{c} * a[(t + {24 * 4 - k * gap}) % 24 + 1]" for k, c in enumerate(f))
        body += f", a{j} AS (SELECT *, LIST(s) OVER (PARTITION BY row, col ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM {last}), l{j + 1} AS (SELECT row, col, t, {taps(low)} AS s, {taps(high)} AS d FROM a{j})"
        last = f"l{j + 1}"
    put("modwt_db4", body + f" SELECT row, col, t, {R('l1.d', 'd1')}, {R('l2.d', 'd2')}, {R('l3.d', 'd3')}, {R('l3.s', 'smooth')} FROM l1 JOIN l2 USING (row, col, t) JOIN l3 USING (row, col, t)")
    q = lambda a: f"[{a}[k] + {a}[k % 12 + 1] + {a}[(k + 1) % 12 + 1] FOR k IN RANGE(1, 13)]"
    clim = "WITH z AS (SELECT 1)" + arrays(0, 12, "y") + arrays(3, 12, "x") + f", l AS (SELECT row, col, t, p FROM (SELECT row, col, LIST(v ORDER BY t) AS t FROM y GROUP BY 1, 2) JOIN (SELECT row, col, LIST(v ORDER BY t) AS p FROM x GROUP BY 1, 2) USING (row, col)), m AS (SELECT *, [e / 3 FOR e IN {q('t')}] AS tq, {q('p')} AS pq, LIST_AVG(t) AS mt, LIST_AVG(p) AS mp, LIST_MAX(t) - LIST_MIN(t) AS span FROM l), n AS (SELECT *, LIST_POSITION(pq, LIST_MAX(pq)) AS wet, LIST_POSITION(pq, LIST_MIN(pq)) AS dry, LIST_POSITION(tq, LIST_MAX(tq)) AS warm, LIST_POSITION(tq, LIST_MIN(tq)) AS cold FROM m)"
    e = ["mt", "span", "CASE WHEN span <> 0 THEN 100 ELSE 0 END", "LIST_STDDEV_POP(t) * 100", "LIST_MAX(t)", "LIST_MIN(t)", "span", *(f"tq[{k}]" for k in ("wet", "dry", "warm", "cold")), "mp * 12", "LIST_MAX(p)", "LIST_MIN(p)", "CASE WHEN mp > 0 THEN LIST_STDDEV_POP(p) / mp * 100 ELSE 0 END", *(f"pq[{k}]" for k in ("wet", "dry", "warm", "cold"))]
    put("bioclimvars", clim + f" SELECT row, col, {', '.join(R(x, f'bio{k + 1}') for k, x in enumerate(e))} FROM n")


PX = ", px AS (SELECT row, col, a.v AS a, p.v AS p, q.v AS q FROM a JOIN p USING (row, col) JOIN q USING (row, col))"
ENDS = ", e AS (SELECT * FROM (VALUES (1, 600.0, 0.2, 0.8), (2, 650.0, 0.8, 0.2), (3, 700.0, 0.5, 0.5)) t(k, a, b, c))"


def _spectra() -> None:
    put("hypersam", with_grids("apq", PX + ENDS + f", g AS (SELECT row, col, k, ACOS(GREATEST(-1, LEAST(1, (px.a * e.a + p * b + q * c) / (SQRT(px.a * px.a + p * p + q * q) * SQRT(e.a * e.a + b * b + c * c))))) AS g FROM px, e), m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY g, k) AS r FROM g) SELECT row, col, CAST(CASE WHEN g <= 0.001 THEN k ELSE 0 END AS DOUBLE) AS v, {R('g', 'angle')} FROM m WHERE r = 1"))
    put("endsig", f"WITH z AS (SELECT 1){ENDS}, f AS (SELECT *, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM e) SELECT CAST(f.k AS INT) AS a, CAST(g.k AS INT) AS b, {R('ACOS((f.a * g.a + f.b * g.b + f.c * g.c) / SQRT((f.a * f.a + f.b * f.b + f.c * f.c) * (g.a * g.a + g.b * g.b + g.c * g.c)))', 'angle')}, {R('(f.x - g.x) * LN(f.x / g.x) + (f.y - g.y) * LN(f.y / g.y) + (f.z - g.z) * LN(f.z / g.z)', 'sid')} FROM f JOIN f g ON g.k > f.k")
    fit = "SQRT((POWER(a - 600 * f1 - 650 * f2, 2) + POWER(p - 0.2 * f1 - 0.8 * f2, 2) + POWER(q - 0.8 * f1 - 0.2 * f2, 2)) / 3)"
    out = f" SELECT row, col, {R('f1', 'f1')}, {R('f2', 'f2')}, {R(fit, 'residual')} FROM w"
    # Least squares over two spectra: the normal equations' determinant is that of the spectra's cross product, which loses no digits.
    cross = "(POWER(600 * 0.8 - 650 * 0.2, 2) + POWER(600 * 0.2 - 650 * 0.8, 2) + POWER(0.2 * 0.2 - 0.8 * 0.8, 2))"
    solve = f"((600 * 0.8 - 650 * 0.2) * (a * 0.8 - 650 * p) + (600 * 0.2 - 650 * 0.8) * (a * 0.2 - 650 * q) + (0.2 * 0.2 - 0.8 * 0.8) * (p * 0.2 - 0.8 * q)) / {cross}", f"((600 * 0.8 - 650 * 0.2) * (600 * p - a * 0.2) + (600 * 0.2 - 650 * 0.8) * (600 * q - a * 0.8) + (0.2 * 0.2 - 0.8 * 0.8) * (0.2 * q - p * 0.8)) / {cross}"
    put("unmix", with_grids("apq", PX + f", u AS (SELECT *, GREATEST(0, {solve[0]}) AS g1, GREATEST(0, {solve[1]}) AS g2 FROM px), w AS (SELECT *, CASE WHEN g1 + g2 > 0 THEN g1 / (g1 + g2) ELSE 0 END AS f1, CASE WHEN g1 + g2 > 0 THEN g2 / (g1 + g2) ELSE 0 END AS f2 FROM u)" + out))
    share = "GREATEST(0, LEAST(1, ((a - 650) * -50 + (p - 0.8) * -0.6 + (q - 0.2) * 0.6) / (2500 + 0.36 + 0.36)))"
    put("hyperunmix", with_grids("apq", PX + f", u AS (SELECT *, {share} AS f1 FROM px), w AS (SELECT *, 1 - f1 AS f2 FROM u)" + out))
    dot = "((600 * 650 + 0.2 * 0.8 + 0.8 * 0.2) / (650 * 650 + 0.8 * 0.8 + 0.2 * 0.2))"
    put("hyperosp", with_grids("apq", PX + f" SELECT row, col, {R(f'a * (600 - 650 * {dot}) + p * (0.2 - 0.8 * {dot}) + q * (0.8 - 0.2 * {dot})')} FROM px"))
    m = _inverse("c00", "c01", "c02", "c11", "c12", "c22")
    cov = ", s AS (SELECT AVG(a) AS m0, AVG(p) AS m1, AVG(q) AS m2, VAR_SAMP(a) AS c00, COVAR_SAMP(a, p) AS c01, COVAR_SAMP(a, q) AS c02, VAR_SAMP(p) AS c11, COVAR_SAMP(p, q) AS c12, VAR_SAMP(q) AS c22 FROM px), i AS (SELECT *, 600 - m0 AS d0, 0.2 - m1 AS d1, 0.8 - m2 AS d2, " + ", ".join(f"{x} AS i{k}" for k, x in m.items()) + " FROM s), w AS (SELECT *, i00 * d0 + i01 * d1 + i02 * d2 AS w0, i01 * d0 + i11 * d1 + i12 * d2 AS w1, i02 * d0 + i12 * d1 + i22 * d2 AS w2 FROM i)"
    put("hyperusp", with_grids("apq", PX + cov + f" SELECT row, col, {R('((a - m0) * w0 + (p - m1) * w1 + (q - m2) * w2) / (d0 * w0 + d1 * w1 + d2 * w2)')} FROM px, w"))
    line = "((a + q) / 2)"
    rel = f"(CASE WHEN GREATEST(p, {line}) > 1e-15 THEN 1 - p / GREATEST(p, {line}) ELSE 0 END)"
    put("hyperabsorb", with_grids("apq", PX + f" SELECT row, col, {R(f'GREATEST(0, {rel})', 'depth')}, {R(f'CASE WHEN {rel} > 0 THEN 1 ELSE 0 END', 'width')} FROM px"))
    bands = (("a", "p", None), ("p", "a", "q"), ("q", "p", None))
    rows = " UNION ALL ".join(f"SELECT {k} AS band, AVG({b}) / STDDEV_SAMP({b}) AS snr, {f'LEAST(CORR({b}, {x}), CORR({b}, {y}))' if y else f'CORR({b}, {x})'} AS c FROM px" for k, (b, x, y) in enumerate(bands))
    put("screen", with_grids("apq", PX + f", s AS ({rows}) SELECT CAST(band AS INT) AS band, {R('snr', 'snr')}, {R('c', 'correlation')}, ABS(snr) >= 10 AND c >= 0.5 AS ok FROM s"))
    wide = 1 << (SIZE - 1).bit_length()
    turn = lambda k, n: f"2 * PI() * {k} * {n} / {wide}"
    dft = lambda g: f", k AS (SELECT CAST(i AS INT) AS k FROM range({wide}) r(i)), x AS (SELECT row, k, SUM(v * COS({turn('k', 'col')})) AS re, SUM(v * SIN({turn('k', 'col')})) AS im FROM {g} CROSS JOIN k GROUP BY 1, 2), y AS (SELECT j.k AS row, x.k AS col, SUM(re * COS({turn('j.k', 'row')}) - im * SIN({turn('j.k', 'row')})) AS re, SUM(re * SIN({turn('j.k', 'row')}) + im * COS({turn('j.k', 'row')})) AS im FROM x CROSS JOIN k j GROUP BY 1, 2)"
    polar = f" SELECT row, col, {R('SQRT(re * re + im * im)', 'magnitude')}, {R('CASE WHEN ATAN2(im, re) < -3.14159 THEN PI() ELSE ATAN2(im, re) END', 'phase')} FROM y"
    put("fourier", with_grids("a", dft("a") + polar))
    put("fourier_long_lines", with_grids("a", dft("a") + polar))
    far = f"SQRT(POWER(LEAST(row, {wide} - row), 2) + POWER(LEAST(col, {wide} - col), 2))"
    shares = {"filtfq": "1 / (1 + POWER(d / 30, 4))", "filtfq_high": "1 - 1 / (1 + POWER(d / 10, 2))", "filtfq_band": "1 - 1 / (1 + POWER(d * 6 / CASE WHEN d * d = 144 THEN 1e-9 ELSE d * d - 144 END, 4))"}
    back = f", p AS (SELECT row, j.k AS col, SUM(re * COS({turn('j.k', 'h.col')}) + im * SIN({turn('j.k', 'h.col')})) / {wide} AS re, SUM(im * COS({turn('j.k', 'h.col')}) - re * SIN({turn('j.k', 'h.col')})) / {wide} AS im FROM h CROSS JOIN k j GROUP BY 1, 2), z AS (SELECT j.k AS row, col, SUM(re * COS({turn('j.k', 'p.row')}) + im * SIN({turn('j.k', 'p.row')})) / {wide} AS v FROM p CROSS JOIN k j GROUP BY 1, 2) SELECT b.row, b.col, {R('z.v')} FROM b JOIN z USING (row, col) WHERE b.v IS NOT NULL"
    for name, share in shares.items():
        put(name, with_grids("b", dft("b") + f", h AS (SELECT row, col, re * s AS re, im * s AS im FROM (SELECT *, {share} AS s FROM (SELECT *, {far} AS d FROM y)))" + back))


def _inverse(a: str, b: str, c: str, d: str, e: str, f: str) -> dict[str, str]:
    """The inverse of the symmetric matrix a b c / b d e / c e f."""
    det = _determinant(a, b, c, d, e, f)
    parts = {"00": f"{d} * {f} - {e} * {e}", "01": f"{c} * {e} - {b} * {f}", "02": f"{b} * {e} - {c} * {d}", "11": f"{a} * {f} - {c} * {c}", "12": f"{b} * {c} - {a} * {e}", "22": f"{a} * {d} - {b} * {b}"}
    return {k: f"(({x}) / {det})" for k, x in parts.items()}


def _determinant(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    return f"({a} * ({d} * {f} - {e} * {e}) - {b} * ({b} * {f} - {e} * {c}) + {c} * ({b} * {e} - {d} * {c}))"


COVARIANCE = ("c00", "c01", "c02", "c11", "c12", "c22")
SIG = (
    PX + ", tr AS (SELECT px.*, CAST(c.v AS INT) AS k FROM px JOIN c USING (row, col) WHERE (row + col) % 3 = 0 AND CAST(c.v AS INT) <> 0), sg AS (SELECT k, COUNT(*) / 1000 AS prior, AVG(a) AS m0, AVG(p) AS m1, AVG(q) AS m2, VAR_POP(a) + 1e-3 AS c00, COVAR_POP(a, p) + 1e-3 AS c01, COVAR_POP(a, q) + 1e-3 AS c02, VAR_POP(p) + 1e-3 AS c11, COVAR_POP(p, q) + 1e-3 AS c12, VAR_POP(q) + 1e-3 AS c22 FROM tr GROUP BY 1), si AS (SELECT *, "
    + _determinant(*COVARIANCE) + " AS det, " + ", ".join(f"{x} AS i{k}" for k, x in _inverse(*COVARIANCE).items())
    + " FROM sg), di AS (SELECT row, col, k, prior, det, d0 * d0 * i00 + d1 * d1 * i11 + d2 * d2 * i22 + 2 * (d0 * d1 * i01 + d0 * d2 * i02 + d1 * d2 * i12) AS d, SQRT((d0 * d0 / c00 + d1 * d1 / c11 + d2 * d2 / c22) / 3) AS z FROM (SELECT *, a - m0 AS d0, p - m1 AS d1, q - m2 AS d2 FROM px, si))"
)
CLASSES = range(1, 6)


def _spread(column: str, prefix: str) -> str:
    return ", ".join(R(f"MAX(CASE WHEN k = {k} THEN {column} END)", f"{prefix}{k}") for k in CLASSES)


def _signatures() -> None:
    pick = ", m AS (SELECT row, col, k, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY {}, k) AS r FROM di) SELECT row, col, CAST(k AS DOUBLE) AS v FROM m WHERE r = 1"
    put("mahalclass", with_grids("apqc", SIG + pick.format("d")))
    put("maxlike", with_grids("apqc", SIG + pick.format("LN(det) + d")))
    post = ", li AS (SELECT *, {} - 0.5 * LN(det) - 0.5 * d AS s FROM di), ex AS (SELECT *, EXP(s - MAX(s) OVER (PARTITION BY row, col)) AS e FROM li), po AS (SELECT row, col, k, e / SUM(e) OVER (PARTITION BY row, col) AS p FROM ex)"
    n = len(CLASSES)
    put("bayclass", with_grids("apqc", SIG + post.format("LN(prior)") + f" SELECT row, col, {_spread('p', 'p')}, {R(f'1 - (MAX(p) - 1.0 / {n}) / (1 - 1.0 / {n})', 'uncertainty')} FROM po GROUP BY 1, 2"))
    put("belclass", with_grids("apqc", SIG + post.format("0") + f", en AS (SELECT *, -SUM(CASE WHEN p > 0 THEN p * LN(p) ELSE 0 END) OVER (PARTITION BY row, col) / LN({n}.0) AS h FROM po) SELECT row, col, {_spread('p * (1 - h)', 'b')}, {R('ANY_VALUE(h)', 'ignorance')} FROM en GROUP BY 1, 2"))
    put("fuzclass", with_grids("apqc", SIG + f", fu AS (SELECT row, col, k, GREATEST(0, 1 - z / 1.96) AS f FROM di), fs AS (SELECT *, SUM(f) OVER (PARTITION BY row, col) AS s FROM fu) SELECT row, col, {_spread('CASE WHEN s > 0 THEN f / s ELSE 0 END', 'm')}, {R('1 - MAX(f)', 'uncertainty')} FROM fs GROUP BY 1, 2"))
    put("knn", with_grids("apqc", SIG.split(", sg AS")[0] + ", di AS (SELECT px.row, px.col, k, ROW_NUMBER() OVER (PARTITION BY px.row, px.col ORDER BY (px.a - tr.a) * (px.a - tr.a) + (px.p - tr.p) * (px.p - tr.p) + (px.q - tr.q) * (px.q - tr.q), tr.row, tr.col) AS r FROM px, tr), vo AS (SELECT row, col, k, COUNT(*) AS n, MIN(r) AS first FROM di WHERE r <= 5 GROUP BY 1, 2, 3), m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY n DESC, first) AS w FROM vo) SELECT row, col, CAST(k AS DOUBLE) AS v FROM m WHERE w = 1"))
    put("knnregress", with_grids("apqs", ", x AS (SELECT row, col, p.v AS p, q.v AS q FROM p JOIN q USING (row, col) WHERE p.v IS NOT NULL AND q.v IS NOT NULL), t AS (SELECT x.*, a.v FROM x JOIN a USING (row, col) JOIN s USING (row, col) WHERE a.v IS NOT NULL AND s.v <> 0), d AS (SELECT x.row, x.col, t.v, SQRT((x.p - t.p) * (x.p - t.p) + (x.q - t.q) * (x.q - t.q)) AS d, t.row AS r, t.col AS c FROM x, t), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY row, col ORDER BY d, r, c) AS n FROM d) SELECT row, col, " + R("CASE WHEN MIN(d) < 1e-10 THEN MAX(CASE WHEN n = 1 THEN v END) ELSE SUM(v / GREATEST(d, 1e-12)) / SUM(1 / GREATEST(d, 1e-12)) END") + " FROM k WHERE n <= 5 GROUP BY 1, 2"))
    pair = SIG.split(", di AS")[0] + ", pa AS (SELECT x.k AS a, y.k AS b, x.m0 - y.m0 AS d0, x.m1 - y.m1 AS d1, x.m2 - y.m2 AS d2, " + ", ".join(f"x.{i}{c} AS x{i}{c}, y.{i}{c} AS y{i}{c}" for i in "ci" for c in ("00", "01", "02", "11", "12", "22")) + ", x.det AS xdet, y.det AS ydet FROM si x, si y)"
    quad = lambda i: f"(d0 * d0 * {i('00')} + d1 * d1 * {i('11')} + d2 * d2 * {i('22')} + 2 * (d0 * d1 * {i('01')} + d0 * d2 * {i('02')} + d1 * d2 * {i('12')}))"
    mid = [f"((xc{k} + yc{k}) / 2)" for k in ("00", "01", "02", "11", "12", "22")]
    inverse = _inverse(*mid)
    bh = f"({quad(inverse.__getitem__)} / 8 + 0.5 * (LN({_determinant(*mid)}) - 0.5 * (LN(xdet) + LN(ydet))))"
    put("sepsig", with_grids("apqc", pair + f" SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, {R(bh, 'bhattacharyya')}, {R(f'2 * (1 - EXP(-{bh}))', 'jm')} FROM pa WHERE a < b"))
    off = " + ".join(f"{2 if i != j else 1} * (xc{i}{j} - yc{i}{j}) * (yi{i}{j} - xi{i}{j})" for i in range(3) for j in range(i, 3))
    both = quad(lambda c: f"(xi{c} + yi{c})")
    div = f"(0.5 * ({off}) + 0.5 * {both})"
    put("sigcomp", with_grids("apqc", pair + f" SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, {R('SQRT(d0 * d0 + d1 * d1 + d2 * d2)', 'euclid')}, {R(div, 'divergence')}, {R(f'2000 * (1 - EXP(-{div} / 8))', 'transformed')} FROM pa"))


def _new_queries() -> None:
    """Operators that had no query."""
    add("weight", lambda s, d: s.createDataFrame([(k + 1, w) for k, w in enumerate(create("WEIGHT")([[1, 2, 4], ["1/2", 1, 2], ["1/4", "1/2", 1]])["weights"])], "criterion int, weight double"), f"SELECT CAST(k AS INT) AS criterion, {R('w', 'weight')} FROM (VALUES (1, 4 / 7.0), (2, 2 / 7.0), (3, 1 / 7.0)) t(k, w)")
    add("cca", lambda s, d: create("CCA")([grid(s, d, g) for g in "ac"], [grid(s, d, g) for g in "pq"], num_components=2))
    places = [(1, 0.0, 0.0), (2, 470.0, 0.0), (3, 0.0, 470.0), (4, 470.0, 470.0), (5, 210.0, 260.0)]

    def affine(s, d):
        # Target places lie 20 to the east and 30 to the south of their sources, so all triangles have one affine map.
        gcps = s.createDataFrame([(i, 1000 + x, 5000 - y, 1020 + x, 4970 - y) for i, x, y in places], "id int, sx double, sy double, dx double, dy double")
        return create("LOCALAFFINE")(grid(s, d, "a"), gcps)

    add("localaffine", affine, with_grids("a", f" SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, a.v FROM range({SIZE}) x(r) CROSS JOIN range({SIZE}) y(c) LEFT JOIN a ON a.row = r - 3 AND a.col = c - 2"))
    add("tinprep", lambda s, d: create("TINPREP")(grid(s, d, "s").with_cells(grid(s, d, "s").df.where("v <> 0"))).groupBy("chain").agg(F.count("*").alias("points")), None)
    every = f" SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, {{}} AS v FROM range({SIZE}) x(r) CROSS JOIN range({SIZE}) y(c) LEFT JOIN {{}} g ON g.row = r AND g.col = c"

    def trip(name: str, op: str, g: str, value: str, **params) -> None:
        """A grid written to a file's form by the operator's own sink, and read again."""

        def run(s, d):
            own = grid(s, d, g)
            return create(op)(create(op)(own, direction="export"), **params).where("band = 0").select(*KEY, "v")

        add(name, run, with_grids(g, every.format(value, g)))

    for op in ("ENVIIDRIS", "ERMIDRIS", "GRASSIDR", "SPLUSIDRIS", "STATIDRIS", "NETCDF", "RST"):
        trip(f"{op.lower()}_form", op, "b", "g.v")
    trip("bmpidris_form", "BMPIDRIS", "c", "COALESCE(g.v, 0)")
    trip("erdidris_form", "ERDIDRIS", "c", "COALESCE(g.v, 0)")

    def picture(s, d):
        """Within a grey level, for the form rounds frequencies."""
        own = grid(s, d, "c")
        back = create("JPGIDRIS")(create("JPGIDRIS")(own, direction="export")).select(*KEY, F.col("v").alias("w"))
        return own.df.join(back, KEY).agg(F.count("*").alias("cells"), (F.max(F.abs(F.col("v") - F.col("w"))) <= 1).alias("near"))

    add("jpgidris_form", picture, with_grids("c", " SELECT COUNT(*) AS cells, TRUE AS near FROM c"))

    def flat(s, d):
        files = create("ENVIIDRIS")(grid(s, d, "b"), direction="export").where("path like '%.img'")
        cells = create("GENERICRASTER")(files, interleave="BSQ", cols=SIZE, rows=SIZE, data_type="Float64")
        return cells.select(*KEY, F.when(F.col("v") != -9999.0, F.col("v")).alias("v"))

    add("genericraster_form", flat, with_grids("b", every.format("g.v", "b")))

    def scene(op):
        return lambda s, d: create(op)(create("GEOTIFF")(grid(s, d, "b"), direction="export")).select(*KEY, "v")

    for op in ("LANDSAT", "SENTINEL", "SPOT", "IKONOS", "QUICKBIRD", "WORLDVIEW", "GEOEYE", "DIGITALGLOBE", "RADARSAT"):
        add(f"{op.lower()}_scene", scene(op), with_grids("b", every.format("g.v", "b")))

    def outlines(op):
        def run(s, d):
            own = grid(s, d, "s")
            edges = create("RASTERVECTOR")(own).where("value <> 0")
            back = create(op)(create(op)(edges, direction="export"))
            return create("VECTORRASTER")(back, own)

        return run

    for op in ("ARCIDRIS", "DXFIDRIS", "KMLIDRIS", "MIFIDRIS", "SHAPEIDR"):
        add(f"{op.lower()}_form", outlines(op), with_grids("s", every.format("CAST(CASE WHEN g.v <> 0 THEN 1 ELSE 0 END AS DOUBLE)", "s")))



def _least_squares() -> None:
    """Fits of series, from their normal equations."""
    from .cases import _series_sql

    S = "WITH s AS (" + _series_sql() + ")"
    full = ", g AS (SELECT row, col, CAST(i AS INT) AS t FROM (SELECT DISTINCT row, col FROM s), range(24) r(i)), f AS (SELECT row, col, t, COALESCE(v, 0) AS v, COS(2 * PI() * t / {p}) AS c, SIN(2 * PI() * t / {p}) AS s FROM g LEFT JOIN s USING (row, col, t))"
    # The six terms don't depend on the data: (X'X)^-1 X' is a table of weights by step.
    t = [k for k in range(24)]
    terms = [[1.0, k, math.cos(2 * math.pi * k / 12), math.sin(2 * math.pi * k / 12), k * math.cos(2 * math.pi * k / 12), k * math.sin(2 * math.pi * k / 12)] for k in t]
    weights = np.linalg.solve(np.array(terms).T @ np.array(terms), np.array(terms).T)
    table = ", ".join(f"({k}, {float(weights[1][k])!r}, {float(weights[2][k])!r}, {float(weights[3][k])!r})" for k in t)
    put("sta", S + full.format(p=12) + f", w AS (SELECT * FROM (VALUES {table}) x(t, w1, w2, w3)), b AS (SELECT row, col, SUM(v * w1) AS b1, SUM(v * w2) AS b2, SUM(v * w3) AS b3 FROM f JOIN w USING (t) GROUP BY 1, 2) SELECT row, col, {R('b1', 'trend')}, {R('SQRT(b2 * b2 + b3 * b3)', 'amplitude')}, {R('ATAN2(b3, b2)', 'phase')} FROM b")
    # One harmonic: three terms by Cramer's rule, ten rounds. A value whose residual is over 0.4 of the range goes, unless fewer than three would stay.
    m = ("n", "c", "s", "cc", "cs", "ss")
    inv = _inverse(*m)
    beta = [" + ".join(f"{inv[''.join(sorted(f'{i}{j}'))]} * {y}" for j, y in enumerate(("y", "yc", "ys"))) for i in range(3)]
    rounds = ", u1 AS (SELECT *, TRUE AS used, 0.4 * (MAX(v) OVER (PARTITION BY row, col) - MIN(v) OVER (PARTITION BY row, col)) AS lim FROM f)"
    for k in range(1, 11):
        rounds += f", m{k} AS (SELECT row, col, 1.0 * COUNT(*) AS n, SUM(c) AS c, SUM(s) AS s, SUM(c * c) AS cc, SUM(c * s) AS cs, SUM(s * s) AS ss, SUM(v) AS y, SUM(v * c) AS yc, SUM(v * s) AS ys FROM u{k} WHERE used GROUP BY 1, 2), b{k} AS MATERIALIZED (SELECT row, col, n, {', '.join(f'{e} AS b{i}' for i, e in enumerate(beta))} FROM m{k})"
        rounds += f", x{k} AS (SELECT u.*, n, used AND ABS(v - b0 - b1 * c - b2 * s) > lim AS bad FROM u{k} u JOIN b{k} USING (row, col)), u{k + 1} AS MATERIALIZED (SELECT row, col, t, v, c, s, used AND NOT (bad AND n - SUM(CAST(bad AS INT)) OVER (PARTITION BY row, col) >= 3) AS used, lim FROM x{k})"
    at5 = f"b0 + b1 * {math.cos(2 * math.pi * 5 / 24)!r} + b2 * {math.sin(2 * math.pi * 5 / 24)!r}"
    put("hants", S + full.format(p=24) + rounds + f" SELECT row, col, {R('SQRT(b1 * b1 + b2 * b2)', 'amplitude')}, {R('ATAN2(b2, b1)', 'phase')}, {R(at5, 'v5')} FROM b10")
    modes = ", n AS (SELECT COUNT(DISTINCT t) AS n FROM s), r1 AS MATERIALIZED (SELECT row, col, t, v - AVG(v) OVER (PARTITION BY row, col) AS v FROM s WHERE (row, col) IN (SELECT (row, col) FROM s, n GROUP BY row, col, n HAVING COUNT(v) = n))"
    for k in (1, 2, 3):
        modes += f", p{k} AS MATERIALIZED (SELECT b.row AS br, b.col AS bc, x.row, x.col, SUM(b.v * x.v) AS bx, SUM(b.v * b.v) AS bb, SUM(x.v * x.v) AS xx FROM r{k} b JOIN r{k} x USING (t) GROUP BY 1, 2, 3, 4), s{k} AS MATERIALIZED (SELECT br, bc, SUM(CASE WHEN xx >= 1e-15 THEN bx * bx / (bb * xx) ELSE 0 END) AS total FROM p{k} WHERE bb >= 1e-15 GROUP BY 1, 2 ORDER BY ROUND(total, 10) DESC, br, bc LIMIT 1)"
        modes += f", o{k} AS MATERIALIZED (SELECT p.row, p.col, bx / bb AS slope, CASE WHEN xx > 1e-15 THEN bx * bx / (bb * xx) ELSE 0 END AS r2 FROM p{k} p JOIN s{k} USING (br, bc)), r{k + 1} AS MATERIALIZED (SELECT x.row, x.col, x.t, x.v - slope * b.v AS v FROM r{k} x JOIN o{k} USING (row, col) JOIN s{k} m ON TRUE JOIN r{k} b ON b.row = m.br AND b.col = m.bc AND b.t = x.t)"
    put("eot", S + modes + " " + " UNION ALL ".join(f"SELECT {k} AS mode, row, col, {R('slope', 'pattern')}, {R('r2', 'r2')} FROM o{k}" for k in (1, 2, 3)))
    put("eot_bases", S + modes + " " + " UNION ALL ".join(f"SELECT {k} AS mode, br AS row, bc AS col, {R('total', 'total_r2')}, CAST(DENSE_RANK() OVER (ORDER BY t) - 1 AS INT) AS t, {R('v')} FROM s{k} JOIN r{k} r ON r.row = br AND r.col = bc" for k in (1, 2, 3)))


def _nearness() -> None:
    """Straight distances, surface areas."""
    change = ", g AS (SELECT row, col, c.v AS v1, CASE WHEN s.v <> 0 THEN c.v % 5 + 1 ELSE c.v END AS v2 FROM c JOIN s USING (row, col)), h AS (SELECT * FROM g WHERE v1 <> v2), m AS (SELECT v2 FROM h GROUP BY 1 ORDER BY COUNT(*) DESC, v2 LIMIT 1)"
    near = f", d AS (SELECT g.row, g.col, MIN((g.row - h.row) * (g.row - h.row) + (g.col - h.col) * (g.col - h.col)) AS d FROM g, h WHERE g.v1 = g.v2 GROUP BY 1, 2), k AS (SELECT * FROM d ORDER BY d, row * {SIZE} + col LIMIT 150)"
    put("geomod", with_grids("cs", change + near + " SELECT g.row, g.col, CASE WHEN k.d IS NULL THEN g.v2 ELSE (SELECT v2 FROM m) END AS v FROM g LEFT JOIN k USING (row, col)"))
    for name, g, sizes in (("fractal", "a", (3, 5, 7, 9)), ("fractal_gaps", "b", (3, 5, 7))):
        edge = lambda e: f"GREATEST(0, LEAST({SIZE - 1}, {e}))"
        corner = {f"z{i}{j}": (f"p + {i}" if i else "p", f"q + {j}" if j else "q") for i in (0, 1) for j in (0, 1)}
        joins = " ".join(f"LEFT JOIN {g} {z} ON {z}.row = {edge('x.row + ' + r)} AND {z}.col = {edge('x.col + ' + c)}" for z, (r, c) in corner.items())
        z = {k: f"COALESCE({k}.v, x.v)" for k in corner}
        heron = lambda d: f"SQRT(100 + POWER({d}, 2)) / 4 * SQRT(GREATEST(0, 300 - POWER({d}, 2)))"
        areas = f", q AS (SELECT UNNEST(RANGE(-4, 4)) AS q), p AS (SELECT UNNEST(RANGE(-4, 4)) AS p), k AS (SELECT x.row, x.col, p, q, {heron(z['z10'] + ' - ' + z['z00'])} + {heron(z['z11'] + ' - ' + z['z01'])} AS e FROM {g} x CROSS JOIN p CROSS JOIN q {joins} WHERE x.v IS NOT NULL)"
        logs = f", w AS (SELECT UNNEST({list(sizes)}) AS w), l AS (SELECT row, col, LN(w * 10.0) AS lx, LN(SUM(e)) AS ly FROM k JOIN w ON p BETWEEN -(w // 2) AND w // 2 - 1 AND q BETWEEN -(w // 2) AND w // 2 - 1 GROUP BY row, col, w HAVING SUM(e) > 0), f AS (SELECT row, col, {len(sizes)} * SUM(lx * ly) - SUM(lx) * SUM(ly) AS num, {len(sizes)} * SUM(lx * lx) - SUM(lx) * SUM(lx) AS den FROM l GROUP BY 1, 2)"
        out = "CASE WHEN x.v IS NULL THEN NULL WHEN den IS NULL OR ABS(den) < 1e-15 THEN 2 ELSE GREATEST(2, LEAST(3, 2 + ABS(num / den - 2))) END"
        put(name, with_grids(g, areas + logs + f" SELECT x.row, x.col, {R(out)} FROM {g} x LEFT JOIN f USING (row, col)"))

    lag = "OVER (ORDER BY row, col)"
    auto = f", t AS MATERIALIZED (SELECT row, col, a.v AS y, b.v AS x, LAG(a.v) {lag} AS y0, LAG(b.v) {lag} AS x0 FROM a JOIN b USING (row, col) WHERE a.v IS NOT NULL AND b.v IS NOT NULL), f0 AS MATERIALIZED (SELECT 0.0 AS rho, REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a, 0 AS k, FALSE AS done FROM t)"
    for k in range(1, 11):
        auto += f", r{k} AS MATERIALIZED (SELECT SUM((y - f.a - f.b * x) * (y0 - f.a - f.b * x0)) / SUM((y0 - f.a - f.b * x0) * (y0 - f.a - f.b * x0)) AS rho FROM t, f{k - 1} f WHERE y0 IS NOT NULL), n{k} AS MATERIALIZED (SELECT r.rho, REGR_SLOPE(y - r.rho * y0, x - r.rho * x0) AS b, REGR_INTERCEPT(y - r.rho * y0, x - r.rho * x0) / (1 - r.rho) AS a FROM t, r{k} r WHERE y0 IS NOT NULL GROUP BY r.rho)"
        auto += f", f{k} AS MATERIALIZED (SELECT CASE WHEN f.done THEN f.rho ELSE n.rho END AS rho, CASE WHEN f.done THEN f.b ELSE n.b END AS b, CASE WHEN f.done THEN f.a ELSE n.a END AS a, CASE WHEN f.done THEN f.k ELSE {k} END AS k, f.done OR {'FALSE' if k == 1 else 'ABS(n.rho - f.rho) < 1e-6'} AS done FROM f{k - 1} f, n{k} n)"
    put("cochranorcutt", with_grids("ab", auto + f" SELECT {R('rho', 'rho')}, {R('a', 'intercept')}, {R('b', 'slope')}, CAST(k AS INT) AS rounds FROM f10"))
    put("cochranorcutt_residuals", with_grids("ab", auto + f" SELECT a.row, a.col, {R('t.y - f.a - f.b * t.x')} FROM a LEFT JOIN t USING (row, col), f10 f"))
    _models()


def _models() -> None:
    """Rounds of models, written out one after the other."""
    moves = ((1, 1, 1.0), (2, 2, 0.9), (2, 1, 0.1), (3, 3, 0.8), (3, 1, 0.2), (4, 2, 0.3), (4, 4, 0.7), (5, 5, 1.0))
    rounds = ", m AS (SELECT * FROM (VALUES " + ", ".join(map(str, moves)) + ") t(f, t, p)), i0 AS (SELECT CAST(v AS INT) AS k, COUNT(*) AS n FROM c WHERE v IS NOT NULL GROUP BY 1), w AS (SELECT k, COALESCE(i0.n, 0) AS n, FLOOR(COALESCE(SUM(j.n * m.p), 0) + 0.5) AS want FROM (SELECT DISTINCT t AS k FROM m UNION SELECT f FROM m) a LEFT JOIN i0 USING (k) LEFT JOIN m ON m.t = a.k LEFT JOIN i0 j ON j.k = m.f GROUP BY k, i0.n), c0 AS (SELECT row, col, v FROM c)"
    for k in (1, 2):
        was = f"c{k - 1}"
        rounds += f", d{k} AS MATERIALIZED (SELECT w.k, FLOOR(w.n + (want - w.n) * {k} / 2.0 + 0.5) - COALESCE(x.n, 0) AS short FROM w LEFT JOIN (SELECT CAST(v AS INT) AS k, COUNT(*) AS n FROM {was} GROUP BY 1) x USING (k))"
        rounds += f", s{k} AS MATERIALIZED (SELECT x.row, x.col, m.t AS k, m.p * CASE m.t WHEN 1 THEN p.v WHEN 2 THEN q.v ELSE 1 END AS s FROM {was} x JOIN m ON m.f = CAST(x.v AS INT) AND m.f <> m.t JOIN p USING (row, col) JOIN q USING (row, col)), h{k} AS MATERIALIZED (SELECT row, col, MAX(k) AS k FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY k ORDER BY s DESC, row * {SIZE} + col) AS r FROM s{k} s WHERE s > 0) JOIN d{k} USING (k) WHERE r <= short GROUP BY 1, 2)"
        rounds += f", n{k} AS MATERIALIZED (SELECT x.row, x.col, x.v, COALESCE(h.k, x.v) AS new FROM {was} x LEFT JOIN h{k} h USING (row, col)), t{k} AS MATERIALIZED (SELECT a.row, a.col, COUNT(*) - 1 AS same FROM n{k} a JOIN n{k} b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND CAST(b.new AS INT) = CAST(a.new AS INT) GROUP BY 1, 2), c{k} AS MATERIALIZED (SELECT n.row, n.col, CASE WHEN new <> v AND same < 2 THEN v ELSE new END AS v FROM n{k} n JOIN t{k} USING (row, col))"
    put("cellular_automata", with_grids("cpq", rounds + " SELECT row, col, CAST(v AS DOUBLE) AS v FROM c2"))

    def purified(threshold: float, most: int, retain: float) -> str:
        out = ", t0 AS MATERIALIZED (SELECT px.row, px.col, px.a, px.p, px.q, CAST(c.v AS INT) AS k FROM px JOIN c USING (row, col) WHERE (row + col) % 3 = 0 AND CAST(c.v AS INT) <> 0), z AS (SELECT k, COUNT(*) AS start FROM t0 GROUP BY 1)"
        for r in range(1, most + 1):
            far = " OR ".join(f"(s{b} >= 1e-10 AND ABS({b} - m{b}) > {threshold} * s{b})" for b in "apq")
            stats = ", ".join(f"AVG({b}) OVER w AS m{b}, STDDEV_SAMP({b}) OVER w AS s{b}" for b in "apq")
            out += f", f{r} AS (SELECT row, col, a, p, q, k, n, n >= 3 AND ({far}) AS far FROM (SELECT *, COUNT(*) OVER w AS n, {stats} FROM t{r - 1} WINDOW w AS (PARTITION BY k))), t{r} AS MATERIALIZED (SELECT row, col, a, p, q, f.k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k, far ORDER BY row, col) - 1 AS j FROM f{r}) f JOIN z ON z.k = f.k WHERE NOT (far AND (n - j - 1) / CAST(start AS DOUBLE) >= {retain}))"
        return PX + out + f" SELECT row, col, CAST(k AS DOUBLE) AS v FROM t{most}"

    put("purify", with_grids("apqc", purified(2.0, 5, 0.5)))
    put("purify_floor", with_grids("apqc", purified(1.2, 2, 0.85)))
    inv = _inverse("h00", "h01", "h02", "h11", "h12", "h22")
    fit = ", x AS MATERIALIZED (SELECT row, col, p.v AS p, q.v AS q, CASE WHEN s.v <> 0 THEN 1.0 ELSE 0.0 END AS y FROM p JOIN q USING (row, col) JOIN s USING (row, col)), b0 AS (SELECT 0.0 AS b0, 0.0 AS b1, 0.0 AS b2)"
    for k in range(1, 13):
        h = {"00": "w", "01": "w * p", "02": "w * q", "11": "w * p * p", "12": "w * p * q", "22": "w * q * q"}
        fit += f", g{k} AS MATERIALIZED (SELECT b0, b1, b2, {', '.join(f'SUM({e}) AS h{i}' for i, e in h.items())}, SUM(y - e) AS g0, SUM((y - e) * p) AS g1, SUM((y - e) * q) AS g2 FROM (SELECT *, e * (1 - e) AS w FROM (SELECT x.*, b.*, 1 / (1 + EXP(-GREATEST(-20, LEAST(20, b0 + b1 * p + b2 * q)))) AS e FROM x, b{k - 1} b)) GROUP BY b0, b1, b2)"
        steps = [" + ".join(f"{inv[''.join(sorted(f'{i}{j}'))]} * g{j}" for j in range(3)) for i in range(3)]
        fit += f", b{k} AS MATERIALIZED (SELECT {', '.join(f'b{i} + {e} AS b{i}' for i, e in enumerate(steps))} FROM g{k})"
    put("logistic_reg", with_grids("spq", fit + f" SELECT row, col, {R('1 / (1 + EXP(-(b0 + b1 * p + b2 * q)))')} FROM x, b12"))
